"""Quality classifier, quality rules and language ID: held-out accuracy, folds, brute-force counts, odd inputs."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from txstream.llm import langid, quality_classifier, quality_rules, queries
from txstream.llm.common import fold, table
from txstream.llm.features import vector

from . import plain
from .conftest import SCHEMA

SF = "/root/testdata/sf0.01"


def texts_of(spark, sf=SF):
    return {r.doc_id: r for r in table(spark, sf, "documents").collect()}


def test_quality_classifier_on_held_out_rows(spark):
    rows = queries.op1_quality_classifier(spark, SF).collect()
    docs = texts_of(spark)
    assert len(rows) == len(docs)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([(s >= 0.5) == y for y, s in held]) >= 0.93
    assert np.mean([g > b for g in good for b in bad]) >= 0.97


def test_held_out_labels_are_not_learnt(spark):
    from pyspark.sql import functions as F

    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    held = fold("doc_id", 3, 1)
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    found = [quality_classifier.fit(docs, x, ~held) for x in (labels, turned)]
    assert np.array_equal(found[0].weights, found[1].weights) and found[0].bias == found[1].bias


def test_ftrl_learns_a_rule_and_leaves_the_rest_at_zero():
    learner = quality_classifier.Ftrl(bits=10)
    r = np.random.default_rng(0)
    for _ in range(2_000):
        y = int(r.integers(2))
        index = np.unique(np.append(r.integers(10, 1000, 5), y))
        learner.update(index, np.full(len(index), len(index) ** -0.5, np.float32), y)
    assert learner.weights(np.array([0]))[0] < -1 and learner.weights(np.array([1]))[0] > 1
    assert (learner.weights(np.arange(1000, 1024)) == 0).all()


LONG = ("Some wörds and &&& märks, 日本 語の THE THE ﬁn \u3000 end. " * 40 + "x" * 90 + "é" * 70 + "\n \t  ") * 3


@pytest.mark.parametrize("size", [1, 2, 17, 64, 1_000, 1 << 20])
@pytest.mark.parametrize("chars", [0, 1, 4])
def test_vectors_do_not_depend_on_pieces(monkeypatch, size, chars):
    from txstream.llm import features

    whole = vector(LONG.encode(), 18, chars)
    monkeypatch.setattr(features, "PIECE", size)
    parts = vector(LONG.encode(), 18, chars)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    assert len(vector(None, 18)[0]) == len(vector(b"", 18, 4)[0]) == 0


@pytest.mark.parametrize("size", [1, 2, 17, 64, 1_000])
def test_word_likelihoods_do_not_depend_on_pieces(monkeypatch, size):
    text = LONG + "ΑΣ ΑΣ'Β İstanbul"
    r = np.random.default_rng(0)
    model = langid.Model(["a", "b"], r.normal(size=(1 << 12, 2)).astype(np.float32), 50, 12)
    whole = model.read(text)
    monkeypatch.setattr(langid, "PIECE", size)
    assert np.array_equal(whole[0], model.read(text)[0]) and whole[1] == model.read(text)[1]


def test_texts_over_a_piece_are_read_whole():
    """Several megabytes with multi-byte words: as plain Python counts them."""
    text = LONG * 180
    assert len(text) > 1 << 20
    words = plain.words_of(text)
    index, _ = langid.trigrams(text.lower(), 12)
    assert len(langid.Model(["a"], np.zeros((1 << 12, 1), np.float32), 9, 12).words(text)) == len(words)
    assert np.bincount(index, minlength=1 << 12).sum() == sum(map(len, words))
    found = dict(zip(*map(np.ndarray.tolist, vector(text.encode(), 18, 4))))
    wanted = plain.features(text, 18, 4)
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-6 for k in wanted)


def test_scores_again_in_plain_python(spark):
    """Features, learning and scores of the quality classifier, one number at a time."""
    sf, bits = "/root/testdata/sf0.001", 14
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_classifier.fit(docs, labels, ~fold("doc_id", 3, 1), limit=25, passes=2, bits=bits)
    texts = {r.doc_id: r.text for r in docs.collect()}
    usable = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    ids = sorted(usable, key=lambda k: hashlib.md5(str(k).encode()).hexdigest())[:25]
    rows = [(usable[k], plain.features(texts[k], bits)) for k in ids]
    draw = np.random.default_rng(0)
    weights, bias = plain.ftrl(rows, [k for _ in range(2) for k in draw.permutation(len(rows)).tolist()])
    assert abs(bias - model.bias) < 1e-4 and max(abs(model.weights[k] - w) for k, w in weights.items()) < 1e-4
    for r in quality_classifier.score(docs, model).collect()[:60]:
        wanted = plain.sigmoid(sum(weights.get(k, 0.0) * v for k, v in plain.features(texts[r.doc_id], bits).items()) + bias)
        assert abs(r.score - wanted) < 1e-3


def test_probabilities_again_in_plain_python(spark):
    """The verdicts of the quality rules from words, characters and the model's numbers."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = quality_rules.fit(docs, table(spark, sf, "labels"), bits=16)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.judge(docs, model).collect()[:60]:
        margin = sum(float(model.weights[k]) * v for k, v in plain.features(texts[r.doc_id], 16, quality_rules.CHARS).items()) + model.bias
        p = plain.sigmoid(model.slope * margin + model.shift)
        assert abs(r.probability - p) < 1e-4
        if abs(p - 0.5) > 1e-3:
            assert r.kept == (p >= 0.5 and not r.base_failed)


def test_quality_rules_on_held_out_rows(spark):
    docs, labels, held = table(spark, SF, "documents"), table(spark, SF, "labels"), fold("doc_id", 3, 1)
    rows = quality_rules.judge(docs, quality_rules.fit(docs, labels, ~held)).collect()
    marks = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(marks[r.doc_id], r.kept) for r in rows if r.doc_id in marks and not r.base_failed and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([k == bool(y) for y, k in judged]) >= 0.93


def test_languages_again_in_plain_python(spark):
    """Word likelihoods, expectation-maximisation and the search over all sets of languages, one number at a time."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("n_chars < 4000")
    model = langid.fit(docs, bits=12)
    rows = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: len(x[1]))
    for doc_id, text in texts[:20] + [(None, f"{texts[-1][1][:300]} {texts[-2][1][:200]} {texts[-9][1][:200]}")]:
        words = [[float(sum(float(model.loglik[plain.bucket(t, 12), j]) for t in plain.trigram_names(w))) for j in range(len(model.languages))] for w in plain.words_of(text)]
        if not words:
            assert rows[doc_id].lang_pred == "und"
            continue
        _, chosen, share, _ = plain.best_set(words, len(model.languages))
        wanted = {model.languages[c]: s for c, s in zip(chosen, share)}
        if doc_id is None:
            got = langid.infer(model.words(text))
            found = {model.languages[c]: s for c, s in zip(got[0], got[1])}
        else:
            found = dict(zip(rows[doc_id].languages, rows[doc_id].proportions))
            assert rows[doc_id].score == pytest.approx(max(found.values())) and found[rows[doc_id].lang_pred] == max(found.values())
        assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 0.02 for k in wanted) and abs(sum(found.values()) - 1) < 1e-6


def test_sets_of_languages_against_all_sets():
    r = np.random.default_rng(0)
    for _ in range(60):
        n, k = int(r.integers(3, 30)), int(r.integers(2, 5))
        words = r.normal(-10, float(r.choice([0.5, 1, 2])), (n, k))
        words[np.arange(n), r.integers(0, min(k, 3), n)] += float(r.choice([0.5, 1, 2]))
        worth, chosen, _, _ = plain.best_set(words.tolist(), k)
        found, share, loglik = langid.infer(words)
        assert sorted(found) == list(chosen) or loglik - np.log(n + 1) * (len(found) - 1) > worth - 1e-3
        assert share.tolist() == sorted(share, reverse=True)


def test_rare_languages_are_learnt(spark):
    rows = [(k, f"the words of text {k}", "en", "s", 0) for k in range(900)] + [(1_000 + k, "ünnep és szó", "hu", "s", 0) for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    few = langid.sampled(docs, 20).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in few} == {"en": 20, "hu": 3}
    assert langid.fit(docs, limit=20).languages == ["en", "hu"]


def test_gain_tells_languages_from_random_letters(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    r = np.random.default_rng(0)
    noise = [(k, " ".join("".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(40)), None, "s", 0) for k in range(20)]
    assert all(x.gain < 0 for x in langid.identify(spark.createDataFrame(noise, SCHEMA), model).collect())
    assert langid.identify(docs, model).where("gain < 0").count() == 0


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.mark.parametrize("text", ["", "a", "a a a a", "a b c a b c x", "x\ny\nx\n \n \nx", "é　b #*$%&|<>\x1c\x85 c", "p q r s p q r s t p q", "\ta  b\r\nc\x0bd\x0ce"])
def test_base_rules(text):
    assert quality_rules.base(text.encode()) == brute_base(text)


def test_quality_rules_over_documents(spark):
    rows = {r.doc_id: r for r in queries.op2_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    docs = texts_of(spark, "/root/testdata/sf0.001")
    assert rows.keys() == docs.keys()
    for k, r in rows.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(docs[k].text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.probability >= quality_rules.THRESHOLD)


def test_quality_rules_verdicts(spark):
    rows = queries.op2_quality_rules(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k for y, k in judged if y]) >= 0.98
    assert np.mean([not k for y, k in judged if not y]) >= 0.9


def test_calibration_maps_margins_to_frequencies():
    r = np.random.default_rng(3)
    margins = r.normal(0, 2, 5_000)
    labels = (r.random(5_000) < 1 / (1 + np.exp(-(0.5 * margins - 1)))).astype(int)
    slope, shift = quality_rules.platt(margins, labels)
    assert abs(slope - 0.5) < 0.06 and abs(shift + 1) < 0.12
    assert quality_rules.platt(margins, np.ones(5_000, int)) == (1.0, 0.0)


def test_language_id_on_held_out_rows(spark):
    rows = queries.op6_language_id(spark, SF).collect()
    docs = texts_of(spark)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(map(str.isalpha, docs[r.doc_id].text or "")))
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert np.mean(held) >= 0.99


def test_a_mixture_is_found(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    by = {}
    for r in docs.where("n_chars > 800").collect():
        by.setdefault(r.lang, r.text)
    a, b = sorted(by)[:2]
    words = model.words(by[a][:600] + " " + by[b][:300])
    chosen, share, _ = langid.infer(words)
    assert [model.languages[c] for c in chosen] == [a, b] and 0.5 < share[0] < 0.85
    assert len(langid.infer(model.words(by[a][:600]))[0]) == 1
    assert sorted(np.round(langid.mixture(words)[0], 2).tolist())[:-2] == [0.0] * (len(model.languages) - 2)


def test_odd_rows(odd, labels, empty, odd_rows):
    for docs in (odd, empty):
        n = docs.count()
        for marks in (labels, labels.limit(0)):
            q = quality_classifier.score(docs, quality_classifier.fit(docs, marks, bits=12), fold("doc_id", 3, 1)).collect()
            assert len(q) == n and all(0 <= r.score <= 1 and r.held_out is not None for r in q)
            j = quality_rules.judge(docs, quality_rules.fit(docs, marks, bits=12)).collect()
            assert len(j) == n
        found = langid.identify(docs, langid.fit(docs, bits=10)).collect()
        assert len(found) == n
    by = {r.doc_id: r for r in found} or {r.doc_id: r for r in langid.identify(odd, langid.fit(odd)).collect()}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (4, 5, 6, 11))
    assert by[9].lang_pred == by[13].lang_pred == "fr" and by[1].lang_pred == "en"
    assert langid.identify(odd, langid.from_counts({})).where("lang_pred != 'und'").count() == 0


def test_unlabelled_rules_leave_the_base_to_decide(odd, labels):
    rows = quality_rules.judge(odd, quality_rules.fit(odd, labels.limit(0), bits=12)).collect()
    assert all(r.kept != r.base_failed for r in rows)


def test_clashing_columns(clashing, labels):
    assert quality_classifier.score(clashing, quality_classifier.fit(clashing, labels, bits=12)).count() == 15
    assert quality_rules.judge(clashing, quality_rules.fit(clashing, labels, bits=12), carry=("text", "carry_0")).count() == 15
    assert langid.identify(clashing, langid.fit(clashing, bits=10), carry=tuple(clashing.columns)).count() == 15


def test_a_carried_text_is_sent_once(odd, odd_rows):
    for carry in (("text",), ("lang", "text", "doc_id")):
        found = langid.identify(odd, langid.fit(odd, bits=10), carry=carry)
        sent = found._jdf.queryExecution().optimizedPlan().children().apply(0).output().size()
        assert sent == 3 + len(carry) - 1
        at = [("doc_id", "text", "lang").index(c) for c in carry]
        assert sorted(map(repr, (tuple(r[f"carry_{k}"] for k in range(len(carry))) for r in found.collect()))) == sorted(repr(tuple(row[a] for a in at)) for row in odd_rows)

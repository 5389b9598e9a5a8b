"""Mixing, token counts, GIF media, packing, WARC and the pipeline."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from txstream.llm import features, gif, gif_media, mixing, near_dedup, packing, queries, token_counts, tokens, warc
from txstream.llm.common import scratch, table

from ..compare import same
from .conftest import SCHEMA, prose

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- mixing
@pytest.mark.parametrize("name", ["op3_mixing", "op5_near_dedup", "op10_warc"])
def test_queries_give_what_their_sql_gives(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_quantiles_follow_the_distribution(spark):
    rates = [0.05, 0.9, 3.0, 8.0, 30.0]
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"))
    for rate in rates:
        draws = int(max(1, -(-rate // mixing.STEP)))
        counted = docs.select(mixing.copies(F.col("doc_id"), F.lit(draws), mixing.cumulated(F.lit(rate / draws))).alias("n"))
        mean, variance = counted.agg(F.avg("n"), F.var_pop("n")).first()
        assert abs(mean - rate) < 5 * (rate / 20_000) ** 0.5 and abs(variance / rate - 1) < 0.1


def test_weights_set_the_expected_shares(spark):
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"), F.when(F.col("id") < 4_000, "big").when(F.col("id") < 5_900, "mid").otherwise("small").alias("source"))
    found = {r.source: r["count"] for r in mixing.mix(docs, {"big": 1.0, "mid": 2.0, "small": 1.0}).groupBy("source").count().collect()}
    assert abs(found["big"] - 1_500) < 200 and abs(found["mid"] - 3_000) < 300 and abs(found["small"] - 1_500) < 200
    assert {r.source for r in mixing.mix(docs, {"mid": 1.0}).select("source").distinct().collect()} == {"mid"}


def test_mixing_odd_rows(spark, odd, empty, clashing):
    assert mixing.mix(empty).count() == 0
    rows = mixing.counted(odd).collect()
    assert len(rows) == 15 and all(r["__mix_copies"] >= 0 for r in rows)
    copies = [r["__mix_copies"] for r in rows if r.doc_id == 9]
    assert copies[0] == copies[1]
    found = mixing.mix(odd).collect()
    assert len(found) == sum(r["__mix_copies"] for r in rows)
    assert sorted(map(repr, mixing.mix(odd.repartition(5)).collect())) == sorted(map(repr, found))
    assert mixing.mix(clashing, details=False).columns == clashing.columns


def test_mixing_keeps_columns_of_the_names_it_adds(spark, odd):
    names = ["mix_rate", "MIX_COPIES", "mix_replica", "mix_key", "mix_key_", "__mix_rate", "__mix_copies", "__mix_source", "__mix_key", "__mix_salt", "salt_of"]
    clash = odd.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    found = mixing.mix(clash)
    assert found.columns == [*clash.columns, "mix_rate_", "mix_copies_", "mix_replica_", "mix_key__"]
    path = scratch(spark, "mix-test")
    found.write.parquet(path)
    back = spark.read.parquet(path)
    plain = {(r.doc_id, r.mix_replica, r.mix_key) for r in mixing.mix(odd).collect()}
    assert {(r.doc_id, r.mix_replica_, r.mix_key__) for r in back.collect()} == plain and back.where("mix_rate != 0").count() == 0


def test_many_sources_are_mixed_alike(monkeypatch, odd):
    few = sorted(map(repr, mixing.mix(odd).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert sorted(map(repr, mixing.mix(odd).collect())) == few


# ---------------------------------------------------------------- token counts
def test_token_counts_by_hand(spark):
    wanted = {}
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    for r in table(spark, SF, "documents").collect():
        n = len(whole.encode(r.text or "", add_special_tokens=False).ids)
        docs, total = wanted.get((r.source, r.lang), (0, 0))
        wanted[r.source, r.lang] = (docs + 1, total + n) if n else (docs, total)
    found = queries.op7_token_counts(spark, SF).collect()
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in found} == {k: v for k, v in wanted.items() if v[0]}
    assert {r.tokenizer for r in found} == {queries.EXACT}


def test_token_counts_take_in_documents_without_tokens(spark, odd, tmp_path):
    odd.write.parquet(f"file://{tmp_path}/documents.parquet")
    found = {(r.source, r.lang): r for r in queries.op7_token_counts(spark, f"file://{tmp_path}").collect()}
    assert {k: r.docs for k, r in found.items()} == Counter((r.source, r.lang) for r in odd.collect())
    assert found["s0", None].tokens == 0  # a group of an empty text alone


def test_commits_count_once_and_survive_compaction(spark):
    store = token_counts.Rollups(spark, scratch(spark, "rollups"))
    assert store.totals().count() == 0
    rows = spark.createDataFrame([("a", "en", 5), ("a", None, 7), (None, "en", None), ("a", "en", 5)], "source string, lang string, n int")
    assert store.commit("b-1", token_counts.inserts(rows, "v1", "n")) and not store.commit("b-1", token_counts.inserts(rows, "v1", "n"))
    totals = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in store.totals().collect()}
    assert totals() == {("a", "en", "v1"): (2, 10), ("a", None, "v1"): (1, 7), (None, "en", "v1"): (1, 0)}
    one = rows.where("n = 7")
    store.commit("b-2", token_counts.revisions(one, ("v1", "n"), ("v2", F.col("n") + 1)))
    store.compact()
    assert not store.commit("b-2", token_counts.deletes(rows, "v1", "n"))
    store.commit("b-3", token_counts.deletes(rows.where("n = 5").limit(1), "v1", "n"))
    store.compact()
    assert totals() == {("a", "en", "v1"): (1, 5), ("a", None, "v2"): (1, 8), (None, "en", "v1"): (1, 0)}
    assert sorted(r.name for r in store.committed().collect()) == ["b-1", "b-2", "b-3"] and store.has("b-1")
    with pytest.raises(ValueError):
        store.commit("../x", rows)


def test_a_commit_while_compacting_counts_once(spark, monkeypatch):
    store = token_counts.Rollups(spark, scratch(spark, "rollups"))
    one = spark.createDataFrame([("a", "en", 5)], "source string, lang string, n int")
    store.commit("b-1", token_counts.inserts(one, "v", "n"))
    summed = token_counts.summed
    with monkeypatch.context() as m:
        def slow(rows):
            m.setattr(token_counts, "summed", summed)
            assert store.commit("b-2", token_counts.inserts(one, "v", "n"))
            return summed(rows)

        m.setattr(token_counts, "summed", slow)
        assert store.compact()
    for _ in range(2):
        assert [(r.docs, r.tokens) for r in store.totals().collect()] == [(2, 10)]
        store.compact()


def test_token_counts_of_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert queries.op7_token_counts(spark, f"file://{tmp_path}").count() == 0


def test_token_counts_odd_rows(odd, empty, clashing):
    assert token_counts.counted(empty).count() == 0 and token_counts.counted(clashing).count() == 15
    assert token_counts.summed(token_counts.inserts(token_counts.counted(odd), "v", "tokens")).agg(F.sum("docs")).first()[0] == 15


# ---------------------------------------------------------------- GIF
def lzw_encoded(samples, least):
    """Plain LZW with a growing table, as encoders write it."""
    clear, table_, width, bits = 1 << least, {}, least + 1, []

    def put(code):
        bits.extend((code >> k) & 1 for k in range(width))

    def reset():
        nonlocal width
        table_.clear()
        table_.update({bytes([k]): k for k in range(clear)})
        width = least + 1

    reset()
    put(clear)
    now, new = b"", clear + 2
    for s in samples:
        if now + bytes([s]) in table_:
            now += bytes([s])
            continue
        put(table_[now])
        if new < 4096:
            table_[now + bytes([s])] = new
            if new == 1 << width:
                width += 1
            new += 1
        else:
            put(clear)
            reset()
            new = clear + 2
        now = bytes([s])
    if now:
        put(table_[now])
    if new == 1 << width and width < 12:
        width += 1
    put(clear + 1)
    bits += [0] * (-len(bits) % 8)
    return bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("n", [1, 7, 500, 60_000])
@pytest.mark.parametrize("least", [2, 4, 8])
def test_streams_of_other_encoders(n, least):
    r = random.Random(n)
    samples = [r.choice([0, 1, 3, r.randrange(1 << least)]) for _ in range(n)]
    assert gif.lzw(lzw_encoded(samples, least), least).tolist() == samples


@pytest.mark.parametrize("rows", [1, 3, 256, 257, 1000])
def test_frames_round_trip(rows):
    samples = np.random.default_rng(rows).integers(0, 256, 192 * rows).astype(np.uint8)
    for values in (samples, samples % 60, samples * 0 + 32):
        found = gif.decode(gif.encode(values))
        assert b"".join(a.tobytes() for a, _ in gif.samples(found)) == values.tobytes()
        shown = list(gif.shown(found))
        assert b"".join(c[: f.height, :, 0].tobytes() for f, c in zip(found.frames, shown)) == values.tobytes()
        assert all(f.delay == 10 and f.disposal == 1 for f in found.frames)
        seen_through = [f.transparent is not None for f in found.frames]
        assert not seen_through[0] and (all(seen_through[1:]) or values is samples)
        first = values[: 192 * 256].tobytes()
        assert lzw_decoded(gif.lzw_stream(first), 8) == first == gif.lzw(gif.lzw_stream(first), 8).tobytes()


def lzw_decoded(data, least):
    """A plain decoder: bit by bit, code by code."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, at, width, table_, last, out = 1 << least, 0, least + 1, [], b"", b""
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table_, width, last = [bytes([k]) for k in range(clear)] + [b"", b""], least + 1, b""
            continue
        if code == clear + 1:
            return out
        entry = table_[code] if code < len(table_) else last + last[:1]
        out += entry
        if last and len(table_) < 4096:
            table_.append(last + entry[:1])
        if len(table_) == 1 << width and width < 12:
            width += 1
        last = entry


def test_the_writers_codes_name_strings():
    """Text is written with codes for strings, and the table is cleared when it is full."""
    text = " ".join(f"word{k % 700} and" for k in range(9_000)).encode()
    codes = gif.lzw_codes(text)
    assert sum(c > 257 for c in codes) > 0.8 * len(codes) and codes.count(256) > 1 and max(codes) > 3_500
    assert gif.lzw(gif.lzw_stream(text), 8).tobytes() == text and len(gif.lzw_stream(text)) < 0.5 * len(text)


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 3_839, 3_840, 3_841, 9_999])
def test_streams_without_a_repetition(n):
    """A run of literals fills the table entry by entry: every width and clear code at its place."""
    values = bytes((k * 7 + k // 256 * 31) % 256 for k in range(n))
    assert lzw_decoded(gif.lzw_stream(values), 8) == values == gif.lzw(gif.lzw_stream(values), 8).tobytes()


def test_a_full_table_may_stay():
    """Streams of encoders that go on with a full table."""
    r = random.Random(3)
    values = bytes(r.randrange(256) for _ in range(30_000))
    table_, width, bits, now, new = {bytes([k]): k for k in range(256)}, 9, "", b"", 258
    bits += f"{256:09b}"[::-1]
    for k in range(len(values)):
        one = values[k : k + 1]
        if now + one in table_:
            now += one
            continue
        bits += f"{table_[now]:0{width}b}"[::-1]
        if new < 4096:
            table_[now + one] = new
            width += new == 1 << width and width < 12
            new += 1
        now = one
    bits += f"{table_[now]:0{width}b}"[::-1] + f"{257:0{width}b}"[::-1]
    data = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    assert gif.lzw(data, 8).tobytes() == values


def animation(frames, width=4, height=2, palette=bytes(range(12))):
    import struct

    out = [b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + palette, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for left, top, w, h, pixels, disposal, clear, flags in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 5, clear or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + b"\x02" + gif.sub_blocks(lzw_encoded(pixels, 2)))
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_and_palettes():
    data = animation([(0, 0, 4, 2, [1] * 8, 1, None, 0), (1, 0, 2, 1, [2, 3], 2, 3, 0), (0, 1, 1, 1, [2], 3, None, 0), (3, 1, 1, 1, [0], 0, None, 0)])
    shown = list(gif.shown(gif.decode(data)))
    colour = lambda k: [3 * k, 3 * k + 1, 3 * k + 2, 255]
    assert shown[0][0, 0].tolist() == colour(1)
    assert shown[1][0, 1].tolist() == colour(2) and shown[1][0, 2].tolist() == colour(1)  # index 3 is transparent
    assert shown[2][0, 1].tolist() == [0, 0, 0, 0] and shown[2][1, 0].tolist() == colour(2)  # the area of frame 2 was cleared
    assert shown[3][1, 0].tolist() == colour(1) and shown[3][1, 3].tolist() == colour(0)  # frame 3 was undone


def test_histograms_count_what_is_shown(spark):
    """Red at 0, 64, 128 and 192; a see-through frame over another, one over a cleared area, one partly off the canvas."""
    palette = bytes(x for k in range(4) for x in (64 * k, 0, 0))
    whole = (0, 0, 4, 2, [1] * 8)
    data = [
        animation([(*whole, 1, None, 0), (1, 0, 2, 1, [2, 3], 1, 3, 0)], palette=palette),
        animation([(*whole, 2, None, 0), (1, 0, 2, 1, [2, 3], 1, 3, 0)], palette=palette),
        animation([(*whole, 1, None, 0), (3, 0, 2, 1, [2, 3], 1, None, 0)], palette=palette),
    ]
    media = spark.createDataFrame([(k, 0, bytearray(d)) for k, d in enumerate(data)], "doc_id long, n_bytes long, media binary")
    red = [[0, 0, 9, 0, 1, 0, 0, 0], [0, 0, 8, 0, 1, 0, 0, 0], [0, 0, 8, 0, 1, 0, 0, 0]]
    rows = {r.doc_id: r for r in gif_media.media_columns(media).collect()}
    assert [rows[k].histogram[:8] for k in range(3)] == red
    # the samples as shown: what is see-through shows the frame before, unless that was cleared
    assert [bytes(rows[k].payload) for k in range(3)] == [bytes([1] * 8 + last) for last in ([2, 1], [2, 3], [2, 3])]
    assert [(f.starts_cs, f.ends_cs, f.left, f.width, sum(f.histogram[:8])) for f in rows[2].frames] == [(0, 5, 0, 4, 8), (5, 10, 3, 2, 1)]
    assert [r.feature.split(":")[:8] for r in gif_media.digests(media).orderBy("doc_id").collect()] == [[str(x) for x in h] for h in red]


def test_interlaced_rows():
    data = animation([(0, 0, 1, 10, [0, 0, 1, 2, 2, 1, 3, 3, 3, 3], 0, None, 0x40)], 1, 10)
    assert gif.decode(data).frames[0].indices[:, 0].tolist() == [0, 1, 2, 3, 1, 3, 2, 3, 0, 3]


def test_broken_files():
    whole = gif.encode(np.zeros(192, np.uint8))
    for bad in (b"PNG" + whole, whole[:13] + whole[13:800] + b"\x99"):
        with pytest.raises(Exception):
            gif.decode(bad)


def test_media_of_documents(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    rows = queries.op8_gif_media(spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys()
    for r in rows:
        data = docs[r.doc_id].encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        red = np.bincount(np.frombuffer(payload, np.uint8) // 32, minlength=8).tolist()
        assert r.feature == ":".join(map(str, red * 3))


def test_media_odd_rows(odd, empty, clashing):
    assert gif_media.media_columns(gif_media.stored_media(empty)).count() == 0
    rows = gif_media.media_columns(gif_media.stored_media(odd)).collect()
    assert [bytes(r.payload) for r in rows if r.doc_id in (4, 5)] == [b" " * 192] * 2
    assert all(r.frames[-1].ends_cs == 10 * len(r.frames) and sum(r.histogram) == 3 * len(r.payload) for r in rows)
    assert gif_media.digests(gif_media.stored_media(clashing)).count() == 15


# ---------------------------------------------------------------- packing
def check_packed(rows, docs, with_ids=True):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    wanted = Counter((d, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 2])) for d, t in docs)
    pieces = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at, found, now = 0, Counter(), None
    for r in pieces:
        assert r.sequence_id * 4096 + r.offset == at and r.length > 0 and r.offset + r.length <= 4096
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        now = (r.doc_id, []) if r.start == 0 else now
        assert now[0] == r.doc_id and len(now[1]) == r.start
        now[1].extend(r.ids)
        at += r.length
        if len(now[1]) == r.doc_tokens:
            found[now[0], tuple(now[1])] += 1
    assert found == wanted


def test_packing_documents(spark):
    docs = table(spark, SF, "documents")
    rows = packing.pack(docs.repartition(3)).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()])
    thin = queries.op9_packing(spark, SF)
    assert thin.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_packing_odd_rows(odd, odd_rows, empty, clashing):
    check_packed(packing.pack(odd).collect(), [(r[0], r[1]) for r in odd_rows])
    assert packing.pack(empty).count() == 0 and packing.pack(clashing).select("doc_id").count() >= 15


@pytest.mark.parametrize("text", ["It's they'll A'S don't. İstanbul ΑΣ, ΣΑΣ. éa <|endoftext|>x ０１ ½ 'tis a.,b c. d, ß. é, Ａ. ́ a, ’s ÷, 中文, x\x1cy\x85z ǅ. ﬁ", ".,", "", " \n", "ﬀ. é, a" * 50, "q" * 300 + "."])
def test_tokens_are_the_librarys(text):
    found = tokens.loaded(tokens.default_path())
    for _ in range(2):
        assert np.frombuffer(found.ids(text.encode()), "<u4").tolist() == found.whole.encode(text, add_special_tokens=False).ids


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 2)
    fresh = tokens.WordTokenizer(tokens.default_path())
    text = "one two, three four five. two three"
    assert np.frombuffer(fresh.ids(text.encode()), "<u4").tolist() == fresh.whole.encode(text, add_special_tokens=False).ids and len(fresh) == 2


def test_words_that_come_once_take_no_place(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "RECENT_WORDS", 4, raising=False)
    fresh = tokens.WordTokenizer(tokens.default_path())
    text = " ".join(f"once{c}" for c in "abcdefghij") + " river stone river stone, stone, more and once river"
    for _ in range(2):
        assert np.frombuffer(fresh.ids(text.encode()), "<u4").tolist() == fresh.whole.encode(text, add_special_tokens=False).ids
    assert {b"river", b"stone"} <= set(fresh) and len(fresh) <= 3 and len(fresh.recent) <= 4


def test_a_worker_keeps_words_of_one_operator_and_holds_few_rows(spark, monkeypatch):
    made = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda rows, run, schema, *more: made.append(run) or rows)
    near_dedup.sketches(spark.createDataFrame([], SCHEMA), 2)
    packing.cut(spark.createDataFrame([], "doc_id long, part long, part_start long, doc_tokens long, ids binary"))
    sketch, cut = made
    n = 2_500
    features.vector(b"winter stone", 18)
    tokens.loaded(tokens.default_path()).ids(b"winter stone")
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"river {k} stone" for k in range(n)])], names=["doc_id", "text"])
    found = list(sketch(iter([batch])))
    assert max(x.num_rows for x in found) <= 1_000 and [d for x in found for d in x.column(0).to_pylist()] == list(range(n))
    assert near_dedup._words and not features._words and not tokens._loaded
    ids = [np.arange(k % 7 + 1, dtype="<u4").tobytes() for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([len(x) // 4 for x in ids]), pa.array(np.cumsum([0, *(len(x) // 4 for x in ids[:-1])])), pa.array(ids)], names=["doc_id", "doc_tokens", "at", "ids"])
    found = list(cut(iter([batch])))
    assert [t for x in found for piece in x.column(7).to_pylist() for t in piece] == np.frombuffer(b"".join(ids), "<u4").tolist()
    assert not near_dedup._words and not features._words and not tokens._loaded


def test_marks_and_capitals_without_the_library():
    fresh = tokens.WordTokenizer(tokens.default_path())
    text = 'river*** Stone,### Ñar%%% ÉTÉ&&& ciónÀ!! wo) ß." été::: a,b'
    wanted = fresh.whole.encode(text, add_special_tokens=False).ids
    fresh.ids(b'*** ,### %%% &&& !! ) ." ::: a,b')
    fresh.whole = None
    assert np.frombuffer(fresh.ids(text.encode()), "<u4").tolist() == wanted


@pytest.mark.parametrize("text", ["<|endoftext|> <|endoftext|>. a<|startoftext|> x<|endoftext|", "l's, 'S. d''' it's### 's*** 12.5, 3)) a_ b_, ×, ÷. à×. Ð, Þ; ÿ?", 'é, É### ñ̃. İ! ª, µ. ß"', "x\x00, \x1f. ​, ﻿. a ,  b."])
def test_odd_words_are_the_librarys(text):
    found = tokens.loaded(tokens.default_path())
    for _ in range(3):
        assert np.frombuffer(found.ids(text.encode()), "<u4").tolist() == found.whole.encode(text, add_special_tokens=False).ids


def test_packing_more_rows_than_a_worker_holds(spark):
    docs = [(k, f"word {k} of {'stone ' * (k % 7)}") for k in range(2_017)] + [(None, None), (1, "")]
    check_packed(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect(), docs)


# ---------------------------------------------------------------- WARC
PAGES = "page_id long, url string, html string"


def test_archives_hold_whole_records(spark):
    html = "<p>a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\né</p>"
    rows = [(3, "http://h/1", html), (1, "http://h/2\r\nX: y", html), (7, None, None), (8, "http://h/3", ""), (9, "http://h/4", "other"), (9, "http://h/4", "other"), (None, "http://h/5", html), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, PAGES)
    path = scratch(spark, "warc-test")
    warc.write_archives(pages, path, date="2020-01-01T00:00:00Z")
    back = warc.read_archives(spark, path)
    payloads = Counter(bytes(r.payload) for r in back.collect() if r.payload is not None)
    assert payloads == {html.encode(): 1, b"": 1, b"other": 2, b"alone": 1}
    found = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolved(back).collect())
    n = len(html.encode())
    assert found == Counter([(1, "response", None, n), (3, "revisit", 1, n), (None, "revisit", 1, n), (7, "response", None, 0), (8, "revisit", 7, 0), (9, "response", None, 5), (9, "response", None, 5), (None, "response", None, 5)])


@pytest.mark.parametrize("tail", ["", "\r", "\n", "\r\n", "\r\n\r", "\r\n\r\n", "\r\r\n\r\n\r\n", "x\r\n\r\nWARC/1.1\r\n\r\n", "\n" * 9])
def test_payloads_that_look_like_separators(spark, tail):
    rows = [(k, f"http://h/{k}", f"{'y' * k}{tail}") for k in range(1, 8)] + [(9, "u", "\r\n" * 40_000 + tail)]
    path = scratch(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), path)
    assert {(r.page_id, bytes(r.payload).decode()) for r in warc.read_archives(spark, path).collect()} == {(k, h) for k, _, h in rows}


def test_broken_archives(spark):
    record = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n".encode()
    assert [c for _, c in warc.parsed(iter([record[:20], record[20:], record]))] == [b"abc"] * 2
    for bad in (record[:-5], b"HTTP/1.1\r\n\r\n", record.replace(b"3", b"2"), record.replace(b"3", b"300")):
        with pytest.raises(ValueError):
            list(warc.parsed(iter([bad])))


def test_plain_archives_are_read(spark, tmp_path):
    import gzip

    path = scratch(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], PAGES).coalesce(1), path)
    file = next(x for x in __import__("pathlib").Path(path.removeprefix("file:")).iterdir() if x.name.endswith(".gz"))
    (tmp_path / "a.warc").write_bytes(gzip.decompress(file.read_bytes()))
    assert {bytes(r.payload) for r in warc.read_archives(spark, f"file://{tmp_path}").collect()} == {b"one", b"two"}


def test_a_table_of_revisits(spark):
    """A payload that a third of the pages has, others in small groups, and many that are unique; no payload moves."""
    rows = [(k, f"http://h/{k}", "<p>the same" if k % 3 == 0 else f"<p>group {k % 40}" if k % 3 == 1 else f"<p>own {k}") for k in range(600)]
    pages = spark.createDataFrame(rows, PAGES).repartition(7)
    firsts = {}
    for k, _, html in rows:
        firsts.setdefault(html, k)
    found = warc.round_trip(pages).collect()
    assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found} == {(k, len(h), *(("response", None) if firsts[h] == k else ("revisit", firsts[h]))) for k, _, h in rows}
    assert len(found) == 600


def test_payloads_are_not_shuffled(spark):
    pages = spark.createDataFrame([(k, "u", f"<p>{k // 2}") for k in range(50)], PAGES)
    before = spark.conf.get(warc._BY_SPLIT)
    for threshold in ("-1", "10m"):  # with and without broadcasts
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set(warc._BY_SPLIT, "false")
        try:
            with warc.staged(pages) as rows:
                found = warc.stored(warc.revisits(rows), "revisits")
                joined = rows.join(found.hint("shuffle_hash"), ["split", "row"], "left")
                plan = joined._jdf.queryExecution().executedPlan().toString()
                for part in plan.split("Exchange hashpartitioning")[1:]:
                    assert "html" not in part
                assert "Sort [" not in plan and plan.count("Exchange hashpartitioning") <= 1
                assert "html" not in warc.revisits(rows)._jdf.queryExecution().executedPlan().toString()
                assert joined.count() == 50
                sizes = [r["count"] for r in rows.groupBy("split").count().collect()]
                assert len(sizes) == min(pages.rdd.getNumPartitions(), 4)
        finally:
            spark.conf.set(warc._BY_SPLIT, before)
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES)
    assert {r.page_id: r.record_type for r in warc.round_trip(pages, least_bytes=3).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_no_pages_and_clashing_names(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    pages = spark.createDataFrame([(1, "u", "x", 5, 6)], PAGES + ", sha1 int, payload_bytes int")
    assert warc.round_trip(pages).first().payload_digest == base64.b32encode(hashlib.sha1(b"x").digest()).decode()


# ---------------------------------------------------------------- the pipeline
def test_pipeline_step_by_step(spark):
    from txstream.llm import langid, quality_rules

    from .test_near_dedup import brute

    from . import plain

    docs = table(spark, SF, "documents")
    model = langid.fit(docs)

    def spoken(text):
        """One number at a time: the best set of languages, its largest share, and its likelihood against chance."""
        if len(text or "") > 1_500:  # plain Python is slow; long texts are told by the operator's own inference
            words, alone = model.read(text)
            _, share, loglik = langid.infer(words)
            return max(share) >= corpus_pipeline.LEAST_SHARE and loglik >= alone
        names = [plain.trigram_names(w) for w in plain.words_of(text)]
        if not names:
            return False
        words = [[sum(float(model.loglik[plain.bucket(t, model.bits), j]) for t in w) for j in range(len(model.languages))] for w in names]
        _, _, share, loglik = plain.best_set(words, len(model.languages))
        return max(share) >= corpus_pipeline.LEAST_SHARE and loglik >= -3 * sum(map(len, names)) * math.log(model.alphabet + 1)

    kept = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
        kept[name] = frame.collect()
        frame = spark.createDataFrame(kept[name], docs.schema)
    every = docs.collect()
    assert {r.doc_id for r in kept["language_id"]} == {r.doc_id for r in every if spoken(r.text)}
    rules = quality_rules.fit(spark.createDataFrame(kept["language_id"], docs.schema), table(spark, SF, "labels"))
    from .test_models import brute_base

    passed = {r.doc_id for r in kept["quality_rules"]}
    for r in sorted(kept["language_id"], key=lambda r: len(r.text))[:120]:
        counted = brute_base(r.text)
        margin = sum(float(rules.weights[k]) * v for k, v in plain.features(r.text, rules.bits, rules.chars).items()) + rules.bias
        p = plain.sigmoid(rules.slope * margin + rules.shift)
        if abs(p - 0.5) > 1e-3:
            assert (r.doc_id in passed) == (counted[0] >= 50 and 100 * counted[4] <= 50 * counted[0] and p >= 0.5)
    groups = brute([(r.doc_id, r.text) for r in kept["quality_rules"]], 5, 80)
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted(k for k, (_, c) in groups.items() if c == k)
    copies = {r.doc_id: r["__mix_copies"] for r in mixing.counted(spark.createDataFrame(kept["near_dedup"], docs.schema)).collect()}
    assert Counter(r.doc_id for r in kept["mixing"]) == {k: n for k, n in copies.items() if n}
    check_packed(corpus_pipeline.pack(spark, frame, SF).collect(), [(r.doc_id, r.text) for r in kept["mixing"]])
    by_text = {r.doc_id: r for r in every}
    assert all(r == by_text[r.doc_id] for r in kept["near_dedup"])


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    """Of two texts under one id, one has a copy elsewhere: the other stays, as do rows without an id."""
    a, b, c = (prose(k, 60) for k in (1, 2, 3))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 2), (2, a, "en", "s", 3), (3, c, "en", "s", 4), (3, c, "en", "s", 4), (4, b, "en", "s", 5), (None, a, "en", "s", 6)]
    for order in (rows, rows[::-1]):
        found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(order, SCHEMA), SF).collect()
        assert Counter(r.text for r in found) == {a: 2, b: 1, c: 1} and sum(r.doc_id is None for r in found) == 1
        assert sorted(r.doc_id for r in found if r.doc_id is not None and r.text == c) == [3]


def test_stages_take_odd_rows(spark, odd, empty, clashing):
    for docs in (odd, empty, clashing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            # filters only take away; mixing repeats small sources as often as their rates say
            most = docs.count() if stage is not corpus_pipeline.mix else sum(r["__mix_copies"] for r in mixing.counted(docs).collect())
            assert out.count() <= most
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_texts_that_stay_are_not_shuffled_for_those_that_go(spark, monkeypatch):
    from txstream.operators import joins

    monkeypatch.setattr(joins, "FEW", 0)
    rows = [(k, prose(k // 2 if k < 20 else k, 80), "en", "s", 1) for k in range(400)]
    found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted(r.doc_id for r in found.collect()) == [k for k in range(400) if k >= 20 or k % 2 == 0]
    shuffled = []
    own = corpus_pipeline.sifted
    monkeypatch.setattr(corpus_pipeline, "sifted", lambda *a: shuffled.append(out := own(*a)) or out)
    corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert 10 <= shuffled[0][0].count() < 100

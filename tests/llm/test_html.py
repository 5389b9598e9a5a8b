import html as html_
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from txstream.llm import html_extract, markup, queries
from txstream.llm.common import table

PAGES = "page_id long, url string, html string"


def test_articles_of_pages(spark):
    """Against a plain reading of the one form that these pages have."""
    sf = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in queries.op4_html_extraction(spark, sf).collect()}
    pages = table(spark, sf, "pages").collect()
    assert rows.keys() == {p.page_id for p in pages}
    for p in pages:
        inside = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        parts = [html_.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))) for x in re.split(r"</?(?:p|h1)>", inside)]
        wanted = "\n\n".join(" ".join(x.split()) for x in parts if x.split())
        r = rows[p.page_id]
        assert (r.url, r.text, r.n_chars) == (p.url, wanted, len(wanted))


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("", []),
        ("plain text &amp; more", [(0, "plain text & more")]),
        ("a < b and c > d", [(0, "a < b and c > d")]),
        ("<p>one<p>two<br>three<hr>four", [(0, "one"), (0, "two three"), (0, "four")]),
        ("<nav>menu<div>deep</div></nav><p>x", [(2, "menu"), (2, "deep"), (0, "x")]),
        ("<article><header><h1>T</h1></header><p class='ad-box'>buy</p><p>a</p></article>", [(1, "T"), (2, "buy"), (1, "a")]),
        ("<article>a<script>'</article>'</script>b<!-- c > --><style>p{}</style></article>d", [(1, "ab"), (0, "d")]),
        ("<article>a<section id=comments><p>c</p><article>d</article></section><p>e</article>", [(1, "a"), (2, "c"), (2, "d"), (1, "e")]),
        ("<main><div hidden>h</div><div>v&nbsp;&#x41;&eacute;</div></main>", [(2, "h"), (1, "v Aé")]),
        ("<article><p title=it's>q</p><p data-x='a>b'>r</article><footer>f", [(1, "q"), (1, "r"), (2, "f")]),
        ("<head><title>t</title><body><article>x</article>", [(1, "x")]),
        ("<script>never closed <p>a", []),
        ("<article>a<!-- never closed </article>", [(1, "a")]),
        ("<div class=notice><div>n</div></div></div></nav><p>k", [(2, "n"), (0, "k")]),
        ("<form><label>l</label></form><aside>s</aside><button>b</button><p>k", [(2, "l"), (2, "s"), (2, "b"), (0, "k")]),
    ],
)
def test_blocks(page, wanted):
    assert markup.blocks(page) == wanted


def test_scanning_odd_markup_is_quick():
    for bad in ("<" * 20_000, "<a " * 20_000, "<!--" * 20_000, "<p class='" * 20_000, "<div>" * 20_000, "&#" * 20_000, "<p x=\"" + "y" * 200_000):
        markup.blocks(bad)


def brute_counts(streams, length):
    found = defaultdict(set)
    for k, s in enumerate(streams):
        for at in range(len(s) - length + 1):
            found[tuple(s[at : at + length].tolist())].add(k)
    return Counter(len(v) for v in found.values()), len(found)


@pytest.mark.parametrize("length", [1, 3, 5, 8])
def test_suffix_arrays_count_pages(length):
    r = np.random.default_rng(length)
    streams = [r.integers(0, 4, n).astype(np.uint64) for n in (0, 1, 7, 8, 30, 60, 60, 3)]
    streams.append(streams[4].copy())
    marks, counts = html_extract.repeated_counts(streams, length)
    wanted, distinct = brute_counts(streams, length)
    assert Counter(counts.tolist()) == wanted and len(set(marks.tolist())) == distinct == len(marks)


def test_suffixes_are_sorted():
    r = np.random.default_rng(0)
    tokens = r.integers(0, 3, 200)
    suffixes, _ = html_extract.sorted_suffixes(tokens, 8)
    heads = [tuple(tokens[s : s + 8]) for s in suffixes]
    assert heads == sorted(heads)


def site(spark, pages=30, seed=1):
    """Pages without article marks on two hosts: shared menus and closing lines, own paragraphs."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    menu, close = ("m1 m2 m3 m4 m5 m6 m7 m8 m9", "c1 c2 c3 c4 c5 c6 c7 c8 c9 c10")
    rows, wanted = [], {}
    for k in range(pages):
        own = [say(25), say(40)]
        rows.append((k, f"http://{'one' if k % 3 else 'two'}.example/{k}", f"<body><div>{menu}</div><p>{own[0]}</p><p>{own[1]}</p><div>{close}</div>"))
        wanted[k] = "\n\n".join(own)
    rows.append((900, "http://lone.example/", f"<div>{menu}</div><p>alone here</p>"))
    wanted[900] = f"{menu}\n\nalone here"
    return spark.createDataFrame(rows, PAGES), wanted


@pytest.mark.parametrize("shard", [1 << 20, 200])
def test_repetition_finds_unmarked_boilerplate(spark, monkeypatch, shard):
    """One suffix array a host, and many: the same outcome."""
    monkeypatch.setattr(html_extract, "SHARD", shard)
    pages, wanted = site(spark)
    rows = html_extract.extract(pages.repartition(5)).collect()
    assert {r.page_id: r.text for r in rows} == wanted
    assert all(r.n_repeated == 2 for r in rows if r.page_id != 900)


def test_quoted_passages_stay_in_articles(spark):
    passage = " ".join(f"q{k}" for k in range(60))
    rows = [(k, "http://h.example/", f"<nav>a b c d e f g h i</nav><article><p>{passage}</p><p>own {k}</p></article>") for k in range(4)]
    assert {r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()} == {f"{passage}\n\nown {k}" for k in range(4)}


def test_odd_pages(spark):
    long_page = "<article>" + "<p>some words here</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (2, "http://[bad", ""), (2, "http://[bad", ""), (None, "http://h/", "<p>x"), (5, "http://h/", long_page), (6, "http://h/", "<nav>only")]
    found = html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert Counter((r.page_id, r.n_chars) for r in found) == Counter({(1, 0): 1, (2, 0): 2, (None, 1): 1, (5, 20_000 * 17 - 2): 1, (6, 0): 1})
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0
    clashing = spark.createDataFrame([(1, "u", "<p>x", 3, 4, 5)], PAGES + ", row int, host int, print int")
    assert html_extract.extract(clashing).first().text == "x"


def test_repetition_decides_on_pages_with_articles_too(spark):
    menu = "m1 m2 m3 m4 m5 m6 m7 m8 m9"
    rows = [(k, "http://h.example/", f"<div>{menu}</div><article><p>story {k}</p></article><p>{' '.join(f'n{k}x{j}' for j in range(12))}</p>") for k in range(6)]
    found = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(6):
        assert found[k].text == f"story {k}\n\n{' '.join(f'n{k}x{j}' for j in range(12))}"
        assert (found[k].n_repeated, found[k].repeated_tokens) == (1, 10 + 1)  # the menu, its boundary and the next one


def test_repetition_alone_finds_articles_without_their_marks(spark):
    """The same pages with nothing that names the article: quotations in it stay, as most of its region is its own."""
    from pyspark.sql import functions as F

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    marked = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    plain = {r.page_id: r for r in html_extract.extract(pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))).collect()}
    other = [k for k, r in plain.items() if r.text != marked[k]]
    # a host of three pages has the title of two as the advertisement of the third
    assert len(other) <= 2 and all(len(plain[k].text) > 0.9 * len(marked[k]) for k in other)


def test_quotations_stay_in_a_region_of_own_text(spark):
    menu, passage, share = own_words("m", 9), own_words("q", 30), own_words("s", 10)
    rows = []
    for k in range(8):
        quoted = f"<p>{passage}</p>" if k < 4 else ""
        rows.append((k, f"http://h.example/{k}", f"<body><ul><li>{menu}</ul><div><p>{own_words(f'o{k}', 80)}</p>{quoted}<p>{share}</p></div>"))
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {k: own_words(f"o{k}", 80) + (f"\n\n{passage}" if k < 4 else "") for k in range(8)}


def test_regions():
    page = "<body><div>a<ul><li>b<li>c</ul>d</div><p>e</p></section><table><tr><td>f</table>g"
    found = markup.placed(page)
    assert [t for _, t, _ in found] == list("abcdefg")
    by = {t: r for _, t, r in found}
    assert by["a"] == by["d"] and by["b"] == by["c"] and by["e"] == by["g"] and len(set(by.values())) == 4


def own_words(name, n):
    return " ".join(f"{name}x{j}" for j in range(n))


def test_copies_keep_their_text(spark):
    """Equal pages, a row that stands twice, a near copy, and pages without a host: none repeats another away."""
    body = f"<p>{own_words('a', 30)}</p><p>{own_words('b', 40)}</p>"
    text = f"{own_words('a', 30)}\n\n{own_words('b', 40)}"
    rows = [(1, "http://h.example/a", body), (2, "https://h.example/a", body), (2, "https://h.example/a", body), (3, "http://h.example/a?print", body + "<p>print view</p>")]
    rows += [(4, None, body), (5, "http://[bad", body), (6, None, body)]
    found = html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert Counter((r.page_id, r.text) for r in found) == Counter({(1, text): 1, (2, text): 2, (3, text + "\n\nprint view"): 1, (4, text): 1, (5, text): 1, (6, text): 1})


def test_quotes_of_two_unmarked_pages_stay(spark):
    menu, passage = own_words("m", 9), own_words("q", 60)
    rows = [(k, f"http://h.example/{k}", f"<div>{menu}</div><p>{own_words(f'o{k}', 50)}</p>" + (f"<p>{passage}</p>" if k < 2 else "")) for k in range(8)]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {k: own_words(f"o{k}", 50) + (f"\n\n{passage}" if k < 2 else "") for k in range(8)}


def test_same_template_around_different_articles_is_repeated(spark):
    rows = [(k, "http://h.example/", f"<div>{own_words('m', 9)}</div><article><p>{own_words(f'o{k}', 30)}</p></article>") for k in range(6)]
    assert {r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()} == {own_words(f"o{k}", 30) for k in range(6)}


def test_unique_runs_stay_in_blocks_with_boilerplate(spark):
    """A paragraph mostly repeated keeps its own words; one that is less than half repeated loses the repeated ones."""
    b, c = own_words("b", 30), own_words("c", 20)
    rows = [(k, f"http://h.example/{k}", f"<p>{b} {own_words(f'o{k}', 25)}</p><p>{own_words(f'p{k}', 15)} {c} {own_words(f'q{k}', 15)}</p>plain<br>{own_words(f'r{k}', 9)}") for k in range(5)]
    found = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(5):
        assert found[k].text.split("\n\n") == [own_words(f"o{k}", 25), own_words(f"p{k}", 15), own_words(f"q{k}", 15), f"plain {own_words(f'r{k}', 9)}"]
        assert (found[k].n_repeated, found[k].repeated_tokens) == (0, 1 + 30 + 20)

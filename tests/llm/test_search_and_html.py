import re
import time

import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F

from millrace.llm import hamming, htmltext


def brute(codes, queries, k):
    ids = np.array([i for i, _ in codes])
    c = np.array([x for _, x in codes], np.int64)
    out = {}
    for i, q in queries:
        d = np.bitwise_count((c ^ np.int64(q)).view(np.uint64))
        at = np.lexsort((ids, d))[:k]
        out[i] = [(int(ids[j]), int(d[j]), r + 1) for r, j in enumerate(at)]
    return out


def run(spark, codes, queries, k):
    make = lambda x: spark.createDataFrame(x, "id long, code long")
    got = {}
    for r in hamming.search(make(codes), make(queries), k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.distance, r.rank))
    return got


@pytest.mark.parametrize(("n", "spread", "k"), [(3, 64, 5), (60, 64, 4), (3000, 12, 10), (2500, 64, 3)])
def test_exact(spark, n, spread, k):
    """Clustered and random codes, many copies, ties, fewer rows than k."""
    rng = np.random.default_rng(n)
    centers = rng.integers(-(1 << 63), 1 << 63, 5)
    codes = []
    for i in range(n):
        x = int(centers[i % 5])
        for b in rng.integers(0, 64, rng.integers(0, max(1, spread))):
            x ^= (1 << int(b)) if b < 63 else -(1 << 63)
        codes.append((i, x))
    codes += [(n + i, codes[0][1]) for i in range(min(n, 40))]
    queries = [c for c in codes if c[0] % 7 == 0]
    assert run(spark, codes, queries, k) == brute(codes, queries, k)


def test_every_answer_comes_from_probing_rounds(spark, monkeypatch):
    """At the size of the smallest tables, too: radii grow one at a time, and each join is on a segment's value."""
    made, joins = [], []
    real_rounds, real_table = hamming.rounds, hamming.table

    def counted(sizes):
        for probe, covered in real_rounds(sizes):
            made.append((len({sum(map(int.bit_count, x[:1])) for _, x in probe}), covered))
            yield probe, covered

    def looked(df, name, *more):
        if name == "hits":
            joins.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real_table(df, name, *more)

    monkeypatch.setattr(hamming, "rounds", counted)
    monkeypatch.setattr(hamming, "table", looked)
    rng = np.random.default_rng(5)
    codes = [(i, int(x)) for i, x in enumerate(rng.integers(-(1 << 63), 1 << 63, 500))]
    assert run(spark, codes, codes[::20], 10) == brute(codes, codes[::20], 10)
    assert len(joins) >= 2 and all(n == 1 for n, _ in made) and sorted(c for _, c in made) == [c for _, c in made]
    assert all("(seg#" in j and "Cartesian" not in j and "Join Cross" not in j for j in joins)


@pytest.mark.parametrize(("sizes", "most"), [([3, 2], 4096), ([4, 4, 3], 5), ([7] * 8 + [8], 100)])
def test_rounds_cover_what_they_say(sizes, most):
    """After each round every difference of that many bits has some segment whose part of it was probed."""
    probed = [set() for _ in sizes]
    for probe, covered in hamming.rounds(sizes, most):
        assert sum(len(x) for _, x in probe) <= most
        for j, x in probe:
            assert not probed[j] & set(x)
            probed[j] |= set(x)
        # A difference avoids all probed masks only if each segment's part does: the fewest bits of such a one.
        least = [min((v.bit_count() for v in range(1 << w) if v not in p), default=99) for w, p in zip(sizes, probed, strict=True)]
        assert sum(least) > min(covered, sum(sizes))
    assert sum(least) >= 99


def test_repeated_queries_and_extra_columns(spark):
    codes = spark.createDataFrame([(i, i * 7919, "x") for i in range(50)], "id long, code long, distance string")
    asked = codes.where("id < 2").union(codes.where("id < 1"))
    got = hamming.search(codes, asked, 3).collect()
    assert sorted(r.query_id for r in got) == [0] * 6 + [1] * 3 and len({(r.id, r.distance) for r in got if r.query_id == 0}) == 3


def test_codes_and_edges(spark):
    rows = spark.createDataFrame([(1, [0.5, -1.0, 0.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [1.0] * 70)], "id long, v array<double>")
    got = {r.id: r.c for r in rows.select("id", hamming.code_of(F.col("v")).alias("c")).collect()}
    assert got == {1: 0b1001, 2: 0, 3: 0b10, 4: -1}
    empty = spark.createDataFrame([], "id long, code long")
    assert hamming.search(empty, empty).count() == 0
    assert run(spark, [(None, 5), (2, 7)], [(9, 5)], 3) == {9: [(2, 1, 1)]}
    assert sum(hamming.widths(51_282)) == 64 and len(hamming.widths(51_282)) == 5


@pytest.fixture(scope="module")
def model():
    return htmltext.model()


def test_messages_are_exact_marginals():
    """Against the sum over all labellings of a small forest."""
    rng = np.random.default_rng(0)
    pages = [htmltext.Page("<div><p>a</p><ul><li>b</li></ul></div>"), htmltext.Page("<p>x</p>")]
    f = htmltext.Forest(pages)
    n = len(f.parent)
    u, pair = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
    want, total = np.zeros((n, 2)), 0.0
    for bits in range(1 << n):
        y = [(bits >> i) & 1 for i in range(n)]
        p = np.exp(sum(u[i, y[i]] for i in range(n)) + sum(pair[y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        total += p
        for i in range(n):
            want[i, y[i]] += p
    got, joint = f.marginals(u, pair)
    np.testing.assert_allclose(got, want / total, atol=1e-9)
    for i in range(n):
        if f.parent[i] >= 0:
            np.testing.assert_allclose(joint[i].sum(0), got[i], atol=1e-9)


def test_held_out_accuracy(model):
    pages = [htmltext.Page(p) for p in htmltext.labelled_pages(200, 77)]
    f = htmltext.Forest(pages)
    content = f.marginals(f.unary(model[0]), model[1])[0][:, 1] > 0.5
    known = f.label >= 0
    assert (content == (f.label == 1))[known].mean() > 0.99


CASES = {
    "<article><h1>A &amp; B</h1><p>one <b>two<br><p>three</p></article><footer>&copy; x</footer>": "A & B\none two\nthree",
    "<nav><ul><li><a href='/x'>Home</a></li></ul></nav><article><p>Real \n text&nbsp;here</p><script>var t='</p>';</script></article>": "Real text here",
    "<div class='ad'>buy</div><main><p>kept</p><aside>more</aside></main>": "kept",
    "<article><p>text</p><section class='comments'><p>first!</p></section></article>": "text",
    "<article><p>a</p><!-- <p>no</p> --><style>p{}</style><form><input><button>Go</button></form><p>b</article>": "a\nb",
    "<div class='cookie-notice'>We use cookies</div><article><p>q &lt;x&gt; &#233;</p></article>": "q <x> é",
    "": "", "<article></article>": "", "<script>alert(1)": "",
    "<article><p data-x=it's>Hello world text here</p><p>More text here</p></article>": "Hello world text here\nMore text here",
    '<article><p title=5" >Hello</p><p class = "a>b" id=\'c">d\'>more</p></article>': "Hello\nmore",
    '<article><p title="never closed>Hello there</p><p>more of it</p></article>': "Hello there\nmore of it",
    "<article><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> end of it <svg><title>no</title><text>label</text></svg></p></article>": "Energy E=m end of it label",
    "<article><p>" + "plain words " * 30 + "</p><p class='related'>" + "long words of the article " * 20 + "</p><p class='ad'>Buy now</p></article>": "\n".join([" ".join(["plain words"] * 30), " ".join(["long words of the article"] * 20)]),
    "<nav><a href=/>Home</a></nav><h1>No article here</h1><p>" + "some words of text " * 9 + "</p><p>and some more of them</p><footer>imprint</footer>": "No article here\n" + " ".join(["some words of text"] * 9) + "\nand some more of them",
}


@pytest.mark.parametrize("source", CASES)
def test_pages(model, source):
    whole = f"<!DOCTYPE html><html><head><title>t</title></head><body>{source}</body></html>" if source and "alert" not in source else source
    assert htmltext.extract([whole], *model) == [CASES[source]]


@pytest.mark.parametrize("source", [
    "<div>" * 100_000 + "text", "<ul><li><ul>" + "<div>" * 50_000 + "<li>a</li>" * 50_000, "<span class=ad>" * 50_000 + "<p>x" * 50_000,
    "<div>" * 50_000 + "</b>" * 50_000 + "</li>" * 50_000, "<p a=\"" * 100_000, "<p =" * 100_000 + "'" * 100_000, "<a " * 100_000, "<!--" * 100_000,
])
def test_deep_and_broken_pages_take_linear_time(model, source):
    began = time.process_time()
    htmltext.extract([source, "<article><p>short</p></article>"], *model)
    assert time.process_time() - began < 20


def test_table(spark, model):
    rows = [(1, "u", None), (2, None, "<p>" * 3000 + "x"), (3, "u", "<article><p>" + "word " * 50_000 + "</p></article>"), (3, "u", "<article><p>" + "word " * 50_000 + "</p></article>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2)})
    got = sorted(htmltext.main_text(d).collect(), key=lambda r: r.page_id)
    assert got[0].text == "" and got[0].n_chars == 0 and got[2].n_chars == 249_999 and got[2] == got[3] and len(got) == 4
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_of_the_table(spark):
    import html as h

    import duckdb

    from millrace.llm import queries

    got = {r.page_id: r.text for r in queries.op7_html_extraction(spark, SF).collect()}
    for i, source in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", inner)]
        assert got[i] == "\n".join(b for b in blocks if b)

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOC, components, docs, words
from pyspark.sql import functions as F

from millrace.llm import paritysketch as P


def corpus(seed=5):
    """Families of near copies at all degrees, copies, short texts and loners."""
    rng = random.Random(seed)
    out = [None, "", " \t ", "A b", "a B", "a b c", "one"]
    for f in range(12):
        base = words(rng.choice((12, 30, 60, 200, 700)), rng.random(), 5000)
        out.append(" ".join(base))
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            out.append(" ".join(w).upper() if rng.random() < 0.2 else "\n".join(w))
    out += [out[10], out[10], *(" ".join(words(40, 1000 + i, 9)) for i in range(10)), *(" ".join(words(100, 2000 + i, 5000)) for i in range(30))]
    return out


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_same_components_as_all_pairs(spark, k, percent):
    texts = corpus()
    want = components(texts, k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in P.join(docs(spark, texts), k, percent).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len({c for _, c in want}) < len(texts) - 20


def test_a_group_whose_members_are_not_all_alike(spark):
    """A chain: neighbours are linked, others are not; and a star of copies of one text with edits of their own."""
    base = words(200, 1, 9000)
    chain = []
    for i in range(25):
        w = list(base)
        for j in range(i):
            w[j * 7] = f"c{j}"
        chain.append(" ".join(w))
    star = [" ".join(words(200, 2, 9000))]
    for i in range(25):
        w = star[0].split()
        for j in range(4):
            w[(i * 8 + j * 2) % 200] = f"s{i}{j}"
        star.append(" ".join(w))
    texts = chain + star
    want = components(texts, 4, 85)
    got = {r.doc_id: r.component_id for r in P.join(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in want]


def test_no_similar_pair_is_missed_by_the_blocks():
    rng = np.random.default_rng(2)
    for n in (6, 7, 9, 14, 30, 90, 400, 1500):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            s = 2 * len(a)
            gone = min(len(a) - 1, int(rng.integers(0, 15 * s // 185 // 2 + 1)))
            b = np.unique(np.append(a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, gone + 1))).astype(np.uint64)))
            common = len(np.intersect1d(a, b))
            if 100 * common < 85 * (len(a) + len(b) - common) or np.array_equal(a, b):
                continue
            every = np.unique(np.append(P.signatures(a, 85)[0], P.signatures(b, 85)[0]))
            # Whichever keys are to be left out, some block is met in.
            for share in (0, 0.02, 0.1, 0.5, 1):
                shared = every[rng.random(len(every)) < share]
                (ka, ca), (kb, cb) = P.signatures(a, 85, shared), P.signatures(b, 85, shared)
                _, i, j = np.intersect1d(ka, kb, return_indices=True)
                assert P.passes(ca[i], cb[j]).any()
            x = np.frombuffer(P.sketch(a), np.uint64) ^ np.frombuffer(P.sketch(b), np.uint64)
            assert np.bitwise_count(x).sum() <= 15 * (len(a) + len(b)) // 185


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
@pytest.mark.parametrize(("n", "sets"), [(7, 20_000), (10, 20_000), (14, 20_000), (18, 20_000), (30, 20_000), (60, 10_000), (100, 10_000), (300, 10_000), (1000, 10_000)])
def test_no_key_is_hot_among_random_sets(n, sets, k, percent):
    """The hottest key of random sets belongs to at most one of ten thousand (and one more, by chance)."""
    rng = np.random.default_rng(n)
    all_keys = [P.signatures(np.unique(x), percent)[0] for x in rng.integers(0, 1 << 63, (sets, n)).astype(np.uint64) * np.uint64(2)]
    assert np.unique(np.concatenate(all_keys), return_counts=True)[1].max(initial=0) <= 1 + sets * 1e-4
    assert max(map(len, all_keys)) <= 2 * n


def test_a_passage_that_many_share_makes_no_hot_key(spark):
    """Texts of their own around one passage: its keys are found in the sample and left out, and links stay."""
    passage = words(100, 7, 9000)
    texts = [" ".join(words(100, 1000 + i, 9000) + passage + words(100, 9000 + i, 9000)) for i in range(200)]
    texts += [t.replace(t.split()[5], "changed", 1) for t in texts[:10]]
    d = docs(spark, texts)
    shared = P.shared_keys(d, 4, 85)
    assert len(shared)
    hottest = lambda shared: P.keys(d, 4, 85, shared).groupBy("key").count().agg(F.max("count")).first()[0]
    assert hottest(None) > 8 and hottest(shared) < P.SHARED
    got = {r.doc_id: r.component_id for r in P.join(d).collect()}
    assert [got[i] for i in range(210)] == [c for _, c in components(texts, 4, 85)]


def test_long_runs_come_in_pieces():
    """Whatever the batches, the rows come out in order, whole runs together and long ones piece by piece."""
    rng = np.random.default_rng(3)
    key = np.sort(np.concatenate([np.full(n, k) for k, n in enumerate(rng.choice([1, 2, 5, 40, 300], 60))])).astype(np.int64)
    old, P.ROWS = P.ROWS, 16
    try:
        for cut in (1, 7, 33, 1000):
            batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + cut]), pa.array(np.arange(len(key))[i : i + cut])], ["key", "x"]) for i in range(0, len(key), cut)]
            pieces = list(P._runs(iter(batches), 16))
            assert np.concatenate([c[1] for c, _ in pieces]).tolist() == list(range(len(key)))
            open_ = None
            for (k, _), more in pieces:
                if open_ is not None:
                    assert not len(k) or set(k) == {open_}
                assert not more or len(set(k)) == 1
                if open_ is None and not more and len(k):
                    assert all((key == x).sum() == (k == x).sum() for x in set(k))
                open_ = k[0] if more else None
            assert max(len(c[0]) for c, _ in pieces) <= 16 + 2 * cut + 40 + 16
    finally:
        P.ROWS = old


def test_bounded_pieces_lose_no_link(monkeypatch, spark):
    """Tiny bounds, so that nearly all runs are long and dealt out in pieces: the same components as by all pairs."""
    from pyspark import cloudpickle

    monkeypatch.setattr(P, "PIECE", 4)
    rows = P.ROWS
    texts = corpus(11)
    base = words(300, 77, 9000)
    for i in range(40):
        w = list(base)
        for j in range(i % 6):
            w[(i * 7 + j * 31) % 300] = f"e{i}{j}"
        texts.append(" ".join(w))
    cloudpickle.register_pickle_by_value(P)
    monkeypatch.setattr(P, "ROWS", 8)
    try:
        got = {r.doc_id: r.component_id for r in P.join(docs(spark, texts)).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(P)
    assert P.ROWS == 8 and rows > 8
    assert [got[i] for i in range(len(texts))] == [c for _, c in components(texts, 4, 85)]


def test_unsettled_components_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(ValueError, match="not settled"):
        P.components(links, 2, most=2)


def test_kept_frames_are_given_back_on_errors(spark, monkeypatch):
    freed = []
    monkeypatch.setattr(P.Held, "free", lambda self: freed.append(1))
    monkeypatch.setattr(P, "_labelled", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        P.join(docs(spark, ["a"]))
    assert freed


def test_components_of_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200, i) for i in range(201, 260)] + [(300 + i, 301 + i) for i in range(40)]
    links = [(min(a, b), max(a, b)) for a, b in links if a != b]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    for parts in (1, 2):
        got = {r.node: r.label for r in P.components(spark.createDataFrame(links, "a long, b long"), parts).collect()}
        assert got == {n: find(n) for n in up}


def test_edges(spark):
    assert P.join(spark.createDataFrame([], DOC)).count() == 0
    d = spark.createDataFrame([(1, "a b c d e"), (None, "a b c d e"), (None, None), (1, "p q r s t"), (1, "a b c d e"), (0, "p q r s t")], "doc_id long, text string").withColumns({"n": F.lit(1), "sid": F.lit("x"), "label": F.lit(2)})
    got = sorted(((r.doc_id, r.component_id) for r in P.join(d).collect()), key=str)
    assert got == [(0, 0), (1, 0), (1, 1), (1, 1), (None, 1), (None, None)]


def test_keep_first(spark):
    t = " ".join(words(60, 9, 900))
    d = docs(spark, [t + " end", t, None, "", "other words in here again", t])
    kept = P.keep_first(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    twice = d.union(d)
    assert sorted(r.doc_id for r in P.keep_first(twice).collect()) == [0, 2, 2, 3, 3, 4]

import re

import numpy as np
import pytest
from helpers import DOC, SF, docs, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import embedder, ngrams, quality, queries

GOOD = [" ".join(words(80, i, 5000)) for i in range(60)]
BAD = [" ".join(w + "###" for w in words(80, 100 + i, 5000)) for i in range(60)]


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|é \x85\x1c\n\t日", max_size=60))
def test_base_counts(text):
    assert quality.base_counts(text.encode()) == brute(text)


def test_repeated_words_long():
    w = [b"a", b"b", b"c"] * 2000 + [f"{i}".encode() for i in range(3000)]
    assert quality.repeated(w) == 6000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\tz", max_size=25), min_size=1, max_size=6))
def test_a_text_scores_alike_in_any_batch(texts):
    table = np.random.default_rng(0).normal(size=ngrams.BUCKETS)
    alone = [ngrams.mean_of(table, [t])[0] for t in texts]
    np.testing.assert_allclose(ngrams.mean_of(table, texts), alone, atol=1e-12)
    for (u, v), a in zip(ngrams.features(texts), alone, strict=True):
        np.testing.assert_allclose(table[u] @ v if len(u) else 0.0, a, atol=1e-6)


def plain_mean(table, text):
    """The mean over the groups of n-grams, each by itself in plain whole numbers."""
    place, top = [int(x) for x in ngrams._PLACE], 1 << 32

    def bucket(h, salt):
        h ^= salt * 0x9E3779B9 % top
        h ^= h >> 15
        h = h * 0x85EBCA6B % top
        h ^= h >> 13
        return (h * 0xC2B2AE35 % top) >> (32 - ngrams.BITS)

    code = [ord(c) for c in text]
    grams = [[bucket(sum(c * place[k] for k, c in enumerate(code[i : i + n])) % top, n) for i in range(len(code))] for n in ngrams.CHARS]
    hashes = [sum(ord(c) * place[j if j < 64 else 32 + j % 32] for j, c in enumerate(w)) % top for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    grams.append([bucket(h, 101) for h in hashes])
    grams.append([bucket(1 if a == b else (a * 0x01000193 + b * 0x9E3779B1) % top, 103) for a, b in zip(hashes, hashes[1:])])
    return sum(sum(float(table[b]) for b in g) / len(g) for g in grams if g) / ngrams.GROUPS


def logistic(z):
    return 1 / (1 + np.exp(-z))


def test_scores_and_verdicts_by_brute_force(spark, labels):
    """Both classifiers' results on whole texts, against plain loops over the same trained numbers."""
    texts = [*GOOD[:20], *BAD[:20], None, "", "one", "w" * 200 + " " + "long " * 3000, "é \x85 日本 \x00 x", "a a a a"] + GOOD[40:50] + BAD[40:50]
    d = docs(spark, GOOD + BAD).union(docs(spark, texts).withColumn("doc_id", F.col("doc_id") + 1000))
    learned = ngrams.fitted(d, labels, "quality", quality.TRAIN_ROWS, quality.TRAIN_CHARS, quality.fit)
    table, bias = ngrams.fitted(d, labels, "quality", embedder.TRAIN_ROWS, embedder.TRAIN_CHARS, lambda t, y: embedder.fit(t, y).table())
    judged, scored = ({r.doc_id: r for r in x.collect()} for x in (quality.judge(d, labels), embedder.score(d, labels)))
    for i, t in enumerate(texts):
        p = logistic(learned.slope * (plain_mean(learned.weights, t or "") + learned.bias) + learned.shift)
        n, _, _, _, again = brute(t or "") if i != 43 else (3001, 0, 0, 0, 3000)
        failed = n < 50 or 100 * again > 50 * n
        row = judged[1000 + i]
        assert abs(row.quality - p) < 1e-9 and row.base_failed == failed and row.kept == (not failed and p >= 0.3)
        assert abs(scored[1000 + i].score - logistic(plain_mean(table, t or "") + bias)) < 1e-9


def test_columns_in_the_order_of_the_contract(spark):
    d = docs(spark, GOOD[:2]).select("doc_id", "text")
    got = quality.judge(d, spark.createDataFrame([], "doc_id long, quality int")).drop("text").columns
    assert got[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_repeated_ids_score_by_their_own_text(spark, labels):
    d = docs(spark, GOOD + BAD).union(spark.createDataFrame([(0, BAD[50], "en", "s", 1), (None, GOOD[1], "en", "s", 1)], DOC))
    rows = embedder.score(d, labels).collect()
    zero = sorted(r.score for r in rows if r.doc_id == 0)
    assert len(rows) == 122 and len(zero) == 2 and zero[0] < zero[1] and [r.score for r in rows if r.doc_id is None] == [r.score for r in rows if r.doc_id == 1]


def test_models_tell_good_from_bad():
    y = np.array([1.0] * 40 + [0.0] * 40)
    train = GOOD[:40] + BAD[:40]
    p = quality.fit(train, y).probability(GOOD[40:] + BAD[40:])
    assert (p[:20] > 0.7).all() and (p[20:] < 0.3).all()
    table, bias = embedder.fit(train, y).table()
    z = ngrams.mean_of(table, GOOD[40:] + BAD[40:]) + bias
    assert (z[:20] > 0).all() and (z[20:] < 0).all()


def test_folded_scores_are_the_softmax():
    m = embedder.fit(GOOD[:10] + BAD[:10], np.array([1.0] * 10 + [0.0] * 10))
    table, bias = m.table()
    for t, (u, v) in zip(GOOD[:3], ngrams.features(GOOD[:3]), strict=True):
        p = embedder.softmax(m.layer @ (v @ m.vectors[u]) + m.bias)[1]
        np.testing.assert_allclose(1 / (1 + np.exp(-(ngrams.mean_of(table, [t])[0] + bias))), p, rtol=1e-3)


def test_calibration_is_monotone_and_close():
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z + 1)))).astype(float)
    slope, shift = quality.platt(z, y)
    assert abs(slope - 0.5) < 0.08 and abs(shift - 1) < 0.15


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, 1 if i < 60 else 0, 0) for i in range(120)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_judge_edges(spark, labels):
    d = docs(spark, GOOD + BAD + [None, "", "one two", "x y z " * 40, GOOD[0], GOOD[0]]).withColumns({"kept": F.lit("mine"), "n_words": F.lit(1)})
    got = {r.doc_id: r for r in quality.judge(d, labels).collect()}
    assert len(got) == 126 and got[0].kept == "mine" and got[0]._kept and not got[60]._kept
    assert got[120].base_failed and got[120]._n_words == 0 and got[121].base_failed and got[122].base_failed and got[123].base_failed
    assert got[124]._kept and got[124].quality == got[125].quality == got[0].quality
    assert sorted(r.doc_id for r in quality.keep(d, labels).collect() if r.doc_id < 120) == list(range(60))
    assert quality.keep(d, labels).columns == d.columns
    none = quality.judge(docs(spark, GOOD[:3]), labels.where("quality = 1"))
    assert all(r.kept for r in none.collect())
    assert quality.judge(spark.createDataFrame([], DOC), labels).count() == 0


def test_long_labelled_texts_are_learned_from(spark, labels):
    """The bad ones are all longer than what of a text is learned from, and differ at their ends only."""
    bad = [" ".join(words(12_000, i, 5000)) + " " + t * 30 for i, t in enumerate(BAD[:20])]
    assert min(map(len, bad)) > quality.TRAIN_CHARS
    d = docs(spark, GOOD[:20] + bad)
    known = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, quality int")
    got = ngrams.fitted(d, known, "quality", 100, 40_000, lambda t, y: [(len(x), x[-9:], z) for x, z in zip(t, y)])
    assert len(got) == 40 and max(n for n, _, _ in got) == 40_003 and sum(end == d for n, end, y in got if y == 0 for d in {b[-9:] for b in bad}) == 20


def test_score_edges(spark, labels):
    d = docs(spark, GOOD + BAD + [None, ""]).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.score for r in embedder.score(d, labels).collect()}
    assert len(got) == 122 and got[120] == got[121] and 0 <= got[120] <= 1 and got[0] > 0.5 > got[60]
    assert embedder.score(spark.createDataFrame([], DOC), labels).count() == 0
    assert {r.score for r in embedder.score(docs(spark, ["a"]), labels.where("1 = 0")).collect()} == {0.5}


def test_held_out_accuracy(spark):
    import duckdb

    scored = {r.doc_id: r for r in queries.op5_quality_classifier(spark, SF).collect()}
    known = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    held = [(scored[i], y) for i, y in known if scored[i].held_out]
    assert all(r.held_out == (__import__("zlib").crc32(str(i).encode()) % 3 == 1) for i, r in scored.items())
    assert np.mean([r.predicted == y for r, y in held]) > 0.9

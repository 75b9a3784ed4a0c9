import zlib

import numpy as np
import pytest
from helpers import DOC, docs, words
from pyspark.sql import functions as F

from millrace.llm import packing

TEXTS = [None, "", "a", " ".join(words(5000, 1)), *[" ".join(words(40 + i, i)) for i in range(30)], "same text here", "same text here", "<|endoftext|> is in here", "é ü   x y \x1c z", "日本語" * 50]


@pytest.fixture(scope="module")
def packed(spark):
    return docs(spark, TEXTS), packing.pack(docs(spark, TEXTS)).collect()


def test_ids_are_those_of_the_tokenizers_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    odd = ["".join(chr(c) for c in rng.choice([9, 10, 13, 28, 32, 39, 65, 97, 48, 133, 160, 233, 0x3042, 0x200B, 0x1F600, 0x0301], 40)) for _ in range(300)]
    import duckdb
    from helpers import SF

    whole = [r[0] for name in ("documents", "conversations", "benchmark") for r in duckdb.sql(f"SELECT text FROM '{SF}/{name}.parquet' WHERE text IS NOT NULL").fetchall()]
    assert len(whole) > 200
    for s in [x for x in TEXTS if x] + odd + whole:
        assert list(packing.encode(s)) == [*t.encode(s, add_special_tokens=False).ids, 1]


def test_every_id_lies_in_exactly_one_piece(packed):
    _, rows = packed
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(TEXTS)))
    for i, pieces in by_doc.items():
        ids, at = packing.encode(TEXTS[i]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    full = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        full += at == packing.WINDOW
    assert full >= len(by_sequence) - 8  # at most one open sequence a shard


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(0)
    ids = [rng.zipf(1.5, n).clip(max=200).astype("<u2") for n in rng.integers(5, 60, 40)]
    df = np.zeros(packing.VOCABULARY, np.int64)
    for a in ids:
        df[np.unique(a)] += 1
    idf, mean = np.log1p((40 - df + 0.5) / (df + 0.5)), np.mean([len(a) for a in ids])
    shard = packing.Shard(ids, idf, mean)
    shard.used[[0, 7]] = True
    for seed in range(10):
        scores = []
        for d, a in enumerate(ids):
            tf = {t: (a == t).sum() for t in set(ids[seed].tolist())}
            scores.append(0 if shard.used[d] else sum(idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(a) / mean)) for t, f in tf.items() if f))
        got = shard.neighbours(seed, 3)
        np.testing.assert_allclose(np.array(scores)[got], np.sort(scores)[::-1][:3], rtol=1e-4)


@pytest.mark.parametrize("common", [0, 50, 1024])
def test_lookups_are_exact_and_ties_go_by_place(common, monkeypatch):
    """A large shard with many copies: the same documents in the same order as by scoring all, whatever the matrices hold."""
    monkeypatch.setattr(packing, "COMMON", common)
    rng = np.random.default_rng(common)
    own = [(rng.zipf(1.3, n) % 3000).astype("<u2") for n in rng.integers(1, 200, 500)]
    ids = [own[i] for i in rng.integers(0, 500, 900)]
    df = np.zeros(packing.VOCABULARY, np.int64)
    for a in ids:
        df[np.unique(a)] += 1
    idf, mean = np.log1p((900 - df + 0.5) / (df + 0.5)), np.mean([len(a) for a in ids])
    shard = packing.Shard(ids, idf, mean)
    shard.used[rng.random(900) < 0.3] = True
    tf = [dict(zip(*np.unique(a, return_counts=True))) for a in ids]
    for seed in rng.integers(0, 900, 12):
        score = [sum(idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(a) / mean)) for t, f in own.items() if t in tf[seed]) for a, own in zip(ids, tf)]
        want = sorted((d for d in range(900) if not shard.used[d] and score[d] > 0), key=lambda d: (-round(score[d], 9), d))
        for k in (1, 8, 32):
            assert list(shard.neighbours(seed, k)) == want[:k]


def test_like_documents_of_all_files_come_together(spark):
    """Near copies that lie in different partitions share a sequence; none is lost, and one key's copies are spread by their ids."""
    base = [words(60, i, 9000) for i in range(60)]
    texts = [" ".join([*base[i], f"end{j}"]) for j in range(6) for i in range(60)]
    rows = packing.pack(docs(spark, texts).repartition(7), window=256).collect()
    together = {}
    for r in rows:
        together.setdefault(r.sequence_id, set()).add(r.doc_id % 60)
    assert sorted({r.doc_id for r in rows}) == list(range(360)) and np.mean([len(x) for x in together.values()]) < 2.6


def test_a_long_seed_is_looked_up_with_all_its_ids():
    """Thirty ids that only the seed has outweigh those it shares: the shared ones have to count all the same."""
    own, shared = np.arange(1000, 1030), np.arange(100, 160)
    ids = [np.concatenate([own, shared]).astype("<u2"), *[np.arange(2000 + 50 * i, 2030 + 50 * i).astype("<u2") for i in range(40)], shared.astype("<u2"), shared[:20].astype("<u2")]
    df = np.zeros(packing.VOCABULARY, np.int64)
    for a in ids:
        df[np.unique(a)] += 1
    n, mean = len(ids), np.mean([len(a) for a in ids])
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    shard = packing.Shard(ids, idf, mean)
    shard.used[0] = True
    # The reference scores with the whole seed document, not with what the shard chose to look up.
    scores = [0 if d == 0 else sum(idf[t] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(a) / mean)) for t in set(ids[0]) & set(a)) for d, a in enumerate(ids)]
    got = shard.neighbours(0, 3)
    assert list(got) == [41, 42]
    np.testing.assert_allclose([scores[d] for d in got], sorted(scores, reverse=True)[:2])
    assert [r[0] for r in packing.pack_shard(ids, idf, mean, 400)][:3] == [0, 41, 42]


def test_similar_documents_share_a_window():
    topics = [np.concatenate([np.full(50, 100 + t), np.arange(20) + 1000 * (i + 1)]).astype("<u2") for i in range(20) for t in [i % 4]]
    df = np.zeros(packing.VOCABULARY, np.int64)
    for a in topics:
        df[np.unique(a)] += 1
    rows = list(packing.pack_shard(topics, np.log1p((20 - df + 0.5) / (df + 0.5)), 70.0, 350))
    same = [len({d % 4 for d, _, _, s, _ in rows if s == q}) for q in {r[3] for r in rows}]
    assert same[0] == 1 and np.mean(same) < 2.1


def test_statistics_cover_all_documents(spark):
    df, n, mean = packing.frequencies(packing.tokenize(docs(spark, ["a b", "a", None])))
    a = packing.encode("a")[0]
    assert n == 3 and df[a] == 2 and df[1] == 3 and mean == (3 + 2 + 1) / 3


def test_empty_and_extra_columns(spark):
    assert packing.pack(spark.createDataFrame([], DOC)).count() == 0
    extra = docs(spark, ["a b c"]).withColumns({"start": F.lit(5), "ids": F.lit("x")})
    assert packing.pack(extra).collect()[0].length == 4

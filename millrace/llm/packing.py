"""Lexical retrieval packing: sequences of similar documents, found by BM25.

Documents are tokenised once, in Arrow batches, into a table in the shared folder, and dealt out to shards by what they say: a
document's key are the winners of three races among its token ids, each run with the same lots for all documents and with idf as
speed, so that two documents share a winner as often as they share their heavy ids (weighted MinHash). Sorted by key, over
all files, documents with heavy ids in common stand together, and copies next to each other; doc_id breaks ties, so a group of copies
spreads over as many tasks as it fills. A shard is a block of consecutive documents in that order, bounded in documents and
tokens, with an inverted index of its own over token ids, as a distributed search index has; a seed is looked up in its
own shard. Inverse document frequencies and the mean length come from all documents (the count table is bounded by the vocabulary).

In a shard the first unused document is the seed; the index returns its best unused neighbours, which fill the window one after the
other. The one that no longer fits is cut, and its rest is the next window's seed, so that only the last sequence of a shard
has padding. A lookup is exact, with all ids of the seed. The ids that most documents of the shard have, whose postings would be
nearly all of the work, are scored for all its documents at once by a product of matrices, the others by their postings; who may
be among the best by that is scored once more, id by id, so that equal documents tie. Ties go by place in the shard.

Defined results: a null or empty text is the closing id alone; every id lies in exactly one piece; equal
rows are packed each for itself; very long documents span as many sequences as they need; an empty table
gives an empty result; of extra columns none is carried. All of a text counts for its key and its scores.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

WINDOW = 2048
CLOSING = 1
#: Bounds of a shard: documents and token ids (two bytes each).
SHARD_DOCS, SHARD_IDS = 4096, 8 << 20
#: Neighbours asked for at first; each further time for the same seed four times as many.
NEIGHBOURS = 8
#: How many ids of a shard are scored by a product of matrices, and by what share two ways to add up a score may differ.
COMMON, SLACK = 512, 1e-4
RACES = 3
K1, B = 1.2, 0.75
VOCABULARY = 1 << 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@cache
def tokenizer(name: str = "byte_bpe_50k.tiktoken"):
    """The byte-level BPE as ranks: the same ids as the ``tokenizers`` file gives, several times faster.

    As there, the special token's string in a text is the special token. tests/llm/test_packing.py compares both.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": 50256}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(text: str | None, closing: int = CLOSING) -> np.ndarray:
    """The ids of a text and the closing one, as little-endian unsigned 16-bit numbers."""
    ids = tokenizer().encode_to_numpy(text, allowed_special="all") if text else ()
    out = np.empty(len(ids) + 1, "<u2")
    out[:-1] = ids
    out[-1] = closing
    return out


TOKENS = "doc_id long, ids binary, counts binary"


def tokenize(docs: DataFrame) -> DataFrame:
    """``(doc_id, ids, counts)``: ids as bytes, two an id; the last row of each task has none, but its counts.

    Those are, as pairs of 64-bit numbers, ids and in how many of the task's documents they are, with the number of documents
    and of ids behind the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(VOCABULARY + 2, np.int64)
        names = [c.split()[0] for c in TOKENS.split(", ")]
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                ids = [encode(t.as_py()) for t in part.column(1)]
                for a in ids:
                    seen[np.unique(a)] += 1
                seen[VOCABULARY:] += len(ids), sum(map(len, ids))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([a.tobytes() for a in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        if seen.any():
            term = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.stack([term, seen[term]]).tobytes()], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """In how many documents each id occurs, the number of documents and their mean length: over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY + 2, np.int64)
        for b in batches:
            for x in b.column(0):
                term, n = np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1)
                total[term] += n
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(total[term], pa.int64())], ["term", "n"])

    rows = tokens.select("counts").where("counts is not null").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(VOCABULARY + 2, np.int64)
    for r in rows:
        df[r["term"]] = r["n"]
    n, length = int(df[VOCABULARY]), int(df[VOCABULARY + 1])
    return df[:VOCABULARY], n, length / max(n, 1)


def lots(idf: np.ndarray) -> np.ndarray:
    """For each race the time that each id takes."""
    drawn = np.random.default_rng(20240302).random((RACES, VOCABULARY))
    return -np.log(drawn) / np.maximum(idf, 1e-6)


def by_key(tokens: DataFrame, idf: np.ndarray) -> DataFrame:
    """``(doc_id, ids)`` sorted by key over all documents, in as many parts as shuffles have."""
    times = lots(idf).astype(np.float32)
    names = [f"k{i}" for i in range(RACES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            won = np.zeros((RACES, b.num_rows), np.int32)
            for i, ids in enumerate(b.column(1)):
                a = np.frombuffer(ids.as_buffer(), "<u2")
                won[:, i] = a[times[:, a].argmin(1)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, won), *b.columns], [*names, "doc_id", "ids"])

    keyed = tokens.select("doc_id", "ids").where("ids is not null").mapInArrow(run, ", ".join(f"{n} int" for n in names) + ", doc_id long, ids binary")
    return keyed.repartitionByRange(*names, "doc_id").sortWithinPartitions(*names, "doc_id").select("doc_id", "ids")


class Shard:
    """An inverted index with BM25 impacts over the documents of a block."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(ids)
        terms, impacts = [], []
        for a in ids:
            term, tf = np.unique(a, return_counts=True)
            terms.append(term)
            impacts.append(idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(a) / max(mean, 1e-9))))
        sizes = [len(t) for t in terms]
        self.start = np.append(0, np.cumsum(sizes))
        self.term, self.impact = np.concatenate(terms), np.concatenate(impacts)
        order = np.argsort(self.term, kind="stable")
        self.docs, self.posted = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[order], self.impact[order]
        self.at = np.searchsorted(self.term[order], np.arange(VOCABULARY + 1))
        most = np.argsort(-np.diff(self.at), kind="stable")[:COMMON]
        column = np.full(VOCABULARY, -1, np.int32)
        column[most] = np.arange(len(most))
        self.common = column >= 0
        dense, at = np.zeros((self.n, len(most)), np.float32), column[self.term]
        dense[np.repeat(np.arange(self.n), sizes)[at >= 0], at[at >= 0]] = self.impact[at >= 0]
        #: Of each seed (first axis) with each document the score by the common ids.
        self.dense = (dense > 0).astype(np.float32) @ dense.T
        self.used, self.asked = np.zeros(self.n, bool), np.zeros(VOCABULARY, bool)

    def terms_of(self, d: int) -> np.ndarray:
        return self.term[self.start[d] : self.start[d + 1]]

    def _added(self, terms: np.ndarray) -> np.ndarray:
        runs = [slice(a, b) for a, b in zip(self.at[terms].tolist(), self.at[terms + 1].tolist(), strict=True)]
        if not runs:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.docs[r] for r in runs]), np.concatenate([self.posted[r] for r in runs]), self.n)

    def _exact(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Scores of some documents, added up in the order of their ids, so that equal documents have equal ones."""
        self.asked[terms] = True
        sizes = self.start[docs + 1] - self.start[docs]
        at = np.repeat(self.start[docs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out = np.add.reduceat(np.where(self.asked[self.term[at]], self.impact[at], 0.0), np.cumsum(sizes) - sizes)
        self.asked[terms] = False
        return out

    def neighbours(self, seed: int, k: int = NEIGHBOURS) -> np.ndarray:
        """The ``k`` unused documents that score best for all ids of the seed, best first, then by position."""
        free = np.flatnonzero(~self.used)
        if not len(free):
            return free
        terms = self.terms_of(seed).astype(np.int64)
        if len(free) > k:
            score = (self.dense[seed] + self._added(terms[~self.common[terms]]))[free]
            free = free[score >= np.partition(score, len(score) - k)[len(score) - k] * (1 - SLACK) - SLACK]
        score = self._exact(free, terms)
        top = np.lexsort((free, -score))[:k]
        return free[top[score[top] > 0]]


def pack_shard(ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of each piece, with sequences numbered from 0."""
    shard, sequence, filled, unused = Shard(ids, idf, mean), 0, 0, 0
    seed, near, ask = -1, iter(()), NEIGHBOURS
    while True:
        # The next document: the seed's best unused neighbour; without one, the first unused document.
        d = next((int(x) for x in near if not shard.used[x]), -1)
        if d < 0 and seed >= 0:
            near, ask = iter(shard.neighbours(seed, ask)), 4 * ask
            d = next((int(x) for x in near), -1)
        if d < 0:
            while unused < shard.n and shard.used[unused]:
                unused += 1
            if unused == shard.n:
                return
            d = unused
        if filled == 0 or seed < 0:
            seed, near, ask = d, iter(()), NEIGHBOURS
        shard.used[d] = True
        start, n = 0, len(ids[d])
        while start < n:
            length = min(n - start, window - filled)
            yield d, start, length, sequence, filled
            start, filled = start + length, filled + length
            if filled == window:
                sequence, filled = sequence + 1, 0
                # What is left of this document begins the next window, and so it is that window's seed.
                seed, near, ask = d if start < n else -1, iter(()), NEIGHBOURS


def pack(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each piece, with the columns of ``PIECES``."""
    tokens = table(tokenize(docs), "tokens")
    df, n, mean = frequencies(tokens)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, block, keys, held, count = TaskContext.get().partitionId() << 32, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal count
            rows = list(pack_shard(block, idf, mean, window))
            d, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            crc = np.array([zlib.crc32(block[i][s : s + k].astype("<u4").tobytes()) for i, s, k, _, _ in rows], np.int64)
            total = np.array([len(a) for a in block], np.int64)[d]
            columns = [pa.array(keys, pa.int64()).take(pa.array(d)), *map(pa.array, (start, length, crc, total, base + count + seq, offset))]
            count += int(seq[-1]) + 1
            block.clear(), keys.clear()
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

        for b in batches:
            for key, ids in zip(b.column(0), b.column(1), strict=True):
                block.append(np.frombuffer(ids.as_py(), "<u2"))
                keys.append(key.as_py())
                held += len(block[-1])
                if len(block) == SHARD_DOCS or held >= SHARD_IDS:
                    held = 0
                    yield flush()
        if block:
            yield flush()

    return by_key(tokens, idf).mapInArrow(run, PIECES)

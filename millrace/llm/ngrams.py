"""Hashed word and character n-grams of texts, whole batches at a time in numpy, for the text classifiers.

A text's n-grams come in groups: runs of ``CHARS`` code points, single words, pairs of neighbouring words.
A pair of equal words is one n-gram of its own, whatever the word. Each group is averaged by itself, and the
groups' means are averaged, so long texts weigh as short ones. A text's n-grams depend on that text alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
BUCKETS = 1 << BITS
CHARS = (3, 4)
GROUPS = len(CHARS) + 2
PAD = max(CHARS)
#: Code points that are hashed at a time, so that memory does not follow the batch's size.
CHUNK = 1 << 20

_RNG = np.random.default_rng(20240229)
_PLACE = (_RNG.integers(1, 1 << 31, 64, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_WHITE = np.zeros(1 << 7, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Bucket numbers of 32-bit hashes; works in place."""
    h ^= np.uint32(salt * 0x9E3779B9 & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - BITS)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``CHUNK`` code points, of one text at least."""
    i = 0
    while i < len(texts):
        j, n = i + 1, len(texts[i])
        while j < len(texts) and n + len(texts[j]) <= CHUNK:
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def groups(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group: all texts' bucket numbers, one after the other, and where each text's begin, with the end."""
    lengths = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer(("\0" * PAD).join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths + PAD) - lengths - PAD
    inside = np.ones(len(code), bool)
    for k in range(PAD):
        inside[starts + lengths + k] = False
    at = np.append(0, np.cumsum(lengths))
    for n in CHARS:
        h = code * _PLACE[0]
        for k in range(1, n):
            h[:-k] += code[k:] * _PLACE[k]
        yield _mix(h[inside], n), at
    # A word begins where a character that is none of the white ones follows a white one or a text's edge.
    white = ~inside
    low = code < 128
    white[low] |= _WHITE[code[low]]
    solid = ~white
    begins = solid.copy()
    begins[1:] &= white[:-1]
    first = np.flatnonzero(begins)
    if not len(first):
        none = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        yield none
        yield none
        return
    where = np.flatnonzero(solid)
    word = np.cumsum(begins)[where] - 1
    place = where - first[word]
    np.minimum(place, len(_PLACE) + (place & 31) - 32, out=place)
    h = code[where] * _PLACE[place]
    words = np.add.reduceat(h, np.searchsorted(where, first), dtype=np.uint32)
    of = np.searchsorted(first, np.append(starts, len(code)))
    yield _mix(words.copy(), 101), of
    pairs = words[:-1] * np.uint32(0x01000193) + words[1:] * np.uint32(0x9E3779B1)
    pairs[words[:-1] == words[1:]] = 1
    own = np.ones(len(pairs), bool)
    own[np.clip(of[1:-1] - 1, 0, len(pairs) - 1)[(of[1:-1] > 0) & (of[1:-1] < len(words))]] = False
    yield _mix(pairs[own], 103), np.append(0, np.cumsum(np.maximum(np.diff(of) - 1, 0)))


def mean_of(table: np.ndarray, texts: list[str]) -> np.ndarray:
    """For each text the mean over its groups of the mean of ``table`` over the group's n-grams; a group without any counts 0."""
    out = np.zeros(len(texts))
    for i, j in chunks(texts):
        for bucket, at in groups(texts[i:j]):
            n = np.diff(at)
            full = np.flatnonzero(n)
            if len(full):
                out[i + full] += np.add.reduceat(table[bucket].astype(np.float64), at[:-1][full]) / n[full] / GROUPS
    return out


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their weights in the mean."""
    out = [([], []) for _ in texts]
    for i, j in chunks(texts):
        for bucket, at in groups(texts[i:j]):
            for t, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if a < b:
                    u, n = np.unique(bucket[a:b], return_counts=True)
                    out[i + t][0].append(u)
                    out[i + t][1].append(n / (b - a) / GROUPS)
    done = []
    for u, w in out:
        if not u:
            done.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
            continue
        bucket, inverse = np.unique(np.concatenate(u), return_inverse=True)
        done.append((bucket.astype(np.int32), np.bincount(inverse, np.concatenate(w)).astype(np.float32)))
    return done


def decoded(column: pa.Array) -> list[str]:
    """The texts of a binary Arrow column; null is empty, and what is no UTF-8 is replaced."""
    return [(x.as_py() or b"").decode("utf-8", "replace") for x in column]


def fitted(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, fit: Callable[[list[str], np.ndarray], object]) -> object:
    """``fit(texts, y)`` of a sample of labelled texts: at most ``rows``, the same ones each time.

    Of a text of more than ``chars`` characters four stretches of a quarter of that are learned from, spread evenly over the text. Which ones depends on a hash of doc_id; of a doc_id on several rows all texts may count, up to ``2 * rows`` in all. One task
    fits, so that neither texts nor features come to the driver: only what ``fit`` returns does.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("y"))
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "y").limit(rows)
    # At most ``rows`` small rows, by the limit above.
    some = lambda i: F.substr("text", F.floor((F.length("text") - chars // 4) * i / 3).cast("int") + 1, F.lit(chars // 4))
    text = F.when(F.length("text") > chars, F.concat_ws("\n", *map(some, range(4)))).otherwise(F.col("text"))
    got = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where("text is not null").withColumn("text", text)
    got = got.select("doc_id", "y", F.col("text").cast("binary").alias("text")).orderBy("doc_id", "y", F.xxhash64("text")).limit(2 * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for b in batches:
            texts += decoded(b.column(1))
            y += b.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(y, float)))], pa.binary())], ["model"])

    row = got.select(F.col("y").cast("double").alias("y"), "text").coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row[0]) if row else fit([], np.zeros(0))

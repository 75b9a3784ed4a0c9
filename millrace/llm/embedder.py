"""Quality classifier: supervised subword embeddings.

Every hashed word or character n-gram has a learned vector; a document's vector is the mean of its n-grams'
(each group of ``ngrams`` averaged by itself), and a softmax layer turns it into label probabilities. Vectors and
layer are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows
(``TRAIN_ROWS``, of each ``TRAIN_CHARS`` characters at most, evenly spread stretches of longer texts).

For scoring, the layer is applied to every n-gram's vector once: as both the mean and the layer are linear,
a document's logits are the mean of its n-grams' logits, and a table of one number a bucket is sent out.

Defined results: a null or empty text has the score of the bias alone; very long texts are scored whole; equal
texts get equal scores; without labels of both kinds every score is that of the one label (0.5 without any); an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams

TRAIN_ROWS, TRAIN_CHARS = 2500, 40_000
DIMENSIONS, EPOCHS, RATE = 12, 6, 6.0


@dataclass
class Model:
    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def table(self) -> tuple[np.ndarray, float]:
        """Of label 1 over label 0: each bucket's logit, and the bias."""
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(texts: list[str], y: np.ndarray, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (ngrams.BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    if len(y) and len(set(y)) < 2:
        bias[int(y[0])] = 10.0
        return Model(vectors, layer, bias)
    x = ngrams.features(texts)
    share = y.mean() if len(y) else 0.5
    weight = (0.5 / (1 - share), 0.5 / share)
    order, done = np.arange(len(y)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(order):
            rate = RATE * (1 - done / (EPOCHS * len(y)))
            done += 1
            u, v = x[i]
            own = vectors[u]
            mean = v.astype(np.float32) @ own
            p = softmax(layer @ mean + bias)
            p[int(y[i])] -= 1
            p *= weight[int(y[i])]
            back = p @ layer
            layer -= (0.2 * rate) * np.outer(p, mean)
            bias -= (0.02 * rate) * p
            # A mean over thousands of n-grams moves each a little; their own shares are rescaled to their root mean square.
            vectors[u] = own - rate * np.outer(v / max(np.sqrt(v @ v), 1e-9), back).astype(np.float32) * 0.2
    return Model(vectors, layer, bias)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``: the probability of label 1. ``labels`` has the rows to learn from."""
    table, bias = ngrams.fitted(docs, labels, label, TRAIN_ROWS, TRAIN_CHARS, lambda texts, y: fit(texts, y).table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                z = ngrams.mean_of(table, ngrams.decoded(b.column(1))) + bias
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], ["doc_id", "score"])

    plain = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))


def fold(doc_id) -> object:
    """The remainder that tells rows to learn from (0, 2) from held-out ones (1)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))

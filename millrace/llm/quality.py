"""Quality rules: fixed base rules, and a calibrated logistic regression over hashed n-grams.

The regression learns from a bounded sample of labelled rows (``TRAIN_ROWS``, of each ``TRAIN_CHARS`` characters at
most, evenly spread stretches of longer texts), by AdaGrad in numpy; a part that it does not learn from calibrates its probabilities (Platt scaling). Texts
are scored whole, in Arrow batches, against the fixed threshold ``REJECT_BELOW``.

Defined results: a null or empty text has no words, and so fails the base rules; ties, repeated rows and very
long texts need no care, as a row's result depends on its text and the model alone; without labels of both kinds
the verdict of the regression is always to keep; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngrams
from .common import fresh

TRAIN_ROWS, TRAIN_CHARS = 2500, 40_000
EPOCHS, RATE, DECAY = 6, 0.5, 1e-6
REJECT_BELOW = 0.3
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


@dataclass
class Model:
    """``weights`` over buckets and ``bias`` give a logit; ``slope`` and ``shift`` calibrate it."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, texts: list[str]) -> np.ndarray:
        z = self.slope * (ngrams.mean_of(self.weights, texts) + self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(texts: list[str], y: np.ndarray) -> Model:
    """Learns from four of five rows and calibrates on the fifth."""
    w, b = np.zeros(ngrams.BUCKETS), 0.0
    if len(set(y)) < 2:
        return Model(w, 0.0, 0.0, 60.0)
    x = ngrams.features(texts)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    own = np.flatnonzero(~held)
    # Both labels weigh alike, however rare one is.
    weight = np.where(y == 1, 0.5 / max(y[own].mean(), 1e-9), 0.5 / max(1 - y[own].mean(), 1e-9))
    seen, seen_b = np.full(ngrams.BUCKETS, 1e-8), 1e-8
    rng = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in rng.permutation(own):
            u, v = x[i]
            g = weight[i] * (1 / (1 + np.exp(-np.clip(w[u] @ v + b, -60, 60))) - y[i])
            step = g * v + DECAY * w[u]
            seen[u] += step * step
            w[u] -= RATE * step / np.sqrt(seen[u])
            seen_b += g * g
            b -= RATE * g / np.sqrt(seen_b)
    z = np.array([w[u] @ v + b for u, v in x])
    return Model(w.astype(np.float32), b, *platt(z[held] if held.any() else z, y[held] if held.any() else y))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through ``(z, y)``, by Newton steps on smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    at = np.array([1.0, 0.0])
    loss = lambda c: np.sum(np.logaddexp(0, x @ c) - t * (x @ c))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t))
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(step).max() * size < 1e-9:
            break
    return float(at[0]), float(at[1])


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = raw.split()
    n = len(words)
    chars = len(raw.decode("utf-8", "replace")) - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return n, chars, symbols, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    """How many words lie in a window of three that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    a = np.fromiter(map(seen.setdefault, words, count()), np.int64, n)
    if n < 2_000_000:
        key = (a[:-2] * n + a[1:-1]) * n + a[2:]
    else:
        key = np.unique(a[:-1] * n + a[1:], return_inverse=True)[1][:-1].astype(np.int64) * n + a[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, key)
    hit = twice[np.minimum(at, len(twice) - 1)] == key
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def judge(docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    """``docs`` plus the columns of ``FIELDS``, which are prefixed with ``_`` where ``docs`` has such ones."""
    model = ngrams.fitted(docs, labels, "quality", TRAIN_ROWS, TRAIN_CHARS, fit)
    names = fresh(docs, *(x.split()[0] for x in FIELDS.split(", ")))
    raw = fresh(docs, "raw_text")[0]
    kept_columns = docs.columns
    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(names, (x.split()[1] for x in FIELDS.split(", ")), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = b.column(b.num_columns - 1)
                c = np.array([base_counts(x.as_py() or b"") for x in texts], np.int64).reshape(-1, 5)
                failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEATED * c[:, 0])
                p = model.probability(ngrams.decoded(texts))
                new = [*map(pa.array, c.T.copy()), pa.array(failed), pa.array(~failed & (p >= reject_below)), pa.array(p)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*kept_columns, *names])

    return docs.withColumn(raw, F.col("text").cast("binary")).mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass."""
    judged = judge(docs, labels)
    return judged.where(F.col(judged.columns[-2])).select(*docs.columns)

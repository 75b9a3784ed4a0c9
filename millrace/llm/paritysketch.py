"""N-gram Jaccard join by parity sketches: exact links between sets of word shingles, and their components.

A set's sketch deals its shingles out to blocks by their hashes. Each block XORs the hashes of its shingles to a key of 64 bits,
and a bit of 16 for each of them, so that two sketches differ in no more bits, and in no more blocks, than the sets differ in
shingles. A set of n shingles differs from any that is as similar as ``percent`` says in at most ``D(n) = n (100 - percent) / percent``
shingles, and both sets of a pair meet in the size band of the larger, with m blocks. By the cycle lemma at least ``m - D(n)``
blocks of the ring are such that for every l the first l blocks from there on differ in less than l shingles; that block's
key is then equal, and the bits of the next ``CHAIN`` blocks travel with it and are held against that, which throws out chance
meetings without losing a pair. What is left is verified on the texts.

Blocks without shingles are equal between many sets, and so are those that hold nothing but a passage many documents share. As
there are ``m - D(n)`` blocks to meet in, a set leaves such blocks out where it has ``D(n) + 1`` others: of those, one is among
them. m is chosen so that a set of distinct shingles has too few others once in ``1 / RARE`` cases. Which keys many sets share is read
off a sample of bounded size; it only decides which blocks are left out, and no pair depends on it.

Shape of the work: one shuffle of (block key, set, chain) rows, sorted, of which each run of equal keys is
read as a stream. In a run not all pairs come out but stars: every set is paired with the first set of
the run that it passes with. Of a run of more than ``ROWS`` rows only a piece and the centers so far are held. After verification and components, those runs that still hold sets of different
components are gone through once more, now for pairs across components whose whole sketches are near enough, so no
link is lost and no large group is written out pair by pair; a run of more than ``PIECE`` rows is dealt out in pieces, each two of
which meet in a task. Copies have one set, which each task sends once. For verification
a pair goes to a slot by its leaf, and each slot gets the text of each set once: a center of a million copies goes to as many
slots as there are, at most. Components come from alternating stars over tables (a million links and less: from
one task); not to converge is an error. Nothing is collected but the sample's keys and a bitmap of fixed size, which only spares
texts that surely are not needed a shuffle.

Sets and shingles go by 64-bit hashes (sets together with their size).

Defined results: null and empty texts have no shingles, link with nothing and are their own component, as documents;
texts with fewer words than a shingle have one, the whole sequence; equal rows and ties share a component, whose
id is its smallest doc_id; a null doc_id is null in the result and passes no id on; texts are taken whole; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Held, drop_table, files_for, parts_for, table

#: Ratio of the bounds of a size band, bits of a block, and blocks that travel with one.
BAND, BLOCK, CHAIN = 1.3, 16, 4
#: How often a set of distinct shingles may have to send a block without any.
RARE = 1e-4
#: Texts in the sample that tells which keys many sets share, and in how many of its sets such a key occurs.
SAMPLE, SHARED = 4096, 4
#: Pairs that go to a slot of the verification on average.
SLOT = 256
#: Bits of the sketch by which pairs of one run and different components are sifted.
SIFT = 2048
#: Words and sets that a task remembers, rows that it looks at together, rows of a piece of a run.
WORDS, SETS, ROWS, PIECE = 1 << 16, 1 << 18, 1 << 18, 1 << 17
#: Bits of the bitmap of texts needed again: so many for each id, within bounds.
BITS, BITMAP = 32, (1 << 16, 1 << 26)

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Words(dict):
    """Hashes of words; forgets them when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(raw: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's ``k``-word shingles. ``bytes`` methods treat A-Z and white space of ASCII only."""
    words = raw.lower().split() if raw else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < k:
        return mix64((w * _K[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    h = w[: n - k + 1] * _K[0]
    for i in range(1, k):
        h += w[i : n - k + 1 + i] * _K[i]
    h = np.sort(mix64(h))
    return h[np.append(True, h[1:] != h[:-1])]


def set_id(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes(), len(h))).view(np.int64))


def bounds(least: int, most: int) -> list[int]:
    """Lower bounds of the size bands up to one beyond ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return [*out, max(out[-1] + 1, int(out[-1] * BAND))]


_BOUNDS = bounds(1, 1 << 40)


def most_apart(n: int, percent: int) -> int:
    """In how many shingles a set of ``n`` may differ from one that is as similar as asked."""
    return n * (100 - percent) // percent


@cache
def blocks_of(band: int, percent: int) -> tuple[int, int]:
    """The number of blocks in a band, and in how many shingles a pair differs there at most; 0 where only equal sets are similar.

    Of n shingles in m blocks at most d are hit in less than ``C(m, d) (d / m)^n`` of all cases, and then ``(m - d) / m`` of
    the blocks are empty: for every size of the band that is to be rare.
    """
    least, most = -(-percent * _BOUNDS[band] // 100), _BOUNDS[band + 1] - 1
    top = 2 * most * (100 - percent) // (100 + percent)
    if not top:
        return 0, 0
    # Of each number of differences the smallest size that has it.
    sizes = {}
    for n in range(least, most + 1) if most < 5000 else sorted({least, most, *np.linspace(least, most, 2000).astype(int).tolist()}):
        sizes.setdefault(min(top, most_apart(n, percent)), n)
    log_choose = lambda m, d: math.lgamma(m + 1) - math.lgamma(d + 1) - math.lgamma(m - d + 1)
    def rare(m: int) -> bool:
        return all(log_choose(m, d) + n * math.log(d / m) + math.log((m - d) / m) <= math.log(RARE) for d, n in sizes.items() if d)

    low, high = top + 1, top + 2
    while not rare(high):
        low, high = high, high + max(1, high // 50)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if rare(middle) else (middle, high)
    return high, top


def bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """``(band, blocks, differences)`` of the bands in which a set of ``n`` shingles can meet its like.

    A pair meets in the band of its larger set; a set also goes to the next band if that begins within its reach.
    """
    j = int(np.searchsorted(_BOUNDS, n, side="right")) - 1
    return [(b, *blocks_of(b, percent)) for b in (j, j + 1) if b == j or 100 * n >= percent * _BOUNDS[b]]


def signatures(h: np.ndarray, percent: int, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and chains of the blocks that a set is to be met in, in all its bands; ``shared`` are the keys to be left out where that may be."""
    keys, chains = [], []
    so_far = np.append(np.uint64(0), np.bitwise_xor.accumulate(mix64(h ^ _K[5])))
    for band, blocks, top in bands(len(h), percent):
        if not blocks:
            continue
        # The hashes are sorted and a block is a range of them, so its shingles stand together.
        at = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(at, np.arange(blocks + 1))
        whole = so_far[ends[1:]] ^ so_far[ends[:-1]]
        bits = np.packbits((np.bincount(at * BLOCK + (h & np.uint64(BLOCK - 1)).astype(np.int64), minlength=blocks * BLOCK) & 1).astype(np.uint8), bitorder="little").view(np.uint16).astype(np.uint64)
        chain = np.zeros(blocks, np.uint64)
        for i in range(1, min(CHAIN, blocks - 1) + 1):
            chain |= np.roll(bits, -i) << np.uint64(16 * (i - 1))
        key = mix64(whole + np.arange(blocks, dtype=np.uint64) * _K[1] + np.array([band], np.uint64) * _K[2:3])
        full = np.diff(ends) > 0
        own = full if shared is None or not len(shared) else full & (shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] != key)
        for send in (own, full):
            if send.sum() > min(top, most_apart(len(h), percent)):
                key, chain = key[send], chain[send]
                break
        keys.append(key)
        chains.append(chain)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(keys), np.concatenate(chains)


def passes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the blocks after an equal one differ in less than l bits among the first l, for every l."""
    x = a ^ b
    errors = np.zeros(x.shape, np.uint8)
    ok = np.ones(x.shape, bool)
    for i in range(CHAIN):
        errors += np.bitwise_count((x >> np.uint64(16 * i)) & np.uint64(0xFFFF))
        ok &= errors <= i + 1
    return ok


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *more)


def sets(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, n, sid)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column(1)):
                h = shingles(t.as_py(), k)
                n[i], ids[i] = len(h), set_id(h)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(ids)], ["doc_id", "n", "sid"])

    return _texts(docs).mapInArrow(run, docs.select("doc_id").schema.add("n", "long").add("sid", "long"))


def shared_keys(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """The keys that ``SHARED`` sets and more of a sample of ``SAMPLE`` texts have, sorted: at most the sample's keys by ``SHARED``."""
    drawn = docs.where("text is not null").select(F.xxhash64("text", F.lit(5)).alias("at"), F.col("text").cast("binary").alias("text")).orderBy("at").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = [np.zeros(0, np.uint64)], set()
        for b in batches:
            for t in b.column(0):
                h = shingles(t.as_py(), k)
                if len(h) and set_id(h) not in seen:
                    seen.add(set_id(h))
                    found.append(np.unique(signatures(h, percent)[0]))
        key, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([key[n >= SHARED].tobytes()], pa.binary())], ["keys"])

    row = drawn.select("text").coalesce(1).mapInArrow(run, "keys binary").first()
    return np.frombuffer(row[0], np.uint64) if row else np.zeros(0, np.uint64)


def keys(docs: DataFrame, k: int, percent: int, shared: np.ndarray | None = None) -> DataFrame:
    """``(key, sid, chain)`` for every block of every distinct set; a task sends a set once as long as it remembers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(x).view(np.int64)) for x in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", "sid", "chain"])

        for b in batches:
            for t in b.column(1):
                h = shingles(t.as_py(), k)
                s = set_id(h)
                if not len(h) or s in seen:
                    continue
                if len(seen) >= SETS:
                    seen.clear()
                seen.add(s)
                key, chain = signatures(h, percent, shared)
                if len(key):
                    out.append((key, np.full(len(key), s, np.int64).view(np.uint64), chain))
                    rows += len(key)
                if rows >= 1 << 16:
                    rows = 0
                    yield flush()
        if out:
            yield flush()

    return _texts(docs).mapInArrow(run, "key long, sid long, chain long")


def _runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """The columns of sorted batches in pieces that hold whole runs of equal keys.

    A run of more than ``most`` rows comes in pieces of its own: the flag says that the piece's run goes on in the next.
    """
    held: list[list[np.ndarray]] = []
    rows, long = 0, None
    joined = lambda: [np.concatenate(x) for x in zip(*held, strict=True)]
    for b in batches:
        c = [x.to_numpy(zero_copy_only=False) for x in b.columns]
        if not len(c[0]):
            continue
        held.append(c)
        rows += len(c[0])
        one = held[0][0][0] == c[0][-1]
        if rows < ROWS or one and long is None and (most is None or rows < most):
            continue
        whole = joined()
        if long is not None:
            end = int(np.searchsorted(whole[0], long, side="right"))
            yield [x[:end] for x in whole], end == len(whole[0])
            whole = [x[end:] for x in whole]
            long = None if len(whole[0]) else long
        elif one:
            long = whole[0][0]
            yield whole, True
            whole = [x[:0] for x in whole]
        if len(whole[0]):
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            if cut:
                yield [x[:cut] for x in whole], False
            whole = [x[cut:] for x in whole]
        held, rows = [whole] if len(whole[0]) else [], len(whole[0])
    whole = joined() if held else None
    if long is not None:
        end = int(np.searchsorted(whole[0], long, side="right")) if whole else 0
        # The run's last piece may be empty: the flag is what counts.
        yield [x[:end] for x in whole] if whole else [np.zeros(0, np.int64)] * len(c), False
        whole = [x[end:] for x in whole] if whole else None
    if whole and len(whole[0]):
        yield whole, False


def _left_out(group: np.ndarray, size: np.ndarray, center_of: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Rows of pairs that pass but that no star has: a row that met its center was not held against the rows after it."""
    met = center_of >= 0
    n_met = np.bincount(group[met], minlength=len(size))
    again = met & (n_met > 1)[group]
    ends = np.cumsum(size)
    for g in np.flatnonzero((n_met > 0) & (size - n_met > 1)):
        run = np.arange(ends[g] - size[g], ends[g])
        other = run[~met[run]]
        for x in np.array_split(run[met[run]], -(-int(n_met[g]) // 256)):
            ok = passes(chain[x][:, None], chain[other][None]) & (other[None] != center_of[x][:, None])
            again[x] |= ok.any(1)
            again[other] |= ok.any(0)
    return again


def stars(rows: DataFrame) -> DataFrame:
    """``(kind, a, b, c)``: kind 0 are pairs of a center a and another set b; kind 1 the rows (key, sid, chain) of runs to look at again."""

    def found(pairs: list[np.ndarray]) -> pa.RecordBatch:
        p = np.unique(np.concatenate(pairs), axis=0)
        zero = np.zeros(len(p), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32)), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), pa.array(zero)], ["kind", "a", "b", "c"])

    def look_again(key: np.ndarray, sid: np.ndarray, chain: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), np.int32)), pa.array(key), pa.array(sid), pa.array(chain.view(np.int64))], ["kind", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers: list[tuple[int, int]] = []
        going = False
        for (key, sid, chain), more in _runs(batches, ROWS):
            own = np.append(True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1]))[: len(key)]
            key, sid, chain = key[own], sid[own], chain[own].view(np.uint64)
            if going or more:
                # A piece of a long run: against the centers of the pieces before, and what is left among itself. All of it is looked at again.
                pairs, left = [], np.arange(len(key))
                i = 0
                while len(left):
                    if i == len(centers):
                        centers.append((int(sid[left[0]]), int(chain[left[0]])))
                        left = left[1:]
                    c, bits = centers[i]
                    ok = passes(chain[left], np.uint64(bits)) & (sid[left] != c)
                    if ok.any():
                        pairs.append(np.stack([np.full(ok.sum(), c), sid[left[ok]]], 1))
                    left, i = left[~ok & (sid[left] != c)], i + 1
                if pairs:
                    yield found(pairs)
                if len(key):
                    yield look_again(key, sid, chain)
                going = more
                if not more:
                    centers = []
                continue
            start = np.append(True, key[1:] != key[:-1])
            group = np.cumsum(start) - 1
            size = np.bincount(group)
            center_of = np.full(len(key), -1)
            live = np.flatnonzero(size[group] > 1)
            pairs = []
            while len(live):
                g = group[live]
                head = np.append(True, g[1:] != g[:-1])
                center = live[head][np.cumsum(head) - 1]
                rest = live[~head]
                center = center[~head]
                ok = passes(chain[rest], chain[center])
                if ok.any():
                    pairs.append(np.stack([sid[center[ok]], sid[rest[ok]]], 1))
                    center_of[rest[ok]] = center[ok]
                live = rest[~ok]
                left = np.bincount(group[live], minlength=len(size)) if len(live) else size
                live = live[left[group[live]] > 1]
            if pairs:
                yield found(pairs)
            again = _left_out(group, size, center_of, chain)
            if again.any():
                yield look_again(key[again], sid[again], chain[again])

    return rows.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(run, "kind int, a long, b long, c long")


def sketch(h: np.ndarray) -> bytes:
    return np.packbits((np.bincount((h >> np.uint64(20)).astype(np.int64) % SIFT, minlength=SIFT) & 1).astype(np.uint8)).tobytes()


def across(rows: DataFrame, percent: int) -> DataFrame:
    """``(a, b, center)``: pairs of sets of one run and different labels that pass, and whose sketches do.

    ``rows`` is ``(key, label, sid, chain, n, sketch)``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, label, sid, chain, n, whole), _ in _runs(batches):
            chain = chain.view(np.uint64)
            bits = np.frombuffer(b"".join(whole), np.uint64).reshape(len(key), SIFT // 64)
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            pairs = []
            for i, j in zip(start, np.append(start[1:], len(key)), strict=True):
                if label[i] == label[j - 1]:
                    continue
                for r in range(i, j - 1):
                    # Sorted by label: the others of this label come next.
                    q = i + int(np.searchsorted(label[i:j], label[r], side="right"))
                    ok = np.flatnonzero(passes(chain[q:j], chain[r])) + q
                    if len(ok):
                        most = (n[ok] + n[r]) * (100 - percent) // (100 + percent)
                        ok = ok[np.bitwise_count(bits[ok] ^ bits[r]).sum(1, dtype=np.int64) <= most]
                    if len(ok):
                        pairs.append(np.stack([np.full(len(ok), sid[r]), sid[ok]], 1))
            if pairs:
                p = np.unique(np.concatenate(pairs), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["a", "b"])

    return unordered(rows.repartition("key").sortWithinPartitions("key", "label").mapInArrow(run, "a long, b long"))


def unordered(pairs: DataFrame) -> DataFrame:
    """``(a, b, center)`` of each pair once, a the lesser: of ``(center, other)`` that several runs may have, either way round."""
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.col("a")).alias("center"))


def in_pieces(rows: DataFrame) -> DataFrame:
    """``rows`` of ``(key, n, sid, ...)``, n a key's number of rows, with a key of its own for each two pieces of a large run."""
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    own = F.pmod(F.xxhash64("sid"), pieces).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    key = F.when(F.col("n") <= PIECE, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return dealt.withColumn("key", key).drop("own", "other", "n")


def perhaps(ids: DataFrame):
    """A condition on doc_id that holds for all of ``ids``' and for few others, by a bitmap of bounded size.

    It has ``BITS`` for each id within the bounds ``BITMAP``; very many ids only make it let more through.
    """
    size = min(max(1 << (BITS * ids.count()).bit_length(), BITMAP[0]), BITMAP[1])
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    words = ids.groupBy(F.floor(slot / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("bits"))
    bitmap = np.zeros(size // 64, np.int64)
    got = words.toArrow()  # at most size / 64 rows
    bitmap[got["w"].to_numpy()] = got["bits"].to_numpy()

    @F.pandas_udf("boolean")
    def maybe(spot: pd.Series) -> pd.Series:
        s = spot.to_numpy()
        return pd.Series((bitmap[s >> 6] >> (s & 63)) & 1 == 1)

    return maybe(slot)


def chosen_of(needed: DataFrame, of: DataFrame) -> DataFrame:
    """``(sid, doc_id)``: one document for each set of ``needed``."""
    return of.where("n > 0 and doc_id is not null").join(needed, "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))


def sketches(needed: DataFrame, docs: DataFrame, of: DataFrame, k: int, held: Held) -> DataFrame:
    """``(sid, n, sketch)`` for each set of ``needed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingles(t.as_py(), k) for t in b.column(1)]
            own = [i for i, h in enumerate(hashes) if set_id(h) == b.column(0)[i].as_py()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array([len(hashes[i]) for i in own], pa.int64()), pa.array([sketch(hashes[i]) for i in own], pa.binary())], ["sid", "n", "sketch"])

    chosen = held(chosen_of(needed, of), "chosen")
    # Hinted so that the plan is the same at every size.
    texts = _texts(docs).where(perhaps(chosen)).join(chosen.hint("merge"), "doc_id").select("sid", "text")
    return texts.mapInArrow(run, "sid long, n long, sketch binary").dropDuplicates(["sid"])


def verify(pairs: DataFrame, docs: DataFrame, of: DataFrame, k: int, percent: int, held: Held, n: int) -> DataFrame:
    """Those of the ``n`` ``pairs`` whose sets are as similar as asked, by the texts of one document each."""
    slots = max(1, n // SLOT)
    dealt = pairs.select(F.pmod(F.xxhash64(F.when(F.col("center") == F.col("a"), F.col("b")).otherwise(F.col("a"))), F.lit(slots)).alias("slot"), "a", "b")
    needed = dealt.select("slot", F.explode(F.array("a", "b")).alias("sid")).distinct()
    chosen = held(chosen_of(needed.select("sid").distinct(), of), "chosen")
    # Hinted so that the plan is the same at every size.
    texts = _texts(docs).where(perhaps(chosen)).join(needed.join(chosen, "sid").hint("merge"), "doc_id")
    rows = texts.select("slot", F.lit(0).alias("kind"), F.col("sid").alias("a"), F.lit(None).cast("long").alias("b"), "text").union(dealt.select("slot", F.lit(1), "a", "b", F.lit(None).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a slot the texts come first.
        slot, have = -1, {}
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            own, kind, left, right = (batch.column(i).to_pylist() for i in range(4))
            for i in range(batch.num_rows):
                if own[i] != slot:
                    slot, have = own[i], {}
                if kind[i] == 0:
                    h = shingles(batch.column(4)[i].as_py(), k)
                    # A doc_id may stand on several texts, so the text counts.
                    if set_id(h) == left[i]:
                        have[left[i]] = h
                elif left[i] in have and right[i] in have:
                    h = have[left[i]], have[right[i]]
                    common = len(np.intersect1d(*h, assume_unique=True))
                    keep[i] = 100 * common >= percent * (len(h[0]) + len(h[1]) - common)
            got = batch.select(["a", "b"]).filter(pa.array(keep))
            if got.num_rows:
                yield got

    linked = rows.repartition("slot").sortWithinPartitions("slot", "kind").mapInArrow(run, "a long, b long")
    # Dealt out anew, or few files would mean few tasks for all of the work above.
    return held(linked.distinct(), "links", files_for(n))


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, label)`` of the links of one task."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], ["node", "label"])


def components(links: DataFrame, parts: int = 1, most: int = 60) -> DataFrame:
    """``(node, label)`` of every node of the links ``(a, b)``: the label is the least node of its component.

    Links of one file (``ROWS_A_FILE`` at most) are joined in one task. More take alternating large and small stars; each
    round is a table of ``parts`` files, so lost executors cost no more than a round. Their number grows with the logarithm of
    the links; should ``most`` not do, that is an error.
    """
    if parts == 1:
        return links.select("a", "b").coalesce(1).mapInArrow(forest, "node long, label long")
    edges, mark = links.select("a", "b"), None
    for _ in range(most):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select("b", "m").where("b != m").toDF("a", "b").union(low.select("a", "m").toDF("a", "b")).distinct()
        new = table(small, "stars", parts)
        now = new.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if mark is not None:
            drop_table(edges)
        edges = new
        if now == mark:
            break
        mark = now
    else:
        raise ValueError(f"components of {now[0]} edges have not settled after {most} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(nodes.select(F.col("label").alias("node"), "label").distinct())


def join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row for each row of ``docs``."""
    held = Held()
    try:
        own = _labelled(docs, k, percent, held)
    finally:
        held.free()
    first = own.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("first"))
    # Documents without shingles have no label and join nothing.
    return own.join(first, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def _labelled(docs: DataFrame, k: int, percent: int, held: Held) -> DataFrame:
    """A table of ``(doc_id, n, label)``: the label is the least set of the component."""
    of = held(sets(docs, k), "sets")
    found = held(stars(keys(docs, k, percent, shared_keys(docs, k, percent))), "found")
    pairs = held(unordered(found.where("kind = 0").select("a", "b")), "pairs")
    total = pairs.count()
    links = verify(pairs, docs, of, k, percent, held, total)
    parts = files_for(total)
    label = held(components(links, parts), "labels", parts)
    # Runs with sets of several components may hide links that the stars left out.
    again = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("sid"), F.col("c").alias("chain"))
    again = held(again.join(label.withColumnRenamed("node", "sid"), "sid", "left").select("key", F.coalesce("label", "sid").alias("label"), "sid", "chain"), "again")
    mixed = again.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x != y").select("key", "n")
    again = held(in_pieces(again.join(mixed, "key").select("key", "n", "label", "sid", "chain")), "mixed")
    whole = sketches(again.select("sid").distinct(), docs, of, k, held)
    more = across(again.join(whole, "sid").select("key", "label", "sid", "chain", "n", "sketch"), percent)
    more = held(more.join(pairs.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "center"), "more")
    n = more.count()
    if n:
        links = links.union(verify(more, docs, of, k, percent, held, n))
        parts = files_for(total + n)
        label = held(components(links, parts), "labels", parts)
    own = of.join(label.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "sid")).alias("label"))
    return table(own, "labelled", files_for(of.count()))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id; rows without words or doc_id all stay.

    Of several rows with that doc_id the text that is least stays, once.
    """
    joined = join(docs, k, percent)
    joined = table(joined, "joined", parts_for(docs))
    grouped = joined.where("n_shingles > 0 and doc_id is not null")
    dropped = grouped.where("doc_id != component_id").select("doc_id").distinct()
    # Only documents whose id may be among the dropped are dealt out to look.
    hit = F.coalesce(perhaps(dropped), F.lit(False))
    parts = docs._jdf.queryExecution().toRdd().getNumPartitions()
    looked = docs.where(hit).join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns).coalesce(max(1, parts))
    kept = docs.where(~hit).union(looked)
    twice = grouped.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = table(twice, "twice", 1)
    if not twice.limit(1).count():
        return kept
    # A doc_id on several rows that share a component; such ids are few, but their rows may be many: one is chosen by aggregation.
    full = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) > 0
    repeated = kept.join(twice, "doc_id", "left_semi").select(*docs.columns).where(full)
    row = F.struct("text", *[c for c in docs.columns if c != "text"])
    one = repeated.groupBy("doc_id").agg(F.min(row).alias("_row")).select(*[F.col(f"_row.{c}") for c in docs.columns])
    rest = kept.join(twice, "doc_id", "left_anti").select(*docs.columns).union(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).where(~full))
    return rest.union(one)

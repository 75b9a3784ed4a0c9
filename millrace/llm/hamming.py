"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit a dimension: whether the component is above 0. Codes are cut into m segments, each
with a hash index of its own. The segments' search radii grow one after the other: once the first j + 1 have radius a
and the others a - 1, every code within ``m * a + j`` bits has been met, as a farther one differs by more in each segment.
A query is done, and leaves, when its k-th verified distance is covered that way; that takes in all its ties.

Radii grow one at a time, and within a radius segment after segment. A round probes the masks of one radius, ``PROBES`` of
them at most, so a radius with more takes several rounds, and a query that is covered by some of them is spared the rest. No
query is ever held against all codes by another way: a radius as wide as the narrowest segment has met every code through
the index itself.

Segments are a little narrower than the number of distinct codes has bits, so that a value is shared by a few codes
and probing stays below linear. Equal codes are one entry of the index that keeps the ``k`` smallest ids (no other can be among
the k nearest) and equal query codes are searched once, so copies, however many, make no larger bucket.

Defined results: null vectors, and null components, count as bits that are 0; vectors are cut or filled with 0 bits to
the number of bits of the code; ties go by id; rows with a null id are not indexed; a query finds itself at
distance 0 as any other row; fewer than k rows are all returned; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import combinations, islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS_A_FILE, parts_for, table

BITS = 64
#: Logarithm of how many codes should share a segment's value: looking at a code is cheaper than dealing out a probe.
SHARED = 2.5
#: Masks that a round probes at most; they are written into its plan.
PROBES = 4096


def code_of(vector: Column, bits: int = BITS) -> Column:
    """The code as a long; bit i is the vector's component i."""
    part = lambda i: F.when(F.coalesce(F.try_element_at(vector, F.lit(i + 1)), F.lit(0.0)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
    code = part(0)
    for i in range(1, bits):
        code = code.bitwiseOR(part(i))
    return code


def widths(n: int, bits: int = BITS) -> list[int]:
    """The segments' widths for ``n`` distinct codes."""
    count = min(bits, max(1, round(bits / max(2.0, math.log2(max(n, 2)) - SHARED))))
    return [bits // count + (i < bits % count) for i in range(count)]


def segments(code: Column, sizes: list[int]) -> Column:
    """``array<struct<seg, value>>`` of a code."""
    out, at = [], 0
    for i, w in enumerate(sizes):
        value = F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << w) - 1)) if w < 64 else code
        out.append(F.struct(F.lit(i).alias("seg"), value.cast("long").alias("value")))
        at += w
    return F.array(*out)


def masks(radius: int, width: int) -> Iterator[int]:
    """All differences of exactly ``radius`` bits in a segment."""
    return (sum(1 << b for b in bits) for bits in combinations(range(width), radius))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def first_ids(rows: DataFrame, k: int) -> DataFrame:
    """``(code, ids)``: each distinct code with its ``k`` smallest ids.

    The ids are ranked within parts of a code first, so that a code with a great share of all rows is dealt out.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    part = Window.partitionBy("code", "salt").orderBy("id")
    some = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    whole = Window.partitionBy("code").orderBy("id")
    few = some.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    return few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def best(candidates: DataFrame, k: int) -> DataFrame:
    """``(query, hits)``: for each query code the entries of least distance that hold the ``k`` nearest ids.

    ``candidates`` is ``(query, code, distance, first)``. Entries go by distance; more than ``k`` entries are never needed, as each
    has an id, but of entries at one distance the ids decide, so all up to the k-th entry's distance are ranked by their first id.
    """
    w = Window.partitionBy("query").orderBy("distance", "first", "code")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def rounds(sizes: list[int], most: int = PROBES) -> Iterator[tuple[list[tuple[int, list[int]]], int]]:
    """``(segment, masks)`` pairs to probe next, and the distance that is covered after them."""
    m = len(sizes)
    for radius in range(min(sizes) + 1):
        held, room = [], most
        for j, width in enumerate(sizes):
            left, rest = masks(radius, width), math.comb(width, radius)
            while rest:
                part = list(islice(left, room))
                held.append((j, part))
                room, rest = room - len(part), rest - len(part)
                if not room:
                    yield held, m * radius + j - (rest > 0)
                    held, room = [], most
        if held:
            yield held, m * radius + m - 1


def search(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS) -> DataFrame:
    """``(query_id, id, distance, rank)``: for every query row its ``k`` nearest rows.

    ``rows`` and ``queries`` are ``(id, code)``.
    """
    rows = rows.where(F.col("id").isNotNull())
    index = table(first_ids(rows, k), "codes", parts_for(rows)).withColumn("first", F.element_at("ids", 1))
    n = index.count()
    sizes = widths(n, bits)
    entries = table(index.select("code", "first", F.inline(segments(F.col("code"), sizes))), "segments", -(-n * len(sizes) // ROWS_A_FILE) or 1)
    # ``worst`` is the distance of the k-th entry so far: nothing farther is of use.
    asked_codes = table(queries.select(F.col("code").alias("query")).distinct(), "queries", parts_for(queries))
    open_ = asked_codes.withColumn("worst", F.lit(None).cast("int"))
    found = index.select(F.col("code").alias("query"), "code", "first", F.lit(0).alias("distance")).limit(0)
    for probe, covered in rounds(sizes):
        if not open_.limit(1).count():
            break
        by_segment = F.from_json(F.lit(json.dumps([x for _, x in probe])), "array<array<bigint>>")
        own = F.filter(segments(F.col("query"), sizes), lambda x: x["seg"].isin([j for j, _ in probe]))
        probes = open_.select("query", "worst", F.posexplode(own).alias("at", "x"))
        probes = probes.select("query", "worst", F.col("x.seg").alias("seg"), F.col("x.value").alias("own"), F.explode(F.element_at(by_segment, F.col("at") + 1)).alias("mask"))
        probes = probes.select("query", "worst", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        far = distance(F.col("query"), F.col("code"))
        # Exploded rows look as small to the planner as what they come from, so it must not broadcast them.
        near = probes.join(entries.hint("merge"), ["seg", "value"]).where(F.col("worst").isNull() | (far <= F.col("worst"))).select("query", "code", "first", far.alias("distance"))
        found = table(best(near.unionByName(found).distinct(), k), "hits")
        state = found.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        left = asked_codes.join(state, "query", "left").where(F.col("n").isNull() | (F.col("n") < min(k, n)) | (F.col("far") > covered))
        open_ = left.select("query", F.when(F.col("n") >= k, F.col("far")).alias("worst"))
    hits = found.join(index.select("code", "ids"), "code").select("query", "distance", F.explode("ids").alias("id"))
    w = Window.partitionBy("query").orderBy("distance", "id")
    hits = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    return asked.join(hits, "query").select("query_id", "id", "distance", "rank")


"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Every document gets a rate ``w = min(max_copies, exp(lambda_source * size / mean size of the source))``.
These rates are the ones of least relative entropy to "each document once" among all rates in
``[0, max_copies]`` under which each source's tokens meet its target; ``lambda`` solves the convex
dual, one unknown a source, by Newton steps over the distributed table of sizes, kept inside a
bracket. Rates become whole copies by thresholds: within a source, size classes (powers of two)
are rounded from the largest to the smallest, each carrying its error on to the next.

What is held together is small: per source a row of parameters and a histogram of at most
``CLASSES * BINS`` counts, however many documents the source has. Targets are shared out in one task, a row for
each source. No text is shuffled.

Defined results: null text has size 0; null sources form one source, last in order; equal rows get
equal decisions; documents of size 0 are kept once; an empty table gives an empty result; extra
columns pass through; inner columns give way to clashing names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, fresh, n_words, parts_for, table, uniform

MAX_COPIES = 2.0
CLASSES = 48
BINS = 2048
NEWTON_STEPS = 60
TOLERANCE = 1e-9
#: A parameter table of at most this many sources is broadcast; beyond, Spark joins as it sees fit.
BROADCAST_SOURCES = 2_000


def share_targets(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), total: float = 1.5, most: float = MAX_COPIES) -> DataFrame:
    """``(source, source_size)`` plus ``target``: ``total`` times all sizes, dealt by repeating ``weights``.

    Sources rank by code point, null last. A target stops at ``most`` times its source's size; the
    excess is dealt again by weight. That fixed point is water filling: sources in the order of
    ``most * size / weight`` are capped while the level that the rest would get lies above.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(most))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(total),
        "all_weight": F.sum("weight").over(everything),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    capped = (F.col("budget") - F.col("cap_before")) * F.col("weight") >= F.col("cap") * (F.col("all_weight") - F.col("weight_before"))
    ranked = ranked.withColumn("capped", capped)
    ranked = ranked.withColumns({
        "left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0)),
        "left_weight": F.col("all_weight") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everything), F.lit(0.0)),
    })
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("left") * F.col("weight") / F.col("left_weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def rate(lam: Column, size: Column, mean: Column, full: Column, most: float = MAX_COPIES) -> Column:
    """The tilted rate of a document of ``size`` words."""
    tilt = F.least(F.lit(float(most)), F.exp(F.least(lam * size / F.greatest(mean, F.lit(1e-9)), F.lit(50.0))))
    return F.when(size == 0, F.lit(1.0)).when(full, F.lit(float(most))).otherwise(tilt)


def solve(sizes: DataFrame, targets: DataFrame, most: float = MAX_COPIES, parts: int | None = None) -> DataFrame:
    """``(source, source_size, target, mean, full, lam)``: Newton on the dual, all sources at once.

    ``sizes`` is ``(source, size, n)``, a row for each size that a source has. A step that leaves the
    bracket of a source is replaced by halving it. A source is settled when its words are as near to the target as
    ``TOLERANCE`` and the rounding of the sum's terms let them be; should ``NEWTON_STEPS`` not do, that is an error.
    """
    docs = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    null = F.lit(None).cast("double")
    params = targets.join(docs, targets["source"].eqNullSafe(docs["source"])).select(
        targets["source"], "source_size", "target", "mean",
        ((F.col("target") >= most * F.col("source_size") * (1 - 1e-12)) | (F.col("source_size") == 0)).alias("full"),
        F.lit(0.0).alias("lam"), null.alias("low"), null.alias("high"), F.lit(1.0).alias("err"),
    )
    params = table(params, "mix-params", parts)
    for _ in range(NEWTON_STEPS):
        p = params.alias("p")
        x = F.col("s.size") / F.greatest(F.col("p.mean"), F.lit(1e-9))
        w = rate(F.col("p.lam"), F.col("s.size"), F.col("p.mean"), F.col("p.full"), most)
        sums = F.col("s.n") * F.col("s.size")
        step = sizes.alias("s").join(p, F.col("s.source").eqNullSafe(F.col("p.source"))).where(~F.col("p.full")).groupBy(F.col("p.source").alias("source")).agg(
            _exact(sums * w).alias("got"), _exact(F.when(w < most, sums * w * x).otherwise(0.0)).alias("slope"), F.count("*").alias("terms")
        ).alias("t")
        j = p.join(step, F.col("p.source").eqNullSafe(F.col("t.source")), "left")
        gap = F.col("got") - F.col("target")
        err = F.coalesce(F.greatest(F.abs(gap) - F.col("terms") / float(1 << 20), F.lit(0.0)) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0))
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        halved = F.when(low.isNull(), high - 1 - F.abs(high)).when(high.isNull(), low + 1 + F.abs(low)).otherwise((low + high) / 2)
        inside = newton.isNotNull() & ~F.isnan(newton) & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high)) & (F.abs(newton) < 1e6)
        lam = F.when(err <= TOLERANCE, F.col("lam")).when(inside, newton).otherwise(halved)
        last, params = params, table(j.select(F.col("p.source").alias("source"), "source_size", "target", "mean", "full", lam.alias("lam"), low.alias("low"), high.alias("high"), err.alias("err")), "mix-params", parts)
        drop_table(last)
        left = params.where(F.col("err") > TOLERANCE).agg(F.count("*").alias("n"), F.max("err").alias("err")).first()
        if not left.n:
            break
    else:
        raise ValueError(f"{left.n} sources have not met their targets after {NEWTON_STEPS} steps; the farthest is off by a share of {left.err:.2g}")
    return params.select("source", "source_size", "target", "mean", "full", "lam")


def _class(size: Column) -> Column:
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))), F.lit(CLASSES - 1)).cast("int")


def _bin(u: Column, part: Column) -> Column:
    """The bin of a document by ``u / (u + part)``: those below a half are due a further copy, and all others follow in order."""
    return F.floor(u / (u + part) * BINS).cast("int")


def _exact(x: Column) -> Column:
    """A sum that does not depend on the order of its terms: of whole multiples of 2^-20."""
    return F.sum(F.round(x * float(1 << 20)).cast("decimal(38,0)")).cast("double") / float(1 << 20)


def cuts(docs: DataFrame, params: DataFrame, most: float = MAX_COPIES) -> DataFrame:
    """``params`` plus ``cut``: for each size class of a source the bin below which a document gets a further copy.

    Per class the bins' words are summed; from the largest class down, the cut is taken at which the words come
    nearest to what the class should give plus what the larger ones left over, with no more left than smaller classes have.
    """
    w = F.col("rate")
    part = w - F.floor(w)
    open_ = docs.where((F.col("size") > 0) & (w < most)).select(
        "source", _class(F.col("size")).alias("k"), _bin(F.col("u"), part).alias("bin"), "size", (part * F.col("size")).alias("due"))
    bins = open_.groupBy("source", "k", "bin").agg(F.sum("size").cast("double").alias("words"), _exact(F.col("due")).alias("due"))
    classes = bins.groupBy("source", "k").agg(_exact(F.col("due")).alias("due"), F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("bin", "words"))).alias("bins"))
    hists = classes.groupBy("source").agg(F.sum("words").alias("all"), F.sort_array(F.collect_list(F.struct("k", "due", "words", "bins")), asc=False).alias("hist"))

    def cut_of(need, rest):
        """Fold over a class's bins: the cut with the words below it nearest to ``need``, among those that smaller classes can make up for if there are such."""
        def step(a, b):
            total = a["total"] + b["words"]
            gap = need - total
            fine = (gap >= 0) & (gap <= rest)
            better = (fine & ~a["fine"]) | ((fine == a["fine"]) & (F.abs(gap) < F.abs(a["gap"])))
            keep = lambda new, old: F.when(better, new).otherwise(a[old]).alias(old)
            return F.struct(total.alias("total"), keep(gap, "gap"), keep(fine, "fine"), keep(b["bin"] + 1, "cut"))

        return step

    def per_class(acc, c):
        need, rest = acc["carry"] + c["due"], acc["rest"] - c["words"]
        start = F.struct(F.lit(0.0).alias("total"), need.alias("gap"), ((need >= 0) & (need <= rest)).alias("fine"), F.lit(0).alias("cut"))
        best = F.aggregate(c["bins"], start, cut_of(need, rest))
        # One evaluation of the inner fold serves both fields.
        return F.element_at(F.transform(F.array(best), lambda b: F.struct(b["gap"].alias("carry"), rest.alias("rest"), F.concat(acc["cut"], F.array(F.struct(c["k"].alias("k"), b["cut"].alias("cut")))).alias("cut"))), 1)

    none = F.struct(F.lit(0.0).alias("carry"), F.col("all").alias("rest"), F.array().cast("array<struct<k:int,cut:int>>").alias("cut"))
    found = hists.select("source", F.map_from_entries(F.aggregate("hist", none, per_class, lambda a: a["cut"])).alias("cut"))
    p, f = params.alias("p"), found.alias("f")
    return p.join(f, F.col("p.source").eqNullSafe(F.col("f.source")), "left").select("p.*", "f.cut")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), total: float = 1.5, most: float = MAX_COPIES) -> DataFrame:
    """``docs`` (with ``doc_id``, ``text``, ``source``) plus size, source_size, target, rate and copies.

    The five names are prefixed with ``_`` where ``docs`` has such columns; their order is the one given here.
    """
    names = fresh(docs, "size", "source_size", "target", "rate", "copies")
    size = n_words(F.col("text"))
    keyed = table(docs.select("source", size.alias("size"), uniform(F.col("doc_id"), size).alias("u")), "mix-sizes")
    sizes = keyed.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = table(sizes, "mix-counts", parts_for(keyed))
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    few = sources.count() <= BROADCAST_SOURCES
    parts = 1 if few else None
    params = solve(sizes, share_targets(sources, weights, total, most), most, parts)
    small = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    q = small(params).alias("p")
    rated = keyed.alias("d").join(q, F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", rate(F.col("lam"), F.col("d.size"), F.col("mean"), F.col("full"), most).alias("rate"))
    # The parameters' one column cannot clash with those of docs.
    c = table(cuts(rated, params, most).select(F.struct(*params.columns, "cut").alias("_mix")), "mix-cuts", parts)
    out = docs.withColumn("_mix_size", size)
    out = out.join(small(c), out["source"].eqNullSafe(F.col("_mix.source")))
    n = F.col("_mix_size")
    w = rate(F.col("_mix.lam"), n, F.col("_mix.mean"), F.col("_mix.full"), most)
    more = (n > 0) & (w < most) & (_bin(uniform(F.col("doc_id"), n), w - F.floor(w)) < F.coalesce(F.try_element_at("_mix.cut", _class(n)), F.lit(0)))
    got = F.least(F.floor(w) + more.cast("int"), F.lit(int(most))).cast("long")
    return out.select(*docs.columns, n.alias(names[0]), F.col("_mix.source_size").alias(names[1]), F.col("_mix.target").alias(names[2]), w.alias(names[3]), got.alias(names[4]))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies say, with the columns of ``docs``."""
    mixed = mix(docs)
    copies = mixed.columns[-1]
    return mixed.where(F.col(copies) > 0).withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*docs.columns)

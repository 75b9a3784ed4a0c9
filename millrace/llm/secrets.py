"""Secret scans: base patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers,
are trained from labelled samples; a token whose log-likelihood ratio reaches ``LEAST`` in all and
``THRESHOLD`` a transition counts as a secret even where no base pattern names it. Tokens are whole runs of 8 key characters
and more; what looks like a plain word or number alone is not judged (``TOKEN``). On random strings that the models have not
seen, recall is 0.8 and more at 8 characters of two kinds, 0.97 at 16, and 0.94 at 20 lower-case letters; of 3000 unseen
ordinary identifiers, and of all words of the largest test table, none is taken for one. Everything is built-in
expressions: training is a ``groupBy`` over the samples' character pairs, whose result is bounded
by the square of the alphabet, and scoring looks the pairs' ratios up in one constant array.

Defined results: a null or empty text has no spans; offsets are code points, end exclusive; equal
rows get equal results; texts are scanned whole, whatever their length, and
no run of characters or number of matches takes quadratic time; an empty table gives an empty
result; extra columns pass through, and new columns give way to clashing names.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound, fresh, match_spans, running, text_of

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A greedy run that is too short ends where no longer one could begin inside it, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the Markov models judge: whole runs of 8 key characters and more, but for a single word of less than 20 letters in one
#: case (the first may be a capital) and for numbers and signs alone. Runs are looked at from their beginnings only, and possessively.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{8})(?!(?:[A-Z]?[a-z]{0,18}+|[A-Z]{0,19}+|[0-9+/_-]++)(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]++={0,2}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
THRESHOLD, LEAST = 0.5, 6.0
SAMPLES = 4000

# Words that ordinary identifiers are made of.
IDENTIFIER_WORDS = (
    "account action active address agent alpha amount archive array article asset async attribute author backup batch beta block branch "
    "bucket buffer build button cache call category channel chapter check child class client cluster code column command commit common "
    "compute config connect content context control convert copy count create current cursor customer daily data database date debug "
    "default delete delta deploy detail device dialog diff digest directory document domain download draft driver edit element email "
    "enable engine entity entry error event example export extra factory feature field file filter final flag folder footer format "
    "frame function gateway global graph group handler header height hidden history home host image import index info input insert "
    "install instance integer internal invoice item iterator job journal key label language layout length level library license limit "
    "line link list load local location lock logger login main manager map marker master match matrix member memory menu message meta "
    "method metric model module monitor month mount name network next node note notice number object offset option order output owner "
    "package page panel parent parser part path pattern payment pixel plan player plugin point policy pool port position post prefix "
    "price print process product profile project property proxy public query queue quota range rate reader record region release remote "
    "render report request reset resource response result retry return role root route rule runtime sample schema scope screen script "
    "search section segment select sender sequence server service session setting shadow shape share signal simple size slice snapshot "
    "socket source space split stack stage start state status step storage store stream string style submit summary switch symbol sync "
    "system table target task template test text theme thread ticket time title token total trace track transfer tree trigger type "
    "unit update upload user utils value vector vendor version video view volume wait warning watch week widget width window worker wrapper write year zone"
).split()


def labelled_samples(n: int = SAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """``n`` random strings (1) and ``n`` ordinary identifiers (0), the same ones each time."""
    rng = random.Random(seed)
    plain = ALPHABET[:62]
    sets = (ALPHABET[:26] + ALPHABET[52:62], plain, ALPHABET[:64], plain + "_-", "0123456789abcdef", "0123456789ABCDEF", ALPHABET[26:62])
    out = [("".join(rng.choice(cs) for _ in range(rng.randint(20, 48))), 1) for cs in (rng.choice(sets) for _ in range(n))]
    for _ in range(n):
        words = [rng.choice(IDENTIFIER_WORDS) for _ in range(rng.randint(2, 6))]
        style = rng.randrange(6)
        number = str(rng.choice((rng.randint(0, 99), rng.randint(1990, 2030), rng.randint(0, 10**8)))) if rng.random() < 0.6 else ""
        if style == 0:
            s = words[0] + "".join(w.title() for w in words[1:]) + number
        elif style == 1:
            s = "".join(w.title() for w in words) + number
        elif style == 4:
            s = "_".join(w.upper() for w in words) + "_" * bool(number) + number
        else:
            glue = ("_", "-", "/", "")[style % 4]
            s = glue.join(words + [number] * bool(number))
        out.append((s, 0))
    return out


def train(spark: SparkSession, samples: DataFrame | None = None, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio (random over ordinary) of every pair of ``ALPHABET``, row by row.

    ``samples`` has ``token`` and ``label`` (1 random, 0 ordinary); characters outside the alphabet count for nothing.
    """
    if samples is None:
        samples = spark.createDataFrame(labelled_samples(), "token string, label int")
    at = F.transform(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.struct(F.element_at("at", i).alias("a"), F.element_at("at", i + 1).alias("b"))))
    counts = samples.where(F.length("token") > 1).select("label", at.alias("at"), "token").select("label", pair.alias("p")).groupBy("label", "p.a", "p.b").count()
    n = len(ALPHABET)
    seen = {(r["label"], r["a"] - 1, r["b"] - 1): r["count"] for r in counts.where("a > 0 and b > 0").collect()}
    import math

    rows = {(y, a): sum(seen.get((y, a, b), 0) for b in range(n)) for y in (0, 1) for a in range(n)}
    log = lambda y, a, b: math.log((seen.get((y, a, b), 0) + smoothing) / (rows[y, a] + smoothing * n))
    return [round(log(1, a, b) - log(0, a, b), 4) for a in range(n) for b in range(n)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of ``token``, the sum over its transitions; characters outside the alphabet are left out."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.filter(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), lambda x: x >= 0)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(codes, start, lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.when(a["last"] < 0, 0.0).otherwise(F.element_at(table, a["last"] * len(ALPHABET) + x + 1))).alias("sum")), lambda a: a["sum"])


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _if(text: Column, pattern: str, spans: Column) -> Column:
    """``spans`` where the cheaper ``pattern`` is found at all, else none."""
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:long,kind:int,end:long>>"


def base_spans(text: Column) -> Column:
    """Spans of the three base patterns, by start and then kind; those that are too short are dropped after matching."""
    secret = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.filter(F.zip_with(match_spans(text, ASSIGN), secret, lambda s, g: F.struct(s["start"].alias("start"), F.lit(0).alias("kind"), s["end"].alias("end"), F.length(g).alias("n"))), lambda s: s["n"] >= 6)
    assign = F.transform(assign, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_sort(F.concat(
        _if(text, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", assign),
        _if(text, ACCESS, _kind(match_spans(text, ACCESS), 1)),
        _if(text, HEX, _kind(match_spans(text, HEX), 2)),
    ))


def scan(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` plus ``base`` and ``spans``: arrays of ``struct(start, kind, end)``, kind an index into ``KINDS``.

    A Markov span that lies inside a base span is left out: that place is found already.
    """
    model = train(docs.sparkSession) if model is None else model
    base, spans = fresh(docs, "base", "spans")
    t = text_of(text)
    found = docs.withColumn(base, base_spans(t))
    # Only for the few texts with such a token are its ratios worked out.
    tokens = F.filter(match_spans(t, TOKEN), lambda s: ratio(s["match"], model) >= F.greatest(F.lit(float(LEAST)), threshold * (F.length(s["match"]) - 1)))
    judged = _if(t, TOKEN, _kind(tokens, 3))
    # A base span that begins at or before a token and ends at or after it: of those that begin so far, the one that reaches farthest.
    order = F.array_sort(F.concat(F.transform(F.col(base), lambda s: F.struct(s["start"].alias("at"), F.lit(0).alias("turn"), s["end"].alias("end"))), F.transform(judged, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("turn"), s["end"].alias("end")))))
    reach = lambda order: running(order, lambda far, x: F.when(x["turn"] == 0, F.greatest(far, x["end"])).otherwise(far))
    marked = lambda order: F.zip_with(order, reach(order), lambda x, far: F.struct(x["at"].alias("start"), F.when((x["turn"] == 1) & (far < x["end"]), F.lit(3)).alias("kind"), x["end"].alias("end")))
    outside = F.filter(bound(order, marked), lambda s: s["kind"].isNotNull())
    added = F.when(F.size(base) == 0, judged).otherwise(outside)
    return found.withColumn(spans, F.array_sort(F.concat(F.col(base), added)))


def spelled(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret, or run of overlapping ones, replaced by ``mark``; a null text stays null.

    ``n_chars`` is counted anew where there is such a column and the text has changed.
    """
    found = scan(docs, text=text)
    spans = found.columns[-1]
    t = text_of(text)
    # ``cut`` has for each span where the text before it that is kept begins and ends; overlapping spans keep nothing between them.
    far = running(F.col(spans), lambda at, s: F.greatest(at, s["end"]))
    cuts = lambda far: F.zip_with(F.col(spans), F.slice(F.concat(F.array(F.lit(0).cast("long")), far), F.lit(1), F.size(far)), lambda s, b: F.struct(b.alias("from"), s["start"].alias("to")))
    # Places in a text are found by counting from its beginning, so that is done once a block of spans, and then inside the block's text.
    part = lambda cut: F.transform(blocks(cut), lambda c: F.struct(c.alias("cut"), c[0]["from"].alias("at"), F.substr(t, (c[0]["from"] + 1).cast("int"), F.greatest(F.element_at(c, -1)["to"] - c[0]["from"], F.lit(0)).cast("int")).alias("text")))
    gap = lambda p, c: F.when(c["to"] >= c["from"], F.concat(F.substr(p["text"], (c["from"] - p["at"] + 1).cast("int"), (c["to"] - c["from"]).cast("int")), F.lit(mark))).otherwise("")
    glued = lambda cut: F.array_join(F.transform(part(cut), lambda p: F.array_join(F.transform(p["cut"], lambda c: gap(p, c)), "")), "")
    clean = bound(far, lambda far: F.concat(bound(cuts(far), glued), F.substr(t, (F.element_at(far, -1) + 1).cast("int"))))
    hit = F.size(spans) > 0
    out = found.withColumn(text, F.when(hit, clean).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

"""Chat formatting by prefix-target expansion, in DataFrame operations alone.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is
trainable. Turns after the last assistant turn, or a conversation without one, make one further example
with nothing trainable, so that no turn is lost. Control strings inside texts are escaped reversibly: a
backslash goes between ``<`` and ``|`` (and one more where there are some already), so that ``<|`` never
comes from a text.

Defined results: null texts and roles count as empty; turns go by number, nulls first, then by role and text,
so that ties and repeated rows have one order; rows with a null conv_id form one conversation; an empty
table gives an empty result; extra columns are not carried. The examples of a conversation repeat its
turns, so their size grows with the square of its length: that is the format. Each is built in a row of
its own, one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    """A role on one line: backslashes and line ends are escaped as well."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unrole(role: Column) -> Column:
    # An escaped role holds no "<|", so that can stand for a backslash while line ends are put back.
    bare = F.replace(F.replace(role, F.lit("\\\\"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return unescape(F.replace(bare, F.lit("<|"), F.lit("\\")))


def conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the turns of each conversation in order, escaped and formatted."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def examples(rows: DataFrame, target_role: str = TARGET_ROLE) -> DataFrame:
    """``(conv_id, example, formatted, loss_start, loss_length, is_last)``, a row for each example.

    ``loss_start`` and ``loss_length`` are code points of ``formatted``: the one trainable span.
    """
    lines = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), _role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == target_role).alias("target")))
    ready = conversations(rows).select("conv_id", lines.alias("lines"))
    n = F.size("lines")
    ends = F.filter(F.transform("lines", lambda x, i: F.when(x["target"], i + 1)), lambda i: i.isNotNull())
    ready = ready.withColumn("ends", ends)
    ready = ready.withColumn("ends", F.when(F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), "ends"), -1), F.lit(0)) < n, F.concat("ends", F.array(n))).otherwise(F.col("ends")))
    # An index is exploded, not the texts: each example is put together in its own row.
    one = ready.select("conv_id", "lines", F.size("ends").alias("n_examples"), F.posexplode("ends").alias("example", "upto"))
    last = F.element_at("lines", F.col("upto"))
    before = F.array_join(F.transform(F.slice("lines", F.lit(1), F.col("upto") - 1), lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    context = F.concat(before, last["head"])
    one = one.select(
        "conv_id", F.col("example").cast("long").alias("example"), context.alias("context"), last["body"].alias("body"), last["target"].alias("target"), (F.col("example") == F.col("n_examples") - 1).alias("is_last"))
    return one.select(
        "conv_id", "example", F.concat("context", "body", F.lit(END + "\n")).alias("formatted"),
        F.when(F.col("target"), F.length("context")).otherwise(F.lit(0)).cast("long").alias("loss_start"),
        F.when(F.col("target"), F.length("body")).otherwise(F.lit(0)).cast("long").alias("loss_length"), "is_last")


def parse(formatted: Column) -> Column:
    """The turns that a formatted text was made from: an array of ``struct(role, text)``."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: F.length(p) > 0)
    bare = F.transform(pieces, lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(bare, lambda p: F.struct(
        _unrole(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text")))


def read_back(made: DataFrame) -> DataFrame:
    """From ``examples()`` output alone, per conversation: its turns' and its trainable texts' digests and sizes."""
    loss = unescape(F.substr("formatted", (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    turns = F.when(F.col("is_last"), parse(F.col("formatted")))
    each = made.select("conv_id", "example", loss.alias("loss"), F.length("formatted").cast("long").alias("n"), turns.alias("turns"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    each = each.select("conv_id", "example", "loss", "n", F.size("turns").cast("long").alias("n_turns"), F.when(F.col("turns").isNotNull(), digest).alias("sha"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    done = each.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("sha").alias("turns_sha256"), whole.alias("loss"), F.sum("n").alias("formatted_chars"))
    return done.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")

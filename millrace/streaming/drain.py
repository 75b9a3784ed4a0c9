"""Drains a buffer by Structured Streaming: each closed segment is a batch."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import body


def stream(spark: SparkSession, ready: str, columns: body.Columns, checkpoint: str, load: Callable[[DataFrame, int], None], seconds: float | None = None, once: bool = False) -> StreamingQuery:
    """Starts a query that hands every new segment to ``load`` with its batch number.

    The checkpoint is the manifest: a batch that was not finished comes again under the same number, which ``load`` has to use
    as its idempotency key. One segment is one batch, so that labels do not depend on timing.
    """
    reader = spark.readStream.schema(body.schema(columns)).option("maxFilesPerTrigger", 1).option("mode", "FAILFAST")
    writer = reader.json(ready).writeStream.option("checkpointLocation", checkpoint).foreachBatch(load)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds or 5} seconds")
    return writer.start()


def replay(spark: SparkSession, root: str, columns: body.Columns | None = None, segment: str | None = None) -> DataFrame:
    """All that a buffer holds, or one of its segments, as a batch."""
    ready = os.path.join(root, "ready")
    path = os.path.join(ready, segment) if segment else ready
    reader = spark.read.option("mode", "FAILFAST")
    if columns:
        reader = reader.schema(body.schema(columns))
    return reader.json(path)

"""The correction log as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.resolve import latest
from ..sources.readers import CORRECTION_SCHEMA

KEYS = ["field_name", "ai_value", "user_value"]


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """New JSON lines files of a folder, as they come."""
    return spark.readStream.schema(CORRECTION_SCHEMA).json(path)


def distinct_corrections(log: DataFrame, watermark: str | None = "1 day") -> DataFrame:
    """Each correction once; on a stream within a watermark, so that the state stays small."""
    if log.isStreaming and watermark:
        return log.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(KEYS)
    return log.dropDuplicates(KEYS)


def already_there(new: DataFrame, log: DataFrame) -> DataFrame:
    """Corrections of which the log has one with the same field and both values."""
    return new.join(log.select(*KEYS).distinct(), KEYS, "left_semi")


def latest_corrections(log: DataFrame, n: int = 5, category: str | None = None) -> DataFrame:
    """The last ``n`` corrections of each field, oldest first, of one category or all."""
    rows = log if category is None else log.where(F.col("category") == category)
    return latest(rows, "field_name", "seq", n)


def sink(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the stream to a table; restarts go on from the checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def on_batch(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs a batch plan on each micro-batch, for example an extraction of new documents."""
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows, for monitoring the log."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def rule_sentence(log: DataFrame) -> DataFrame:
    """Corrections as sentences to embed, the user's rule first; those that change nothing
    or name no field go."""
    ai, user = F.coalesce("ai_value", F.lit("")), F.coalesce("user_value", F.lit(""))
    ruled = F.format_string('RULE for field "%s": %s (Value should be "%s", not "%s")', F.col("field_name"), F.col("rule"), user, ai)
    plain = F.format_string('Field "%s": AI said "%s" but correct value is "%s". Doc type: %s.', F.col("field_name"), ai, user, F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")))
    told = F.when(F.coalesce("rule", F.lit("")) != "", ruled).otherwise(plain)
    return log.where((F.coalesce("field_name", F.lit("")) != "") & (ai != user)).withColumn("sentence", told)

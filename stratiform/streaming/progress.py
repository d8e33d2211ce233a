"""Progress lines of running jobs, folded to the latest state by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent, progress


def parsed(lines: DataFrame) -> DataFrame:
    """job_id, seq and the progress fields of each line; other lines have null fields."""
    return lines.select("job_id", "seq", *[c.alias(n) for n, c in progress(F.col("value")).items()])


def latest(lines: DataFrame) -> DataFrame:
    """Latest value of each field and job; what a line lacks keeps its earlier value (R01). Works on streams in complete or update mode."""
    p = parsed(lines)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return p.groupBy("job_id").agg(F.count("*").alias("lines"), *[last(c) for c in ("step", "steps", "phase", "slices_done", "slices_total", "message")])


def with_percent(state: DataFrame) -> DataFrame:
    return state.withColumn("percent", percent(F.col("step"), F.col("steps"), F.col("slices_done"), F.col("slices_total")))


def start(lines: DataFrame, name: str, checkpoint: str | None = None):
    """Runs the fold on a stream of (job_id, seq, value) into a memory table."""
    w = with_percent(latest(lines)).writeStream.outputMode("complete").format("memory").queryName(name)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def alive(events: DataFrame, minutes: int = 60) -> DataFrame:
    """Events in tumbling windows by type, late ones up to ten minutes (for monitoring)."""
    return events.withWatermark("timestamp", "10 minutes").groupBy(F.window("timestamp", f"{minutes} minutes").alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")

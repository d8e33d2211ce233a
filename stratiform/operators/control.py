"""Projects, samples, events, logs and queues as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES = {"pending", "queued", "running", "done", "error", "cancel"}


def sample_state(events: DataFrame) -> DataFrame:
    """Latest state of each sample; a cancelled one is pending again, only ended ones have an end."""
    e = events.where(F.col("event").isin(sorted(STATES)))
    last = e.groupBy("sample_id").agg(F.max_by(F.struct("event", "timestamp"), "id").alias("l"), F.count("*").alias("n_events"))
    status = F.when(F.col("l.event") == "cancel", "pending").otherwise(F.col("l.event"))
    return last.select("sample_id", status.alias("status"), F.when(status.isin("done", "error"), F.col("l.timestamp")).alias("finished_at"), "n_events")


def state_durations(events: DataFrame) -> DataFrame:
    """Seconds from each event to the sample's next."""
    w = Window.partitionBy("sample_id").orderBy("id")
    e = events.withColumn("next", F.lead("timestamp").over(w))
    return e.groupBy("event").agg(F.count("next").alias("n"), F.sum(F.unix_timestamp("next") - F.unix_timestamp("timestamp")).alias("seconds"))


def tail(events: DataFrame, n: int, key: str = "sample_id", order: str = "id") -> DataFrame:
    """The last n rows of each key."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def recent(events: DataFrame, sample: str, limit: int = 100) -> DataFrame:
    """The newest events of a sample, oldest first (S17, T11); limit is held to 1..500."""
    return events.where(F.col("sample_id") == sample).orderBy(F.desc("id")).limit(max(1, min(500, limit))).orderBy("id")


def listing(rows: DataFrame, *, where: dict[str, object] | None = None, order: list[tuple[str, bool]] | None = None, limit: int | None = None, name: str = "id") -> DataFrame:
    """Rows of a stored table by equality filters, ordered by (column, falling) and then by name, the first `limit` of them (S17). A filter value of None asks for null."""
    for c, v in (where or {}).items():
        rows = rows.where(F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    rows = rows.orderBy(*[F.desc(c) if falling else F.asc(c) for c, falling in order or []], name)
    return rows if limit is None else rows.limit(limit)


def get(rows: DataFrame, value, name: str = "id") -> DataFrame:
    """The row of one name, or none."""
    return rows.where(F.col(name) == F.lit(value)).limit(1)


def delete_project(events: DataFrame, samples: DataFrame, project: str) -> DataFrame:
    """Events that stay when a project with its samples goes."""
    return events.join(samples.where(F.col("project_id") == project).select("sample_id"), "sample_id", "left_anti")


def drop_stale(tasks: DataFrame, now, max_age_s: float = 3600.0, cap: int = 50) -> DataFrame:
    """Tasks that ended less than max_age_s ago or still run, the newest `cap` of them."""
    live = tasks.where(F.col("finished_at").isNull() | (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("finished_at") <= max_age_s))
    return live.orderBy(F.desc("started_at"), "task_id").limit(cap)


def newest_first(rows: DataFrame, keys: list[str], when: str, name: str) -> DataFrame:
    """Rows with their place from 1 in each group, the newest first, of one time by name."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(when), name)))


def task_states(events: DataFrame) -> DataFrame:
    """State of each background task from its events (R08): cancelled where a cancel came before any end, else done or error by the first end, else running; with the latest progress.

    events: task_id, seq, kind (start, progress, cancel, done, error), percent, message. Progress after a cancel doesn't count, as a task stops at its next report.
    """
    first = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.col("seq")))
    ends = events.groupBy("task_id").agg(first("done", "error").alias("_end"), first("cancel").alias("_cancel"), F.min_by("kind", F.when(F.col("kind").isin("done", "error"), F.col("seq"))).alias("_how"), F.count("*").alias("events"))
    stopped = F.col("_cancel").isNotNull() & (F.col("_end").isNull() | (F.col("_cancel") < F.col("_end")))
    ends = ends.withColumn("status", F.when(stopped, "cancelled").otherwise(F.coalesce("_how", F.lit("running"))))
    seen = events.where("kind = 'progress'").join(ends.select("task_id", "_cancel"), "task_id").where(F.col("_cancel").isNull() | (F.col("seq") < F.col("_cancel")))
    last = seen.groupBy("task_id").agg(F.max_by(F.struct("percent", "message"), "seq").alias("_p"))
    return ends.join(last, "task_id", "left").select("task_id", "status", F.coalesce("_p.percent", F.lit(0)).alias("percent"), F.col("_p.message").alias("message"), "events")


def poll(state: DataFrame, logs: DataFrame, lines: int = 20) -> DataFrame:
    """Each job's state with its last log lines, oldest first, and its errors (R02). state: job_id and what is told of it; logs: job_id, seq, level, line."""
    last = logs.withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))).where(F.col("_r") <= lines)
    tail = last.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]).alias("log_tail"))
    errors = logs.where(F.col("level") == "error").groupBy("job_id").agg(F.count("*").alias("errors"), F.max_by("line", "seq").alias("last_error"))
    out = state.join(tail, "job_id", "left").join(errors, "job_id", "left")
    return out.withColumns({"log_tail": F.coalesce("log_tail", F.array().cast("array<string>")), "errors": F.coalesce("errors", F.lit(0))})


def queue_status(items: DataFrame) -> DataFrame:
    """Counts by status and the items in order."""
    return items.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "sample_id"))), lambda s: s["sample_id"]).alias("items"))


def next_free_id(ids: DataFrame) -> DataFrame:
    """The smallest positive number that isn't an id."""
    have = ids.select(F.col("id").cast("long").alias("id")).where("id > 0").distinct()
    after = have.select((F.col("id") + 1).alias("c")).unionByName(ids.sparkSession.range(1).select(F.lit(1).cast("long").alias("c")))
    return after.join(have, after["c"] == have["id"], "left_anti").agg(F.min("c").alias("next_id"))


def stale(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Artifacts with a source that is newer."""
    newest = sources.groupBy("artifact").agg(F.max("mtime").alias("source_mtime"))
    return targets.join(newest, "artifact", "left").select("artifact", (F.coalesce("source_mtime", F.lit(0)) > F.col("mtime")).alias("stale"))

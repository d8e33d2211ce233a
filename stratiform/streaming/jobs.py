"""Background tasks as keyed state with timers: a stream of task events folded to each task's state.

The rule is that of control.task_states, whatever order events come in: the first end or an earlier cancel decides, and the
latest progress before a cancel counts. A task holds its progress reports that a late cancel may still reach; reports older than the
watermark shrink to the last of them, so state is bounded by the lateness. A task that ended goes max_age_s after its end by an event-time timer, which tells
of it once more as expired. Events that come after their time (older than the watermark) are told apart as late and change nothing.

A key holds one task, or the few tasks of a group (those of a user, say): each key costs some ms of calls to the state store, so that tasks with few events are better kept together. A group's
row of state is read and written whole, hence groups have to stay small whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

OUT = "task_id string, status string, percent int, message string, events long, version long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = 2**62


# A task while it is worked on: these, then its reports by seq.
_TASK = {"end_seq": "long", "how": "string", "ended_ms": "long", "cancel_seq": "long", "cancel_ms": "long", "events": "long", "version": "long", "due_ms": "long"}
_END, _HOW, _ENDED, _CANCEL, _CANCELLED, _EVENTS, _VERSION, _DUE, _SEEN = range(9)
_NEW = (NEVER, None, NEVER, NEVER, NEVER, 0, 0, NEVER)
_REPORT = {"seq": "long", "percent": "int", "message": "string", "at_ms": "long"}


class TaskRegistry(StatefulProcessor):
    """One value of state a key, read and written once a batch, with one timer, that of its first task to go. Its tasks and their reports are arrays side by side, which cross to the store fastest; `place` tells a report's task."""

    def __init__(self, max_age_s: float = 3600.0):
        self.max_age_ms = int(max_age_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = {"id": "string", **_TASK, "place": "int", **_REPORT}
        self.state = handle.getValueState("tasks", "timer_ms long, " + ", ".join(f"{k} array<{v}>" for k, v in arrays.items()))

    def held(self) -> tuple[dict[str, list], int]:
        """The key's tasks by their ids, and when its timer goes off."""
        row = self.state.get()
        if not row:
            return {}, NEVER
        timer, ids, n = row[0], row[1], 2 + len(_TASK)
        tasks = {i: [*t, {}] for i, *t in zip(ids, *row[2:n], strict=True)}
        for place, *report in zip(*row[n:], strict=True):
            tasks[ids[place]][_SEEN][report[0]] = tuple(report)
        return tasks, timer

    def keep(self, tasks: dict[str, list], timer: int, fired: bool = False) -> None:
        """Writes the tasks; the timer follows the first of them to go. One that went off is gone."""
        due = min((t[_DUE] for t in tasks.values()), default=NEVER)
        if due != timer or fired:
            if timer < NEVER and not fired:
                self.handle.deleteTimer(timer)
            if due < NEVER:
                self.handle.registerTimer(due)
        if not tasks:
            self.state.clear()
            return
        own = zip(*(t[:_SEEN] for t in tasks.values()), strict=True)
        reports = [(place, *r) for place, t in enumerate(tasks.values()) for r in t[_SEEN].values()]
        told = zip(*reports, strict=True) if reports else [()] * (1 + len(_REPORT))
        self.state.update((due, list(tasks), *map(list, own), *map(list, told)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        tasks, timer = self.held()
        late, changed = {}, {}
        for row in rows:
            i, seq, kind, ms = row["task_id"], row["seq"], row["kind"], row["at_ms"]
            if ms < now:
                late[i] = late.get(i, 0) + 1
                continue
            t = changed.get(i)
            if t is None:
                t = changed[i] = tasks.setdefault(i, [*_NEW, {}])
            t[_EVENTS] += 1
            if kind in ("done", "error") and seq < t[_END]:
                t[_END], t[_HOW], t[_ENDED] = seq, kind, ms
            elif kind == "cancel" and seq < t[_CANCEL]:
                t[_CANCEL], t[_CANCELLED] = seq, ms
            elif kind == "progress":
                t[_SEEN][seq] = (seq, row["percent"], row["message"], ms)
        out = [self.row(i, "late", None, None, n, -1) for i, n in late.items()]
        for i, t in changed.items():
            t[_VERSION] += 1
            last, seen = self.trimmed(t[_SEEN], t[_CANCEL], now)
            t[_SEEN] = {r[0]: r for r in seen}
            over = min(t[_ENDED], t[_CANCELLED])
            if over < NEVER:
                t[_DUE] = max(over + self.max_age_ms, now + 1)
            status = "cancelled" if t[_CANCEL] < t[_END] else t[_HOW] or "running"
            out.append(self.row(i, status, (last[1] if last else None) or 0, last[2] if last else None, t[_EVENTS], t[_VERSION]))
        if changed:
            self.keep(tasks, timer)
        yield from out

    @staticmethod
    def trimmed(seen: dict, cancel: int, now: int) -> tuple[tuple | None, list[tuple]]:
        """The latest progress before the cancel, and what stays: of reports older than the watermark only the last that counts."""
        counts = sorted((r for r in seen.values() if r[0] < cancel), key=lambda r: r[0])
        old = [r for r in counts if r[3] < now][-1:]
        return (counts[-1] if counts else None), [r for r in counts if r[3] >= now or r in old]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        tasks, timer = self.held()
        gone = {i: tasks.pop(i) for i in [i for i, t in tasks.items() if t[_DUE] <= now]}
        if gone:
            self.keep(tasks, timer, fired=True)
        yield from [self.row(i, "expired", None, None, t[_EVENTS], t[_VERSION] + 1) for i, t in gone.items()]

    @staticmethod
    def row(task_id, status, percent, message, events, version) -> Row:
        return Row(task_id=task_id, status=status, percent=percent, message=message, events=events, version=version)

    def close(self) -> None:
        pass


def task_stream(events: DataFrame, max_age_s: float = 3600.0, lateness: str = "10 minutes", group: Column | None = None) -> DataFrame:
    """Every change of a task's state, from a stream of task_id, seq, kind, percent, message, at. `group` follows from the task's id, and its few tasks share a row of state."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    out = StructType.fromDDL(OUT)
    key = F.col("task_id") if group is None else group
    keyed = events.select(key.alias("_group"), "task_id", "seq", "kind", "percent", "message", "at", F.unix_millis("at").alias("at_ms")).withWatermark("at", lateness).groupBy("_group")
    return keyed.transformWithState(TaskRegistry(max_age_s), out, "Update", "EventTime")


def latest_states(changes: DataFrame) -> DataFrame:
    """The last state of each task among told changes, expired ones left out; late events are no state."""
    last = changes.where("status <> 'late'").groupBy("task_id").agg(F.max_by(F.struct("status", "percent", "message", "events"), "version").alias("s"))
    return last.select("task_id", "s.*").where("status <> 'expired'")


def run_to_end(changes: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over what its source has and gives the changes as a table in the folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")  # a batch that runs again writes the same folder

    q = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return changes.sparkSession.read.schema(OUT).option("recursiveFileLookup", True).parquet(f"{folder}/changes")

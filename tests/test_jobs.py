"""The task stream against the batch rule, on shuffled input, and its timers and bounded state."""

import random

import pytest

pytest.importorskip("google.protobuf")

from pyspark.sql import functions as F

from stratiform.operators import control
from stratiform.streaming import jobs

EVENTS = "task_id string, seq long, kind string, percent int, message string, at timestamp"


def rows(n_tasks, r):
    out, seq = [], 0
    for _ in range(n_tasks * 8):
        seq += 1
        kind = r.choice(["progress"] * 6 + ["cancel", "done", "error"])
        out.append((f"t{r.randrange(n_tasks)}", seq, kind, r.choice([None, seq % 100]), r.choice([None, f"m{seq}"])))
    return out


def stream(spark, folder, batches, **kw):
    """Files of one batch each, in name order."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "task_id string, seq long, kind string, percent int, message string, s double").selectExpr("task_id", "seq", "kind", "percent", "message", "timestamp_seconds(1700000000 + s) at").coalesce(1).write.parquet(f"{folder}/in/{i:03}")
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    return jobs.run_to_end(jobs.task_stream(source, **kw), f"{folder}/out")


def test_stream_equals_batch_rule_on_shuffled_input(spark, tmp_path):
    r = random.Random(3)
    every = rows(12, r)
    r.shuffle(every)
    batches = [[(*e, float(e[1])) for e in every[i::4]] for i in range(4)]
    got = jobs.latest_states(stream(spark, tmp_path, batches, lateness="1 day"))
    want = control.task_states(spark.createDataFrame(every, "task_id string, seq long, kind string, percent int, message string"))
    key = lambda df: sorted(tuple(x[c] for c in ("task_id", "status", "percent", "message", "events")) for x in df.collect())
    plain = [(t, s, p or 0, m, n) for t, s, p, m, n in key(want)]
    assert [(t, s, p, m or "", n) for t, s, p, m, n in key(got)] == [(t, s, p, m or "", n) for t, s, p, m, n in plain]


def test_ended_tasks_expire_and_late_events_change_nothing(spark, tmp_path):
    batches = [[("a", 1, "progress", 5, "x", 0.0), ("a", 2, "done", None, None, 10.0), ("b", 3, "progress", 7, "y", 20.0)], [("b", 4, "progress", 9, "z", 5000.0)], [("a", 5, "error", None, None, 30.0), ("b", 6, "progress", 11, "w", 5001.0), ("c", 7, "progress", 1, "v", 5002.0)], [("c", 8, "progress", 2, "v2", 5003.0)]]
    out = stream(spark, tmp_path, batches, max_age_s=60.0, lateness="10 seconds")
    told = [(x.task_id, x.status) for x in out.orderBy("version").collect()]
    assert told.count(("a", "done")) == 1 and ("a", "expired") in told and ("a", "late") in told and ("a", "error") not in told
    left = {x.task_id: (x.status, x.percent) for x in jobs.latest_states(out).collect()}
    assert left == {"b": ("running", 11), "c": ("running", 2)}


def test_state_is_bounded_by_lateness(spark, tmp_path):
    batches = [[("a", 100 * b + i, "progress", i, f"m{b}", 1000.0 * b + i) for i in range(100)] for b in range(4)]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "task_id string, seq long, kind string, percent int, message string, s double").selectExpr("task_id", "seq", "kind", "percent", "message", "timestamp_seconds(1700000000 + s) at").coalesce(1).write.parquet(f"{tmp_path}/in/{i:03}")
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = jobs.task_stream(source, lateness="10 seconds").writeStream.outputMode("update").foreachBatch(lambda df, n: df.count()).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) < 260 and held[-1] < 260, held


def test_tasks_of_a_group_share_a_row_of_state(spark, tmp_path):
    """with a group the states are the same and a key holds all of its tasks and one timer; tasks of one group expire one by one."""
    r = random.Random(5)
    every = rows(20, r)
    r.shuffle(every)
    batches = [[(*e, float(e[1])) for e in every[i::3]] for i in range(3)]
    alone = stream(spark, tmp_path / "a", batches, lateness="1 day")
    group = F.expr("substring(task_id, 2, 1)")
    together = stream(spark, tmp_path / "g", batches, lateness="1 day", group=group)
    key = lambda df: sorted(tuple("" if v is None else v for v in x) for x in df.select("task_id", "status", "percent", "message", "events", "version").collect())
    assert key(together) == key(alone)
    ends = [[("a1", 1, "done", None, None, 10.0), ("a2", 2, "error", None, None, 50.0), ("a3", 3, "progress", 7, "y", 60.0)], [("b", 4, "progress", 1, "z", 90.0)], [("a1", 5, "cancel", None, None, 60.0), ("b", 6, "progress", 2, "z", 95.0)], [("b", 7, "progress", 3, "z", 500.0)], [("b", 8, "progress", 4, "z", 501.0)]]
    out = stream(spark, tmp_path / "e", ends, max_age_s=60.0, lateness="10 seconds", group=F.expr("left(task_id, 1)"))
    told = sorted((x.task_id, x.status, x.version) for x in out.collect() if x.task_id != "b")
    assert told == [("a1", "done", 1), ("a1", "expired", 2), ("a1", "late", -1), ("a2", "error", 1), ("a2", "expired", 2), ("a3", "running", 1)]


def test_calls_to_the_store_grow_with_groups_not_tasks():
    """whatever the tasks of a key, its state is read and written once and one timer is set; the state comes back as it was."""

    class Store:
        calls, value = [], None

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            return self.calls.append("get") or self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, ms):  # noqa: N802
            self.calls.append(ms)

    class Times:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 0

    store, registry = Store(), jobs.TaskRegistry(60.0)
    registry.init(store)
    events = [{"task_id": f"t{i % 30}", "seq": i, "kind": "done" if i % 3 else "progress", "percent": 5, "message": "m", "at_ms": 1000 + i} for i in range(300)]
    assert len(list(registry.handleInputRows(("k",), iter(events), Times()))) == 30
    assert store.calls == ["get", 61001, "update"]
    tasks, timer = registry.held()
    assert timer == 61001 and len(tasks) == 30 and sum(t[5] for t in tasks.values()) == 300 and tasks["t0"][8][270] == (270, 5, "m", 1270)

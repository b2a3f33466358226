"""Segmented tables and the queue: restarts, bytes written, merges, and the rule of one running job."""

from __future__ import annotations

import random
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from pageloom.operators import audit
from pageloom.plans.shared import new_path
from pageloom.streaming import logs


def local(path):
    return Path(path.removeprefix("file:"))


def written(place):
    return {p: p.stat().st_size for p in local(place).rglob("table/*/*.parquet")}


def test_each_batch_writes_what_it_changes(spark, tmp_path):
    """Three runs and more on one place: the answer is the fold of all, bytes follow the changes, few segments stay."""
    rng, source, place = random.Random(2), tmp_path / "in", new_path(spark, "edits")
    schema = "event_id long, ts timestamp, doc_id long, page_no int, degrees int"
    known, sums, sizes, seen = {}, {}, [], {}
    for run in range(9):
        n = 20_000 if run == 0 else 300
        rows = [(run * 100_000 + i, rng.randrange(5_000), rng.randrange(1, 4), rng.choice([90, 180, 270])) for i in range(n)]
        rows += [(e, *known[e]) for e in rng.sample(sorted(known), 5)] if known else []  # repeated events
        for e, d, p, deg in rows:
            if e not in known:
                known[e] = (d, p, deg)
                sums[d, p] = (sums.get((d, p), 0) + deg) % 360
        spark.createDataFrame([(e, None, d, p, deg) for e, d, p, deg in rows], schema).coalesce(1).write.mode("append").parquet(str(source / "edits.parquet"))
        stream = logs.event_stream(spark, str(source), "edits", spark.createDataFrame([], schema).schema)
        got = logs.edit_log(stream, place=place)
        assert {(r.doc_id, r.page_no): r.rotation for r in got.collect()} == {k: v for k, v in sums.items() if v}
        now = written(place)
        sizes.append(sum(s for p, s in now.items() if p not in seen))
        seen = {**seen, **now}
    small = sorted(sizes[1:])
    assert small[len(small) // 2] < sizes[0] / 5  # most runs write only their own changes
    assert sum(sizes[1:]) < 3 * sizes[0]
    live = logs.live_segments(spark, place)
    assert len(live) <= 2 * logs.FAN and live[0][0] == 0
    assert all(b + 1 == c for (_, b), (c, _) in zip(live, live[1:], strict=False))


def test_a_repeated_batch_changes_nothing(spark):
    place, keys = new_path(spark, "twice"), ["k"]
    batch = lambda rows: spark.createDataFrame(rows, "k int, v string")
    schema = batch([]).schema
    for number in range(6):
        rows = [(number, "own"), (0, f"v{number}")]
        for _ in range(2):
            logs.save_changes(batch(rows), number, place, schema, keys)
    want = {(0, "v5"), *((k, "own") for k in range(1, 6))}
    assert {tuple(r) for r in logs.current(spark, place, schema, keys).collect()} == want
    logs.save_changes(batch([(1, "again")]), 2, place, schema, keys)  # batch 2 is in a merged segment
    assert {tuple(r) for r in logs.current(spark, place, schema, keys).collect()} == want


def test_the_sessions_state_store_is_left_alone(spark):
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")


def plain_queue(events):
    running, last, out = {}, {}, []
    for queue, seq, job, action in sorted(events):
        reason = None
        if action == "running":
            reason = "AlreadyRunning" if queue in running else None
            running.setdefault(queue, job)
        elif action in ("done", "failed"):
            reason = None if running.get(queue) == job else "NotRunning"
            if reason is None:
                del running[queue]
        elif action == "cancel":
            reason = None if last.get((queue, job)) == "queued" else "NotWaiting"
        elif action != "queued":
            reason = "UnknownAction"
        if reason is None or action == "cancel":
            last[queue, job] = action
        out.append((queue, seq, job, action, reason is None, reason))
    return out


EVENTS = "queue int, seq long, job_id long, action string"


def test_one_running_job_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(8)
    actions = ["queued", "queued", "running", "running", "done", "failed", "cancel", "pause"]
    events = [(0 if rng.random() < 0.5 else rng.randrange(1, 4), seq, rng.randrange(4), rng.choice(actions)) for seq in range(900)]
    want = plain_queue(events)
    second = next(e for e in want if e[5] == "AlreadyRunning")
    assert not second[4]
    batch = audit.queue_run(spark.createDataFrame(events, EVENTS), width=50)
    assert sorted(map(tuple, batch.collect())) == sorted(want)
    place, source = new_path(spark, "queue"), tmp_path / "in"
    schema = spark.createDataFrame([], EVENTS).schema
    for run in range(3):
        part = events[run * 300 : run * 300 + 300]
        spark.createDataFrame(rng.sample(part, len(part)), EVENTS).write.mode("append").parquet(str(source / "jobs.parquet"))
        got = logs.queue_run(logs.event_stream(spark, str(source), "jobs", schema), place=place)
        assert sorted(map(tuple, got.collect())) == sorted(w for w in want if w[1] < run * 300 + 300)
    late = [(0, 5, 9, "queued")]
    spark.createDataFrame(late, EVENTS).write.mode("append").parquet(str(source / "jobs.parquet"))
    got = logs.queue_run(logs.event_stream(spark, str(source), "jobs", schema), place=place)
    assert [r.reason for r in got.filter("job_id = 9").collect()] in ([], ["OutOfOrder"])
    assert audit.queue_run(spark.createDataFrame([], EVENTS)).count() == 0


def test_a_queue_that_never_ends_a_job(spark):
    events = [(1, s, s, "running") for s in range(5)]
    got = audit.queue_run(spark.createDataFrame(events, EVENTS)).orderBy("seq").select(F.col("accepted")).collect()
    assert [r.accepted for r in got] == [True, False, False, False, False]


class Held:
    """A value or map state in memory that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def call(self, fn, *args):
        self.calls += 1
        return fn(*args)

    def exists(self):
        return () in self.rows

    def get(self):
        return self.rows[()]

    def update(self, value):
        self.rows[()] = value

    def clear(self):
        self.rows.clear()

    def containsKey(self, key):  # noqa: N802
        return self.call(self.rows.__contains__, key)

    def getValue(self, key):  # noqa: N802
        return self.call(self.rows.__getitem__, key)

    def updateValue(self, key, value):  # noqa: N802
        self.call(self.rows.__setitem__, key, value)


def test_a_queue_asks_its_state_by_job_and_not_by_event(monkeypatch):
    monkeypatch.setattr(logs, "OUT_ROWS", 700)
    rng, jobs = random.Random(4), 20
    events = [(3, seq, rng.randrange(jobs), rng.choice(["queued", "running", "done", "failed", "cancel", "pause"])) for seq in range(6_000)]
    processor = logs.QueueProcessor()
    processor.running, processor.seen, processor.last = Held(), Held(), Held()
    got = []
    for run in range(3):
        part = pd.DataFrame(rng.sample(events[run * 2_000 : run * 2_000 + 2_000], 2_000), columns=["queue", "seq", "job_id", "action"])
        processor.last.calls = 0
        out = list(processor.handleInputRows((3,), iter([part[:900], part[900:]]), None))
        assert [len(x) for x in out] == [700, 700, 600] and processor.last.calls <= 3 * jobs
        got += [tuple(r) for x in out for r in x.itertuples(index=False)]
    assert got == plain_queue(events)
    late = list(processor.handleInputRows((3,), iter([part[:1]]), None))[0]
    assert late["reason"].tolist() == ["OutOfOrder"] and late["accepted"].tolist() == [False]

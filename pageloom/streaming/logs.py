"""Edit log and job queue kept up to date as events arrive.

Both streams keep mergeable state, so the answer equals the batch form. What a micro-batch
changes is written as one segment; segments are read newest first by key, and merged in
tiers, so that the bytes written follow the changes and not the table. A repeated batch
writes its segment again. Edits are dropped only where a caller bounds how late they may
be (``late``); jobs of a queue must come in order, and what comes late is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, TimestampType

from pageloom.operators.audit import job_state_columns, job_status_of
from pageloom.plans.shared import new_path, with_package

#: Segments of a tier that are merged into one of the next.
FAN = 4
#: Rows that the queue's processor hands back at once.
OUT_ROWS = 100_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A table, one file or a folder of parts, as a stream; times are read as instants, as watermarks need."""
    fields = [StructField(f.name, TimestampType()) if f.dataType.typeName() == "timestamp_ntz" else f for f in schema.fields]
    # a pattern, as a stream takes a plain path for a folder
    return spark.readStream.schema(StructType(fields)).parquet(f"{folder}/{name}.parque[t]")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _finished(spark: SparkSession, place: str) -> list[tuple[int, int]]:
    """(first, last) batch of every segment that was written to its end."""
    where, files = _files(spark, f"{place}/table")
    if not files.exists(where):
        return []
    found = [s.getPath().getName() for s in files.listStatus(where)]
    pairs = [tuple(map(int, n.split("-"))) for n in found if n.replace("-", "").isdigit()]
    return sorted((a, b) for a, b in pairs if files.exists(_files(spark, f"{place}/table/{a}-{b}/_SUCCESS")[0]))


def live_segments(spark: SparkSession, place: str) -> list[tuple[int, int]]:
    """The segments that make up the table: those inside a wider one have been merged into it."""
    every = _finished(spark, place)
    return [x for x in every if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in every)]


def current(spark: SparkSession, place: str, schema: StructType, keys: list[str], parts: list[tuple[int, int]] | None = None) -> DataFrame:
    """The newest row of every key in the live segments, or in the given ones."""
    parts = live_segments(spark, place) if parts is None else parts
    if not parts:
        return spark.createDataFrame([], schema)
    read = [spark.read.schema(schema).parquet(f"{place}/table/{a}-{b}") for a, b in parts]
    if len(read) == 1:
        return read[0]
    rows = None
    for (_, last), part in zip(parts, read, strict=True):
        tagged = part.withColumn("__last", F.lit(last))
        rows = tagged if rows is None else rows.unionByName(tagged)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "__last").alias("r"))
    return newest.select("r.*")


def _tier(part: tuple[int, int]) -> int:
    size, tier = part[1] - part[0] + 1, 0
    while size >= FAN:
        size, tier = size // FAN, tier + 1
    return tier


def save_changes(batch: DataFrame, number: int, place: str, schema: StructType, keys: list[str]) -> None:
    """Add the changed rows of a batch as a segment, then merge the newest segments while FAN of them are of one tier.

    Segments that a merge of an earlier batch replaced are deleted now, not then, so that
    a reader that has just listed them can still finish.
    """
    spark = batch.sparkSession
    live = live_segments(spark, place)
    for a, b in set(_finished(spark, place)) - set(live):
        where, files = _files(spark, f"{place}/table/{a}-{b}")
        files.delete(where, True)
    if any(a <= number <= b and a != b for a, b in live):
        return  # a repeated batch that has been merged already
    batch.select(*schema.names).write.mode("overwrite").parquet(f"{place}/table/{number}-{number}")
    while True:
        last = live_segments(spark, place)[-FAN:]
        if len(last) < FAN or len({_tier(x) for x in last}) > 1:
            return
        current(spark, place, schema, keys, last).write.mode("overwrite").parquet(f"{place}/table/{last[0][0]}-{last[-1][1]}")


def _run(changes: DataFrame, keys: list[str], place: str, mode: str = "update") -> DataFrame:
    """Take in what is new since the last run with the same ``place``; return the current row of every group.

    State lives on disk (RocksDB, saved in the checkpoint), so remembered keys need no
    executor memory; the session's own choice of a state store is left as it was.
    """
    spark = changes.sparkSession
    schema = changes.schema

    def save(batch: DataFrame, number: int) -> None:
        save_changes(batch, number, place, schema, keys)

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        writer = changes.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint")
        query = writer.trigger(availableNow=True).foreachBatch(save).start()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)
    query.awaitTermination()
    return current(spark, place, schema, keys)


def edit_log(edits: DataFrame, *, place: str | None = None, late: str | None = None) -> DataFrame:
    """Folded rotations per page from a stream of edits; repeated event ids count once.

    ``place`` is the folder of checkpoint and table; a later run with the same folder
    reads only new events. Event ids are remembered for good, on disk, unless ``late``
    bounds that, which drops edits older than so much behind the newest one.
    """
    once = edits.dropDuplicates(["event_id"]) if late is None else edits.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    sums = once.groupBy("doc_id", "page_no").agg(F.sum("degrees").alias("turned"))
    folded = _run(sums, ["doc_id", "page_no"], place or new_path(edits.sparkSession, "edits"))
    return folded.select("doc_id", "page_no", F.pmod("turned", F.lit(360)).cast("int").alias("rotation")).filter("rotation <> 0")


def job_status(events: DataFrame, *, place: str | None = None) -> DataFrame:
    """Latest job states from a stream of queue actions; ``place`` as in :func:`edit_log`."""
    states = events.groupBy("job_id").agg(*job_state_columns())
    return job_status_of(_run(states, ["job_id"], place or new_path(events.sparkSession, "jobs")))


class QueueProcessor(StatefulProcessor):
    """One queue: which job runs (value state), and the last thing that counted of each job (map state).

    A job may start while none runs, end while it runs, and be cancelled while it waits.
    Everything else is refused with a reason, and so is an event older than one already seen.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", "job_id long")
        self.seen = handle.getValueState("seen", "seq long")
        self.last = handle.getMapState("last", "job_id long", "action string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        running = self.running.get()[0] if self.running.exists() else None
        seen = self.seen.get()[0] if self.seen.exists() else None
        events = pd.concat(list(rows))[["seq", "job_id", "action"]].sort_values("seq", kind="stable", ignore_index=True)
        # every call to the state is a message to another process: a job is asked for and saved at most once
        known, new, counted, reasons = seen is not None, {}, {}, []
        for seq, job, action in zip(events["seq"].tolist(), events["job_id"].tolist(), events["action"].tolist(), strict=True):
            reason = None
            if seen is not None and seq <= seen:
                reason = "OutOfOrder"
            elif action == "running":
                reason = None if running is None else "AlreadyRunning"
                running = job if running is None else running
            elif action in ("done", "failed"):
                reason = None if running == job else "NotRunning"
                running = None if running == job else running
            elif action == "cancel":
                if job not in new and job not in counted:
                    counted[job] = self.last.getValue((job,))[0] if known and self.last.containsKey((job,)) else None
                reason = None if new.get(job, counted.get(job)) == "queued" else "NotWaiting"
            elif action != "queued":
                reason = "UnknownAction"
            if reason != "OutOfOrder":
                seen = seq
                if reason is None or action == "cancel":
                    new[job] = action
            reasons.append(reason)
        for job, action in new.items():
            self.last.updateValue((job,), (action,))
        if seen is not None:
            self.seen.update((seen,))
        if running is None:
            self.running.clear()
        else:
            self.running.update((running,))
        events.insert(0, "queue", key[0])
        events["reason"] = pd.Series(reasons, dtype=object)
        events["accepted"] = events["reason"].isna()
        for start in range(0, len(events), OUT_ROWS):
            yield events.iloc[start : start + OUT_ROWS][["queue", "seq", "job_id", "action", "accepted", "reason"]]

    def close(self) -> None:
        pass


def queue_run(events: DataFrame, *, place: str | None = None) -> DataFrame:
    """Outcome of every event of a stream of queues (queue, seq, job_id, action); ``place`` as in :func:`edit_log`.

    The same as ``audit.queue_run`` where events of a queue come in order from one run to the next.
    """
    with_package(events.sparkSession)
    rows = events.select("queue", F.col("seq").cast("long").alias("seq"), F.col("job_id").cast("long").alias("job_id"), "action")
    kind = rows.schema["queue"].dataType.simpleString()
    shape = f"queue {kind}, seq long, job_id long, action string, accepted boolean, reason string"
    spark = events.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        done = rows.groupBy("queue").transformWithStateInPandas(QueueProcessor(), shape, "Update", "None")
        return _run(done, ["queue", "seq"], place or new_path(spark, "queues"))
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)

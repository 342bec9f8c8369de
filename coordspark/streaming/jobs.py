"""Structured Streaming jobs over change and request streams."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from coordspark.sources.scratch import new_path
from coordspark.sources.versions import Conflict, VersionedTable, change_table, last_write_table


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's Parquet files as a stream; timestamps without a zone become timestamps."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    out = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir)
    return out.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", interval: str | None = None, checkpoint: str | None = None) -> None:
    """Run a stream through what is there, or every ``interval`` (as '60 seconds') until stopped. With the same ``checkpoint`` it goes on where it was."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or new_path(stream.sparkSession, "stream")).foreachBatch(each)
    query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    query.awaitTermination()


def into_table(stream: DataFrame, table: VersionedTable, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Append each batch of a stream to a versioned table, once: a batch that comes again after a crash is passed over. The table at the end."""
    run_to_end(stream, lambda df, i: table.append(df, name, i), mode, checkpoint=checkpoint)
    return table.read()


def last_writes(changes: DataFrame) -> DataFrame:
    """target_id, field, value: last writer wins, per field."""
    return changes.where("target_id is not null").groupBy("target_id", "field").agg(F.max_by("value", "pos").alias("value"))


def collect_last_writes(changes: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """The final field values of a change stream (target_id, field, value, pos). The stream keeps no state: each batch adds its own last writes to a table."""
    spark, types = changes.sparkSession, {f.name: f.dataType.simpleString() for f in changes.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in ("target_id", "field", "value", "pos"))
    table = last_write_table(spark, path or new_path(spark, "lww"), schema, ["target_id", "field"])
    return into_table(changes.where("target_id is not null").select("target_id", "field", "value", "pos"), table, "writes", checkpoint=checkpoint).drop("pos")


def apply_change_stream(state: DataFrame, changes: DataFrame, fields: list[str], key: str = "global_id", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """State after a stream of changes (key, pos, op, fields). Each batch adds a delta of its own size to a versioned table; ``state`` is its first base."""
    spark, types = changes.sparkSession, {f.name: f.dataType.simpleString() for f in state.schema}
    table = change_table(spark, path or new_path(spark, "state"), ", ".join(f"{c} {types[c]}" for c in (key, *fields)), fields, key)
    table.start(state.select(key, *fields))
    return into_table(changes, table, "changes", checkpoint=checkpoint)


def rate_limit_stream(requests: DataFrame, limit: int, window_ms: int = 60_000) -> DataFrame:
    """requests (ip, ts_ms) with rejected; a window begins with the first request after the last one ended. State: begin and count per ip."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        for batch in batches:
            out = []
            for ts in (batch := batch.sort_values("ts_ms")).ts_ms:
                if start is None or ts - start > window_ms:
                    start, count = int(ts), 1
                else:
                    count += 1
                out.append(count > limit)
            yield pd.DataFrame({"ip": key[0], "ts_ms": batch.ts_ms.to_numpy(), "rejected": out})
        state.update((start, count))

    kind = requests.schema["ip"].dataType.simpleString()
    return requests.select("ip", "ts_ms").groupBy("ip").applyInPandasWithState(step, f"ip {kind}, ts_ms bigint, rejected boolean", "start bigint, n bigint", "append", GroupStateTimeout.NoTimeout)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keep stream state in RocksDB while a query starts: it lies on disk and is written as changes, not whole."""
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _forget_at(state: GroupState, last: pd.Timestamp, idle_ms: int) -> None:
    """Let the state time out ``idle_ms`` of event time after its key's last row."""
    state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))


def assembly_progress(messages: DataFrame, idle_ms: int | None = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """model_id, received, status, pos of a model stream (model_id, ts, pos, kind, n): a row per batch and model, in update mode; start it under ``rocksdb``.

    Elements themselves are written as they come; the end mark, or an error, settles them: complete, partial (an error after
    elements) or failed (before any). A model without a message for ``idle_ms`` (of the stream's own time, ts) is settled
    likewise and forgotten, so the state is three values for each model that has been heard of in that time. Messages that
    come ``late`` or later are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        received, status, last = state.get if state.exists else (0, "idle", -1)
        if state.hasTimedOut:
            state.remove()
            if status != "receiving":
                return
            status = "partial" if received else "failed"
        else:
            rows = pd.concat(list(batches)).sort_values("pos")  # narrow messages of one batch
            for pos, kind, n in zip(rows.pos, rows.kind, rows.n, strict=True):
                last = int(pos)
                if kind == "model-start":
                    received, status = 0, "receiving"
                elif kind == "element-batch":
                    received, status = received + int(n), "receiving"
                elif kind == "model-end":
                    status = "complete"
                elif kind == "error":
                    status = "partial" if received else "failed"
            state.update((received, status, last))
            if idle_ms is not None:
                _forget_at(state, rows.ts.max(), idle_ms)
        yield pd.DataFrame({"model_id": [key[0]], "received": [received], "status": [status], "pos": [last]})

    kind = messages.schema["model_id"].dataType.simpleString()
    rows = messages.select("model_id", "ts", "pos", "kind", "n")
    rows, timeout = (rows, GroupStateTimeout.NoTimeout) if idle_ms is None else (rows.withWatermark("ts", late), GroupStateTimeout.EventTimeTimeout)
    return rows.groupBy("model_id").applyInPandasWithState(step, f"model_id {kind}, received bigint, status string, pos bigint", "received bigint, status string, pos bigint", "update", timeout)


def assemble(messages: DataFrame, path: str | None = None, checkpoint: str | None = None, idle_ms: int | None = 3_600_000) -> DataFrame:
    """model_id, received, status of all models of a stream that has been read to its end; ``idle_ms`` as in ``assembly_progress``."""
    spark = messages.sparkSession
    kind = messages.schema["model_id"].dataType.simpleString()
    table = last_write_table(spark, path or new_path(spark, "models"), f"model_id {kind}, value struct<received:bigint,status:string>, pos bigint", ["model_id"])
    with rocksdb(spark):
        progress = assembly_progress(messages, idle_ms).select("model_id", F.struct("received", "status").alias("value"), "pos")
        found = into_table(progress, table, "models", "update", checkpoint)
    return found.select("model_id", "value.received", "value.status")


def changed_content(sent: DataFrame, idle_ms: int = 86_400_000, late: str = "10 minutes") -> DataFrame:
    """The rows (global_id, pos, hash) of a stream (with ts) whose hash differs from the one sent before; start it under ``rocksdb``. The state is one hash a key; a key that is not sent for ``idle_ms`` of the stream's own time is forgotten, and sent anew."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # in numpy: what pandas does beside for each key costs more than the rows of most keys
        parts = list(batches)
        pos, hashes = (np.concatenate([p[c].to_numpy(t) for p in parts]) for c, t in (("pos", np.int64), ("hash", object)))
        order = np.argsort(pos, kind="stable")
        none = lambda h: h is None or h != h
        last, changed = state.get[0] if state.exists else None, []
        for i in order.tolist():
            h = None if none(hashes[i]) else hashes[i]
            if h != last:
                changed.append(i)
            last = h
        state.update((last,))
        _forget_at(state, max(p.ts.max() for p in parts), idle_ms)
        if changed:
            yield pd.DataFrame({"global_id": [key[0]] * len(changed), "pos": pos[changed], "hash": hashes[changed]})

    kind = sent.schema["global_id"].dataType.simpleString()
    rows = sent.where("global_id is not null").select("global_id", "ts", "pos", "hash").withWatermark("ts", late)
    return rows.groupBy("global_id").applyInPandasWithState(step, f"global_id {kind}, pos bigint, hash string", "hash string", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: events per type in tumbling windows, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("begins"), "event_type", "n")


class SyncLoop:
    """Pulls remote changes into a versioned table at an interval, from a high-water mark on.

    ``remote`` gives the remote rows as they are now; ``clock`` is their column of change times. Rows from the mark on are
    read, those at the mark again, since others of the same time may have come later; the table must take repeats (as tables
    of last writes do). The mark is stored with the rows, in one step: a loop that is stopped or lost at any point goes on
    from there.
    """

    def __init__(self, table: VersionedTable, remote: Callable[[], DataFrame], clock: str = "updated_at", name: str = "sync"):
        self.table, self.remote, self.clock, self.name = table, remote, clock, name
        self.query, self._halt = None, threading.Event()

    def once(self) -> int:
        """Pull what is new; the number of rows that were added or read again."""
        now = self.table.manifest()
        mark = json.loads(now.marks.get(self.name, "null"))
        rows = self.remote()
        at = F.col(self.clock).cast("string")
        if mark is not None:
            rows = rows.where(F.col(self.clock) >= F.lit(mark["at"]).cast(rows.schema[self.clock].dataType))
        last = rows.agg(F.count(F.lit(1)).alias("n"), F.max(self.clock).cast("string").alias("at")).first()
        if not last.n:
            return 0
        same = rows.where(at == last.at).count()
        if mark == {"at": last.at, "rows": same}:
            return 0
        try:
            self.table.append(rows, self.name, now.batches.get(self.name, -1) + 1, json.dumps({"at": last.at, "rows": same}))
        except Conflict:  # another loop has been faster; the next round sees its mark
            return 0
        return last.n

    def start(self, interval: str = "60 seconds") -> None:
        """Run ``once`` now and at every interval until ``stop``."""
        spark = self.table.spark
        self._halt.clear()

        def tick(_: DataFrame, __: int) -> None:
            if not self._halt.is_set():
                self.once()

        clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        writer = clock.writeStream.queryName(f"{self.name}-{uuid.uuid4().hex[:8]}").option("checkpointLocation", new_path(spark, "sync"))
        self.query = writer.foreachBatch(tick).trigger(processingTime=interval).start()

    def stop(self, seconds: float = 600) -> None:
        """Let a pull that is under way finish, begin no other, and end the loop."""
        self._halt.set()
        until = time.time() + seconds
        while self.query.isActive and self.query.status["isTriggerActive"] and time.time() < until:
            time.sleep(0.05)
        self.query.stop()


class ProgressLog(StreamingQueryListener):
    """Writes what streaming queries report to a folder, a small file an event: run_id, name, phase (started, running, idle, finished, failed), batch_id, rows, seconds, at."""

    SCHEMA = "run_id string, name string, phase string, batch_id bigint, rows bigint, seconds double, at string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _tell(self, run_id, name, phase: str, batch_id: int | None = None, rows: int | None = None, seconds: float | None = None) -> None:
        row = {"run_id": str(run_id), "name": name, "phase": phase, "batch_id": batch_id, "rows": rows, "seconds": seconds, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{uuid.uuid4().hex}.json")
        out = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(target, False)
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._tell(event.runId, event.name, "started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._tell(p.runId, p.name, "running", p.batchId, p.numInputRows, p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._tell(event.runId, None, "idle")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._tell(event.runId, None, "failed" if event.exception else "finished")

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).json(self.path)

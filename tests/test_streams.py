"""Versioned tables, streams that restart, state that expires, the sync loop and its progress."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from coordspark.operators import merge
from coordspark.sources import scratch, versions
from coordspark.streaming import jobs

CHANGES = "global_id string, pos bigint, op string, name string, material string"
STATE = "global_id string, name string, material string"


def some_changes(rng, n, keys=30):
    text = lambda: rng.choice([None, "x", "y", f"v{rng.randrange(100)}"])
    return [(f"g{rng.randrange(keys)}", p, rng.choice(["deleted", "modified", "properties-only", "properties-only"]), text(), text()) for p in range(n)]


def by_force(state, changes):
    out = {r[0]: list(r[1:]) for r in state}
    for key, _, op, *values in changes:
        if op == "deleted":
            out.pop(key, None)
        elif op == "modified":
            out[key] = values
        elif key in out:
            out[key] = [v if v is not None else old for v, old in zip(values, out[key], strict=True)]
    return {k: tuple(v) for k, v in out.items()}


def rows_of(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.fixture
def folder(spark):
    return scratch.new_path(spark, "versions")


def test_change_table_equals_one_by_one(spark, folder, monkeypatch):
    monkeypatch.setattr(versions, "FOLD_LEAST", 4)
    monkeypatch.setattr(versions, "FOLD_SHARE", 0.0)
    rng = random.Random(4)
    state = [(f"g{i}", f"n{i}", None) for i in range(20)]
    table = versions.change_table(spark, folder, STATE, ["name", "material"])
    table.start(spark.createDataFrame(state, STATE))
    table.start(spark.createDataFrame([], STATE))  # there is a table: nothing happens
    known = [c for c in some_changes(rng, 300) if c[2] != "properties-only" or c[0] in {f"g{i}" for i in range(20)}]
    # property changes of keys that are not there leave no rows in either
    for i in range(6):
        batch = known[i * 40 : (i + 1) * 40]
        assert table.append(spark.createDataFrame(batch, CHANGES), "s", i)
        assert not table.append(spark.createDataFrame(batch[:1], CHANGES), "s", i)  # sent twice
    want = by_force(state, known[:240])
    assert rows_of(table.read()) == want
    assert any(not table.manifest(v).deltas for v in table.versions()[1:])  # folded on the way
    assert rows_of(table.read(1)) == {k: (a, b) for k, a, b in state}
    gone = table.vacuum()
    assert gone and len(table.versions()) == 1 and rows_of(table.read()) == want and table.vacuum() == []


def test_a_batch_writes_what_it_changes(spark, folder):
    wide = spark.range(200_000).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("global_id"), F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit(None).cast("string").alias("material"))
    table = versions.change_table(spark, folder, STATE, ["name", "material"])
    table.start(wide)
    for i in range(3):
        table.append(spark.createDataFrame([(f"g{i}", i, "modified", "new", None)], CHANGES), "s", i)
    m = table.manifest()
    assert len(m.deltas) == 3 and m.delta_bytes * 100 < m.base_bytes and table.read().where("name = 'new'").count() == 3


def test_two_writers_of_one_version(spark, folder):
    table = versions.last_write_table(spark, folder, "k bigint, value string, pos bigint", ["k"])
    row = spark.createDataFrame([(1, "a", 1)], "k bigint, value string, pos bigint")

    def other():
        versions.last_write_table(spark, folder, table.schema, ["k"]).append(spark.createDataFrame([(1, "b", 2)], row.schema), "other", 0)

    with pytest.raises(versions.Conflict):
        table.append(row, "mine", 0, finished=other)
    assert rows_of(table.read()) == {1: ("b", 2)} and table.append(row, "mine", 0) and rows_of(table.read()) == {1: ("b", 2)}
    assert [n for n in table.vacuum(keep=2) if n.startswith("delta-")]  # what the loser had written


def files(spark, rows, schema, path, n):
    for i in range(n):
        spark.createDataFrame(rows[i * len(rows) // n : (i + 1) * len(rows) // n], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # streams take files by their times


@pytest.mark.parametrize("after_manifest", [False, True])
def test_a_stream_that_is_lost_goes_on(spark, folder, after_manifest):
    rng = random.Random(7)
    state = [(f"g{i}", "n", "m") for i in range(10)]
    changes = [c for c in some_changes(rng, 200, 10)]
    source, path, checkpoint = f"{folder}-source", f"{folder}-table", f"{folder}-checkpoint"
    files(spark, changes, CHANGES, source, 5)
    stream = lambda: spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
    table = versions.change_table(spark, path, STATE, ["name", "material"])
    table.start(spark.createDataFrame(state, STATE))

    def step(df, i):
        table.append(df, "changes", i, finished=None if after_manifest else (lambda: 1 / 0) if i == 3 else None)
        if after_manifest and i == 3:
            raise ZeroDivisionError  # the table has the batch, the checkpoint does not know

    with pytest.raises(Exception, match="ZeroDivisionError"):
        jobs.run_to_end(stream(), step, checkpoint=checkpoint)
    assert len(table.manifest().deltas) == 3 + after_manifest
    found = jobs.apply_change_stream(spark.createDataFrame([], STATE), stream(), ["name", "material"], path=path, checkpoint=checkpoint)
    assert len(table.manifest().deltas) == 5
    want = rows_of(merge.apply_changes(spark.createDataFrame(state, STATE), spark.createDataFrame(changes, CHANGES), ["name", "material"]))
    assert rows_of(found) == want
    again = jobs.apply_change_stream(spark.createDataFrame([], STATE), stream(), ["name", "material"], path=path, checkpoint=checkpoint)
    assert rows_of(again) == want and len(table.manifest().deltas) == 5


def test_last_writes_over_batches(spark, folder):
    rows = [(1, "a", 1.0, 5), (1, "a", 2.0, 3), (2, "b", 9.0, 1), (None, "a", 0.0, 9), (1, "a", None, 7), (2, "b", 8.0, 0)]
    files(spark, rows, "target_id bigint, field string, value double, pos bigint", f"{folder}-w", 3)
    stream = spark.readStream.schema("target_id bigint, field string, value double, pos bigint").option("maxFilesPerTrigger", 1).parquet(f"{folder}-w")
    assert sorted(map(tuple, jobs.collect_last_writes(stream).collect())) == [(1, "a", None), (2, "b", 9.0)]


MESSAGES = "model_id string, ts timestamp, pos bigint, kind string, n int"


def at(seconds):
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)


def test_assembly_over_batches_and_a_restart(spark, folder):
    rows = [("m", at(0), 0, "model-start", 0), ("m", at(1), 1, "element-batch", 5), ("n", at(2), 2, "element-batch", 1), ("o", at(3), 3, "error", 0), ("q", at(4), 4, "model-start", 0)]
    more = [("m", at(5), 5, "element-batch", 2), ("m", at(6), 6, "model-end", 0), ("n", at(7), 7, "error", 0), ("p", at(8), 8, "model-start", 0), ("p", at(9), 9, "element-batch", 3)]
    files(spark, rows + more, MESSAGES, f"{folder}-a", 2)
    stream = lambda: spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}-a")
    place = {"path": f"{folder}-models", "checkpoint": f"{folder}-ck"}
    assert rows_of(jobs.assemble(stream(), **place)) == {"m": (7, "complete"), "n": (1, "partial"), "o": (0, "failed"), "p": (3, "receiving"), "q": (0, "receiving")}
    # a restart from the checkpoint goes on with the counts it had
    files(spark, [("p", at(10), 10, "element-batch", 4), ("p", at(11), 11, "model-end", 0)], MESSAGES, f"{folder}-a", 1)
    assert rows_of(jobs.assemble(stream(), **place))["p"] == (7, "complete")


def test_silent_models_are_settled_and_forgotten(spark, folder):
    source = f"{folder}-b"
    files(spark, [("p", at(0), 0, "model-start", 0), ("p", at(1), 1, "element-batch", 3), ("q", at(2), 2, "model-start", 0)], MESSAGES, source, 1)
    files(spark, [("r", at(500), 3, "model-start", 0)], MESSAGES, source, 1)
    files(spark, [("r", at(501), 4, "element-batch", 1)], MESSAGES, source, 1)
    files(spark, [("p", at(502), 5, "element-batch", 2)], MESSAGES, source, 1)
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(source)
    got = []
    with jobs.rocksdb(spark):
        jobs.run_to_end(jobs.assembly_progress(stream, 100_000, "1 second"), lambda df, _: got.extend(df.collect()), "update")
    found = [(r.model_id, r.received, r.status) for r in got]
    assert ("p", 3, "partial") in found and ("q", 0, "failed") in found and ("p", 2, "receiving") in found  # counted from nothing: the state was gone


def test_contents_that_change_and_are_forgotten(spark, folder):
    schema = "global_id string, ts timestamp, pos bigint, hash string"
    rows = [("a", at(0), 0, "x"), ("a", at(1), 1, "x"), ("b", at(2), 2, None), ("a", at(3), 3, "y"), ("a", at(4), 4, "x"), ("b", at(5), 5, None), ("b", at(6), 6, "z"), (None, at(7), 7, "x")]
    files(spark, rows, schema, f"{folder}-h", 2)
    files(spark, [("c", at(500), 8, "x")], schema, f"{folder}-h", 1)
    files(spark, [("c", at(501), 9, "x")], schema, f"{folder}-h", 1)
    files(spark, [("a", at(502), 10, "x"), ("c", at(503), 11, "x")], schema, f"{folder}-h", 1)
    got = []
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}-h")
    with jobs.rocksdb(spark):
        jobs.run_to_end(jobs.changed_content(stream()), lambda df, _: got.extend(df.collect()))
        assert sorted(r.pos for r in got) == [0, 3, 4, 6, 8]
        got.clear()
        jobs.run_to_end(jobs.changed_content(stream(), 100_000, "1 second"), lambda df, _: got.extend(df.collect()))
    assert sorted(r.pos for r in got) == [0, 3, 4, 6, 8, 10]  # a's hash was forgotten, so the same content is sent anew


REMOTE = "id bigint, value string, updated_at bigint"


def test_sync_rounds_and_late_ties(spark, folder):
    remote = [(1, "a", 10), (2, "b", 20)]
    table = versions.last_write_table(spark, folder, REMOTE, ["id"], order="updated_at")
    loop = jobs.SyncLoop(table, lambda: spark.createDataFrame(remote, REMOTE))
    assert loop.once() == 2 and loop.once() == 0
    remote.append((3, "c", 20))  # of the same time as the mark
    assert loop.once() == 2
    remote.append((1, "a2", 30))
    assert loop.once() == 3 and jobs.SyncLoop(table, loop.remote).once() == 0  # the mark's rows again; another loop goes on from the stored mark
    assert rows_of(table.read()) == {1: ("a2", 30), 2: ("b", 20), 3: ("c", 20)}
    assert jobs.SyncLoop(versions.last_write_table(spark, f"{folder}-e", REMOTE, ["id"], order="updated_at"), lambda: spark.createDataFrame([], REMOTE)).once() == 0


def test_sync_loop_at_intervals_with_progress(spark, folder):
    log = jobs.ProgressLog(spark, f"{folder}-log")
    spark.streams.addListener(log)
    remote, seen = [(1, "a", 1)], []
    table = versions.last_write_table(spark, folder, REMOTE, ["id"], order="updated_at")

    def read():
        seen.append(len(remote))
        return spark.createDataFrame(remote, REMOTE)

    loop = jobs.SyncLoop(table, read, name="pull")
    try:
        loop.start("1 second")
        until = time.time() + 60
        while time.time() < until and not table.versions():
            time.sleep(0.1)
        remote.append((2, "b", 2))
        while time.time() < until and len(table.versions()) < 2:
            time.sleep(0.1)
        loop.stop()
        rounds = len(seen)
        time.sleep(1.5)
        assert len(seen) == rounds and not loop.query.isActive
        assert rows_of(table.read()) == {1: ("a", 1), 2: ("b", 2)}
        while time.time() < until and log.read().where("phase in ('finished', 'failed')").count() == 0:
            time.sleep(0.2)
        phases = [r for r in log.read().collect()]
        assert {r.phase for r in phases} >= {"started", "running", "finished"}
        running = [r for r in phases if r.phase == "running"]
        assert all(r.name.startswith("pull-") and r.batch_id is not None and r.rows is not None and r.seconds >= 0 for r in running) and len({r.batch_id for r in running}) >= 2
    finally:
        spark.streams.removeListener(log)

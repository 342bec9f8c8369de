"""Queries and operators where tables are larger, or lie otherwise, than the test data."""

import json
import math
import random
from collections import namedtuple

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from coordspark.functions import text
from coordspark.functions.geometry import triangle_segments
from coordspark.operators import cluster, components, spatial
from coordspark.plans import registry
from coordspark.sources import formats, glb

SMALL = "/root/testdata/sf0.001"


def folder(tmp_path, **tables):
    """The small tables in a folder of their own; ``tables`` gives the SQL of those that differ."""
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents conversations".split():
        con.execute(f"CREATE VIEW {t}_given AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
        con.execute(f"COPY ({tables.get(t, f'SELECT * FROM {t}_given')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    return str(tmp_path), con


def same(spark, name, d, con):
    got, want = registry.QUERIES[name](spark, d).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return got


def test_sync_rounds_of_equal_times(spark, tmp_path):
    """Records of one customer that change at the same time: the greatest value stays, whatever the order of the rows."""
    orders = "SELECT o_orderkey * 1000 AS o_orderkey, o_custkey % 20 AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders_given ORDER BY hash(o_orderkey)"
    same(spark, "sync_rounds", *folder(tmp_path, orders=orders))


def test_stream_assembly_waits_for_silent_models(spark, tmp_path):
    """Models that are silent for hours of the stream's time, and then go on."""
    events = "SELECT k * 20000 + event_id AS event_id, ts, event_id % 40 + 40 * (k % 2) AS user_id, event_type, value, props FROM events_given, range(4) AS r(k)"
    got = same(spark, "stream_assembly", *folder(tmp_path, events=events))
    assert (got.status == "receiving").any()


def test_model_lookup_with_keys_beyond_a_million(spark, tmp_path):
    part = "SELECT * FROM part_given UNION ALL SELECT * REPLACE (p_partkey + 1000000 AS p_partkey) FROM part_given"
    same(spark, "model_lookup", *folder(tmp_path, part=part))


def broadcast_joins(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_min_distance_of_small_and_large_meshes(spark):
    rng = random.Random(5)
    points = lambda sizes: [(p, *(float(rng.randrange(500)) for _ in range(3))) for p, n in enumerate(sizes) for _ in range(n)]
    a, b = points([3, 90, 5]), points([4, 100, 0])
    schema = "pair bigint, x double, y double, z double"
    got = spatial.min_distance(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 40)
    assert broadcast_joins(got) == 0
    least = {p: min((math.dist(u[1:], v[1:]) for u in a for v in b if u[0] == p == v[0]), default=math.inf) for p in range(3)}
    assert {r.pair: pytest.approx(r.distance) for r in got.collect()} == {p: d for p, d in least.items() if d <= 40}


def test_box_join_compares_few_pairs_that_do_not_meet(spark):
    """Crowded boxes of several levels: each pair comes once, and the keys leave few others to be compared."""
    rng = random.Random(11)
    rows = []
    for i in range(600):
        low = [rng.randrange(-8000, 8000) for _ in range(3)]
        size = [rng.choice([0, 900, 2500, 5000]) for _ in range(3)]
        rows.append((i, *low, *(p + s for p, s in zip(low, size, strict=True))))
    df = spark.createDataFrame(rows, "id int, x0 int, y0 int, z0 int, x1 int, y1 int, z1 int")
    meet = lambda a, b: all(a[k] - 20 <= b[k + 3] and a[k + 3] + 20 >= b[k] for k in (1, 2, 3))
    want = sorted((a[0], b[0]) for a in rows for b in rows if meet(a, b))
    assert sorted((r.a_id, r.b_id) for r in spatial.box_join(df, df, 20).select("a_id", "b_id").collect()) == want
    a, b = (spatial._cells(df, 20, 3000, [0, 1], side) for side in "ab")
    assert a.join(b, [f"_k{i}" for i in range(4)]).count() < 8 * len(want)  # under the keys alone
    upside = df.withColumns({"x0": F.col("x1"), "x1": F.col("x0")})  # boxes that are inside out meet what holds both their sides, and fail no task
    turned = [(i, d, y, z, x, v, w) for i, x, y, z, d, v, w in rows]
    assert sorted((r.a_id, r.b_id) for r in spatial.box_join(upside, df, 20).select("a_id", "b_id").collect()) == sorted((a[0], b[0]) for a in turned for b in rows if meet(a, b))


def test_boxes_of_many_cells_are_not_broadcast(spark):
    """A plan takes a side for as large as it was before its boxes became many rows; it is shuffled all the same."""
    boxes = spark.range(300).selectExpr("id", "id * 70 % 9000 AS x0", "id * 110 % 3000 AS y0", "id * 130 % 9000 AS z0")
    boxes = boxes.withColumns({f"{k}1": F.col(f"{k}0") + 2500 for k in "xyz"})
    assert broadcast_joins(spatial.box_join(boxes, boxes, 50)) == 0


def test_descriptions_of_missing_values(spark):
    df = spark.createDataFrame([("IfcWall", None, "M", None, "n", None)], "ta string, na string, ma string, tb string, nb string, mb string")
    assert df.select(text.clash_description("ta", "na", "ma", "tb", "nb", "mb")).first()[0] == "IfcWall: null (M) vs null: n (null)"


def test_triangles_are_tested_in_batches(spark):
    """The exact test is no expression that is interpreted for each pair; missing corners do not cross."""
    corners = [f"{side}_{a}{i}" for side in "ab" for i in range(3) for a in "xyz"]
    crossing = (0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0, 2.0, 0.0, 0.5, 0.5, -1.0, 1.5, 0.5, -1.0, 1.0, 0.5, 1.0)
    rows = [(i, *crossing) for i in range(300)] + [(-1, None, *crossing[1:]), (-2, *(0.0,) * 9, *crossing[9:])]
    found = triangle_segments(spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in corners)))
    assert sorted((r.id, r.seg_len, r.mid_x, r.mid_y, r.mid_z) for r in found.collect()) == [(i, 0.5, 1.0, 0.5, 0.0) for i in range(300)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan


def test_few_triangle_pairs_reach_the_exact_test(spark, monkeypatch):
    """Pairs that do not lie astride each other's planes are left out by the join, and no crossing is lost by that."""
    rng = random.Random(3)
    corners = [f"{a}{i}" for i in range(3) for a in "xyz"]
    rows = [(i, *(float(rng.randrange(12)) for _ in corners)) for i in range(150)] + [(150, None, *(3.0,) * 8), (151, *(5.0,) * 9)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in corners))
    a, b = (df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns)) for side in "ab")
    want = sorted((r.a_id, r.b_id, r.seg_len, r.mid_x) for r in triangle_segments(a.crossJoin(b).where("a_id < b_id")).collect())
    tested = []
    monkeypatch.setattr(spatial, "triangle_segments", lambda pairs: tested.append(pairs.count()) or triangle_segments(pairs))
    found = spatial.triangle_contacts(df, df, 5, F.col("a_id") < F.col("b_id"))
    assert sorted((r.a_id, r.b_id, r.seg_len, r.mid_x) for r in found.collect()) == want
    assert len(want) > 1000 and tested[0] < 2 * len(want)


def test_small_meshes_share_a_batch(monkeypatch):
    """Meshes of one triangle each are given on together; a large one ends the batch."""
    points = [np.arange(9 * k, dtype="<f4").tobytes() for k in (1, 1, 0, 5, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3, 4, 5], pa.int64()), pa.array(points, pa.binary()), pa.array([None] * 5, pa.binary())], ["id", "positions", "indices"])
    (whole,) = formats._decoded(iter([batch]))
    assert list(zip(whole["id"].to_pylist(), whole["tri_idx"].to_pylist(), whole["z2"].to_pylist(), strict=True)) == [(1, 0, 8.0), (None, 0, 8.0), *((4, k, 9.0 * k + 8) for k in range(5)), (5, 0, 8.0)]
    monkeypatch.setattr(formats, "TRIANGLES_A_BATCH", 3)
    assert [b.num_rows for b in formats._decoded(iter([batch]))] == [7, 1]


def test_scene_files_are_bounded_by_nodes(spark, tmp_path, monkeypatch):
    """A task's meshes go to files of a bounded number of nodes, however small they are."""
    monkeypatch.setattr(glb, "FILE_NODES", 20)
    row, box = namedtuple("row", "express_id name geometry_id positions indices matrix"), np.arange(9, dtype="<f4").tobytes()
    writer = glb.MeshWriter(str(tmp_path / "out"))
    writer.commit([writer.write(iter([row(i, f"E{i}", None, box, None, None) for i in range(50)]))])
    assert len(list((tmp_path / "out").glob("*.glb"))) == 3
    assert sorted(r.name for r in glb.read_placed(spark, str(tmp_path / "out")).collect()) == sorted(f"E{i}" for i in range(50))


def test_close_points_are_tied_without_sorting_their_pairs(spark):
    """Ties between cells are hubs, found by a hash aggregate, and points that repeat are compared once."""
    points = spark.createDataFrame([(i, "t", float(i % 40 // 8 * 5), float(i % 8), 0.0) for i in range(400)], "id bigint, pair string, x double, y double, z double")
    ties = cluster.near_pairs(points, 9, ["pair"])
    found = ties.collect()
    assert len(found) == len(set(found)) < 400 + 62 * 40
    assert "SortAggregate" not in ties._jdf.queryExecution().executedPlan().toString()
    assert {r.cluster for r in cluster.clusters(points, 9, ["pair"]).collect()} == {0}


def test_neighbours_of_places_are_not_broadcast(spark):
    """A place becomes a row for each neighbouring cell after the last shuffle, which a plan's sizes do not show."""
    points = spark.createDataFrame([(i, "t", float(i % 40), float(i % 8), 0.0) for i in range(400)], "id bigint, pair string, x double, y double, z double")
    ties = cluster.near_pairs(points, 9, ["pair"])
    ties.collect()
    assert "SortMergeJoin" in ties._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_triangles_of_scenes_are_not_broadcast(spark, tmp_path):
    """A file's row becomes its nodes and a piece its triangles, which a plan's sizes do not show."""
    row, box = namedtuple("row", "express_id name geometry_id positions indices matrix"), np.arange(9, dtype="<f4").tobytes()
    writer = glb.MeshWriter(str(tmp_path / "out"))
    writer.commit([writer.write(iter([row(i, f"E{i}", None, box, None, None) for i in range(50)]))])
    found = glb.read_placed(spark, str(tmp_path / "out"))
    assert broadcast_joins(found) == 0 and found.count() == 50


def test_duplicates_beyond_the_period_of_places(spark, tmp_path):
    """Keys that differ by 780,000 have boxes in one place; the planted copies are found all the same."""
    part = "SELECT * FROM part_given UNION ALL SELECT * REPLACE (p_partkey + 780000 AS p_partkey) FROM part_given"
    same(spark, "duplicate_geometry", *folder(tmp_path, part=part))


def test_rounds_broadcast_little(spark, monkeypatch):
    """The joins of a round of connected components hand over limits of their own, below those of a single join."""
    limits, plain = [], components.small
    monkeypatch.setattr(components, "small", lambda df, *limit: limits.append(limit) or plain(df, *limit))
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "a bigint, b bigint")
    assert {r.component for r in components.components(edges).collect()} == {0}
    assert limits and all(rows <= 100_000 and size <= 1 << 20 for rows, size in limits)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_documents_are_read_in_parts(monkeypatch, chunk, indent):
    """No text but a row's is held whole, however the document is laid out."""
    monkeypatch.setattr(formats, "DOCUMENT_CHUNK", chunk)
    rows = [{"id": i, "t": 'a "{[,\n\\' * (i % 3), "n": [{"x": 1.5}, []]} for i in range(20)] + [{"id": i} for i in range(20)] + [7, None, "x"]
    document, longest = json.dumps({"_cc": "m", "n": 1234, "a": rows, "b": [], "o": {"a": [1]}, "c": [1, 2]}, indent=indent), []
    at = 0

    def read(n):
        nonlocal at
        longest.append(n)
        at += n
        return document[at - n : at]

    found = list(formats._document_parts(read))
    assert [json.loads(x) for name, many, texts in found if many and name == "a" for x in texts] == rows
    assert [(name, many, [*map(json.loads, texts)]) for name, many, texts in found if name != "a"] == [("_cc", False, ["m"]), ("n", False, [1234]), ("o", False, [{"a": [1]}]), ("c", True, [1]), ("c", True, [2])]
    assert chunk > 7 or max(longest) < len(document) / 4
    with pytest.raises(ValueError):
        list(formats._document_parts(lambda n, parts=['{"a": [1, ']: parts.pop() if parts else ""))


def test_project_sections_of_other_layouts(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps({"clashes": [{"id": k, "s": {"x": "\u00e9"}}, {"id": 5}], "_cc": "m"}, indent=k or None))
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "other.json").write_text('{"_cc": "no", "clashes": [{"id": 9}]}')
    found = formats.project_section(formats.read_project(spark, str(tmp_path), "m"), "clashes")
    assert sorted((r.id, r.s and r.s.x) for r in found.collect()) == [(0, "\u00e9"), (1, "\u00e9"), (5, None), (5, None)]


def test_streams_read_several_files_a_batch(spark, tmp_path, monkeypatch):
    """Ranges of the events in several files each are still taken range by range, in order."""
    events = "SELECT * REPLACE (event_id * 8 + k AS event_id, user_id + 1000 * (k % 2) AS user_id) FROM events_given, range(8) AS r(k)"
    d, con = folder(tmp_path, events=events)
    monkeypatch.setattr(registry, "_in_files", lambda spark, d, make=registry._in_files: make(spark, d, 700))
    path = registry._in_files(spark, d)
    assert len(spark.read.parquet(path).inputFiles()) > 4
    same(spark, "stream_changed", d, con)

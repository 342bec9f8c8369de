"""Folds, formats, tools and functions on hand-written rows."""

import base64
import json
import random
import struct
from datetime import datetime

from pyspark.sql import functions as F

from coordspark.functions import js, text
from coordspark.operators import merge, quality, review
from coordspark.plans import tools
from coordspark.sources import formats
from coordspark.streaming import jobs

RANK = merge.SOURCE_RANK


def test_label_fold(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(6), p, rng.choice([None, 0, 1, 2]), rng.choice([*RANK, "x"]), rng.random() < 0.1, p) for p in range(200)]
    store = {}
    for i, _, label, source, synthetic, ts in rows:
        if synthetic:
            continue
        old = store.get(i)
        if old and old[0] is not None and label is not None:
            a, b = RANK.get(source, 0), RANK.get(old[1], 0)
            if a < b or (a == b and label <= old[0]):
                continue
        store[i] = (label, source, ts)
    got = merge.merge_labels(spark.createDataFrame(rows, "id int, pos int, label int, label_source string, synthetic boolean, ts int")).collect()
    assert {r.id: (r.label, r.label_source, r.ts) for r in got} == store


def test_change_capture(spark):
    state = spark.createDataFrame([("a", "A", None), ("b", "B", "m"), ("c", "C", "m")], "global_id string, name string, material string")
    changes = spark.createDataFrame(
        [("a", 1, "properties-only", None, "x"), ("b", 2, "deleted", None, None), ("b", 3, "modified", "B2", None), ("c", 4, "properties-only", "C2", None), ("c", 5, "deleted", None, None), ("d", 6, "modified", "D", None), ("d", 7, "properties-only", None, "y")],
        "global_id string, pos int, op string, name string, material string",
    )
    got = {r.global_id: (r.name, r.material) for r in merge.apply_changes(state, changes, ["name", "material"]).collect()}
    assert got == {"a": ("A", "x"), "b": ("B2", None), "d": ("D", "y")}


def test_js_rules(spark):
    df = spark.createDataFrame([(-2.5, "\t x\u00a0", "12.5 mm")], "d double, s string, n string")
    row = df.select(js.round_half_up("d").alias("r"), js.trim("s").alias("t"), js.parse_float("n").alias("p"), js.blank(F.lit(" \n")).alias("b")).first()
    assert (row.r, row.t, row.p, row.b) == (-2, "x", 12.5, True)


def test_property_order(spark):
    schema = "express_id int, model_id string, pos int, ifc_type string, name string, long_name string, description string, object_type string, storey string, material string, global_id string, host_id string, n_meshes int, layers array<struct<width:string>>, psets map<string,map<string,string>>, quantities map<string,string>"
    row = (1, "M", 1, "IfcWall", "Wall 12.5mm", None, None, None, None, None, None, None, None, None, {"Pset_WallCommon": {"FireRating": "60"}, "Z": {"firerating": "90", "ISEXTERNAL": ""}}, {"Width": "0.2"})
    e = spark.createDataFrame([row], schema)
    values = quality.bim_values(e).first()
    assert values.v_fireRating == "60" and values.v_isExternal == "" and values.v_loadBearing is None
    hits = {r.check: r.detail for r in quality.bim_hits(e).collect()}
    assert hits["thicknessMismatch"] == "Name says 5mm, actual 200mm" and "noIsExternal" not in hits


def test_text(spark):
    row = spark.range(1).select(
        text.redact(F.lit("see a@b.co in C:\\x\\y and /usr/lib/z or plan.IFC for Tower"), ["Tower"]).alias("a"), text.reduce_type(F.lit("HEB 200x100 steel beam")).alias("b"),
        text.clash_title(F.lit("IfcWall"), F.lit("IfcPipeSegment"), F.lit(True)).alias("c"), text.distance_mm(F.lit("hard"), F.lit(-0.0256)).alias("d"), text.distance_mm(F.lit("hard"), F.lit(0.1)).alias("e"),
        text.pixels_per_metre(F.lit("1:50")).alias("f"), text.measure_label(F.lit(0.25)).alias("g"), text.length_mm(F.lit("about 2.5 cm")).alias("h"), (text.version_key(F.lit("v1.10.0")) > text.version_key(F.lit("1.9.9"))).alias("i"),
    ).first()
    assert row.a == "see [email] in [path] and [path] or [file] for MODEL_A"
    assert (row.b, row.c, row.d, row.e, row.f, row.g, row.h, row.i) == ("HEB beam 200x100", "Wall × Pipe Segment (self)", -26, -1, 200, "250 mm", 25.0, True)


def test_formats(spark, tmp_path):
    issues = spark.createDataFrame([("i1", 'A <b> & "c"', "open", "high", None), ("i2", "two", "closed", "low", "d")], "id string, title string, status string, priority string, description string")

    rules = formats.ids_rules(formats.ids_xml(formats.ids_specs(spark), "T & U", "2024-01-01")).collect()
    assert len(rules) == 23 and rules[0].title == "T & U" and {r.name for r in rules} >= {"GlobalId required", "IsExternal on walls"}

    formats.write_project({"issues": issues.drop("description"), "none": issues.limit(0), "clashes": issues.select("id").withColumn("snapshot", F.lit("x"))}, f"{tmp_path}/p", "2024-01-01", "ma\"rk")
    back = formats.read_project(spark, f"{tmp_path}/p", 'ma"rk')
    assert {r.title for r in formats.project_section(back, "issues").collect()} == {'A <b> & "c"', "two"} and formats.project_section(back, "clashes").columns == ["id"]
    (part,) = (tmp_path / "p").glob("part-*")
    document = json.loads(part.read_text())
    assert (document["_v"], document["savedAt"], document["none"], len(document["clashes"])) == (1, "2024-01-01", [], 2)
    formats.write_project({"only": issues.limit(0)}, f"{tmp_path}/q", "", "m")
    assert json.loads(next((tmp_path / "q").glob("part-*")).read_text())["only"] == []
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.json").write_text('{"_cc": "no"}')
    assert formats.read_project(spark, f"{tmp_path}/other", "mark").count() == 0

    mesh = spark.createDataFrame([(1, base64.b64encode(struct.pack("<9f", *range(9))).decode(), None), (2, None, None)], "id bigint, positions string, indices string")
    assert [r.asDict() for r in formats.decode_meshes(mesh).select("id", "x0", "z2").collect()] == [{"id": 1, "x0": 0.0, "z2": 8.0}]


def test_ids_rules_with_gaps(spark):
    """A specification without entity or base name shifts none after it; prefixes and empty elements are read."""
    xml = """<x:ids xmlns:x="u"><x:info><x:title>T</x:title></x:info><x:specifications>
<x:specification name="one"><x:applicability/><x:requirements><x:material/><x:attribute><x:name><x:simpleValue>Tag &amp; a</x:simpleValue></x:name></x:attribute></x:requirements></x:specification>
<x:specification><x:applicability><x:entity><x:name><x:simpleValue>IFCWALL</x:simpleValue></x:name></x:entity></x:applicability>
<x:requirements><x:property><x:propertySet><x:simpleValue>P</x:simpleValue></x:propertySet></x:property><x:property><x:propertySet><x:simpleValue>Q</x:simpleValue></x:propertySet><x:baseName><x:simpleValue>b</x:simpleValue></x:baseName></x:property>
<x:partOf><x:entity><x:name><x:simpleValue>IFCSITE</x:simpleValue></x:name></x:entity></x:partOf></x:requirements></x:specification>
<x:specification name="bare"/><x:specification name="last"></x:specification></x:specifications></x:ids>"""
    docs = spark.createDataFrame([(xml,), ("<ids/>",), (None,)], "value string")
    got = [tuple(r) for r in formats.ids_rules(docs).collect()]
    assert got == [
        ("T", "one", "*", ["attribute: Tag & a", "material"]),
        ("T", "Unnamed", "IFCWALL", ["property: P.*", "property: Q.b", "partOf: IFCSITE"]),
        ("T", "bare", "*", []),
        ("T", "last", "*", []),
    ]


def test_list_titles_and_lone_model(spark):
    clashes = spark.createDataFrame([(1, "open", None, "hard", 3, "", "by model"), (2, None, "high", "soft", 4, None, None), (3, "open", "low", "hard", 5, "own", "by model")], "id int, status string, priority string, type string, distance_mm int, title string, ai_title string")
    assert [r.title for r in review.clash_list(clashes).collect()] == ["by model", "Clash 2", "own"]
    models = spark.createDataFrame([("M0", 0, "West")], "model_id string, pos int, name string")
    assert review.fuzzy(models, "east", lone=True).count() == 1 and review.fuzzy(models, "east").count() == 0


def test_command_phrases():
    said = {
        "exclude duplicates": {"intent": "set_duplicates", "off": "exclude"}, "import the bcf file": {"intent": "import_bcf"}, "open a model": {"intent": "load_model"},
        "create project tower a": {"intent": "create_project", "name": "tower a"}, "rename project to bar": {"intent": "rename_project", "name": "bar"},
        "resolve all duplicates": {"intent": "batch_update", "action": "resolve", "filter": "duplicates"}, "show critical": {"intent": "filter_priority", "priority": "critical"},
        "analyze the patterns": {"intent": "analyze_clashes"}, "save viewpoint": {"intent": "save_viewpoint"}, "stop measuring": {"intent": "measure", "mode": "stop"},
        "section along y": {"intent": "set_section", "axis": "y"}, "color by storey": {"intent": "color_by", "by": "storey"}, "dark mode": {"intent": "set_theme", "theme": "dark"},
        "wireframe": {"intent": "set_render_style", "style": "wireframe"}, "hide grid": {"intent": "set_visibility_option", "do": "hide", "option": "grid"},
        "unhide all": {"intent": "restore_visibility"}, "go to issues": {"intent": "navigate_tab", "tab": "issues"}, "top view": {"intent": "set_view", "view": "top"}, "hello": {"intent": "help"},
    }
    assert {s: tools.read_command(s) for s in said} == said


def test_tools(spark):
    clashes = spark.createDataFrame([(1, "open", "high"), (2, "closed", "low")], "id bigint, status string, priority string")
    state = {"clashes": clashes}
    after = tools.call(state, "batch_update_clashes", ids=[1], status="resolved")["clashes"]
    assert {r.id: r.status for r in after.collect()} == {1: "resolved", 2: "closed"}
    assert [r.id for r in tools.call(state, "send_nl_command", text="show closed clashes").collect()] == [2]
    assert tools.read_command("run hard clashes only between structural and mep") == {"intent": "run_detection", "hard": True, "maxGap": 0.0, "duplicates": False, "modelA": "structural", "modelB": "mep"}
    assert tools.read_command("near misses within 75 mm, check pipes against beams")["maxGap"] == 75.0
    assert len(tools.manifest()) == len(tools.TOOLS) == 35


def test_streamed_rate_limit(spark, tmp_path):
    rows = [("a", t) for t in (0, 10, 20, 60_001, 60_002)] + [("b", 5)]
    spark.createDataFrame(rows, "ip string, ts_ms bigint").coalesce(1).write.parquet(f"{tmp_path}/requests.parquet")
    stream = spark.readStream.schema("ip string, ts_ms bigint").parquet(f"{tmp_path}/requests.parquet")
    got = []
    jobs.run_to_end(jobs.rate_limit_stream(stream, 2), lambda df, _: got.extend(df.collect()))
    assert sorted((r.ip, r.ts_ms) for r in got if r.rejected) == [("a", 20)]
    plain = merge.rate_limited(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "ip string, ts_ms bigint, pos bigint"), 2)
    assert sorted((r.ip, r.ts_ms) for r in plain.collect() if r.rejected) == [("a", 20)]


def test_stream_assembly(spark, tmp_path):
    rows = [("m", "model-start", 0), ("m", "element-batch", 5), ("m", "element-batch", 2), ("m", "model-end", 0), ("n", "element-batch", 1), ("n", "error", 0)]
    schema = "model_id string, ts timestamp, pos int, kind string, n int"
    spark.createDataFrame([(m, datetime(2024, 1, 1), p, k, n) for p, (m, k, n) in enumerate(rows)], schema).coalesce(1).write.parquet(f"{tmp_path}/x")
    got = []
    jobs.run_to_end(jobs.assembly_progress(spark.readStream.schema(schema).parquet(f"{tmp_path}/x")), lambda df, _: got.extend(df.collect()), "update")
    assert {(r.model_id, r.received, r.status) for r in got} == {("m", 7, "complete"), ("n", 1, "partial")}

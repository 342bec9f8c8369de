"""Issue archives: both versions, foreign files, failures of tasks, and components."""

import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from coordspark.sources import bcf

ISSUES = (
    "id string, title string, status string, priority string, description string, type string, assignee string, author string, created_at timestamp, labels array<string>, revit_a bigint, revit_b bigint, "
    f"camera {bcf.CAMERA}, components array<string>"
)
CAMERA = ((1.5, -2.0, 3.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), 45.0)
FULL = ("i1", 'A <b> & "c"', "open", "high", "line\none", "Clash & more", "A", "B", datetime(2024, 5, 6, 7, 8, 9), ["x & y", "<z>"], 12, 345678901234, CAMERA, ["G'1", "G2", "G'1"])
BARE = ("i2", None, None, None, None, None, None, None, None, None, None, None, None, None)


@pytest.mark.parametrize("version", bcf.VERSIONS)
def test_round_trip(spark, tmp_path, version):
    bcf.write_archives(spark.createDataFrame([FULL, BARE], ISSUES).coalesce(1), f"file://{tmp_path}/out", version)
    rows = {r.title: r for r in bcf.read_archives(spark, f"file://{tmp_path}/out", topics_a_task=1).collect()}
    full, bare = rows['A <b> & "c"'], rows[None]
    assert (full.version, full.type, full.status, full.priority, full.description, full.assignee, full.author, full.created_at) == (version, "Clash & more", "open", "high", "line\none", "A", "B", datetime(2024, 5, 6, 7, 8, 9))
    assert (full.labels, full.revit_a, full.revit_b, full.components) == (["x & y", "<z>"], 12, 345678901234, ["G'1", "G2"])
    assert tuple(tuple(p) if isinstance(p, tuple) else p for p in full.camera) == CAMERA
    assert (bare.status, bare.labels, bare.revit_a, bare.components, bare.camera, bare.created_at) == (None, [], None, [], None, None)
    (name,) = (tmp_path / "out").glob("*.bcfzip")
    inside = zipfile.ZipFile(name).namelist()
    assert "bcf.version" in inside and ("extensions.xml" in inside) == (version == "3.0") and sum(n.endswith(".bcfv") for n in inside) == 1
    with pytest.raises(ValueError, match="4.0"):
        bcf.topic_documents(spark.createDataFrame([BARE], ISSUES), "4.0")


def test_append_overwrite_and_failed_tasks(spark, tmp_path):
    path, issues = f"file://{tmp_path}/out", spark.createDataFrame([(f"i{k}", f"t{k}") for k in range(40)], "id string, title string").withColumns({c: F.lit("x") for c in ("status", "priority", "description")})
    titles = lambda: sorted(r.title for r in bcf.read_archives(spark, path).select("title").collect())
    bcf.write_archives(issues.where("id < 'i2'").repartition(3), path)
    bcf.write_archives(issues.where("id >= 'i2'").repartition(2), path)
    assert titles() == sorted(f"t{k}" for k in range(40))
    broken = issues.repartition(4).withColumn("title", F.when(F.col("id") == "i7", F.raise_error(F.lit("broken row"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="broken row"):
        bcf.write_archives(broken, path)
    assert titles() == sorted(f"t{k}" for k in range(40))  # nothing of the failed run is read
    bcf.write_archives(issues.where("id = 'i3'").repartition(2), path, mode="overwrite")
    assert titles() == ["t3"] and [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith(".")] == []
    bcf.write_archives(issues.limit(0), f"file://{tmp_path}/none")
    assert bcf.read_archives(spark, f"file://{tmp_path}/none").collect() == []


def test_archives_of_other_programs(spark, tmp_path):
    """Prefixes, a byte-order mark, several viewpoints with names of their own, an orthogonal camera, files besides."""
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "a.bcf", "w") as z:
        z.writestr("t1/markup.bcf", '﻿<?xml version="1.0"?><Markup xmlns="urn:x"><Header/><Topic Guid="t1" TopicType="Issue"><Title>One</Title><Labels>cc:revitA:7</Labels><Labels>keep</Labels></Topic><Comment Guid="c"><Comment>hello</Comment></Comment><Viewpoints Guid="b"><Viewpoint>second.bcfv</Viewpoint></Viewpoints><Viewpoints Guid="a"><Viewpoint>first.bcfv</Viewpoint></Viewpoints></Markup>')
        point = lambda n, x: f"<{n}><X>{x}</X><Y>0</Y><Z>1e1</Z></{n}>"
        camera = "".join(point(n, k) for k, n in enumerate(("CameraViewPoint", "CameraDirection", "CameraUpVector")))
        z.writestr("t1/first.bcfv", f'<VisualizationInfo Guid="a"><Components><Selection><Component IfcGuid="G1"/></Selection></Components><PerspectiveCamera>{camera}<FieldOfView>60</FieldOfView></PerspectiveCamera></VisualizationInfo>')
        z.writestr("t1/second.bcfv", f'<VisualizationInfo Guid="b"><Components><Selection><Component IfcGuid="G2"><OriginatingSystem>s</OriginatingSystem></Component><Component IfcGuid="G1"/></Selection></Components><OrthogonalCamera>{camera}<ViewToWorldScale>2</ViewToWorldScale></OrthogonalCamera></VisualizationInfo>')
        z.writestr("t1/snapshot.png", b"x")
        z.writestr("notes.txt", b"x")
    (row,) = bcf.read_archives(spark, f"file://{tmp_path}/in").collect()
    assert (row.topic, row.version, row.title, row.type, row.status, row.labels, row.revit_a, row.revit_b) == ("t1", None, "One", "Issue", None, ["keep"], 7, None)
    assert sorted(row.components) == ["G1", "G2"] and row.camera.eye.z == 10.0 and row.camera.up.x == 2.0 and row.camera.field_of_view is None  # the second, which the markup names first
    elements = spark.createDataFrame([("G2", "M", 5), ("G3", "M", 6)], "global_id string, model_id string, express_id bigint")
    (found,) = bcf.resolve_components(bcf.read_archives(spark, f"file://{tmp_path}/in"), elements).collect()
    assert [tuple(e) for e in found.elements] == [("M", 5)]


def test_a_directory_is_read_once_and_archives_are_bounded(spark, tmp_path, monkeypatch):
    """Runs of topics are read by the places of their members, without the archive's directory; a task writes several archives."""
    issues = spark.createDataFrame([(f"i{k}", f"t{k}") for k in range(50)], "id string, title string").withColumns({c: F.lit("x") for c in ("status", "priority", "description")}).withColumn("components", F.array(F.lit("G1")))
    monkeypatch.setattr(bcf, "TOPICS_AN_ARCHIVE", 20)
    writer, rows = bcf.ArchiveWriter(f"file://{tmp_path}/out", "3.0", False), bcf.topic_documents(issues, "3.0").collect()
    writer.commit([writer.write(iter(rows)), writer.write(iter([]))])
    files = sorted((tmp_path / "out").iterdir())
    assert sorted(sum(n.endswith("markup.bcf") for n in zipfile.ZipFile(p).namelist()) for p in files) == [10, 20, 20]
    found = bcf.read_archives(spark, f"file://{tmp_path}/out", topics_a_task=3).select("title", "components").collect()
    assert sorted(r.title for r in found) == sorted(f"t{k}" for k in range(50)) and all(r.components == ["G1"] for r in found)
    with zipfile.ZipFile(files[0]) as z:
        at = next(i for i in z.infolist() if i.filename.endswith("markup.bcf")).header_offset
    broken = bytearray(files[0].read_bytes())
    broken[at + 80] ^= 0xFF
    files[0].write_bytes(bytes(broken))
    with pytest.raises(Exception, match="BadZipFile|zlib|Error"):
        bcf.read_archives(spark, f"file://{tmp_path}/out").collect()


def test_archives_are_read_once_for_their_components(spark, tmp_path):
    """What is resolved lies stored: the archives are not read for the topics and again for their parts."""
    bcf.write_archives(spark.createDataFrame([FULL, BARE], ISSUES), f"file://{tmp_path}/out")
    found = bcf.resolve_components(bcf.read_archives(spark, f"file://{tmp_path}/out"), spark.createDataFrame([("G2", "M", 5)], "global_id string, model_id string, express_id bigint"))
    assert {r.title: [tuple(e) for e in r.elements] for r in found.collect()} == {FULL[1]: [("M", 5)], None: []}
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()

"""Issue archives (BCF 2.1 and 3.0): topics with labels and viewpoints, written by tasks and committed by the driver, and read member by member.

Writing: ``topic_documents`` makes the XML of each topic in column expressions; the sink ``issue-archive`` lets every task write one
archive under a name that readers pass over, and gives the archives their names only when all tasks have succeeded. A task
that fails, or is run twice, leaves nothing that is read.

Reading: each archive's directory is read once, then its members are dealt out by their places, so a large archive is read by
many tasks, each through a seekable stream; no archive is held whole. The XML is parsed with schemas, and components are
resolved to elements by joins on their global ids.
"""

from __future__ import annotations

import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from coordspark.functions.text import xml_escape
from coordspark.sources.scratch import save

VERSIONS = ("2.1", "3.0")
#: Topics of an archive that one task reads.
TOPICS_A_TASK = 2000
#: Topics of a written archive: its directory is held in memory until it is closed.
TOPICS_AN_ARCHIVE = 50_000
#: Bytes that are gathered before they are written: members are small.
WRITE_BYTES = 1 << 20
# The labels that carry the ids of a clash's two elements in the authoring tool.
REVIT_LABELS = {"revit_a": "cc:revitA:", "revit_b": "cc:revitB:"}

_AXES = ("x", "y", "z")
CAMERA = "struct<" + ",".join(f"{p}:struct<x:double,y:double,z:double>" for p in ("eye", "direction", "up")) + ",field_of_view:double>"


def _tag(name: str, value: Column) -> Column:
    """An element with text, nothing if the text is null."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), xml_escape(value), F.lit(f"</{name}>"))).otherwise("")


def _guid(*parts: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", *parts), 256)
    return F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def topic_id(key: Column) -> Column:
    """The topic of an issue with this id."""
    return _guid(key)


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def topic_documents(issues: DataFrame, version: str = "2.1") -> DataFrame:
    """topic, markup, viewpoint (null without camera and components) of issues: id, title, status, priority, description and, where
    there are such columns, type, assignee, author, created_at, labels (array), revit_a, revit_b, camera (``CAMERA``), components (array of global ids)."""
    if version not in VERSIONS:
        raise ValueError(f"version {version} is none of {', '.join(VERSIONS)}")
    third = version == "3.0"
    given = lambda name, kind="string": _optional(issues, name, kind)
    revit = F.array(*(F.concat(F.lit(mark), given(c)) for c, mark in REVIT_LABELS.items()))
    labels = F.filter(F.concat(F.coalesce(given("labels", "array<string>"), F.array().cast("array<string>")), revit), lambda x: x.isNotNull())
    rows = issues.select(
        "id", topic_id(F.col("id").cast("string")).alias("topic"), _guid(F.lit("viewpoint"), F.col("id").cast("string")).alias("view"), "title", "status", "priority", "description", labels.alias("labels"),
        F.coalesce(given("type"), F.lit("Clash")).alias("type"), given("assignee").alias("assignee"), given("author").alias("author"),
        F.date_format(given("created_at", "timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"), given("camera", CAMERA).alias("camera"), given("components", "array<string>").alias("components"),
    )
    seen = F.col("camera").isNotNull() | (F.size("components") > 0)
    listed = F.array_join(F.transform("labels", lambda x: F.concat(F.lit("<Label>" if third else "<Labels>"), xml_escape(x), F.lit("</Label>" if third else "</Labels>"))), "")
    listed = F.when(F.size("labels") > 0, F.concat(F.lit("<Labels>"), listed, F.lit("</Labels>")) if third else listed).otherwise("")
    one = F.concat(F.lit('<ViewPoint Guid="' if third else '<Viewpoints Guid="'), F.col("view"), F.lit('"><Viewpoint>viewpoint.bcfv</Viewpoint>' + ("</ViewPoint>" if third else "</Viewpoints>")))
    views = F.when(seen, F.concat(F.lit("<Viewpoints>"), one, F.lit("</Viewpoints>")) if third else one).otherwise("")
    attribute = lambda c: F.coalesce(xml_escape(F.col(c)), F.lit(""))
    body = F.concat(
        _tag("Title", F.col("title")), _tag("Priority", F.col("priority")), listed, _tag("CreationDate", F.col("created")), _tag("CreationAuthor", F.col("author")), _tag("AssignedTo", F.col("assignee")), _tag("Description", F.col("description")),
        views if third else F.lit(""),
    )
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<Markup><Topic Guid="'), F.col("topic"), F.lit('" TopicType="'), attribute("type"), F.lit('" TopicStatus="'), attribute("status"), F.lit('">'))
    markup = F.concat(head, body, F.lit("</Topic>"), F.lit("") if third else views, F.lit("</Markup>"))
    point = lambda name, p: F.concat(F.lit(f"<{name}>"), *(F.concat(F.lit(f"<{a.upper()}>"), F.col(f"camera.{p}.{a}").cast("string"), F.lit(f"</{a.upper()}>")) for a in _AXES), F.lit(f"</{name}>"))
    parts = F.array_join(F.transform("components", lambda g: F.concat(F.lit('<Component IfcGuid="'), xml_escape(g), F.lit('"/>'))), "")
    components = F.when(F.size("components") > 0, F.concat(F.lit("<Components><Selection>"), parts, F.lit('</Selection><Visibility DefaultVisibility="true"/></Components>'))).otherwise("")
    angle = F.coalesce(F.col("camera.field_of_view"), F.lit(60.0)).cast("string")
    camera = F.concat(F.lit("<PerspectiveCamera>"), point("CameraViewPoint", "eye"), point("CameraDirection", "direction"), point("CameraUpVector", "up"), F.lit("<FieldOfView>"), angle, F.lit("</FieldOfView>" + "<AspectRatio>1</AspectRatio>" * third + "</PerspectiveCamera>"))
    view = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<VisualizationInfo Guid="'), F.col("view"), F.lit('">'), components, F.coalesce(camera, F.lit("")), F.lit("</VisualizationInfo>"))
    return rows.select("topic", markup.alias("markup"), F.when(seen, view).alias("viewpoint"))


# --- the sink


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str, version: str, overwrite: bool):
        self.path, self.version, self.overwrite = path.rstrip("/"), version, overwrite

    def write(self, iterator: Iterator) -> Written:
        """Archives of a task, streamed, each of up to ``TOPICS_AN_ARCHIVE`` topics; their names begin with a dot until they are committed."""
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        names, rows = [], iter(iterator)
        row = next(rows, None)
        while row is not None:
            names.append(f"{uuid.uuid4().hex}.bcfzip")
            n = 0
            with store.open_output_stream(f"{base}/.{names[-1]}", buffer_size=WRITE_BYTES) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as archive:
                detail = "" if self.version == "3.0" else f"<DetailedVersion>{self.version}</DetailedVersion>"
                archive.writestr("bcf.version", f'<?xml version="1.0" encoding="UTF-8"?>\n<Version VersionId="{self.version}">{detail}</Version>')
                if self.version == "3.0":
                    archive.writestr("extensions.xml", '<?xml version="1.0" encoding="UTF-8"?>\n<Extensions/>')
                while row is not None and n < TOPICS_AN_ARCHIVE:
                    archive.writestr(f"{row.topic}/markup.bcf", row.markup)
                    if row.viewpoint is not None:
                        archive.writestr(f"{row.topic}/viewpoint.bcfv", row.viewpoint)
                    n, row = n + 1, next(rows, None)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        kept = [name for m in messages if m is not None for name in m.names]
        if self.overwrite:
            new = set(kept)
            for f in store.get_file_info(fs.FileSelector(base)):
                if f.base_name.endswith(".bcfzip") and f.base_name[1:] not in new:
                    store.delete_file(f.path)
        for name in kept:
            store.move(f"{base}/.{name}", f"{base}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        """What successful tasks have written goes; what failed ones left has names that are never read, and the next overwrite clears it."""
        store, base = _store(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            if store.get_file_info(f"{base}/.{name}").type != fs.FileType.NotFound:
                store.delete_file(f"{base}/.{name}")


class ArchiveSource(DataSource):
    """``df.write.format("issue-archive")``: rows of topic, markup and viewpoint to archives. Options: path, version."""

    @classmethod
    def name(cls) -> str:
        return "issue-archive"

    def schema(self) -> str:
        return "topic string, markup string, viewpoint string"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self.options.get("version", "2.1"), overwrite)


def write_archives(issues: DataFrame, path: str, version: str = "2.1", mode: str = "append") -> None:
    """Write issues (see ``topic_documents``) to archives below ``path``, of up to ``TOPICS_AN_ARCHIVE`` topics."""
    issues.sparkSession.dataSource.register(ArchiveSource)
    topic_documents(issues, version).write.format("issue-archive").option("path", path).option("version", version).mode(mode).save()


# --- reading

_POINT = "struct<X:double,Y:double,Z:double>"
MARKUP = (
    "struct<Topic:struct<_Guid:string,_TopicType:string,_TopicStatus:string,Title:string,Priority:string,Labels:array<struct<_VALUE:string,Label:array<string>>>,CreationDate:string,CreationAuthor:string,"
    "AssignedTo:string,Description:string,Viewpoints:struct<ViewPoint:array<struct<_Guid:string,Viewpoint:string>>>>,Viewpoints:array<struct<_Guid:string,Viewpoint:string>>>"
)
VIEWPOINT = (
    "struct<_Guid:string,Components:struct<Selection:struct<Component:array<struct<_IfcGuid:string,_VALUE:string>>>>,"
    f"PerspectiveCamera:struct<CameraViewPoint:{_POINT},CameraDirection:{_POINT},CameraUpVector:{_POINT},FieldOfView:double>,"
    f"OrthogonalCamera:struct<CameraViewPoint:{_POINT},CameraDirection:{_POINT},CameraUpVector:{_POINT},ViewToWorldScale:double>>"
)


def members(spark: SparkSession, path: str, topics_a_task: int = TOPICS_A_TASK) -> DataFrame:
    """archive, topic, version, markup, viewpoints (file name -> text) of the topics of all archives of ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!.]*.bcf*").load(path).select("path")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """archive, version and runs of topics with the places of their members, from the directory at the archive's end."""
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, name = _store(uri)
                topics: dict[str, list[tuple]] = {}
                with store.open_input_file(name) as f, zipfile.ZipFile(f) as archive:
                    inside = archive.infolist()
                    found = re.search(r'VersionId="([^"]*)"', archive.read("bcf.version").decode()) if "bcf.version" in archive.NameToInfo else None
                for i in inside:
                    if i.filename.endswith(("/markup.bcf", ".bcfv")) and "/" in i.filename:
                        topic, file = i.filename.rsplit("/", 1)
                        topics.setdefault(topic, []).append((file, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC, i.flag_bits))
                names = sorted(t for t, files in topics.items() if any(x[0] == "markup.bcf" for x in files))
                for k in range(0, len(names), topics_a_task):
                    run = names[k : k + topics_a_task]
                    # flat columns: nested rows would cost more than the members themselves
                    places = list(zip(*(x for t in run for x in sorted(topics[t])), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([uri], pa.string()), pa.array([found[1] if found else None], pa.string()), pa.array([run], pa.list_(pa.string())), *(pa.array([column], pa.list_(kind)) for column, kind in zip(([len(topics[t]) for t in run], *places), (pa.int32(), *_MEMBER.values()), strict=True))], _RUN)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, version, topics, counts, *places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = _store(uri)
                out, members = [], zip(*places, strict=True)
                with store.open_input_file(name) as f:
                    for topic, n in zip(topics, counts, strict=True):
                        texts = {file: _member(f, f"{uri}: {topic}/{file}", *place).decode("utf-8-sig") for file, *place in islice(members, n)}
                        out.append((uri, topic, version, texts.pop("markup.bcf"), list(texts.items())))
                types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["archive", "topic", "version", "markup", "viewpoints"])

    kinds = ", ".join(f"{c} array<{'string' if kind == pa.string() else 'int' if kind == pa.int32() else 'bigint'}>" for c, kind in _MEMBER.items())
    runs = files.repartition("path").mapInArrow(listed, f"archive string, version string, topics array<string>, files array<int>, {kinds}")
    dealt = runs.repartition(F.xxhash64("archive", F.col("topics")[0]))
    return dealt.mapInArrow(read, "archive string, topic string, version string, markup string, viewpoints map<string,string>")


#: Where a member lies: what ``_member`` takes, after its file name. A run of topics has a list of each, with as many places a topic as it has files.
_MEMBER = {"file": pa.string(), "at": pa.int64(), "packed": pa.int64(), "size": pa.int64(), "method": pa.int32(), "crc": pa.int64(), "flags": pa.int32()}
_RUN = ["archive", "version", "topics", "files", *_MEMBER]


def _member(f, name: str, at: int, packed: int, size: int, method: int, crc: int, flags: int) -> bytes:
    """A member by its place in the directory: its own header, then its bytes, checked."""
    head = f.read_at(30, at)
    if len(head) < 30 or head[:4] != b"PK\x03\x04" or flags & 1 or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise zipfile.BadZipFile(f"{name}: broken, encrypted or packed in an unknown way")
    raw = f.read_at(packed, at + 30 + sum(struct.unpack("<2H", head[26:30])))
    out = zlib.decompress(raw, -zlib.MAX_WBITS) if method == zipfile.ZIP_DEFLATED else raw
    if len(out) != size or zlib.crc32(out) != crc:
        raise zipfile.BadZipFile(f"{name}: bytes that do not match the directory")
    return out


def read_archives(spark: SparkSession, path: str, topics_a_task: int = TOPICS_A_TASK) -> DataFrame:
    """topic, version, title, type, status, priority, description, assignee, author, created_at, labels, revit_a, revit_b, components, camera of archives of either version.

    A topic's first viewpoint (the one that its markup names first, else by name) gives the camera; the components of all of
    them are listed once. Labels that carry ids are taken out of ``labels``. Spaces around texts are not kept.
    """
    xml = lambda c, schema, tag: F.from_xml(c, schema, {"rowTag": tag, "mode": "PERMISSIVE", "ignoreNamespace": "true"})
    rows = members(spark, path, topics_a_task).withColumn("m", xml(F.col("markup"), MARKUP, "Markup"))
    topic = F.col("m.Topic")
    labels = F.flatten(F.transform(F.coalesce(topic["Labels"], F.array().cast("array<struct<_VALUE:string,Label:array<string>>>")), lambda x: F.coalesce(x["Label"], F.array(x["_VALUE"]))))
    named = F.coalesce(topic["Viewpoints"]["ViewPoint"], F.col("m.Viewpoints"))
    first = F.coalesce(F.try_element_at("viewpoints", F.try_element_at(named, F.lit(1))["Viewpoint"]), F.try_element_at(F.map_values("viewpoints"), F.lit(1)))
    rows = rows.withColumns({"labels": F.filter(labels, lambda x: x.isNotNull()), "shown": xml(first, VIEWPOINT, "VisualizationInfo"), "all": F.array_join(F.map_values("viewpoints"), "\n")})
    # components of every viewpoint: their ids stand in attributes
    named_in = lambda quote: F.regexp_extract_all("all", F.lit(rf"<(?:\w+:)?Component\b[^>]*?\bIfcGuid\s*=\s*{quote}([^{quote}]*){quote}"), F.lit(1))
    guids = F.array_distinct(F.concat(named_in('"'), named_in("'")))
    point = lambda p: F.coalesce(F.col(f"shown.PerspectiveCamera.{p}"), F.col(f"shown.OrthogonalCamera.{p}"))
    as_point = lambda p: F.struct(*(point(p)[a.upper()].alias(a) for a in _AXES))
    camera = F.struct(as_point("CameraViewPoint").alias("eye"), as_point("CameraDirection").alias("direction"), as_point("CameraUpVector").alias("up"), F.col("shown.PerspectiveCamera.FieldOfView").alias("field_of_view"))
    carried = lambda mark: F.try_element_at(F.filter("labels", lambda x: x.startswith(mark)), F.lit(1))
    plain = F.filter("labels", lambda x: ~(x.startswith(REVIT_LABELS["revit_a"]) | x.startswith(REVIT_LABELS["revit_b"])))
    blank = lambda c: F.nullif(c, F.lit(""))
    return rows.select(
        "topic", "version", topic["Title"].alias("title"), blank(topic["_TopicType"]).alias("type"), blank(topic["_TopicStatus"]).alias("status"), topic["Priority"].alias("priority"), topic["Description"].alias("description"),
        topic["AssignedTo"].alias("assignee"), topic["CreationAuthor"].alias("author"), F.try_to_timestamp(topic["CreationDate"]).alias("created_at"), plain.alias("labels"),
        *(F.substring(carried(mark), len(mark) + 1, 1000).try_cast("bigint").alias(c) for c, mark in REVIT_LABELS.items()), guids.alias("components"), F.when(point("CameraViewPoint").isNotNull(), camera).alias("camera"),
    )


def resolve_components(topics: DataFrame, elements: DataFrame) -> DataFrame:
    """topics with elements: model_id and express_id of the elements that the components' global ids stand for, in their order; unknown ones are left out."""
    topics = save(topics, "topics")  # read from the archives once, for the join and for its parts
    # a plan's sizes are those before a topic becomes a row for each component: by them, either join would broadcast what grows
    parts = topics.select("topic", F.posexplode("components").alias("pos", "global_id")).hint("merge")
    found = parts.join(elements.select("global_id", "model_id", "express_id"), "global_id")
    listed = found.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("pos", "model_id", "express_id"))).alias("x"))
    members_of = F.transform("x", lambda e: F.struct(e["model_id"].alias("model_id"), e["express_id"].alias("express_id")))
    empty = F.array().cast("array<struct<model_id:string,express_id:bigint>>")
    return topics.hint("merge").join(listed.select("topic", members_of.alias("elements")), "topic", "left").withColumn("elements", F.coalesce("elements", empty))

"""Readers and writers: wire meshes, wire rows, project files, JSONL, IDS and issue archives."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.functions import text
from coordspark.operators.quality import COMMON_PSET
from coordspark.sources.scratch import new_path

# Types that are dropped or lose their meshes at load, and the header of exported labels.
EXCLUDED_TYPES = ["IfcOpeningElement"]
MESHLESS_TYPES = ["IfcSpace", "IfcVirtualElement", "IfcAnnotation", "IfcGrid"]
CLASH_HEADER = (
    "# type_pair,disc_pair,same_storey,same_model,overlap_vol_m3,pen_depth_mm,clearance_mm,bbox_a_dx,bbox_a_dy,bbox_a_dz,bbox_b_dx,bbox_b_dy,bbox_b_dz,"
    "mat_a,mat_b,storey,max_gap_mm,label,label_source,synthetic"
)


#: Triangles that decoded meshes are given on in, at least, where there are as many.
TRIANGLES_A_BATCH = 20_000


def loadable(elements: DataFrame) -> DataFrame:
    """Openings are dropped; spaces and the like keep their row but lose their meshes."""
    kept = elements.where(~F.coalesce(F.col("ifc_type").isin(EXCLUDED_TYPES), F.lit(False)))
    return kept.withColumn("meshes", F.when(F.col("ifc_type").isin(MESHLESS_TYPES), F.array().cast(kept.schema["meshes"].dataType)).otherwise(F.col("meshes")))


_CORNERS = [f"{a}{i}" for i in range(3) for a in "xyz"]


def _together(found: list[tuple]) -> pa.RecordBatch:
    keys, meshes = zip(*found, strict=True)
    counts = [len(m) for m in meshes]
    tris, places = np.concatenate(meshes), np.concatenate([np.arange(n, dtype="<i4") for n in counts])
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()).take(pa.array(np.repeat(np.arange(len(keys)), counts))), pa.array(places), *(pa.array(tris[:, k].copy()) for k in range(9))], ["id", "tri_idx", *_CORNERS])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, n = [], 0
        for key, pos, idx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            points = np.frombuffer(pos or b"", dtype="<f4").reshape(-1, 3)
            at = np.frombuffer(idx, dtype="<u4") if idx is not None else np.arange(len(points))
            tris = points[at[: len(at) // 3 * 3]].reshape(-1, 9)
            if len(tris):
                found.append((key, tris))
                n += len(tris)
            if n >= TRIANGLES_A_BATCH:
                yield _together(found)
                found, n = [], 0
        if found:
            yield _together(found)


def decode_meshes(df: DataFrame) -> DataFrame:
    """id, positions (base64 f32) and indices (base64 u32) to triangles: id, tri_idx and corners x0 .. z2, in Arrow batches of many meshes."""
    schema = "id bigint, tri_idx int, " + ", ".join(f"{c} float" for c in _CORNERS)
    return df.select("id", F.unbase64("positions"), F.unbase64("indices")).mapInArrow(_decoded, schema)


def place_triangles(triangles: DataFrame, transforms: DataFrame) -> DataFrame:
    """Triangles of shared geometry (geometry_id) put into the world by each element's column-major 4x4 matrix."""
    joined = triangles.join(transforms.select("express_id", "geometry_id", "matrix"), "geometry_id")
    m = lambda i: F.col("matrix")[i]
    moved = {f"{a}{c}": m(r) * F.col(f"x{c}") + m(4 + r) * F.col(f"y{c}") + m(8 + r) * F.col(f"z{c}") + m(12 + r) for c in range(3) for r, a in enumerate("xyz")}
    return joined.select("express_id", "geometry_id", "tri_idx", *(v.alias(k) for k, v in moved.items()))


def normalise_wire(rows: DataFrame) -> DataFrame:
    """Wire rows (category, type, level, parameters, materials, ...) to elements."""
    return rows.select(
        "express_id", "global_id", F.coalesce(F.nullif("category", F.lit("")), F.lit("IfcBuildingElementProxy")).alias("ifc_type"), "name",
        F.col("type").alias("object_type"), F.col("level").alias("storey"), F.array_join("materials", ", ").alias("material"),
        F.coalesce("parameters", F.create_map().cast("map<string,map<string,string>>")).alias("psets"),
    )


#: Characters of a project document that are read at a time.
DOCUMENT_CHUNK = 1 << 20
_BLANKS = re.compile(r"[ \t\n\r]*")
#: Lines of one flat object each, as ``write_project`` makes them. A line break is never inside a JSON text, so the braces are the object's.
_FLAT_LINES = re.compile(r"(?:,\{[^{}\[\]\n]*\}\n)+")


def _document_parts(read: Callable[[int], str]) -> Iterator[tuple[str, bool, list[str]]]:
    """name, whether it is an array, and texts of the members of a JSON object: some of an array's at a time, so that no more than the longest is held.

    ``read`` gives the next characters, none at the end. Raises ValueError where the text is no JSON object.
    """
    decode, text, at, ended = json.JSONDecoder().raw_decode, "", 0, False

    def more() -> None:
        nonlocal text, at, ended
        got = read(max(DOCUMENT_CHUNK, len(text) - at))
        text, at, ended = text[at:] + got, 0, not got

    def ahead() -> str:
        nonlocal at
        while (at := _BLANKS.match(text, at).end()) == len(text):
            if ended:
                raise ValueError("the document ends early")
            more()
        return text[at]

    def take(*allowed: str) -> str:
        nonlocal at
        if (c := ahead()) not in allowed:
            raise ValueError(f"{c!r} instead of one of {allowed}")
        at += 1
        return c

    def value() -> str:
        nonlocal at
        ahead()
        while True:
            try:
                end = decode(text, at)[1]
                if end < len(text) or ended:  # a number may go on
                    found, at = text[at:end], end
                    return found
            except json.JSONDecodeError:
                if ended:
                    raise
            more()

    take("{")
    if ahead() == "}":
        return
    while True:
        name = json.loads(value())
        take(":")
        if ahead() != "[":
            yield name, False, [value()]
        else:
            take("[")
            if ahead() == "]":
                take("]")
            else:
                while True:
                    yield name, True, [value()]
                    ahead()
                    if lines := _FLAT_LINES.match(text, at):
                        at = lines.end()
                        yield name, True, [x[1:] for x in lines[0][:-1].split("\n")]
                    if take(",", "]") == "]":
                        break
        if take(",", "}") == "}":
            return


def _parts_of(uri: str) -> Iterator[tuple[str, bool, list[str]]]:
    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    decoder = codecs.getincrementaldecoder("utf-8-sig")()
    with store.open_input_file(path) as f:

        def read(n: int) -> str:
            while raw := f.read(n):
                if got := decoder.decode(raw):
                    return got
            return decoder.decode(b"", True)

        yield from _document_parts(read)


def _is_marked(uri: str, mark: str) -> bool:
    try:
        return next((json.loads(texts[0]) == mark for name, _, texts in _parts_of(uri) if name == "_cc"), False)
    except ValueError:
        return False


def read_project(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """section and value (JSON) of each row of the arrays of project files (one JSON document each, with ``mark`` as _cc); others are ignored.

    A document is one text by format: one task reads it, some characters at a time, and stores its rows for all tasks.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                if not _is_marked(uri, mark):
                    continue
                rows, n = [], 0
                for name, many, texts in _parts_of(uri):
                    if many:
                        rows.append((name, texts))
                        n += sum(map(len, texts))
                    if n >= DOCUMENT_CHUNK:
                        yield _section_rows(rows)
                        rows, n = [], 0
                if rows:
                    yield _section_rows(rows)

    schema, stored = "section string, value string", new_path(spark, "project-rows")
    files.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(sections, schema).write.parquet(stored)
    return spark.read.schema(schema).parquet(stored)


def _section_rows(rows: list[tuple[str, list[str]]]) -> pa.RecordBatch:
    names = [name for name, texts in rows for _ in texts]
    # line breaks are blanks in JSON
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([re.sub(r"[\r\n]", " ", x) for _, texts in rows for x in texts], pa.string())], ["section", "value"])


def project_section(project: DataFrame, section: str) -> DataFrame:
    """One array of the project files as rows; the fields are those of all of them."""
    path = new_path(project.sparkSession, "section")
    project.where(F.col("section") == section).select("value").write.option("compression", "gzip").text(path)
    return project.sparkSession.read.json(path)


def write_project(parts: dict[str, DataFrame], path: str, saved_at: str, mark: str, version: int = 1) -> None:
    """A project: one JSON document with an array for each section, snapshots left out.

    A document is one text by format, so one task writes it; rows are turned into JSON by all tasks, sorted by section (on
    disk if need be) and streamed into it line by line. Nothing is gathered, and the writer's commit leaves a whole file or none.
    """
    spark = next(iter(parts.values())).sparkSession
    rows = spark.range(1).select(F.lit(-1).alias("section"), F.lit(None).cast("string").alias("value"))  # so that there is a row to begin with
    for k, df in enumerate(parts.values()):
        kept = df.drop("snapshot")
        rows = rows.unionByName(kept.select(F.lit(k).alias("section"), F.to_json(F.struct(*kept.columns)).alias("value")))
    head, names = json.dumps({"_cc": mark, "_v": version, "savedAt": saved_at})[:-1], list(parts)

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = -1, True
        for batch in batches:
            lines = []
            for section, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if section < 0:
                    lines.append(head)
                    continue
                while at < section:
                    lines.append(("]" if at >= 0 else "") + f", {json.dumps(names[at + 1])}: [")
                    at, first = at + 1, True
                lines.append(value if first else "," + value)
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        rest = [("]" if k > 0 else "") + f", {json.dumps(names[k])}: [" for k in range(at + 1, len(names))]
        yield pa.RecordBatch.from_arrays([pa.array([*rest, "]}"], pa.string())], ["value"])

    rows.repartition(1).sortWithinPartitions("section").mapInArrow(document, "value string").write.mode("overwrite").text(path)


def labels_jsonl(records: DataFrame) -> DataFrame:
    """value: one JSON line per labelled record. The header is ``CLASH_HEADER``; ``write_jsonl`` puts it first."""
    return records.where("label is not null").select(F.to_json(F.struct(*records.columns)).alias("value"))


def commands_jsonl(commands: DataFrame, system: str) -> DataFrame:
    """value: one chat-format JSON line per command (input, output, path)."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    base = F.array(message("system", F.lit(system)), message("user", F.col("input")))
    full = F.when(F.col("output").isNotNull(), F.concat(base, F.array(message("assistant", F.col("output"))))).otherwise(base)
    return commands.select(F.to_json(F.struct(full.alias("messages"), F.col("output").isNotNull().alias("matched"), F.col("path"))).alias("value"))


def write_jsonl(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Lines as text part files; a header is a part of its own that sorts before the others."""
    lines.write.mode("overwrite").text(path)
    if header is not None:
        spark = lines.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-00000-0-header.txt")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray((header + "\n").encode()))
        out.close()


def ids_specs(spark: SparkSession) -> DataFrame:
    """pos, name, entity, facet, target, prop of the exported specifications: a small fixed table."""
    rows = [
        ("GlobalId required", "IFCBUILDINGELEMENT", "attribute", "GlobalId", None), ("Material assigned", "IFCBUILDINGELEMENT", "material", None, None),
        ("Storey assignment", "IFCBUILDINGELEMENT", "partOf", "IFCBUILDINGSTOREY", None), ("Description", "IFCBUILDINGELEMENT", "attribute", "Description", None),
        ("No unclassified proxies", "IFCBUILDINGELEMENTPROXY", "entity", None, None),
        *((f"{pset} on {kind}", kind.upper(), "property", pset, None) for kind, pset in COMMON_PSET.items()),
        ("FireRating on walls", "IFCWALL", "property", "Pset_WallCommon", "FireRating"), ("IsExternal on walls", "IFCWALL", "property", "Pset_WallCommon", "IsExternal"),
    ]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, name string, entity string, facet string, target string, prop string")


def ids_xml(specs: DataFrame, title: str, date: str) -> DataFrame:
    """value: the whole IDS document, one row. The specifications are a fixed small table."""
    value = lambda c: F.concat(F.lit("<simpleValue>"), text.xml_escape(c), F.lit("</simpleValue>"))
    need = (
        F.when(F.col("facet") == "attribute", F.concat(F.lit('<attribute cardinality="required"><name>'), value("target"), F.lit("</name></attribute>")))
        .when(F.col("facet") == "material", F.lit('<material cardinality="required"/>'))
        .when(F.col("facet") == "partOf", F.concat(F.lit('<partOf relation="IFCRELCONTAINEDINSPATIALSTRUCTURE" cardinality="required"><entity><name>'), value("target"), F.lit("</name></entity></partOf>")))
        .when(F.col("facet") == "property", F.concat(F.lit('<property cardinality="required"><propertySet>'), value("target"), F.lit("</propertySet>"), F.when(F.col("prop").isNotNull(), F.concat(F.lit("<baseName>"), value("prop"), F.lit("</baseName>"))).otherwise(""), F.lit("</property>")))
        .otherwise("")
    )
    spec = F.concat(
        F.lit('<specification name="'), text.xml_escape("name"), F.lit('" ifcVersion="IFC2X3 IFC4"><applicability minOccurs="0" maxOccurs="unbounded"><entity><name>'),
        value("entity"), F.lit("</name></entity></applicability><requirements>"), need, F.lit("</requirements></specification>"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", spec.alias("x")))), lambda r: r.x), "\n")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<ids xmlns="http://standards.buildingsmart.org/IDS" xmlns:xs="http://www.w3.org/2001/XMLSchema">\n<info><title>'
    return specs.agg(F.concat(F.lit(head), text.xml_escape(F.lit(title)), F.lit(f"</title><date>{date}</date></info>\n<specifications>\n"), body, F.lit("\n</specifications>\n</ids>\n")).alias("value"))


def _elements_of(tag: str) -> str:
    """A pattern for the elements of one name in XML text, with or without a prefix or a body."""
    return rf"(?s)<(?:\w+:)?{tag}(?:\s(?:\"[^\"]*\"|'[^']*'|[^\"'>/])*)?(?:/>|>.*?</(?:\w+:)?{tag}\s*>)"


def ids_rules(documents: DataFrame, column: str = "value") -> DataFrame:
    """title, name, entity, requirements (an array of texts) of each specification of IDS documents, one per row of ``documents``.

    A specification without an entity has '*', one without a name 'Unnamed'. Requirements are listed by kind: attributes,
    properties, materials, then containing elements. Each specification is read by itself, so gaps in one shift no other.
    """
    steps = lambda *names: "".join(f"//*[local-name()='{n}']" for n in names)
    first = lambda c, default, *names: F.coalesce(F.nullif(F.xpath_string(c, F.lit(steps(*names))), F.lit("")), F.lit(default))
    each = lambda c, tag: F.regexp_extract_all(c, F.lit(_elements_of(tag)), F.lit(0))
    specs = documents.select(first(F.col(column), "Imported IDS", "info", "title").alias("title"), F.posexplode(each(F.col(column), "specification")).alias("pos", "spec"))
    needs = F.regexp_extract("spec", _elements_of("requirements"), 0)
    requirements = F.concat(
        F.transform(each(needs, "attribute"), lambda x: F.concat(F.lit("attribute: "), first(x, "?", "name", "simpleValue"))),
        F.transform(each(needs, "property"), lambda x: F.concat(F.lit("property: "), first(x, "?", "propertySet", "simpleValue"), F.lit("."), first(x, "*", "baseName", "simpleValue"))),
        F.transform(each(needs, "material"), lambda x: F.lit("material")),
        F.transform(each(needs, "partOf"), lambda x: F.concat(F.lit("partOf: "), first(x, "?", "entity", "name", "simpleValue"))),
    )
    name = F.coalesce(F.nullif(F.xpath_string("spec", F.lit("/*/@name")), F.lit("")), F.lit("Unnamed"))
    return specs.select("title", name.alias("name"), first(F.col("spec"), "*", "applicability", "entity", "name", "simpleValue").alias("entity"), requirements.alias("requirements"))


def topic_xml(issues: DataFrame) -> DataFrame:
    """topic (guid) and markup: the topic document of each issue."""
    guid = F.concat_ws("-", *(F.substring(F.sha2(F.col("id").cast("string"), 256), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    e = text.xml_escape
    markup = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<Markup><Topic Guid="'), guid, F.lit('" TopicType="Clash" TopicStatus="'), e("status"), F.lit('"><Title>'), e("title"),
        F.lit("</Title><Priority>"), e("priority"), F.lit("</Priority><Description>"), e("description"), F.lit("</Description></Topic></Markup>"),
    )
    return issues.select("id", guid.alias("topic"), markup.alias("markup"))

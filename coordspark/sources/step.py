"""STEP text files (ISO 10303-21) as tables: entities, and elements with their property sets, quantities, storeys, materials and hosts.

Files are read in byte ranges, in parallel. A range cannot tell by itself whether it begins inside a string or a comment,
where a ``;`` ends nothing. So a first pass works out, for each range and each state that it may begin in, the state that
it ends in; these small maps are composed along each file, and the second pass begins every range in its true state. A
statement belongs to the range in which it begins, and its reader goes on past the range's end to the statement's.

References are resolved by joins over entity ids: nothing of a model is held in one place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from coordspark.operators import quality
from coordspark.sources.scratch import save

RANGE_BYTES = 32 << 20
#: What a reader asks for at once beyond the end of its range.
AHEAD_BYTES = 1 << 20

#: States between bytes: plain text, after a slash in it, in a string, in a comment, after a star in one.
PLAIN, SLASH, STRING, COMMENT, STAR = range(5)
STATES = 5

_MARK = re.compile(rb"'|/\*")


def end_state(data: bytes, state: int) -> int:
    """The state after ``data``, if it begins in ``state``. A doubled quote leaves a string and enters it again, which is the same."""
    at, n = 0, len(data)
    if not n:
        return state
    if state == SLASH:
        state = COMMENT if data[:1] == b"*" else PLAIN
        at = int(state == COMMENT)
    if state == STAR:
        state = PLAIN if data[:1] == b"/" else COMMENT
        at = int(state == PLAIN)
    while at < n:
        if state == PLAIN:
            found = _MARK.search(data, at)
            if found is None:
                return SLASH if data[-1:] == b"/" else PLAIN
            state, at = (STRING if found[0] == b"'" else COMMENT), found.end()
        elif state == STRING:
            close = data.find(b"'", at)
            if close < 0:
                return STRING
            state, at = PLAIN, close + 1
        else:
            close = data.find(b"*/", at)
            if close < 0:
                return STAR if data[-1:] == b"*" and at < n else COMMENT
            state, at = PLAIN, close + 2
    return state


# strings, comments and the ends of statements; what is left over is plain text
_TOKEN = re.compile(rb"'[^']*'|/\*.*?\*/|;", re.S)
_ENTITY = re.compile(r"\s*#(\d+)\s*=\s*([A-Za-z_][A-Za-z0-9_]*)\s*\((.*)\)\s*\Z", re.S)
_SPLIT = re.compile(r"'(?:[^']|'')*'|[(),]")


def statement_end(data: bytes, at: int) -> int:
    """Where the statement that begins at ``at`` ends (behind its ``;``), or -1 if ``data`` ends before. ``at`` is in plain text."""
    while True:
        found = _TOKEN.search(data, at)
        if found is None:
            return -1
        gap = data[at : found.start()]
        if b"'" in gap or b"/*" in gap:  # a string or comment that is not finished here hides what follows
            return -1
        if found[0] == b";":
            return found.end()
        at = found.end()


def first_statement(data: bytes, state: int) -> int:
    """Where the first statement begins that does not begin before ``data``: behind the first ``;`` in plain text, or -1."""
    at = 0
    if state == SLASH:
        state, at = (COMMENT, 1) if data[:1] == b"*" else (PLAIN, 0)
    if state == STAR:
        state, at = (PLAIN, 1) if data[:1] == b"/" else (COMMENT, 0)
    if state == STRING:
        at = data.find(b"'") + 1
        if not at:
            return -1
    elif state == COMMENT:
        at = data.find(b"*/", at) + 2
        if at < 2:
            return -1
    return statement_end(data, at)


def without_comments(statement: bytes) -> bytes:
    return _TOKEN.sub(lambda m: b" " if m[0][:2] == b"/*" else m[0], statement) if b"/*" in statement else statement


def arguments(body: str) -> list[str]:
    """The top-level arguments of an entity, as they are written."""
    out, depth, start = [], 0, 0
    for found in _SPLIT.finditer(body):
        c = found[0]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and not depth:
            out.append(body[start : found.start()].strip())
            start = found.end()
    last = body[start:].strip()
    return [*out, last] if out or last else []


def entity(statement: bytes) -> tuple[int, str, list[str]] | None:
    """(id, type, arguments) of a statement, or None if it is no entity (a header, a section mark, a compound entity)."""
    found = _ENTITY.match(without_comments(statement).decode("utf-8", "replace"))
    return (int(found[1]), found[2].upper(), arguments(found[3])) if found else None


_ENCODED = re.compile(r"\\X2\\((?:[0-9A-Fa-f]{4})*)\\X0\\|\\X4\\((?:[0-9A-Fa-f]{8})*)\\X0\\|\\X\\([0-9A-Fa-f]{2})|\\S\\(.)|\\P[A-I]\\|\\\\|''", re.S)


def plain_text(written: str | None) -> str | None:
    """The text of a quoted argument: doubled quotes and encoded characters undone; None for anything else."""
    if written is None or len(written) < 2 or written[0] != "'" or written[-1] != "'":
        return None

    def undo(m: re.Match) -> str:
        if m[1] is not None:
            return bytes.fromhex(m[1]).decode("utf-16-be", "replace")
        if m[2] is not None:
            return bytes.fromhex(m[2]).decode("utf-32-be", "replace")
        if m[3] is not None:
            return chr(int(m[3], 16))
        if m[4] is not None:
            return chr(ord(m[4]) + 128)
        return {"\\\\": "\\", "''": "'"}.get(m[0], "")

    return _ENCODED.sub(undo, written[1:-1])


def quoted_text(value: str) -> str:
    """``value`` as a quoted argument."""

    def coded(m: re.Match) -> str:
        return "\\X2\\" + m[0].encode("utf-16-be").hex().upper() + "\\X0\\"

    return "'" + re.sub(r"[^\x20-\x7e]+", coded, value.replace("\\", "\\\\").replace("'", "''")) + "'"


@F.pandas_udf(StringType())
def unquoted(column: pd.Series) -> pd.Series:
    return column.map(plain_text, na_action="ignore")


@F.pandas_udf(StringType())
def quoted(column: pd.Series) -> pd.Series:
    return column.map(quoted_text, na_action="ignore")


# --- files to entities


@dataclass(frozen=True)
class Range:
    path: str
    start: int
    end: int
    size: int


def ranges_of(files: list[tuple[str, int]], range_bytes: int) -> list[Range]:
    return [Range(path, a, min(size, a + range_bytes), size) for path, size in files for a in range(0, size, range_bytes)]


def _open(uri: str):
    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return store.open_input_file(path)


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and size of the files that ``path`` (a file, a folder, or a pattern) stands for, by Spark's file index."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0").collect()
    return sorted((r.path, r.length) for r in rows)


def entities(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, express_id, type (upper case) and args (as written) of all entities of the STEP files of ``path``.

    The files' paths, sizes and, for each range, five small numbers pass through the driver.
    """
    ranges = ranges_of(_listed(spark, path), range_bytes)
    schema = "file string, express_id bigint, type string, args array<string>"
    if not ranges:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame([(i, r.path, r.start, r.end, r.size) for i, r in enumerate(ranges)], "i int, path string, a bigint, b bigint, size bigint")
    spread = table.repartition(len(ranges), "i")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for r in batch.to_pylist():
                with _open(r["path"]) as f:
                    data = f.read_at(r["b"] - r["a"], r["a"])
                ends.append([end_state(data, s) for s in range(STATES)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.list_(pa.int32()))], ["i", "ends"])

    ends = {r.i: r.ends for r in spread.mapInArrow(maps, "i int, ends array<int>").collect()} if len(ranges) > 1 else {0: [PLAIN] * STATES}
    begins, state = [], PLAIN
    for i, r in enumerate(ranges):
        state = PLAIN if r.start == 0 else state
        begins.append((i, r.path, r.start, r.end, r.size, state))
        state = ends[i][state]
    begun = spark.createDataFrame(begins, "i int, path string, a bigint, b bigint, size bigint, state int").repartition(len(ranges), "i")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                for found in range_entities(r["path"], r["a"], r["b"], r["size"], r["state"]):
                    rows.append((r["path"], *found))
                    if len(rows) == 5000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    return begun.mapInArrow(read, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    types = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "express_id", "type", "args"])


def range_entities(path: str, start: int, end: int, size: int, state: int) -> Iterator[tuple[int, str, list[str]]]:
    """The entities whose statements begin in a range that begins in ``state``."""
    with _open(path) as f:
        data, have = f.read_at(end - start, start), end

        def more() -> bool:
            nonlocal data, have
            if have >= size:
                return False
            part = f.read_at(min(AHEAD_BYTES, size - have), have)
            data, have = data + part, have + len(part)
            return True

        # what stands before the first end belongs to the range before; only a file's first range begins with a statement
        at = 0 if start == 0 else first_statement(data, state)
        while 0 <= at <= end - start:  # one that begins where the range ends is still this range's
            stop = statement_end(data, at)
            while stop < 0:
                if not more():
                    return
                stop = statement_end(data, at)
            found = entity(data[at : stop - 1])
            if found is not None:
                yield found
            at = stop


# --- entities to elements

#: Places of arguments, fixed by the schema: rooted objects begin with id, owner, name, description.
GLOBAL_ID, OWNER, NAME, DESCRIPTION, OBJECT_TYPE, PLACEMENT, SHAPE, LONG_NAME, ELEVATION = 0, 1, 2, 3, 4, 5, 6, 7, 9
#: relation -> (place of the related objects, place of the relating one)
RELATIONS = {
    "IFCRELDEFINESBYPROPERTIES": (4, 5), "IFCRELDEFINESBYTYPE": (4, 5), "IFCRELCONTAINEDINSPATIALSTRUCTURE": (4, 5), "IFCRELASSOCIATESMATERIAL": (4, 5),
    "IFCRELAGGREGATES": (5, 4), "IFCRELFILLSELEMENT": (5, 4), "IFCRELVOIDSELEMENT": (5, 4),
}
#: Levels of parts within parts (element assemblies) through which a storey is looked for.
NESTING = 4

#: Types that are written with more capitals than one, beside those that the rules name.
_MORE_TYPES = "IfcPipeSegment IfcPipeFitting IfcDuctSegment IfcDuctFitting IfcCableSegment IfcCableCarrierSegment IfcFlowTerminal IfcSanitaryTerminal IfcOpeningElement IfcVirtualElement IfcElementAssembly".split()
_KNOWN_TYPES = sorted(set(_MORE_TYPES) | {t for name in dir(quality) if isinstance(value := getattr(quality, name), (list, tuple, dict, set, frozenset)) for t in value if isinstance(t, str) and t.startswith("Ifc")})


def _arg(i: int) -> Column:
    """The i-th argument, null where there are fewer."""
    return F.get("args", F.lit(i))


def refs(arg: Column) -> Column:
    """The entity ids that an argument refers to, outside strings."""
    bare = F.regexp_replace(arg, r"'(?:[^']|'')*'", "")
    return F.transform(F.regexp_extract_all(bare, F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))


def ref(arg: Column) -> Column:
    return F.try_element_at(refs(arg), F.lit(1))


def nominal(arg: Column) -> Column:
    """The text of a value argument: a type's name around it is taken off, texts are unquoted, truth values are spelt out; null for ``$``."""
    inner = F.regexp_replace(arg, r"(?s)^[A-Za-z][A-Za-z0-9_]*\s*\((.*)\)$", "$1")
    spelt = F.when(inner == ".T.", "true").when(inner == ".F.", "false").when(inner == ".U.", "unknown").otherwise(F.regexp_replace(inner, r"^\.(\w+)\.$", "$1"))
    return F.when(~arg.isin("$", "*"), F.when(F.substring(inner, 1, 1) == "'", unquoted(inner)).otherwise(F.regexp_replace(spelt, r"^(-?\d+)\.$", "$1")))


def type_name(kind: Column) -> Column:
    """``IFCWALL`` as ``IfcWall``; types that the rules do not know are written with one capital."""
    table = F.create_map(*(F.lit(x) for t in _KNOWN_TYPES for x in (t.upper(), t)))
    return F.coalesce(F.try_element_at(table, kind), F.concat(F.lit("Ifc"), F.initcap(F.substring(kind, 4, 200))))


def all_relations(found: DataFrame) -> DataFrame:
    """file, type, part, whole: the related and the relating entity of each relation."""
    parts, wholes = (F.coalesce(*(F.when(F.col("type") == kind, _arg(at[i])) for kind, at in RELATIONS.items())) for i in (0, 1))
    return found.where(F.col("type").isin(*RELATIONS)).select("file", "type", F.explode(refs(parts)).alias("part"), ref(wholes).alias("whole"))


def relations(related: DataFrame, kind: str) -> DataFrame:
    """file, part, whole of the relations of a kind."""
    return related.where(F.col("type") == kind).select("file", "part", "whole")


def is_element(kind: Column) -> Column:
    """Products: rooted objects with a placement and a shape (ids and either of these may be unset), without types, relations and the project."""
    unset_or = lambda i, form: _arg(i).rlike(rf"(?s)^(\$|{form})$")
    named = kind.rlike("^IFC(?!REL|PROJECT$).*") & ~kind.rlike("(TYPE|STYLE)$") & ~kind.isin("IFCSITE", "IFCBUILDING", "IFCBUILDINGSTOREY", "IFCPERSON", "IFCPOSTALADDRESS", "IFCTELECOMADDRESS")
    return named & (F.size("args") >= 7) & unset_or(GLOBAL_ID, "'.*'") & unset_or(OWNER, r"#\d+") & unset_or(PLACEMENT, r"#\d+") & unset_or(SHAPE, r"#\d+")


def _properties(found: DataFrame) -> DataFrame:
    """file, set_id, pset ('' for quantities, which are one set an object), quantity, pos, key, value of all sets that say something."""
    sets = found.where(F.col("type").isin("IFCPROPERTYSET", "IFCELEMENTQUANTITY"))
    listed = F.when(F.col("type") == "IFCPROPERTYSET", _arg(4)).otherwise(_arg(5))
    members = sets.select("file", F.col("express_id").alias("set_id"), F.when(F.col("type") == "IFCPROPERTYSET", F.coalesce(unquoted(_arg(NAME)), F.lit(""))).otherwise("").alias("pset"), (F.col("type") == "IFCELEMENTQUANTITY").alias("quantity"), F.posexplode(refs(listed)).alias("pos", "member"))
    single = F.col("type") == "IFCPROPERTYSINGLEVALUE"
    several = F.col("type").isin("IFCPROPERTYENUMERATEDVALUE", "IFCPROPERTYLISTVALUE")
    items = F.regexp_extract_all(_arg(2), F.lit(r"'(?:[^']|'')*'|[^\s(),']+(?=\s*[,)])"), F.lit(0))
    measured = F.col("type").rlike("^IFCQUANTITY(LENGTH|AREA|VOLUME|COUNT|WEIGHT|TIME)$")
    values = found.where(single | several | measured).select(
        "file", F.col("express_id").alias("member"), F.col("type"), unquoted(_arg(0)).alias("key"), F.when(single, _arg(2)).when(measured, _arg(3)).alias("written"), F.when(several, items).alias("items")
    )
    one = values.where("items is null").select("file", "member", "key", nominal(F.col("written")).alias("value"))
    many = values.where("items is not null").select("file", "member", "key", F.posexplode("items").alias("n", "item")).select("file", "member", "key", "n", nominal(F.col("item")).alias("v"))
    many = many.groupBy("file", "member", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]), ", ").alias("value"))
    return members.join(one.unionByName(many), ["file", "member"]).where("key is not null and value is not null").drop("member")


def _sets_of(found: DataFrame, related: DataFrame) -> DataFrame:
    """file, express_id, psets and quantities of the objects that sets are attached to, by themselves or by their type; their own go before."""
    direct = relations(related, "IFCRELDEFINESBYPROPERTIES").select("file", F.col("part").alias("express_id"), F.col("whole").alias("set_id"), F.lit(1).alias("own"))
    typed = found.where(F.col("type").rlike("(TYPE|STYLE)$") & (F.size("args") > 5)).select("file", F.col("express_id").alias("whole"), F.explode(refs(_arg(5))).alias("set_id"))
    by_type = relations(related, "IFCRELDEFINESBYTYPE").join(typed, ["file", "whole"]).select("file", F.col("part").alias("express_id"), "set_id", F.lit(0).alias("own"))
    rows = direct.unionByName(by_type).distinct().join(_properties(found), ["file", "set_id"])
    # of one key in sets of one name the object's own value counts, then that of the later set and place
    last = rows.groupBy("file", "express_id", "quantity", "pset", "key").agg(F.max(F.struct("own", "set_id", "pos", "value")).alias("x"))
    entry = F.struct(F.col("key").alias("key"), F.col("x.value").alias("value"))
    per_set = last.groupBy("file", "express_id", "quantity", "pset").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("values"))
    psets = F.collect_list(F.when(~F.col("quantity"), F.struct(F.col("pset").alias("key"), F.col("values").alias("value"))))
    counted = F.flatten(F.collect_list(F.when(F.col("quantity"), F.map_entries("values"))))
    return per_set.groupBy("file", "express_id").agg(F.map_from_entries(psets).alias("psets"), F.when(F.size(counted) > 0, F.map_from_entries(counted)).alias("quantities"))


def _materials(found: DataFrame, related: DataFrame) -> DataFrame:
    """file, express_id, material (names joined by ', ') and layers (widths) of the objects that a material, layer set or list is attached to."""
    given = relations(related, "IFCRELASSOCIATESMATERIAL").select("file", F.col("part").alias("express_id"), F.col("whole").alias("m"))
    kind = lambda name: found.where(F.col("type") == name)
    usage = kind("IFCMATERIALLAYERSETUSAGE").select("file", F.col("express_id").alias("m"), ref(_arg(0)).alias("target"))
    given = given.join(usage, ["file", "m"], "left").select("file", "express_id", F.coalesce("target", "m").alias("m"))
    layers = kind("IFCMATERIALLAYERSET").select("file", F.col("express_id").alias("m"), F.posexplode(refs(_arg(0))).alias("pos", "layer"))
    layer = kind("IFCMATERIALLAYER").select("file", F.col("express_id").alias("layer"), ref(_arg(0)).alias("material"), nominal(_arg(1)).alias("width"))
    lists = kind("IFCMATERIALLIST").select("file", F.col("express_id").alias("m"), F.posexplode(refs(_arg(0))).alias("pos", "material"), F.lit(None).cast("string").alias("width"))
    alone = kind("IFCMATERIAL").select("file", F.col("express_id").alias("m"), F.lit(0).alias("pos"), F.col("express_id").alias("material"), F.lit(None).cast("string").alias("width"))
    parts = layers.join(layer, ["file", "layer"]).select("file", "m", "pos", "material", "width").unionByName(lists).unionByName(alone)
    names = kind("IFCMATERIAL").select("file", F.col("express_id").alias("material"), unquoted(_arg(0)).alias("name"))
    rows = given.join(parts, ["file", "m"]).join(names, ["file", "material"], "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", "name", "width")))
    widths = F.transform(F.filter("listed", lambda x: x["width"].isNotNull()), lambda x: F.struct(x["width"].alias("width")))
    return rows.groupBy("file", "express_id").agg(listed.alias("listed")).select(
        "file", "express_id", F.array_join(F.array_distinct(F.transform("listed", lambda x: x["name"])), ", ").alias("material"), F.when(F.size(widths) > 0, widths).alias("layers")
    )


def storeys(found: DataFrame) -> DataFrame:
    """file, storey_id, name, elevation of the storeys."""
    rows = found.where(F.col("type") == "IFCBUILDINGSTOREY")
    return rows.select("file", F.col("express_id").alias("storey_id"), unquoted(_arg(NAME)).alias("name"), _arg(ELEVATION).try_cast("double").alias("elevation"))


def _storey_of(found: DataFrame, related: DataFrame) -> DataFrame:
    """file, express_id, storey: of the storey that contains an object, or whose space does, or that contains what it is a part of."""
    contained = relations(related, "IFCRELCONTAINEDINSPATIALSTRUCTURE")
    parts = relations(related, "IFCRELAGGREGATES")
    up = contained.unionByName(parts)
    names = storeys(found).select("file", F.col("storey_id").alias("whole"), F.col("name").alias("storey"))
    above = up.select("file", F.col("part").alias("whole"), F.col("whole").alias("next"))
    place, out = up, None
    for depth in range(NESTING):
        met = place.join(names, ["file", "whole"]).select("file", F.col("part").alias("express_id"), "storey", F.lit(depth).alias("depth"))
        out = met if out is None else out.unionByName(met)
        higher = save(place.join(above, ["file", "whole"]).select("file", "part", F.col("next").alias("whole")), "step-places")
        if not higher.stored_rows:
            break
        place = higher
    return out.groupBy("file", "express_id").agg(F.min(F.struct("depth", "storey")).alias("x")).select("file", "express_id", F.col("x.storey").alias("storey"))


def _hosts(related: DataFrame) -> DataFrame:
    """file, express_id, host (an id): what a door or window stands in, through its opening."""
    fills, voids = relations(related, "IFCRELFILLSELEMENT"), relations(related, "IFCRELVOIDSELEMENT")
    rows = fills.select("file", F.col("part").alias("express_id"), F.col("whole").alias("part")).join(voids, ["file", "part"])
    return rows.groupBy("file", "express_id").agg(F.min("whole").alias("host"))


def elements(found: DataFrame) -> DataFrame:
    """The elements of stored entities (file, express_id, type, args), in the columns that the rules read: file, express_id, global_id,
    ifc_type, name, description, object_type, long_name, storey, material, layers, host_id, psets, quantities.

    A file is a model; give several files the same ``file`` where they are parts of one. Entity ids are unique within a model:
    of repeated ones each is an element of its own.
    """
    rows = found.where(is_element(F.col("type")))
    products = rows.select(
        "file", "express_id", unquoted(_arg(GLOBAL_ID)).alias("global_id"), type_name(F.col("type")).alias("ifc_type"), unquoted(_arg(NAME)).alias("name"), unquoted(_arg(DESCRIPTION)).alias("description"),
        unquoted(_arg(OBJECT_TYPE)).alias("object_type"), F.when(F.col("type") == "IFCSPACE", unquoted(_arg(LONG_NAME))).alias("long_name"),
    )
    key = ["file", "express_id"]
    related = save(all_relations(found), "step-relations")
    hosts = _hosts(related).join(found.select("file", F.col("express_id").alias("host"), unquoted(_arg(GLOBAL_ID)).alias("host_id")), ["file", "host"]).drop("host")
    out = products.join(_storey_of(found, related), key, "left").join(_materials(found, related), key, "left").join(hosts, key, "left").join(_sets_of(found, related), key, "left")
    return out.select(*products.columns, "storey", "material", "layers", "host_id", "psets", "quantities")


def read_elements(spark: SparkSession, path: str, one_model: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The elements of the STEP files of ``path``; with ``one_model`` the files are parts of one. The entities are stored on the way."""
    found = entities(spark, path, range_bytes)
    return elements(save(found.withColumn("file", F.lit(path)) if one_model else found, "step-entities"))


# --- elements to files


def _statement(number: Column, kind: Column | str, *args: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("#"), number.cast("string"), F.lit("="), kind, F.lit("("), F.concat_ws(",", *args), F.lit(");"))


def statements(rows: DataFrame) -> DataFrame:
    """value: the statements of elements (express_id, global_id, ifc_type, name, description, object_type, storey, material, psets).

    Each element has its own sets and relations, so nothing is gathered; storeys are one a name. Ids are numbered apart:
    an element's statements get the 1000 numbers from 1000 * express_id on, storeys are numbered from 2^62 on by a hash of their name.
    More than 30 sets, or 30 properties in one, raise an error.
    """
    none, owner = F.lit("$"), F.lit("$")
    said = lambda c: F.coalesce(quoted(F.col(c)), none)
    base = F.col("express_id") * 1000
    hashed = lambda name: F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(name), 3)
    guid = lambda *parts: F.concat(F.lit("'"), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 22), F.lit("'"))
    number = lambda n: F.concat(F.lit("#"), n.cast("string"))
    # texts are quoted once for all, before the arrays of statements are built
    flat = rows.select("express_id", "ifc_type", *(said(c).alias(c) for c in ("global_id", "name", "description", "object_type", "material")), F.col("storey").alias("raw_storey"), "psets")
    product = _statement(base, F.upper("ifc_type"), F.col("global_id"), owner, F.col("name"), F.col("description"), F.col("object_type"), none, none, none)
    key = F.col("express_id").cast("string")
    stone = F.when(F.col("material") != "$", F.array(
        _statement(base + 1, "IFCMATERIAL", F.col("material")),
        _statement(base + 2, "IFCRELASSOCIATESMATERIAL", guid(F.lit("m"), key), owner, none, none, F.concat(F.lit("("), number(base), F.lit(")")), number(base + 1)),
    )).otherwise(F.array().cast("array<string>"))
    held = F.when(F.col("raw_storey") != "", F.array(_statement(base + 3, "IFCRELCONTAINEDINSPATIALSTRUCTURE", guid(F.lit("s"), key), owner, none, none, F.concat(F.lit("("), number(base), F.lit(")")), number(hashed("raw_storey"))))).otherwise(F.array().cast("array<string>"))
    lines = flat.select(F.explode(F.concat(F.array(product), stone, held)).alias("value"))
    named = rows.select("storey").where("storey <> ''").distinct()
    levels = named.select(_statement(hashed("storey"), "IFCBUILDINGSTOREY", guid(F.lit("l"), F.col("storey")), owner, said("storey"), none, none, none, none, none, F.lit(".ELEMENT."), F.lit("0.")).alias("value"))
    sets = rows.select("express_id", F.posexplode(F.map_entries("psets")).alias("i", "s")).withColumn("n", F.size("s.value"))
    first = base + 10 + F.when((F.col("i") < 30) & (F.col("n") <= 30), F.col("i") * 33).otherwise(F.raise_error(F.lit("an element has more sets or properties than there are numbers for")).cast("int"))
    props = sets.select("express_id", "i", "n", F.posexplode(F.map_entries("s.value")).alias("j", "p"))
    stated = props.select("express_id", "i", "n", "j", F.col("p.key").alias("key"), F.col("p.value").alias("value")).where("value is not null")
    values = stated.select(_statement(first + 2 + F.col("j"), "IFCPROPERTYSINGLEVALUE", said("key"), none, F.concat(F.lit("IFCTEXT("), said("value"), F.lit(")")), none).alias("value"))
    filled = sets.select("express_id", "i", "n", F.col("s.key").alias("pset"), F.filter(F.sequence(F.lit(0), F.col("n")), lambda k: k < F.col("n")).alias("all"))
    members = F.array_join(F.transform("all", lambda k: F.concat(F.lit("#"), (first + 2 + k).cast("string"))), ",")
    defined = filled.select(F.explode(F.array(
        _statement(first, "IFCPROPERTYSET", guid(F.lit("p"), key, F.col("i").cast("string")), owner, said("pset"), none, F.concat(F.lit("("), members, F.lit(")"))),
        _statement(first + 1, "IFCRELDEFINESBYPROPERTIES", guid(F.lit("r"), key, F.col("i").cast("string")), owner, none, none, F.concat(F.lit("("), number(base), F.lit(")")), number(first)),
    )).alias("value"))
    return lines.unionByName(levels).unionByName(values).unionByName(defined)


def write_elements(rows: DataFrame, path: str) -> None:
    """Elements as STEP text: part files that together are the data section of one model."""
    statements(rows).write.mode("overwrite").text(path)

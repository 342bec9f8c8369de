"""Binary scene files (GLB 2.0): node meshes with their world matrices, shared geometry decoded once, read by byte ranges.

Reading takes three steps. Each file's header and scene description are read alone, without its buffers, and the matrices of
the nodes are composed from the scene's roots down. The different primitives are cut into pieces of ``PIECE`` triangles and
dealt out; a task reads the byte ranges of its pieces and no more, so a large mesh is read by many tasks. Then the local
triangles are joined with the nodes that show them.

Defined results: a node without a mesh has no rows, a node that no scene reaches none either; without a scene all nodes that
are no one's children are roots. Primitives of points and lines have no triangles; strips and fans are unrolled, with the
winding of the format. A position accessor without a view is zero. Triangles that refer to a position beyond the accessor are an
error, as are broken or cut-off files, cycles or a node with two parents, sparse or compressed accessors and buffers outside the file: none is
passed over.
"""

from __future__ import annotations

import json
import re
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from coordspark.sources.formats import place_triangles

# Fixed values of the format: file mark, version, chunk types, component types, primitive modes.
MAGIC, VERSION, JSON_CHUNK, BIN_CHUNK = 0x46546C67, 2, 0x4E4F534A, 0x004E4942
FLOAT = 5126
INDEX_TYPES = {5121: "<u1", 5123: "<u2", 5125: "<u4"}
TRIANGLES, STRIP, FAN = 4, 5, 6

#: Triangles of a piece that one task reads at a time.
PIECE = 100_000
#: Bytes of buffers and number of nodes in a written file: its scene description is held in memory, in writing and in reading.
FILE_BYTES, FILE_NODES = 512 << 20, 20_000

CORNERS = [f"{a}{i}" for i in range(3) for a in "xyz"]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"))


def _open(uri: str):
    store, path = _store(uri)
    return store.open_input_file(path)


def described(f, size: int) -> tuple[dict, int, int]:
    """The scene description of a file, and where its buffer begins and how long it is."""
    head = f.read_at(20, 0)
    if len(head) < 20:
        raise ValueError("cut off in its header")
    magic, version, length, chunk, kind = struct.unpack("<5I", head)
    if magic != MAGIC or version != VERSION or kind != JSON_CHUNK:
        raise ValueError("no binary scene of version 2")
    if length > size or 20 + chunk > length:
        raise ValueError(f"{length} bytes announced, {size} there")
    scene = json.loads(f.read_at(chunk, 20))
    at = 20 + chunk
    while at + 8 <= length:
        n, kind = struct.unpack("<2I", f.read_at(8, at))
        if at + 8 + n > length:
            raise ValueError("cut off in a chunk")
        if kind == BIN_CHUNK:
            return scene, at + 8, n
        at += 8 + n
    return scene, at, 0


def local_matrix(node: dict) -> np.ndarray:
    """A node's own 4x4 matrix: given, or translation times rotation times scale."""
    if "matrix" in node:
        return np.array(node["matrix"], dtype=float).reshape(4, 4).T
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    turn = np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])
    out = np.eye(4)
    out[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)), dtype=float)
    out[:3, 3] = node.get("translation", (0, 0, 0))
    return out


def world_matrices(scene: dict) -> Iterator[tuple[int, np.ndarray]]:
    """Each node that a scene reaches with its matrix from local to world."""
    nodes = scene.get("nodes", [])
    below = {c for node in nodes for c in node.get("children", ())}
    scenes = scene.get("scenes")
    roots = [n for s in scenes for n in s.get("nodes", ())] if scenes else [n for n in range(len(nodes)) if n not in below]
    if not scenes and nodes and not roots:
        raise ValueError("nodes in a cycle")
    seen: set[int] = set()
    stack = [(n, np.eye(4)) for n in dict.fromkeys(roots)]
    while stack:
        n, above = stack.pop()
        if n in seen:
            raise ValueError(f"node {n} is reached twice")
        seen.add(n)
        world = above @ local_matrix(nodes[n])
        yield n, world
        stack += [(c, world) for c in nodes[n].get("children", ())]


@dataclass
class Part:
    """Where an accessor's values lie in the file."""

    at: int
    stride: int
    count: int
    kind: int


def part_of(scene: dict, accessor: int, start: int, length: int, width: int) -> Part:
    a = scene["accessors"][accessor]
    if "sparse" in a:
        raise ValueError("sparse accessors are not read")
    if "bufferView" not in a:
        return Part(-1, 0, a["count"], a["componentType"])
    view = scene["bufferViews"][a["bufferView"]]
    if view.get("buffer", 0) != 0 or "uri" in scene["buffers"][0] or "extensions" in view:
        raise ValueError("buffers outside the file, or compressed ones, are not read")
    item = np.dtype("<f4" if a["componentType"] == FLOAT else INDEX_TYPES.get(a["componentType"], "<u4")).itemsize * width
    offset, stride = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride", item)
    if a["count"] and offset + stride * (a["count"] - 1) + item > length:
        raise ValueError("an accessor beyond the buffer")
    return Part(start + offset, stride, a["count"], a["componentType"])


def values(f, part: Part, low: int, high: int, width: int, kind: str) -> np.ndarray:
    """The values ``low`` to ``high`` of an accessor, by strides over one byte range."""
    n, item = high - low, np.dtype(kind).itemsize
    if part.at < 0 or n <= 0:
        return np.zeros((max(n, 0), width), dtype=kind)
    raw = f.read_at(part.stride * (n - 1) + item * width, part.at + part.stride * low)
    return np.ndarray((n, width), dtype=kind, buffer=raw, strides=(part.stride, item))


def triangles_in(mode: int, n: int) -> int:
    return n // 3 if mode == TRIANGLES else max(0, n - 2) if mode in (STRIP, FAN) else 0


def piece_triangles(f, points: Part, index: Part | None, mode: int, low: int, high: int) -> np.ndarray:
    """The corners (n x 9) of the triangles ``low`` to ``high`` of a primitive."""
    if points.kind != FLOAT:
        raise ValueError("positions that are not floats are not read")
    if index is not None and index.kind not in INDEX_TYPES:
        raise ValueError("indices of an unknown type")
    places = lambda a, b: np.arange(a, b) if index is None else values(f, index, a, b, 1, INDEX_TYPES[index.kind])[:, 0].astype(np.int64)
    if mode == TRIANGLES:
        at = places(3 * low, 3 * high).reshape(-1, 3)
    else:
        # the second and third corner lie side by side; a strip turns every second triangle over
        run = places(low + 1, high + 2) if mode == FAN else places(low, high + 2)
        if mode == FAN:
            at = np.stack([np.full(high - low, places(0, 1)[0]), run[:-1], run[1:]], axis=1)
        else:
            odd = (np.arange(low, high) % 2).astype(bool)
            at = np.stack([run[:-2], np.where(odd, run[2:], run[1:-1]), np.where(odd, run[1:-1], run[2:])], axis=1)
    if not len(at):
        return np.empty((0, 9), dtype="<f4")
    first, last = int(at.min()), int(at.max()) + 1
    if last > points.count:
        raise ValueError(f"a triangle of position {last - 1}, of {points.count}")
    return values(f, points, first, last, 3, "<f4")[at - first].reshape(-1, 9)


def _parts(scene: dict, primitive: dict, start: int, length: int) -> tuple[Part, Part | None]:
    if "KHR_draco_mesh_compression" in primitive.get("extensions", {}):
        raise ValueError("compressed primitives are not read")
    index = part_of(scene, primitive["indices"], start, length, 1) if "indices" in primitive else None
    return part_of(scene, primitive["attributes"]["POSITION"], start, length, 3), index


_PART = "struct<at:bigint,stride:bigint,count:bigint,kind:int>"
_NODES = f"file string, node int, name string, extras string, matrix array<double>, geometry_id string, mode int, points {_PART}, index {_PART}, n bigint"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """A row for each primitive that a node of the files at ``path`` (a file, folder or pattern) shows.

    file, node, name, extras (JSON), matrix (column-major, to the world), geometry_id (one for each primitive of a file's
    meshes), mode, points, index, and n, its number of triangles.
    """
    part = pa.struct([("at", pa.int64()), ("stride", pa.int64()), ("count", pa.int64()), ("kind", pa.int32())])
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.int32(), part, part, pa.int64()]
    names = [x.strip().split(" ")[0] for x in re.sub(r"struct<[^>]*>", "t", _NODES).split(",")]

    def nodes(file: str, size: int) -> Iterator[tuple]:
        with _open(file) as f:
            scene, start, length = described(f, size)
        shown: dict[int, list[tuple]] = {}
        for n, world in world_matrices(scene):
            node = scene["nodes"][n]
            if "mesh" not in node:
                continue
            if node["mesh"] not in shown:  # read once for all nodes that show it
                rows = []
                for k, primitive in enumerate(scene["meshes"][node["mesh"]]["primitives"]):
                    mode = primitive.get("mode", TRIANGLES)
                    if mode not in (TRIANGLES, STRIP, FAN) or "POSITION" not in primitive["attributes"]:
                        continue
                    points, index = _parts(scene, primitive, start, length)
                    rows.append((f"{file}#{node['mesh']}/{k}", mode, vars(points), None if index is None else vars(index), triangles_in(mode, (index or points).count)))
                shown[node["mesh"]] = rows
            extras = json.dumps(node["extras"]) if "extras" in node else None
            for row in shown[node["mesh"]]:
                yield (file, n, node.get("name"), extras, world.T.ravel().tolist(), *row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                try:
                    for row in nodes(file, size):
                        rows.append(row)
                        if len(rows) == 1000:
                            yield _batch(rows, types, names)
                            rows = []
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    raise ValueError(f"{file}: {e}") from e
                if rows:
                    yield _batch(rows, types, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.glb").option("recursiveFileLookup", "true").load(path).select("path", "length")
    tasks = max(1, spark.sparkContext.defaultParallelism)
    return files.repartition(tasks, "path").mapInArrow(run, _NODES)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_triangles(nodes: DataFrame, piece: int = PIECE) -> DataFrame:
    """geometry_id, tri_idx and local corners x0 .. z2 of the primitives that ``nodes`` (of ``read_nodes``) show, each read once."""
    shown = nodes.where("n > 0").groupBy("geometry_id").agg(*(F.any_value(c).alias(c) for c in ("file", "mode", "points", "index", "n")))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(piece).cast("bigint"))
    pieces = shown.withColumn("low", F.explode(starts)).select("file", "geometry_id", "mode", "points", "index", "low", F.least(F.col("low") + piece, "n").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, geometry, mode, points, index, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(file) as f:
                    try:
                        found = piece_triangles(f, Part(**points), index and Part(**index), mode, low, high)
                    except ValueError as e:
                        raise ValueError(f"{geometry}: {e}") from e
                yield pa.RecordBatch.from_arrays(
                    [pa.array([geometry] * len(found), pa.string()), pa.array(np.arange(low, high), pa.int64()), *(pa.array(found[:, k].copy()) for k in range(9))], ["geometry_id", "tri_idx", *CORNERS]
                )

    tasks = nodes.sparkSession.sparkContext.defaultParallelism
    return pieces.repartition(max(1, tasks), "geometry_id", "low").mapInArrow(run, "geometry_id string, tri_idx bigint, " + ", ".join(f"{c} float" for c in CORNERS))


def read_placed(spark: SparkSession, path: str) -> DataFrame:
    """file, node, name, extras, geometry_id, tri_idx and world corners x0 .. z2 of every triangle that the files show."""
    nodes = read_nodes(spark, path)
    key = nodes.select(F.struct("file", "node", "name", "extras").alias("express_id"), "geometry_id", "matrix")
    # a plan's sizes are those before a file becomes nodes and a piece triangles: by them, either side would be broadcast
    placed = place_triangles(read_triangles(nodes).hint("merge"), key)
    return placed.select("express_id.*", "geometry_id", "tri_idx", *CORNERS)


# --- the sink


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class MeshWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        """Files of a task, of about ``FILE_BYTES`` or up to ``FILE_NODES`` nodes each; their names begin with a dot until they are committed."""
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        names, rows = [], iter(iterator)
        row = next(rows, None)
        while row is not None:
            scene: dict = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": []}], "nodes": [], "meshes": [], "accessors": [], "bufferViews": []}
            meshes: dict[str, int] = {}
            with tempfile.TemporaryFile() as buffer:  # this task's own, gone with it
                while row is not None and buffer.tell() < FILE_BYTES and len(scene["nodes"]) < FILE_NODES:
                    self._add(scene, meshes, buffer, row)
                    row = next(rows, None)
                names.append(f"{uuid.uuid4().hex}.glb")
                with store.open_output_stream(f"{base}/.{names[-1]}") as sink:
                    self._assemble(scene, buffer, sink)
        return Written(names)

    @staticmethod
    def _add(scene: dict, meshes: dict[str, int], buffer, row) -> None:
        node = {"name": row.name, "extras": {"expressId": row.express_id}}
        if row.geometry_id is not None and row.geometry_id in meshes:
            node["mesh"] = meshes[row.geometry_id]
        elif row.positions:
            points = np.frombuffer(row.positions, dtype="<f4").reshape(-1, 3)
            primitive: dict = {"attributes": {"POSITION": len(scene["accessors"])}}
            scene["accessors"].append({"bufferView": len(scene["bufferViews"]), "componentType": FLOAT, "count": len(points), "type": "VEC3", "min": points.min(0).tolist(), "max": points.max(0).tolist()})
            scene["bufferViews"].append({"buffer": 0, "byteOffset": buffer.tell(), "byteLength": len(row.positions)})
            buffer.write(row.positions)
            if row.indices is not None:
                primitive["indices"] = len(scene["accessors"])
                scene["accessors"].append({"bufferView": len(scene["bufferViews"]), "componentType": 5125, "count": len(row.indices) // 4, "type": "SCALAR"})
                scene["bufferViews"].append({"buffer": 0, "byteOffset": buffer.tell(), "byteLength": len(row.indices)})
                buffer.write(row.indices)
            node["mesh"] = len(scene["meshes"])
            scene["meshes"].append({"primitives": [primitive]})
            if row.geometry_id is not None:
                meshes[row.geometry_id] = node["mesh"]
        if row.matrix is not None:
            node["matrix"] = list(row.matrix)
        scene["scenes"][0]["nodes"].append(len(scene["nodes"]))
        scene["nodes"].append({k: v for k, v in node.items() if v is not None})

    @staticmethod
    def _assemble(scene: dict, buffer, sink) -> None:
        size = buffer.tell()
        scene["buffers"] = [{"byteLength": size}] if size else []
        text = json.dumps({k: v for k, v in scene.items() if v or k == "scene"}).encode()
        text += b" " * (-len(text) % 4)
        sink.write(struct.pack("<5I", MAGIC, VERSION, 20 + len(text) + (8 + size if size else 0), len(text), JSON_CHUNK) + text)
        if size:
            sink.write(struct.pack("<2I", size, BIN_CHUNK))
            buffer.seek(0)
            while part := buffer.read(1 << 20):
                sink.write(part)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            store.move(f"{base}/.{name}", f"{base}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            store.delete_file(f"{base}/.{name}")


_MESHES = "express_id bigint, name string, geometry_id string, positions binary, indices binary, matrix array<double>"


class MeshSource(DataSource):
    """``df.write.format("scene-meshes")``: rows of meshes to binary scenes. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "scene-meshes"

    def schema(self) -> str:
        return _MESHES

    def writer(self, schema, overwrite: bool) -> MeshWriter:
        return MeshWriter(self.options["path"])


def write_meshes(meshes: DataFrame, path: str) -> None:
    """Add files with the meshes below ``path``: express_id, name, geometry_id (null: the row's own; rows of a task that share it must share their mesh, which is
    written once a file), positions (f32), indices (u32, or null) and matrix (column-major, or null). Rows without positions become nodes without a mesh."""
    meshes.sparkSession.dataSource.register(MeshSource)
    rows = meshes.select(*(F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in _MESHES.split(", ")))
    rows.write.format("scene-meshes").option("path", path).mode("append").save()

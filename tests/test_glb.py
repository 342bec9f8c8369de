"""Binary scenes: the container, accessors, the scene graph, pieces, the sink, and files that are refused."""

import json
import struct

import numpy as np
import pytest

from coordspark.sources import glb

BOX = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 0, 1]], dtype="<f4")


def scene_file(path, scene, buffer, cut=0, magic=b"glTF", extra=b""):
    text = json.dumps({"asset": {"version": "2.0"}, "buffers": [{"byteLength": len(buffer)}], **scene}).encode()
    text += b" " * (-len(text) % 4)
    body = struct.pack("<2I", len(text), glb.JSON_CHUNK) + text + extra + struct.pack("<2I", len(buffer), glb.BIN_CHUNK) + buffer
    data = magic + struct.pack("<2I", 2, 12 + len(body)) + body
    path.write_bytes(data[: len(data) - cut])
    return str(path)


def mesh(mode=4, index="<u2", order=(0, 1, 2, 0, 2, 3), points=BOX, stride=12, pad=0):
    """A scene with one mesh, its points ``stride`` bytes apart and ``pad`` bytes into their view."""
    block = np.zeros((len(points), stride), dtype="u1")
    block[:, :12] = points.view("u1").reshape(-1, 12)
    raw = b"\xff" * pad + block.tobytes()
    primitive = {"attributes": {"POSITION": 0}, "mode": mode}
    accessors = [{"bufferView": 0, "byteOffset": pad, "componentType": 5126, "count": len(points), "type": "VEC3"}]
    views = [{"buffer": 0, "byteLength": len(raw), **({"byteStride": stride} if stride != 12 else {})}]
    if index:
        code = {v: k for k, v in glb.INDEX_TYPES.items()}[index]
        accessors.append({"bufferView": 1, "componentType": code, "count": len(order), "type": "SCALAR"})
        views.append({"buffer": 0, "byteOffset": len(raw), "byteLength": len(order) * np.dtype(index).itemsize})
        raw += np.array(order, dtype=index).tobytes()
        primitive["indices"] = 1
    return {"meshes": [{"primitives": [primitive]}], "accessors": accessors, "bufferViews": views, "nodes": [{"mesh": 0, "name": "n"}], "scenes": [{"nodes": [0]}]}, raw


def placed(spark, path):
    rows = glb.read_placed(spark, path).collect()
    return {(r.node, r.geometry_id.rsplit("#")[1], r.tri_idx): np.array([r[c] for c in glb.CORNERS]).reshape(3, 3) for r in rows}


@pytest.mark.parametrize("index", ["<u1", "<u2", "<u4"])
@pytest.mark.parametrize("stride, pad", [(12, 0), (24, 8)])
def test_accessors_are_read_by_strides(spark, tmp_path, index, stride, pad):
    got = placed(spark, scene_file(tmp_path / "a.glb", *mesh(index=index, stride=stride, pad=pad)))
    assert sorted(got) == [(0, "0/0", 0), (0, "0/0", 1)]
    assert np.array_equal(got[0, "0/0", 0], BOX[[0, 1, 2]]) and np.array_equal(got[0, "0/0", 1], BOX[[0, 2, 3]])


def test_modes(spark, tmp_path):
    order = (0, 1, 2, 3, 4)
    strip = placed(spark, scene_file(tmp_path / "s.glb", *mesh(5, order=order)))
    assert [np.array_equal(strip[0, "0/0", i], BOX[list(t)]) for i, t in enumerate([(0, 1, 2), (1, 3, 2), (2, 3, 4)])] == [True] * 3
    fan = placed(spark, scene_file(tmp_path / "f.glb", *mesh(6, order=order)))
    assert [np.array_equal(fan[0, "0/0", i], BOX[list(t)]) for i, t in enumerate([(0, 1, 2), (0, 2, 3), (0, 3, 4)])] == [True] * 3
    assert len(placed(spark, scene_file(tmp_path / "n.glb", *mesh(4, index=None)))) == 1  # five points: one triangle
    assert placed(spark, scene_file(tmp_path / "l.glb", *mesh(1))) == {}


@pytest.mark.parametrize("mode", [4, 5, 6])
def test_pieces_are_the_whole(spark, tmp_path, mode):
    points = np.random.default_rng(mode).random((40, 3)).astype("<f4")
    order = np.random.default_rng(9).integers(0, 40, 200)
    nodes = glb.read_nodes(spark, scene_file(tmp_path / "p.glb", *mesh(mode, order=order, points=points)))
    one, many = (sorted(map(tuple, glb.read_triangles(nodes, n).collect())) for n in (10**6, 7))
    assert one == many and len(one) == glb.triangles_in(mode, 200)


def test_matrices_are_composed_from_the_root_down(spark, tmp_path):
    scene, raw = mesh()
    half = 0.5**0.5
    scene["nodes"] = [
        {"translation": [10, 0, 0], "children": [1, 3]},
        {"rotation": [0, half, 0, half], "scale": [2, 3, 4], "children": [2]},  # a right angle about y
        {"matrix": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 5, 6, 7, 1], "mesh": 0, "extras": {"expressId": 7}},
        {"mesh": 0}, {"mesh": 0, "name": "in no scene"},
    ]
    path = scene_file(tmp_path / "m.glb", scene, raw)
    got = placed(spark, path)
    moved = (BOX + [5, 6, 7]) * [2, 3, 4]
    turned = np.stack([moved[:, 2], moved[:, 1], -moved[:, 0]], axis=1) + [10, 0, 0]
    assert {k[0] for k in got} == {2, 3}
    assert np.allclose(got[2, "0/0", 1], turned[[0, 2, 3]]) and np.allclose(got[3, "0/0", 0], BOX[[0, 1, 2]] + [10, 0, 0])
    nodes = glb.read_nodes(spark, path)
    assert {r.node: r.extras for r in nodes.collect()} == {2: '{"expressId": 7}', 3: None}
    assert glb.read_triangles(nodes).count() == 2  # shared geometry once


def test_without_a_scene_all_top_nodes_are_shown(spark, tmp_path):
    scene, raw = mesh()
    del scene["scenes"]
    scene["nodes"] = [{"children": [1]}, {"mesh": 0}, {"mesh": 0}]
    unknown = struct.pack("<2I", 4, 0x12345678) + b"????"
    assert {k[0] for k in placed(spark, scene_file(tmp_path / "t.glb", scene, raw, extra=unknown))} == {1, 2}


def broken(kind):
    scene, raw = mesh()
    if kind == "cycle":
        scene["nodes"] = [{"children": [1]}, {"children": [0], "mesh": 0}]
    if kind == "sparse":
        scene["accessors"][0]["sparse"] = {"count": 1}
    if kind == "outside":
        scene["accessors"][0]["count"] = 10**6
    if kind == "index":
        scene, raw = mesh(order=(0, 1, 77))
    if kind == "quantised":
        scene["accessors"][0]["componentType"] = 5123
    return scene, raw


@pytest.mark.parametrize("kind, says", [("cycle", "reached twice"), ("sparse", "sparse"), ("outside", "beyond the buffer"), ("index", "position 77"), ("quantised", "not floats")])
def test_what_cannot_be_read_is_an_error(spark, tmp_path, kind, says):
    with pytest.raises(Exception, match=says):
        placed(spark, scene_file(tmp_path / "b.glb", *broken(kind)))


def test_broken_containers_are_an_error(spark, tmp_path):
    for name, how in {"cut": {"cut": 5}, "mark": {"magic": b"blob"}}.items():
        with pytest.raises(Exception, match="bytes announced|no binary scene"):
            placed(spark, scene_file(tmp_path / f"{name}.glb", *mesh(), **how))


def test_sink(spark, tmp_path):
    order = np.array([0, 1, 2, 0, 2, 3], dtype="<u4").tobytes()
    shift = [float(x) for x in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 1, 2, 3, 1)]
    rows = [(1, "a", "g", BOX.tobytes(), order, None), (2, "b", "g", BOX.tobytes(), order, shift), (3, None, None, BOX[:3].tobytes(), None, None), (4, "no mesh", None, None, None, None)]
    out = str(tmp_path / "out")
    glb.write_meshes(spark.createDataFrame(rows, glb._MESHES).coalesce(1), out)
    glb.write_meshes(spark.createDataFrame([], glb._MESHES), out)
    nodes = glb.read_nodes(spark, out)
    assert sorted((r.extras, r.n) for r in nodes.collect()) == [('{"expressId": 1}', 2), ('{"expressId": 2}', 2), ('{"expressId": 3}', 1)]
    assert nodes.select("geometry_id").distinct().count() == 2
    found = {(json.loads(r.extras)["expressId"], r.tri_idx): r.x0 for r in glb.read_placed(spark, out).collect()}
    assert found == {(1, 0): 0, (1, 1): 0, (2, 0): 1, (2, 1): 1, (3, 0): 0}
    with pytest.raises(Exception, match="reshape|size"):
        glb.write_meshes(spark.createDataFrame([(1, "bad", None, b"12345678", None, None)], glb._MESHES), out)
    assert nodes.count() == 3 and not list((tmp_path / "out").glob("[!.]*.tmp"))

"""Geometry as column expressions: boxes, triangles, plane cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

AXES = ("x", "y", "z")
DEGENERATE, COPLANAR = 1e-10, 1e-12

Vector = tuple[Column, Column, Column]


def box_overlap(a: str, b: str, gap: float = 0) -> Column:
    """Inclusive overlap of the boxes in columns {a}x0 .. {b}z1, each side widened by ``gap``."""
    hit = F.lit(True)
    for axis in AXES:
        hit = hit & (F.col(f"{a}{axis}0") - gap <= F.col(f"{b}{axis}1")) & (F.col(f"{a}{axis}1") + gap >= F.col(f"{b}{axis}0"))
    return hit


def vector(prefix: str, index: int) -> Vector:
    return tuple(F.col(f"{prefix}{axis}{index}").cast("double") for axis in AXES)  # type: ignore[return-value]


def minus(a: Vector, b: Vector) -> Vector:
    return (a[0] - b[0], a[1] - b[1], a[2] - b[2])


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def squared(a: Vector) -> Column:
    return dot(a, a)


def norm(a: Vector) -> Column:
    return F.sqrt(squared(a))


def midpoint(a: Vector, b: Vector) -> Vector:
    return ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2, (a[2] + b[2]) / 2)


def affine(matrix: list[float], p: Vector) -> Vector:
    """A column-major 4x4 matrix applied to a point."""
    return tuple(matrix[i] * p[0] + matrix[4 + i] * p[1] + matrix[8 + i] * p[2] + matrix[12 + i] for i in range(3))  # type: ignore[return-value]


def _segments(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which triangle pairs cross, by their corners (three arrays of rows x, y, z a side), and of these seg_len and the middle (3 rows)."""
    put = lambda v: tuple(v[:, k] for k in range(3))
    pa_, pb_ = [put(v) for v in a], [put(v) for v in b]
    na, nb = cross(minus(pa_[1], pa_[0]), minus(pa_[2], pa_[0])), cross(minus(pb_[1], pb_[0]), minus(pb_[2], pb_[0]))
    line = cross(na, nb)
    ll = squared(line)
    ok = (squared(na) >= DEGENERATE) & (squared(nb) >= DEGENERATE) & (ll >= COPLANAR)

    def interval(corners: list, n: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d, p = [dot(n, c) - dot(n, other) for c in corners], [dot(line, c) for c in corners]
        low, high, hits = np.full(len(ll), np.inf), np.full(len(ll), -np.inf), np.zeros(len(ll), dtype=int)
        for i, j in ((0, 1), (0, 2), (1, 2)):
            cut = d[i] * d[j] < 0
            at = p[i] + (p[j] - p[i]) * (d[i] / (d[i] - d[j]))
            low, high, hits = np.where(cut, np.minimum(low, at), low), np.where(cut, np.maximum(high, at), high), hits + cut
        return low, high, hits >= 2

    (la, ha, ca), (lb, hb, cb) = interval(pa_, nb, pb_[0]), interval(pb_, na, pa_[0])
    lo, hi = np.maximum(la, lb), np.minimum(ha, hb)
    ok = ok & ca & cb & (lo < hi)
    # the middle: the line's point with these two plane distances, moved along the line
    of = lambda v: tuple(c[ok] for c in v)
    na, nb, line, ll, lo, hi, p0, q0 = of(na), of(nb), of(line), ll[ok], lo[ok], hi[ok], of(pa_[0]), of(pb_[0])
    u, v, da, db = cross(nb, line), cross(line, na), dot(na, p0), dot(nb, q0)
    return ok, (hi - lo) / np.sqrt(ll), np.stack([(da * u[k] + db * v[k] + line[k] * (lo + hi) / 2) / ll for k in range(3)])


def triangle_segments(df: DataFrame, a: str = "a_", b: str = "b_") -> DataFrame:
    """Rows whose triangles {a}x0..z2 and {b}x0..z2 cross, with seg_len and the segment's middle (mid_x, mid_y, mid_z).

    The interval test: each triangle's edges that strictly cross the other's plane give an interval on the common line;
    the intervals' overlap is the contact. Coplanar, degenerate and merely touching triangles do not cross, nor do ones with
    a missing corner. Tested in Arrow batches, a whole batch in each step.
    """
    corners = [[f"{side}{axis}{i}" for axis in AXES] for side in (a, b) for i in range(3)]
    found = ("seg_len", *(f"mid_{axis}" for axis in AXES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in corner], axis=1) for corner in corners]
            with np.errstate(all="ignore"):  # nulls are NaN, and compare as false
                ok, length, middle = _segments(points[:3], points[3:])
            kept = batch.filter(pa.array(ok))
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(length), *(pa.array(m) for m in middle)], [*kept.schema.names, *found])

    kinds = StructType([*df.schema.fields, *(StructField(c, DoubleType()) for c in found)])
    return df.mapInArrow(run, kinds)


def plane_cut(df: DataFrame, height: float) -> DataFrame:
    """Segments where the triangles x0..z2 strictly cross the horizontal plane y = height, as sheet coordinates (-x, z)."""
    keep = [c for c in df.columns if c[:-1] not in AXES or not c[-1].isdigit()]
    p = [vector("", i) for i in range(3)]

    def cut(i: int, j: int) -> Column:
        d0, d1 = p[i][1] - height, p[j][1] - height
        r = d0 / (d0 - d1)
        return F.when(d0 * d1 < 0, F.struct((-(p[i][0] + (p[j][0] - p[i][0]) * r)).alias("u"), (p[i][2] + (p[j][2] - p[i][2]) * r).alias("v")))

    out = df.withColumn("_c", F.filter(F.array(cut(0, 1), cut(0, 2), cut(1, 2)), lambda x: x.isNotNull())).where(F.size("_c") == 2)
    return out.select(*keep, F.col("_c")[0].u.alias("u0"), F.col("_c")[0].v.alias("v0"), F.col("_c")[1].u.alias("u1"), F.col("_c")[1].v.alias("v1"))

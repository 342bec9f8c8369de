"""Spatial joins over element boxes, triangles and vertices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.functions.geometry import AXES, box_overlap, cross, dot, minus, triangle_segments, vector

#: Contacts of a pair that the capped variant of ``mesh_intersections`` looks at.
MAX_CONTACTS = 72


#: Cells of a box's own grid along its level's greatest extent.
CELLS = 2


def _level(gap: float, cell: float) -> Column:
    """The size level of a box: 0 up to an extent of ``cell``, one more for each doubling."""
    extent = F.greatest(*((F.col(f"{a}1") - F.col(f"{a}0")).cast("double") for a in AXES)) + 2 * gap
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(1e-9)) / cell))).cast("int")


def _cells(df: DataFrame, gap: float, cell: float, levels: list[int], side: str) -> DataFrame:
    """A row for each key _k0 .. _k3 (level and cells, with marks) under which a box of side a or b meets others; the box is widened by ``gap``.

    A key ends with a mark that says which side gives it. Level: the greater of the two own levels, mark 0 if it is that of a
    (equal ones included). Axis: the cell of the greater of the two lower corners, mark 0 if it is that of a (or the same cell).
    So a box lies under its own value with its own side's mark, and under those from it on with the other side's.
    """
    first = side == "a"
    own = _level(gap, cell)
    above = F.filter(F.array(*map(F.lit, levels)), lambda x: x > own if first else x >= own)
    out = df.withColumn("_own", own)
    mark = lambda x, k: x * 2 + k
    places = F.concat(F.array(mark(own, 0 if first else 1)), F.transform(above, lambda x: mark(x, 1 if first else 0)))
    out = out.withColumn("_k0", F.explode(places))
    size, wide = F.pow(F.lit(2.0), F.floor(F.col("_k0") / 2)) * (cell / CELLS), gap if first else 0
    out = out.withColumns({f"_lo{a}": F.floor((F.col(f"{a}0") - wide) / size) for a in AXES} | {f"_hi{a}": F.floor((F.col(f"{a}1") + wide) / size) for a in AXES})
    arrays = {}
    for i, a in enumerate(AXES, 1):
        low, high = F.col(f"_lo{a}"), F.greatest(f"_lo{a}", f"_hi{a}")
        later = F.when(high > low, F.sequence(mark(low + 1, 1), mark(high, 1), F.lit(2))).otherwise(F.array().cast("array<bigint>"))
        arrays[f"_k{i}"] = F.concat(F.array(mark(low, 0)), later) if first else F.concat(F.sequence(mark(low, 0), mark(high, 0), F.lit(2)), F.array(mark(low, 1)))
    out = out.withColumns(arrays).drop(*(f"_{p}{a}" for p in ("lo", "hi") for a in AXES), "_own")
    for k in arrays:
        out = out.withColumn(k, F.explode(k))
    return out.withColumn("_k", F.xxhash64("_k0", *arrays))


def box_join(left: DataFrame, right: DataFrame, gap: float = 0, cell: float = 3000, condition: Column | None = None) -> DataFrame:
    """Pairs of rows whose boxes (x0 .. z1) overlap, inclusively, each side widened by ``gap``; columns a_* and b_*.

    One grid-cell equi-join: a box lies on the grid of its own size level, whose cells are a ``CELLS``-th of its extent at least,
    so it touches few cells however large it is, and meets smaller boxes on its own grid. The keys are such that a pair whose
    cells meet comes under one key only, that of the greater of the two lower corners: nothing needs a distinct, and pairs that
    share further cells are not compared there again. Both sides are shuffled, never broadcast from the driver.
    """
    level = _level(gap, cell).alias("level")
    sides = left.select(level) if left is right else left.select(level).union(right.select(level))
    levels = sorted(r.level for r in sides.distinct().collect() if r.level is not None)  # some tens at most
    # a box becomes some tens of rows: a table in one file is dealt out before
    spark = left.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    a, b = (_cells(d.repartition(tasks), gap, cell, levels, p) for d, p in ((left, "a"), (right, "b")))
    a, b = (d.select(*(F.col(c).alias(f"{p}_{c}") for c in d.columns)) for d, p in ((a, "a"), (b, "b")))
    # the hash comes first, so that sorting by it is fast
    on = [F.col(f"a__{k}") == F.col(f"b__{k}") for k in ("k", "k0", "k1", "k2", "k3")]
    # a plan's sizes are those before a box becomes many rows: by them, a large side would be broadcast
    out = a.hint("merge").join(b, on).where(box_overlap("a_", "b_", gap)).select(*(f"a_{c}" for c in left.columns), *(f"b_{c}" for c in right.columns))
    return out if condition is None else out.where(condition)


def in_scope(models_a: list[str] | None = None, models_b: list[str] | None = None, exclude_self: bool = True, excluded_pairs: list[tuple[str, str]] = ()) -> Column:
    """Which pairs a detection run looks at: model sides, self clashes, excluded type pairs. Each pair once, by pos."""
    a_in = F.lit(True) if models_a is None else F.col("a_model_id").isin(models_a)
    b_in = F.lit(True) if models_b is None else F.col("b_model_id").isin(models_b)
    a_in2 = F.lit(True) if models_a is None else F.col("b_model_id").isin(models_a)
    b_in2 = F.lit(True) if models_b is None else F.col("a_model_id").isin(models_b)
    ok = (F.col("a_pos") < F.col("b_pos")) & ((a_in & b_in) | (a_in2 & b_in2))
    if exclude_self:
        ok = ok & (F.col("a_model_id") != F.col("b_model_id"))
    return ok & allowed_types(excluded_pairs)


def allowed_types(excluded_pairs: list[tuple[str, str]]) -> Column:
    """Whether a pair's types are none of the excluded pairs, in either order; an element without a type is in none."""
    a, b, ok = F.col("a_ifc_type"), F.col("b_ifc_type"), F.lit(True)
    for x, y in excluded_pairs:
        ok = ok & ~F.coalesce(((a == x) & (b == y)) | ((a == y) & (b == x)), F.lit(False))
    return ok


def detect_boxes(elements: DataFrame, gap: float = 0, cell: float = 3000, **scope) -> DataFrame:
    """Element pairs whose boxes overlap or come within ``gap``."""
    return box_join(elements, elements, gap, cell, in_scope(**scope))


def triangle_boxes(triangles: DataFrame) -> DataFrame:
    """Triangles t0 .. with their boxes as x0 .. z1; the corners move to p_x0 .. p_z2."""
    corners = {f"p_{a}{i}": F.col(f"{a}{i}") for a in AXES for i in range(3)}
    out = triangles.withColumns(corners)
    lows = {f"{a}0": F.least(*(F.col(f"p_{a}{i}") for i in range(3))) for a in AXES}
    highs = {f"{a}1": F.greatest(*(F.col(f"p_{a}{i}") for i in range(3))) for a in AXES}
    return out.withColumns(lows | highs).drop(*(f"{a}2" for a in AXES))


#: A triangle's plane: its normal, and that times a corner.
_PLANE = ("_nx", "_ny", "_nz", "_nd")


def _planes(boxes: DataFrame) -> DataFrame:
    """``triangle_boxes`` with each triangle's plane, by the same steps as in ``triangle_segments``."""
    p = [vector("p_", i) for i in range(3)]
    normal = cross(minus(p[1], p[0]), minus(p[2], p[0]))
    return boxes.withColumns(dict(zip(_PLANE, (*normal, dot(normal, p[0])), strict=True)))


def _astride(a: str, b: str) -> Column:
    """Whether triangle ``b`` has corners on both sides of the plane of ``a``: without, no edges of it cross that plane."""
    n, at = tuple(F.col(f"{a}{k}") for k in _PLANE[:3]), F.col(f"{a}{_PLANE[3]}")
    d = [dot(n, vector(f"{b}p_", i)) - at for i in range(3)]
    return (F.least(*d) < 0) & (F.greatest(*d) > 0)


def triangle_contacts(left: DataFrame, right: DataFrame, cell: float = 3000, condition: Column | None = None) -> DataFrame:
    """Crossing triangle pairs with seg_len and mid_x, mid_y, mid_z: a grid join of triangle boxes that lie astride each other's planes, then the exact test."""
    astride = _astride("a_", "b_") & _astride("b_", "a_")
    pairs = box_join(_planes(triangle_boxes(left)), _planes(triangle_boxes(right)), 0, cell, astride if condition is None else condition & astride)
    plain = [c for c in pairs.columns if not any(c in (f"{s}_{a}{i}", f"{s}_p_{a}{i}", *(f"{s}_{n}" for n in _PLANE)) for s in "ab" for a in AXES for i in range(3))]
    corners = [F.col(f"{s}_p_{a}{i}").alias(f"{s}_{a}{i}") for s in "ab" for a in AXES for i in range(3)]
    return triangle_segments(pairs.select(*plain, *corners))


def mesh_intersections(left: DataFrame, right: DataFrame, cell: float = 3000, condition: Column | None = None, max_contacts: int | None = None) -> DataFrame:
    """Per element pair: n_contacts, the mean contact point and max_segment_len. With ``max_contacts`` only that many contacts count, in triangle order."""
    contacts = triangle_contacts(left, right, cell, condition)
    keys = ["a_model_id", "a_express_id", "b_model_id", "b_express_id"]
    if max_contacts is not None:
        contacts = contacts.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("a_tri_idx", "b_tri_idx"))).where(F.col("_n") <= max_contacts)
    return contacts.groupBy(*keys).agg(
        F.count("*").alias("n_contacts"), F.avg("mid_x").alias("cx"), F.avg("mid_y").alias("cy"), F.avg("mid_z").alias("cz"), F.max("seg_len").alias("max_segment_len")
    )


def sample_points(points: DataFrame, keys: list[str] = ("pair",), full: int = 10_000) -> DataFrame:
    """Every n-th point (by idx, from 0) of the keys with more than ``full`` points, n = points // full + 1; all points of the others. Sampling is the feature."""
    sizes = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    step = F.when(F.col("_n") > full, F.floor(F.col("_n") / full) + 1).otherwise(1)
    return points.join(sizes, list(keys)).where(F.col("idx") % step == 0).drop("_n")


#: Points of a key on side b up to which all of them are compared, without cells.
FEW_POINTS = 64


def min_distance(points_a: DataFrame, points_b: DataFrame, max_dist: float, keys: list[str] = ("pair",), sample: bool = False) -> DataFrame:
    """Per key the least distance between a point of either side, if it is at most ``max_dist`` (inclusive), with both points.

    One side is put into the 27 cells around each of its points, the other into its own cell: an equi-join, and exact,
    since points within ``max_dist`` are in neighbouring cells; keys with at most ``FEW_POINTS`` points on that side are joined
    without cells. Both sides are shuffled, never broadcast. ``sample`` thins large meshes of side a as ``sample_points`` does.
    """
    size = max(max_dist, 0.02)
    keys = list(keys)
    if sample:
        points_a = sample_points(points_a, keys)
    # the points of a small mesh need no cells: all of a key are compared with them
    few = points_b.groupBy(*keys).agg((F.count(F.lit(1)) <= FEW_POINTS).alias("few"))
    points_a, points_b = (p.select(*keys, *AXES).join(few.hint("shuffle_hash"), keys) for p in (points_a, points_b))
    at = lambda k: F.floor(F.col(k) / size)
    a = points_a.select(*keys, *(F.col(k).alias(f"a{k}") for k in AXES), *(F.when(F.col("few"), 0).otherwise(at(k)).alias(f"c{k}") for k in AXES))
    b = points_b.select(*keys, *(F.col(k).alias(f"b{k}") for k in AXES), *(F.when(F.col("few"), F.array(F.lit(0).cast("bigint"))).otherwise(F.array(*(at(k) + d for d in (-1, 0, 1)))).alias(f"c{k}") for k in AXES))
    for k in AXES:
        b = b.withColumn(f"c{k}", F.explode(f"c{k}"))
    b = b.hint("shuffle_hash")
    near = a.join(b, [*keys, "cx", "cy", "cz"]).withColumn("d2", sum(((F.col(f"a{k}") - F.col(f"b{k}")) ** 2 for k in AXES[1:]), (F.col("ax") - F.col("bx")) ** 2))
    points = [f"{s}{k}" for s in "ab" for k in AXES]
    best = near.where(F.col("d2") <= max_dist * max_dist).groupBy(*keys).agg(F.min(F.struct("d2", *points)).alias("m"))
    return best.select(*keys, F.sqrt("m.d2").alias("distance"), *(F.col(f"m.{p}").alias(p) for p in points))


def duplicate_geometry(elements: DataFrame, decimals: int = 0) -> DataFrame:
    """Groups of elements with the same type and rounded box: n, first_id and last_id. Groups are counted, not expanded into pairs."""
    box = [F.round(f"{a}{i}", decimals).alias(f"{a}{i}") for a in AXES for i in (0, 1)]
    rounded = elements.select("ifc_type", "express_id", *box)
    return rounded.groupBy("ifc_type", *(f"{a}{i}" for a in AXES for i in (0, 1))).agg(F.count("*").alias("n"), F.min("express_id").alias("first_id"), F.max("express_id").alias("last_id")).where("n > 1")


def _same_place(decimals: int) -> list[Column]:
    return [F.col("ifc_type"), *(F.round(f"{a}{i}", decimals) for a in AXES for i in (0, 1))]


def same_geometry(decimals: int = 0) -> Column:
    """Whether the elements of a pair (a_*, b_*) have the same type, or none, and the same rounded box."""
    out = F.col("a_ifc_type").eqNullSafe(F.col("b_ifc_type"))
    for k in (f"{a}{i}" for a in AXES for i in (0, 1)):
        out = out & F.round(f"a_{k}", decimals).eqNullSafe(F.round(f"b_{k}", decimals))
    return out


def duplicate_pairs(elements: DataFrame, decimals: int = 0, models_a: list[str] | None = None, models_b: list[str] | None = None, exclude_self: bool = True) -> DataFrame:
    """Pairs a_*, b_* of elements with the same type and rounded box, each element with the first one (by pos) of its group that it may be paired with.

    A group of n gives fewer than 2 n pairs, not all of them. With ``exclude_self`` the partner is of another model: the
    group's first element, or else the first one of another model than that.
    """
    columns = elements.columns
    row = F.struct(*columns)
    keyed = elements.select(*(k.alias(f"_k{i}") for i, k in enumerate(_same_place(decimals))), row.alias("x"))
    keys = [c for c in keyed.columns if c != "x"]
    crowds = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    on = lambda left, right: [left[k].eqNullSafe(right[k]) for k in keys]
    keyed = keyed.alias("e").join(crowds.alias("c"), on(keyed, crowds), "left_semi")
    within = lambda models: keyed if models is None else keyed.where(F.col("x.model_id").isin(models))

    def partners(side: DataFrame) -> DataFrame:
        first = side.groupBy(*keys).agg(F.min_by("x", "x.pos").alias("p1"))
        if not exclude_self:
            return first.withColumn("p2", F.lit(None).cast(first.schema["p1"].dataType))
        f = first.select(*(F.col(k).alias(f"f{k}") for k in keys), F.col("p1"))
        others = side.join(f, reduce(lambda a, b: a & b, (side[k].eqNullSafe(F.col(f"f{k}")) for k in keys))).where("x.model_id != p1.model_id")
        second = others.groupBy(*keys).agg(F.min_by("x", "x.pos").alias("p2")).select(*(F.col(k).alias(f"s{k}") for k in keys), "p2")
        return first.join(second, reduce(lambda a, b: a & b, (first[k].eqNullSafe(F.col(f"s{k}")) for k in keys)), "left").select(*keys, "p1", "p2")

    def pairs(of: DataFrame, with_side: DataFrame) -> DataFrame:
        p = partners(with_side).select(*(F.col(k).alias(f"p{k}") for k in keys), "p1", "p2")
        met = of.join(p, reduce(lambda a, b: a & b, (of[k].eqNullSafe(F.col(f"p{k}")) for k in keys)))
        fits = (F.col("p1.model_id") != F.col("x.model_id")) if exclude_self else (F.col("p1.pos") != F.col("x.pos"))
        return met.select("x", F.when(fits, F.col("p1")).otherwise(F.col("p2")).alias("y")).where("y is not null")

    both = pairs(within(models_b), within(models_a))
    if models_a != models_b:
        both = both.unionByName(pairs(within(models_a), within(models_b)))
    before = F.col("x.pos") < F.col("y.pos")
    ordered = both.select(F.when(before, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(before, F.col("y")).otherwise(F.col("x")).alias("b")).dropDuplicates()
    return ordered.select(*(F.col(f"a.{c}").alias(f"a_{c}") for c in columns), *(F.col(f"b.{c}").alias(f"b_{c}") for c in columns))


def model_bounds(elements: DataFrame) -> DataFrame:
    """Per model: least and greatest corner, centre and size."""
    lows = [F.min(f"{a}0").alias(f"min_{a}") for a in AXES]
    highs = [F.max(f"{a}1").alias(f"max_{a}") for a in AXES]
    out = elements.groupBy("model_id").agg(*lows, *highs)
    return out.withColumns({f"center_{a}": (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in AXES} | {f"size_{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES})


def drop_related(pairs: DataFrame, related: DataFrame) -> DataFrame:
    """Without the pairs whose global ids are host and part of each other (gid_a, gid_b), in either order."""
    key = lambda a, b: (F.least(a, b), F.greatest(a, b))
    lo, hi = key(F.col("gid_a"), F.col("gid_b"))
    marks = related.select(lo.alias("_lo"), hi.alias("_hi")).distinct()
    plo, phi = key(F.col("a_global_id"), F.col("b_global_id"))
    return pairs.join(marks, (plo == marks._lo) & (phi == marks._hi), "left_anti")


def drop_denied(pairs: DataFrame, denied: DataFrame, radius: float = 150) -> DataFrame:
    """Without the pairs that were denied before (gid_a, gid_b, x, y, z) within ``radius`` of where they are now (x, y, z)."""
    near = sum(((F.col(k) - F.col(f"_d{k}")) ** 2 for k in AXES[1:]), (F.col("x") - F.col("_dx")) ** 2) <= radius * radius
    marks = denied.select(F.least("gid_a", "gid_b").alias("_lo"), F.greatest("gid_a", "gid_b").alias("_hi"), *(F.col(k).alias(f"_d{k}") for k in AXES))
    same = (F.least("a_global_id", "b_global_id") == F.col("_lo")) & (F.greatest("a_global_id", "b_global_id") == F.col("_hi"))
    return pairs.join(marks, same & near, "left_anti")


def drop_parallel(pairs: DataFrame, cosine: float = 0.999, lateral: float = 50) -> DataFrame:
    """Without long parallel elements that lie side by side: axes (a_ax, a_ay, a_az, b_..) within ``cosine`` and centres more than ``lateral`` apart across the axis."""
    along = sum((F.col(f"a_a{k}") * F.col(f"b_a{k}") for k in AXES[1:]), F.col("a_ax") * F.col("b_ax"))
    apart = [F.col(f"a_c{k}") - F.col(f"b_c{k}") for k in AXES]
    on_axis = sum((d * F.col(f"a_a{k}") for d, k in zip(apart[1:], AXES[1:], strict=True)), apart[0] * F.col("a_ax"))
    across = F.sqrt(F.greatest(F.lit(0.0), sum((d * d for d in apart[1:]), apart[0] * apart[0]) - on_axis * on_axis))
    return pairs.where(~((F.abs(along) > cosine) & (across > lateral)))


def within_tolerance(pairs: DataFrame, tolerances: DataFrame, min_volume: float = 0) -> DataFrame:
    """Pairs above the overlap-volume gate and above the tolerance of their type pair (pair_key 'A:B' sorted, tolerance_mm)."""
    key = F.concat_ws(":", F.least("a_ifc_type", "b_ifc_type"), F.greatest("a_ifc_type", "b_ifc_type"))
    joined = pairs.withColumn("pair_key", key).join(tolerances, "pair_key", "left")
    return joined.where((F.col("overlap_volume") >= min_volume) & (F.col("depth_mm") > F.coalesce("tolerance_mm", F.lit(0))))


def overlap_box(pairs: DataFrame) -> DataFrame:
    """Pairs with overlap_volume and depth_mm (the shallowest side) of their common box."""
    side = {k: F.greatest(F.lit(0), F.least(f"a_{k}1", f"b_{k}1") - F.greatest(f"a_{k}0", f"b_{k}0")) for k in AXES}
    volume = side["x"].cast("double") * side["y"] * side["z"]
    return pairs.withColumns({"overlap_volume": volume, "depth_mm": F.least(*side.values())})

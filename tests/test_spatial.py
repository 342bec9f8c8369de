import math
import random

from pyspark.sql import functions as F

from coordspark.functions import text
from coordspark.operators import cluster, spatial

A = (0, 0, 0, 1, 0, 0, 0, 1, 0)
CORNERS = [f"{a}{i}" for i in range(3) for a in "xyz"]


def triangles(spark, rows):
    return spark.createDataFrame([("M", i, 0, *map(float, r)) for i, r in enumerate(rows)], "model_id string, express_id int, tri_idx int, " + ", ".join(f"{c} double" for c in CORNERS))


def contacts(spark, left, right):
    return spatial.triangle_contacts(triangles(spark, [left]), triangles(spark, [right]), 1).collect()


def test_crossing_triangles(spark):
    assert len(contacts(spark, A, (0.2, 0.2, -1, 0.8, 0.2, -1, 0.5, 0.2, 1))) == 1
    row = contacts(spark, (0, 0, 0, 2, 0, 0, 1, 2, 0), (0.5, 0.5, -1, 1.5, 0.5, -1, 1, 0.5, 1))[0]
    assert math.isclose(row.seg_len, 0.5)
    assert math.isclose(row.mid_x, 1) and math.isclose(row.mid_y, 0.5) and math.isclose(row.mid_z, 0, abs_tol=1e-12)


def test_no_contact(spark):
    lifted = tuple(v + (i % 3 == 2) for i, v in enumerate(A))
    for other in (tuple(v + 10 for v in A), lifted, A, (5, 5, 5) * 3, (0, 0, 0, -1, 0, 0, 0, -1, 0), (0.2, 0.2, 0, 0.8, 0.2, 1, 0.2, 0.8, 1)):
        assert contacts(spark, A, other) == []


def test_contact_is_symmetric(spark):
    rng = random.Random(3)
    rows = [[rng.uniform(0, 3) for _ in range(9)] for _ in range(40)]
    t = triangles(spark, rows)
    found = spatial.triangle_contacts(t, t, 1).where("a_express_id <> b_express_id")
    pairs = {(r.a_express_id, r.b_express_id): round(r.seg_len, 9) for r in found.collect()}
    assert pairs and all(pairs.get((b, a)) == length for (a, b), length in pairs.items())


def test_grid_join_equals_theta_join(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        x, y, z = (rng.randrange(-5000, 5000) for _ in range(3))
        size = rng.choice([0, 10, 300, 2500, 9000])
        rows.append((i, x, y, z, x + size, y + rng.randrange(1, 900), z + size))
    df = spark.createDataFrame(rows, "id int, x0 int, y0 int, z0 int, x1 int, y1 int, z1 int")
    for gap in (0, 50):
        got = sorted((r.a_id, r.b_id) for r in spatial.box_join(df, df, gap, 500, F.col("a_id") < F.col("b_id")).collect())
        want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and all(a[k] - gap <= b[k + 3] and a[k + 3] + gap >= b[k] for k in (1, 2, 3)))
        assert got == want


def test_min_distance(spark):
    a = [(0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)]
    b = [(0, 0.0, 0.0, 0.1), (1, 100.0, 100.0, 100.0), (2, 1.0, 0.0, 0.0)]
    frame = lambda rows: spark.createDataFrame(rows, "pair int, x double, y double, z double")
    got = {r.pair: r.distance for r in spatial.min_distance(frame(a), frame(b), 1.0).collect()}
    assert set(got) == {0, 2} and math.isclose(got[0], 0.1) and got[2] == 1.0  # the threshold is inclusive
    assert spatial.min_distance(frame([]), frame(b), 1.0).collect() == []


def test_clusters_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, "t", "L", *(float(rng.randrange(0, 60)) for _ in range(3))) for i in range(150)]
    got = {r.id: r.cluster for r in cluster.clusters(spark.createDataFrame(rows, "id int, type_pair string, storey string, x double, y double, z double"), 9).collect()}
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p in rows:
        for q in rows:
            if sum((u - v) ** 2 for u, v in zip(p[3:], q[3:], strict=True)) <= 81:
                a, b = find(p[0]), find(q[0])
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in root}


def test_questions(spark):
    texts = ["what 's the BCF format", "What's new", "how to export", "is there a clash", "hide all walls", "what can I do", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.is_question("t").alias("q")).orderBy("i").collect()
    assert [r.q for r in rows] == [True, True, True, True, False, True, False]

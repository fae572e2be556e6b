import math
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoremap.functions import geometry as G
from scoremap.operators import layers as L
from scoremap.operators.pick import _over_shapes, _small, pick, pick_top
from scoremap.operators.simplify import EdgeGrid, _crosses, simplify, simplify_polys, simplify_ring
from scoremap.sources import literals


def parse(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["g"] for r in rows.select("i", G.wkt_to_geom(F.col("t")).alias("g")).orderBy("i").collect()]


def test_wkt_kinds(spark):
    good = ["POLYGON ((0 0, 1 0, 1 1, 0 0))", "multipolygon (((0 0, 1e1 0, 1 -1.5, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.1 5.1, 5.2 5.1, 5.2 5.2, 5.1 5.1)))", "POLYGON EMPTY"]
    bad = [None, "", "garbage", "POLYGON ((0 0, 1 0", "POINT (1 2)", "POLYGON ((0 0 1, 1 0 1, 1 1 1, 0 0 1))", "POLYGON ((0 0, 1 0, 1 1, 0 1))", "POLYGON ((0 0, 1 0, 0 0))", "POLYGON ((a b, 1 0, 1 1, 0 0))"]
    got = parse(spark, good + bad)
    assert [g["type"] for g in got[:3]] == ["Polygon", "MultiPolygon", "Polygon"]
    assert got[1]["polys"][0][0][1]["x"] == 10.0 and len(got[1]["polys"][1]) == 2 and got[2]["polys"] == []
    assert got[3:] == [None] * len(bad)


def test_projection_origin_and_sites(spark):
    rows = [(-74.0, 40 + 10 / 60)] + [(s[3], s[2]) for s in literals.SITES]
    x, y = G.project_xy(F.col("lon"), F.col("lat"))
    got = spark.createDataFrame(rows, "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert abs(got[0]["x"] - 984250.0) < 1e-6 and abs(got[0]["y"]) < 1e-6
    assert abs(got[1]["x"] - 1015490.622) < 0.01 and abs(got[4]["y"] - 211586.217) < 0.01


def test_projection_round_trip_and_srid(spark):
    box = spark.createDataFrame([("POLYGON ((-74 40.5, -73.7 40.5, -73.7 40.9, -74 40.5))",)], "t string")
    g = G.wkt_to_geom(F.col("t"), 4326)
    back = box.select(g.alias("a"), G.unproject(G.project(g)).alias("b"), G.project(G.project(g))["srid"].alias("s")).first()
    for p, q in zip(back["a"]["polys"][0][0], back["b"]["polys"][0][0]):
        assert abs(p["x"] - q["x"]) < 1e-10 and abs(p["y"] - q["y"]) < 1e-10
    assert back["s"] == 2263
    with pytest.raises(Exception, match="SRID"):
        box.select(G.project(G.wkt_to_geom(F.col("t"), 3857))).collect()


def test_buffer_and_domes(spark):
    b = spark.createDataFrame([(5.0,), (0.0,), (-3.0,)], "r double").select(G.buffer_point(F.lit(1.0), F.lit(2.0), F.col("r")).alias("g")).collect()
    ring = b[0]["g"]["polys"][0][0]
    assert len(ring) == 65 and ring[0] == ring[-1]
    assert all(abs(math.hypot(v["x"] - 1, v["y"] - 2) - 5) < 1e-9 for v in ring)
    assert b[1]["g"]["polys"] == [] and b[2]["g"]["polys"] == []
    sites = literals.sites(spark)
    assert L.dome_planar(sites).count() == 28 and L.dome_planar(sites, keep_empty=True).count() == 60
    assert L.dome_geographic(sites).count() == 60
    assert L.vertices(L.dome_geographic(sites).select("ordinal", "level", "geometry")).groupBy("ordinal", "level").count().where("count <> 33").isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=3, max_size=25), st.sampled_from([0.0, 1.0, 5.0, 20.0]))
def test_simplify_ring(points, tolerance):
    ring = np.array([*points, points[0]], float)
    out = simplify_ring(ring, tolerance, EdgeGrid([ring]))
    assert len(out) >= 4 and (out[0] == out[-1]).all()
    rows = ring.tolist()
    at = -1
    for v in out.tolist():  # a subset in order
        at = rows.index(v, at + 1)
    if tolerance == 0:
        assert len(out) == len(ring)
    for v in ring:  # within the tolerance of what is left
        a, b = out[:-1], out[1:]
        d = b - a
        n = (d**2).sum(axis=1)
        t = np.clip(((v - a) * d).sum(axis=1) / np.where(n > 0, n, 1), 0, 1)
        assert np.sqrt((((a + t[:, None] * d) - v) ** 2).sum(axis=1)).min() <= tolerance + 1e-9


def test_simplify_column(spark):
    t = "POLYGON ((0 0, 5 0.1, 10 0, 10 10, 0 10, 0 0))"
    two = "MULTIPOLYGON (((0 0, 5 0.1, 10 0, 10 10, 0 10, 0 0), (1 1, 2 1, 2 2, 1 1)), ((20 0, 25 0, 30 0, 30 10, 20 0)))"
    texts = [t, None, two, "POLYGON EMPTY", t]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    rows = {r["i"]: r["g"] for r in frame.select("i", simplify(G.wkt_to_geom(F.col("t")), 2.0).alias("g")).collect()}
    assert len(rows[0]["polys"][0][0]) == 5 and rows[1] is None and rows[3]["polys"] == [] and rows[4] == rows[0]
    assert [[len(ring) for ring in poly] for poly in rows[2]["polys"]] == [[5, 4], [4]]
    assert [(v["x"], v["y"]) for v in rows[2]["polys"][0][0]] == [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]


def test_pick_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-20, 120, (300, 2)))]
    disks = [(j, float(x), float(y), float(r)) for j, (x, y, r) in enumerate(zip(rng.uniform(0, 100, 20), rng.uniform(0, 100, 20), rng.uniform(0.5, 60, 20)))]
    p = spark.createDataFrame(pts + [(999, None, 1.0)], "point_id int, x double, y double")
    f = spark.createDataFrame(disks, "feature_id int, cx double, cy double, r double").select("feature_id", G.buffer_point(F.col("cx"), F.col("cy"), F.col("r"), 4).alias("geometry"))
    got = {tuple(r) for r in pick(p, f, 7.0).collect()}
    every = {tuple(r) for r in p.where("x is not null").join(f, G.inside(F.col("x"), F.col("y"), F.col("geometry")["polys"])).select("point_id", "feature_id").collect()}
    assert got == every and got


def test_edges_in_slabs_equal_the_ring_test(spark):
    """Every feature by edges: stars, long thin triangles, holes, parts, repeated points."""
    rng = np.random.default_rng(7)
    rows = []
    for j in range(25):
        n, c = int(rng.integers(3, 400)), rng.uniform(0, 100, 2)
        angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
        v = (c + (rng.uniform(1, 40, n) * [np.cos(angle), np.sin(angle)]).T).round(int(rng.integers(0, 3))).tolist()
        hole = (c + np.array([[1, 1], [2, 1], [2, 2], [1, 1]])).tolist()
        rows.append((j, [[[*v, v[0]], hole], [hole]] if j % 3 else [[[*v, v[0]]]]))
    rows += [(90, []), (91, None), (92, [[[[0.0, 0.0], [100.0, 0.0], [50.0, 0.0], [0.0, 0.0]]]])]
    polys = [(j, None if p is None else ("MultiPolygon", 2263, [[[(float(x), float(y)) for x, y in r] for r in rings] for rings in p])) for j, p in rows]
    f = spark.createDataFrame(polys, f"feature_id int, geometry {G.GEOM}")
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-10, 110, (250, 2)).round(1))]
    p = spark.createDataFrame(pts + pts[:9] + [(999, None, 1.0), (998, 1.0, None)], "point_id int, x double, y double")
    got = sorted(tuple(r) for r in pick(p, f, 7.0, whole=0).collect())
    assert got == sorted(tuple(r) for r in p.join(f, G.inside(F.col("x"), F.col("y"), F.col("geometry")["polys"])).select("point_id", "feature_id").collect())
    assert got == sorted(tuple(r) for r in pick(p, f, 7.0).collect()) and len(got) > len(set(got))


def test_pick_top(spark):
    square = lambda x, s: [[(float(a), float(b)) for a, b in ((x, 0), (x + s, 0), (x + s, s), (x, s), (x, 0))]]
    rows = [("areas", 9, False, 0, 100), ("walks", 1, True, 0, 50), ("walks", 1, True, 10, 50), ("sites", 2, True, 20, 10)]
    f = spark.createDataFrame([(f"{n} {k}", o, p, ("Polygon", 2263, [square(x, s)])) for k, (n, o, p, x, s) in enumerate(rows)], f"feature_id string, draw_order int, pickable boolean, geometry {G.GEOM}")
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 5.0), (3, 25.0, 5.0), (4, 80.0, 5.0), (5, 200.0, 5.0), (3, 25.0, 5.0)], "point_id int, x double, y double")
    assert sorted(map(tuple, pick_top(p, f, 8.0).collect())) == [(1, 1, "walks 1"), (2, 1, "walks 2"), (3, 2, "sites 3")]


def _copies(spark):
    """40 points at each of three places, two of them in the 50 copies of two disks."""
    p = spark.range(120).selectExpr("id AS point_id", "(id % 3) * 10.0D AS x", "0.0D AS y")
    k = F.col("feature_id")
    f = spark.range(100).withColumnRenamed("id", "feature_id")
    f = f.select("feature_id", (k % 3).alias("draw_order"), (k < 90).alias("pickable"), G.buffer_point(k % 2 * 10.0, F.lit(0.0), F.lit(3.0), 4).alias("geometry"))
    return p, f


def test_pick_tests_copies_once(spark):
    p, f = _copies(spark)
    small = _small(f.select(F.col("feature_id").alias("_f"), F.col("geometry")["polys"].alias("_polys")), 256)
    assert sorted(r["x"] for r in _over_shapes(p, small, 4.0).collect()) == [0.0, 10.0]
    got = sorted(map(tuple, pick(p, f, 4.0).collect()))
    assert got == [(i, k) for i in range(120) if i % 3 < 2 for k in range(100) if k % 2 == i % 3]


def test_pick_top_of_copies(spark):
    """Also where copies are tested edge by edge; the last drawn of equal shapes counts."""
    p, f = _copies(spark)
    expected = [(i, 2, (86, 89)[i % 3]) for i in range(120) if i % 3 < 2]
    assert sorted(map(tuple, pick_top(p, f, 4.0).collect())) == expected
    assert sorted(map(tuple, pick_top(p, f, 4.0, whole=0).collect())) == expected


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 4), st.sampled_from([0, 1, 8]))
def test_the_grid_finds_all_crossings(seed, n_rings, digits):
    rng = np.random.default_rng(seed)
    rings = []
    for _ in range(n_rings):
        v = (rng.uniform(0, 100, 2) + rng.uniform(-1, 1, (int(rng.integers(3, 60)), 2)) * 10.0 ** rng.integers(-2, 3)).round(digits)
        rings.append(np.vstack([v, v[:1]]))
    grid = EdgeGrid(rings)
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    for _ in range(30):
        p, q = rng.uniform(-20, 120, (2, 2)).round(digits)
        i, j = sorted(rng.integers(0, len(a) + 1, 2).tolist())
        apart = np.ones(len(a), bool)
        apart[i:j] = False
        assert grid.crossed(p, q, (i, j)) == _crosses(p, q, a[apart], b[apart])


def test_simplify_a_large_ring():
    """1e5 vertices with wiggles inside the tolerance: in seconds, and without crossings."""
    n = 100_000
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = 1000 + 200 * np.sin(9 * angle) + np.random.default_rng(2).uniform(-0.5, 0.5, n)
    ring = np.column_stack([r * np.cos(angle), r * np.sin(angle)])
    ring = np.vstack([ring, ring[:1]])
    began = time.time()
    out = simplify_ring(ring, 1.0, EdgeGrid([ring]))
    assert time.time() - began < 60 and 4 <= len(out) < n / 20
    edges = EdgeGrid([out])
    assert not any(edges.crossed(out[k], out[k + 1], (k, k + 1)) for k in range(len(out) - 1))


def test_small_geometries_are_simplified_together():
    """The same rings as one by one, whatever the geometries beside them; and quickly."""
    rng = np.random.default_rng(5)

    def ring():
        n = int(rng.integers(0, 12 if rng.random() < 0.9 else 90))
        v = rng.integers(0, 30, (n, 2)).astype(float) if rng.random() < 0.7 else rng.normal(size=(n, 2)) * 20
        v = v * 0 + 3 if rng.random() < 0.1 else v
        return [{"x": x, "y": y} for x, y in [*v.tolist(), *v[:1].tolist()]]

    rows = [None if rng.random() < 0.05 else [[ring() for _ in range(rng.integers(0, 4))] for _ in range(rng.integers(0, 3))] for _ in range(400)]
    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    for tolerance in (0.0, 2.0, 10.0, 1e9):
        got = simplify_polys(pa.array([[], *rows], kind).slice(1), tolerance).to_pylist()
        for before, after in zip(rows, got, strict=True):
            if before is None:
                assert after is None
                continue
            rings = [np.array([(v["x"], v["y"]) for v in r]).reshape(-1, 2) for part in before for r in part]
            grid = EdgeGrid(rings)
            alone = [simplify_ring(r, tolerance, grid, int(grid.base[k])).tolist() for k, r in enumerate(rings)]
            assert alone == [[[v["x"], v["y"]] for v in r] for part in after for r in part]
    many = pa.array([[[[{"x": float(x), "y": float(y)} for x, y in rng.integers(0, 30, (7, 2))]]]] * 20_000, kind)
    began = time.time()
    simplify_polys(many, 10.0)
    assert time.time() - began < 3


def test_vertices_compute_a_geometry_once(spark):
    """No filter repeats the geometry; empty and null ones have no vertices."""
    sites = spark.createDataFrame([(1, "a", 40.7, -74.0)], "ordinal int, name string, lat double, lon double")
    out = L.vertices(L.dome_planar(sites, keep_empty=True))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("transform" in line for line in plan.splitlines() if "Filter" in line)
    assert out.count() == 7 * 65
    g = spark.createDataFrame([(1, None), (2, ("Polygon", 2263, []))], f"i int, geometry {G.GEOM}")
    assert L.vertices(g).count() == 0

"""Which feature lies under a point, by equi-joins on grid cells and slabs of edges.

Points first meet the bounding boxes of features in the cells of a grid, points of equal
coordinates and features of few vertices and equal shape once only. The ring test then takes the geometry along for features of few vertices; of those with more, edges
are rows of their own, in horizontal slabs of their feature, and a point meets the edges
of its slabs only: it lies inside if it crosses an odd number. So no large polygon
travels whole, and a feature of a million vertices is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremap.functions import geometry as G

#: Side of the finest cell is the unit; a feature uses the level at which its bounding
#: box is at most one cell wide, so it lies in four cells at most, however large.
LEVELS = 40
#: Features with more edges than this are tested edge by edge; about SLAB_EDGES short
#: edges lie in a slab. A longer edge uses a coarser slab, so it lies in two at most.
WHOLE, SLAB_EDGES = 256, 64


def _level(extent: Column, unit: Column) -> Column:
    """The power of two of ``unit`` that ``extent`` fits in."""
    return F.when(extent <= unit, 0).otherwise(F.least(F.ceil(F.log2(extent / unit)), F.lit(LEVELS))).cast("int")


def _edges(polys: Column) -> Column:
    """All edges of all rings that are not level."""
    of_ring = lambda r: F.transform(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), lambda a, k: F.struct(a.alias("a"), F.get(r, k + 1).alias("b")))
    every = F.flatten(F.transform(polys, lambda rings: F.flatten(F.transform(rings, of_ring))))
    return F.filter(every, lambda e: e["a"]["y"] != e["b"]["y"])


def _by_edges(met: DataFrame, large: DataFrame, point_id: str) -> DataFrame:
    """The candidates ``<point_id>, _f, x, y`` whose point is inside, by edges of ``large``
    (``_f, _polys, _b, _n``)."""
    unit = (F.col("_b.y1") - F.col("_b.y0")) / F.ceil(F.col("_n") / SLAB_EDGES)
    sized = large.withColumns({"_unit": unit, "_y0": F.col("_b.y0")}).where("_unit > 0")
    edges = sized.select("_f", "_unit", "_y0", F.inline(_edges(F.col("_polys")))).select("_f", "_unit", "_y0", "a.x", "a.y", F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    edges = edges.withColumn("_low", F.least("y", "by")).withColumn("_high", F.greatest("y", "by")).withColumn("_slab_level", _level(F.col("_high") - F.col("_low"), F.col("_unit")))
    height = F.col("_unit") * F.pow(F.lit(2.0), F.col("_slab_level"))
    slab = lambda y: F.floor((F.col(y) - F.col("_y0")) / height)
    placed = edges.withColumn("_slab", F.explode(F.sequence(slab("_low"), slab("_high")))).select("_f", "_slab_level", "_slab", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")
    levels = edges.groupBy("_f", "_unit", "_y0").agg(F.collect_set("_slab_level").alias("_levels"))
    # equal points of one id are tested once
    asked = met.groupBy(point_id, "x", "y", "_f").agg(F.count("*").alias("_times")).join(levels, "_f")
    probes = asked.withColumn("_slab_level", F.explode("_levels")).withColumn("_slab", slab("y")).drop("_levels", "_unit", "_y0")
    crossed = probes.join(placed, ["_f", "_slab_level", "_slab"])
    right = F.col("x") < F.try_divide((F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")), F.col("by") - F.col("ay")) + F.col("ax")
    crossed = crossed.where(((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & right)
    odd = crossed.groupBy(point_id, "x", "y", "_f", "_times").agg(F.count("*").alias("_n")).where("_n % 2 = 1")
    return odd.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(point_id, "_f")


def _edge_count(polys: Column) -> Column:
    return F.aggregate(polys, F.lit(0), lambda n, rings: n + F.aggregate(rings, F.lit(0), lambda m, r: m + F.greatest(F.size(r) - 1, F.lit(0))))


def _met(points: DataFrame, features: DataFrame, cell: float) -> DataFrame:
    """``points`` (with ``x, y``) by the rows of ``features`` (``_b`` and others) in whose
    bounding box they lie."""
    side = F.greatest(F.col("_b.x1") - F.col("_b.x0"), F.col("_b.y1") - F.col("_b.y0"))
    boxed = features.withColumn("_level", _level(side, F.lit(cell)))
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    used = boxed.select("_level").distinct().agg(F.collect_set("_level")).scalar()
    probes = points.withColumn("_level", F.explode(used))
    probes = probes.withColumn("_cx", F.floor(F.col("x") / size)).withColumn("_cy", F.floor(F.col("y") / size))
    placed = boxed.withColumn("_cx", cells("_b.x0", "_b.x1")).withColumn("_cy", cells("_b.y0", "_b.y1"))
    # the bounding box in the join: the ring test then sees few pairs of a cell
    near = F.col("x").between(F.col("_b.x0"), F.col("_b.x1")) & F.col("y").between(F.col("_b.y0"), F.col("_b.y1"))
    same = [F.col(f"p.{c}") == F.col(f"f.{c}") for c in ("_level", "_cx", "_cy")]
    return probes.alias("p").join(placed.alias("f"), [*same, near])


def _small(features: DataFrame, whole: int) -> DataFrame:
    """The features (``_f, _polys``) of at most ``whole`` edges, with a digest of the shape."""
    return features.where(_edge_count(F.col("_polys")) <= whole).withColumn("_shape", F.unhex(F.sha2(F.to_json("_polys"), 256)))


def _over_shapes(points: DataFrame, small: DataFrame, cell: float) -> DataFrame:
    """``x, y, _shape``: places of points and the shapes that hold them, each pair once."""
    shapes = small.groupBy("_shape").agg(F.first("_polys").alias("_polys")).withColumn("_b", G.bounds(F.col("_polys"))).where("_b.x0 is not null")
    met = _met(points.select("x", "y").distinct(), shapes, cell)
    return met.where(G.inside(F.col("x"), F.col("y"), F.col("_polys"))).select("x", "y", "_shape")


def _over_large(points: DataFrame, features: DataFrame, cell: float, point_id: str, whole: int) -> DataFrame | None:
    """``<point_id>, _f`` for features of more than ``whole`` edges, if there are any."""
    large = features.withColumns({"_b": G.bounds(F.col("_polys")), "_n": _edge_count(F.col("_polys"))}).where(F.col("_n") > whole).where("_b.x0 is not null")
    if large.isEmpty():
        return None
    return _by_edges(_met(points, large.drop("_polys"), cell).select(point_id, "x", "y", "_f"), large, point_id)


def _inputs(points: DataFrame, features: DataFrame, point_id: str, feature_id: str, geometry: str) -> tuple[DataFrame, DataFrame]:
    asked = points.where("x is not null and y is not null").select(point_id, "x", "y")
    return asked, features.select(F.col(feature_id).alias("_f"), F.col(geometry)["polys"].alias("_polys"))


def pick(points: DataFrame, features: DataFrame, cell: float, point_id: str = "point_id", feature_id: str = "feature_id", geometry: str = "geometry", whole: int = WHOLE) -> DataFrame:
    """``<point_id>, <feature_id>`` of every feature that holds the point.

    ``points`` has ``x, y``. Features get a grid level by their size, and points are
    looked up at the levels that occur, so large and small features mix without one
    of them filling many cells. Rows with null coordinates or geometry match nothing;
    a repeated point matches as often as it stands there. Features with more than ``whole``
    edges are told apart by their ids: rings of one id count as one feature's. Of the
    others each distinct shape is tested once at each distinct place, and ids are joined
    to what was found: the tests do not grow with copies, the rows of the result do.
    """
    asked, every = _inputs(points, features, point_id, feature_id, geometry)
    small = _small(every, whole)
    found = asked.join(_over_shapes(asked, small, cell), ["x", "y"]).join(small.select("_shape", "_f"), "_shape").select(point_id, "_f")
    large = _over_large(asked, every, cell, point_id, whole)
    return (found if large is None else found.unionByName(large)).withColumnRenamed("_f", feature_id)


def pick_top(points: DataFrame, features: DataFrame, cell: float, order: str = "draw_order", pickable: str = "pickable", point_id: str = "point_id", feature_id: str = "feature_id", geometry: str = "geometry", whole: int = WHOLE) -> DataFrame:
    """``<point_id>, <order>, <feature_id>``: of the features under a point in layers that
    may be picked, the one drawn last (in the highest layer, there the largest id).
    Points over none of these are left out; a point id gives one row. Of features of equal
    shape only the one drawn last takes part, and each place is looked up once."""
    ranked = features.where(F.col(pickable)).withColumn("_drawn", F.struct(order, feature_id))
    asked, every = _inputs(points, ranked, point_id, "_drawn", geometry)
    small = _small(every, whole)
    last = small.groupBy("_shape").agg(F.max("_f").alias("_f"))
    at = _over_shapes(asked, small, cell).join(last, "_shape").groupBy("x", "y").agg(F.max("_f").alias("_f"))
    found = asked.join(at, ["x", "y"]).select(point_id, "_f")
    large = _over_large(asked, every, cell, point_id, whole)
    found = found if large is None else found.unionByName(large)
    return found.groupBy(point_id).agg(F.max("_f").alias("_top")).select(point_id, "_top.*")

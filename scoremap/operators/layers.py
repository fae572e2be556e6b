"""Rings around sites, layers and their selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremap.functions import geometry as G
from scoremap.functions import scores as S


def keep_boroughs(df: DataFrame, col: str, names: list[str]) -> DataFrame:
    """Rows whose name is listed; null is not."""
    return df.where(F.col(col).isin(names))


def visible(layers: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the named layers; an empty list shows nothing."""
    return layers.where(F.col("layer").isin(names)) if names else layers.limit(0)


def visible_to(layers: DataFrame, selections: DataFrame, user: str = "user") -> DataFrame:
    """``<user>`` and the rows of each layer that it has selected, once however often it did.

    ``selections`` has ``<user>, layer``; a user without a known layer sees nothing. On
    layers partitioned by ``layer`` the filtered selections prune files at run time.
    """
    chosen = selections.select(user, "layer").where("layer is not null").distinct()
    return layers.join(chosen, "layer").select(user, *layers.columns)


def assemble(**layers: DataFrame) -> DataFrame:
    """All layers in one frame with a ``layer`` column; missing columns are null."""
    named = [df.withColumn("layer", F.lit(name)) for name, df in layers.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def described(sites: DataFrame) -> DataFrame:
    return sites.withColumn("description", F.concat(F.lit("Deployment location: "), F.col("name")))


def _rings(sites: DataFrame, n: int) -> DataFrame:
    return sites.withColumn("ring", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def dome_planar(sites: DataFrame, radius: float = 400.0, height: float = 150.0, rings: int = 15, quad_segs: int = 16, keep_empty: bool = False) -> DataFrame:
    """Rings of a dome over each site, as circles of the plane in degrees.

    Angles run from 0 to pi, so the radius turns negative behind the middle; those
    rings have no area and are kept, empty, with ``keep_empty`` only.
    """
    angle = F.col("ring") * (math.pi / (rings - 1))
    x, y = G.project_xy(F.col("lon"), F.col("lat"))
    # once per site: below the rings' explosion the planar point is a plain column
    flat = _rings(sites.withColumns({"_x": x, "_y": y}), rings).withColumns({"radius": F.cos(angle) * radius, "height": F.sin(angle) * height})
    flat = flat if keep_empty else flat.where("radius > 1e-9")
    # a ring is a short row that becomes many vertices, and sites may fill one file only
    flat = flat.repartition(int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return flat.withColumn("geometry", G.unproject(G.buffer_point(F.col("_x"), F.col("_y"), F.col("radius"), quad_segs))).drop("_x", "_y")


def dome_geographic(sites: DataFrame, radius: float = 0.004, height: float = 250.0, rings: int = 15, points: int = 32) -> DataFrame:
    """Rings whose radius is in degrees, with height, opacity and level."""
    progress = F.col("ring") / (rings - 1)
    out = _rings(sites, rings).withColumns({"radius": F.cos(progress * (math.pi / 2)) * radius, "height": F.sin(progress * (math.pi / 2)) * height, "opacity": S.opacity(F.col("ring"), rings), "level": F.col("ring")})
    ring = F.array(F.array(G.circle(F.col("lon"), F.col("lat"), F.col("radius"), points)))
    return out.withColumn("geometry", G.geom(F.lit("Polygon"), F.lit(G.WGS84), ring))


def vertices(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row per vertex: the other columns with ``poly, loop, k, x, y``."""
    rest = [c for c in df.columns if c != geometry]
    # of an inner explode Spark infers a filter, which would compute the geometry again
    polys = df.select(*rest, F.posexplode_outer(F.col(geometry)["polys"]).alias("poly", "_p")).where("poly is not null")
    loops = polys.select(*rest, "poly", F.posexplode("_p").alias("loop", "_r"))
    return loops.select(*rest, "poly", "loop", F.posexplode("_r").alias("k", "_v")).select(*rest, "poly", "loop", "k", "_v.x", "_v.y")

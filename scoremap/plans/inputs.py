"""Tables with geometry, observations and documents derived from the given tables.

The given tables hold no geometry, so coordinates follow from keys by rules that
both engines share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat(k: Column) -> Column:
    return F.lit(40.5) + (k * 37 % 1000) / F.lit(2500.0)


def lon(k: Column) -> Column:
    return F.lit(-74.2) + (k * 91 % 1000) / F.lit(2000.0)


LAT_SQL = "(40.5::DOUBLE + ({k} * 37 % 1000) / 2500.0::DOUBLE)"
LON_SQL = "(-74.2::DOUBLE + ({k} * 91 % 1000) / 2000.0::DOUBLE)"


def sites_of(df: DataFrame, key: str, name: str) -> DataFrame:
    """``ordinal, name, lat, lon`` from a key column."""
    return df.select(F.col(key).alias("ordinal"), F.col(name).alias("name"), lat(F.col(key)).alias("lat"), lon(F.col(key)).alias("lon"))


def boxes(df: DataFrame, key: str) -> DataFrame:
    """``<key>, wkt``: an integer box per key, every third with a hole and every
    fifth in two parts."""
    k = F.col(key)
    x, y = (k * 37 % 1000) * 100, (k * 91 % 1000) * 100
    side = 20 + k % 7 * 10

    def ring(x0: Column, y0: Column, s: Column) -> Column:
        x0, y0, x1, y1 = (c.cast("string") for c in (x0, y0, x0 + s, y0 + s))
        corner = lambda a, b: F.concat(a, F.lit(" "), b)
        return F.concat(F.lit("("), F.concat_ws(", ", corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)), F.lit(")"))

    outer, hole, second = ring(x, y, side), ring(x + 5, y + 5, side - 10), ring(x + 100, y, side)
    poly = F.when(k % 3 == 0, F.concat(F.lit("("), outer, F.lit(", "), hole, F.lit(")"))).otherwise(F.concat(F.lit("("), outer, F.lit(")")))
    wkt = F.when(k % 5 == 0, F.concat(F.lit("MULTIPOLYGON ("), poly, F.lit(", ("), second, F.lit("))"))).otherwise(F.concat(F.lit("POLYGON "), poly))
    return df.withColumn("wkt", wkt)

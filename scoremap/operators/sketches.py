"""Percentiles from stored quantile sketches that merge over days.

A day's scores become one KLL sketch per key, a few KB however many rows it stands for.
Stored by day, sketches of any span merge without their rows being read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremap.functions import scores as S

#: Size parameter of the sketches, 8 to 65535.
K = 1024
#: Ranks of rows are found among this number squared of quantiles.
STEPS = 32


def rank_error(k: int = K) -> float:
    """By how much the rank of a value, as a share of the rows, may be off, with 99 percent
    confidence; merging keeps it. (The published fit for KLL sketches.)"""
    return 2.296 / k**0.9723


def day_sketches(df: DataFrame, key: str, day: str, value: str, k: int = K) -> DataFrame:
    """``<key>, <day>, n, sketch``: null and NaN values have no part, and a key and day
    without others no row. Sketches are built where rows lie and merged in the shuffle."""
    known = df.select(key, day, S.known(F.col(value).cast("double")).alias("_v")).where("_v is not null")
    return known.groupBy(key, day).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_v", k).alias("sketch"))


def write_sketches(sketches: DataFrame, path: str, day: str) -> None:
    """Replaces the files of the days in ``sketches``, other days stay."""
    sketches.write.partitionBy(day).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(sketches: DataFrame, key: str) -> DataFrame:
    """``<key>, n, sketch`` over all days in ``sketches``; filter on the day first, which
    prunes files."""
    return sketches.groupBy(key).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketch: Column, shares: list[float]) -> Column:
    """The values below which these shares of the rows lie."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(s) for s in shares]))


def percentile(df: DataFrame, sketches: DataFrame, key: str, value: str, out: str = "percentile") -> DataFrame:
    """The share of the key's sketched rows up to each row's value, within ``rank_error`` and
    one in STEPS squared; null for a value or key that is null or unknown. ``sketches`` has
    a row per key."""
    n = STEPS * STEPS
    cuts = quantiles(F.col("sketch"), [i / n for i in range(n)])
    known = sketches.select(F.col(key).alias("_key"), cuts.alias("_cuts")).withColumn("_coarse", F.transform(F.sequence(F.lit(1), F.lit(STEPS - 1)), lambda i: F.get("_cuts", i * STEPS)))
    joined = df.withColumn("_v", S.known(F.col(value).cast("double"))).join(known, F.col(key) == F.col("_key"), "left")
    # first among every STEPS-th cut, then among those of one step
    upto = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col("_v")))
    step = upto(F.col("_coarse")) * STEPS
    rank = (F.col("_step") + upto(F.slice("_cuts", F.col("_step") + 1, F.lit(STEPS)))) / n
    known_row = F.col("_cuts").isNotNull() & F.col("_v").isNotNull()
    return joined.withColumn("_step", F.when(known_row, step)).withColumn(out, F.when(known_row, rank)).drop("_key", "_cuts", "_coarse", "_v", "_step")

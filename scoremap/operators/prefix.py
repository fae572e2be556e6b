"""Running counts of a key's values without sorting the key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slices of a range of values: STEPS coarse ones of STEPS fine ones each.
STEPS = 32
ACCURACY = 20000


def with_slices(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``_slice``: ranges of values, numbered in order from 0, that hold
    about as many rows each, by approximate quantiles of the whole frame; so an outlier
    does not push all others into one. Equal values are in one slice; null is in 0.
    Values are numbers or times. The quantiles, STEPS squared numbers, are found first.
    """
    n, kind = STEPS * STEPS, df.schema[value].dataType.typeName()
    number = F.unix_micros(F.col(value).cast("timestamp")) if kind.startswith("timestamp") else F.col(value)
    cuts = df.agg(F.percentile_approx(number, [i / n for i in range(1, n)], ACCURACY)).first()[0]
    if not cuts:
        return df.withColumn("_slice", F.lit(0))
    flat = F.array(*[F.lit(c) for c in cuts])
    coarse = sum((F.when(number > cuts[(i + 1) * STEPS - 1], 1).otherwise(0) for i in range(STEPS - 1)), F.lit(0))
    fine = F.size(F.filter(F.slice(flat, F.col("_coarse") * STEPS + 1, F.lit(STEPS - 1)), lambda c: c < number))
    return df.withColumn("_coarse", coarse).withColumn("_slice", F.col("_coarse") * STEPS + F.when(number.isNull(), 0).otherwise(fine)).drop("_coarse")


#: Keys with no more rows than this are sorted in one task each, which is faster.
WHOLE_KEY = 1_000_000


def has_hot_key(df: DataFrame, key: str, limit: int = WHOLE_KEY) -> bool:
    """Whether some key has more rows than one task should sort: one job that counts
    keys where the rows lie."""
    return bool(df.groupBy(key).count().where(F.col("count") > limit).limit(1).count())


def running_counts(counts: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """``counts`` (a row per key and value) with ``_below`` and ``_total``: the sum of
    ``n`` over the key's smaller values, and over all.

    Windows run inside a slice of values, and over the slice totals of a key.
    """
    sliced = with_slices(counts, value)
    totals = sliced.groupBy(key, "_slice").agg(F.sum(n).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_of_key"), F.col("_slice").alias("_of_slice"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(key)).alias("_total"))
    inside = Window.partitionBy(key, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    joined = placed.join(totals, F.col(key).eqNullSafe(F.col("_of_key")) & (F.col("_slice") == F.col("_of_slice")))
    return joined.withColumn("_below", F.col("_before") + F.col("_in")).drop("_of_key", "_of_slice", "_slice", "_in", "_before")

"""Normalised, styled and composite scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoremap.functions import scores as S
from scoremap.operators.prefix import WHOLE_KEY, has_hot_key, running_counts, with_slices


def normalise(df: DataFrame, col: str, out: str = "score") -> DataFrame:
    """Min-max over the whole frame. The two bounds come from one aggregate each,
    used as scalar subqueries: rows stay where they are."""
    value = S.known(F.col(col).cast("double"))
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    return df.withColumn(out, S.minmax(value, low, high))


def style(df: DataFrame, score: str = "score", **columns) -> DataFrame:
    """Columns made by functions of the score column: ``style(df, bin=ramp_index)``."""
    return df.withColumns({name: f(F.col(score)) for name, f in columns.items()})


def percentile(df: DataFrame, key: str, value: str, out: str = "percentile", whole_key: int = WHOLE_KEY) -> DataFrame:
    """Exact ``percent_rank`` within each key; null values have no rank. If a key has
    more than ``whole_key`` rows, equal values are counted first and the counts summed
    over value ranges, so that no task sorts all of a key's rows."""
    v = S.known(F.col(value).cast("double"))
    if not has_hot_key(df, key, whole_key):
        known = F.col("_x").isNotNull()
        rank = F.percent_rank().over(Window.partitionBy(key, known).orderBy("_x"))
        return df.withColumn("_x", v).withColumn(out, F.when(known, rank)).drop("_x")
    counts = df.select(key, v.alias("_v")).where("_v is not null").groupBy(key, "_v").agg(F.count("*").alias("_n"))
    ranked = running_counts(counts, key, "_v", "_n")
    rank = F.coalesce(F.try_divide(F.col("_below"), F.col("_total") - 1), F.lit(0.0))
    join = ranked.select(F.col(key).alias("_k"), F.col("_v").alias("_w"), rank.alias(out))
    return df.withColumn("_x", v).join(join, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_x") == F.col("_w")), "left").drop("_k", "_w", "_x")


def percentile_bins(df: DataFrame, value: str, n: int = 11, out: str = "bin", accuracy: int = 10000) -> DataFrame:
    """Bins by approximate percentiles of the whole frame, in one pass."""
    cuts = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], accuracy)).scalar()
    above = sum((F.when(F.get(cuts, i) < F.col(value), 1).otherwise(0) for i in range(n - 1)), F.lit(0))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), above))


def parse_scale(text: Column) -> Column:
    """``0 = a, 1 = b`` as ``array<struct<code:int,label:string>>``; labels may hold
    commas."""
    parts = F.split(text, r", (?=\d+ = )")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\s*(\d+) = ", 1).cast("int").alias("code"), F.regexp_extract(p, r"^\s*\d+ = (.*)$", 1).alias("label")))


def composite_score(obs: DataFrame, weights: DataFrame, scales: DataFrame, segment: str = "segment_id") -> DataFrame:
    """``<segment>, composite, n_used, n_missing`` of ``<segment>, indicator, code``.

    A code counts as its share of the scale's highest; indicators without a weight,
    a scale or a code in range are left out and counted. ``weights`` and ``scales``
    are catalogues with a row per indicator; Spark broadcasts them if they are small.
    """
    top = scales.select("indicator", F.array_max(F.transform(parse_scale(F.col("scale")), lambda s: s["code"])).alias("top"))
    rated = obs.join(weights, "indicator", "left").join(top, "indicator", "left")
    share = F.when(F.col("code").between(0, F.col("top")), F.try_divide(F.col("code"), F.col("top")))
    used = share.isNotNull() & F.col("weight").isNotNull()
    sums = rated.groupBy(segment).agg(
        F.sum(F.when(used, share * F.col("weight"))).alias("a"), F.sum(F.when(used, F.col("weight"))).alias("b"), F.count_if(used).alias("n_used"), F.count_if(~used).alias("n_missing")
    )
    return sums.select(segment, F.try_divide("a", "b").alias("composite"), "n_used", "n_missing")


def weight_share(df: DataFrame, weight: str, k: int) -> DataFrame:
    """``top, share``: the k largest weights' sum and its share of all."""
    top = df.orderBy(F.desc(weight)).limit(k).agg(F.sum(weight).alias("top"))
    return top.withColumn("share", F.try_divide("top", df.agg(F.sum(weight)).scalar()))


def extreme_ratio(df: DataFrame, score: str, keys: list[str] | None = None) -> DataFrame:
    """The best score over the worst, by key or for the whole frame."""
    ratio = F.try_divide(F.max(score), F.min(score)).alias("ratio")
    return df.groupBy(*keys).agg(ratio) if keys else df.agg(ratio)


def ordinal(df: DataFrame, key: str, order: list[str], out: str = "ordinal", whole_key: int = WHOLE_KEY) -> DataFrame:
    """Zero-based position of a row within its key. If a key has more than ``whole_key``
    rows and the first order column is a number or a time, rows are placed within slices
    of it (null is in the first), and slices by their counts."""
    kind = df.schema[order[0]].dataType.typeName()
    sliceable = kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith(("timestamp", "decimal"))
    if not sliceable or not has_hot_key(df, key, whole_key):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    sliced = with_slices(df, order[0])
    counts = sliced.groupBy(key, "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(key).alias("_key"), F.col("_slice").alias("_s"), before.alias("_before"))
    met = sliced.join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_s")))
    place = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*order)) - 1 + F.col("_before")
    return met.withColumn(out, place.cast("int")).drop("_slice", "_key", "_s", "_before")

"""Click logs: selection state, selection changes and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoremap.operators.prefix import WHOLE_KEY, has_hot_key, with_slices


def _sliced(events: DataFrame, key: str, item: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``events`` with ``_slice`` (a range of the first order column), ``_item``, and
    ``_head`` (whether it is in the first run of its key and slice) and ``_nth`` (its
    place in its run there); and per key and slice, how many rows the run had before
    (``_carry``, null if the slice begins a run of its own).

    A run are events of one item in a row; a null item is a run of its own. Only the
    few slices of a key meet in one task, never its events.
    """
    cut = with_slices(events, order[0]).withColumn("_item", F.col(item))
    w = Window.partitionBy(key, "_slice").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    begins = F.row_number().over(w) == 1
    new = begins | F.col("_item").isNull() | ~F.col("_item").eqNullSafe(F.lag("_item").over(w))
    cut = cut.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(upto))
    nth = F.row_number().over(Window.partitionBy(key, "_slice", "_run").orderBy(*order))
    cut = cut.withColumn("_nth", nth).withColumn("_head", F.col("_run") == 1).drop("_new")
    place = F.struct(*order)
    ends = cut.groupBy(key, "_slice").agg(F.min_by("_item", place).alias("first"), F.max_by("_item", place).alias("last"), F.max_by("_nth", place).alias("tail"), F.max("_run").alias("runs"))
    by = Window.partitionBy(key).orderBy("_slice")
    ends = ends.withColumn("goes_on", F.col("first").isNotNull() & F.col("first").eqNullSafe(F.lag("last").over(by)))
    # the run that ends a slice began where a slice has several runs or does not go on
    whole = F.col("goes_on") & (F.col("runs") == 1)
    ends = ends.withColumn("part", F.sum((~whole).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    reach = F.sum("tail").over(Window.partitionBy(key, "part").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("reach", reach)
    carry = F.when(F.col("goes_on"), F.lag("reach").over(by))
    return cut, ends.select(F.col(key).alias("_key"), F.col("_slice").alias("_s"), carry.alias("_carry"))


def _met(cut: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    return cut.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_s")))


def _numbered_runs(events: DataFrame, key: str, item: str, order: list[str]) -> DataFrame:
    """``events`` with ``_nth``, the place in its run, by windows over whole keys."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.col(item).isNull() | ~F.col(item).eqNullSafe(F.lag(item).over(w))
    runs = events.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # rows of a run follow each other, so the next window needs no shuffle
    return runs.withColumn("_nth", F.row_number().over(Window.partitionBy(key, "_run").orderBy(*order)))


def selection_toggle(events: DataFrame, key: str, item: str, order: list[str], out: str = "active", whole_key: int = WHOLE_KEY) -> DataFrame:
    """The active item after each event: a click on the active item clears it, on
    another selects that, and a null item closes.

    Within a run of clicks on one item every other click is active; a close ends
    the run. If a key has more than ``whole_key`` events, keys are worked on in slices.
    """
    if not has_hot_key(events, key, whole_key):
        return _numbered_runs(events, key, item, order).withColumn(out, F.when(F.col("_nth") % 2 == 1, F.col(item))).select(*events.columns, out)
    cut, ends = _sliced(events, key, item, order)
    nth = F.col("_nth") + F.when(F.col("_head"), F.coalesce("_carry", F.lit(0))).otherwise(0)
    return _met(cut, ends, key).withColumn(out, F.when(nth % 2 == 1, F.col("_item"))).select(*events.columns, out)


def selection_changes(events: DataFrame, key: str, item: str, order: list[str], whole_key: int = WHOLE_KEY) -> DataFrame:
    """Events whose item differs from the one before; the first always does unless
    it is null. If a key has more than ``whole_key`` events, keys are worked on in slices."""
    if not has_hot_key(events, key, whole_key):
        before = F.lag(item).over(Window.partitionBy(key).orderBy(*order))
        return events.withColumn("_before", before).where(~F.col(item).eqNullSafe(F.col("_before"))).select(*events.columns)
    cut = with_slices(events, order[0]).withColumn("_item", F.col(item))
    w = Window.partitionBy(key, "_slice").orderBy(*order)
    cut = cut.withColumns({"_last": F.lag("_item").over(w), "_begins": F.row_number().over(w) == 1})
    ends = cut.groupBy(key, "_slice").agg(F.max_by("_item", F.struct(*order)).alias("last"))
    ends = ends.select(F.col(key).alias("_key"), F.col("_slice").alias("_s"), F.lag("last").over(Window.partitionBy(key).orderBy("_slice")).alias("_before"))
    last = F.when(F.col("_begins"), F.col("_before")).otherwise(F.col("_last"))
    return _met(cut, ends, key).where(~F.col("_item").eqNullSafe(last)).select(*events.columns)


def known_keys(df: DataFrame, catalogue: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in the catalogue."""
    return df.join(catalogue.select(on).distinct(), on, "left_semi")


def looked_up(df: DataFrame, catalogue: DataFrame, on: str | Column) -> DataFrame:
    """Inner equi-join: rows without a match give nothing. Spark picks the side to
    broadcast by its size."""
    return df.join(catalogue, on, "inner")

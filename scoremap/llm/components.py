"""Connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremap.llm.common import discard, materialize, small_side


def order_of(vertex: str):
    """The order in which vertices are preferred: pseudo-random, so that a path of
    links falls apart into short descents."""
    return F.struct(F.xxhash64(vertex).alias("h"), F.col(vertex).alias("v"))


def components(links: DataFrame) -> DataFrame:
    """``links`` is ``a long, b long``; the result ``v, c`` names for every vertex of
    a link the smallest vertex that it is connected with. No links give no rows."""
    found = joined(links)
    least = materialize(found.groupBy("c").agg(F.min("v").alias("least")), "least")
    own = links.where("a = b").select(F.col("a").alias("v")).distinct().join(small_side(found), "v", "left_anti")
    return materialize(found.join(small_side(least), "c").select("v", F.col("least").alias("c")).unionByName(own.select("v", F.col("v").alias("c"))), "labels")


def joined(links: DataFrame) -> DataFrame:
    """``v, c``: for every vertex of a link between two one vertex of its component,
    the same for all of them.

    In each round every vertex is hooked to its first neighbour in ``order_of``, two
    hooks are followed, and only links between what then differs go on, so a star
    takes one round and a path a number that grows with the logarithm of its length.
    Each round is written to the shared folder.
    """
    live, done = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"), None
    while live._row_bytes:
        ends = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy(F.col("a").alias("v")).agg(F.min(order_of("b")).alias("f"))
        once = materialize(first.select("v", F.least("f", order_of("v"))["v"].alias("c")), "hooks")
        far = once
        for _ in range(2):
            far = far.join(small_side(once).select(F.col("v").alias("c"), F.col("c").alias("to")), "c").select("v", F.col("to").alias("c"))
        hooks = materialize(far, "hooks")
        to = lambda end: small_side(hooks).select(F.col("v").alias(end), F.col("c").alias(f"{end}_"))  # noqa: E731,B023
        moved = live.join(to("a"), "a").join(to("b"), "b").where("a_ <> b_")
        rest = materialize(moved.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct(), "links")
        discard(live, once)
        done, live = hooks if done is None else merged(done, hooks), rest
    return done if done is not None else materialize(live.select(F.col("a").alias("v"), F.col("b").alias("c")), "labels")


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` (``v, c``) after the components that it names became vertices of
    ``more``; vertices that only ``more`` knows come along. Both are materialised."""
    to = small_side(more).select(F.col("v").alias("c"), F.col("c").alias("to"))
    old = labels.join(to, "c", "left").select("v", F.coalesce("to", "c").alias("c"))
    new = more.join(small_side(labels).select("v"), "v", "left_anti")
    out = materialize(old.unionByName(new), "labels")
    discard(labels, more)
    return out


def contracted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links between components: both ends replaced by what ``labels`` says."""
    to = lambda end: small_side(labels).select(F.col("v").alias(end), F.col("c").alias(f"{end}_"))
    both = links.join(to("a"), "a", "left").join(to("b"), "b", "left")
    return both.select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))

"""Temperature mixing of sources to a token budget.

A source with token share p gets weight p**a / sum(p**a). The exponent a in [0, 1]
is found by repeated 64-way bisection over the table of sources: the flattest
mixture (smallest a) whose entropy stays at or below the target and that repeats no
source more often than allowed. Weights become whole epochs plus a part; the part
is filled block by block in a pseudo-random order of blocks, and only the block
where a source's budget ends is ordered row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoremap.llm.common import free_name, materialize, row_id, small_side
from scoremap.operators.prefix import running_counts

WAYS, ROUNDS = 64, 4
#: Where the target entropy lies between the natural mixture's (0) and the uniform (1).
ENTROPY_SHARE = 0.5
MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 16
SEED = "mix"


def token_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffled(value: Column, seed: str) -> Column:
    """60 pseudo-random bits of a value, from the MD5 of ``seed:value``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(value.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


@dataclass
class Mixture:
    exponent: float
    weights: DataFrame  # _s, tokens, weight, target
    entropy: float


def solve(sources: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS) -> Mixture | None:
    """``sources`` is ``_s, tokens``, one row per source with tokens. None if empty."""
    total = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total["t"]:
        return None
    budget = total["t"] if budget is None else budget
    p = F.col("tokens") / F.lit(float(total["t"]))

    def measured(exponents: list[float]) -> list:
        a = F.explode(F.array(*[F.lit(x) for x in exponents])).alias("a")
        each = sources.select(p.alias("p"), a).select("a", F.pow("p", "a").alias("w"), F.pow(F.col("p"), F.col("a") - 1).alias("r"))
        sums = each.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log2("w")).alias("e"), F.max("r").alias("r"))
        rows = sums.select("a", (F.log2("z") - F.col("e") / F.col("z")).alias("h"), (F.col("r") / F.col("z") * (budget / total["t"])).alias("repeats")).collect()
        return sorted(rows, key=lambda x: x["a"])

    low, high = 0.0, 1.0
    flat, natural = measured([0.0, 1.0])
    target = natural["h"] + entropy_share * (flat["h"] - natural["h"])
    for _ in range(ROUNDS):
        step = (high - low) / WAYS
        grid = measured([low + step * i for i in range(WAYS + 1)])
        fits = [x["a"] for x in grid if x["h"] <= target + 1e-9 and x["repeats"] <= max_repeats + 1e-9]
        high = min(fits, default=1.0)  # none fits: the natural mixture
        low = max(0.0, high - step)
    best = measured([high])[0]
    z = sources.agg(F.sum(F.pow(p, F.lit(high)))).first()[0]
    weight = F.pow(p, F.lit(high)) / F.lit(z)
    return Mixture(high, sources.select("_s", "tokens", weight.alias("weight"), F.floor(weight * budget).cast("long").alias("target")), best["h"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> DataFrame:
    """Per row: ``_rid, <id_col>, <source_col>, n_tokens, weight, n_copies``.

    ``n_copies`` is how often the row stands in the mixture (0: not at all). The
    budget defaults to the tokens there are. Null is a source of its own; rows of a
    source without tokens (null and empty texts) cost nothing and stand once, with
    weight 0. Rows with the same id are in one block and may differ by one copy; those
    with a null id are in any block. Texts
    of any length count whole, an empty table gives no rows, and other columns are
    ignored.
    """
    # rows without an id are dealt out by their numbers
    place = F.when(F.col("_id").isNull(), shuffled(F.concat(F.lit("row "), F.col("_rid")), seed)).otherwise(shuffled(F.col("_id"), seed))
    base = materialize(
        row_id(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_t"))).select(
            "_rid", "_id", "_source", F.coalesce(F.concat(F.lit("="), F.col("_source").cast("string")), F.lit("")).alias("_s"), token_count(F.col("_t")).alias("n_tokens"), place.alias("_h")
        ),
        "tokens",
    )
    sources = materialize(base.groupBy("_s").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "sources")
    found = solve(sources, budget, entropy_share, max_repeats)
    if found is None:
        return base.select("_rid", F.col("_id").alias(id_col), F.col("_source").alias(source_col), "n_tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("n_copies"))
    # of each source: whole epochs, tokens of the part, number of blocks
    plan = materialize(
        found.weights.select(
            "_s", "weight", F.floor(F.col("target") / F.col("tokens")).cast("long").alias("epochs"), (F.col("target") % F.col("tokens")).alias("part"), F.ceil(F.col("tokens") / block_tokens).cast("long").alias("blocks")
        ),
        "plan",
    )
    placed = base.join(small_side(plan), "_s", "left").withColumn("_block", F.pmod("_h", "blocks"))
    # every block of a source in shuffled order, with the tokens before it; slices of the
    # order are summed first, as a large source has too many blocks for one task
    blocks = placed.where("blocks is not null").groupBy("_s", "_block").agg(F.sum("n_tokens").alias("size"), F.first("part").alias("part"))
    blocks = materialize(blocks.withColumn("_place", shuffled(F.concat_ws("/", "_s", "_block"), seed)), "sizes")
    blocks = running_counts(blocks, "_s", "_place", "size").withColumnRenamed("_below", "before")
    blocks = materialize(
        blocks.where("before < part").select("_s", "_block", (F.col("before") + F.col("size") <= F.col("part")).alias("_whole"), (F.col("part") - F.col("before")).alias("_left")), "blocks"
    )
    placed = placed.join(small_side(blocks), ["_s", "_block"], "left")
    inside = Window.partitionBy("_s", "_block").orderBy("_h", "_id", "_rid").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.where("not _whole").withColumn("upto", F.sum("n_tokens").over(inside)).where("upto <= _left")
    cut = materialize(cut.select("_rid", F.lit(True).alias("_in")), "cut")
    one = (F.col("_whole") | F.col("_in")).isNotNull() & F.coalesce(F.col("_whole") | F.col("_in"), F.lit(False))
    return placed.join(small_side(cut), "_rid", "left").select(
        "_rid",
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        "n_tokens",
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce(F.col("epochs") + one.cast("long"), F.lit(1).cast("long")).alias("n_copies"),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The input rows, each as often as the mixture asks for."""
    copies = materialize(mix(docs, id_col, text_col, source_col, **options).where("n_copies <> 1").select("_rid", "n_copies"), "copies")
    rid, n, each = (free_name(docs, c) for c in ("_rid", "_copies", "_copy"))
    placed = row_id(docs, rid).join(small_side(copies).toDF(rid, n), rid, "left").withColumn(n, F.coalesce(n, F.lit(1).cast("long"))).where(F.col(n) > 0)
    return placed.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sql(docs: str = "documents") -> str:
    """DuckDB SQL with the rows of ``mix`` at its defaults."""
    hashed = "('0x' || substr(md5('{seed}:' || {x}), 1, 15))::BIGINT"
    measure = """SELECT a, log2(sum(w)) - sum(w * log2(w)) / sum(w) AS h, max(r) / sum(w) AS repeats
      FROM (SELECT a, pow(p, a) AS w, pow(p, a - 1) AS r FROM share, {grid}) GROUP BY a"""
    rounds = f"WITH t AS (SELECT doc_id, source, coalesce('=' || source, '') AS s, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n, {hashed.format(seed=SEED, x="coalesce(doc_id::VARCHAR, '')")} AS hash FROM {docs}),\n"
    rounds += "src AS (SELECT s, sum(n)::BIGINT AS tokens FROM t GROUP BY s HAVING sum(n) > 0),\n"
    rounds += "share AS (SELECT s, tokens, tokens / (SELECT sum(tokens) FROM src)::DOUBLE AS p FROM src),\n"
    rounds += "ends AS (" + measure.format(grid="(VALUES (0::DOUBLE), (1::DOUBLE)) AS g(a)") + "),\n"
    rounds += f"goal AS (SELECT (SELECT h FROM ends WHERE a = 1) + {ENTROPY_SHARE} * ((SELECT h FROM ends WHERE a = 0) - (SELECT h FROM ends WHERE a = 1)) AS target),\n"
    rounds += "r0 AS (SELECT 0::DOUBLE AS low, 1::DOUBLE AS high),\n"
    for k in range(1, ROUNDS + 1):
        width = f"{WAYS}.0::DOUBLE" if k == 1 else f"pow({WAYS}, {k})"
        grid = f"(SELECT low + (high - low) / {WAYS} * i AS a FROM r{k - 1}, range({WAYS + 1}) AS g(i)) AS g"
        rounds += f"m{k} AS ({measure.format(grid=grid)}),\n"
        rounds += f"h{k} AS (SELECT coalesce(min(a) FILTER (h <= target + 1e-9 AND repeats <= {MAX_REPEATS} + 1e-9), 1::DOUBLE) AS high FROM m{k}, goal),\n"
        rounds += f"r{k} AS (SELECT greatest(0, high - 1 / {width}) AS low, high FROM h{k}),\n"
    return (
        rounds
        + f"""wt AS (SELECT s, tokens, pow(p, high) / (SELECT sum(pow(p, high)) FROM share, r{ROUNDS}) AS weight FROM share, r{ROUNDS}),
plan AS (SELECT s, weight, tokens, floor(weight * (SELECT sum(tokens) FROM src))::BIGINT AS target,
                ceil(tokens / {BLOCK_TOKENS})::BIGINT AS blocks FROM wt),
placed AS (SELECT t.*, weight, target // tokens AS epochs, target % tokens AS part, hash % blocks AS block FROM t LEFT JOIN plan USING (s)),
blk AS (SELECT s, block, sum(n) AS size, any_value(part) AS part FROM placed WHERE weight IS NOT NULL GROUP BY s, block),
ordered AS (SELECT s, block, size, part, coalesce(sum(size) OVER (PARTITION BY s
              ORDER BY {hashed.format(seed=SEED, x="s || '/' || block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blk),
run AS (SELECT placed.*, before, size, sum(n) OVER (PARTITION BY s, block ORDER BY hash, doc_id ROWS UNBOUNDED PRECEDING) AS upto
        FROM placed LEFT JOIN ordered USING (s, block))
SELECT doc_id, source, n AS n_tokens, coalesce(round(weight, 9), 0) AS weight,
       coalesce(epochs + (before < part AND (before + size <= part OR upto <= part - before))::BIGINT, 1)::BIGINT AS n_copies
FROM run"""
    )

import random

from pyspark.sql import functions as F

from scoremap.operators import layers as L
from scoremap.operators import sketches as sk
from scoremap.sources.writers import write_layers


def test_merged_days_keep_the_rank_error(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, d, rng.choice([rng.gauss(0, 1), round(rng.random(), 1)])) for k in "ab" for d in range(30) for _ in range(200 if k == "a" else 40)]
    rows += [("a", 3, None), ("a", 3, float("nan")), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, day int, v double")
    path = f"file://{tmp_path}/sketches"
    sk.write_sketches(sk.day_sketches(df, "k", "day", "v"), path, "day")
    sk.write_sketches(sk.day_sketches(df.where("day = 3"), "k", "day", "v"), path, "day")  # again: replaces that day alone
    stored = sk.read_sketches(spark, path)
    assert stored.count() == 60
    some = stored.where("day < 20")
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().toString()
    got = sk.percentile(df.where("day < 20"), sk.merged(some, "k"), "k", "v").collect()
    values = {k: sorted(v for k2, d, v in rows if k2 == k and d < 20 and v is not None and v == v) for k in "ab"}
    assert {r["k"]: r["n"] for r in sk.merged(some, "k").collect()} == {k: len(v) for k, v in values.items()}
    for r in got:
        if r["v"] is None or r["v"] != r["v"]:
            assert r["percentile"] is None
        else:
            mine = values[r["k"]]  # of equal values any rank will do
            low, high = sum(v < r["v"] for v in mine) / len(mine), sum(v <= r["v"] for v in mine) / len(mine)
            slack = 2 * sk.rank_error() + 1 / sk.STEPS**2
            assert low - slack <= r["percentile"] <= high + slack
    assert sk.rank_error(200) > sk.rank_error() > 0 and len(got) == sum(d < 20 for _, d, _ in rows)


def test_selections_prune_layer_files(spark, tmp_path):
    path = f"file://{tmp_path}/layers"
    write_layers(spark.range(100).select(F.concat(F.lit("l"), F.col("id") % 10).alias("layer"), F.col("id").cast("string").alias("feature"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 40).alias("more")), path)
    chosen = spark.createDataFrame([("u", "l1", 1), ("u", "l1", 1), ("w", "l3", 1), ("w", "none", 1), ("x", None, 1), ("y", "l5", 0)], "user string, layer string, active int")
    chosen.coalesce(1).write.parquet(f"file://{tmp_path}/chosen")
    chosen = spark.read.parquet(f"file://{tmp_path}/chosen")
    got = L.visible_to(spark.read.parquet(f"{path}/features"), chosen.where("active = 1")).select("user", "layer", "feature")
    assert sorted(map(tuple, got.collect())) == sorted([("u", "l1", str(i)) for i in range(1, 100, 10)] + [("w", "l3", str(i)) for i in range(3, 100, 10)], key=lambda r: (r[0], r[1], r[2]))
    assert "dynamicpruning" in got._jdf.queryExecution().toString()

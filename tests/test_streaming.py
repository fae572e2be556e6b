"""The selection machine over streams against the batch form and the plain machine."""

import datetime
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoremap.operators import events as ev
from scoremap.streaming.selection import OUTPUT, PROVIDER, rocksdb, run_states, selection_by_event_time, selection_stream, step

SCHEMA = "event_id long, ts timestamp, user_id long, item string"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


@given(st.sampled_from([None, "a", "b"]), st.lists(st.sampled_from([None, "a", "b"]), max_size=30))
def test_run_states_are_the_machine(active, items):
    want, now = [], active
    for x in items:
        now = step(now, x)
        want.append(now)
    assert run_states(active, np.array(items, object)).tolist() == want


def clicks(seed, n=900):
    """A third of all clicks by one user, ties in time, closes."""
    rng = random.Random(seed)
    return [(i, START + datetime.timedelta(seconds=i // 2), 0 if rng.random() < 0.35 else rng.randint(1, 9), rng.choice(["a", "b", None, "a"])) for i in range(n)]


def written(spark, path, files):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{path}/in/{k:03d}")


def streamed(spark, path, answer, per_trigger=1):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(f"file://{path}/in/*")
    with rocksdb(spark):
        answer(source).writeStream.format("parquet").option("checkpointLocation", f"file://{path}/state").option("path", f"file://{path}/out").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.schema(OUTPUT).parquet(f"file://{path}/out").collect()))


def batch(spark, rows):
    return ev.selection_toggle(spark.createDataFrame(rows, SCHEMA), "user_id", "item", ["ts", "event_id"]).select("event_id", "user_id", "item", "active")


def test_state_goes_on_over_micro_batches(spark, tmp_path):
    rows = clicks(1)
    files = [rows[k : k + 300] for k in range(0, 900, 300)]
    for f in files:
        random.Random(2).shuffle(f)  # within a micro-batch any order will do
    written(spark, tmp_path, files)
    old = spark.conf.get(PROVIDER, None)
    assert streamed(spark, tmp_path, selection_stream) == sorted(map(tuple, batch(spark, rows).collect())) and spark.conf.get(PROVIDER, None) == old


def test_shuffled_files_give_the_batch_answer(spark, tmp_path):
    """Clicks come up to 100 s late, over files; the watermark is 120 s behind."""
    rows, rng = clicks(3), random.Random(4)
    late = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=rng.randint(0, 100)))
    written(spark, tmp_path, [late[k : k + 225] for k in range(0, 900, 225)])
    end = max(r[1] for r in rows) - datetime.timedelta(seconds=120)
    kept = {r[0] for r in rows if r[1] <= end}
    want = batch(spark, rows).where(F.col("event_id").isin(*kept))
    assert streamed(spark, tmp_path, lambda s: selection_by_event_time(s, "120 seconds")) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("behind", [200, 1500])
def test_clicks_behind_the_watermark_are_dropped(spark, tmp_path, behind):
    at = lambda s: START + datetime.timedelta(seconds=s)
    files = [[(1, at(1000), 1, "a")], [(2, at(2000), 1, "b")], [(3, at(2000 - behind), 1, "x"), (4, at(3000), 1, "b")], [(5, at(9000), 1, None)]]
    written(spark, tmp_path, files)
    got = [r[0] for r in streamed(spark, tmp_path, lambda s: selection_by_event_time(s, "300 seconds"))]
    assert got == ([1, 2, 3, 4] if behind < 300 else [1, 2, 4])


@pytest.mark.parametrize("answer", [lambda s: selection_by_event_time(s, "120 seconds", buckets=4), lambda s: selection_stream(s, buckets=4)])
def test_users_share_entries_of_state(spark, tmp_path, answer):
    """3000 users and clicks without one, over two micro-batches: state grows with
    buckets (their clicks, items and timers), and answers are those of the batch form."""
    rng = random.Random(5)
    rows = [(i, START + datetime.timedelta(seconds=i // 20), rng.choice([None, *range(3000)]), rng.choice(["a", "b", None, "a"])) for i in range(9000)]
    written(spark, tmp_path, [rows[:4500], rows[4500:]])
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    with rocksdb(spark):
        query = answer(source).writeStream.format("memory").queryName(f"shared_{id(answer)}").trigger(availableNow=True).start()
        query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    kept = sorted(map(tuple, spark.table(f"shared_{id(answer)}").collect()))
    assert state and max(state) < 100
    assert len(kept) >= 6000 and set(kept) <= set(map(tuple, batch(spark, rows).collect()))

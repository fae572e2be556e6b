"""The selection state machine over a stream of clicks.

Both forms keep the items of users in RocksDB. ``selection_stream`` answers at once, in
order of time within a micro-batch; ``selection_by_event_time`` waits for the watermark,
so that clicks which come late, in any order, are applied in the order of their times.

Users are dealt to ``buckets`` by a hash, and the processor works on the clicks of all
users of a bucket at once: a call per user, with its round trips between Spark and the
Python worker, would cost more than the clicks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "event_id long, user_id long, item string, active string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Groups of users that share an entry of state. A stream keeps the number it began with.
BUCKETS = 1024
#: Rows of an answer that are given at once.
GIVE = 1 << 16
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; a query keeps what it
    started with, so the session's own setting comes back afterwards."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, old)


def step(active: str | None, item: str | None) -> str | None:
    """State after a click (null: close)."""
    return None if item is None or item == active else item


def _states(codes: np.ndarray, starts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether each click leaves its item active. ``codes`` are items (-1: close), user
    after user, each from ``starts`` on with the item ``before`` (-1: none) active: within
    a run of one item every other click is active, and a user's first run may go on from
    the state."""
    n = len(codes)
    new = np.ones(n, bool)
    new[1:] = (codes[1:] == -1) | (codes[1:] != codes[:-1])
    new[starts] = True
    first = np.flatnonzero(new)
    goes_on = np.zeros(len(first), np.int64)
    goes_on[np.searchsorted(first, starts)] = (before != -1) & (codes[starts] == before)
    nth = np.arange(n) - np.repeat(first - goes_on, np.diff(np.append(first, n)))
    return (codes != -1) & (nth % 2 == 0)


def _coded(items: np.ndarray) -> np.ndarray:
    return pd.factorize(items)[0]


def run_states(active: str | None, items: np.ndarray) -> np.ndarray:
    """States of one user after each of ``items`` (objects, None: close), from ``active``
    on."""
    if not len(items):
        return items.copy()
    codes = _coded(np.append(items, np.array([active], object)))
    return np.where(_states(codes[:-1], np.zeros(1, int), codes[-1:]), items, None)


def _objects(column) -> np.ndarray:
    out = np.asarray(column, object)
    return np.where(pd.isna(out), None, out)


def _packed(**columns) -> bytes:
    """Columns as bytes, so that an entry of state is one value whatever it holds."""
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if c.dtype == object else pa.int64()) for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> list[np.ndarray]:
    table = pa.ipc.open_stream(raw).read_all()
    return [_objects(c.to_pandas()) if pa.types.is_string(c.type) else c.to_numpy() for c in table.columns]


class _Selection(StatefulProcessor):
    """Common to both forms: the items of a bucket's users, and rows that become states
    in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "users binary")

    def known(self) -> list[np.ndarray]:
        """Users in ascending order, the item of each and the time of its last click."""
        got = self.active.get()
        return _unpacked(bytes(got[0])) if got else [np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64)]

    def applied(self, bucket: int, us: np.ndarray, ids: np.ndarray, users: np.ndarray, items: np.ndarray) -> Iterator[pd.DataFrame]:
        order = np.lexsort((ids, us, users))
        us, ids, users, items = (x[order] for x in (us, ids, users, items))
        who, starts = np.unique(users, return_index=True)
        old, old_items, old_us = self.known()
        had = np.isin(who, old, assume_unique=True)
        before = np.full(len(who), None, object)
        before[had] = old_items[np.searchsorted(old, who[had])]
        codes = _coded(np.concatenate([items, before]))
        on = _states(codes[: len(items)], starts, codes[len(items) :])
        states, ends = np.where(on, items, None), np.append(starts[1:], len(us)) - 1
        stay = ~np.isin(old, who, assume_unique=True)
        all_users = np.concatenate([old[stay], who])
        place = np.argsort(all_users)
        self.active.update((_packed(user=all_users[place], item=np.concatenate([old_items[stay], states[ends]])[place], us=np.concatenate([old_us[stay], us[ends]])[place]),))
        for k in range(0, len(us), GIVE):
            some = slice(k, k + GIVE)
            user = users[some] if bucket >= 0 else np.full(len(users[some]), None)
            yield pd.DataFrame({"event_id": ids[some], "user_id": user, "item": items[some], "active": states[some]})

    def close(self) -> None:
        pass


def _columns(r: pd.DataFrame) -> list[np.ndarray]:
    return [*(r[c].to_numpy(np.int64) for c in ("us", "event_id", "owner")), _objects(r["item"])]


def _together(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


class _AtOnce(_Selection):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # times, numbers, users and items of the bucket's clicks in this micro-batch
        if parts := [_columns(r) for r in rows]:
            yield from self.applied(key[0], *_together(parts))


class _ByEventTime(_Selection):
    """Clicks wait in a list, an entry for each batch of rows; the bucket's one timer
    stands at the earliest of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "clicks binary")
        self.due = handle.getValueState("due", "ms long")

    def _wake_at(self, ms: int) -> None:
        now = self.due.get()
        if now is None or ms < now[0]:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def _wait(self, clicks: list[np.ndarray]) -> tuple[bytes]:
        return (_packed(**dict(zip(("us", "id", "user", "item"), clicks, strict=True))),)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        users, _, answered = self.known()
        least = None
        for r in rows:
            clicks = _columns(r)
            if len(users):  # Spark drops late clicks by the watermark of the batch before
                at = np.minimum(np.searchsorted(users, clicks[2]), len(users) - 1)
                fresh = (users[at] != clicks[2]) | (clicks[0] // 1000 > answered[at] // 1000)
                clicks = [c[fresh] for c in clicks]
            if len(clicks[0]):
                self.waiting.appendValue(self._wait(clicks))
                least = min(int(clicks[0].min()) // 1000, least if least is not None else 1 << 62)
        if least is not None:
            self._wake_at(least)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        held = _together([_unpacked(bytes(h[0])) for h in self.waiting.get()])
        ripe = held[0] // 1000 <= upto
        self.due.clear()
        if ripe.all():
            self.waiting.clear()
        else:
            self.waiting.put([self._wait([c[~ripe] for c in held])])
            self._wake_at(int(held[0][~ripe].min()) // 1000)
        if ripe.any():
            yield from self.applied(key[0], *(c[ripe] for c in held))


def _dealt(events: DataFrame, buckets: int, delay: str | None = None) -> DataFrame:
    """The clicks grouped by bucket; those without a user have one of their own."""
    ts, user = F.col("ts").cast("timestamp"), F.col("user_id").cast("long")
    us = F.coalesce(F.unix_micros(ts), F.lit(-(1 << 63)))  # no time comes first
    clicks = events.select("event_id", ts.alias("ts"), us.alias("us"), F.coalesce(user, F.lit(0)).alias("owner"), "item", F.when(user.isNull(), -1).otherwise(F.pmod(F.xxhash64(user), F.lit(buckets))).alias("bucket"))
    return (clicks.withWatermark("ts", delay) if delay else clicks).groupBy("bucket")


def selection_stream(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``event_id, user_id, item, active`` of a stream ``event_id, ts, user_id, item``.

    Clicks are put in order of time and id within a micro-batch; those that come in a
    later one are applied then. State is one item per user. A bucket's clicks of one
    micro-batch are held as arrays, so bound it by bytes (``maxBytesPerTrigger`` of the
    source). Start the query within ``rocksdb(spark)``.
    """
    return _dealt(events, buckets).transformWithStateInPandas(_AtOnce(), OUTPUT, "append", "None")


def selection_by_event_time(events: DataFrame, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """The same by event time: a click is answered when the watermark, ``delay`` behind
    the latest click seen, has passed it (to the millisecond), whatever the order in which
    clicks within the delay came; so the answers are those of the batch form. Clicks that
    are later still are dropped, unless nothing of their user after them has been
    answered. State per user is an item and the clicks that wait; those of a bucket are
    held as arrays when they are answered. Start the query within ``rocksdb(spark)``.
    """
    return _dealt(events, buckets, delay).transformWithStateInPandas(_ByEventTime(), OUTPUT, "append", "EventTime")

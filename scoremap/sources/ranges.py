"""Large text files read by byte ranges: features of one FeatureCollection, and CSV records
with line breaks in quotes.

Where a record begins depends on all bytes before: whether they leave a string open, and
how deep brackets are nested. So a first pass over the ranges finds, for every state that
a range may begin in, the state that it ends in; Spark composes these along each file. In
the second pass every task knows the state of its range, finds the records that begin
there, and reads on behind it to the end of the last one. No task reads a whole file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 32 << 20
#: Bytes that a task holds and scans at once.
BLOCK = 4 << 20
QUOTE, ESCAPE, LINE = 0x22, 0x5C, 0x0A
#: States between bytes: outside a string, inside one, inside and behind a backslash.
OUT, IN, ESCAPED = 0, 1, 2


def strings(data: np.ndarray, state: int, escapes: bool) -> tuple[np.ndarray, int]:
    """Per byte whether it is outside of quotes (quotes themselves are not), and the state
    behind the last. With ``escapes`` a backslash inside a string covers the next byte."""
    quote = data == QUOTE
    last = False
    if escapes and len(data):
        slash = data == ESCAPE
        if slash.any() or state == ESCAPED:
            # a byte is covered behind an odd run of backslashes (these occur in strings only)
            at = np.arange(len(data))
            runs = at - np.maximum.accumulate(np.where(slash, -1, at))  # backslashes up to here, this one included
            start = np.maximum.accumulate(np.where(slash, -1, at)) < 0
            runs = runs + np.where(start & slash, state == ESCAPED, 0)
            before = np.append(int(state == ESCAPED), runs[:-1])
            quote = quote & (before % 2 == 0)
            last = bool(slash[-1] and runs[-1] % 2 == 1)
    inside = np.cumsum(quote) + (state != OUT)
    open_ = bool(inside[-1] % 2) if len(data) else state != OUT
    return (inside % 2 == 0) & ~quote, (ESCAPED if last else IN) if open_ else OUT


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))
    return fs.open_input_file(name)


def _blocks(file, start: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
    file.seek(start)
    while start < end and (data := file.read(min(BLOCK, end - start))):
        yield start, np.frombuffer(data, np.uint8)
        start += len(data)


def _nesting(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    step = ((data == 0x7B) | (data == 0x5B)).astype(np.int64) - ((data == 0x7D) | (data == 0x5D))
    return np.where(outside, step, 0)


def _ends(json: bool):
    """Per range, for each state that it may begin in: the state behind it, and by how
    much brackets nest deeper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                states, deeper = [OUT, IN, ESCAPED], [0, 0, 0]
                with _open(path) as file:
                    for _, data in _blocks(file, start, end):
                        for k in range(3 if json else 2):
                            outside, states[k] = strings(data, states[k], json)
                            deeper[k] += int(_nesting(data, outside).sum()) if json else 0
                yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "end": end, "ends": [{"state": s, "deeper": d} for s, d in zip(states, deeper, strict=True)]}], schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ends", pa.list_(pa.struct([("state", pa.int32()), ("deeper", pa.int64())])))]))

    return run


def ranges(spark: SparkSession, path: str, range_bytes: int, json: bool) -> DataFrame:
    """``path, start, end, state, depth`` of every range of the files under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    parts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"), "length")
    parts = parts.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end")).repartition("path", "start")
    each = parts.mapInArrow(_ends(json), "path string, start long, end long, ends array<struct<state:int,deeper:bigint>>")
    # along a file: some bytes per range, whatever the size of the file
    per_file = each.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "ends"))).alias("rs"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,state:int,depth:bigint>>")
    zero = F.struct(F.lit(OUT).alias("state"), F.lit(0).cast("long").alias("depth"), empty.alias("done"))

    def follow(acc, r):
        end = F.get(r["ends"], acc["state"])
        mine = F.struct(r["start"].alias("start"), r["end"].alias("end"), acc["state"].alias("state"), acc["depth"].alias("depth"))
        return F.struct(end["state"].alias("state"), (acc["depth"] + end["deeper"]).alias("depth"), F.concat(acc["done"], F.array(mine)).alias("done"))

    placed = per_file.select("path", F.inline(F.aggregate("rs", zero, follow, lambda acc: acc["done"])))
    return placed.repartition("path", "start")


def _features(path: str, start: int, end: int, state: int, depth: int, level: int) -> Iterator[bytes]:
    """The objects that begin in the range at nesting ``level``."""
    with _open(path) as file:
        size, begun, kept = file.size(), False, []
        for at, data in _blocks(file, start, size):
            outside, state = strings(data, state, True)
            deep = depth + np.cumsum(_nesting(data, outside))
            depth = int(deep[-1])
            opens = np.flatnonzero(outside & (data == 0x7B) & (deep == level + 1))
            closes = np.flatnonzero(outside & (data == 0x7D) & (deep == level))
            opens = opens[opens + at < end]
            raw, k = data.tobytes(), 0
            if begun:
                if not len(closes):
                    kept.append(raw)
                    continue
                yield b"".join([*kept, raw[: closes[0] + 1]])
                begun, kept = False, []
            for o in opens.tolist():
                k = int(np.searchsorted(closes, o))
                if k == len(closes):
                    begun, kept = True, [raw[o:]]
                else:
                    yield raw[o : closes[k] + 1]
            if at + len(data) >= end and not begun:
                return


def _records(path: str, start: int, end: int, state: int, depth: int, level: int) -> Iterator[bytes]:
    """The lines outside of quotes that begin in the range: at the start of the file or
    behind a line break."""
    with _open(path) as file:
        size, kept, first = file.size(), [], start == 0
        begun = first
        if not first:  # a break that ends the range before begins a record here
            file.seek(start - 1)
            begun = file.read(1) == b"\n" and state == OUT
        for at, data in _blocks(file, start, size):
            outside, state = strings(data, state, False)
            breaks, raw, p = np.flatnonzero(outside & (data == LINE)), data.tobytes(), 0
            for b in breaks.tolist():
                if begun:
                    yield b"".join([*kept, raw[p:b]])
                kept, p, begun = [], b + 1, at + b + 1 < end
                if not begun:
                    return
            if begun:
                kept.append(raw[p:])
            elif at + len(data) >= end:
                return
        if begun and (rest := b"".join(kept)):
            yield rest


def _read(find, level: int, placed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, *place in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                some, size = [], 0
                for record in find(path, *place, level):
                    some.append(record.decode("utf-8", "replace").rstrip("\r"))
                    size += len(record)
                    if size > BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(some)], names=["path", "value"])
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(some)], names=["path", "value"])

    return placed.mapInArrow(run, "path string, value string")


def feature_texts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, value``: the JSON text of every object in the arrays of the top-level object of
    each file, as features are in a FeatureCollection."""
    return _read(_features, 2, ranges(spark, path, range_bytes, json=True))


def csv_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, value``: the records of CSV files whose quotes are doubled inside quotes, so
    that line breaks inside of quotes belong to their record; headers are records too."""
    return _read(_records, 0, ranges(spark, path, range_bytes, json=False))

"""Media columns: payloads cut by a rolling gear hash, stored once per chunk, and
put together again from ordered chunk lists.

A first pass notes only digests. Spark joins find which row owns each distinct
chunk; a second pass writes, per distinct payload, its header, its ordered digest
list and the chunks that it owns. Reading back needs no exchange for payloads that
own all their chunks; for the others, only the chunks that they borrow move.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremap.llm.common import materialize, row_id, shared_dir, small_side

MIN_CHUNK, MAX_CHUNK = 512, 8192
#: A cut where these bits of the gear hash are zero: one place in 2048.
CUT_MASK = np.uint32(0xFFE00000)
#: Bytes that a task cuts at once.
BLOCK = 4 << 20
#: A payload is a whole number of frames of this many samples.
FRAME = 576
FILL = 255
SAMPLE_RATE = 16_000


def gear_table() -> np.ndarray:
    """256 random 32-bit values (splitmix64 of 1..256)."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z >> np.uint64(32)).astype(np.uint32)


def cut_places(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Where the gear hash of the last 32 bytes asks for a cut (behind that byte)."""
    with np.errstate(over="ignore"):
        h = gear[data]
        for k in (1, 2, 4, 8, 16):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))  # the right side is made first
    return np.flatnonzero((h & CUT_MASK) == 0) + 1


def chunk_ends(places: np.ndarray, start: int, end: int) -> list[int]:
    """The ends of the chunks of data[start:end]: the first cut behind MIN_CHUNK
    bytes, or MAX_CHUNK. No hash looks back beyond its own chunk."""
    out, at = [], start
    i, n = int(np.searchsorted(places, start)), len(places)
    while at < end:
        low = at + MIN_CHUNK
        while i < n and places[i] < low:
            i += 1
        cut = int(places[i]) if i < n else end
        at = min(cut, at + MAX_CHUNK, end)
        out.append(at)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def wav(text: str | None) -> tuple[bytes, bytes, int]:
    """Header and payload of a text as 8-bit mono samples, and its own bytes: UTF-8,
    filled with FILL to a positive number of frames. Null is empty."""
    raw = (text or "").encode("utf-8", "replace")
    payload = raw + bytes([FILL]) * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))
    head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return head, payload, len(raw)


def wav_samples(media: bytes) -> bytes:
    """The samples of a file that ``wav`` made."""
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("no such file")
    return media[44 : 44 + struct.unpack("<I", media[40:44])[0]]


def wav_feature(media: bytes) -> str:
    """Frames, mean, root mean square about 128, crossings of 128 and peak."""
    x = np.frombuffer(wav_samples(media), np.uint8).astype(np.int32) - 128
    up = x >= 0
    return f"frames={len(x) // FRAME};sum={int(x.sum())};energy={int((x.astype(np.int64) ** 2).sum())};crossings={int((up[1:] != up[:-1]).sum())};peak={int(np.abs(x).max())}"


@dataclass
class MediaStore:
    """index: one row per input row (_rid, key columns, n_bytes, payload_id).
    blobs: one row per distinct payload (owner, payload_id, header, digests, own:
    its owned chunks as (pos, bytes), borrows).
    loans: owner, pos (in the owner), to (the borrower), at (its place)."""

    index: DataFrame
    blobs: DataFrame
    loans: DataFrame


def _cut_batch(payloads: list[bytes], gear: np.ndarray) -> Iterator[list[bytes]]:
    """The chunks of each payload; hashes are made for about BLOCK bytes at once."""
    at = 0
    while at < len(payloads):
        last, size = at, 0
        while last < len(payloads) and (size < BLOCK or last == at):
            size += len(payloads[last])
            last += 1
        data = b"".join(payloads[at:last])
        places, start = cut_places(np.frombuffer(data, np.uint8), gear), 0
        for p in payloads[at:last]:
            ends = chunk_ends(places, start, start + len(p))
            yield [data[a:b] for a, b in zip([start, *ends[:-1]], ends, strict=True)]
            start += len(p)
        at = last


def store(rows: DataFrame, key_cols: list[str], text_col: str = "text", make: Callable = wav) -> MediaStore:
    """Store ``make(text)`` of every row, each distinct chunk once.

    Null and empty texts become one frame of fill; equal texts, and repeated rows,
    share everything; an empty table gives an empty store. A text of any length is
    stored whole, and is in memory as a whole where it is cut. Columns other than
    ``key_cols`` are ignored whatever their names.
    """
    gear = gear_table()
    if clash := {c.lower() for c in key_cols} & {"_rid", "_text", "n_bytes", "payload_id", "digests"}:
        raise ValueError(f"rename the key columns {sorted(clash)}: the store has columns of these names")
    slim = row_id(rows.select(*key_cols, F.col(text_col).alias("_text"))).select("_rid", *key_cols, "_text")

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            lists = [[digest(c) for c in chunks] for chunks in _cut_batch([p for _, p, _ in made], gear)]
            ids = [hashlib.blake2b(h + b"".join(x), digest_size=16).digest() for (h, _, _), x in zip(made, lists, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([n for _, _, n in made], pa.int64()), pa.array(ids, pa.binary()), pa.array(lists, pa.list_(pa.binary()))],
                names=[*batch.schema.names[:-1], "n_bytes", "payload_id", "digests"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    index = materialize(slim.mapInArrow(note, f"{fields}, n_bytes long, payload_id binary, digests array<binary>"), "index")
    # light rows from here on: digests, row numbers and places
    ids = index.select("_rid", "payload_id")
    groups = ids.groupBy("payload_id").agg(F.min("_rid").alias("rep"), F.count("*").alias("n")).where("n > 1").select("payload_id", "rep")
    # rows with an earlier copy; digest lists stay where they are
    groups = materialize(groups, "groups")
    copies = materialize(ids.join(small_side(groups), "payload_id").where("_rid <> rep").select("_rid"), "copies")
    placed = index.select("_rid", "digests").join(small_side(copies), "_rid", "left_anti").select("_rid", F.posexplode("digests").alias("pos", "digest"))
    owners = placed.groupBy("digest").agg(F.min(F.struct("_rid", "pos")).alias("o"))
    loans = materialize(
        placed.join(owners, "digest").where((F.col("o._rid") != F.col("_rid")) | (F.col("o.pos") != F.col("pos"))).select(F.col("o._rid").alias("owner"), F.col("o.pos").alias("pos"), F.col("_rid").alias("to"), F.col("pos").alias("at")),
        "loans",
    )
    skip = materialize(
        copies.select("_rid", F.lit(None).cast("array<int>").alias("skip")).unionByName(loans.groupBy(F.col("to").alias("_rid")).agg(F.collect_list("at").alias("skip"))).withColumn("_known", F.lit(True)),
        "skip",
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, texts, skips = (c.to_pylist() for c in batch.columns)
            made = [make(t) for t in texts]
            own, lists = [], []
            for chunks, s in zip(_cut_batch([p for _, p, _ in made], gear), skips, strict=True):
                s = set(s)
                lists.append([digest(c) for c in chunks])
                own.append([{"pos": i, "bytes": c} for i, c in enumerate(chunks) if i not in s])
            ids = [hashlib.blake2b(h + b"".join(x), digest_size=16).digest() for (h, _, _), x in zip(made, lists, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids, pa.int64()), pa.array(ids, pa.binary()), pa.array([h for h, _, _ in made], pa.binary()), pa.array(lists, pa.list_(pa.binary())), pa.array(own, OWN), pa.array([bool(s) for s in skips], pa.bool_())],
                names=["owner", "payload_id", "header", "digests", "own", "borrows"],
            )

    todo = slim.join(small_side(skip), "_rid", "left").where("_known is null or skip is not null").select("_rid", "_text", F.coalesce("skip", F.array().cast("array<int>")).alias("skip"))
    made = todo.mapInArrow(write, "owner long, payload_id binary, header binary, digests array<binary>, own array<struct<pos:int,bytes:binary>>, borrows boolean")
    path = f"{shared_dir(rows.sparkSession)}/blobs"
    made.write.option("compression", "zstd").parquet(path)
    return MediaStore(index.drop("digests"), rows.sparkSession.read.schema(made.schema).parquet(path), loans)


OWN = pa.list_(pa.struct([("pos", pa.int32()), ("bytes", pa.binary())]))


def read_back(held: MediaStore, feature: Callable[[bytes], str] = wav_feature) -> DataFrame:
    """``payload_id, media binary, feature`` per distinct payload: its header and its
    chunks in order, each checked against its digest."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heads, lists, own, lent = (c.to_pylist() for c in batch.columns)
            out, size, first = [], 0, 0
            for k in range(len(ids)):
                got = {x["pos"]: x["bytes"] for x in [*(own[k] or []), *(lent[k] or [])]}
                chunks = [got[i] for i in range(len(lists[k]))]
                if [digest(c) for c in chunks] != lists[k]:
                    raise ValueError("a chunk differs from its digest")
                out.append(heads[k] + b"".join(chunks))
                size += len(out[-1])
                if size > BLOCK or k == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first : k + 1], pa.binary()), pa.array(out, pa.binary()), pa.array([feature(m) for m in out], pa.string())], names=["payload_id", "media", "feature"])
                    out, size, first = [], 0, k + 1

    lent_schema = "array<struct<pos:int,bytes:binary>>"
    cols = ["payload_id", "header", "digests", "own", "lent"]
    whole = held.blobs.where("not borrows").withColumn("lent", F.lit(None).cast(lent_schema))
    lenders = materialize(held.loans.select("owner").distinct(), "lenders")
    wanted = held.blobs.join(small_side(lenders), "owner", "left_semi").select("owner", F.explode("own").alias("c")).select("owner", F.col("c.pos").alias("pos"), F.col("c.bytes").alias("bytes"))
    lent = wanted.join(held.loans, ["owner", "pos"]).groupBy("to").agg(F.collect_list(F.struct(F.col("at").alias("pos"), "bytes")).alias("lent"))
    parts = held.blobs.where("borrows").join(lent.withColumnRenamed("to", "owner"), "owner")
    return whole.select(*cols).unionByName(parts.select(*cols)).mapInArrow(assemble, "payload_id binary, media binary, feature string")

"""Line dedup by a segment-partition edit join.

Within n edits of each other, two lines share at least one of n + 1 segments of the
shorter one exactly. So each line is indexed by its segments under its length, and
probes, for every length that may match, the substrings that can align with a segment
there (the multi-match-aware choice of starts). Where many lines share a segment, what
is left of them without it must be within the same edits, so they meet under segments
of these rests instead, and so on. Only lines that meet under a key are
fetched; pairs whose letter counts differ too much drop out in the join, and a banded
bit-parallel automaton decides on the others. How many edits count grows with the
length of the shorter line, so that short lines do not chain up with everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremap.llm.common import materialize, row_id, small_side
from scoremap.llm.components import components
from scoremap.llm.shingles import mix, powers

#: Most edits (insertions, deletions, substitutions of code points) between two
#: linked lines, and code points of the shorter line for each of them.
LIMIT, PER_EDIT = 2, 8
BLOCK = 1 << 20
#: Lines under one key above which these are told apart by finer keys, at most so often.
HOT_KEY, ROUNDS = 256, 3
_BASE = 0xD1342543DE82EF95


def allowed(length, limit: int = LIMIT):
    """The edits that a line of this length may be away from one that is as long or
    longer: one for each PER_EDIT code points, ``limit`` at most."""
    return np.minimum(length // PER_EDIT, limit)


def line_key(line: Column) -> Column:
    return F.xxhash64(line)


def _line_key(raw: bytes) -> int:
    """The same in Python (xxHash64 with Spark's seed), as a signed number."""
    h = xxhash.xxh64_intdigest(raw, 42)
    return h - (1 << 64) if h >> 63 else h


def _segments(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of lines cut into ``parts`` nearly equal ones."""
    base, longer = length // parts, length % parts
    return i * base + np.maximum(0, i - (parts - longer)), base + (i >= parts - longer)


def aligned(lengths: np.ndarray, target: np.ndarray, edits: int, delta: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(which lines, start, size, segment, shift) of the substrings of lines that are
    ``delta`` longer than ``target`` which can align with a segment of ``target`` code
    points within ``edits``."""
    for i in range(edits + 1):
        start, size = _segments(target, i, edits + 1)
        low, high = max(-i, delta - (edits - i)), min(i, delta + (edits - i))
        for shift in range(low, high + 1):
            s = start + shift
            ok = np.flatnonzero((s >= 0) & (s + size <= lengths))
            yield ok, s[ok], size[ok], i, shift


def probes(lengths: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(which lines, start, size, salt, indexed) of every key of lines of these
    lengths. The salt tells length and segment apart."""
    for edits in range(1, limit + 1):  # of targets of so many edits
        for delta in range(edits + 1):
            fits = np.flatnonzero(allowed(lengths - delta, limit) == edits)
            target = lengths[fits] - delta
            for ok, start, size, i, shift in aligned(lengths[fits], target, edits, delta):
                yield fits[ok], start, size, (target[ok] * 64 + i).astype(np.uint64), delta == 0 and shift == 0


class _Hashes:
    """Hashes of substrings of lines, by place in all of them put together."""

    def __init__(self, lines: list[str]):
        text = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32)
        self.lengths = np.array([len(x) for x in lines], np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        up, self.down = powers(_BASE, len(text) + 1), powers(pow(_BASE, -1, 1 << 64), len(text) + 1)
        self.prefix = np.zeros(len(text) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mix(text.astype(np.uint64)) * up[:-1], out=self.prefix[1:])

    def keys(self, who: np.ndarray, start: np.ndarray, size: np.ndarray, salt: np.ndarray) -> np.ndarray:
        a = self.begin[who] + start
        with np.errstate(over="ignore"):
            return mix(mix((self.prefix[a + size] - self.prefix[a]) * self.down[a]) ^ mix(salt))


def keys_of(lines: list[str], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the line, key, indexed) of all keys of these lines."""
    hashes = _Hashes(lines)
    found = [(ok, hashes.keys(ok, start, size, salt), np.full(len(ok), is_index)) for ok, start, size, salt, is_index in probes(hashes.lengths, limit)]
    who, keys, indexed = (np.concatenate(x) for x in zip(*found, strict=True))
    return who, keys.view(np.int64), indexed


def _rests(lines: list[str], limit: int, hot: list[int]) -> list[tuple[int, str, int, int, bool]]:
    """(number of the line, what is left of it, target, edits, indexed) where a line has its
    hot key: the segment is cut out, so the rests of linked lines are within the same
    edits, and the target loses its length."""
    hashes, wanted, out = _Hashes(lines), np.array(hot, np.int64), []
    for edits in range(1, limit + 1):
        for delta in range(edits + 1):
            fits = np.flatnonzero(allowed(hashes.lengths - delta, limit) == edits)
            target = hashes.lengths[fits] - delta
            for ok, start, size, i, shift in aligned(hashes.lengths[fits], target, edits, delta):
                keys = hashes.keys(fits[ok], start, size, (target[ok] * 64 + i).astype(np.uint64)).view(np.int64)
                for k in np.flatnonzero(keys == wanted[fits[ok]]).tolist():
                    j, a, n = int(fits[ok[k]]), int(start[k]), int(size[k])
                    out.append((j, lines[j][:a] + lines[j][a + n :], int(target[ok[k]]) - n, edits, delta == 0 and shift == 0))
    return out


def _finer(rests: list[tuple[int, str, int, int, bool]], keys: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, str, int, int, bool]]]:
    """(number of the rest, finer key, indexed, what is then left) of all keys that segments
    of these rests have under the key so far."""
    if not rests:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), []
    hashes = _Hashes([r[1] for r in rests])
    target, edits, is_index = (np.array([r[k] for r in rests]) for k in (2, 3, 4))
    old = np.array(keys, np.int64).view(np.uint64)
    delta, found, left = hashes.lengths - target, [], []
    for e in np.unique(edits).tolist():
        for d in np.unique(delta[edits == e]).tolist():
            fits = np.flatnonzero((edits == e) & (delta == d))
            for ok, start, size, i, shift in aligned(hashes.lengths[fits], target[fits], e, d):
                mine = fits[ok]
                with np.errstate(over="ignore"):
                    salt = mix(old[mine]) + (target[mine] * 64 + i).astype(np.uint64)
                found.append((mine, hashes.keys(mine, start, size, salt), is_index[mine] & (shift == 0) & (d == 0)))
                left += [(rests[j][0], rests[j][1][:a] + rests[j][1][a + n :], rests[j][2] - n, e, bool(x)) for j, a, n, x in zip(mine.tolist(), start.tolist(), size.tolist(), found[-1][2].tolist(), strict=True)]
    who, new, indexed = (np.concatenate(x) for x in zip(*found, strict=True))
    return who, new.view(np.int64), indexed, left


def _refine(limit: int):
    """Rows ``chain, line, text``: the keys under which a line is in hot groups, one finer
    than the other. Out come its keys one step finer."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains, lines, texts = (c.to_pylist() for c in batch.columns)
            rests = _rests(texts, limit, [c[0] for c in chains])
            depth = np.array([len(c) for c in chains], np.int64)
            for step in range(1, int(depth.max(initial=1)) + 1):
                who, new, indexed, left = _finer(rests, [chains[r[0]][step - 1] for r in rests])
                row = np.array([r[0] for r in rests], np.int64)[who] if len(who) else who
                last = np.flatnonzero(depth[row] == step) if len(row) else row
                lists = [[*chains[row[k]], int(new[k])] for k in last.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(new[last]), pa.array([lines[row[k]] for k in last.tolist()], pa.int64()), pa.array(indexed[last]), pa.array(lists, pa.list_(pa.int64()))], names=["key", "line", "indexed", "chain"])
                wanted = [chains[r][step] if step < len(chains[r]) else None for r in row.tolist()]
                rests = [left[k] for k in range(len(left)) if wanted[k] is not None and wanted[k] == new[k]]

    return refine


def within(a: str, b: str, limit: int) -> bool:
    """Whether at most ``limit`` edits turn a into b. One machine word per number of
    edits holds the diagonals of the band; each character of b is one step."""
    m, n = len(a), len(b)
    if abs(m - n) > limit:
        return False
    lead = 0
    most = min(m, n)
    while lead + 64 <= most and a[lead : lead + 64] == b[lead : lead + 64]:
        lead += 64
    while lead < most and a[lead] == b[lead]:
        lead += 1
    while m > lead and n > lead and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    if m - lead == 0 or n - lead == 0:
        return max(m, n) - lead <= limit
    a, b = a[lead:m], b[lead:n]
    m, n = len(a), len(b)
    full = (1 << (2 * limit + 1)) - 1
    # bit d + limit of reach[e]: a[: j + d] turns into b[:j] with at most e edits
    reach = []
    for e in range(limit + 1):
        bits = 0
        for d in range(0, min(e, m) + 1):
            bits |= 1 << (d + limit)
        reach.append(bits)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + limit)
    for j in range(n):
        hit = places.get(b[j], 0) >> j & full
        low, high = max(0, limit - (j + 1)), min(2 * limit, m - (j + 1) + limit)
        valid = (((1 << (high + 1)) - 1) >> low) << low if high >= low else 0
        new = [reach[0] & hit & valid]
        for e in range(1, limit + 1):
            new.append(((reach[e] & hit) | reach[e - 1] | (reach[e - 1] >> 1) | (new[e - 1] << 1)) & valid)
        reach = new
        if not reach[limit]:
            return False
    return bool(reach[limit] >> (m - n + limit) & 1)


def _blocks(texts: Iterator[str | None]) -> Iterator[list[str]]:
    """Distinct lines of a task that may have neighbours, about BLOCK code points at
    a time."""
    seen: set[bytes] = set()
    block, size = [], 0
    for t in texts:
        for line in (t or "").split("\n"):
            if len(line) >= PER_EDIT and (h := xxhash.xxh3_128_digest(line.encode("utf-8", "replace"))) not in seen:
                seen.add(h)
                block.append(line)
                size += len(line)
        if size >= BLOCK:
            yield block
            block, size = [], 0
        if len(seen) > 1 << 20:
            seen.clear()
    if block:
        yield block


def _emit(limit: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(t for batch in batches for t in batch.column(0).to_pylist()):
            own = np.array([_line_key(x.encode("utf-8", "replace")) for x in block], np.int64)
            who, keys, indexed = keys_of(block, limit)
            order = np.argsort(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[order]), pa.array(own[who[order]]), pa.array(indexed[order])], names=["key", "line", "indexed"])

    return emit


def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``counts``: 16 classes of code points, each counted modulo 16, in one number."""
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    for batch in batches:
        out = []
        for line in batch.column("line").to_pylist():
            classes = mix(np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)) & np.uint64(15)
            counts = np.bincount(classes.astype(np.int64), minlength=16).astype(np.uint64) & np.uint64(15)
            out.append(int(np.bitwise_or.reduce(counts << shift).view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "counts"])


def _count_distance(a: Column, b: Column) -> Column:
    """At most two per edit: the sum over classes of the counts' differences."""
    total = F.lit(0)
    for k in range(16):
        x = F.shiftrightunsigned(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * k).bitwiseAND(F.lit(15))
        d = x.bitwiseAND(F.lit(15))
        total = total + F.least(d, 16 - d)
    return total


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("_rid", F.posexplode(F.split(F.coalesce("_text", F.lit("")), "\n", -1)).alias("line_no", "line"))


def edit_links(docs: DataFrame, limit: int = LIMIT, hot_key: int = HOT_KEY) -> tuple[DataFrame, DataFrame]:
    """``a, b``: the keys of distinct lines (``a < b``) within the edits that the
    shorter one allows, ``limit`` at most; and ``key, check``: a second hash of the
    lines that were compared."""
    keys = materialize(docs.select("_text").mapInArrow(_emit(limit), "key long, line long, indexed boolean"), "keys")
    needed, rounds = None, []
    for step in range(ROUNDS + 1):
        # keys under which an indexed line meets another one
        met = keys.groupBy("key").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.max("indexed").alias("any"), F.count("*").alias("n")).where("any and lo < hi")
        met = materialize(met.select("key", (F.col("n") > hot_key).alias("hot")), "met")
        both = materialize(keys.join(small_side(met), "key").distinct(), "both")
        if step == 0:
            needed = materialize(both.select(F.col("line").alias("key")).distinct(), "needed")
            text = _lines(docs).select(line_key(F.col("line")).alias("key"), "line").join(small_side(needed), "key", "left_semi").distinct()
            text = materialize(text.mapInArrow(_with_counts, "key long, line string, counts long"), "text")
        chained = "chain" in both.columns
        again = both.where("hot") if step < ROUNDS else both.where("false")
        cold = both.where("not hot") if step < ROUNDS else both
        rounds.append(cold.select("key", "line", "indexed"))
        if step == ROUNDS or met.where("hot").isEmpty():
            break
        # a hot segment does not pair its lines: their rests meet under segments of their own
        chain = F.col("chain") if chained else F.array("key")
        asked = again.select(chain.alias("chain"), F.col("line").alias("key")).distinct().join(text.select("key", F.col("line").alias("text")), "key").select("chain", F.col("key").alias("line"), "text")
        keys = materialize(asked.mapInArrow(_refine(limit), "key long, line long, indexed boolean, chain array<long>").distinct(), "finer")
    both = reduce(DataFrame.unionByName, rounds)
    counted = both.join(text.select(F.col("key").alias("line"), "counts"), "line")
    x, y = counted.where("indexed").alias("x"), counted.alias("y")
    near = _count_distance(F.col("x.counts"), F.col("y.counts")) <= 2 * limit
    pairs = x.join(y, F.col("x.key") == F.col("y.key")).where((F.col("x.line") != F.col("y.line")) & near)
    pairs = materialize(pairs.select(F.least("x.line", "y.line").alias("a"), F.greatest("x.line", "y.line").alias("b")).distinct(), "pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, s, t = (c.to_pylist() for c in batch.columns)
            near = [k for k in range(len(a)) if within(s[k], t[k], int(allowed(min(len(s[k]), len(t[k])), limit)))]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in near], pa.int64()), pa.array([b[k] for k in near], pa.int64())], names=["a", "b"])

    left = text.select(F.col("key").alias("a"), F.col("line").alias("s"))
    right = text.select(F.col("key").alias("b"), F.col("line").alias("t"))
    links = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(compare, "a long, b long").distinct(), "links")
    return links, text.select("key", F.crc32("line").alias("check"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, hot_key: int = HOT_KEY) -> DataFrame:
    """One row per line of every row: ``_rid, <id_col>, line_no, class_doc, class_line,
    n_copies, n_links, kept``.

    Lines end at ``\\n``; a null or empty text is one empty line, an empty table gives
    no rows, lines of any length are read whole and other columns are ignored. Lines
    are linked within one edit for each PER_EDIT code points of the shorter one,
    ``limit`` at most (so lines of under PER_EDIT code points equal exact copies only);
    a class is what exact copies and links connect, named by its first line (smallest
    id, null ids last, then line number; of repeated rows one), which alone is kept.
    ``n_copies`` counts exact copies of the line, itself included, ``n_links`` the
    other distinct lines linked to it.
    """
    base = row_id(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    links, checks = edit_links(base, limit, hot_key)
    degree = links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("n_links"))
    label = components(links).select(F.col("v").alias("key"), F.col("c").alias("class"))
    known = materialize(degree.join(label, "key").join(checks, "key"), "known")
    lines = _lines(base).select("_rid", "line_no", line_key(F.col("line")).alias("key"), F.crc32("line").alias("check"))
    ids = base.select("_rid", "_id")
    # the second hash keeps lines apart that share the first
    lines = lines.join(small_side(known), ["key", "check"], "left").withColumn("class_check", F.when(F.col("class").isNull(), F.col("check")))
    lines = materialize(lines.withColumn("class", F.coalesce("class", "key")), "lines")
    of_text = lines.groupBy("key", "check").agg(F.count("*").alias("n_copies"))
    placed = lines.join(ids, "_rid")
    first = F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_rid").alias("rid"), "line_no")).alias("f")
    of_class = placed.groupBy("class", "class_check").agg(first)
    out = placed.join(of_text, ["key", "check"]).alias("l")
    out = out.join(of_class.alias("c"), (F.col("l.class") == F.col("c.class")) & F.col("l.class_check").eqNullSafe(F.col("c.class_check")))
    return out.select(
        "l._rid",
        F.col("l._id").alias(id_col),
        F.col("l.line_no").cast("long").alias("line_no"),
        F.col("f.id").alias("class_doc"),
        F.col("f.line_no").cast("long").alias("class_line"),
        "l.n_copies",
        F.coalesce("l.n_links", F.lit(0)).cast("long").alias("n_links"),
        ((F.col("f.rid") == F.col("l._rid")) & (F.col("f.line_no") == F.col("l.line_no"))).alias("kept"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``_rid, <id_col>, text``: every text with its kept lines only, in order."""
    kept = line_dedup(docs, id_col, text_col, limit).where("kept").select("_rid", "line_no")
    base = row_id(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    stay = kept.groupBy("_rid").agg(F.sort_array(F.collect_list("line_no")).alias("nos"))
    text = F.array_join(F.transform(F.coalesce("nos", F.array().cast("array<long>")), lambda i: F.get(F.split(F.coalesce("_text", F.lit("")), "\n", -1), i.cast("int"))), "\n")
    return base.join(stay, "_rid", "left").select("_rid", F.col("_id").alias(id_col), text.alias("text"))

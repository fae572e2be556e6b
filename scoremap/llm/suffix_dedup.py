"""Repeated passages by a run-length suffix index.

Two places that share MATCH bytes also share the smallest K-byte gram hash within
them, so each text is reduced to such anchors. Anchors whose gram occurs once drop
out. The distinct contexts of the others go into indexes, with those anchors together
that first occur in the same part of a text, so that neighbouring contexts of a row
are one piece: the Burrows-Wheeler transform of the pieces, kept as runs with suffix
samples at run ends. A context that occurs n times stands there once, as its copies
only lengthen runs. The longest match of every place with a place elsewhere is streamed
from the samples: it is measured only at run ends and falls by one per byte in between.
Places that match MATCH bytes or more are marked, and every occurrence of a context
gets the marks of the one that was indexed; contexts are told apart by two 64-bit
hashes, of the gram and of the context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremap.llm.common import discard, materialize, release, row_id, small_side
from scoremap.llm.shingles import OTHER_BASE, Hasher, mix

MATCH = 200
K = 64
#: Bytes that a task hashes, and that one index covers, at once.
BLOCK = 1 << 20
INDEX_BYTES = 1 << 18
#: Anchors that first occur within so many bytes of a text are indexed together, as
#: long as their pieces are not more than LARGE bytes; beyond that anchor by anchor.
PART, LARGE = 4096, 1 << 21
#: An anchor with more distinct contexts than one index should hold is dealt out by
#: ranges of windows.
MANY = 2048
RANGE = 16
#: An odd number, so that places in equal contexts give digests far apart.
OFF = 0x2545F4914F6CDD1D
SEPARATOR = 0xFF  # no byte of UTF-8
SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
SPAN_TYPE = "array<struct<a:int,b:int>>"


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] at each i (shorter at the end), by doubling."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = op(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hasher: Hasher, match: int = MATCH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place in it, gram hash, start and end of the context in
    ``data``) of every anchor.

    ``data`` holds the texts one after another. A gram is an anchor if its hash is
    the smallest in some ``match`` bytes of its text; its context are all ``match``
    bytes around it that hold it.
    """
    width = match - k + 1
    none = np.zeros(0, np.int64)
    if len(data) < match:
        return none, none, none, none, none
    prefix = hasher.prefix(data)
    at = np.arange(len(data) - k + 1)
    h = hasher.between(prefix, at, at + k)
    ends = starts + sizes
    text = np.repeat(np.arange(len(starts)), sizes)[: len(h)]
    inside = at + k <= ends[text]
    h[~inside] = np.uint64(2**64 - 1)
    least = _sliding(h, width, np.minimum)
    least[at + match > ends[text]] = 0  # no whole window starts here
    most = _sliding(least[::-1], width, np.maximum)[::-1]
    found = np.flatnonzero((most == h) & inside & (sizes[text] >= match))
    own = text[found]
    a = np.maximum(starts[own], found - width + 1)
    b = np.minimum(ends[own], found + match)
    return own, found - starts[own], h[found].view(np.int64), a, b


def to_separator(t: np.ndarray) -> np.ndarray:
    """Bytes from each place to the next separator; ``t`` ends with one."""
    ends = np.flatnonzero(t == SEPARATOR)
    return np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(t))


def first_letters(t: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, int]:
    """As many letters from each place on as a word holds, in one number that keeps
    their order, and how many these are. Nothing counts behind a separator."""
    there = np.bincount(t, minlength=256) > 0
    bits = int(there.sum()).bit_length()
    have = 62 // bits
    one = np.cumsum(there)[t].astype(np.int64)  # letters that occur, from 1

    def then(x: np.ndarray, y: np.ndarray, at: int, size: int) -> np.ndarray:
        out = x << (bits * size)
        if at < len(y):
            out[: len(y) - at] |= y[at:]
        return out

    key, got, done = None, 0, 0
    part, size = one, 1
    while size <= have:  # numbers of 1, 2, 4 ... letters; those of ``have`` put together
        if have & size:
            key = part if key is None else then(part, key, size, got)
            got += size
        part, size = then(part, part, size, size), 2 * size
    near = np.flatnonzero(room < have)
    keep = (bits * (have - 1 - room[near])).astype(np.int64)
    key[near] = (key[near] >> keep) << keep
    return key, have


def suffix_order(t: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling the sorted prefixes from one machine word on; only
    suffixes that still share their place are sorted again. Every separator is a
    letter of its own, in order of place."""
    n = len(t)
    key, have = first_letters(t, room)
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.empty(n, bool)
    new[0], new[1:] = True, s[1:] != s[:-1]
    new |= (room < have)[order]
    slots, some = np.arange(n), order
    rank = np.empty(n, np.int64)
    while True:
        rank[some] = np.maximum.accumulate(np.where(new, slots, 0))
        tied = ~(new & np.append(new[1:], True))
        if not tied.any():
            return order
        slots, some = slots[tied], some[tied]
        key = rank[some] * np.int64(n + 1) + rank[some + have]
        again = np.argsort(key)
        s, some = key[again], some[again]
        order[slots] = some
        new = np.concatenate([[True], s[1:] != s[:-1]])
        have *= 2


class RunIndex:
    """Runs of the transform of ``t`` and, per run, the suffixes at its two ends with
    the bytes that they share with their neighbours in the next runs."""

    def __init__(self, t: np.ndarray):
        self.t, self.room = t, to_separator(t)
        order = suffix_order(t, self.room)
        last = t[order - 1]  # the byte before each suffix; the last one is a separator
        head = np.concatenate([[True], (last[1:] != last[:-1]) | (last[1:] == SEPARATOR)])
        first = np.flatnonzero(head)
        end = np.append(first[1:], len(t)) - 1
        self.run_bytes, self.run_sizes = last[first], end - first + 1
        self.starts, self.ends = order[first], order[end]
        # what the last suffix of a run shares with the first one of the next run
        self.shared = self._common(self.ends[:-1], self.starts[1:])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The bytes that two suffixes share, not beyond a separator."""
        padded = np.concatenate([self.t, np.zeros(8, np.uint8)])
        words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        shared, live = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):
            p, q = a[live] + shared[live], b[live] + shared[live]
            room = np.minimum(self.room[p], self.room[q])
            live, p, q, room = live[room > 0], p[room > 0], q[room > 0], room[room > 0]
            differ = words[p] != words[q]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
            shared[live] += np.minimum(same, room)
            live = live[(same == 8) & (room > 8)]
        return shared

    def longest(self) -> np.ndarray:
        """For each place the longest match with any other place. From a sampled suffix
        on it falls by one per byte up to the next sample, for the neighbour above and
        the one below alike; the ends of the whole order lack one of the two."""
        at = np.arange(len(self.t))
        out = np.zeros(len(self.t), np.int64)
        for places, values in ((self.starts, np.append(0, self.shared)), (self.ends, np.append(self.shared, 0))):
            sampled = np.zeros(len(self.t), np.int64)
            sampled[places] = places
            value = np.zeros(len(self.t), np.int64)
            value[places] = values + places
            here = np.maximum.accumulate(sampled)
            np.maximum(out, value[here] - at, out=out)
        return out


def repeats(pieces: list[bytes], match: int = MATCH, copied: list[tuple[int, int, int]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Whether ``match`` bytes that start at each place of the joined pieces also start
    elsewhere, and where each piece begins there. Matches do not run over the end of a
    piece. ``copied`` are spans (piece, start, end) with copies outside the pieces."""
    t = np.frombuffer(b"".join(p + bytes([SEPARATOR]) for p in pieces), np.uint8)
    found = RunIndex(t).longest()
    size = np.array([len(p) for p in pieces])
    begin = np.cumsum(size + 1) - size - 1
    for i, a, b in copied:  # the suffix of a copy is a neighbour up to the copy's end
        some = found[begin[i] + a : begin[i] + b]
        np.maximum(some, np.arange(b - a, 0, -1), out=some)
    return (found >= match) & (to_separator(t) >= match), begin


def match_starts(pieces: list[bytes], match: int = MATCH) -> list[np.ndarray]:
    """Per piece, the starts of ``match`` bytes that also start elsewhere."""
    if not pieces:
        return []
    hit, begin = repeats(pieces, match)
    return [np.flatnonzero(hit[a : a + len(p)]) for a, p in zip(begin.tolist(), pieces, strict=True)]


def _blocks(texts: list) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < BLOCK or end == at):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def find_anchors(texts: DataFrame, match: int, k: int) -> DataFrame:
    """``h, c, _rid, pos`` of ``_rid, _text``: hash of the gram, digest of the context and
    of the anchor's place in it, row and place. Contexts are told apart by both."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, digest = Hasher(), xxhash.xxh3_64_digest
        for batch in batches:
            rid, text = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in _blocks(text):
                raw = [_raw(t) for t in text[a:b]]
                data = b"".join(raw)
                sizes = np.array([len(r) for r in raw], np.int64)
                own, pos, h, start, end = anchors(np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes, sizes, hasher, match, k)
                c = np.frombuffer(b"".join([digest(data[x:y]) for x, y in zip(start.tolist(), end.tolist(), strict=True)]), np.int64)
                # two anchors of a short text may both have all of it as their context
                off = pos - (start - (np.cumsum(sizes) - sizes)[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(c + off * OFF, pa.int64()), pa.array(rid[a:b][own], pa.int64()), pa.array(pos.astype(np.int32), pa.int32())], names=["h", "c", "_rid", "pos"]
                )

    return texts.mapInArrow(find, "h long, c long, _rid long, pos int")


#: A piece of a row from ``start`` on that holds the contexts of the listed anchors.
SNIPPET = "part long, hot boolean, _rid long, start int, piece binary, h array<long>, c array<long>, n array<long>, pos array<int>"


def _snippets(texts: DataFrame, asked: DataFrame, match: int, k: int) -> DataFrame:
    """SNIPPET rows with the bytes of the asked contexts (h, c, n, part, hot, _rid,
    pos). Overlapping ones of a row and part are one piece; hot ones stand alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = match - k
        for batch in batches:
            want = batch.column(2)
            part, hot, h, c, n, pos = (want.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("part", "hot", "h", "c", "n", "pos"))
            row = np.repeat(np.arange(len(batch)), want.value_lengths().to_numpy(zero_copy_only=False))
            raw = [_raw(t) for t in batch.column(1).to_pylist()]
            order = np.lexsort((pos, part, row))
            part, hot, h, c, n, pos, row = (x[order] for x in (part, hot, h, c, n, pos, row))
            start, end = np.maximum(pos - back, 0), pos + match
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1]) | (start[1:] > end[:-1]) | hot[1:] | hot[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row))[: len(first)] - 1
            pieces = [raw[i][a:b] for i, a, b in zip(row[first].tolist(), start[first].tolist(), end[last].tolist(), strict=True)]
            offsets = pa.array(np.append(first, len(row)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h, c, n, pos)]
            cols = [pa.array(part[first]), pa.array(hot[first]), pa.array(batch.column(0).to_numpy()[row[first]], pa.int64()), pa.array(start[first].astype(np.int32)), pa.array(pieces, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SNIPPET.split(", ")])

    want = materialize(asked.groupBy("_rid").agg(F.collect_list(F.struct("part", "hot", "h", "c", "n", "pos")).alias("want")), "want")
    made = materialize(texts.join(small_side(want), "_rid").select("_rid", "_text", "want").mapInArrow(cut, SNIPPET), "snippets")
    discard(want)
    return made


MARKS = "h long, c long, a int, b int"


def _marks(h: np.ndarray, c: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """MARKS rows: the runs of each context, from the place of its anchor."""
    each = [len(a) for a, _ in spans]
    flat = lambda k: np.concatenate([x[k] for x in spans]).astype(np.int32) if spans else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(h, each), pa.int64()), pa.array(np.repeat(c, each), pa.int64()), pa.array(flat(0), pa.int32()), pa.array(flat(1), pa.int32())], names=["h", "c", "a", "b"])


def _alone(rows: list[tuple], match: int, back: int) -> list[list[tuple]]:
    """The same contexts with a piece for each, anchor by anchor."""
    each: dict[int, list[tuple]] = {}
    for rid, start, piece, h, c, n, pos in rows:
        for i, p in enumerate(pos.tolist()):
            a = max(p - back, 0)
            each.setdefault(int(h[i]), []).append((rid, a, piece[a - start : p + match - start], *(x[i : i + 1] for x in (h, c, n, pos))))
    return list(each.values())


def _solve(rows: list[tuple], match: int, back: int) -> pa.RecordBatch:
    """The marks of the contexts in these pieces: (rid, start, piece, h, c, n, pos)."""
    rows.sort(key=lambda r: r[:2])
    pieces: list[bytearray] = []
    at, last = [], None
    for rid, start, piece, *_ in rows:  # what overlaps becomes one: each place is there once
        if last and last[0] == rid and start <= last[1] + len(pieces[-1]):
            pieces[-1] += piece[last[1] + len(pieces[-1]) - start :]
        else:
            last = (rid, start)
            pieces.append(bytearray(piece))
        at.append((len(pieces) - 1, last[1]))
    each = [len(r[6]) for r in rows]
    piece, base = (np.repeat(np.array([x[k] for x in at], np.int64), each) for k in (0, 1))
    h, c, n, pos = (np.concatenate([r[k] for r in rows]).astype(np.int64) for k in (3, 4, 5, 6))
    size = np.array([len(p) for p in pieces], np.int64)
    start = np.maximum(pos - back, 0) - base
    end = np.minimum(pos + match - base, size[piece])
    many = np.flatnonzero(n > 1)
    hit, begin = repeats([bytes(p) for p in pieces], match, list(zip(piece[many].tolist(), start[many].tolist(), end[many].tolist(), strict=True)))
    before = np.append(0, np.cumsum(hit))
    first, stop = begin[piece] + start, begin[piece] + end - match + 1
    got = before[stop] - before[first]
    whole, some = np.flatnonzero(got == stop - first), np.flatnonzero((got > 0) & (got < stop - first))
    spans = [_spans(np.flatnonzero(hit[first[i] : stop[i]]) + (start[i] + base[i] - pos[i]), match) for i in some.tolist()]
    times = [len(a) for a, _ in spans]
    own = np.concatenate([whole, np.repeat(some, times)]).astype(np.int64)
    a = np.concatenate([(start + base - pos)[whole], *(x for x, _ in spans)]).astype(np.int32)
    b = np.concatenate([(end + base - pos)[whole], *(x for _, x in spans)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(c[own]), pa.array(a), pa.array(b)], names=["h", "c", "a", "b"])


def _by_index(snippets: DataFrame, match: int, k: int) -> DataFrame:
    """The marks of contexts. Whole parts of texts are indexed, INDEX_BYTES at a time."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = match - k

        def close(rows: list[tuple], held: list[tuple], held_size: int) -> Iterator[pa.RecordBatch]:
            if held_size <= LARGE:
                rows += held
                return
            some, size = [], 0
            for group in _alone(held, match, back):
                some += group
                size += sum(len(r[2]) for r in group)
                if size >= INDEX_BYTES:
                    yield _solve(some, match, back)
                    some, size = [], 0
            if some:
                yield _solve(some, match, back)

        rows, size, part, held, held_size = [], 0, None, [], 0
        for batch in batches:
            parts, rids, starts = (batch.column(f).to_pylist() for f in ("part", "_rid", "start"))
            pieces = batch.column("piece").to_pylist()
            ends = np.cumsum(batch.column("c").value_lengths().to_numpy(zero_copy_only=False)).tolist()
            flat = [batch.column(f).flatten().to_numpy() for f in ("h", "c", "n", "pos")]
            for i, (p, e) in enumerate(zip(parts, ends, strict=True)):
                if p != part:
                    yield from close(rows, held, held_size)
                    size, part, held, held_size = size + held_size * (held_size <= LARGE), p, [], 0
                    if size >= INDEX_BYTES:
                        yield _solve(rows, match, back)
                        rows, size = [], 0
                b = ends[i - 1] if i else 0
                held.append((rids[i], starts[i], pieces[i], *(x[b:e] for x in flat)))
                held_size += len(pieces[i])
        yield from close(rows, held, held_size)
        if rows:
            yield _solve(rows, match, back)

    parts = int(snippets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return snippets.drop("hot").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(look_up, MARKS)


def _spans(starts: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts as runs: those at most ``match`` apart overlap or touch."""
    cut = np.flatnonzero(np.diff(starts) > match)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + match


def _window_keys(snippets: DataFrame, match: int, width: int) -> DataFrame:
    """``h, c, n, off, w, v``: two keys of ``off`` and of the bytes that the windows
    which begin ``off`` to ``off + width - 1`` bytes before the anchor have in common.
    With an array column ``offs``, only windows within RANGE of one of these."""
    near = "offs" in snippets.columns

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = Hasher(), Hasher(OTHER_BASE)
        for batch in batches:
            h, c, n, pos, start = (batch.column(x).to_numpy().astype(np.int64) for x in ("h", "c", "n", "pos", "start"))
            pieces = batch.column("piece").to_pylist()
            size = np.array([len(p) for p in pieces], np.int64)
            base = np.cumsum(size) - size
            data = np.frombuffer(b"".join(pieces), np.uint8)
            prefixes = [x.prefix(data) for x in hashers]
            low, high = np.maximum(0, pos + match - start - size), pos - start
            wanted = [set(x) for x in batch.column("offs").to_pylist()] if near else None
            for off in range(0, int(high.max(initial=-1)) + 1, width):
                ok = (off <= high) & (off + width - 1 >= low)
                if near:
                    ok &= np.array([off - off % RANGE in x for x in wanted])
                i = np.flatnonzero(ok)
                a = base[i] + high[i] - off
                w, v = (mix(x.between(p, a, a + match - width + 1) ^ np.uint64(off)).view(np.int64) for x, p in zip(hashers, prefixes, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(c[i]), pa.array(n[i]), pa.array(np.full(len(i), off, np.int32)), pa.array(w), pa.array(v)], names=["h", "c", "n", "off", "w", "v"])

    cols = ["h", "c", "n", "pos", "start", "piece"] + ["offs"] * near
    return snippets.select(cols).mapInArrow(keys, "h long, c long, n long, off int, w long, v long")


def _twice(keys: DataFrame) -> DataFrame:
    """Per context the offsets whose key occurs at least twice."""
    again = materialize(keys.groupBy("w", "v").agg(F.sum("n").alias("n")).where("n > 1").select("w", "v"), "twice")
    release(keys.sparkSession)
    return keys.drop("n").join(small_side(again), ["w", "v"], "left_semi").groupBy("h", "c").agg(F.collect_list("off").alias("offs"))


def _by_window(snippets: DataFrame, match: int) -> DataFrame:
    """The same for anchors with more contexts than an index holds, exact too, counted
    by Spark: first by what RANGE windows in a row have in common, then each window of
    the ranges that repeat."""
    some = materialize(_twice(_window_keys(snippets, match, RANGE)), "ranges")
    release(snippets.sparkSession)
    fine = _twice(_window_keys(snippets.join(some, ["h", "c"]), match, 1))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_spans(np.sort(-np.array(x, np.int64)), match) for x in batch.column(2).to_pylist()]
            yield _marks(batch.column(0).to_numpy(), batch.column(1).to_numpy(), out)

    return fine.mapInArrow(spans, MARKS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its runs in order, overlapping and touching ones made one."""
    for batch in batches:
        some = batch.column(1)
        each, flat = some.value_lengths().to_numpy(zero_copy_only=False), some.flatten()
        a, b = (flat.field(f).to_numpy().astype(np.int64) for f in ("a", "b"))
        row = np.repeat(np.arange(len(batch)), each)
        order = np.lexsort((a, row))
        a, b, far = a[order], b[order], row << 32  # rows lie apart
        reach = np.maximum.accumulate(b + far)
        new = np.append(True, (a + far)[1:] > reach[:-1]) if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(a)) - 1 if len(a) else first
        runs = pa.StructArray.from_arrays([pa.array(a[first].astype(np.int32)), pa.array((reach[last] - far[last]).astype(np.int32))], names=["a", "b"])
        offsets = np.searchsorted(row[first], np.arange(len(batch) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), runs)], names=["_rid", "runs"])


def repeated_runs(texts: DataFrame, match: int = MATCH, k: int = K, many: int = MANY) -> DataFrame:
    """``_rid, runs``: per row of ``_rid, _text`` with any, its repeated byte runs."""
    found = materialize(find_anchors(texts, match, k), "anchors")
    # where a gram first occurs names the part of a text that it is indexed with
    part = F.xxhash64("f._rid", F.floor(F.col("f.pos") / PART)).alias("part")
    grams = found.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("_rid", "pos")).alias("f")).where("n > 1")
    grams = materialize(grams.select("h", part), "grams")
    release(texts.sparkSession)  # here and below: each step's shuffle files go before the next
    again = materialize(found.join(small_side(grams, 1 << 20), "h"), "again")
    discard(found, grams, collect=True)
    first = F.min(F.struct("_rid", "pos")).alias("f")
    contexts = again.groupBy("h", "c").agg(F.count("*").alias("n"), first, F.first("part").alias("part"))
    contexts = materialize(contexts.select("h", "c", "n", "part", "f._rid", "f.pos"), "contexts")
    release(texts.sparkSession)
    hot = materialize(contexts.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > many).select("h", F.lit(True).alias("hot")), "hot")
    asked = contexts.join(small_side(hot), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    snippets = _snippets(texts, asked, match, k)
    discard(contexts, collect=True)
    marks = _by_index(snippets.where("not hot"), match, k)
    if hot._row_bytes:
        one = [F.get(f, 0).alias(f) for f in ("h", "c", "n", "pos")]
        marks = marks.unionByName(_by_window(snippets.where("hot").select(*one, "start", "piece"), match))
    marks = materialize(marks, "marks")
    discard(snippets, collect=True)
    placed = again.select("h", "c", "_rid", "pos").join(small_side(marks), ["h", "c"]).select("_rid", F.struct((F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("b")).alias("b")).alias("s"))
    return placed.groupBy("_rid").agg(F.collect_list("s").alias("some")).mapInArrow(_joined, f"_rid long, runs {SPAN_TYPE}")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, k: int = K, many: int = MANY) -> DataFrame:
    """One row per input row: ``_rid, <id_col>, n_bytes, spans, kept``.

    ``spans`` are the maximal runs ``a <= byte < b`` of the UTF-8 text that are
    covered by ``match`` bytes which also start at another place, in this or another
    row; ``kept`` are the other bytes. Null is empty; texts shorter than ``match``
    bytes have no spans, an empty table gives no rows. Of equal texts and of repeated
    rows all are covered. Texts are read whole, however long, up to 2 GB. Other columns
    are ignored whatever their names.
    """
    base = row_id(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    runs = materialize(repeated_runs(base.select("_rid", "_text"), match, k, many), "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids, texts, lists = batch.columns
            raw, out, kept = [_raw(t) for t in texts.to_pylist()], [], []
            for r, x in zip(raw, lists.to_pylist(), strict=True):
                mine = [(s["a"], min(s["b"], len(r))) for s in x or ()]
                edges = [0, *(e for s in mine for e in s), len(r)]
                out.append([{"a": a, "b": b} for a, b in mine])
                kept.append(b"".join(r[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([rids, ids, pa.array([len(r) for r in raw], pa.int64()), pa.array(out, SPANS), pa.array(kept, pa.binary())], names=["_rid", "_id", "n_bytes", "spans", "kept"])

    kind = base.schema["_id"].dataType.simpleString()
    ready = base.join(small_side(runs), "_rid", "left").select("_id", "_rid", "_text", "runs")
    return ready.mapInArrow(cut, f"_rid long, _id {kind}, n_bytes long, spans {SPAN_TYPE}, kept binary").withColumnRenamed("_id", id_col)

"""Byte-level BPE: ranked merges folded over distinct words by higher-order functions.

Texts are split by the tokenizer's pattern into words. Per block of text (some tens
of MB in reading order) the distinct words are noted; over all blocks each distinct
word is encoded once, by a fold in DataFrame functions against a literal rank map;
each block then gets the words that it holds, in a file of its own in the shared
folder, and its texts are rewritten word by word. Texts never move between tasks.

Bytes are held as Latin-1 characters, one per byte, in all columns here.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremap.llm.common import free_name, release, shared_dir

#: Buckets of the literal pair map, so that a look-up compares a few keys.
BUCKETS = 1 << 15
#: Code points of text after which a task begins its next block.
BLOCK_CHARS = 32 << 20
#: Words of more bytes than this are merged with a heap, in time n log n; the fold
#: takes time n * n, which is less for the short words that nearly all are.
LONG_WORD = 200
#: Partitions whose common words are encoded together. It bounds the list of blocks
#: that a word is wanted in, however often it occurs.
SPAN = 1024
#: Bits of a rank. What is larger than any rank stands for none, and EDGE is the piece
#: before the first and behind the last one of a word.
BITS = 20
NO_RANK, EDGE = 1 << BITS, (1 << BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file (base64 piece, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def latin(piece: bytes) -> str:
    return piece.decode("latin-1")


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def pair_key(left, right):
    """A number for two ranks, below 0 to differ from any rank."""
    return -1 - (left * (1 << BITS) + right)


def pair_bucket(left, right):
    return (left * 8191 + right) % BUCKETS


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal: rank of every byte; of every two bytes the rank together and that of
    the first, packed; and buckets of the pairs of pieces (by rank) that make a piece
    together. A bucket begins with NO_RANK and goes on with pair, rank, pair, rank ...,
    ranks shifted by BITS."""
    if max(ranks.values()) >= EDGE:
        raise ValueError(f"ranks must be below {EDGE}")
    pairs: list[list[int]] = [[NO_RANK << BITS] for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                pairs[pair_bucket(a, b)] += [pair_key(a, b), rank << BITS]
    one = [ranks[bytes([i])] for i in range(256)]
    two = [(ranks.get(bytes([i, j]), NO_RANK) << BITS) + ranks[bytes([i])] for i in range(256) for j in range(256)]
    return F.struct(_literal(one, "array<bigint>").alias("one"), _literal(two, "array<bigint>").alias("two"), _literal(pairs, "array<array<bigint>>").alias("pairs"))


def packed(table: Column, left: Column, right: Column) -> Column:
    """The rank of what two pieces make together, NO_RANK if that is no piece, shifted,
    and the first piece's own: the rank follows the pair in its bucket; for a pair that
    is not there the first entry is taken."""
    bucket = F.get(table["pairs"], pair_bucket(left, right).cast("int"))
    return F.get(bucket, F.array_position(bucket, pair_key(left, right)).cast("int")) + left


def merged(word: Column, table: Column) -> Column:
    """The ranks of the pieces of a word (Latin-1, one character per byte): the pair of
    lowest rank, leftmost first, is joined until no pair has a rank.

    The fold is over one array of a number per piece, between two EDGEs: in the high
    bits the rank that it makes with the next piece, in the low bits its own. Its
    least number is the pair to join, and pairs of equal rank are equal numbers.
    """
    none = F.lit(NO_RANK << BITS)
    edge, rest = F.array(none + EDGE), F.lit(2 * LONG_WORD)  # more than there can be

    def begin(b: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda i: F.get(table["two"], F.get(b, i - 1) * 256 + F.get(b, i)))
        inner = F.when(F.size(b) < 2, F.array().cast("array<bigint>")).otherwise(inner)
        return F.concat(edge, inner, F.array(none + F.get(table["one"], F.element_at(b, -1))), edge)

    def join(x: Column) -> Column:
        piece = lambda i: F.get(x, i).bitwiseAND(F.lit(EDGE))

        def at(i: Column, least: Column) -> Column:  # numbers i-1 and i (from 0) become one
            around = _let(F.shiftright(least, BITS), lambda new: F.array(packed(table, piece(i - 2), new), packed(table, new, piece(i + 1))))
            return F.concat(F.slice(x, F.lit(1), i - 2), around, F.slice(x, i + 2, rest))

        return _let(F.array_min(x), lambda least: F.when(least < none, _let(F.array_position(x, least).cast("int"), lambda i: at(i, least))).otherwise(x))

    steps = F.when(F.length(word) > 1, F.sequence(F.lit(2), F.length(word))).otherwise(F.array().cast("array<int>"))
    bytes_of = F.transform(F.split(word, ""), lambda c: F.ascii(c))
    done = F.aggregate(steps, _let(bytes_of, begin), lambda x, _: join(x))
    return _let(done, lambda x: F.transform(F.slice(x, F.lit(2), F.size(x) - 2), lambda v: v.bitwiseAND(F.lit(EDGE)).cast("int")))


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n steps."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[piece[i] + piece[i + 1]], i, 2) for i in range(n - 1) if piece[i] + piece[i + 1] in ranks]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, size = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or len(piece[i]) + len(piece[j]) != size:
            continue
        piece[i] += piece[j]
        alive[j] = False
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        for a, b in ((prev[i], i), (i, nxt[i])):
            if a >= 0 and b < n and (both := piece[a] + piece[b]) in ranks:
                heapq.heappush(heap, (ranks[both], a, len(both)))
    return [ranks[piece[i]] for i in range(n) if alive[i]]


_WHITE = re.compile(r"\s\s+")
# Fixed value: splitting patterns that begin a word at every single space between two
# characters which are no white space.
SPACED = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}


def spaced(text: str) -> tuple[str, list[str]]:
    """``text`` cut before each single space that stands between two characters
    which are no white space: the first part, and the others without that space.

    The patterns of SPACED (an optional space before letters, digits or other signs;
    runs of white space apart) always begin a word there, so parts can be split into
    words one by one, and each distinct part only once.
    """
    first, *rest = text.split(" ")
    if text and not text[0].isspace() and not text[-1].isspace() and not any(" " in run for run in _WHITE.findall(text)):
        return first, rest
    out = [first]
    for p in rest:
        if p and out[-1] and not p[0].isspace() and not out[-1][-1].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    return out[0], out[1:]


def _whole(text: str) -> tuple[str, list[str]]:
    """For any other pattern: the text is one part."""
    return text, []


class _Made(dict):
    """A dict that makes what it lacks."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        got = self[key] = self.make(key)
        return got


def words_of(parts: set[str], find) -> set[str]:
    """The words of ``spaced`` parts, each with its space: parts of plain letters are one;
    others are searched behind each other, as they split like each alone."""
    some = [x for x in parts if not (x.isascii() and x.isalpha())]
    out = {" " + x for x in parts.difference(some)}
    for k in range(0, len(some), 1 << 14):
        out.update(find(" " + " ".join(some[k : k + (1 << 14)])))
    return out


def part_ids(part: str, ids: dict[str, bytes], find) -> bytes:
    """The ids of a ``spaced`` part with its space, by those of words: one that is a known
    word is that word alone."""
    whole = ids.get(" " + part)
    return b"".join(map(ids.__getitem__, find(" " + part))) if whole is None else whole


#: Bits of a block's number that count the blocks of a partition.
PARTITION_SHIFT = 24


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[int]]]:
    """Each batch, its texts (null is empty) and the block of each: blocks follow
    from the partition and the code points read before, so every pass agrees."""
    base, read = TaskContext.get().partitionId() << PARTITION_SHIFT, 0
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        blocks = []
        for t in texts:
            blocks.append(base + read // BLOCK_CHARS)
            read += len(t)
        yield batch, texts, blocks


class Tokenizer:
    """Encode and decode frames by the ranks of a file and a splitting pattern, any that
    the ``regex`` library reads; texts are cut at spaces first for those of SPACED."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern, self.parts = read_ranks(path), pattern, spaced if pattern in SPACED else _whole
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"no rank for the bytes {missing}")

    def _words(self, rows: DataFrame) -> DataFrame:
        """``block, word``: the distinct words of each block that take merges, but for
        long ones."""
        pattern, ranks, parts_of = self.pattern, self.ranks, self.parts

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = regex.compile(pattern).findall

            def give(at: int, seen: set[str]) -> Iterator[pa.RecordBatch]:
                raw = (x.encode("utf-8", "replace") for x in seen)
                some = [latin(w) for w in raw if len(w) <= LONG_WORD and w not in ranks]
                for k in range(0, len(some), 1 << 16):
                    part = some[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([at] * len(part), pa.int64()), pa.array(part, pa.string())], names=["block", "word"])

            def found(firsts: set[str], parts: set[str]) -> set[str]:
                out = words_of(parts, find)
                for x in firsts:
                    out.update(find(x))
                return out

            now, firsts, parts = None, set(), set()
            for _, texts, blocks in _texts(batches):
                for t, at in zip(texts, blocks, strict=True):
                    if at != now:
                        yield from give(now, found(firsts, parts))
                        now, firsts, parts = at, set(), set()
                    first, rest = parts_of(t)
                    firsts.add(first)
                    parts.update(rest)
            yield from give(now, found(firsts, parts))

        return rows.mapInArrow(words, "block long, word string")

    def encode_words(self, words: DataFrame) -> DataFrame:
        """``word string`` (Latin-1, LONG_WORD bytes at most, not a piece as a whole)
        with ``ids array<int>``."""
        # bound once, so that the plan holds and prints the literal a single time
        return words.withColumn("ids", _let(rank_map(self.ranks), lambda table: merged(F.col("word"), table)))

    def encode(self, rows: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
        """The key columns and ``ids array<int>`` (``_ids`` if a key has that name) of
        every row; null and empty texts have no ids, an empty table gives no rows,
        equal rows get equal ids. Special tokens are ordinary text. Texts are read
        whole, however long; words of more than LONG_WORD bytes are merged where they
        occur, as is any word that the blocks of an earlier pass did not hold, so
        that results do not depend on how Spark splits the files."""
        keys = rows.select(*key_cols)
        made_col, text = free_name(keys, "ids"), free_name(keys, "_text")
        slim = rows.select(*key_cols, F.col(text_col).alias(text))
        folder = f"{shared_dir(rows.sparkSession)}/words"
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        span = F.shiftright("block", PARTITION_SHIFT + SPAN.bit_length() - 1)
        held = self._words(slim.select(text)).groupBy("word", span.alias("span")).agg(F.collect_list("block").alias("blocks"))
        coded = self.encode_words(held).select(F.explode("blocks").alias("block"), "word", "ids")
        release(rows.sparkSession)  # what earlier steps left in the driver, the rank map comes on top of it
        coded.repartition(parts, "block").write.partitionBy("block").parquet(folder)
        release(rows.sparkSession)
        pattern, ranks, parts_of = self.pattern, self.ranks, self.parts

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, now = regex.compile(pattern).findall, None
            fs, base = pafs.FileSystem.from_uri(folder)

            def known(block: int) -> dict[str, bytes]:
                out = {}
                for info in fs.get_file_info(pafs.FileSelector(f"{base}/block={block}", allow_not_found=True)):
                    if info.path.endswith(".parquet"):
                        with fs.open_input_file(info.path) as f:
                            for part in pq.ParquetFile(f).iter_batches(1 << 16, columns=["word", "ids"]):
                                lists = part.column(1)
                                flat = np.asarray(lists.flatten(), np.int32).tobytes()
                                ends = (np.cumsum(lists.value_lengths()) * 4).tolist()
                                out.update((w.encode("latin-1").decode(), flat[a:b]) for w, a, b in zip(part.column(0).to_pylist(), [0, *ends[:-1]], ends, strict=True))
                return out

            def alone(word: str) -> bytes:
                return np.array(merge_by_heap(word.encode("utf-8", "replace"), ranks), np.int32).tobytes()

            ids = _Made(alone)

            seen = _Made(lambda x: part_ids(x, ids, find))

            for batch, texts, blocks in _texts(batches):
                at = 0
                while at < len(texts):  # results of about a million code points at a time
                    cut, size, first = [], 0, at
                    if blocks[at] != now:
                        now = blocks[at]
                        seen.clear()
                        ids.clear()
                        ids.update(known(now))
                    while at < len(texts) and blocks[at] == now and size < 1 << 20:
                        cut.append(parts_of(texts[at]))
                        size += len(texts[at])
                        at += 1
                    out = [b"".join(map(ids.__getitem__, find(x))) + b"".join(map(seen.__getitem__, rest)) for x, rest in cut]
                    some = batch.slice(first, at - first)
                    offsets = np.cumsum([0, *(len(x) // 4 for x in out)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), np.int32)))
                    yield pa.RecordBatch.from_arrays([*some.columns[:-1], lists], names=[*some.schema.names[:-1], made_col])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
        return slim.mapInArrow(rewrite, f"{fields}, {made_col} array<int>")

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids: their pieces, concatenated."""
        pieces = [""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            pieces[rank] = latin(piece)
        table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""), "ISO-8859-1")


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")

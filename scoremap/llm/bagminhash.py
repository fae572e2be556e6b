"""Near-duplicates by BagMinHash signatures of word-shingle multisets.

A shingle of weight w is a Poisson process on [0, w). It is the union of processes
on [0, 1), [1, 2), [2, 4), [4, 8) ..., each with points in ascending order; a point
carries a place in the signature and, in the last interval, a mark that says whether
it lies below w. Each signature component keeps its earliest point, so two bags
agree in a component with probability equal to their weighted Jaccard similarity. A
shingle is given up as soon as its next point is later than all components.

Bands of components make candidates, and every link is verified on the multisets. A
bucket first compares all members with one of them, and then, in a few more rounds,
those outside the component of another one with that. Rows that this leaves in different
components, and that their distance to that member does not keep apart (weighted
Jaccard distance is a metric), meet again by their rarest shingles: bags of similarity
t share one of the first n - ceil(t n) + 1 shingles of the larger and of the first
n - ceil(2 t n / (1 + t)) + 1 of the smaller, in any fixed order. So many short texts
around one common passage do not all meet each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremap.llm.common import discard, materialize, release, row_id, small_side, without_rows
from scoremap.llm.components import contracted, joined, merged, order_of
from scoremap.llm.shingles import Hasher, bags, mix, overlap

BANDS, ROWS = 24, 4
THRESHOLD = 0.8
#: Code points that a task hashes at once.
BLOCK = 1 << 20
#: Rounds of comparing buckets with another member before the exact rest.
TURNS = 3
#: Members of a star that one group compares with its centre.
GROUP = 512


def _unit(h: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 random bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(found: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """A row of ``size`` point identities per bag; empty bags have zeros."""
    n = len(found)
    feature = np.concatenate([f for f, _ in found]) if n else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in found]).astype(np.int64) if n else np.zeros(0, np.int64)
    bag = np.repeat(np.arange(n), [len(f) for f, _ in found])
    seeds, low, width, tops, owners = [], [], [], [], []
    j, at, wide = 0, 0, 1
    while True:  # the intervals [0, 1), [1, 2), [2, 4), ... that reach below the weight
        pick = np.flatnonzero(weight > at)
        if not len(pick):
            break
        with np.errstate(over="ignore"):
            seeds.append(mix(feature[pick] + np.uint64(j) * np.uint64(0xA24BAED4963EE407)))
        low.append(np.full(len(pick), at))
        width.append(np.full(len(pick), wide))
        tops.append(weight[pick])
        owners.append(bag[pick])
        j, at, wide = j + 1, at + wide, at + wide
    first, ids = np.full(n * size, np.inf), np.zeros(n * size, np.uint64)
    if not seeds:
        return ids.reshape(n, size)
    seed, low, width, top, own = (np.concatenate(x) for x in (seeds, low, width, tops, owners))
    x, step = np.zeros(len(seed)), 0
    latest = np.full(n, np.inf)
    while len(seed):
        step += 1
        with np.errstate(over="ignore"):
            point = mix(seed + np.uint64(step) * np.uint64(0x9FB21C651E98DF25))
            mark = mix(point ^ np.uint64(0x5851F42D4C957F2D))
        x = x - np.log(_unit(point)) / width
        place = own * size + (mark % np.uint64(size)).astype(np.int64)
        ok = x < first[place]
        partial = low + width > top
        if partial.any():
            ok &= ~partial | (low + np.floor((1 - _unit(mix(mark))) * width) < top)
        p, v = place[ok], x[ok]
        np.minimum.at(first, p, v)
        won = v == first[p]
        ids[p[won]] = point[ok][won]
        touched = np.unique(own[ok])
        latest[touched] = first.reshape(n, size)[touched].max(axis=1)
        go = x < latest[own]
        seed, low, width, top, own, x = seed[go], low[go], width[go], top[go], own[go], x[go]
    return ids.reshape(n, size)


def band_keys(ids: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per bag and band."""
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(ids), 1))
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[:, k::rows][:, :bands])
    return out.view(np.int64)


def _blocks(texts: list) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < BLOCK or end == at):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def sketch(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """``_rid, n, bag, keys`` of ``_rid, _text``: number of shingles, a digest of the
    multiset and the band keys (none for an empty bag)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            rid, text = batch.column(0), batch.column(1).to_pylist()
            for a, b in _blocks(text):
                found = bags(text[a:b], hasher)
                keys = band_keys(signatures(found, bands * rows), bands, rows)
                lists = [k.tolist() if len(f) else [] for k, (f, _) in zip(keys, found, strict=True)]
                digests = [hashlib.blake2b(f.tobytes() + w.tobytes(), digest_size=16).digest() for f, w in found]
                yield pa.RecordBatch.from_arrays(
                    [rid.slice(a, b - a), pa.array([int(w.sum()) for _, w in found], pa.int64()), pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["_rid", "n", "bag", "keys"]
                )

    return texts.mapInArrow(make, "_rid long, n long, bag binary, keys array<long>")


def verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, j``: the weighted Jaccard similarity of each pair of rows. ``pairs``
    is a materialised ``a long, b long``. The members of a star are dealt to groups of
    about GROUP, each with its own copy of the centre's text."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, centre, mine = Hasher(), None, None
        for batch in batches:
            a, _, _, b, text = (c.to_pylist() for c in batch.columns)
            out = []
            for s, e in _blocks(text):
                for k, bag in zip(range(s, e), bags(text[s:e], hasher), strict=True):
                    if b[k] is None:
                        centre, mine = a[k], bag
                    else:
                        assert centre == a[k]
                        out.append((a[k], b[k], overlap(mine, bag)))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "j"])

    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("groups"))
    dealt = materialize(pairs.join(stars, "a").select("a", F.pmod(F.xxhash64("b"), "groups").alias("g"), "b"), "dealt")
    centres = materialize(dealt.select("a", "g").distinct(), "centres")
    cols = ["a", "g", "side", "b", "_text"]
    members = texts.join(_renamed(dealt, "b"), "_rid").select("a", "g", F.lit(1).alias("side"), F.col("_rid").alias("b"), "_text")
    middle = texts.join(_renamed(centres, "a"), "_rid").select(F.col("_rid").alias("a"), "g", F.lit(0).alias("side"), F.lit(None).cast("long").alias("b"), "_text")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = members.select(cols).unionByName(middle.select(cols)).repartition(parts, "a", "g").sortWithinPartitions("a", "g", "side")
    return ready.mapInArrow(compare, "a long, b long, j double")


def _renamed(df: DataFrame, col: str) -> DataFrame:
    """A materialised frame keyed by ``_rid``, broadcast if small."""
    return small_side(df).withColumnRenamed(col, "_rid")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``_rid, <id_col>, class_id, class_size, kept``.

    Rows are linked when the multisets of their 5-word shingles have a weighted
    Jaccard similarity of at least ``threshold``; a class is what links connect, its
    id the smallest id in it (null ids last), and one row of that id is kept, also of
    repeated rows. Texts without words, null ones included, are one class; an empty
    table gives no rows. Texts are read whole, however long. Other columns are ignored
    whatever their names.
    """
    base = row_id(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    texts = base.select("_rid", "_text")
    made = materialize(sketch(texts, bands, rows), "sketches")
    # rows with the same multiset stand together from here on
    copies = materialize(made.groupBy("bag").agg(F.min("_rid").alias("rep")), "copies")
    reps = made.join(small_side(copies).select(F.col("rep").alias("_rid")), "_rid", "left_semi")
    members = reps.select("_rid", "n", F.explode("keys").alias("key"))
    first = F.min(F.struct(order_of("_rid").alias("o"), "n")).alias("r")
    centres = materialize(members.groupBy("key").agg(first, F.count("*").alias("k")).where("k > 1").select("key", F.col("r.o.v").alias("centre"), F.col("r.n").alias("cn")), "centres")
    # both sides are plain reads, so that Spark can split the members of a large bucket
    buckets = materialize(members.join(small_side(centres), "key"), "buckets")
    discard(centres, collect=True)  # here and below: each step's files go before the next
    ratio = lambda x, y: F.least(x, y) / F.greatest(x, y)
    star = buckets.where(F.col("_rid") != F.col("centre")).select(F.col("centre").alias("a"), F.col("_rid").alias("b"), ratio(F.col("cn"), F.col("n")).alias("bound")).distinct()
    stars = materialize(star.where(F.col("bound") >= threshold).select("a", "b"), "star")
    release(docs.sparkSession)
    checked = materialize(verify(texts, stars), "checked")
    discard(stars, collect=True)
    linked = lambda pairs: pairs.where(F.col("j") >= threshold).select("a", "b")
    labels = joined(linked(checked))
    for turn in range(TURNS):
        pairs = _outside(buckets, checked, labels, threshold, ratio, turn)
        if not pairs._row_bytes:
            break
        got = materialize(verify(texts, pairs), "got")
        # only what links different components goes on
        labels = _extended(labels, linked(got))
        before, checked = checked, materialize(checked.unionByName(got), "checked")
        discard(pairs, before, got, collect=True)
    rest = _rest(texts, buckets, checked, labels, threshold, ratio)
    discard(buckets, checked, collect=True)
    if rest._row_bytes:
        more = materialize(verify(texts, rest), "more")
        labels = _extended(labels, linked(more))
        discard(more)
    discard(rest, collect=True)
    of_rep = copies.join(labels, F.col("rep") == F.col("v"), "left").select("bag", F.coalesce("c", "rep").alias("c"))
    of_row = made.select("_rid", "bag").join(of_rep, "bag").select("_rid", "c")
    every = materialize(of_row.join(base.select("_rid", "_id"), "_rid"), "classes")
    discard(made, copies, labels, collect=True)
    first = F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_rid").alias("rid")))
    groups = every.groupBy("c").agg(F.count("*").alias("class_size"), first.alias("f"))
    return every.join(groups, "c").select("_rid", F.col("_id").alias(id_col), F.col("f.id").alias("class_id"), "class_size", (F.col("f.rid") == F.col("_rid")).alias("kept"))


def _extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links."""
    new = materialize(contracted(links, labels), "new")
    return merged(labels, joined(new)) if new._row_bytes else labels


def _outside(buckets: DataFrame, checked: DataFrame, labels: DataFrame, threshold: float, ratio, turn: int) -> DataFrame:
    """The pairs of a bucket's pseudo-random member with those of other components."""
    placed = buckets.select("key", "_rid", "n").join(labels.select(F.col("v").alias("_rid"), "c"), "_rid", "left").withColumn("c", F.coalesce("c", "_rid"))
    centres = placed.groupBy("key").agg(F.min(F.struct(F.xxhash64("_rid", F.lit(turn)).alias("h"), "_rid", "n", "c")).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key", "m")
    met = placed.join(centres, "key").where((F.col("c") != F.col("m.c")) & (ratio(F.col("n"), F.col("m.n")) >= threshold))
    pairs = met.select(F.col("m._rid").alias("a"), F.col("_rid").alias("b")).distinct()
    seen = checked.select("a", "b").unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return materialize(pairs.join(seen, ["a", "b"], "left_anti"), "outside")


def _rest(texts: DataFrame, buckets: DataFrame, checked: DataFrame, labels: DataFrame, threshold: float, ratio) -> DataFrame:
    """The pairs in different components that may be linked."""
    far = 1 - threshold + 1e-9
    label = lambda name, out: labels.select(F.col("v").alias(name), F.col("c").alias(out))
    known = checked.select(F.col("a").alias("centre"), F.col("b").alias("_rid"), (1 - F.col("j")).alias("d")).distinct()
    centre = F.col("_rid") == F.col("centre")
    # lo and hi enclose the distance to the centre
    placed = (
        buckets.join(known, ["centre", "_rid"], "left")
        .join(label("_rid", "c"), "_rid", "left")
        .join(label("centre", "cc"), "centre", "left")
        .select(
            "key", "_rid", "centre", F.coalesce("c", "_rid").alias("c"), F.coalesce("cc", "centre").alias("cc"),
            F.when(centre, F.lit(0.0)).otherwise(F.coalesce("d", 1 - ratio(F.col("cn"), F.col("n")))).alias("lo"),
            F.when(centre, F.lit(0.0)).otherwise(F.coalesce("d", F.lit(1.0))).alias("hi"),
        )
    )
    placed = materialize(placed, "placed")
    release(texts.sparkSession)
    # strays near enough to another stray or to a row of the centre's own component
    strays = placed.where("c <> cc").groupBy("key").agg(F.min("lo").alias("least"), F.count("*").alias("strays"))
    left = placed.join(strays, "key").where((F.col("_rid") != F.col("centre")) & ((F.col("c") != F.col("cc")) | (F.col("hi") >= F.col("least") - far)))
    groups = left.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    alone = materialize(left.join(groups, "key", "left_semi").select("_rid", "c").distinct(), "left")
    discard(placed, collect=True)
    tokens = materialize(texts.join(small_side(alone), "_rid").select("_rid", "c", "_text").mapInArrow(_tokens, "_rid long, c long, n int, token long"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    rarest = tokens.join(often, "token").groupBy("_rid", "c", "n").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("t"))
    n, slack = F.col("n"), 1e-9
    probe = n - F.ceil(n * threshold - slack).cast("int") + 1
    index = n - F.ceil(n * (2 * threshold / (1 + threshold)) - slack).cast("int") + 1
    own = F.transform(F.slice("t", F.lit(1), probe), lambda s: s["token"])
    rarest = materialize(rarest.select("_rid", "c", "n", index.alias("index"), own.alias("t")), "rarest")
    discard(alone, tokens, collect=True)
    # with the shingles before it, so that a pair meets at the first that it shares only
    first = rarest.select("_rid", "c", "n", "index", "t", F.posexplode("t").alias("pos", "token"))
    first = first.select("_rid", "c", "n", "pos", (F.col("pos") < F.col("index")).alias("indexed"), "token", F.slice("t", F.lit(1), F.col("pos")).alias("before"))
    x, y = first.where("indexed").alias("x"), first.alias("y")
    size = lambda side: F.struct(f"{side}.n", f"{side}._rid")
    # the first shingle that two bags share leaves room for the overlap they need
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    enough = room >= (F.col("x.n") + F.col("y.n")) * (threshold / (1 + threshold)) - slack
    new = ~F.arrays_overlap("x.before", "y.before")
    met = x.join(y, F.col("x.token") == F.col("y.token")).where((F.col("x.c") != F.col("y.c")) & (size("x") < size("y")) & (F.col("x.n") >= F.col("y.n") * (threshold - slack)) & enough & new)
    pairs = met.select(F.least("x._rid", "y._rid").alias("a"), F.greatest("x._rid", "y._rid").alias("b")).distinct()
    seen = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialize(pairs.join(seen, ["a", "b"], "left_anti"), "rest")
    discard(rarest, collect=True)
    return rest


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shingle of a text; repeats of a shingle are told apart by number."""
    hasher = Hasher()
    for batch in batches:
        rid, c, text = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        for a, b in _blocks(text):
            found = bags(text[a:b], hasher)
            size = np.array([int(w.sum()) for _, w in found], np.int64)
            feature = np.repeat(np.concatenate([f for f, _ in found]), np.concatenate([w for _, w in found]))
            weight = np.concatenate([w for _, w in found])
            nth = np.arange(len(feature)) - np.repeat(np.cumsum(weight) - weight, weight)
            with np.errstate(over="ignore"):
                token = mix(feature + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(rid[a:b], size)), pa.array(np.repeat(c[a:b], size)), pa.array(np.repeat(size, size).astype(np.int32)), pa.array(token)], names=["_rid", "c", "n", "token"]
            )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, one of each class, with all their columns, whatever
    these are called. Null and empty texts are one class; no rows give no rows."""
    dropped = materialize(near_dedup(docs, id_col, text_col).where(~F.col("kept")).select("_rid"), "dropped")
    return without_rows(docs, dropped)

"""Merkle manifest of a dataset: a leaf per row, a tree per source, a tree of sources.

Where a leaf stands follows from bitmaps. Every source has a compressed bitmap of its
ids: blocks of ``BLOCK`` ids that hold their non-empty 64-bit words only, merged by
Spark's ``bit_or`` from what tasks find. A directory of popcounts, per word in its block
and per block in its source, turns them into rank queries: ids below a row's word plus
set bits below its own, so no source is ever sorted. From coordinates on, nodes are keyed:
``WIDTH`` slots of neighbouring nodes are one array, that loses six levels at once, and so
on up to the root; paths go down the same way, and only digests and short paths move.

All of it are DataFrame functions; the driver holds a number of rounds and the root.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremap.llm.common import materialize, row_id, small_side
from scoremap.operators.prefix import running_counts

#: Children of a node, and levels that one array of slots loses at once.
FAN, LEVELS = 3, 6
WIDTH = FAN**LEVELS
#: A block of a bitmap holds 2 to this power ids, a word of it 2 to the sixth.
BLOCK_BITS = 15
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l:string,r:string>>"


def framed(col: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = col.cast("string")
    return F.when(col.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*cols: Column) -> Column:
    """SHA-256 of the concatenated fields, in lower-case hex."""
    return F.sha2(F.concat(*[framed(c) for c in cols]), 256)


def directory(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``<group>, word, bits, base, more``: the non-empty words of each group's bitmap
    of the long column ``key``, with how many of the group's rows lie below the word
    and, for keys of several rows, how many more than one."""
    keys = rows.groupBy(group, key).agg(F.count("*").alias("n"))
    place = F.col(key).bitwiseAND(63).cast("int")
    more = F.collect_list(F.when(F.col("n") > 1, F.struct(F.col("place"), (F.col("n") - 1).alias("extra"))))
    bit = F.expr("shiftleft(1L, place)")
    words = keys.withColumns({"place": place, "word": F.shiftright(key, 6)}).groupBy(group, "word").agg(F.bit_or(bit).alias("bits"), F.sum("n").alias("n"), more.alias("more"))
    entry = F.struct("word", "bits", "n", "more")
    blocks = words.groupBy(group, F.shiftright("word", BLOCK_BITS - 6).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("words"), F.sum("n").alias("n"))
    blocks = materialize(blocks, "bitmaps")
    before = running_counts(blocks.select(group, "block", "n"), group, "block", "n").select(F.col(group).alias("_bg"), F.col("block").alias("_bb"), F.col("_below").alias("_before"))
    blocks = blocks.join(before, F.col(group).eqNullSafe(F.col("_bg")) & (F.col("block") == F.col("_bb")))
    # running sum of the at most 512 words of a block
    sums = F.aggregate("words", F.array(F.lit(0).cast("long")), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w["n"])))
    placed = F.transform("words", lambda w, i: F.struct(w["word"].alias("word"), w["bits"].alias("bits"), (F.col("_before") + F.get(F.col("_sums"), i)).alias("base"), w["more"].alias("more")))
    return blocks.withColumn("_sums", sums).select(group, F.inline(placed))


def ranked(rows: DataFrame, group: str, keys: list[str], out: str = "_pos", rid: str = "_rid") -> DataFrame:
    """``rows`` with ``out``: how many rows of its group lie below a row. ``keys`` are long
    columns without nulls; a later one orders rows with equal earlier ones, and the
    last differs in all rows of a group, as ``rid`` does in all rows."""
    key = keys[0]
    words = directory(rows, group, key).select(F.col(group).alias("_wg"), *[F.col(c).alias(f"_{c}") for c in ("word", "bits", "base", "more")])
    met = rows.join(words, F.col(group).eqNullSafe(F.col("_wg")) & (F.shiftright(key, 6) == F.col("_word")))
    met = met.withColumn("_place", F.col(key).bitwiseAND(63).cast("int"))
    below = F.expr("bit_count(_bits & ~shiftleft(-1L, _place))").cast("long")
    extra = F.aggregate(F.filter("_more", lambda m: m["place"] < F.col("_place")), F.lit(0).cast("long"), lambda n, m: n + m["extra"])
    met = met.withColumns({out: F.col("_base") + below + extra, "_tied": F.exists("_more", lambda m: m["place"] == F.col("_place"))})
    met = materialize(met.drop("_wg", "_word", "_bits", "_base", "_more", "_place"), "ranks")
    tied = met.where("_tied")
    if len(keys) == 1 or tied.isEmpty():
        return met.drop("_tied")
    again = tied.select(F.struct(group, key).alias("_group"), *dict.fromkeys([*keys[1:], rid]))
    further = f"_{out}"
    again = materialize(ranked(again, "_group", keys[1:], further, rid).select(rid, further), "ties")
    return met.join(small_side(again), rid, "left").withColumn(out, F.col(out) + F.coalesce(further, F.lit(0))).drop("_tied", further)


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k).cast("long") for k in range(40)]), lambda p: p < n))


def _levels(nodes: Column, steps: Column) -> Column:
    """The nodes and ``steps`` levels above them."""
    up = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / FAN).cast("int")), lambda i: F.sha2(F.array_join(F.slice(xs, i * FAN + 1, F.lit(FAN)), ""), 256))
    rounds = F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda k: k <= steps)
    return F.aggregate(rounds, F.array(nodes), lambda acc, _: F.concat(acc, F.array(up(F.element_at(acc, -1)))))


def _siblings(levels: Column, slot: Column) -> Column:
    """Left and right siblings of a slot on every level of its array but the top."""
    at = lambda k: F.floor(slot / F.pow(F.lit(float(FAN)), k)).cast("int")
    run = lambda k: (F.floor(at(k) / FAN) * FAN).cast("int")
    pair = lambda xs, k: F.struct(
        F.array_join(F.slice(xs, run(k) + 1, at(k) - run(k)), "").alias("l"), F.array_join(F.slice(xs, at(k) + 2, run(k) + FAN - 1 - at(k)), "").alias("r")
    )
    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), pair)


def _rounds(nodes: DataFrame, deepest: int) -> tuple[list[DataFrame], DataFrame]:
    """Arrays of slots round by round, and the last nodes. ``nodes``: ``_s, _pos, _hash,
    _deep`` (levels to go) and ``_rest`` (a struct that stays with its slot)."""
    rounds = []
    for _ in range(max(1, -(-deepest // LEVELS))):
        chunk = F.floor(F.col("_pos") / WIDTH).alias("_pos")
        slots = nodes.groupBy("_s", chunk).agg(F.array_sort(F.collect_list(F.struct((F.col("_pos") % WIDTH).alias("slot"), "_hash", "_rest"))).alias("_slots"), F.first("_deep").alias("_deep"))
        full = slots.select("_s", "_pos", "_deep", F.transform("_slots", lambda x: x["_rest"]).alias("_rests"), _levels(F.transform("_slots", lambda x: x["_hash"]), F.col("_deep")).alias("_levels"))
        full = materialize(full, "slots")
        rounds.append(full)
        nodes = full.select("_s", "_pos", F.element_at(F.element_at("_levels", -1), 1).alias("_hash"), F.greatest(F.lit(0), F.col("_deep") - LEVELS).alias("_deep"), F.struct(F.lit(0)).alias("_rest"))
    return rounds, nodes


def _down(slots: DataFrame, above: DataFrame) -> DataFrame:
    """``_s, _pos, _path, _rest, _hash`` and what else ``above`` has per node of a round:
    its path in the array and that of the array."""
    more = [c for c in above.columns if c not in ("_s", "_pos", "_path")]
    met = slots.join(above.withColumnsRenamed({"_s": "_as", "_pos": "_apos", "_path": "_up"}), (F.col("_s") == F.col("_as")) & (F.col("_pos") == F.col("_apos")))
    path = lambda i: F.concat(_siblings(F.col("_levels"), i), F.col("_up"))
    each = F.transform("_rests", lambda rest, i: F.struct((F.col("_pos") * WIDTH + i).alias("_pos"), path(i).alias("_path"), rest.alias("_rest"), F.get(F.element_at("_levels", 1), i).alias("_hash")))
    return met.select("_s", *more, F.inline(each))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


@dataclass
class Manifest:
    """Slots of all rounds, of the sources (``rounds``) and of the tree over them
    (``top``), and the root; no rows, no root."""

    rounds: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str | None

    def paths(self) -> DataFrame:
        """Per leaf: ``_s, _pos``, the columns it was built with, ``leaf, subroot``,
        ``path`` to the root."""
        none = F.array().cast(PATH)
        above = self.top[-1].select("_s", F.lit(0).cast("long").alias("_pos"), none.alias("_path"))
        for slots in reversed(self.top):
            above = _down(slots, above).select("_s", "_pos", "_path", "_rest", "_hash")
            above = above if slots is self.top[0] else above.drop("_rest", "_hash")
        above = materialize(above.select(F.col("_rest._of").alias("_s"), F.lit(0).cast("long").alias("_pos"), "_path", F.col("_hash").alias("subroot")), "paths")
        for slots in reversed(self.rounds):
            above = _down(slots, above)
            if slots is not self.rounds[0]:
                above = materialize(above.drop("_rest", "_hash"), "paths")
        return above.select("_s", "_pos", F.col("_hash").alias("leaf"), "subroot", F.col("_path").alias("path"), "_rest.*")

    def nodes(self) -> DataFrame:
        """``source, level, pos, digest`` of every node below the subroots and of these."""
        parts = []
        for r, slots in enumerate(self.rounds):
            deep = F.posexplode(F.slice("_levels", F.lit(1 if r == 0 else 2), F.lit(LEVELS + 1))).alias("k", "row")
            each = slots.select("_s", "_pos", deep).withColumn("level", F.col("k") + (0 if r == 0 else r * LEVELS + 1))
            each = each.select("_s", "level", F.col("_pos").alias("chunk"), (F.col("level") - r * LEVELS).alias("up"), F.posexplode("row").alias("i", "digest"))
            first = F.col("chunk") * F.pow(F.lit(float(FAN)), F.lit(LEVELS) - F.col("up")).cast("long")
            parts.append(each.select(_source("_s").alias("source"), "level", (first + F.col("i")).alias("pos"), "digest"))
        return reduce(DataFrame.unionByName, parts)


def _source(col: str) -> Column:
    return F.when(F.col(col) != "", F.substring(col, 2, 2**31 - 1))


def _numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """``df`` with places in the order of ``by``: ranges of it are counted, and the
    driver sees one count a range."""
    low = 33  # bits of the number of a row in its partition
    sorted_ = materialize(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    before, starts = 0, []
    for r in sorted_.groupBy(F.shiftright("_m", low).alias("part")).count().sort("part").collect():
        starts += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    at = F.create_map(*starts)[F.shiftright("_m", low)] if starts else F.lit(0)
    return sorted_.withColumn(out, at.cast("long") + F.col("_m").bitwiseAND((1 << low) - 1)).drop("_m")


def leaves(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, **more: Column) -> DataFrame:
    """``_rid, _s, _id, _hash`` of every row, and further columns by name."""
    col = lambda c: F.col(f"`{c}`")
    source = F.coalesce(F.concat(F.lit("="), col(source_col).cast("string")), F.lit("")).alias("_s")
    return row_id(docs.select(source, col(id_col).cast("long").alias("_id"), digest(*[col(c) for c in fields]).alias("_hash"), *[c.alias(n) for n, c in more.items()]))


def manifest(rows: DataFrame) -> Manifest:
    """The trees over ``leaves``: runs of three nodes become one while there are several,
    by source in the order of ids, then over the sources by their UTF-8 bytes.

    A null source is a source, before all others; null ids come after all others of
    their source. Rows with the same id follow each other by the first 60 bits of their
    digests, then by row number, so equal rows are neighbours. Any row stands for itself,
    however often it is repeated. An empty table has no root and no paths.
    """
    tie = F.conv(F.substring("_hash", 1, 15), 16, 10).cast("long")
    group = F.concat(F.when(F.col("_id").isNull(), "n").otherwise("i"), F.col("_s"))
    carry = [c for c in rows.columns if c not in ("_s", "_hash")]
    rows = materialize(rows.withColumns({"_g": group, "_key": F.coalesce("_id", F.lit(0).cast("long")), "_tie": tie}), "leaves")
    counts = rows.groupBy("_s").agg(F.count("*").alias("_n"), F.count("_id").alias("_known")).withColumn("_deep", _depth(F.col("_n")))
    counts = materialize(counts, "counts")
    placed = ranked(rows, "_g", ["_key", "_tie", "_rid"]).join(small_side(counts).withColumnRenamed("_s", "_cs"), F.col("_s") == F.col("_cs"))
    pos = F.col("_pos") + F.when(F.col("_id").isNull(), F.col("_known")).otherwise(0)
    nodes = placed.select("_s", pos.alias("_pos"), "_hash", "_deep", F.struct(*carry).alias("_rest"))
    rounds, last = _rounds(nodes, counts.agg(F.max("_deep")).first()[0] or 0)
    subroots = materialize(_numbered(last.select("_s", "_hash"), "_s", "_pos"), "subroots")
    n = subroots.count()
    deep = subroots.sparkSession.range(1).select(_depth(F.lit(n).cast("long"))).first()[0]
    above = subroots.select(F.lit("").alias("_s"), "_pos", "_hash", F.lit(deep).alias("_deep"), F.struct(F.col("_s").alias("_of")).alias("_rest"))
    top, root = _rounds(above, deep)
    found = root.first()
    return Manifest(rounds, top, subroots.select(_source("_s").alias("source"), F.col("_hash").alias("subroot")), found and found["_hash"])


def tampered(docs_text: Column, id_col: Column) -> Column:
    """The text as the check of tampering has it: without line feeds where 2 divides the
    CRC-32 of the id; unchanged texts and null are null."""
    changed = (F.crc32(id_col.cast("string")) % 2 == 0) & F.contains(docs_text, F.lit("\n"))
    return F.when(changed, F.replace(docs_text, F.lit("\n"), F.lit("")))


def proofs(docs: DataFrame, changed: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``<id_col>, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``changed`` is the text of rows whose text was changed after the manifest was made
    (null: not changed); ``folded_root`` is what such a row gives with its old siblings.
    Nulls, ties and repeated rows as in ``manifest``; texts are read whole; other
    columns are ignored whatever their names.
    """
    bent = F.lit(None).cast("string")
    if changed is not None:
        bent = F.when(changed.isNotNull(), digest(*[changed if c == text_col else F.col(f"`{c}`") for c in fields]))
    tree = manifest(leaves(docs, id_col, source_col, fields, _bent=bent))
    back = folded(F.coalesce("_bent", "leaf"), F.col("path"))
    root = F.lit(tree.root)
    out = tree.paths().select(F.col("_id").alias(id_col), "leaf", "subroot", root.cast("string").alias("root"), siblings_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc_sql(x: str) -> str:
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({x}) + 1), lambda i: ascii(({x})[i])::BIGINT)), lambda c, b: {step}), 4294967295)"


def _framed_sql(x: str) -> str:
    return f"coalesce(octet_length(encode(({x})::VARCHAR)) || ':' || ({x})::VARCHAR, '-')"


def _tree_sql(name: str, base: str) -> str:
    """Nodes of trees over ``base`` (s, pos, h, n), and their siblings."""
    run = f"(PARTITION BY s, lvl, pos // {FAN} ORDER BY pos)"
    return f"""{name} AS (
  SELECT s, 0 AS lvl, pos, h, n FROM {base}
  UNION ALL
  SELECT s, lvl + 1, pos // {FAN}, sha256(string_agg(h, '' ORDER BY pos)), (n + {FAN - 1}) // {FAN} FROM {name} WHERE n > 1 GROUP BY s, lvl, pos // {FAN}, n),
{name}_sib AS (
  SELECT s, lvl, pos, coalesce(lag(h, 2) OVER {run}, '') || coalesce(lag(h, 1) OVER {run}, '') AS l, coalesce(lead(h, 1) OVER {run}, '') || coalesce(lead(h, 2) OVER {run}, '') AS r
  FROM {name} WHERE n > 1)"""


def proofs_sql(docs: str = "documents") -> str:
    """DuckDB SQL with the rows of ``proofs(docs, tampered(...))`` for unlike ids."""
    leaf = lambda text: "sha256(" + " || ".join(_framed_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    fold = lambda name, of, base: f"""{name} AS (
  SELECT doc, s, 0 AS lvl, pos, h, proof FROM {base}
  UNION ALL
  SELECT doc, s, lvl + 1, pos // {FAN}, sha256(l || h || r), proof || l || r FROM {name} JOIN {of}_sib USING (s, lvl, pos))"""  # noqa: E731
    return f"""WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || source, '') AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
         {leaf("text")} AS h, CASE WHEN {_crc_sql("doc_id::VARCHAR")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS bent
  FROM {docs}),
{_tree_sql("tree", "leaf")},
sub AS (SELECT s, h FROM tree WHERE n = 1),
above AS (SELECT '' AS s, row_number() OVER (ORDER BY s) - 1 AS pos, h, count(*) OVER () AS n, s AS source FROM sub),
{_tree_sql("top", "above")},
root AS (SELECT h FROM top WHERE n = 1),
start AS (SELECT pos AS doc, s, pos, coalesce(bent, h) AS h, '' AS proof FROM leaf),
{fold("low", "tree", "start")},
subfold AS (SELECT low.doc || '/' || low.s AS doc, '' AS s, above.pos, low.h, proof FROM low JOIN tree ON tree.s = low.s AND tree.lvl = low.lvl AND tree.n = 1 JOIN above ON above.source = low.s),
{fold("high", "top", "subfold")},
done AS (SELECT doc, high.h, proof FROM high JOIN top ON top.lvl = high.lvl AND top.n = 1)
SELECT leaf.doc_id, leaf.h AS leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, done.h AS folded_root, done.h = root.h AS verified
FROM leaf JOIN sub USING (s) JOIN done ON done.doc = leaf.pos || '/' || leaf.s, root"""

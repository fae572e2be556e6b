"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own content says so, each chunk gets a 64-bit
identifier, and a document becomes the ordered list of its identifiers. One
grouping by chunk text proves which identifiers stand for a single text; the
few that do not get a rank per text beside them. Two documents are equal exactly
when their lists are, so after the one pass over chunks only the short lists move.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoremap.llm.common import materialize, row_id, small_side, without_rows


def _half(i: int, low: int, high: int) -> str:
    """A class of about half of the bytes from low to high - 1, by their CRC-32."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(low, high) if zlib.crc32(b"%d/%d" % (i, b)) >> 7 & 1) + "]"


def chunk_pattern(letters: int = 10, wide: int = 8) -> str:
    """Chunks of UTF-8 bytes, written as Latin-1. One ends where each of the last
    ``letters`` bytes, or the last byte of each of the last ``wide`` letters of more
    than one byte, is in the half of all bytes that is set for its place (about one
    place in a thousand, in any script), at 64 bytes at least and 4096 at most."""
    narrow = "".join(_half(i, 0, 256) for i in range(letters))
    other = "".join(rf"[\xc2-\xf4][\x80-\xbf]{{0,2}}{_half(i, 128, 192)} ?" for i in range(wide))
    return f"(?s).{{64,4096}}?(?:{narrow}|{other})|.{{1,4096}}"


CHUNK = chunk_pattern()
#: Any run of ASCII white space but a single space.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def chunks(text: Column) -> Column:
    """The chunks of a text in order, each a string of its bytes as Latin-1."""
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column, bits: int = 64) -> Column:
    """xxHash64; fewer bits only to provoke collisions in tests."""
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per input row: ``_rid, <id_col>, keep_id, group_size, kept, text_sha256``.

    Rows are equal when their texts are after white-space normalisation; null and
    empty texts are equal. The row with the smallest id stays (null ids come last;
    of repeated rows with one id a single one stays). Empty tables give no rows,
    other columns are ignored, and texts of any length are read whole.
    """
    base = row_id(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))).withColumn("_t", normalised(F.col("_t")))
    found = F.col("_chunks")
    recipes = materialize(
        base.select("_rid", "_id", F.sha2(F.col("_t"), 256).alias("text_sha256"), chunks(F.col("_t")).alias("_chunks")).select(
            "_rid", "_id", "text_sha256", F.transform(found, lambda c: identifier(c, bits)).alias("recipe")
        ),
        "recipes",
    )
    parts = base.select(F.explode(chunks(F.col("_t"))).alias("chunk")).distinct()
    doubtful = materialize(
        parts.select(identifier(F.col("chunk"), bits).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"),
        "doubtful",
    )
    ranks = F.array().cast("array<int>")
    if doubtful.isEmpty():  # each identifier stands for one chunk text
        lists = recipes.withColumn("ranks", ranks)
    else:
        lists = recipes.join(_ranks(base, doubtful, bits), "text_sha256", "left").withColumn("ranks", F.coalesce("ranks", ranks))
    first = F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_rid").alias("rid")))
    groups = lists.groupBy("recipe", "ranks").agg(F.count("*").alias("group_size"), first.alias("f")).where("group_size > 1")
    # written first, so that Spark can split the rows of a large group in the join
    groups = materialize(groups.select("recipe", "ranks", "group_size", F.col("f.id").alias("keep_id"), F.col("f.rid").alias("keep_rid")), "groups")
    alone = F.col("group_size").isNull()
    return lists.join(groups, ["recipe", "ranks"], "left").select(
        "_rid",
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("keep_rid") == F.col("_rid"))).alias("kept"),
        "text_sha256",
    )


def _ranks(base: DataFrame, doubtful: DataFrame, bits: int) -> DataFrame:
    """Per text that holds a doubtful identifier: which of its texts, in order."""
    held = (
        base.select(F.sha2("_t", 256).alias("text_sha256"), F.posexplode(chunks(F.col("_t"))).alias("pos", "chunk"))
        .withColumn("h", identifier(F.col("chunk"), bits))
        .join(small_side(doubtful), "h")
    )
    rank = held.select("h", "chunk").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    placed = held.select("text_sha256", "pos", "h", "chunk").distinct().join(rank, ["h", "chunk"])
    return placed.groupBy("text_sha256").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "rank"))), lambda x: x["rank"]).alias("ranks")
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns, whatever these are called.
    Null and empty texts are equal; no rows give no rows."""
    dropped = materialize(exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select("_rid"), "dropped")
    return without_rows(docs, dropped)

"""Validation, tags, listings and outlines of a document collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremap.functions import documents as D

REQUIRED = ["title", "author", "tags", "description", "pub_date", "img_url"]


def typed(raw: DataFrame) -> DataFrame:
    """Parsed date and draft flag; a missing flag is false."""
    draft = F.lower("draft_text")
    return raw.withColumns({"pub_date": D.parse_pub_date(F.col("pub_date_text")), "draft": F.when(F.col("draft_text").isNull(), False).when(draft == "true", True).when(draft == "false", False)})


def with_errors(docs: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """``errors``: the required fields that are missing, and a draft flag that is
    neither true nor false."""
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in required]
    flag = [F.when(F.col("draft").isNull(), F.lit("draft"))] if "draft" in docs.columns else []
    return docs.withColumn("errors", F.filter(F.array(*missing, *flag), lambda e: e.isNotNull()))


def validated(docs: DataFrame, required: list[str] = REQUIRED, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects; with ``strict`` reading a bad row raises. Drafts are
    good rows: nothing here filters on the flag."""
    checked = with_errors(docs, required)
    if strict:
        raised = F.when(F.size("errors") > 0, F.raise_error(F.concat(F.lit("bad document: "), F.array_join("errors", ", "))).cast("array<string>")).otherwise(F.col("errors"))
        checked = checked.withColumn("errors", raised)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def tagged(docs: DataFrame, tags: str = "tags", id_col: str = "id") -> DataFrame:
    """``tag, <id>``: each document under each of its distinct slugs."""
    return docs.select(F.explode(D.tag_set(F.col(tags))).alias("tag"), id_col)


def tag_counts(docs: DataFrame, tags: str = "tags", id_col: str = "id") -> DataFrame:
    return tagged(docs, tags, id_col).groupBy("tag").agg(F.count("*").alias("n_docs"))


def with_tag(docs: DataFrame, tag: str, tags: str = "tags") -> DataFrame:
    return docs.where(F.array_contains(D.tag_set(F.col(tags)), tag.lower()))


def reverse(docs: DataFrame, by: str = "id") -> DataFrame:
    return docs.orderBy(F.desc(by))


def recent(docs: DataFrame, k: int = 3, by: str = "id") -> DataFrame:
    return reverse(docs, by).limit(k)

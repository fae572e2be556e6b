"""Front matter, dates, tags and outlines of text documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frontmatter(text: Column) -> Column:
    """The lines between the first two ``---`` lines; null if there are none."""
    found = F.regexp_extract(text, r"(?s)^﻿?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", 1)
    return F.when(found != "", found)


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^﻿?---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|$)", "")


def scalar(front: Column, key: str) -> Column:
    """``key: value`` with or without quotes, in any order of keys."""
    raw = F.trim(F.regexp_extract(front, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*\r?$", 1))
    bare = F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2")
    return F.when(bare != "", bare)


def block_list(front: Column, key: str) -> Column:
    """The ``- item`` lines under ``key:``; null without the key."""
    block = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*-[ \t]*.*(?:\r?\n|$))+)", 1)
    items = F.regexp_extract_all(block, F.lit(r"""(?m)^[ \t]*-[ \t]*["']?(.*?)["']?[ \t]*\r?$"""), F.lit(1))
    return F.when(block != "", items)


def parse_pub_date(s: Column) -> Column:
    """``MM/dd/yyyy HH:mm`` or ``yyyy-MM-dd HH:mm``; null otherwise."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("MM/dd/yyyy HH:mm")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm")))


def tag_slug(tag: Column) -> Column:
    return F.lower(tag)


def tag_set(tags: Column) -> Column:
    """Distinct slugs of an array of tags."""
    return F.array_distinct(F.transform(tags, tag_slug))


def doc_id(path: Column) -> Column:
    """File name without folder and extension, percent-decoded."""
    return F.url_decode(F.replace(F.regexp_extract(path, r"([^/]+)\.md$", 1), F.lit("+"), F.lit("%2B")))


def heading_slug(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s-]", "")), r"\s+", "-")


def outline_markdown(text: Column) -> Column:
    """``array<struct<depth,slug,text>>`` of the ``#`` headings, in order."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6}[ \t]+.*?)[ \t]*#*[ \t]*\r?$"), F.lit(1))
    title = lambda x: F.trim(F.regexp_replace(x, r"^#+[ \t]+", ""))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("depth"), heading_slug(title(x)).alias("slug"), title(x).alias("text")))


def outline_html(html: Column) -> Column:
    """The same for ``<h1>`` to ``<h6>``."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>)"), F.lit(1))
    title = lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))
    return F.transform(tags, lambda x: F.struct(F.substring(x, 3, 1).cast("int").alias("depth"), heading_slug(title(x)).alias("slug"), title(x).alias("text")))


def link(id_: Column) -> Column:
    return F.concat(F.lit("/blog/"), id_.cast("string"), F.lit("/"))

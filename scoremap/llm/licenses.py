"""Licence scans: notices by Aho-Corasick over words, tags by a shunting-yard parser.

A text becomes its lower-case words with one space between them; one automaton finds all
notice phrases and identifier tags in one pass, overlaps included. What follows a tag on
its line in the raw text is a licence expression, whose operators (``with`` before ``and``
before ``or``) are evaluated as they are read. Each row is worked on where it lies; there
is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremap.llm.common import bound_session

# Phrases and labels of the base scan.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Names and usual opening words of further licences.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public license": "eupl",
    "open database license": "odbl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "boost",
    "python software foundation license": "psf",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "cc0 1 0": "cc0",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noderivs": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "all rights reserved": "proprietary",
}

# Words of tags that a licence expression follows, behind a colon or an equals sign.
TAGS = ("spdx license identifier", "license expression", "packagelicensedeclared", "packagelicenseconcluded", "licenseconcluded", "licenseinfoinfile")

# Labels of identifiers by how these begin, the longest beginning that fits.
FAMILIES = {
    "agpl-": "agpl", "lgpl-": "lgpl", "gpl-": "gpl", "gfdl-": "gfdl", "apache-": "apache", "mit": "mit", "mpl-": "mpl", "epl-": "epl", "eupl-": "eupl", "cddl-": "cddl", "odbl-": "odbl",
    "bsd-": "bsd", "0bsd": "bsd", "isc": "isc", "zlib": "zlib", "bsl-": "boost", "psf-": "psf", "python-": "psf", "unlicense": "unlicense", "cc0-": "cc0", "cc-pddc": "public-domain",
    "cc-by-": "cc-by", "cc-by-sa-": "cc-by-sa", "cc-by-nd-": "cc-by-nd", "cc-by-nc-": "cc-by-nc", "cc-by-nc-sa-": "cc-by-nc-sa", "cc-by-nc-nd-": "cc-by-nc-nd",
}

#: How much a licence restricts reuse, from 0 to 1; labels without a level count as 1.
LEVELS = {
    "public-domain": 0.1, "cc0": 0.1, "unlicense": 0.1, "mit": 0.2, "isc": 0.2, "bsd": 0.2, "zlib": 0.2, "boost": 0.2, "psf": 0.2, "apache": 0.25, "cc-by": 0.25,
    "lgpl": 0.5, "mpl": 0.5, "epl": 0.5, "cddl": 0.5, "eupl": 0.6, "gpl": 0.7, "gfdl": 0.7, "odbl": 0.7, "cc-by-sa": 0.7, "agpl": 0.8, "cc-by-nd": 0.9, "cc-by-nc": 0.9, "cc-by-nc-sa": 0.9, "cc-by-nc-nd": 0.95,
}
#: An exception frees linked works, so a licence with one is at most as strict as this.
EXCEPTION = 0.5

BINDING = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.\-]*(?::[A-Za-z0-9.\-]+)?\+?))")
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FOLLOWS = re.compile(rb"[ \t]*[\"']?[ \t]*[:=][ \t]*[\"']?")
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HITS = "array<struct<word:bigint,label:string,base:boolean>>"
FOUND = "array<struct<word:bigint,expression:string,labels:array<string>,level:double,whole:boolean>>"


def label_of(identifier: str) -> str:
    """The label of a licence identifier; of an unknown one, itself in lower case."""
    low = identifier.lower().removesuffix("+")
    fits = [p for p in FAMILIES if low.startswith(p) and (p.endswith("-") or low == p or low[len(p)] == "-")]
    return FAMILIES[max(fits, key=len)] if fits else low


def _operand(name: str) -> tuple[set[str], float]:
    if name.lower() in ("none", "noassertion"):
        return set(), 0.0
    label = label_of(name)
    return {label}, LEVELS.get(label, 1.0)


def _apply(out: list[tuple[set[str], float]], op: str) -> None:
    right, left = out.pop(), out.pop()
    if op == "with":
        out.append((left[0], min(left[1], EXCEPTION)))
    else:  # one may choose between alternatives, but has to obey all parts
        out.append((left[0] | right[0], (min if op == "or" else max)(left[1], right[1])))


def evaluate(text: str) -> tuple[str, set[str], float, bool] | None:
    """The expression that ``text`` begins with: its tokens, labels and level, and whether
    it is whole (nothing dangling, brackets closed). What follows the longest expression
    is no part of it; none if the first token fits no expression."""
    seen: list[str] = []
    out: list[tuple[set[str], float]] = []
    ops: list[str] = []
    at, operand, whole = 0, False, True  # operand: whether one has just been read
    while m := TOKEN.match(text, at):
        bracket, name = m[1], (m[2] or "").rstrip(".")
        op = name.lower() if name.lower() in BINDING else None
        if bracket == "(" and not operand:
            ops.append("(")
        elif bracket == ")" and operand and "(" in ops:
            while (top := ops.pop()) != "(":
                _apply(out, top)
        elif op and operand:
            while ops and ops[-1] != "(" and BINDING[ops[-1]] >= BINDING[op]:
                _apply(out, ops.pop())
            ops.append(op)
            operand = False
        elif name and not op and not operand:
            out.append(_operand(name))
            operand = True
        else:
            break
        seen.append(bracket or (op.upper() if op else name))
        at = m.end() - len(m[2] or "") + len(name) if name else m.end()
        if m[2] and name != m[2]:  # the full stop of a sentence
            break
    while ops and not operand and seen:  # dangling operators and open brackets go
        whole, _ = False, seen.pop()
        ops.pop()
        operand = bool(seen) and seen[-1] not in ("(", "AND", "OR", "WITH")
    while ops:
        if (top := ops.pop()) == "(":
            whole = False
        else:
            _apply(out, top)
    return (" ".join(seen).replace("( ", "(").replace(" )", ")"), *out[0], whole) if out else None


class Scanner:
    """Built in a worker from the phrases, once a task."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for spelling in ("license", "licence"):
            for phrase, label in {**{p: (x, False) for p, x in NOTICES.items()}, **{p: (x, True) for p, x in BASE.items()}, **{t: (None, False) for t in TAGS}}.items():
                own = phrase.replace("license", spelling)
                self.automaton.add_word(f" {own} ", (own.count(" ") + 1, label[0], label[1] and own == phrase))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[dict], list[dict]]:
        """Number of words, notices and expressions of a text, in the order of words."""
        raw = (text or "").encode("utf-8", "replace")
        words = b" ".join(raw.translate(_PLAIN).split())
        if not words:
            return 0, [], []
        plain = f" {words.decode()} "
        hits, tags, n, at = [], [], 0, 0
        for end, (size, label, base) in self.automaton.iter(plain):
            n, at = n + plain.count(" ", at, end), end
            if label is None:
                tags.append(n - 1)  # the tag's last word
            else:
                hits.append({"word": n - size, "label": label, "base": base})
        return plain.count(" ") - 1, sorted(hits, key=lambda h: h["word"]), self._expressions(raw, tags)

    @staticmethod
    def _expressions(raw: bytes, tags: list[int]) -> list[dict]:
        out, wanted = [], iter(sorted(set(tags)))
        k = next(wanted, None)
        for i, m in enumerate(WORD.finditer(raw)) if k is not None else ():
            if i == k:
                if gap := FOLLOWS.match(raw, m.end()):
                    end = raw.find(b"\n", gap.end())
                    got = evaluate(raw[gap.end() : end if end >= 0 else len(raw)].decode("utf-8", "replace"))
                    if got:
                        out.append({"word": i + 1, "expression": got[0], "labels": sorted(got[1]), "level": got[2], "whole": got[3]})
                k = next(wanted, None)
                if k is None:
                    break
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``<id_col>, n_words, hits, expressions``.

    ``hits`` are all places of notice phrases (``base``: of the base list), ``expressions``
    what follows identifier tags; both by number of word, from 0. Null counts as empty and
    has no words; repeated rows and ids each give their row, an empty table none. Texts are
    read whole, however long; other columns are ignored whatever their names.
    """
    bound_session(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        hit = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))
        found = pa.list_(pa.struct([("word", pa.int64()), ("expression", pa.string()), ("labels", pa.list_(pa.string())), ("level", pa.float64()), ("whole", pa.bool_())]))
        for batch in batches:
            got: Iterable = [scanner.scan(t.as_py()) for t in batch.column(1)]
            n, hits, tags = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hits, hit), pa.array(tags, found)], names=["_id", "n_words", "hits", "expressions"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, n_words long, hits {HITS}, expressions {FOUND}").withColumnRenamed("_id", id_col)


def level(hits: Column, expressions: Column) -> Column:
    """How much all notices of a row together restrict reuse; 0 without any."""
    known = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    each = F.transform(hits, lambda h: F.coalesce(known[h["label"]], F.lit(1.0)))
    return F.coalesce(F.array_max(F.concat(each, F.transform(expressions, lambda e: e["level"]))), F.lit(0.0))


def summary(scanned: DataFrame) -> DataFrame:
    """The rows of ``scan`` with ``n_base, first_word, last_word, base_labels, labels,
    score`` instead of lists; ``score`` is ``level``."""
    base = F.filter("hits", lambda h: h["base"])
    start, labels = F.transform(base, lambda h: h["word"]), lambda hits: F.transform(hits, lambda h: h["label"])
    joined = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    every = F.concat(labels(F.col("hits")), F.flatten(F.transform("expressions", lambda e: e["labels"])))
    return scanned.select(
        *[c for c in scanned.columns if c not in ("hits", "expressions")],
        F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), joined(labels(base)).alias("base_labels"), joined(every).alias("labels"), level(F.col("hits"), F.col("expressions")).alias("score"),
    )

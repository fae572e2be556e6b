"""Licence scans against plain regular expressions, and the parser by hand."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoremap.llm import queries as Q
from scoremap.llm.common import materialize
from scoremap.llm.licenses import BASE, LEVELS, NOTICES, Scanner, evaluate, label_of, scan, summary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """n_words, n_base, first_word, last_word, base_labels and notice labels."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places, labels = [], set()
    for phrases, base in ((BASE, True), (NOTICES, False)):
        for phrase, label in phrases.items():
            for spelling in {phrase} if base else {phrase, phrase.replace("license", "licence")}:
                p = spelling.split()
                at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
                places += [(i, label) for i in at] if base else []
                labels |= {label} if at else set()
    for phrase, label in BASE.items():  # the other spelling is a label, but no base place
        p = phrase.replace("license", "licence").split()
        labels |= {label} if any(words[i : i + len(p)] == p for i in range(len(words))) else set()
    starts = [i for i, _ in places]
    base_labels = {x for _, x in places}
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), labels | base_labels


def test_op13(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op13_license_scan(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(docs[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], set(filter(None, r["labels"].split(",")))) == want
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert any(r["n_base"] for r in got)


ODD = [
    None, "", " \n\t", "MIT License", "mit-license, MIT LICENSE", "summit license", "mit licensed", "CC-BY-NC-SA 4.0", "Cc By cc by", "ÅMIT license", "mit license", "gnu\ngeneral\npublic/license",
    "MIT licence", "Apache Licence", "mit license " * 50_000, "x" * 3_000_000, "\x00mit\x7flicense\x01", "apache license mit license gnu general public license", "0mit license", "mit license0", "Kelvin K license", "İ mit license",
]


def test_odd_rows(spark):
    rows = [(i if i % 7 else None, t, "c", 1, "d") for i, t in enumerate(ODD)] + [(3, "MIT License", "c", 1, "d")] * 2
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, hits string, _id int, labels string"), "docs")
    got = sorted(summary(scan(docs)).collect(), key=str)
    assert len(got) == len(rows)
    want = sorted((str(i), *map(str, (*plain(t)[:5], ",".join(sorted(plain(t)[5]))))) for i, t, *_ in rows)
    assert sorted(tuple(map(str, (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]))) for r in got) == want
    none = materialize(spark.createDataFrame([], "doc_id long, text string"), "none")
    assert summary(scan(none)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*BASE, "mit", "license", "cc", "by", "nc", "gnu", "general", "public", "apache", "Ä", "  ", "\n", "-", "x", "MIT License", "all rights", "reserved"]), max_size=20), st.sampled_from([" ", "", "-", "\n"]))
def test_any_text(parts, gap):
    text = gap.join(parts)
    n, hits, _ = Scanner().scan(text)
    want = plain(text)
    base = [h["word"] for h in hits if h["base"]]
    assert (n, len(base), min(base, default=None), max(base, default=None)) == want[:4] and {h["label"] for h in hits} == want[5]


@pytest.mark.parametrize(
    ("text", "tokens", "labels", "level", "whole"),
    [
        ("MIT", "MIT", {"mit"}, 0.2, True),
        ("mit or gpl-2.0-only", "mit OR gpl-2.0-only", {"mit", "gpl"}, 0.2, True),
        ("MIT AND GPL-2.0+ OR Apache-2.0", "MIT AND GPL-2.0+ OR Apache-2.0", {"mit", "gpl", "apache"}, 0.25, True),
        ("MIT AND (GPL-2.0+ OR Apache-2.0)", "MIT AND (GPL-2.0+ OR Apache-2.0)", {"mit", "gpl", "apache"}, 0.25, True),
        ("Apache-2.0 OR MIT AND AGPL-3.0-only", "Apache-2.0 OR MIT AND AGPL-3.0-only", {"mit", "agpl", "apache"}, 0.25, True),
        ("GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", "GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", {"gpl", "mit"}, 0.5, True),
        ("((MIT))", "((MIT))", {"mit"}, 0.2, True),
        ("BSD-3-Clause */ more", "BSD-3-Clause", {"bsd"}, 0.2, True),
        ("MIT. And so on", "MIT", {"mit"}, 0.2, True),
        ("(MIT OR", "(MIT", {"mit"}, 0.2, False),
        ("MIT AND ( OR", "MIT", {"mit"}, 0.2, False),
        ("MIT Apache-2.0", "MIT", {"mit"}, 0.2, True),
        ("LicenseRef-own AND CC-BY-NC-4.0", "LicenseRef-own AND CC-BY-NC-4.0", {"licenseref-own", "cc-by-nc"}, 1.0, True),
        ("DocumentRef-a:LicenseRef-b", "DocumentRef-a:LicenseRef-b", {"documentref-a:licenseref-b"}, 1.0, True),
        ("NONE", "NONE", set(), 0.0, True),
    ],
)
def test_expressions(text, tokens, labels, level, whole):
    assert evaluate(text) == (tokens, labels, level, whole)


@pytest.mark.parametrize("text", ["", "AND MIT", ") MIT", "()", "(((", "*/", "- x", "OR"])
def test_no_expression(text):
    assert evaluate(text) is None


LEAF = st.sampled_from(["MIT", "GPL-3.0-only", "Apache-2.0", "AGPL-3.0-only", "LGPL-2.1-only", "CC0-1.0"])
TREE = st.recursive(LEAF, lambda x: st.tuples(x, st.sampled_from(["AND", "OR"]), x), max_leaves=12)


def written(t, outer=0):
    if isinstance(t, str):
        return t
    mine = 2 if t[1] == "AND" else 1
    text = f"{written(t[0], mine)} {t[1]} {written(t[2], mine)}"
    return f"({text})" if outer > mine else text


def valued(t):
    if isinstance(t, str):
        return LEVELS[label_of(t)]
    return (max if t[1] == "AND" else min)(valued(t[0]), valued(t[2]))


@settings(max_examples=200, deadline=None)
@given(TREE)
def test_expressions_follow_the_tree(t):
    got = evaluate(written(t))
    assert got[0] == written(t) and got[2] == valued(t) and got[3]


def test_tags():
    text = "# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\nfoo\n// spdx-license-identifier = 'ISC'\n<!-- SPDX-License-Identifier: Zlib -->\nSPDX-License-Identifier\nMIT\nLicense-Expression: CC-BY-4.0."
    n, hits, found = Scanner().scan(text)
    assert n == len(WORD.findall(text.lower())) and [f["expression"] for f in found] == ["(MIT OR GPL-2.0-only) AND BSD-3-Clause", "ISC", "Zlib", "CC-BY-4.0"]
    assert [f["word"] for f in found] == [3, 17, 21, 28] and [h for h in hits if h["base"]] == [{"word": 25, "label": "mit", "base": True}, {"word": 28, "label": "cc-by", "base": True}]
    assert [f["labels"] for f in found] == [["bsd", "gpl", "mit"], ["isc"], ["zlib"], ["cc-by"]]
    assert label_of("MITNFA") == "mitnfa" and label_of("MIT-0") == "mit" and label_of("GPL-2.0+") == "gpl"

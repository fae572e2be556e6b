"""The Merkle manifest against a plain version that sorts and hashes in one place."""

import hashlib
import zlib

from pyspark.sql import functions as F

from scoremap.llm.common import materialize, row_id
from scoremap.llm.merkle import leaves, manifest, proofs, ranked, tampered

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    for row in levels[:-1]:
        a = i // 3 * 3
        yield "".join(row[a:i]), "".join(row[i + 1 : a + 3])
        i //= 3


def plain(rows):
    """Rows in the order of their numbers -> the result of ``proofs``, sorted."""
    by = {}
    for k, r in enumerate(rows):
        leaf = sha(*map(framed, r))
        by.setdefault(r[1], []).append((r[0] is None, r[0] or 0, int(leaf[:15], 16), k, leaf, r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[4] for x in sorted(by[s])]) for s in names}
    top, out = tree([trees[s][-1][0] for s in names]), []
    for j, s in enumerate(names):
        for i, (*_, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:4])):
            path, text = [*siblings(trees[s], i), *siblings(top, j)], r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = sha(*map(framed, (*r[:4], text)))
            for left, right in path:
                h = sha(left, h, right)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha(*[a + b for a, b in path]), h, h == top[-1][0]))
    return sorted(out, key=str)


def check(spark, rows, schema=DOCS):
    docs = materialize(spark.createDataFrame(rows, schema).coalesce(1), "docs")
    got = proofs(docs, tampered(F.col("text"), F.col("doc_id")))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in row_id(docs, "__n").orderBy("__n").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == plain(found)


def test_odd_rows(spark):
    rows = [(7, "a", "en", 3, "x\ny"), (7, "a", "en", 3, "x\ny"), (7, "a", None, None, None), (7, "a", "en", 0, ""), (None, "a", "en", 1, "z"), (None, "a", "en", 1, "z"), (None, "a", None, 2, "zz")]
    rows += [(5, None, "en", 1, "q"), (-3, None, None, 1, "q\n"), (None, None, None, None, None), (2, "", "é", 1, "ß\n"), (1 << 62, "é", "en", 1, "far"), (-(1 << 62), "é", "en", 1, "far"), (0, "Z", "en", 1, "\n" * 5000)]
    check(spark, rows)


def test_hot_sources_ties_and_many_sources(spark):
    rows = [(i * 7919 % 100_003, "hot", "en", i, f"t\n{i}") for i in range(2300)]  # more than three rounds of slots
    rows += [(11, "same id", "en", i % 50, f"u\n{i % 50}") for i in range(900)]
    rows += [(i, f"s{i}", None, 1, "v") for i in range(800)]
    rows += [(i, f"small {n}", "en", i, "x\n") for n in (2, 3, 4, 9, 10, 27, 28, 729, 730) for i in range(n)]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    docs = materialize(spark.createDataFrame([], DOCS), "none")
    assert proofs(docs).collect() == [] and manifest(leaves(docs)).root is None
    wide = DOCS + ", _rid string, _s long, _hash string, path string, leaf int, root int, _pos int, `a.b` int"
    check(spark, [(i, "a", "en", 1, "x\n", "r", 1, "h", "p", 1, 2, 3, 4) for i in range(5)], wide)


def test_ranks_and_nodes(spark):
    rows = [(k, g, v) for k, (g, v) in enumerate([(g, v) for g in ("a", "b") for v in [*range(-70, 200, 3), 5, 5, 1 << 40, -(1 << 40), 63, 64, 65]])]
    df = materialize(spark.createDataFrame(rows, "_rid long, g string, v long"), "rows")
    got = {r["_rid"]: r["_pos"] for r in ranked(df, "g", ["v", "_rid"]).collect()}
    want = {k: sorted((v2, k2) for k2, g2, v2 in rows if g2 == g).index((v, k)) for k, g, v in rows}
    assert got == want
    docs = materialize(spark.createDataFrame([(i, "a" if i % 9 else None, "en", i, "x") for i in range(900)], DOCS), "docs")
    tree_of = manifest(leaves(docs))
    found = {}
    for r in tree_of.nodes().collect():
        found.setdefault((r["source"], r["level"]), {})[r["pos"]] = r["digest"]
    for s in (None, "a"):
        mine = [sha(*map(framed, (i, s, "en", i, "x"))) for i in range(900) if ("a" if i % 9 else None) == s]
        assert [list(dict(sorted(found[s, k].items())).values()) for k in range(len(tree(mine)))] == tree(mine)


def test_a_changed_row_is_found(spark):
    docs = materialize(spark.createDataFrame([(i, f"s{i % 3}", "en", 1, f"text {i}") for i in range(40)], DOCS), "docs")
    got = {r["doc_id"]: r["verified"] for r in proofs(docs, F.when(F.col("doc_id") == 17, F.lit("other"))).collect()}
    assert got == {i: i != 17 for i in range(40)}

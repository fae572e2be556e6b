import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoremap.llm import bagminhash, exact_dedup, line_dedup, suffix_dedup
from scoremap.llm.components import components
from scoremap.llm.shingles import Hasher, bags, overlap

SCHEMA = "doc_id long, text string, lang string, _rid string, n int, h int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, "k") for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


ODD = [(7, None), (3, ""), (9, " \t\n"), (5, "x"), (5, "x"), (None, "x"), (None, None), (1, "a  b"), (2, "a\n\tb"), (4, "a b"), (8, "z" * 20000), (6, "z" * 20000)]


@pytest.mark.parametrize("bits", [64, 2])
def test_exact(spark, bits):
    rng = random.Random(1)
    long = words(rng, 3000)
    rows = ODD + [(20, long), (21, long + " "), (22, long + "x"), (23, "x" + long), (24, long.replace(" ", "\n"))]
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    order = lambda i: (i is None, i or 0)
    got = exact_dedup.exact_dedup(frame(spark, rows), bits=bits).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, min(groups[norm(t)], key=order), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_survivors_keep_columns(spark):
    docs = frame(spark, ODD)
    out = exact_dedup.survivors(docs)
    assert out.columns == docs.columns and out.count() == 6 and out.where("_rid <> 'x'").isEmpty()
    near = bagminhash.survivors(docs)
    assert near.columns == docs.columns and near.count() == 5  # texts without words are one class


def test_empty_tables(spark):
    none = frame(spark, []).where("doc_id is not null")
    assert exact_dedup.exact_dedup(none).isEmpty() and bagminhash.near_dedup(none).isEmpty()
    assert line_dedup.line_dedup(none).isEmpty() and suffix_dedup.suffix_dedup(none).isEmpty()


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(5)
    feature = np.sort(rng.integers(1, 2**63, 40).astype(np.uint64))
    wa, wb = rng.integers(1, 12, 40), rng.integers(1, 12, 40)
    a, b = (feature, wa), (feature[:30], wb[:30])
    ids = bagminhash.signatures([a, b], 4000)
    assert abs((ids[0] == ids[1]).mean() - overlap(a, b)) < 0.03
    assert (bagminhash.signatures([a], 64)[0] == bagminhash.signatures([b, a], 64)[1]).all()


def brute_classes(rows, threshold=0.8):
    found = bags([t for _, t in rows], Hasher())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if overlap(found[a], found[b]) >= threshold:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(len(rows))]


def test_near_equals_brute_force(spark):
    rng = random.Random(2)
    rows, i = [], 0
    passage = words(rng, 14)
    for _ in range(12):
        base = words(rng, rng.randint(8, 90)).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            rows.append((i, " ".join(copy)))
            i += 1
    for _ in range(25):  # short texts around one passage
        rows.append((i, passage + " " + words(rng, rng.randint(0, 6))))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "one two"), (i + 3, "one two"), (i + 4, "one two three")]
    got = {r["doc_id"]: r for r in bagminhash.near_dedup(frame(spark, rows)).collect()}
    want = brute_classes(rows)
    assert {k: r["class_id"] for k, r in got.items()} == {j: want[j] for j in range(len(rows))}
    assert sum(r["kept"] for r in got.values()) == len(set(want))
    assert all(r["class_size"] == want.count(want[k]) for k, r in got.items())


def test_components_of_random_links(spark):
    rng = random.Random(13)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(1, 200)]
    up = {v: v for p in links for v in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: root(v) for v in up}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_within_equals_edit_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(2))
        for k in range(4):
            assert line_dedup.within(a, b, k) == (edits(a, b) <= k)


@pytest.mark.parametrize("hot_key", [256, 2, 0])
def test_lines_equal_brute_force(spark, hot_key):
    """With 0 all keys count as hot, as often as there are rounds."""
    rng = random.Random(4)
    pool = [words(rng, rng.randint(2, 8)) for _ in range(20)] + [words(rng, 2)[: rng.randint(1, 17)] for _ in range(20)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            x = list(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                k, op = rng.randrange(len(x) + 1), rng.random()
                x[k : k + (op < 0.6)] = [rng.choice("xyzé")] if op > 0.3 else []
            lines.append("".join(x))
        rows.append((i, "\n".join(lines)))
    rows += [(90, None), (91, "")]
    first = {}
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            first.setdefault(x, (i, n))
    texts = list(first)
    near = {(a, b) for a in texts for b in texts if a < b and edits(a, b) <= min(line_dedup.LIMIT, min(len(a), len(b)) // 8)}
    assert near
    name = {x: x for x in texts}
    for _ in texts:
        for a, b in near:
            low = min(name[a], name[b], key=first.get)
            name[a] = name[b] = low
    degree = collections.Counter(x for p in near for x in p)
    got = {(r["doc_id"], r["line_no"]): r for r in line_dedup.line_dedup(frame(spark, rows), hot_key=hot_key).collect()}
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            r = got.pop((i, n))
            assert ((r["class_doc"], r["class_line"]), r["n_links"]) == (first[name[x]], degree[x])
            assert r["kept"] == ((i, n) == first[name[x]])
    assert not got
    text = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(frame(spark, rows)).collect()}
    assert len(text) == len(rows) and sum(len(t.split("\n")) if t else 0 for t in text.values()) <= len(set(name.values()))


def test_lines_with_a_common_start(spark):
    """Thousands of lines that share a segment meet under what follows it."""
    rng = random.Random(9)
    start = "the following line was posted by a reader on "
    lines = [start + "".join(rng.choice("abcdefghij") for _ in range(24)) for _ in range(1500)]
    lines += [x[:60] + "#" + x[61:] for x in lines[:200]] + [x[:50] + x[51:] for x in lines[100:300]] + [x + "zz" for x in lines[:50]]
    rows = [(i, x) for i, x in enumerate(lines)]
    want = collections.Counter()
    for a in range(len(lines)):
        for b in range(1500, len(lines)):
            if b > a and line_dedup.within(lines[a], lines[b], 2):
                want[a] += 1
                want[b] += 1
    got = {r["doc_id"]: r["n_links"] for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == {i: want[i] for i in range(len(lines))} and sum(want.values()) >= 900


def brute_spans(rows, match):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(r[i : i + match] for r in raw for i in range(len(r) - match + 1))
    out = []
    for r in raw:
        hit = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - match + 1):
            if seen[r[i : i + match]] > 1:
                hit[i + 1 : i + 1 + match] = True
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


@pytest.mark.parametrize(("many", "large", "size"), [(4096, 1 << 21, 1 << 18), (4096, 0, 2000), (2, 1 << 21, 1)])
def test_suffix_equals_brute_force(spark, monkeypatch, many, large, size):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", size)
    rng = random.Random(6)
    shared = [words(rng, 60) for _ in range(3)]
    rows = [(i, words(rng, rng.randint(0, 30)) + " " + rng.choice(shared)[rng.randint(0, 150) :] + words(rng, rng.randint(0, 30)) + "é" * rng.randint(0, 3)) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "ab" * 400), (93, "q" * 700), (94, rows[0][1]), (95, rows[0][1]), (96, "short"), (96, "short")]
    got = suffix_dedup.suffix_dedup(frame(spark, rows), many=many).collect()
    want = collections.Counter((i, len((t or "").encode()), tuple(s)) for (i, t), s in zip(rows, brute_spans(rows, suffix_dedup.MATCH)))
    assert collections.Counter((r["doc_id"], r["n_bytes"], tuple((s["a"], s["b"]) for s in r["spans"])) for r in got) == want
    text = {i: (t or "").encode() for i, t in rows}
    for r in got:
        raw, at, kept = text[r["doc_id"]], 0, b""
        for s in r["spans"]:
            kept, at = kept + raw[at : s["a"]], s["b"]
        assert bytes(r["kept"]) == kept + raw[at:]


def test_short_periodic_texts_equal_brute_force(spark):
    """Anchors of a text that have all of it as their context are no copies of each other."""
    rng = random.Random(4)
    rows = [(0, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(47)) * 5)]
    assert all(not r["spans"] for r in suffix_dedup.suffix_dedup(frame(spark, [(0, rows[0][1][:234])])).collect())
    for period in range(1, 201):
        block = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(period))
        rows += [(len(rows) + k, (block * (size // period + 1))[:size]) for k, size in enumerate(sorted({200, rng.randint(201, 263), rng.randint(264, 335), 336, rng.randint(337, 420)}) if period % 3 else [rng.randint(200, 340)])]
    got = suffix_dedup.suffix_dedup(frame(spark, rows)).collect()
    want = sorted((i, tuple(s)) for (i, _), s in zip(rows, brute_spans(rows, suffix_dedup.MATCH)))
    assert sorted((r["doc_id"], tuple((s["a"], s["b"]) for s in r["spans"])) for r in got) == want


def test_marks_come_from_the_index(spark, monkeypatch):
    """Without the index nothing is removed, repeated texts included."""
    rng = random.Random(8)
    text = words(rng, 80)
    rows = [(1, text), (2, text), (3, words(rng, 20) + text + words(rng, 20)), (4, words(rng, 90))]
    full = {r["doc_id"]: sum(s["b"] - s["a"] for s in r["spans"]) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert full == {1: len(text), 2: len(text), 3: len(text), 4: 0}
    monkeypatch.setattr(suffix_dedup.RunIndex, "longest", lambda self: np.zeros(len(self.t), np.int64))
    monkeypatch.setattr(suffix_dedup, "repeats", lambda pieces, match=200, copied=(): (np.zeros(sum(len(p) + 1 for p in pieces), bool), np.cumsum([0, *(len(p) + 1 for p in pieces)])[:-1]))
    assert all(not r["spans"] for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect())


def test_first_letters_keep_the_order():
    rng = random.Random(9)
    for _ in range(200):
        t = np.frombuffer(b"".join(bytes(rng.choice(b"abz") for _ in range(rng.randint(0, 20))) + b"\xff" for _ in range(4)), np.uint8)
        room = suffix_dedup.to_separator(t)
        key, have = suffix_dedup.first_letters(t, room)
        cut = [bytes(t[i : i + min(have, room[i] + 1)]) for i in range(len(t))]
        order = sorted(range(len(t)), key=lambda i: cut[i])
        assert [cut[i] for i in order] == [cut[i] for i in np.argsort(key, kind="stable")]


@pytest.mark.parametrize("letters", ["абвгдежзийклмнопрстуфхцчшщ    ", "".join(map(chr, range(0x4E00, 0x5E00))), "0123456789", "".join(map(chr, range(0x905, 0x939))) + "    ", "abcdefghijklmnop  "])
def test_chunks_follow_content_in_any_script(spark, letters):
    rng = random.Random(10)
    text = "".join(rng.choice(letters) for _ in range(30000))
    got = spark.createDataFrame([(0, text), (1, "an insertion " + text)], "i int, t string").select("i", exact_dedup.chunks(F.col("t")).alias("c")).collect()
    a, b = (next(r["c"] for r in got if r["i"] == i) for i in (0, 1))
    assert "".join(a).encode("latin-1").decode() == text and len(a) > 15
    assert sum(x in set(b) for x in a) > 0.8 * len(a)


def test_run_index_equals_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        m = rng.randint(1, 8)
        seen = collections.Counter(p[i : i + m] for p in pieces for i in range(len(p) - m + 1))
        assert [x.tolist() for x in suffix_dedup.match_starts(pieces, m)] == [[i for i in range(len(p) - m + 1) if seen[p[i : i + m]] > 1] for p in pieces]


def test_near_dedup_leaves_no_inner_steps(spark):
    """Only classes stay in the shared folder; pairs, buckets and shingles go on the way."""
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "scoremap"
    rng = random.Random(8)
    base = [rng.choice("abcdefgh") * 3 + str(k) for k in range(60)]
    rows = [(i, " ".join([*base[: 60 - i % 7], *(f"w{i % 5}x{k}" for k in range(i % 12))])) for i in range(60)]
    there = set(shared.glob("*/*")) if shared.exists() else set()
    got = bagminhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 60
    left = {p.name for p in set(shared.glob("*/*")) - there}
    assert "classes" in left and not left & {"sketches", "copies", "buckets", "star", "checked", "got", "placed", "left", "tokens", "rarest", "rest", "more"}

"""The registered opN queries against plain Python versions of their contracts."""

import base64
import collections
import hashlib
import os
import re
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from scoremap.llm import common
from scoremap.llm import queries as Q
from scoremap.llm.bpe import read_ranks
from scoremap.llm.common import materialize, row_id
from scoremap.llm.shingles import Hasher, bags, overlap

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {i: (t or "").encode() for i, t in duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall()}


@pytest.fixture(scope="module")
def pages():
    return duckdb.sql(f"SELECT page_id, url, html FROM read_parquet('{SF}/pages.parquet')").fetchall()


def test_op1(spark, texts):
    got = Q.op1_line_dedup(spark, SF).collect()
    lines = {(i, n): x for i, t in texts.items() for n, x in enumerate(t.decode().split("\n"))}
    assert {(r["doc_id"], r["line_no"]) for r in got} == set(lines) and len(got) == len(lines)
    copies = collections.Counter(lines.values())
    by = {(r["doc_id"], r["line_no"]): r for r in got}
    name = {}
    for k, x in lines.items():
        r = by[k]
        assert r["n_copies"] == copies[x] and name.setdefault(x, (r["class_doc"], r["class_line"])) == (r["class_doc"], r["class_line"])
        assert r["kept"] == (k == (r["class_doc"], r["class_line"]))


def test_op2(spark, pages):
    got = {r["page_id"]: r for r in Q.op2_html_extract(spark, SF).collect()}
    assert set(got) == {p for p, _, _ in pages}
    for p, url, html in pages:
        r = got[p]
        assert r["url"] == url and r["n_chars"] == len(r["text"]) and r["text"] == "\n".join(" ".join(x.split()) for x in r["text"].split("\n"))
        # these pages hold their text in one <article>; its blocks, cut by plain patterns
        inner = re.search(r"(?s)<article[^>]*>(.*?)</article>", html or "")
        if inner and "<div" not in inner[1] and "class=" not in inner[1] and "<script" not in inner[1]:
            for h in re.findall(r"(?s)<h1>(.*?)</h1>", inner[1]):
                assert " ".join(re.sub("<[^>]*>", "", h).split())[:20].split("&")[0] in r["text"]


def test_op4(spark, texts):
    got = {r["doc_id"]: r for r in Q.op4_language_id(spark, SF).collect()}
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM read_parquet('{SF}/documents.parquet')").fetchall())
    assert set(got) == set(texts)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and lang[i] and any(c.isalpha() for c in texts[i].decode())]
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) >= 0.95 * len(held)


def test_op5(spark, texts):
    ids = sorted(texts)
    found = bags([texts[i].decode() for i in ids], Hasher())
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if overlap(found[a], found[b]) >= 0.8:
                x, y = root(ids[a]), root(ids[b])
                up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in Q.op5_bagminhash(spark, SF).collect()}
    size = collections.Counter(root(i) for i in ids)
    assert {i: (r["class_id"], r["class_size"], r["kept"]) for i, r in got.items()} == {i: (root(i), size[root(i)], root(i) == i) for i in ids}


def test_op6(spark, pages):
    got = {r["page_id"]: r for r in Q.op6_warc(spark, SF).collect()}
    first = {}
    for p, _, h in pages:
        first[h or ""] = min(p, first.get(h or "", p))
    assert len(got) == len(pages)
    for p, _, h in pages:
        raw = (h or "").encode()
        again = first[h or ""] != p
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)
        assert tuple(got[p])[1:] == want


def test_op7(spark, texts):
    seen = collections.Counter(t[k : k + 200] for t in texts.values() for k in range(len(t) - 199))
    got = {r["doc_id"]: r for r in Q.op7_suffix_dedup(spark, SF).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        hit = np.zeros(len(t) + 2, int)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                hit[k] += 1
                hit[k + 200] -= 1
        covered = np.cumsum(hit)[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~covered])
        assert tuple(got[i])[1:] == (len(t), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op8(spark, texts):
    got = {r["doc_id"]: r for r in Q.op8_media_chunks(spark, SF).collect()}
    assert len(got) == len(texts)
    same = {}
    for i, t in texts.items():
        payload = t + b"\xff" * (max(576, -(-len(t) // 576) * 576) - len(t))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        # a canonical WAV file: 44 bytes of header, 8 bits, one channel
        head = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt \x10\0\0\0\1\0\1\0\x80\x3e\0\0\x80\x3e\0\0\1\0\x08\0data" + len(payload).to_bytes(4, "little")
        assert (r["media_bytes"], r["media_sha256"]) == (len(payload) + 44, hashlib.sha256(head + payload).hexdigest())
        x = np.frombuffer(payload, np.uint8).astype(int) - 128
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x[:-1].tolist(), x[1:].tolist()))
        assert r["feature"] == f"frames={len(payload) // 576};sum={x.sum()};energy={(x * x).sum()};crossings={crossings};peak={abs(x).max()}"
        assert same.setdefault(t, tuple(r)[1:]) == tuple(r)[1:]


def test_op9(spark, texts):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op9_bpe(spark, SF).collect()}
    want = {}
    for i, t in texts.items():
        ids = plain.encode_ordinary(t.decode())
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t).hexdigest())
    assert got == want


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op10_mixing", "op11_merkle_manifest"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in want.description]
    df = Q.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert collections.Counter(tuple(r[c] for c in names) for r in df.collect()) == collections.Counter(want.fetchall())


def test_stages_equal_brute_force(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = materialize(corpus_pipeline.language_id(spark, docs, SF), "a")
    left = {r["doc_id"] for r in kept.collect()}
    assert all(i in left for i, t in texts.items() if len(t) > 200) and not any(i in left for i, t in texts.items() if not any(c.isalpha() for c in t.decode()))
    after = materialize(corpus_pipeline.exact(spark, kept, SF), "b")
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(b"[\x20\x09-\x0d]+", b" ", texts[i]), i)
    left = sorted(r["doc_id"] for r in after.collect())
    assert left == sorted(first.values())
    near = sorted(r["doc_id"] for r in materialize(corpus_pipeline.near(spark, after, SF), "c").collect())
    found = bags([texts[i].decode() for i in left], Hasher())
    up = list(range(len(left)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            if overlap(found[a], found[b]) >= 0.8:
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert near == [i for k, i in enumerate(left) if root(k) == k]


def test_stages_of_an_empty_table(spark):
    docs = materialize(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < -1"), "none")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.isEmpty()


@pytest.mark.parametrize("literal", [4096, 1])
def test_row_numbers_do_not_depend_on_splits(spark, tmp_path, monkeypatch, literal):
    monkeypatch.setattr(common, "LITERAL_FILES", literal)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(7).write.parquet(f"file://{tmp_path}/many")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    for path in (f"file://{SF}/documents.parquet", f"file://{tmp_path}/many"):
        seen = []
        for size in ("128m", "4k"):
            spark.conf.set(key, size)
            frame = spark.read.parquet(path)
            seen.append({r["_rid"]: r["doc_id"] for r in row_id(frame.where("doc_id >= 0").select("doc_id")).collect()})
        spark.conf.set(key, old)
        assert seen[0] == seen[1] and len(seen[0]) == docs.count()
    # rows of a join are no rows of a file
    twice = docs.join(spark.range(2).withColumnRenamed("id", "n"), F.lit(True))
    assert row_id(twice.select("doc_id")).select("_rid").distinct().count() == 2 * docs.count()


def test_workers_without_the_repository(tmp_path):
    """The driver alone knows where the library is."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.local.dir", "{tmp_path}").getOrCreate()
from scoremap.llm import common
from scoremap.llm import queries as Q
for name in ("op4_language_id", "op5_bagminhash", "op2_html_extract"):
    assert Q.queries()[name](spark, {SF!r}).count() > 0, name
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    path = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and os.path.realpath(p) != repo]
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env | ({"PYTHONPATH": ":".join(path)} if path else {}), capture_output=True, text=True, timeout=400)
    assert "fine" in done.stdout, done.stderr[-2000:]

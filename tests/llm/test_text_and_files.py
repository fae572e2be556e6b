import base64
import collections
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from scoremap.llm import bpe, html_extract, language_id, media_chunks, mixing, warc

ODD_TEXTS = [None, "", " ", "\n\n  x", "it's  we'll", "naïve Ünïcödé 🙂🙂", "a" * 5000, " " * 3000, "\x00\x1c\x85　​", "<|endoftext|> 12345", "x\r\n\r\ny ", "été " * 2000, "it's  we'll"]


def docs(spark, rows, schema="doc_id long, text string, ids string, block int, n_copies string, _rid int"):
    return spark.createDataFrame([(i, t, "a", 1, "b", 2) for i, t in rows], schema)


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_equals_tiktoken(spark, tokenizer):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizer.ranks, special_tokens={})
    rows = list(enumerate(ODD_TEXTS)) + [(None, "null id")]
    out = tokenizer.encode(docs(spark, rows).select("doc_id", "text", "block"), ["doc_id", "block"])
    got = {r["doc_id"]: r for r in out.select("doc_id", "block", "ids", tokenizer.decode(F.col("ids")).alias("raw")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i]["ids"] == plain.encode_ordinary(t or "") and bytes(got[i]["raw"]) == (t or "").encode() and got[i]["block"] == 1
    assert tokenizer.encode(docs(spark, []).where("doc_id > 0"), ["doc_id"]).isEmpty()


def test_parts_split_like_the_whole():
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice([" ", " ", "a", "b", "\n", "'s", "1", ".", " ", "é", "\x1c", "\x85"]) for _ in range(rng.randint(0, 14)))
        first, rest = bpe.spaced(t)
        cut = regex.findall(public_tokenizers.PATTERN, first) + [w for p in rest for w in regex.findall(public_tokenizers.PATTERN, " " + p)]
        assert cut == regex.findall(public_tokenizers.PATTERN, t)


def test_heap_merges_like_the_fold(spark, tokenizer):
    rng = random.Random(4)
    ws = ["".join(rng.choice("thean iozé") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    frame = spark.createDataFrame([(bpe.latin(w.encode()),) for w in ws], "word string")
    for r in tokenizer.encode_words(frame).collect():
        assert r["ids"] == bpe.merge_by_heap(r["word"].encode("latin-1"), tokenizer.ranks)


def test_language_id(spark):
    rng = random.Random(5)
    alphabets = {"aa": "abcde", "bb": "defgh"}
    rows = []
    for i in range(300):
        lang = rng.choice(list(alphabets))
        rows.append((i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(30)), lang))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, "abc abc ab", None), (None, "fgh fgh", "bb"), (1004, "ABCAB, ABACD!", "zz")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame = frame.withColumn("held", language_id.held_out("doc_id"))
    assert {r["doc_id"]: r["held"] for r in frame.where("doc_id < 50").collect()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}
    model = language_id.LanguageId.fit(frame.where("not held"))
    got = {r["doc_id"]: r for r in model.predict(frame, ["doc_id", "held"]).collect()}
    assert len(got) == len(rows)
    want = {i: lang for i, t, lang in rows if i is not None and i < 300}
    held = [i for i in want if got[i]["held"]]
    assert sum(got[i]["lang_pred"] == want[i] for i in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["rejected"] and got[1003]["lang_pred"] == "aa"
    assert sum(got[i]["rejected"] for i in want) <= 3
    empty = language_id.LanguageId.fit(frame.where("doc_id < 0"))
    assert {r["lang_pred"] for r in empty.predict(frame, ["doc_id"]).collect()} == {"und"}


@pytest.mark.parametrize("sizes", [{"aa": 400, "bb": 60, "cc": 12}, {"aa": 3, "bb": 3}])
def test_unknown_language_is_rejected_on_small_tables(spark, sizes):
    rng = random.Random(9)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    rows = [(1000 * k + i, make(alphabets[lang]), lang) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    # unknown letters, and known ones of all languages mixed
    planted = [(10000 + i, make("αβγδεζηθ"), None) for i in range(20)] + [(20000 + i, make("".join(alphabets.values()) + "pqrstuvw"), None) for i in range(20)]
    model = language_id.LanguageId.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.levels) == set(sizes) and all(math.isfinite(v) for v in model.levels.values())
    got = {r["doc_id"]: r["rejected"] for r in model.predict(spark.createDataFrame(rows + planted, "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    assert all(got[i] for i, _, _ in planted)
    assert sum(got[i] for i, _, _ in rows) <= 0.01 * len(rows)


def test_mixing_budget_and_repeats(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice("aaaaaaab")) for i in range(900)] + [(2000, None, None), (2001, "", "c"), (2002, "x y", None), (2002, "x y", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame, block_tokens=200, max_repeats=50.0).collect()
    total = sum(r["n_tokens"] for r in got)
    by = collections.defaultdict(lambda: [0, 0, 0.0, set()])
    for r in got:
        x = by[r["source"]]
        x[0] += r["n_tokens"]
        x[1] += r["n_tokens"] * r["n_copies"]
        x[2] = r["weight"]
        x[3].add(r["n_copies"])
    assert len(got) == len(rows) and abs(sum(x[2] for x in by.values()) - 1) < 1e-9
    for x in (by["a"], by["b"], by[None]):
        assert x[2] * total - 61 <= x[1] <= x[2] * total + 1e-6  # at most one document short
    entropy = lambda p: -sum(q * math.log2(q) for q in p if q)
    natural, flat = entropy([x[0] / total for x in by.values()]), math.log2(3)
    assert entropy([x[2] for x in by.values()]) <= natural + 0.5 * (flat - natural) + 1e-6
    tight = mixing.mix(frame, block_tokens=200, max_repeats=1.5).collect()
    assert max(r["weight"] * total / by[r["source"]][0] for r in tight if by[r["source"]][0]) <= 1.5 + 1e-6
    assert by["c"][3] == {1}
    clash = frame.withColumn("_rid", F.lit("r")).withColumn("_copies", F.lit("c"))
    out = mixing.mixed_rows(clash, block_tokens=200, max_repeats=50.0)
    assert out.columns == clash.columns and out.count() == sum(r["n_copies"] for r in got) and out.where("_rid <> 'r'").isEmpty()
    assert mixing.mix(frame.where("doc_id < 0")).isEmpty()
    assert {r["n_copies"] for r in mixing.mix(frame.where("doc_id = 2001")).collect()} == {1}


def test_media_round_trip(spark):
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefghij ") for _ in range(30000))
    texts = [None, "", "x", base, base, base[:9000] + "EDIT" + base[9000:], base[5000:], "é" * 40000, "y" * 576, "y" * 577]
    held = media_chunks.store(docs(spark, list(enumerate(texts))), ["doc_id", "block"])
    read = {bytes(r["payload_id"]): r for r in media_chunks.read_back(held).collect()}
    index = held.index.collect()
    assert len(index) == len(texts) and len(read) == len(set(t or "" for t in texts))
    for r in index:
        head, payload, n = media_chunks.wav(texts[r["doc_id"]])
        got = read[bytes(r["payload_id"])]
        assert r["n_bytes"] == n and len(payload) % 576 == 0 and len(payload) > 0
        assert bytes(got["media"]) == head + payload and media_chunks.wav_samples(bytes(got["media"])) == payload and got["feature"] == media_chunks.wav_feature(head + payload)
    stored = sum(len(c["bytes"]) for r in held.blobs.collect() for c in r["own"])
    assert stored < 0.6 * sum(len(media_chunks.wav(t)[1]) for t in texts)  # shared chunks once
    assert media_chunks.read_back(media_chunks.store(docs(spark, []).where("doc_id > 0"), ["doc_id"])).isEmpty()


def test_warc_ranges_and_revisits(spark):
    rng = random.Random(8)
    rows = [(i, f"http://h/{i}\r\nX: y", rng.choice(["<p>same</p>", f"<p>{i}</p>" * rng.randint(1, 900), "é\x1f", None, ""])) for i in range(120)] + [(None, None, "<p>same</p>"), (5, "u", "<p>same</p>")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    for step in (37, 5000, warc.RANGE_BYTES):
        got = warc.read_archives(warc.archive_pages(frame), step).collect()
        assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", 10**9), 10**8 if i is None else i)
    by = collections.Counter()
    for r in got:
        i = int(r["record_id"]) if r["record_id"] else None
        texts = [(h or "") for j, _, h in rows if j == i]
        raw = next(t for t in texts if base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() == r["payload_digest"])
        assert r["payload_bytes"] == len(raw.encode()) and "\r" not in (r["uri"] or "")
        if r["record_type"] == "response":
            by[raw] += 1
            assert bytes(r["payload"]) == raw.encode() and i == first[raw] and r["refers_to"] is None
        else:
            assert int(r["refers_to"]) == first[raw] and bytes(r["payload"]) == b""
    assert set(by.values()) == {1} and set(by) == set(first)
    big = warc.archive_pages(frame, min_bytes=1000)
    assert {r["record_type"] for r in warc.read_archives(big).where("payload_bytes < 1000").collect()} == {"response"}
    assert warc.read_archives(warc.archive_pages(frame.where("page_id < 0"))).isEmpty()
    assert list(warc.records_in(io.BytesIO(b"\x1f\x8b\x08 no record" * 9), 0, 200)) == []


def member(kind, block, **fields):
    """A gzip member with one WARC record, written here by hand."""
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    raw = f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return gzip.compress(raw)


def test_foreign_warc_records(spark, tmp_path):
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    chunked = b"HTTP/1.1 404 Not Found\r\nTransfer-Encoding: chunked\r\n\r\n"
    body = b"<p>" + bytes(range(256)) + MAGIC_TEXT
    kind = "application/http; msgtype=response"
    records = [
        member("warcinfo", b"software: none", WARC_Record_ID="<urn:uuid:0>", Content_Type="application/warc-fields"),
        member("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<urn:uuid:1>", Content_Type="application/http; msgtype=request"),
        member("response", http + body, WARC_Record_ID="<urn:uuid:2>", Content_Type=kind, WARC_Payload_Digest=f"sha1:{sha(body)}", WARC_Target_URI="http://a/"),
        member("response", http + body, WARC_Record_ID="<urn:uuid:3>", Content_Type=kind),
        member("response", http + body, WARC_Record_ID="<urn:uuid:4>", Content_Type=kind, WARC_Payload_Digest=f"sha1:{hashlib.sha1(body).hexdigest()}"),
        member("response", http + body, WARC_Record_ID="<urn:uuid:5>", Content_Type=kind, WARC_Payload_Digest=f"sha1:{sha(b'other')}"),
        member("response", chunked + b"3\r\nabc\r\nA;x=y\r\n0123456789\r\n0\r\n\r\n", WARC_Record_ID="<urn:uuid:6>", Content_Type=kind, WARC_Payload_Digest=f"sha1:{sha(b'abc0123456789')}"),
        member("revisit", http, WARC_Record_ID="<urn:uuid:7>", Content_Type=kind, WARC_Payload_Digest=f"sha1:{sha(body)}", WARC_Refers_To="<urn:uuid:2>"),
    ]
    noise = b"\x1f\x8b\x08 no member " + gzip.compress(b"no record")
    (tmp_path / "f.warc.gz").write_bytes(noise + records[0] + noise + b"".join(records[1:]) + records[2][:-30])
    manifest = spark.createDataFrame([(f"file://{tmp_path}/f.warc.gz", (tmp_path / "f.warc.gz").stat().st_size)], "path string, bytes long")
    for step in (61, 1 << 20):
        got = {r["record_id"]: r for r in warc.read_archives(manifest, step).collect()}
        assert sorted(got) == [f"urn:uuid:{i}" for i in range(8)]
        assert [got[f"urn:uuid:{i}"]["digest_ok"] for i in range(8)] == [None, None, True, None, True, False, True, None]
        assert [got[f"urn:uuid:{i}"]["http_status"] for i in range(8)] == [None, None, 200, 200, 200, 200, 404, 200]
        assert all(bytes(got[f"urn:uuid:{i}"]["payload"]) == body for i in range(2, 6)) and bytes(got["urn:uuid:6"]["payload"]) == b"abc0123456789"
        assert all(got[f"urn:uuid:{i}"]["payload_digest"] == sha(body) for i in (2, 4, 5, 7))  # that of the bytes read, whatever the header says
        assert got["urn:uuid:3"]["payload_digest"] == sha(body) and got["urn:uuid:7"]["refers_to"] == "urn:uuid:2" and got["urn:uuid:2"]["uri"] == "http://a/"


MAGIC_TEXT = b"\x1f\x8b\x08" * 5


def plain_kneser_ney(texts, chars):
    """p(character, three before it) by dictionaries, from the definition."""
    top = collections.Counter()
    for t in texts:
        padded = ["pad"] * 3 + list(t)
        for i in range(3, len(padded)):
            top[tuple(padded[i - 3 : i + 1])] += 1
    levels = {4: top}
    for k in (3, 2, 1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    discount = {}
    for k, c in levels.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = n1 / (n1 + 2 * n2) if n1 else 0.5

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (chars + 1)
        mine = {g: v for g, v in levels[k].items() if g[:-1] == gram[:-1]}
        total = sum(mine.values())
        if not total:
            return p(gram[1:])
        return max(mine.get(gram, 0) - discount[k], 0) / total + discount[k] * len(mine) / total * p(gram[1:])

    return p


def test_kneser_ney_equals_the_definition(spark):
    rng = random.Random(12)
    texts = {"aa": ["".join(rng.choice("abc ") for _ in range(40)).strip() for _ in range(6)], "bb": ["".join(rng.choice("bcde ") for _ in range(40)).strip() for _ in range(6)]}
    texts = {k: [" ".join(t.split()) for t in v] for k, v in texts.items()}
    rows = [(i, t, lang) for lang, v in texts.items() for i, t in enumerate(v)]
    model = language_id.LanguageId.fit(spark.createDataFrame([(100 * (lang == "bb") + i, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string"))
    chars = len(set("".join(t for _, t, _ in rows)))
    probe = ["abca bc", "dede cab", "xyz abc", "a"]
    bits, sizes = language_id.entropies(model.models, probe)
    assert sizes.tolist() == [len(t) for t in probe]
    for j, lang in enumerate(model.models.langs):
        p = plain_kneser_ney(texts[lang], chars)
        for i, t in enumerate(probe):
            padded = ["pad"] * 3 + list(t)
            want = -sum(math.log2(p(tuple(padded[n - 3 : n + 1]))) for n in range(3, len(padded))) / len(t)
            assert abs(bits[i, j] - want) < 1e-4


def test_language_id_odd_rows(spark):
    rows = [(i, "abcab cabac bacab", "aa") for i in range(30)] + [(50 + i, "fghfg hgfhf ghfgh", "bb") for i in range(30)] + [(1, "abcab", None), (1, "abcab", None), (None, "abc " * 50000, None)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, _text string, fold string")
    model = language_id.LanguageId.fit(frame)
    got = model.predict(frame, ["doc_id", "fold"]).collect()
    assert len(got) == len(rows) and {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 1 and r["lang_pred"] != "bb"} and all(r["fold"] == "y" for r in got)
    assert [r["lang_pred"] for r in got if r["doc_id"] is None] == ["aa"]
    same = [tuple(r) for r in got if r["doc_id"] == 1][1:]
    assert same[0] == same[1]


def test_texts_without_a_letter_are_und(spark):
    rows = [(i, "abcab cabac e\u0301cole", "aa") for i in range(30)]
    odd = ["\u2764\ufe0f", "\u0301", "12 \U0001f44d\ufe0f", "\u0301\u0302 \u0300", "007", "\u00b2\u00bd\u2167", "_", "!?", "", None, " \n", "\u0967\u0968", "\U0001f1e9\U0001f1ea"]
    letters = ["a", "e\u0301", "\u00aa", "1a", "\u4e2d", "\u0915\u094d", "\u2764\ufe0f b"]
    frame = spark.createDataFrame([*rows, *((100 + i, t, None) for i, t in enumerate(odd)), *((200 + i, t, None) for i, t in enumerate(letters))], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.LanguageId.fit(frame).predict(frame, ["doc_id"]).collect()}
    assert all((got[100 + i]["lang_pred"], got[100 + i]["score"], got[100 + i]["rejected"]) == ("und", 0.0, True) for i in range(len(odd)))
    assert all(got[200 + i]["lang_pred"] == "aa" for i in range(len(letters))) and all(got[i]["lang_pred"] == "aa" and not got[i]["rejected"] for i in range(30))


@pytest.mark.parametrize("pattern", [r"\S+ ?|\s+", r"[a-z]+ [a-z]+|.|\n", r"(?s).{1,3}"])
def test_bpe_of_other_patterns(spark, tokenizer, pattern):
    """Patterns whose words do not begin at spaces."""
    ranks = tokenizer.ranks
    rows = [(i, t) for i, t in enumerate(["one two  three four", "a b c d e f", " lead and trail ", "x\ny z\n", None, "", "the cat sat on the mat " * 50])]
    got = {r["doc_id"]: r["ids"] for r in bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern).encode(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    plain = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert got == {i: plain.encode_ordinary(t or "") for i, t in rows}


def test_bpe_searches_no_plain_or_known_part():
    """Parts that are words cost no search by the pattern; the others split as before."""
    find = regex.compile(public_tokenizers.PATTERN).findall
    parts, asked = {"the", "ma\u00f1ana", "end.", "x1", "'s", "it's", "\u4f60\u597d", "a\nb", "..."}, []

    def noted(text):
        asked.append(text)
        return find(text)

    assert bpe.words_of(parts, noted) == {w for x in parts for w in find(" " + x)}
    assert len(asked) == 1 and "the" not in asked[0].split(" ")
    asked.clear()
    ids = {w: w.encode() for x in parts for w in find(" " + x)}
    assert all(bpe.part_ids(x, ids, noted) == (" " + x).encode() for x in parts)
    assert {x[1:] for x in asked} == {"end.", "x1", "'s", "it's", "a\nb"}


def test_bpe_clashing_names_and_repeats(spark, tokenizer):
    frame = spark.createDataFrame([(1, "same text here", 7, "k")] * 3 + [(2, None, None, None)], "doc_id long, text string, ids int, _text string")
    got = tokenizer.encode(frame, ["doc_id", "ids", "_text"]).collect()
    assert [r.__fields__ for r in got][0] == ["doc_id", "ids", "_text", "_ids"]
    assert sorted((r["doc_id"], r["ids"], r["_text"], len(r["_ids"])) for r in got if r["doc_id"] == 1) == [(1, 7, "k", 3)] * 3 and [r["_ids"] for r in got if r["doc_id"] == 2] == [[]]


def test_media_key_names(spark):
    with pytest.raises(ValueError, match="rename"):
        media_chunks.store(docs(spark, [(1, "x")]).withColumnRenamed("ids", "n_bytes"), ["doc_id", "n_bytes"])


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><div id="cookie-notice">We use cookies</div><header><a href=/>Home</a></header>
<div class="nav menu"><ul><li><a href=a>One {i}</a><li><a href=b>Two</a></ul></div><aside class=sidebar>Side {i}</aside>
<{tag}><h1>Title {i}</h1><p>First &amp; <b>bold</b>
 text &eacute;&nbsp;{i}.<p>Second<br>line {i}<script>var x="</p>";</script><div class="ad-slot">Buy {i}</div>
<p>Follow the constant line</p><ul><li>item {i}<li>other {i}</ul><form><input value=q>Sign up {i}</form></{tag}>
<section id="comments"><article class="comment"><p>Reader says {i}</article></section><footer>&copy; {i}</footer></body></html>"""
TEXT = "Title {i}\nFirst & bold text é {i}.\nSecond line {i}\nitem {i}\nother {i}"


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_main_text(spark, tag):
    rows = [(i, f"https://h.example/{i}", PAGE.format(i=i, tag=tag)) for i in range(12)]
    rows += [(50, None, None), (51, "https://h.example/x", ""), (52, "https://one.example/", "<p>only <i>text</i> &lt;b&gt; 1 < 2"), (53, "https://cut.example/", "<article><p>whole</p><p>cut &am"), (None, "u", "<article>x</article>")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(frame).collect()}
    assert len(got) == len(rows)
    for i in range(12):  # the line that all pages share is template
        assert got[i] == TEXT.format(i=i)
    assert got[50] == "" and got[51] == "" and got[52] == "only text <b> 1 < 2" and got[53] == "whole\ncut &am" and got[None] == "x"


def extracted(spark, pages, host="h.example"):
    rows = [(i, f"https://{host}/{i}", p) for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extract.extract(frame).collect()}


def test_text_outside_article_stays(spark):
    menu = "<nav><a href=/>Home</a></nav>"
    links = "<div class=more>See <a href=/{i}>what we wrote {i}</a> before</div>"
    posts = [f"{menu}<div class=post-body><h1>Title {i}</h1><p>Body of page {i} in a div</div><article><p>Reader {i} likes it</article>" for i in range(8)]
    assert extracted(spark, posts) == {i: f"Title {i}\nBody of page {i} in a div\nReader {i} likes it" for i in range(8)}
    behind = [f"{menu}<article><h1>Title {i}</h1><p>A long first part of page {i} that is in the article</article><p>It runs on behind {i}{links.format(i=i)}" for i in range(8)]
    assert extracted(spark, behind) == {i: f"Title {i}\nA long first part of page {i} that is in the article\nIt runs on behind {i}" for i in range(8)}
    short = [f"{menu}<main><article><p>Short {i}</article><article><p>{f'a much longer article {i} ' * 9}</article><article><p>Brief {i}</article></main>" for i in range(3)]
    assert extracted(spark, short) == {i: f"Short {i}\n{f'a much longer article {i} ' * 9}".rstrip() + f"\nBrief {i}" for i in range(3)}


def rim_pages(n, rng):
    """Pages whose adverts, notices and bylines have neither telling names nor links, and
    the text that each should give."""
    say = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(k))
    out = []
    for i in range(n):
        title, body = say(4), [say(rng.randint(20, 60)) for _ in range(rng.randint(3, 6))]
        html = f"<html><body><div class=q7>{say(6)}</div><div><h1>{title}</h1></div><article>" + "".join(f"<p>{p}</p>" for p in body) + f"</article><section><div class=z>{say(5)}</div></section></body></html>"
        out.append((i, f"http://rim.example/{i}", html, "\n".join([title, *body])))
    # a page of the host without <article>, and one that is all rim
    words = [say(40), say(40)]
    out.append((n, f"http://rim.example/{n}", f"<html><body><div class=q7>{words[0]}</div><p>{words[1]}</p></body></html>", "\n".join(words)))
    return out


def test_small_slots_outside_the_text_go_without_a_name(spark):
    rows = rim_pages(30, random.Random(5))
    frame = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(frame).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_names_hardly_matter(spark, monkeypatch):
    """The wrapper finds what the lists of names do: without them few pages change."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    full = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    never = re.compile(r"(?!x)x")
    monkeypatch.setattr(html_extract, "BOILER", never)
    monkeypatch.setattr(html_extract, "SUSPECT", never)
    without = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert sum(full[k] != without[k] for k in full) < 0.05 * len(full) and all(full.values())


def test_roles_are_names(spark):
    """A role that says boilerplate drops an element, unless it is where the host has its text."""
    page = lambda i: f"<html><body><div role=search>find {i}</div><article><p>body {i} {'text ' * 30}</p></article><div role=contentinfo>legal {i}</div></body></html>"
    frame = spark.createDataFrame([(i, f"http://r.example/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")
    assert all(r["text"].startswith(f"body {r['page_id']}") and "find" not in r["text"] and "legal" not in r["text"] for r in html_extract.extract(frame).collect())


def test_copies_of_a_page_are_no_template(spark):
    page = lambda i: f"<nav>n</nav><h1>Title {i}</h1><p>First of {i}</p><p>Second of {i}</p>"
    text = lambda i: f"Title {i}\nFirst of {i}\nSecond of {i}"
    assert extracted(spark, [page(0)] * 9 + [page(1)]) == {**{i: text(0) for i in range(9)}, 9: text(1)}
    rows = [(i, None, f"<h1>Introduction</h1><p>Page {i} of some site</p>") for i in range(8)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Introduction\nPage {i} of some site" for i in range(8)}


def test_titles_as_ids_are_content(spark):
    menu = "<div class=related><p>Also read</p><a href=/{i}>Other page {i}</a></div><div id=search>Search this site</div>"
    body = '<h2 id="discussion">Discussion {i}</h2><section id="related-work"><p>Work {i}</section><h3 id="search-results">Results {i}</h3><div id="legal-history"><p>Law {i}, <span class="search">found {i}</span></div><div id="comments-on-ads">Remarks {i}</div><div class=ad>Buy {i}</div>'
    want = "Discussion {i}\nWork {i}\nResults {i}\nLaw {i}, found {i}\nRemarks {i}"
    got = extracted(spark, [menu.format(i=i) + "<article>" + body.format(i=i) + "</article>" for i in range(8)])
    assert got == {i: want.format(i=i) for i in range(8)}
    assert extracted(spark, ["<article>" + body.format(i=0) + "</article>"]) == {0: want.format(i=0)}


def test_deep_long_and_odd_pages(spark):
    deep = "<div>" * 50000 + "<p>at the bottom</p>" + "<div class=ad>buy</div>" + "</div>" * 50000
    pages = [deep, "<ul>" + "<li>x" * 20000 + "</ul>", "</div>" * 9000 + "<p>after stray ends", "<article>" + "<div class=ad><div>" * 400 + "buy" + "</div></div>" * 400 + "<p>kept</p></article>"]
    assert extracted(spark, pages) == {0: "at the bottom", 1: "\n".join(["x"] * 20000), 2: "after stray ends", 3: "kept"}
    none = spark.createDataFrame([], "page_id long, url string, html string, text string, host string, _rid int")
    assert html_extract.extract(none).isEmpty()
    rows = [(1, "https://h/", "<p>one <p>two", "x", "y", 3)] * 3 + [(None, None, None, None, None, None)]
    got = html_extract.extract(spark.createDataFrame(rows, none.schema)).collect()
    assert sorted(str(r["text"]) for r in got) == ["", "one\ntwo", "one\ntwo", "one\ntwo"]


def test_wrapper_decides(spark):
    """Without its wrapper a host's pages come out otherwise: boilerplate without a
    telling name is known by what the host's pages share."""
    page = "<div><p>Big Site, since 1999<p>Your daily read</div><div><h1>Title {i}</h1><p>Body {i} with <a href=x>a link</a> in its midst</div><div><a href=/{i}>More on {i}</a> <a href=/b{i}>Rest of {i}</a></div>"
    pages = [page.format(i=i) for i in range(8)]
    assert extracted(spark, pages) == {i: f"Title {i}\nBody {i} with a link in its midst" for i in range(8)}
    bare = html_extract.kept_blocks(html_extract.parse(pages[3]), {})
    assert bare == ["Big Site, since 1999", "Your daily read", "Title 3", "Body 3 with a link in its midst", "More on 3 Rest of 3"]
    # a name alone does not cut a slot that the wrapper knows as content
    tree = html_extract.parse("<body><div class=footer><p>text</p></div>")
    seed, _ = html_extract.numbered(html_extract.skeleton([html_extract.parse("<body><div class=footer><p>other</p></div>")]))
    assert html_extract.kept_blocks(tree, {}) == []
    html_extract.align([tree], seed, {})
    assert html_extract.kept_blocks(tree, {}) == ["text"] and html_extract.kept_blocks(tree, {"agreed": [2]}) == []


def test_seed_grows_over_pages():
    one, two = "<body><div class=a><p>x</div><div class=c>y</div>", "<body><div class=a><p>x</div><div class=b><ul><li>z</ul></div><div class=c>y</div><div class=d>w</div>"
    tree = html_extract.grown(html_extract.skeleton([html_extract.parse(one)]), html_extract.parse(two))
    assert tree == html_extract.skeleton([html_extract.parse(two)])
    assert html_extract.grown(tree, html_extract.parse(one)) == tree


def test_tree_matching_pairs_like_nodes():
    tree = html_extract.parse("<body><div class=a><p>x</div><div class=b><p>y</div></body>")
    seed, _ = html_extract.numbered(html_extract.skeleton([tree]))
    other = html_extract.parse("<body><div class=b><p>z</div><div class=c>w</div></body>")
    html_extract.align([other], seed, {})
    slots = {n.text: s for n, s in html_extract.leaves(other)}
    same = {n.text: s for n, s in html_extract.leaves(html_extract._with_seed(html_extract.parse("<body><div class=a><p>x</div><div class=b><p>y</div></body>"), __import__("json").dumps(seed)))}
    assert slots["z"] == same["y"] and slots["z"] != same["x"]


def test_halved_alignment_is_as_heavy(monkeypatch):
    rng = random.Random(11)
    page = lambda: "<body>" + "".join(f"<div class={rng.choice('abcd')}><p>x</p></div>" for _ in range(rng.randint(1, 25)))
    for _ in range(40):
        seed, _ = html_extract.numbered(html_extract.skeleton([html_extract.parse(page())]))
        html, paired = page(), []
        for cells in (10**6, 4):
            monkeypatch.setattr(html_extract, "DP_CELLS", cells)
            tree = html_extract.parse(html)
            html_extract.align([tree], seed, {})
            body = tree.children[0]
            paired.append(sum(r[0].seed is not None for r in html_extract.runs(body.children)))
        assert paired[0] == paired[1]

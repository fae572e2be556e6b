import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from scoremap.llm.bpe import read_ranks

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, counts = docs, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    from scoremap.llm.common import materialize

    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, seen, SF), name)
        if name != "bpe":
            assert out.columns == docs.columns
            assert out.join(docs, "doc_id", "left_anti").isEmpty()
        if name in ("exact_dedup", "near_dedup"):
            assert out.count() < counts[-1] and out.groupBy("doc_id").count().where("count > 1").isEmpty()
        seen = out
        counts.append(out.count())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in seen.collect():
        assert r["ids"] == plain.encode_ordinary(text[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert counts[4] == counts[5] and counts[1] >= 0.98 * counts[0]

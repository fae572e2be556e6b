"""From raw documents to token ids: five stages, each a Spark job of its own.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All stages but the last keep
the columns of ``documents``, and further ones whatever they are called. An empty table
gives an empty result; texts of any length are read whole; repeated rows are told apart
by their place in the files.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremap.llm import bagminhash, exact_dedup, mixing
from scoremap.llm.bpe import Tokenizer, ids_text
from scoremap.llm.common import materialize, row_id, table, without_rows
from scoremap.llm.language_id import LanguageId

#: The pipeline mixes to the tokens that are left, so sources repeat at most so often.
MAX_REPEATS = 2.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), and those that no language
    model explains, go."""
    model = LanguageId.fit(docs)
    rejected = model.predict(row_id(docs), ["_rid"]).where("rejected").select("_rid")
    return without_rows(docs, materialize(rejected, "rejected"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays, null ids last; of repeated rows one."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays; texts without words are
    one group."""
    return bagminhash.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as its source's weight asks for; null is a source,
    and documents without tokens stand once."""
    return mixing.mixed_rows(docs, max_repeats=MAX_REPEATS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to;
    null and empty texts have no ids."""
    bpe = Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.col("ids")
    return bpe.encode(docs, ["doc_id", "source"]).select(
        "doc_id", "source", ids, F.size(ids).cast("long").alias("n_tokens"), F.sha2(ids_text(ids), 256).alias("ids_sha256"), F.sha2(bpe.decode(ids), 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("bpe", encode),
]

#: Language models, near-duplicate classes and merges have no SQL form; tests compare
#: the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

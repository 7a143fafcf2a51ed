"""A corpus pipeline over ``documents``: toxicity, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written
from tessera.llm.maxplus import encode
from tessera.llm.mixing import apply_mix
from tessera.llm.partenum import ngram_join
from tessera.llm.pii import mask_pii
from tessera.llm.toxicity import drop_toxic


#: So many ids (8 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a model learned from the training labels predicts toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one of smallest id (five-word shingles, similarity 0.8)."""
    groups = ngram_join(docs, share=Fraction(8, 10), words=5)
    lost = written(groups.where("component_id < doc_id").select("doc_id").distinct())
    if lost.count() <= BROADCAST_IDS:
        lost = F.broadcast(lost)
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the personal data of every document; all documents stay."""
    return mask_pii(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks (0 to 3 times)."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids): the ids of each text, little-endian 32-bit integers in binary."""
    import public_tokenizers

    found = encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The toxicity and token stages have no SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs

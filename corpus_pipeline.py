"""A corpus pipeline of five stages over ``documents``: quality, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame, which ``run`` writes to the shared folder and rereads for the next stage. All but the last
return the columns of documents. Nulls, empty texts, repeated rows and empty tables have the results
that the operators' modules state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, mixing, pii, quality, simhash
from veilframe.llm.shared import discard, discard_since, mark, table, written

TOKENIZER = "byte_bpe_50k.tiktoken"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; the others go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "_score").where(F.col("_score") >= quality.ACCEPT).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return simhash.representatives(docs, width=5, radius=simhash.RADIUS, similarity=0.8)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a token for each span of personal data; n_chars follows the text."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: number and digest of its ids, and the digest of the bytes decoded from them."""
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", without_near_duplicates),
    ("pii", without_personal_data),
    ("source_mix", mixed_sources),
    ("byte_bpe", tokenized),
]

#: A trained classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``. A stage's own tables and its input go when its output is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = mark(spark)
        out = written(stage(spark, docs, sf_dir), name)
        discard_since(spark, place, out)
        discard(docs)
        docs = out
    return docs

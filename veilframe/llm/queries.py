"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import ann, bpe, exact, filters, fim, lengths, licenses, media, mixing, pii, quality, simhash, urlfilter
from veilframe.llm.shared import table, written

TOKENIZER = "byte_bpe_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_vantage_point_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, factor=ann.FACTOR)


@query
def op2_url_link_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"), urlfilter.RULES)


ORACLES["op2_url_link_filter"] = urlfilter.oracle()


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample=quality.SAMPLE)


@query
def op4_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(table(spark, sf_dir, "documents"))


@query
def op5_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    counted = bpe.count(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN).select("n_tokens")
    return lengths.suffix_sums(written(lengths.histogram(counted), "lengths"))  # the texts are encoded once


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLES["op7_source_mix"] = mixing.ORACLE


@query
def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), support=pii.SUPPORT, confident=pii.CONFIDENT)


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


@query
def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


ORACLES["op10_license_digests"] = licenses.oracle()


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


ORACLES["op11_fill_in_middle"] = fim.ORACLE


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = filters.ORACLE


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", found["digest"].alias("text_sha256"))


ORACLES["op13_exact_dedup"] = exact.ORACLE

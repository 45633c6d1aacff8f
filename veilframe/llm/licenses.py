"""Licence scans by canonical digest.

A text is brought to a canonical form: lower case, without copyright lines, with one spelling for
equivalent words, every run of other characters than letters and digits a single space. The SHA-256
of that form is joined to the digests of known licences, for whole texts and, so that notices inside
other prose are seen too, for every whole line. No text is compared with another.

Null texts count as empty; the digest of a text that is empty, or empty in canonical form, is that of
the empty string and never a licence. Repeated rows get equal results. Extra columns are not read.
Of several known texts with one digest the first by name counts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.license_texts import DIGESTS, KNOWN

#: Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = (("licence", "license"), ("licensee", "license holder"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("https://", "http://"), ("acknowledgement", "acknowledgment"), ("whilst", "while"), ("organisation", "organization"), ("version 2.0", "version 2"), ("version 3.0", "version 3"))
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, " ")
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(known_digest, license) of (name, text) pairs and of (name, digest) pairs, both parameter lists."""
    rows = spark.createDataFrame([*known], "license string, text string").select("license", canonical(F.col("text")).alias("form")).where("form <> ''").select(F.sha2("form", 256).alias("known_digest"), "license")
    more = spark.createDataFrame([*digests], "license string, known_digest string").select("known_digest", "license")
    return rows.union(more).groupBy("known_digest").agg(F.min("license").alias("license"))


def digests_of(files: DataFrame) -> DataFrame:
    """(license, known_digest) of licence files, read with ``wholetext`` (value): named by their files, without the suffix."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.txt)?$", 1)
    return files.select(name.alias("license"), digest(F.col("value")).alias("known_digest"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license, notices): per document its digest, the licence that its whole text is (else null),
    and the licences that single lines of it are, sorted and joined by commas (else an empty string).

    ``known`` is a parameter list and small, and broadcast. Every different line of a text is digested where the text
    is read; only those that are known leave the task.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = texts.select("doc_id", "text", digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("_text"))
    lines = marked.select("_text", F.explode(F.array_distinct(F.split("text", r"\n", -1))).alias("line")).where("line <> ''")
    found = lines.select("_text", digest(F.col("line")).alias("d")).join(F.broadcast(known.toDF("d", "notice")), "d")
    notices = found.groupBy("_text").agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices")).withColumnRenamed("_text", "_key")
    whole = marked.drop("text").join(F.broadcast(known), marked["digest"] == known["known_digest"], "left")
    out = whole.join(notices, F.col("_text") == F.col("_key"), "left")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle(known: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, str]] = DIGESTS) -> str:
    """DuckDB SQL for ``scan`` over documents."""

    def form(x: str) -> str:
        x = f"regexp_replace(lower({x}), {_quoted(COPYRIGHT)}, ' ', 'g')"
        for other, one in SPELLINGS:
            x = f"replace({x}, {_quoted(other)}, {_quoted(one)})"
        return f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    values = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in known)
    more = "".join(f" UNION ALL SELECT {_quoted(d)}, {_quoted(n)}" for n, d in digests)
    return f"""
WITH known AS (SELECT d, min(n) AS license FROM (SELECT sha256(f) AS d, n FROM (SELECT n, {form("t")} AS f FROM (VALUES {values}) v(n, t)) WHERE f <> ''{more}) GROUP BY d),
docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs),
notices AS (SELECT k, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT k, sha256({form("line")}) AS d FROM lines WHERE line <> '') JOIN known USING (d) GROUP BY k)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices
FROM (SELECT k, doc_id, sha256({form("text")}) AS digest FROM docs) t LEFT JOIN known ON digest = known.d LEFT JOIN notices USING (k)
"""

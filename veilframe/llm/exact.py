"""Exact duplicates, combined in stages that survive a group of any size.

Each row's text gets a digest; (doc_id, digest) is written once, and a count by digest shows which digests repeat and
which are hot (more than one row in ``HOT`` of the table: fewer than ``HOT`` digests, whatever the input). Only texts
whose digest repeats are compared, by their full content in each of three stages: a task merges its own equal texts
before the shuffle, the tasks' rows of a hot digest meet under a salt, and the winners of the salts are combined. Cold
digests need no salt, and their texts cross the network once, the hot ones' once more for each salt. Rows find their
group by the digest: a hot one by a broadcast of fewer than ``HOT`` rows, the rest by a join in which no key holds more
than one row in ``HOT``. A digest that different texts share is told apart by the text again.

Null texts count as empty, and empty ones are equal like others. Texts are compared as they are. Of equal texts the row
with the largest (or smallest) id stays; null ids are below all others and stay only where all ids of the group are
null. Rows that repeat the id that stays all count as kept here; ``deduplicated`` leaves one of them. An empty table has
no groups. Only the id and text columns and those of ``carry`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import discard, written

#: A digest with more than one row in so many is salted; its texts meet in so many tasks first.
HOT, SALTS = 1000, 64
#: Repeated digests up to which (some 100 bytes each) they are broadcast, so that other texts are not shuffled.
BROADCAST_ROWS = 200_000

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def winners(texts: DataFrame, hot: DataFrame, stays: str = "largest") -> DataFrame:
    """(digest, keep_id, group_size) of each different text of ``texts`` (doc_id, digest, text); ``hot``: the digests to salt, a few."""
    best = F.max if stays == "largest" else F.min
    marked = texts.join(F.broadcast(hot.select("digest", F.lit(True).alias("hot"))), "digest", "left")
    salted = marked.select("doc_id", "digest", "text", "hot", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).alias("salt"))
    merged = salted.groupBy("digest", "hot", "salt", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # a cold text is whole by now: it needs no text to stay apart from others
    left = merged.select("digest", F.when(F.col("hot"), F.col("text")).alias("text"), F.when(F.col("hot").isNull(), F.monotonically_increasing_id()).alias("own"), "keep_id", "group_size")
    return left.groupBy("digest", "own", "text").agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).select("digest", "keep_id", "group_size")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stays: str = "largest", carry: Sequence[Column] = (), digest: Digest = sha256) -> DataFrame:
    """(doc_id, *carry, digest, keep_id, group_size, kept) for every row: the row that stays for its text, and how many have it.

    ``carry``: columns of ``docs``, by names other than these. ``digest``: of a text; a weak one costs time, not correctness.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *carry, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    marked = written(rows.drop("text"), "marked")
    repeated = written(marked.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    total = marked.count()
    hot = repeated.where(F.col("n") > total / HOT)
    texts = rows.select("doc_id", "digest", "text")
    if _few(repeated):
        texts = texts.join(F.broadcast(repeated.select("digest")), "digest", "left_semi")
    found = written(winners(texts, hot, stays).where("group_size > 1"), "winners")
    shared = written(winners_apart(found, repeated), "shared")
    discard(repeated)

    large = F.col("group_size") > total / HOT
    out = _placed(marked, found.where(large), found.where(~large))
    if shared.limit(1).count():
        again = rows.join(shared, "digest", "left_semi")
        best = F.max if stays == "largest" else F.min
        own = again.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.join(shared, "digest", "left_anti").unionByName(again.join(own, ["digest", "text"]).drop("text"))
    names = [c for c in marked.columns if c != "digest"]
    return out.select(*names, "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def winners_apart(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """Digests that more than one text has: their largest group is smaller than their number of rows."""
    most = found.groupBy("digest").agg(F.max("group_size").alias("most"))
    return repeated.join(most, "digest", "left").where("most is null or most < n").select("digest")


def _placed(marked: DataFrame, large: DataFrame, others: DataFrame) -> DataFrame:
    """``marked`` with its group: ``large`` (a few rows) by broadcast, ``others`` by a join, else the row itself."""
    first = marked.join(F.broadcast(large.select("digest", F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))), "digest", "left")
    rest = first.where("_size is null").drop("_keep", "_size").join(others, "digest", "left")
    alone = F.col("group_size").isNull()
    rest = rest.withColumns({"keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return first.where("_size is not null").withColumnsRenamed({"_keep": "keep_id", "_size": "group_size"}).unionByName(rest)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stays: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each different text."""
    stay = groups(docs, doc_id, text, stays).where("kept").groupBy(F.col("keep_id").alias("_keep"), F.col("digest").alias("_digest")).agg(F.count(F.lit(1)).alias("_rows"))
    stay = written(stay, "stay")
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_keep")) & (sha256(F.coalesce(F.col(text), F.lit(""))) == F.col("_digest"))
    once = docs.join(stay.where("_rows = 1"), same, "left_semi")
    often = docs.join(stay.where("_rows > 1").select("_keep", "_digest"), same)
    return once.unionByName(often.dropDuplicates(["_keep", "_digest"]).drop("_keep", "_digest"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

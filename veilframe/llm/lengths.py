"""Exact histogram of encoded lengths, and what its sums answer for every context limit.

Documents are counted per encoded length (partial sums before the shuffle); suffix sums over the
distinct lengths then answer totals, quantiles and truncated totals for any limit without another
pass over the texts. The sums run in two levels, inside blocks of BLOCK lengths and over the
blocks, so that no task holds more than one block's lengths or one row per block.

Null and empty texts have length 0. An empty table gives an empty histogram. Repeated rows count
each time. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of one block of the two-level suffix sum.
BLOCK = 4096


def histogram(counted: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """(length, docs, tokens): one row per distinct length."""
    length = F.coalesce(F.col(n_tokens).cast("long"), F.lit(0)).alias("length")
    return counted.select(length).groupBy("length").agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("tokens"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds, for each length taken as a context limit: documents and tokens of that length or more
    (docs_from, tokens_from), all documents and tokens, and the tokens left if every document is cut
    at that length (truncated_tokens)."""
    block = F.floor(F.col("length") / BLOCK)
    rows = hist.withColumn("_block", block)
    blocks = rows.groupBy("_block").agg(F.sum("docs").alias("_docs"), F.sum("tokens").alias("_tokens"))
    later = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_docs").over(later), zero).alias("_docs_later"),
        F.coalesce(F.sum("_tokens").over(later), zero).alias("_tokens_later"),
        F.sum("_docs").over(whole).alias("all_docs"),
        F.sum("_tokens").over(whole).alias("all_tokens"),
    )
    own = Window.partitionBy("_block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", F.sum("docs").over(own).alias("_d"), F.sum("tokens").over(own).alias("_t"))
    out = summed.join(blocks, "_block").select(
        "length",
        "docs",
        "tokens",
        (F.col("_d") + F.col("_docs_later")).alias("docs_from"),
        (F.col("_t") + F.col("_tokens_later")).alias("tokens_from"),
        "all_docs",
        "all_tokens",
    )
    kept = F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")
    return out.withColumn("truncated_tokens", kept)


def at_limits(sums: DataFrame, limits: DataFrame, limit: str = "limit") -> DataFrame:
    """For each row of ``limits`` (a small table): documents longer than the limit, and the tokens left
    if every document is cut at it. A limit above every length leaves all tokens; a null limit gives nulls.
    The few limits are broadcast by Spark if it finds them small; each meets one row, the shortest length above it."""
    asked = limits.select(F.col(limit).cast("long").alias("limit")).distinct()
    above = asked.join(sums, sums["length"] > asked["limit"], "left").groupBy("limit").agg(
        F.min_by(F.struct("docs_from", "tokens_from"), "length").alias("_next")
    )
    totals = sums.agg(F.max("all_tokens").alias("all_tokens"))
    over = F.coalesce(F.col("_next.docs_from"), F.lit(0).cast("long"))
    cut = F.coalesce(F.col("all_tokens"), F.lit(0).cast("long")) - F.coalesce(F.col("_next.tokens_from"), F.lit(0).cast("long")) + F.col("limit") * over
    known = F.col("limit").isNotNull()
    return above.crossJoin(F.broadcast(totals)).select("limit", F.when(known, over).alias("docs_over"), F.when(known, cut).alias("truncated_tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length at or below which at least the share ``q`` of all documents lies; null if there are none."""
    upto = F.col("all_docs") - F.col("docs_from") + F.col("docs")
    return sums.where(upto >= F.ceil(F.lit(q) * F.col("all_docs"))).agg(F.min("length").alias("length"))

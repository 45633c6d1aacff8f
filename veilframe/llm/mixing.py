"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

A budget is shared among the sources by weight; no source gets more than ``most`` times its size, and
what it can't take is shared again among the rest by weight. A source's target is met by complete
epochs first, in which every document counts once, then by a fraction: its documents are ordered by
exponential keys, -ln(u) / quality with u a hash of the document's id and size, and taken in that
order up to the budget that is left. The last one is taken in part, so the words taken meet the
target to less than a word. A key that is k times likelier to be small belongs to a document with k
times the quality.

The order within a source is found in two levels: its keys are cut into about sqrt(documents) ranges,
sums of ranges are added up first and the documents inside a range after that. A key's range is the share
of the source's documents that are expected below it, which the source's histogram of weights tells:
a document of weight w has a key below x with probability 1 - exp(-w x). So the ranges are about even
whatever the weights, and no task sorts a whole source, however large its share of the rows.

Sizes are counts of `[^\\x20\\x09-\\x0D]+` (null or empty: 0). Sources come by code point, null last as a
source of its own, the empty string first. The weights repeat over them in that order. Documents of
size 0 are kept with nothing taken. Repeated rows are separate documents with equal keys; ties are
ordered by id, then size, and equal rows may change places, which changes no set of results. Null
qualities, or ones not above 0, count as ``least_quality``. Extra columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.shared import written

#: Shares of the sources in turn, the budget over all sizes, and the most of a source's size.
WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2.0
LEAST_QUALITY = 0.05
#: Classes of the histogram of weights: so many to each doubling, and the least and largest class.
CLASSES, LEAST_CLASS, MOST_CLASS = 2, -60, 60
#: Sources up to which their targets are broadcast: some MB.
BROADCAST_ROWS = 100_000


def words(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def prose_quality(size: Column, chars: Column) -> Column:
    """A cheap weight in (0, 1]: 1 where words have five to six characters on average, less the further from it."""
    mean = chars / F.greatest(size, F.lit(1))
    return F.lit(1.0) / (F.lit(1.0) + F.abs(mean - F.lit(6.0)) / F.lit(6.0))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the MD5 digest of ``parts``: the same on every run and in any SQL engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, docs, source_size, target) from (source, docs, source_size), one row per source.

    The level that the resharing ends at: with sources ordered by limit/weight, the first n are at
    their limits, where n is the least for which the rest, sharing what is left by weight, stay
    within theirs. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(most)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    ahead, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole) * F.lit(budget) - F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0))
    behind = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(ahead), F.lit(0.0))
    rows = rows.withColumn("_level", left / behind)
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(whole)["_level"]
    share = F.least(F.col("_cap"), F.coalesce(F.col("_w") * level, F.col("_cap")))
    return rows.select("source", "docs", "source_size", share.alias("target"))


def expected_below(key: Column, levels: Column) -> Column:
    """How many documents of a source are expected to have a smaller key, by its histogram of weights (w, docs)."""
    return F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + x["docs"] * (F.lit(1.0) - F.exp(-x["w"] * key)))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 7, quality: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) and the columns ``keep``: the words that the mix takes of each row.

    ``quality``: a column of document weights; without one, ``prose_quality`` weighs the texts.
    """
    size = words("text")
    rows = docs.select("doc_id", "source", size.alias("size"), (F.col(quality).cast("double") if quality else prose_quality(size, F.coalesce(F.length("text"), F.lit(0)))).alias("_q"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    weight = F.when(F.col("_q") > 0, F.col("_q")).otherwise(F.lit(LEAST_QUALITY))
    rows = rows.withColumn("_weight", weight).withColumn("_key", -F.log(uniform(seed, F.col("doc_id"), F.col("size"))) / F.col("_weight"))
    rows = written(rows, "sizes")  # the texts are read once
    level = F.greatest(F.lit(LEAST_CLASS), F.least(F.lit(MOST_CLASS), F.floor(F.log2("_weight") * CLASSES)))
    levels = rows.groupBy("source", level.alias("_level")).agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("size"), F.avg("_weight").alias("w"))
    sources = levels.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("size").alias("source_size"), F.collect_list(F.struct("w", "docs")).alias("_levels"))
    sources = written(sources, "sources")  # a source has 121 classes at most
    shares = targets(sources.drop("_levels"), weights, budget, most).withColumnRenamed("source", "_source")
    shares = written(shares.join(sources.select("source", "_levels"), F.col("_source").eqNullSafe(F.col("source"))).drop("source").withColumn("_sid", F.monotonically_increasing_id()), "targets")
    if shares.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        shares = F.broadcast(shares)  # a checked size; more sources are joined by a shuffle, which AQE splits at hot ones
    parts = F.ceil(F.sqrt("docs")).cast("long")
    spread = F.floor(expected_below(F.col("_key"), F.col("_levels")) / F.col("docs") * parts).cast("long")  # rises with the key
    placed = rows.join(shares, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_range", spread).drop("_levels")
    # sources by their number, which is never null: the window's partitioning serves the join too, and rows are shuffled once
    ranges = placed.groupBy("_sid", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_sid").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_sid", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_sid", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    joined = summed.join(ranges, ["_sid", "_range"])
    goal = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = goal - epochs * F.col("source_size") - F.col("_before") - F.col("_own")
    fraction = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return joined.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + fraction).alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in whole texts: a part of half a text or more counts as one.

    Rows of size 0 have no words to take and are left out.
    """
    names = docs.columns
    own = [c for c in names if c != "doc_id"]
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = mix(docs, keep=own, **options).where("size > 0").withColumn("_times", times).where("_times > 0")
    return taken.select(*names, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select(*names)


#: DuckDB SQL for ``mix(documents)`` with the parameters above.
ORACLE = """
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, coalesce(length(text), 0) AS chars FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '-') || '|' || size::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / (1.0 / (1.0 + abs(chars::DOUBLE / greatest(size, 1) - 6.0) / 6.0)) AS key FROM rows),
sized AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM rows GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM sized),
levels AS (
  SELECT *, cap / w AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
shares AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio), cap)) AS target FROM levels),
ordered AS (
  SELECT k.*, s.source_size, s.target, floor(s.target + 0.5)::BIGINT AS goal,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN shares s ON k.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * size
   + greatest(0, least(size, goal - CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM ordered
"""

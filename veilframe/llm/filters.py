"""Interaction audit of filters: what each removes in every order of application.

Each document gets a mask of the filters that it fails. Documents are counted by part, mask and labels, so at most 128
cells a part are left, whatever the input. Each cell then folds across the array of orders, which the plan carries as a
literal: ``transform`` over the orders, ``aggregate`` over the letters of one, giving a struct for each order and step
(600 with five filters), weighted by the cell's count. The arrays are merged by sums at each position, and the
Shapley sums add a filter's removals over all orders.

Identical texts are those of ``exact.groups`` (skew-safe, full content): a row fails that filter if a smaller id has
its text. Null texts are empty; an empty text fails A only, and E where it repeats. A null id is never larger than
another, and has no label. Repeated rows count as often as they occur. A document with several labels is good or toxic
if any of them says so. A null part is the empty one. No documents, no rows. Only the columns named are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm import exact

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = r"[#$%&*|]"
_SEEN = "struct<gone:boolean,out:array<struct<kept:long,removed:long,redundant:long,unique_fails:long,good_lost:long,toxic_lost:long>>>"


def failures(text: Column) -> dict[str, Column]:
    """The conditions of a text alone, by filter."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail exactly the filters of ``mask`` (bit 0 is A)."""
    own = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures(F.coalesce(F.col(text), F.lit(""))).values())), F.lit(0))
    marked = exact.groups(docs, doc_id, text, stays="smallest", carry=[F.coalesce(F.col(part), F.lit("")).alias("part"), own.alias("own")])
    mask = F.col("own") + F.when(F.col("doc_id") > F.col("keep_id"), 16).otherwise(0)
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    seen = marked.select("doc_id", "part", mask.alias("mask")).join(said, "doc_id", "left")
    return seen.groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


def _folded(orders: Column) -> Column:
    """For each order and step in turn, what a cell (mask, good, toxic, n) adds there."""
    n, mask = F.col("n"), F.col("mask")

    def step(acc, bit):
        fails, gone = mask.bitwiseAND(bit) != 0, acc["gone"]
        here = fails & ~gone
        count = lambda c: F.when(c, n).otherwise(F.lit(0).cast("long"))
        made = F.struct(
            count(~(gone | fails)).alias("kept"),
            count(here).alias("removed"),
            count(fails & gone).alias("redundant"),
            count(mask == bit).alias("unique_fails"),
            count(here & (F.col("good") == 1)).alias("good_lost"),
            count(here & (F.col("toxic") == 1)).alias("toxic_lost"),
        )
        return F.struct((gone | fails).alias("gone"), F.concat(acc["out"], F.array(made)).alias("out"))

    start = F.struct(F.lit(False).alias("gone"), F.array().alias("out")).cast(_SEEN)
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda acc: acc["out"])))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step."""
    named = ["".join(p) for p in permutations(FILTERS)]
    orders = F.array(*[F.array(*[F.lit(1 << FILTERS.index(x)) for x in p]) for p in named])
    spread = cells(docs, labels, doc_id, text, part).select("part", F.posexplode(_folded(orders)).alias("at", "x"))
    sums = [F.sum(f"x.{c}").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")]
    merged = spread.groupBy("part", "at").agg(*sums)
    width = len(FILTERS)
    order = F.element_at(F.array(*map(F.lit, named)), F.floor(F.col("at") / width).cast("int") + 1)
    rows = merged.select("part", order.alias("filter_order"), (F.col("at") % width + 1).cast("int").alias("step"), *[c for c in merged.columns if c not in ("part", "at")])
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    shares = rows.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    return rows.withColumn("letter", letter).join(shares, ["part", "letter"]).drop("letter")


ORACLE = """
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS again FROM documents),
marked AS (
  SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(again, false)::INT AS mask FROM words),
said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM marked LEFT JOIN said USING (doc_id) GROUP BY ALL),
filters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT p.f || q.f || r.f || s.f || u.f AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits FROM filters p, filters q, filters r, filters s, filters u
  WHERE len(list_distinct([p.b, q.b, r.b, s.b, u.b])) = 5),
steps AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS f, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, unnest(range(1, 6)) AS x(step)),
totals AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (before + b) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & b > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & b > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = b THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & b > 0 AND mask & before = 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & b > 0 AND mask & before = 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM totals
"""

"""Queries that score detections against labels, both from the keys of ``part``: per category, by area, by pixels, for baselines and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators import score
from veilframe.plans.boxes import _BOXES_SQL, _INTER, _boxes
from veilframe.plans.folds import matched_sql
from veilframe.plans.registry import query
from veilframe.tables import table

_SIDES = f"(SELECT k, page_id, w * h::DOUBLE AS area, k % 3 = 0 AS hit, k % 4 < 2 AS flag, CASE WHEN k % 2 = 0 THEN 'name' ELSE 'email' END AS truth, CASE WHEN k % 5 < 2 THEN 'name' ELSE 'email' END AS claim, k % 2 = 0 AS image FROM {_BOXES_SQL})"


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("ord")
    boxes = _boxes(spark, sf_dir)
    truth = boxes.where(k % 3 == 0).withColumn("category", F.when(k % 2 == 0, "name").otherwise("email"))
    found = boxes.where(k % 4 < 2).withColumn("category", F.when(k % 5 < 2, "name").otherwise("email"))
    return boxes, truth, found


@query(f"""
SELECT category, expected, tp AS true_positives, fp AS false_positives, CASE WHEN expected > 0 THEN tp / expected ELSE 1 END::DOUBLE AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END::DOUBLE AS "precision" FROM (
  SELECT category, count(*) FILTER (hit AND truth = category) AS expected, count(*) FILTER (hit AND truth = category AND flag) AS tp, count(*) FILTER (NOT hit AND flag AND claim = category) AS fp FROM {_SIDES}, (VALUES ('name'), ('email')) c(category) GROUP BY category)
""")
def score_by_category(spark, sf_dir):
    _, truth, found = _sides(spark, sf_dir)
    return score.by_category(score.compared(truth, found))


@query(f"""
SELECT *, CASE WHEN needed > 0 THEN correct / needed ELSE 1 END::DOUBLE AS coverage, CASE WHEN painted > 0 THEN correct / painted ELSE 1 END::DOUBLE AS redaction_precision, CASE WHEN needed > 0 THEN painted / needed ELSE 0 END::DOUBLE AS area_ratio FROM (
  SELECT page_id, coalesce(sum(area) FILTER (hit), 0)::DOUBLE AS needed, coalesce(sum(area) FILTER (flag), 0)::DOUBLE AS painted, coalesce(sum(area) FILTER (hit AND flag), 0)::DOUBLE AS correct FROM {_SIDES} WHERE hit OR flag GROUP BY page_id)
""")
def area_scores(spark, sf_dir):
    return score.area_scores(*_sides(spark, sf_dir))


@query(f"""
SELECT page_id, coalesce(string_agg('e' || k, ',' ORDER BY 'e' || k) FILTER (hit AND NOT flag), '') AS missed, coalesce(string_agg('e' || k, ',' ORDER BY 'e' || k) FILTER (flag AND NOT hit), '') AS over_flagged FROM {_SIDES} WHERE hit OR flag GROUP BY page_id
""")
def score_misses(spark, sf_dir):
    _, truth, found = _sides(spark, sf_dir)
    return score.misses(truth, found)


_IOU = f"({_INTER})::DOUBLE / (a.w * a.h + b.w * b.h - {_INTER})"


@query(f"""
WITH t AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'name' ELSE 'email' END AS truth, CASE WHEN k % 5 < 2 THEN 'name' ELSE 'email' END AS claim FROM {_BOXES_SQL}),
m AS ({matched_sql(f"SELECT a.page_id AS page_id, a.k AS a, b.k AS b, {_IOU} AS weight, ({_INTER})::DOUBLE AS shared, a.truth = b.claim AS same FROM t a JOIN t b ON a.page_id = b.page_id AND a.k % 3 = 0 AND b.k % 4 < 2 WHERE {_IOU} >= 0.5")}),
g AS (SELECT page_id, count(*) AS tp, sum(shared) AS correct, count(*) FILTER (same) AS same FROM m GROUP BY page_id),
s AS (SELECT page_id, count(*) FILTER (k % 3 = 0) AS expected, count(*) FILTER (k % 4 < 2) AS detected, coalesce(sum(w * h) FILTER (k % 3 = 0), 0)::DOUBLE AS needed, coalesce(sum(w * h) FILTER (k % 4 < 2), 0)::DOUBLE AS painted FROM t WHERE k % 3 = 0 OR k % 4 < 2 GROUP BY page_id)
SELECT page_id, expected, detected, coalesce(tp, 0) AS true_positives, coalesce(same, 0) AS right_category, needed, painted, coalesce(correct, 0)::DOUBLE AS correct,
  CASE WHEN expected > 0 THEN coalesce(tp, 0) / expected ELSE 1 END::DOUBLE AS recall, CASE WHEN detected > 0 THEN coalesce(tp, 0) / detected ELSE 1 END::DOUBLE AS "precision",
  CASE WHEN needed > 0 THEN coalesce(correct, 0) / needed ELSE 1 END::DOUBLE AS coverage, CASE WHEN painted > 0 THEN coalesce(correct, 0) / painted ELSE 1 END::DOUBLE AS redaction_precision FROM s LEFT JOIN g USING (page_id)
""")
def pixel_scores(spark, sf_dir):
    _, truth, found = _sides(spark, sf_dir)
    cut = ("page_id", "ord", "category", "position")
    return score.pixel_scores(truth.select(*cut), found.select(*cut))


@query(f"""
WITH e AS (SELECT *, CASE WHEN k % 6 = 0 THEN '' WHEN k % 7 = 0 THEN NULL ELSE 'v' END AS v FROM {_SIDES}),
s AS (SELECT hit, unnest(['none', 'blanket', 'all_inputs', 'all_values', 'detector']) AS strategy, unnest([false, true, k % 2 = 1, coalesce(v <> '', false), flag]) AS hidden FROM e)
SELECT strategy, CASE WHEN count_if(hit) > 0 THEN count_if(hit AND hidden) / count_if(hit) ELSE 1 END::DOUBLE AS recall, CASE WHEN count_if(hidden) > 0 THEN count_if(hit AND hidden) / count_if(hidden) ELSE 1 END::DOUBLE AS "precision",
  CASE WHEN count_if(NOT hit) > 0 THEN count_if(NOT hit AND NOT hidden) / count_if(NOT hit) ELSE 1 END::DOUBLE AS context_kept FROM s GROUP BY strategy
""")
def score_baselines(spark, sf_dir):
    boxes, truth, found = _sides(spark, sf_dir)
    k = F.col("ord")
    elements = boxes.withColumns({"element_type": F.when(k % 2 == 1, "input").otherwise("image"), "value": F.when(k % 6 == 0, "").when(k % 7 == 0, F.lit(None)).otherwise("v")})
    return score.baselines(elements, truth, found)


@query("""
WITH l AS (SELECT event_type AS layer, count(*) AS found, row_number() OVER (ORDER BY event_type) AS ord FROM events GROUP BY event_type)
SELECT layer, ord, (sum(found) OVER w)::BIGINT AS found, CASE WHEN max((ord = 4)::INT) OVER w = 0 THEN sum(ord * 1.5::DOUBLE) OVER w END AS cost_ms FROM l WINDOW w AS (ORDER BY ord ROWS UNBOUNDED PRECEDING)
""")
def layer_curve(spark, sf_dir):
    from pyspark.sql import Window

    kinds = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("layer")).agg(F.count(F.lit(1)).alias("found"))
    ranked = kinds.withColumn("ord", F.row_number().over(Window.orderBy("layer")).cast("long"))  # a row for each layer
    return score.layer_curve(ranked.withColumn("cost_ms", F.when(F.col("ord") != 4, F.col("ord") * 1.5)))

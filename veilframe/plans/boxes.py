"""Queries over rectangles that follow from the keys of ``part``: a page of 20 boxes for each 20 keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import geom
from veilframe.operators import coverage, match
from veilframe.plans.folds import kept_sql, matched_sql
from veilframe.plans.registry import query
from veilframe.tables import table

_BOXES_SQL = "(SELECT p_partkey AS k, p_partkey // 20 AS page_id, (p_partkey * 37) % 300 AS x, (p_partkey * 91) % 400 AS y, 40 + (p_partkey * 13) % 160 AS w, 20 + (p_partkey * 29) % 120 AS h, p_size FROM part)"


def _boxes(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    place = geom.rect((k * 37) % 300, (k * 91) % 400, F.lit(40) + (k * 13) % 160, F.lit(20) + (k * 29) % 120)
    return table(spark, sf_dir, "part").select(
        F.floor(k / 20).alias("page_id"),
        k.alias("ord"),
        F.concat(F.lit("e"), k.cast("string")).alias("element_id"),
        F.concat(F.lit("r"), k.cast("string")).alias("region_id"),
        F.when(k % 3 == 0, "name").otherwise("email").alias("category"),
        F.when(k % 4 == 0, "ocr").when(k % 7 == 0, "manual").otherwise("dom").alias("source"),
        F.when(k % 2 == 0, "image").otherwise("text").alias("element_type"),
        (k % 5 == 0).alias("seen_whole"),
        (((k * 17) % 100) / 100.0).alias("score"),
        place.alias("position"),
    )


_INTER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(f"""
SELECT a.page_id, a.k AS a, b.k AS b, {_INTER}::DOUBLE AS shared, ({_INTER})::DOUBLE / (a.w * a.h + b.w * b.h - {_INTER}) AS iou, ({_INTER})::DOUBLE / least(a.w * a.h, b.w * b.h) AS share
FROM {_BOXES_SQL} a JOIN {_BOXES_SQL} b ON a.page_id = b.page_id AND a.k < b.k AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h
""")
def overlap_pairs(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).select("page_id", "ord", "position")
    l, r = F.col("l.position"), F.col("r.position")  # noqa: E741
    pairs = match.overlapping(boxes, boxes).where("l.ord < r.ord")
    return pairs.select("page_id", F.col("l.ord").alias("a"), F.col("r.ord").alias("b"), geom.intersection(l, r).alias("shared"), geom.iou(l, r).alias("iou"), geom.overlap_share(l, r).alias("share"))


_SHARED = f"({_INTER})::DOUBLE / least(a.w * a.h, b.w * b.h) >= 0.6"
_SOURCED = f"(SELECT *, CASE WHEN k % 3 = 0 THEN 'name' ELSE 'email' END AS category, CASE WHEN k % 4 = 0 THEN 'ocr' WHEN k % 7 = 0 THEN 'manual' ELSE 'dom' END AS source, ((k * 17) % 100) / 100.0 AS score FROM {_BOXES_SQL})"


@query(f"SELECT page_id, k AS ord, score::DOUBLE AS score FROM ({kept_sql(f'SELECT *, page_id AS g FROM {_SOURCED} WHERE score >= 0.3', '-score, k', f'({_INTER})::DOUBLE / (a.w * a.h + b.w * b.h - {_INTER}) > 0.3', 50)})")
def nms_keep(spark, sf_dir):
    kept = match.suppressed(_boxes(spark, sf_dir).select("page_id", "ord", "score", "position"))
    return kept.select("page_id", "ord", "score")


@query(f"SELECT page_id, category, k AS ord FROM ({kept_sql(f"SELECT *, page_id || category AS g FROM {_SOURCED}", 'k', _SHARED)})")
def dedupe_findings(spark, sf_dir):
    return match.deduplicated(_boxes(spark, sf_dir).select("page_id", "ord", "category", "position")).select("page_id", "category", "ord")


@query(f"""SELECT page_id, category, k AS ord, source FROM ({kept_sql(f"SELECT *, page_id || category AS g FROM {_SOURCED} WHERE source <> 'manual'", 'k', _SHARED)})
UNION ALL SELECT page_id, category, k, source FROM {_SOURCED} WHERE source = 'manual'""")
def dedupe_regions(spark, sf_dir):
    rows = _boxes(spark, sf_dir).select("page_id", "ord", "category", "source", "element_id", "position")
    return match.deduplicated_regions(rows).select("page_id", "category", "ord", "source")


_WEIGHT = f"({_INTER})::DOUBLE / (a.w * a.h + b.w * b.h - {_INTER})"


@query(f"""SELECT page_id, a, b, weight FROM ({matched_sql(f"SELECT a.page_id AS page_id, a.k AS a, b.k AS b, {_WEIGHT} AS weight FROM {_BOXES_SQL} a JOIN {_BOXES_SQL} b ON a.page_id = b.page_id AND a.k % 2 = 0 AND b.k % 2 = 1 WHERE {_WEIGHT} >= 0.1")})""")
def greedy_match(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).select("page_id", "ord", "position")
    near = match.overlapping(boxes.where("ord % 2 = 0"), boxes.where("ord % 2 = 1"))
    pairs = near.select("page_id", F.col("l.ord").alias("a"), F.col("r.ord").alias("b"), geom.iou(F.col("l.position"), F.col("r.position")).alias("weight"))
    return match.greedy_pairs(pairs.where("weight >= 0.1"))


@query(f"""
SELECT page_id, 'r' || rk AS region_id, 'e' || arg_max(ek, struct_pack(s := share, o := -ek)) AS element_id FROM (
  SELECT a.page_id, a.k AS rk, b.k AS ek, ({_INTER})::DOUBLE / (a.w * a.h) AS share FROM {_BOXES_SQL} a JOIN {_BOXES_SQL} b ON a.page_id = b.page_id WHERE a.k % 4 = 0 AND b.k % 2 = 1)
WHERE share > 0.5 GROUP BY page_id, rk
""")
def overlapping_element(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    return match.best_element(boxes.where("ord % 4 = 0").select("page_id", "region_id", "position"), boxes.where("ord % 2 = 1").select("page_id", "element_id", "ord", "position"))


_ASPECT = "w / h::DOUBLE BETWEEN 0.25 AND 4"


@query(f"SELECT page_id, k AS ord FROM {_BOXES_SQL} WHERE k % 2 = 0 AND w >= 140 AND h >= 80 AND {_ASPECT}")
def image_candidates(spark, sf_dir):
    return coverage.image_candidates(_boxes(spark, sf_dir)).select("page_id", "ord")


@query(f"""
SELECT f::INT AS floor, count(k) AS crops FROM (SELECT unnest([40, 60, 80, 100, 120, 140, 180, 240]) AS f)
LEFT JOIN {_BOXES_SQL} ON k % 2 = 0 AND w >= f AND h >= floor(f * 80 / 140.0 + 0.5) AND {_ASPECT} GROUP BY f
""")
def floor_sweep(spark, sf_dir):
    return coverage.floor_sweep(_boxes(spark, sf_dir).where("element_type = 'image'"))


@query("""
SELECT doc_id, array_to_string(CASE WHEN cut OR last = bottom THEN regular ELSE list_append(regular, bottom) END, ',') AS stops, cut AS truncated FROM (
  SELECT doc_id, bottom, regular, regular[-1] AS last, len(regular) >= 12 AND regular[-1] < bottom AS cut FROM (
    SELECT doc_id, bottom, list_slice(generate_series(0, bottom, 540), 1, 12) AS regular FROM (SELECT doc_id, greatest(0, n_chars - 720) AS bottom FROM documents)))
""")
def scan_plan(spark, sf_dir):
    stops, cut = coverage.scan_stops(F.col("n_chars"), F.lit(720))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(stops.cast("array<string>"), ",").alias("stops"), cut.alias("truncated"))


_LOOKS = f"(SELECT *, page_id AS g, k % 5 = 0 AS seen FROM {_BOXES_SQL} WHERE k % 2 = 0)"


@query(f"""
WITH kept AS MATERIALIZED ({kept_sql(f"SELECT * FROM {_LOOKS}", "k", _SHARED)}),
first AS (SELECT b.k AS k, min(a.k) AS home FROM {_LOOKS} b JOIN kept a ON a.page_id = b.page_id AND a.k <= b.k AND (a.k = b.k OR {_SHARED}) GROUP BY b.k),
seen AS (SELECT home, bool_or(k % 5 = 0) AS seen FROM first GROUP BY home)
SELECT a.page_id, a.k AS ord FROM kept a JOIN seen ON home = a.k WHERE NOT seen.seen
AND NOT EXISTS (SELECT 1 FROM {_BOXES_SQL} b WHERE a.page_id = b.page_id AND b.k % 12 = 0 AND {_SHARED})
""")
def unexamined(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    images = boxes.where("element_type = 'image'").select("page_id", "ord", "seen_whole", "position")
    read = boxes.where("ord % 12 = 0").select("page_id", "source", "position")
    return coverage.unexamined(images, read).select("page_id", "ord")


@query(f"""
SELECT page_id, ord, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS width, h::DOUBLE AS height FROM (
  SELECT page_id, k AS ord, greatest(x, 50) - 50 AS x, greatest(y, 100) - 100 AS y, least(x + w, 250) - greatest(x, 50) AS w, least(y + h, 300) - greatest(y, 100) AS h FROM {_BOXES_SQL}) WHERE w > 0 AND h > 0
""")
def clip_findings(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).select("page_id", "ord", "position")
    views = boxes.select("page_id").distinct().select("page_id", geom.rect(50, 100, 200, 200).alias("view"))
    return coverage.clipped(boxes, views).select("page_id", "ord", "position.*")

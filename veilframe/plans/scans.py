"""Queries over whole-page scans: each document is a page of lines, seen through looks of 264 pixels that overlap.

A page's content sits up to three pixels lower from look to look, some pages stop moving, some looks can't be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import geom
from veilframe.functions.text import classify_text
from veilframe.operators import coverage, scan
from veilframe.operators.detect import categorised
from veilframe.plans.boxes import _INTER
from veilframe.plans.folds import kept_sql, matched_sql
from veilframe.plans.registry import query
from veilframe.plans.texts import _category_sql
from veilframe.tables import spread, table

LINE, VIEW, WIDTH = 22, 264, 520


def _pages(docs: DataFrame) -> DataFrame:
    """(page_id, text, document_height, at, truncated): each page with its stops, and whether they end before its bottom."""
    height = (F.size(F.split("text", "\n", -1)) * LINE).cast("long")
    tall = docs.where("text is not null").select(F.col("doc_id").alias("page_id"), "text", height.alias("document_height"))
    stops, cut = coverage.scan_stops(F.col("document_height"), F.lit(VIEW))
    return tall.select("*", stops.alias("at"), cut.alias("truncated"))


def _lines(spark, sf_dir) -> DataFrame:
    """(page_id, at, n, text): each line with its page's stops, so that looks meet it where it is read."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _pages(docs).select("page_id", "at", F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))


def _plans(spark, sf_dir) -> DataFrame:
    return _pages(table(spark, sf_dir, "documents")).select("page_id", "document_height", F.lit(VIEW).cast("long").alias("view_height"), "at", F.size("at").cast("long").alias("stops"), "truncated")


def _looks(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` (page_id, at, ...) once a look, with stop and scroll_y. Every 13th page is locked from its third look on."""
    locked = (F.col("page_id") % 13 == 5) & (F.col("stop") >= 2)
    met = rows.select("page_id", *columns, "at", F.posexplode("at").alias("stop", "y"))
    return met.select("page_id", *columns, "stop", F.when(locked, F.element_at("at", 2)).otherwise(F.col("y")).alias("scroll_y"))


def _captures(spark, sf_dir) -> DataFrame:
    """The looks of each page; every 11th page's third look can't be read."""
    p, stop = F.col("page_id"), F.col("stop")
    looks = _looks(_plans(spark, sf_dir))
    return looks.select("page_id", "stop", F.lit(0).alias("scroll_x"), "scroll_y", F.lit(WIDTH).alias("view_width"), F.lit(VIEW).alias("view_height"), (~((p % 11 == 3) & (stop == 2))).alias("ok"))


def _seen(lines: DataFrame) -> DataFrame:
    """``lines`` (page_id, at, n, ...) as each look shows them: the part inside the view, in its coordinates."""
    met = _looks(lines, *[c for c in lines.columns if c not in ("page_id", "at")])
    top = F.col("n") * LINE + F.pmod(F.col("page_id") + F.col("stop"), F.lit(4)) - F.col("scroll_y")
    rows = met.withColumn("_top", top).where((F.col("_top") < VIEW) & (F.col("_top") + LINE > 0))
    y = F.greatest(F.col("_top"), F.lit(0))
    return rows.withColumn("position", geom.rect(0, y, WIDTH, F.least(F.col("_top") + LINE, F.lit(VIEW)) - y)).withColumn("ord", F.col("n").cast("long")).drop("_top", "scroll_y", "n")


def _found(spark, sf_dir) -> DataFrame:
    seen = _seen(categorised(_lines(spark, sf_dir)).drop("text"))
    return seen.withColumns({"source": F.when(F.col("ord") % 3 == 0, "ocr").otherwise("dom"), "reason": F.lit("line")})


def _pictures(spark, sf_dir) -> DataFrame:
    """Every ninth line has a picture of 300 x 110 beside it, of which a look shows all or a part."""
    met = _looks(_lines(spark, sf_dir).where("n % 9 = 4"), "n")
    rows = met.withColumn("_top", F.col("n") * LINE - F.col("scroll_y")).where((F.col("_top") < VIEW) & (F.col("_top") + 110 > 0))
    return rows.select("page_id", "stop", F.col("n").cast("long").alias("ord"), F.concat(F.lit("i"), F.col("n").cast("string")).alias("element_id"), F.lit("image").alias("element_type"), geom.rect(100, F.col("_top"), 300, 110).alias("position"))


_LOOKS_SQL = f"""
lines AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS ord FROM documents),
heights AS (SELECT page_id, count(*) * {LINE} AS height, greatest(0, count(*) * {LINE} - {VIEW}) AS bottom FROM lines GROUP BY page_id),
regular AS (SELECT *, list_slice(generate_series(0, bottom, 198), 1, 12) AS r FROM heights),
plans AS (SELECT *, len(r) >= 12 AND r[-1] < bottom AS cut, CASE WHEN r[-1] = bottom OR (len(r) >= 12 AND r[-1] < bottom) THEN r ELSE list_append(r, bottom) END AS tops FROM regular),
captures AS (
  SELECT page_id, stop, CASE WHEN page_id % 13 = 5 AND stop >= 2 THEN tops[2] ELSE tops[stop + 1] END AS sy, NOT (page_id % 11 = 3 AND stop = 2) AS ok
  FROM (SELECT page_id, tops, unnest(range(0, len(tops))) AS stop FROM plans)),
bad AS (SELECT *, coalesce(sy = lag(sy) OVER (PARTITION BY page_id ORDER BY stop), false) OR NOT ok AS bad FROM captures),
looks AS (SELECT page_id, stop, sy, bool_or(bad) OVER (PARTITION BY page_id) AS short FROM bad QUALIFY NOT bool_or(bad) OVER (PARTITION BY page_id ORDER BY stop)),
seen AS (
  SELECT page_id, stop, ord, text, sy + greatest(top, 0) AS y, 0 AS x, {WIDTH} AS w, least(top + {LINE}, {VIEW}) - greatest(top, 0) AS h, page_id * 1000000 + stop * 10000 + ord AS k
  FROM (SELECT l.*, stop, sy, ord * {LINE} + (l.page_id + stop) % 4 - sy AS top FROM lines l JOIN looks USING (page_id)) WHERE top < {VIEW} AND top + {LINE} > 0),
found AS (SELECT *, page_id || category AS g FROM (SELECT * EXCLUDE (text), {_category_sql("text")} AS category FROM seen) WHERE category IS NOT NULL)"""
_SHARE = f"({_INTER})::DOUBLE / least(a.w * a.h, b.w * b.h) >= 0.6"
_STITCHED_SQL = f"stitched AS MATERIALIZED ({kept_sql('SELECT * FROM found', 'k', _SHARE)})"
_UNREAD_SQL = f"""
pictures AS MATERIALIZED (
  SELECT page_id, page_id AS g, stop, ord, 100 AS x, ord * {LINE} AS y, 300 AS w, 110 AS h, page_id * 1000000 + stop * 10000 + ord AS k, ord * {LINE} >= sy AND ord * {LINE} + 110 <= sy + {VIEW} AS seen
  FROM lines JOIN looks USING (page_id) WHERE ord % 9 = 4 AND ord * {LINE} - sy < {VIEW} AND ord * {LINE} - sy + 110 > 0),
unread AS (
  SELECT page_id, min(x) AS x, y, min(w) AS w, min(h) AS h FROM pictures p GROUP BY page_id, y HAVING NOT bool_or(seen)),
gaps AS (SELECT * FROM unread a WHERE NOT EXISTS (SELECT 1 FROM stitched b WHERE a.page_id = b.page_id AND b.ord % 3 = 0 AND {_SHARE}))"""


@query(f"WITH {_LOOKS_SQL}, {_STITCHED_SQL} SELECT page_id, stop::INT AS stop, ord, category, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS width, h::DOUBLE AS height FROM stitched")
def scan_stitched(spark, sf_dir):
    found = scan.stitched(_found(spark, sf_dir), scan.walked(_captures(spark, sf_dir)))
    return found.select("page_id", "stop", "ord", "category", "position.*")


@query(f"WITH {_LOOKS_SQL}, {_STITCHED_SQL} SELECT f.seen - s.kept AS merged, f.seen AS sightings, s.kept AS findings FROM (SELECT count(*) AS seen FROM found) f, (SELECT count(*) AS kept FROM stitched) s")
def scan_merges(spark, sf_dir):
    looks, found = scan.walked(_captures(spark, sf_dir)), _found(spark, sf_dir)
    both = scan.lifted(found, looks).select(F.lit(1).alias("seen"), F.lit(0).alias("kept")).union(scan.stitched(found, looks).select(F.lit(0), F.lit(1)))
    sums = both.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("sightings"), F.coalesce(F.sum("kept"), F.lit(0)).alias("findings"))
    return sums.select((F.col("sightings") - F.col("findings")).alias("merged"), "sightings", "findings")


def _everything(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    looks = scan.walked(_captures(spark, sf_dir))
    return scan.everything(_found(spark, sf_dir), _pictures(spark, sf_dir), looks), looks


@query(f"WITH {_LOOKS_SQL}, {_STITCHED_SQL}, {_UNREAD_SQL} SELECT page_id, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS width, h::DOUBLE AS height FROM gaps")
def scan_gaps(spark, sf_dir):
    found, _ = _everything(spark, sf_dir)
    return found.where(F.col("reason") == scan.UNREAD).select("page_id", "position.*")


_ALL_SQL = f"WITH {_LOOKS_SQL}, {_STITCHED_SQL}, {_UNREAD_SQL}, everything AS (SELECT page_id, category, y, h FROM stitched UNION ALL SELECT page_id, 'other', y, h FROM gaps)"


@query(f"{_ALL_SQL} SELECT l.page_id, l.stop::INT AS stop, count(e.page_id) AS covered FROM looks l LEFT JOIN everything e ON e.page_id = l.page_id AND e.y < l.sy + {VIEW} AND e.y + e.h > l.sy GROUP BY ALL")
def scan_screens(spark, sf_dir):
    return scan.screens(*_everything(spark, sf_dir))


@query(f"""{_ALL_SQL}, tally AS (SELECT page_id, count(*) AS total, count_if(category = 'email') AS emails FROM everything GROUP BY page_id)
SELECT p.page_id, len(p.tops) AS stops, coalesce(any_value(l.n), 0) AS looks, p.height AS document_height, p.cut OR coalesce(any_value(l.short), true) AS truncated,
  coalesce(any_value(l.upto), 0)::BIGINT AS examined_to, coalesce(any_value(t.total), 0) AS total, coalesce(any_value(t.emails), 0) AS emails
FROM plans p LEFT JOIN (SELECT page_id, count(*) AS n, bool_or(short) AS short, arg_max(sy, stop) + {VIEW} AS upto FROM looks GROUP BY page_id) l USING (page_id) LEFT JOIN tally t USING (page_id)
GROUP BY p.page_id, p.tops, p.height, p.cut""")
def scan_summary(spark, sf_dir):
    found, looks = _everything(spark, sf_dir)
    told = scan.summary(found, looks, _plans(spark, sf_dir))
    return told.select("page_id", "stops", "looks", "document_height", "truncated", "examined_to", "total", F.coalesce(F.try_element_at("counts", F.lit("email")), F.lit(0).cast("long")).alias("emails"))


def _texts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """What the markup shows (every line but each tenth) and what is read (all but each fourth; each seventh misread)."""
    seen = _seen(_lines(spark, sf_dir))
    misread = F.when(F.col("ord") % 7 == 2, F.reverse("text")).otherwise(F.col("text"))
    return seen.where("ord % 10 <> 9"), seen.where("ord % 4 <> 3").withColumn("text", misread)


_SAME = "(a.t <> '' AND b.t <> '' AND (contains(a.t, b.t) OR contains(b.t, a.t)))"
_NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {_LOOKS_SQL},
texts AS (SELECT *, {_NORMAL.format("text")} AS t, 0 AS side FROM seen WHERE ord % 10 <> 9 UNION ALL
  SELECT * REPLACE (CASE WHEN ord % 7 = 2 THEN reverse(text) ELSE text END AS text), {_NORMAL.format("CASE WHEN ord % 7 = 2 THEN reverse(text) ELSE text END")}, 1 FROM seen WHERE ord % 4 <> 3),
named AS (SELECT * REPLACE (k * 2 + side AS k), page_id || ':' || side || ':' || t AS g FROM texts WHERE t <> ''),
merged AS MATERIALIZED ({kept_sql('SELECT * FROM named', 'k', _SHARE)}),
pairs AS MATERIALIZED (SELECT a.page_id, a.k AS a, b.k AS b, ({_INTER})::DOUBLE / least(a.w * a.h, b.w * b.h) AS weight FROM merged a JOIN merged b ON a.page_id = b.page_id AND a.side = 0 AND b.side = 1
  WHERE ({_INTER})::DOUBLE / least(a.w * a.h, b.w * b.h) >= 0.2 AND {_SAME}),
agreed AS (SELECT page_id, count(*) AS agreed FROM ({matched_sql("SELECT * FROM pairs")}) GROUP BY page_id),
sizes AS (SELECT page_id, count_if(side = 0) AS shown, count_if(side = 1) AS read FROM merged GROUP BY page_id)
SELECT page_id, coalesce(agreed, 0) AS agreed, shown - coalesce(agreed, 0) AS shown_only, read - coalesce(agreed, 0) AS read_only FROM sizes LEFT JOIN agreed USING (page_id)
""")
def scan_reading(spark, sf_dir):
    shown, read = _texts(spark, sf_dir)
    told = scan.reading(shown, read, read.limit(0), scan.walked(_captures(spark, sf_dir)))
    return told.select("page_id", "agreed", "shown_only", "read_only")


@query(None)
def screen_findings(spark, sf_dir):
    shown, read = _texts(spark, sf_dir)
    return scan.screen_findings(shown, read, classify_text, "page_id", "stop").select("page_id", "stop", "ord", "category", "confidence")

"""Queries over words, images and faces that follow from the keys of ``part`` and ``supplier``: lines, readings, agreement, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import geom
from veilframe.functions.text import classify_text
from veilframe.operators import guards, vision
from veilframe.plans.boxes import _BOXES_SQL, _INTER, _boxes
from veilframe.plans.folds import kept_sql, lined_sql, matched_sql
from veilframe.plans.registry import query
from veilframe.tables import table

#: Words by key mod 9.
WORDS = ("name", "me@mail.example", "passport", "no", "Fee", "B0SS", " ", "pay", "x")

_WORDS_SQL = f"""(SELECT k, page_id, page_id AS g, 'i' || page_id % 3 AS element_id, x, y % 90 AS y, w, 10 + k % 7 AS h, {WORDS!r}[k % 9 + 1] AS text FROM {_BOXES_SQL})""".replace("('name'", "(['name'").replace("'x')[", "'x'])[")


def _words(spark, sf_dir) -> DataFrame:
    k, p = F.col("ord"), F.col("position")
    text = F.element_at(F.array(*map(F.lit, WORDS)), (k % 9 + 1).cast("int"))
    boxes = _boxes(spark, sf_dir)
    return boxes.select("page_id", F.concat(F.lit("i"), (F.col("page_id") % 3).cast("string")).alias("element_id"), "ord", text.alias("text"), geom.rect(p["x"], p["y"] % 90, p["width"], F.lit(10) + k % 7).alias("position"))


_LINE_SQL = f"""(SELECT g AS page_id, line, string_agg(text, ' ' ORDER BY x, y, k) AS text, count(*) AS words, min(x)::DOUBLE AS x, min(y)::DOUBLE AS y, (max(x + w) - min(x))::DOUBLE AS w, (max(y + h) - min(y))::DOUBLE AS h FROM ({lined_sql("SELECT * FROM " + _WORDS_SQL)}) GROUP BY g, line)"""


@query(f"SELECT page_id, line, text, words, x, y, w AS width, h AS height FROM {_LINE_SQL}")
def word_lines(spark, sf_dir):
    return vision.line_boxes(_words(spark, sf_dir), "page_id").select("page_id", F.col("line").cast("long").alias("line"), "text", "words", "position.*")


@query(f"""
WITH said AS ({lined_sql(f"SELECT * FROM {_WORDS_SQL} WHERE trim(text) <> ''")}),
lines AS (SELECT g AS page_id, line, string_agg(text, ' ' ORDER BY x, y, k) AS text, count(*) AS words, min(x) AS x, min(y) AS y FROM said GROUP BY g, line)
SELECT page_id, text, words, row_number() OVER (PARTITION BY page_id ORDER BY y, x, line)::INT AS place FROM lines WHERE words > 1 OR length(text) >= 3
""")
def screen_lines(spark, sf_dir):
    frame, view = geom.rect(0, 0, 640, 480), geom.rect(0, 0, 320, 240)
    return vision.screen_lines(_words(spark, sf_dir), frame, view).select("page_id", "text", "words", "place")


@query(f"""
WITH hits AS (SELECT *, CASE WHEN contains(text, '@mail.example') THEN 'email' END AS category, regexp_matches(text, '(?i)\\bpassport\\b') AS card FROM {_LINE_SQL}),
shown AS (SELECT *, page_id % 4 > 0 AS good, 100.0 + page_id % 50 AS ix, 200.0 AS iy, (300 + page_id % 100) / 400.0 AS sx, 0.5 AS sy FROM hits)
SELECT page_id, 'ocr-i' || page_id % 3 || '-' || line - 1 AS region_id, category, round(ix + (x - h * 0.25) * sx, 6) AS x, round(iy + (y - h * 0.25) * sy, 6) AS y, round((w + h * 0.5) * sx, 6) AS width, round(h * 1.5 * sy, 6) AS height FROM shown WHERE good AND category IS NOT NULL
UNION ALL SELECT DISTINCT page_id, 'ocr-i' || page_id % 3 || '-document', 'id_number', ix, iy, 300.0 + page_id % 100, 100 FROM shown WHERE good AND card
""")
def image_regions(spark, sf_dir):
    words = _words(spark, sf_dir)
    g = F.col("page_id")
    images = words.select("page_id", "element_id").distinct().select("page_id", "element_id", geom.rect(F.lit(100) + g % 50, F.lit(200), F.lit(300) + g % 100, F.lit(100)).alias("position"), F.when(g % 4 > 0, 400).otherwise(0).alias("crop_width"), F.lit(200).alias("crop_height"))
    found = vision.image_regions(words, images, classify_text)
    return found.select("page_id", "region_id", "category", *[F.round(f"position.{c}", 6).alias(c) for c in ("x", "y", "width", "height")])


@query(f"SELECT page_id, 'i' || k AS element_id FROM {_BOXES_SQL} WHERE k % 2 = 0 AND (k % 3 <> 0 OR k % 5 = 0)")
def covered_images(spark, sf_dir):
    images = _boxes(spark, sf_dir).where("ord % 2 = 0").select("page_id", F.concat(F.lit("i"), F.col("ord").cast("string")).alias("element_id"), "ord", "position")
    results = images.where("ord % 3 = 0").select("page_id", "element_id", (F.col("ord") % 5 != 0).alias("ok"))
    return vision.covered_images(images.drop("ord"), results).select("page_id", "element_id")


@query(f"SELECT page_id, 'i' || k AS element_id FROM {_BOXES_SQL} WHERE k % 2 = 0 AND x >= 50 AND y >= 100 AND x + w <= 350 AND y + h <= 420 AND k % 3 <> 0")
def images_to_read(spark, sf_dir):
    images = _boxes(spark, sf_dir).where("ord % 2 = 0").select("page_id", F.concat(F.lit("i"), F.col("ord").cast("string")).alias("element_id"), "ord", "position")
    return vision.to_read(images, images.where("ord % 3 = 0").select("page_id", "element_id"), geom.rect(50, 100, 300, 320)).select("page_id", "element_id")


_TEXTED = f"(SELECT *, page_id AS g, ['pay now', 'Name:', 'mail', ''][k % 4 + 1] AS shown, ['PAY', 'name', 'mail!', 'other', 'Now pay now'][k % 5 + 1] AS pixels FROM {_BOXES_SQL})"


@query(f"""
WITH shown AS (SELECT * FROM {_TEXTED} WHERE k % 2 = 0 AND shown <> ''), pixels AS (SELECT * FROM {_TEXTED} WHERE k % 2 = 1),
near AS (SELECT a.page_id, a.k AS a, b.k AS b, ({_INTER})::DOUBLE / least(a.w * a.h, b.w * b.h) AS weight, trim(regexp_replace(lower(a.shown), '[^a-z0-9]+', ' ', 'g')) AS s, trim(regexp_replace(lower(b.pixels), '[^a-z0-9]+', ' ', 'g')) AS t FROM shown a JOIN pixels b ON a.page_id = b.page_id),
agreed AS (SELECT page_id, count(*) AS n FROM ({matched_sql("SELECT page_id, a, b, weight FROM near WHERE weight >= 0.2 AND (contains(s, t) OR contains(t, s))")}) GROUP BY page_id),
counts AS (SELECT page_id, count(*) FILTER (k % 2 = 0 AND shown <> '') AS shown, count(*) FILTER (k % 2 = 1) AS pixels FROM {_TEXTED} GROUP BY page_id)
SELECT page_id, coalesce(n, 0) AS agreed, shown - coalesce(n, 0) AS shown_only, pixels - coalesce(n, 0) AS read_only, coalesce(n, 0)::DOUBLE / (shown + pixels - coalesce(n, 0)) AS agreement FROM counts LEFT JOIN agreed USING (page_id)
""")
def agreement(spark, sf_dir):
    k = F.col("ord")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    boxes = _boxes(spark, sf_dir)
    value = pick(("pay now", None, "mail", ""))
    elements = boxes.where("ord % 2 = 0").select("page_id", "ord", "element_id", value.alias("value"), F.lit("Name:").alias("label"), F.lit(None).cast("string").alias("placeholder"), F.lit("text").alias("input_type"), "position")
    read = boxes.where("ord % 2 = 1").select("page_id", "ord", pick(("PAY", "name", "mail!", "other", "Now pay now")).alias("text"), "position")
    return vision.agreement(vision.shown_texts(elements), read)


@query(f"SELECT page_id, k AS ord FROM ({kept_sql(f"SELECT *, page_id || ':' || k % 3 AS g FROM {_BOXES_SQL}", 'k', f'({_INTER})::DOUBLE / least(a.w * a.h, b.w * b.h) >= 0.6')})")
def merged_sightings(spark, sf_dir):
    items = _boxes(spark, sf_dir).select("page_id", "ord", F.concat(F.lit("Text, "), (F.col("ord") % 3).cast("string"), F.lit("!")).alias("text"), "position")
    return vision.merged_sightings(items).select("page_id", "ord")


@query("""
WITH s AS (SELECT p_partkey AS k, (p_partkey * 7) % 2000 AS w, (p_partkey * 11) % 9000 AS h FROM part),
t AS (SELECT *, greatest(1.0, 1000.0 / nullif(w, 0), 2.0)::DOUBLE AS wanted, sqrt(9000000.0::DOUBLE / nullif(w * h, 0)) AS room FROM s)
SELECT k AS image, CASE WHEN w > 0 AND h > 0 THEN floor(w * greatest(1, least(wanted, room)) + 0.5)::BIGINT ELSE 0 END AS width, CASE WHEN w > 0 AND h > 0 THEN floor(h * greatest(1, least(wanted, room)) + 0.5)::BIGINT ELSE 0 END AS height,
  CASE WHEN w > 0 AND h > 0 THEN greatest(1, least(wanted, room)) < wanted - 1e-9 ELSE false END AS capped FROM t
""")
def recognition_sizes(spark, sf_dir):
    k = F.col("p_partkey")
    size = vision.recognition_size((k * 7) % 2000, (k * 11) % 9000, F.lit(vision.LEAST_WIDTH), F.lit(vision.SCREEN_SCALE))
    return table(spark, sf_dir, "part").select(k.alias("image"), size.alias("s")).select("image", "s.width", "s.height", "s.capped")


@query("""
WITH heads AS (SELECT * FROM (VALUES (0, 8, [10, 16, 24]), (1, 16, [32, 48]), (2, 32, [64, 96]), (3, 64, [128, 192, 256])) t(head, stride, sizes)),
cells AS (SELECT head, stride, r, c, unnest(sizes) AS size FROM (SELECT *, unnest(range(ceil(320 / stride)::INT)) AS c FROM (SELECT *, unnest(range(ceil(240 / stride)::INT)) AS r FROM heads))),
grid AS (SELECT row_number() OVER (ORDER BY head, r, c, size) - 1 AS prior, (c + 0.5) / (320.0 / stride) AS cx, (r + 0.5) / (240.0 / stride) AS cy, size / 320.0 AS w, size / 240.0 AS h FROM cells),
raw AS (SELECT vec_id, vec_id % 4420 AS prior, embedding[1]::DOUBLE AS dx, embedding[2]::DOUBLE AS dy, embedding[3]::DOUBLE AS dw, embedding[4]::DOUBLE AS dh FROM embeddings WHERE embedding IS NOT NULL),
box AS (SELECT vec_id, prior, dx * 0.1 * w + cx AS x, dy * 0.1 * h + cy AS y, exp(dw * 0.2) * w AS w, exp(dh * 0.2) * h AS h FROM raw JOIN grid USING (prior))
SELECT vec_id, prior, round((x - w / 2)::DOUBLE, 9) AS x1, round((y - h / 2)::DOUBLE, 9) AS y1, round((x + w / 2)::DOUBLE, 9) AS x2, round((y + h / 2)::DOUBLE, 9) AS y2 FROM box
""")
def face_boxes(spark, sf_dir):
    part = lambda n: F.col("embedding")[n].cast("double")
    raw = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", (F.col("vec_id") % 4420).alias("prior"), part(0).alias("dx"), part(1).alias("dy"), part(2).alias("dw"), part(3).alias("dh"))
    found = vision.decoded(raw, vision.priors(spark))
    return found.select("vec_id", "prior", *[F.round(f"box.{c}", 9).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"""
WITH t AS (SELECT *, greatest(0, x * 2.0 - 3) AS l, greatest(0, y * 2.0 - 3) AS u, least(500, (x + w) * 2.0 + 3) AS r, least(600, (y + h) * 2.0 + 3) AS d FROM {_BOXES_SQL})
SELECT page_id, count(*) FILTER (r > l AND d > u) AS painted, count(*) FILTER (NOT (r > l AND d > u)) AS skipped FROM t GROUP BY page_id
""")
def painted_boxes(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    frames = boxes.select("page_id").distinct().select("page_id", F.lit(2.0).alias("scale_x"), F.lit(2.0).alias("scale_y"), F.lit(500).alias("frame_width"), F.lit(600).alias("frame_height"))
    return vision.painted(boxes.select("page_id", "position"), frames)


@query(f"""
SELECT a.page_id, 'm' || a.k AS mark_id, NULL AS element_id FROM {_BOXES_SQL} a WHERE k % 7 = 0
UNION ALL SELECT a.page_id, 'm' || a.k, 'e' || b.k FROM {_BOXES_SQL} a JOIN {_BOXES_SQL} b ON a.page_id = b.page_id AND a.k % 7 = 0 AND b.k % 2 = 1 AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h
""")
def marked_regions(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    marks = boxes.where("ord % 7 = 0").select("page_id", F.concat(F.lit("m"), F.col("ord").cast("string")).alias("mark_id"), "category", "position")
    return guards.marked_regions(marks, boxes.where("ord % 2 = 1").select("page_id", "element_id", "position")).select("page_id", "mark_id", "element_id")


@query(f"""
SELECT page_id, k AS ord, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN k % 4 = 0 THEN 3 WHEN k % 7 = 0 THEN 5 ELSE 1 END, k)::INT AS place FROM {_BOXES_SQL}
""")
def region_order(spark, sf_dir):
    return guards.concatenated(_boxes(spark, sf_dir)).select("page_id", "ord", "place")


@query(f"""
WITH hits AS (SELECT *, CASE WHEN contains(text, '@mail.example') THEN 'email' END AS category, regexp_matches(text, '(?i)\\bpassport\\b') AS card FROM {_LINE_SQL})
SELECT page_id, category, (x - h * 0.25)::DOUBLE AS x, (y - h * 0.25)::DOUBLE AS y, (w + h * 0.5)::DOUBLE AS width, (h * 1.5)::DOUBLE AS height FROM hits WHERE category IS NOT NULL
UNION ALL SELECT DISTINCT page_id, 'id_number', 0, 0, 640, 480 FROM hits WHERE card
""")
def pixel_detections(spark, sf_dir):
    words = _words(spark, sf_dir)
    frames = words.select("page_id").distinct().select("page_id", F.lit(640).alias("width"), F.lit(480).alias("height"))
    return vision.pixel_detections(words.drop("element_id"), frames, classify_text).select("page_id", "category", "position.*")


@query(f"""SELECT page_id, k AS ord, round(greatest(0, x - w * 0.15::DOUBLE) / 640, 9) AS x1, round(least(640, x + w * 1.15::DOUBLE) / 640, 9) AS x2, round(greatest(0, x - w * 0.15::DOUBLE), 9) AS x, round(least(640, x + w * 1.15::DOUBLE) - greatest(0, x - w * 0.15::DOUBLE), 9) AS width FROM {_BOXES_SQL}""")
def face_regions(spark, sf_dir):
    p = F.col("position")
    unit = F.struct((p["x"] / 640).alias("x1"), (p["y"] / 640).alias("y1"), ((p["x"] + p["width"]) / 640).alias("x2"), ((p["y"] + p["height"]) / 640).alias("y2"))
    grown = _boxes(spark, sf_dir).withColumn("box", vision.padded_face(unit))
    placed = grown.withColumn("place", vision.face_position(F.col("box"), F.lit(1280), F.lit(1280), F.lit(2.0), F.lit(2.0)))
    near = lambda c: F.round(c, 9)
    return placed.select("page_id", "ord", near("box.x1").alias("x1"), near("box.x2").alias("x2"), near("place.x").alias("x"), near("place.width").alias("width"))

"""Queries over page contexts, typed values, changed targets and run notes, of pages that follow from the supplied keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import geom
from veilframe.operators import coverage, handover
from veilframe.plans import agents, boxes
from veilframe.plans.registry import query
from veilframe.tables import table

_E = agents._E


def _hidden(elements):
    category = F.lower(F.regexp_extract("value", r"^\[([A-Z]+)\]$", 1))
    return elements.where(F.startswith("value", F.lit("["))).select("page_id", "element_id", category.alias("category"))


@query(f"""
WITH e AS (SELECT *, '{{"elementId":' || to_json(id) || ',"type":' || to_json(t) || ',"label":' || coalesce(to_json(l)::VARCHAR, 'null') || ',"value":' || coalesce(to_json(v)::VARCHAR, 'null') || ',"filled":' || filled::VARCHAR
  || CASE WHEN "row" IS NULL THEN '' ELSE ',"row":' || "row" END || '}}' AS j, CASE WHEN starts_with(v, '[') THEN lower(v[2:-2]) END AS category FROM {_E})
SELECT page_id, to_json(coalesce(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)), []))::VARCHAR AS hidden, '[' || string_agg(j, ', ' ORDER BY k) || ']' AS elements, count(*) AS n_elements FROM e GROUP BY page_id
""")
def page_contexts(spark, sf_dir):
    elements = agents._elements(spark, sf_dir)
    return handover.contexts(elements, _hidden(elements))


@query(f"""
WITH a AS (SELECT o_orderkey AS o, o_orderkey % 64 AS page_id, 'e' || ((o_orderkey % 64) * 8 + (o_orderkey // 64) % 8) AS sel, CASE WHEN o_orderkey % 3 = 0 THEN 'click' ELSE 'type' END AS act,
  CASE o_orderkey % 5 WHEN 0 THEN '[USE_SAVED_CREDENTIAL]' WHEN 1 THEN NULL ELSE 'someone' END AS value FROM orders),
r AS (SELECT *, CASE WHEN act = 'type' AND value = '[USE_SAVED_CREDENTIAL]' THEN 'no saved credential' WHEN act = 'type' AND EXISTS (SELECT 1 FROM {_E} e WHERE e.page_id = a.page_id AND e.id = a.sel AND starts_with(e.v, '[')) THEN 'literal for a hidden field' END AS withheld FROM a)
SELECT o AS reply_id, CASE WHEN act = 'type' AND withheld IS NULL THEN value END AS typed, withheld FROM r
""")
def typed_values(spark, sf_dir):
    o = F.col("o_orderkey")
    target = (o % 64) * 8 + F.floor(o / 64) % 8
    value = F.when(o % 5 == 0, "[USE_SAVED_CREDENTIAL]").when(o % 5 > 1, "someone")
    actions = table(spark, sf_dir, "orders").select(o.alias("reply_id"), (o % 64).alias("page_id"), F.when(o % 3 == 0, "click").otherwise("type").alias("action"), F.concat(F.lit("e"), target.cast("string")).alias("selector"), value.alias("value"))
    return handover.typed_values(actions, _hidden(agents._elements(spark, sf_dir))).select("reply_id", "typed", "withheld")


#: Tags, roles and input types that the later capture shows, by key mod 6.
_LATER = (("input", None, "text"), ("button", None, None), ("textarea", None, None), ("div", "button", None), ("input", None, "submit"), ("a", None, None))


@query(f"""
SELECT page_id, id AS element_id, CASE WHEN k % 7 = 0 THEN 'gone' WHEN k % 11 = 0 THEN 'not visible' WHEN t = 'input' AND k % 6 NOT IN (0, 2, 4) OR t = 'button' AND k % 6 NOT IN (1, 3, 4, 5) THEN 'another kind'
  WHEN l IS NOT NULL AND k % 5 = 0 THEN 'another label' END AS change FROM {_E}
""")
def changed_targets(spark, sf_dir):
    elements, k = agents._elements(spark, sf_dir), F.col("ord")

    def later(which):
        out = F.when(k % 6 == 0, F.lit(_LATER[0][which]))
        for n, row in enumerate(_LATER[1:], 1):
            out = out.when(k % 6 == n, F.lit(row[which]))
        return out

    now = elements.where(k % 7 != 0).select("page_id", "element_id", later(0).alias("tag"), later(1).alias("role"), later(2).alias("input_type"), (k % 11 != 0).alias("visible"), F.when(k % 5 == 0, F.concat(F.lit("was "), "label")).otherwise(F.col("label")).alias("label"))
    return handover.rechecked(elements, now).select("page_id", "element_id", "change")


@query("""
WITH s AS (SELECT l_orderkey AS scan_id, count(*) AS screens, sum(l_linenumber % 3)::BIGINT AS covered FROM lineitem WHERE l_orderkey % 4 < 3 GROUP BY 1),
r AS (SELECT o_orderkey AS scan_id, coalesce(screens, 0) AS screens, coalesce(covered, 0) AS covered, o_orderkey % 5 = 0 AS cut, o_orderkey % 3 AS omitted FROM orders LEFT JOIN s ON scan_id = o_orderkey)
SELECT scan_id, screens, covered, screens || CASE screens WHEN 1 THEN ' screen examined, ' ELSE ' screens examined, ' END || CASE covered WHEN 0 THEN 'nothing found' WHEN 1 THEN '1 area covered' ELSE covered || ' areas covered' END
  || CASE WHEN cut THEN '; ended before the bottom' ELSE '' END || CASE omitted WHEN 0 THEN '' WHEN 1 THEN '; 1 screen not shown' ELSE '; ' || omitted || ' screens not shown' END AS note FROM r
""")
def proof_notes(spark, sf_dir):
    o = F.col("o_orderkey")
    screens = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 < 3").select(F.col("l_orderkey").alias("scan_id"), (F.col("l_linenumber") % 3).cast("long").alias("covered"))
    scans = table(spark, sf_dir, "orders").select(o.alias("scan_id"), (o % 5 == 0).alias("truncated"), (o % 3).alias("omitted"))
    return handover.proof_notes(screens, scans)


@query("""
WITH s AS (SELECT user_id, CASE WHEN event_id % 4 > 0 THEN event_id * 4096 END AS used, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS of FROM events)
SELECT user_id AS run_id, max(used) FILTER (n = 1) / 1048576 AS before_mb, max(used) FILTER (n = of) / 1048576 AS after_mb, (max(used) FILTER (n = of) - max(used) FILTER (n = 1)) / 1048576 AS delta_mb FROM s GROUP BY user_id
""")
def memory_deltas(spark, sf_dir):
    e = F.col("event_id")
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), e.alias("ord"), F.when(e % 4 > 0, e * 4096).alias("used"))
    return handover.memory_deltas(samples)


@query(f"""
SELECT k AS ord, w > 0 AND x - 150 < 320 AND y - 200 < 180 AND x - 150 + w > 0 AND y - 200 + h > 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 AS shown FROM {boxes._BOXES_SQL}
""")
def shown_elements(spark, sf_dir):
    k = F.col("ord")
    inside = handover.in_view(geom.moved(F.col("position"), F.lit(-150), F.lit(-200)), F.lit(320), F.lit(180))
    style = handover.rendered(F.when(k % 13 == 0, "hidden").when(k % 2 == 0, "visible"), F.when(k % 17 == 0, "none"), F.when(k % 19 == 0, 0.0).when(k % 3 == 0, 1.0))
    return boxes._boxes(spark, sf_dir).select("ord", (inside & style).alias("shown"))


@query(f"""
WITH i AS (SELECT w, h, k % 3 = 0 AS sensitive FROM {boxes._BOXES_SQL} WHERE k % 2 = 0),
f AS (SELECT unnest([40, 60, 80, 100, 120, 140, 180, 240]) AS floor),
c AS (SELECT floor, count(w) AS crops, count(*) FILTER (sensitive) AS caught FROM f LEFT JOIN i ON w >= floor AND h >= floor(floor * 80 / 140.0::DOUBLE + 0.5) AND w / h::DOUBLE BETWEEN 0.25 AND 4 GROUP BY floor),
n AS (SELECT count(*) FILTER (sensitive) AS sensitive FROM i), b AS (SELECT crops AS base FROM c WHERE floor = 140)
SELECT floor, crops, caught, sensitive, CASE WHEN sensitive > 0 THEN caught / sensitive ELSE 1 END::DOUBLE AS recall, crops - caught AS over_flagged, CASE WHEN crops > 0 THEN caught / crops ELSE 1 END::DOUBLE AS "precision",
  CASE WHEN base > 0 THEN crops / base ELSE 1 END::DOUBLE AS relative_cost FROM c, n, b
""")
def floor_costs(spark, sf_dir):
    images = boxes._boxes(spark, sf_dir).where("element_type = 'image'").select("position", (F.col("category") == "name").alias("sensitive"))
    return coverage.floor_costs(images)

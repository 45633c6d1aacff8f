"""Queries over sealed payloads: a page for every ten customers, whose names are typed into fields and repeated in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import geom
from veilframe.operators import detect, redact
from veilframe.plans.registry import query
from veilframe.tables import table

_LETTERS = ("0123456789", "bcdfghjklm")


def _elements(spark, sf_dir) -> DataFrame:
    """A field declared as a name, and a line of text: every third repeats the name, every fifth quotes it with a line feed within."""
    k = F.col("c_custkey")
    typed = F.concat(F.lit("Mx "), F.translate(F.lpad(k.cast("string"), 8, "0"), *_LETTERS), F.when(k % 5 == 0, ' "the\nfirst"').otherwise(""))
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), typed.alias("typed")).withColumn("said", F.when(F.col("k") % 3 == 0, F.concat(F.lit("hello "), F.col("typed"), F.lit(", welcome"))).otherwise("hello, welcome"))
    part = lambda n, kind, value, auto: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("element_type"), value.alias("value"), F.lit(auto).cast("string").alias("autocomplete"))
    both = rows.select("k", F.explode(F.array(part(0, "input", F.col("typed"), "name"), part(1, "text", F.col("said"), None))).alias("e"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    ord_ = (F.col("k") * 2 + F.col("e.n")).alias("ord")
    return both.select(F.floor(F.col("k") / 10).alias("page_id"), ord_, F.concat(F.lit("e"), (F.col("k") * 2 + F.col("e.n")).cast("string")).alias("element_id"), "e.element_type", none("label"), "e.value", F.when(F.col("e.n") == 0, "text").alias("input_type"), "e.autocomplete", none("name"), none("placeholder"), none("column_header"), geom.rect(0, F.col("k"), 10, 10).alias("position"))


@query("""
WITH people AS (SELECT c_custkey // 10 AS page_id, c_custkey AS k, 'Mx ' || translate(lpad(c_custkey::VARCHAR, 8, '0'), '0123456789', 'bcdfghjklm') || CASE WHEN c_custkey % 5 = 0 THEN ' "the' || chr(10) || 'first"' ELSE '' END AS raw FROM customer)
SELECT page_id, raw FROM people WHERE k % 3 = 0
""")
def leaked_names(spark, sf_dir):
    elements = _elements(spark, sf_dir)
    regions = detect.detect(elements)
    sent = redact.payloads(redact.redact(elements, regions), regions)
    return redact.leaks(sent, redact.flagged_values(elements, regions)).select("page_id", F.explode("leaked").alias("raw"))


@query("""
SELECT page_id, count(*) AS elements, count_if(k % 3 = 0) = 0 AS sealed FROM (SELECT c_custkey // 10 AS page_id, c_custkey AS k FROM customer, range(2)) GROUP BY page_id
""")
def sealed_pages(spark, sf_dir):
    elements = _elements(spark, sf_dir)
    sealed = redact.seal(elements, detect.detect(elements))
    count = elements.groupBy("page_id").agg(F.count(F.lit(1)).alias("elements"))
    told = sealed.frame.select("page_id", F.lit(True).alias("sealed")).unionByName(sealed.refused.select("page_id", F.lit(False).alias("sealed")))
    return count.join(told, "page_id").select("page_id", "elements", "sealed")

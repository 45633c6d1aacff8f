"""Queries over the supplied pages: elements, links, headings, rows, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.detect import detect
from veilframe.plans.registry import query
from veilframe.sources import captured, html
from veilframe.tables import table

_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"
# Character references as browsers read them: these count without their semicolon too, and one that was cut to &#x2 is no character.
_READ = "{x}"
for _was, _is in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#x27;?", "''"), ("&#x2;", ""), ("&#x2([^0-9a-fA-F;]|$)", r"\1"), ("&amp;?", "&")):
    _READ = f"regexp_replace({_READ}, '{_was}', '{_is}', 'g')"
_READ = rf"trim(regexp_replace({_READ}, '[\s\x0B]+', ' ', 'g'))"
_CUT = "CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '…' ELSE nullif({x}, '') END"


def _nodes(spark, sf_dir) -> DataFrame:
    return html.nodes(table(spark, sf_dir, "pages"))


@query(None)
def page_elements(spark, sf_dir):
    return html.elements_of(table(spark, sf_dir, "pages"))


@query(f"""
SELECT page_id, count(*) AS links, count(DISTINCT said) AS texts, max(length(said)) AS longest FROM (
  SELECT page_id, {_PLAIN.format(x="unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1))")} AS said FROM pages) GROUP BY page_id
""")
def page_links(spark, sf_dir):
    links = _nodes(spark, sf_dir).where("element_type = 'button'").withColumn("said", html.squeezed(F.col("own")))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("said").alias("texts"), F.max(F.length("said")).cast("long").alias("longest"))


@query(f"""
SELECT page_id, {_CUT.format(x="said", n=200)} AS heading FROM (SELECT page_id, {_READ.format(x="regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS said FROM pages WHERE contains(html, '<h1>')) WHERE said <> ''
""")
def page_headings(spark, sf_dir):
    heads = _nodes(spark, sf_dir).where("tag = 'h1' and element_type = 'text'")
    return heads.select("page_id", html.clamped(F.col("own"), html.MOST_VALUE).alias("heading"))


@query("""
SELECT page_id, tag, count(*) AS nodes FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<(style|script|title)[^>]*>.*?</(style|script|title)>|<meta[^>]*>|<head>|<!DOCTYPE[^>]*>', '', 'gs'), '<([a-z][a-z0-9]*)[ />]', 1)) AS tag FROM pages) GROUP BY ALL
""")
def page_tags(spark, sf_dir):
    return _nodes(spark, sf_dir).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("nodes"))


@query(None)
def page_findings(spark, sf_dir):
    placed = html.elements_of(table(spark, sf_dir, "pages")).withColumn("position", F.lit(None).cast("struct<x:double,y:double,width:double,height:double>"))
    return detect(placed).drop("position")


@query(f"""
SELECT page_id, count(*) AS listed, sum(length(v))::BIGINT AS characters FROM (
  SELECT page_id, {_PLAIN.format(x="unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1))")} AS v FROM pages) WHERE v <> '' GROUP BY page_id
""")
def reviewable_links(spark, sf_dir):
    links = html.elements(html.parsed(table(spark, sf_dir, "pages"), only="tag = 'a'"))
    return captured.reviewable(links).groupBy("page_id").agg(F.count(F.lit(1)).alias("listed"), F.sum(F.length("value")).alias("characters"))


@query("""
SELECT doc_id AS page_id, '{"kind":"element-map","about":"documents","elements":[{"elementId":"e0","elementType":"text","selector":null,"label":' || CASE WHEN lang IS NULL THEN 'null' ELSE '"' || lang || '"' END || ',"value":"' || n_chars || '","inputType":null,"autocomplete":null,"name":' || CASE WHEN source IS NULL THEN 'null' ELSE '"' || source || '"' END || ',"placeholder":null,"position":null}]}' AS json FROM documents
""")
def exported_maps(spark, sf_dir):
    none = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit(0).alias("ord"), F.lit("e0").alias("element_id"), F.lit("text").alias("element_type"), none.alias("selector"), F.col("lang").alias("label"), F.col("n_chars").cast("string").alias("value"), none.alias("input_type"), none.alias("autocomplete"), F.col("source").alias("name"), none.alias("placeholder"), F.lit(None).cast(captured.POSITION).alias("position"), "text")
    return captured.exported(docs, "documents")


def _grid_pages(spark, sf_dir) -> DataFrame:
    """A page for each order: a grid of its lines by roles, within a row of an outer grid. Every fifth has a header too many."""
    cell = lambda c: F.concat(F.lit('<i role="gridcell"><b>'), c.cast("string"), F.lit("</b></i>"))
    row = lambda x: F.concat(F.lit('<div role="row"><div>'), cell(x["l_partkey"]), F.lit("</div>"), cell(x["l_suppkey"]), F.lit("</div>"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), row), "").alias("rows"))
    extra = F.when(F.col("l_orderkey") % 5 == 0, '<b role="columnheader">More').otherwise("")
    head = F.concat(F.lit('<p role="row"><b role="columnheader">Part <u>sort</u></b><b role="columnheader"><u>Supplier</u></b>'), extra, F.lit("</p>"))
    page = F.concat(F.lit('<section role="grid"><div role="row"><i role="cell">outer</i><table role="grid">'), head, F.col("rows"), F.lit("</table></div></section>"))
    return lines.select(F.col("l_orderkey").alias("page_id"), page.alias("html"))


@query("""
SELECT l_orderkey AS page_id, x.value, CASE WHEN l_orderkey % 5 > 0 THEN x.header END AS header, count(*) AS cells
FROM (SELECT l_orderkey, unnest([{'value': l_partkey::VARCHAR, 'header': 'Part'}, {'value': l_suppkey::VARCHAR, 'header': 'Supplier'}]) AS x FROM lineitem) GROUP BY ALL
""")
def grid_cells(spark, sf_dir):
    # pages come from a shuffle, so they lie on all cores already
    found = html.elements(html.nodes(_grid_pages(spark, sf_dir), shown=True)).where("tag = 'b' and value rlike '^[0-9]+$'")
    return found.groupBy("page_id", "value", F.col("column_header").alias("header")).agg(F.count(F.lit(1)).alias("cells"))

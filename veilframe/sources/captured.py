"""Captured maps of pages: a reader that sets bad files aside by name and reason, and a writer of allowed fields only.

A file is one JSON object with about, elements and sensitive (the labels by hand). It is refused as a whole if
it can't be parsed, has no elements, no list of labels, or a label of an element that is not on the page. A folder
without files gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.html import HAS_VALUE

POSITION = "struct<x:double,y:double,width:double,height:double>"
#: The fields of an element that leave the engine, in their order.
ALLOWED = ("elementId", "elementType", "selector", "label", "value", "inputType", "autocomplete", "name", "placeholder")
ELEMENT = "struct<" + ",".join(f"{c}:string" for c in ALLOWED) + f",position:{POSITION}>"
SCHEMA = f"about string, elements array<{ELEMENT}>, sensitive array<struct<elementId:string,category:string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, about, elements, sensitive, refused) of every ``*.json`` below ``path``: one row a file, with the reason if it is refused."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    rows = files.select(name.alias("id"), "value", F.from_json("value", SCHEMA).alias("m"))
    known = F.transform("m.elements", lambda e: e["elementId"])
    unknown = F.array_except(F.transform("m.sensitive", lambda s: s["elementId"]), known)
    why = (
        F.when(F.json_object_keys("value").isNull(), "could not be parsed")
        .when(F.coalesce(F.size("m.elements"), F.lit(0)) < 1, "has no elements")
        .when(F.col("m.sensitive").isNull(), "has no labels")
        .when(F.size(unknown) > 0, F.concat(F.lit("labels "), F.array_join(unknown, ", "), F.lit(", not on the page")))
    )
    return rows.select("id", F.coalesce("m.about", F.lit("Captured page, no description given.")).alias("about"), "m.elements", "m.sensitive", why.alias("refused"))


def elements_of(maps: DataFrame) -> DataFrame:
    """(page_id, ord, element_id, ...) of the maps that are not refused."""
    rows = maps.where("refused is null").select(F.col("id").alias("page_id"), F.posexplode("elements").alias("ord", "e"))
    named = {"elementId": "element_id", "elementType": "element_type", "inputType": "input_type"}
    return rows.select("page_id", "ord", *[F.col(f"e.{c}").alias(named.get(c, c)) for c in (*ALLOWED, "position")])


def with_pixels(maps: DataFrame, pixels: DataFrame) -> DataFrame:
    """``maps`` with ``pixels``, the labelled boxes (page_id, category, position) of a page, or null."""
    boxes = pixels.groupBy(F.col("page_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("category", "position"))).alias("pixels"))
    return maps.join(boxes, "id", "left")


def unmeasured(pixels: DataFrame, readings: DataFrame) -> DataFrame:
    """Pages with labelled boxes of which no reading exists (page_id)."""
    return pixels.select("page_id").distinct().join(readings.select("page_id").distinct(), "page_id", "left_anti")


def exported(elements: DataFrame, about: str) -> DataFrame:
    """(page_id, json): a page's map (page_id, ord, and the allowed fields), without anything else."""
    named = {"elementId": "element_id", "elementType": "element_type", "inputType": "input_type"}
    row = F.struct(*[F.col(named.get(c, c)).alias(c) for c in ALLOWED], "position")
    grouped = elements.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", row.alias("e")))).alias("_e"))
    body = F.struct(F.lit("element-map").alias("kind"), F.lit(about).alias("about"), F.transform("_e", lambda x: x["e"]).alias("elements"))
    return grouped.select("page_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def reviewable(elements: DataFrame) -> DataFrame:
    """(page_id, ord, element_id, field, value): trimmed values for review, each with the name of its field; passwords never."""
    value = F.trim("value")
    rows = elements.where((value != "") & (value != HAS_VALUE))
    return rows.select("page_id", "ord", "element_id", F.coalesce("label", "name", "placeholder", "element_type").alias("field"), value.alias("value"))

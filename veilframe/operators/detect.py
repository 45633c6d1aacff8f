"""Regions of personal data in page elements, by what a field declares and what it holds.

``elements``: page_id, ord, element_id, element_type, label, value, input_type, autocomplete, name,
placeholder, column_header, position. One region per element at most; confidence never filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.patterns import AUTHOR_SUPPLIED, AUTOCOMPLETE, CONFIDENCE, FIELD_TEXT, INPUT_TYPES, SEVERITY, VALUELESS, java
from veilframe.functions.text import HIT, category_of, classify_header, classify_text, hit


def holds_free_text() -> Column:
    return F.col("input_type").isNull() | ~F.lower("input_type").isin(*VALUELESS)


def searchable_text() -> Column:
    filled = [F.when(F.col(c) != "", F.col(c)) for c in ("label", "name", "placeholder")]
    return F.lower(F.concat_ws(" ", *filled))


def classify_field() -> Column:
    """What an input declares itself to be: by type, autocomplete tokens, then the words around it."""
    kind = F.lower(F.coalesce("input_type", F.lit("")))
    tokens = F.split(F.lower(F.coalesce("autocomplete", F.lit(""))), r"\s+")
    out = F.when(~holds_free_text(), F.lit(None).cast(HIT)).when(kind == "password", hit("password", CONFIDENCE["declared_password"], "input type is password"))
    for category, known in AUTOCOMPLETE.items():
        out = out.when(F.arrays_overlap(tokens, F.array(*map(F.lit, known))), hit(category, CONFIDENCE["autocomplete"], f"autocomplete declares {category}"))
    for declared, category in INPUT_TYPES.items():
        out = out.when(kind == declared, hit(category, CONFIDENCE["input_type"], f"input type is {declared}"))
    for category, pattern in FIELD_TEXT.items():
        out = out.when(searchable_text().rlike(java(pattern)), hit(category, CONFIDENCE["pattern"], f"field text matched {category} pattern"))
    return F.when(F.col("element_type") == "input", out)


def _severity(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), category)


def reconciled(declared: Column, content: Column) -> Column:
    """Where content disagrees, the more severe category, the higher confidence, both reasons."""
    agree = content.isNull() | (content["category"] == declared["category"])
    stronger = _severity(declared["category"]) >= _severity(content["category"])
    both = hit(F.when(stronger, declared["category"]).otherwise(content["category"]), F.greatest(declared["confidence"], content["confidence"]), F.concat(declared["reason"], F.lit(", content looks like "), content["category"]))
    return F.when(agree, declared).otherwise(both)


def detect(elements: DataFrame, given_names: Sequence[str] = ()) -> DataFrame:
    """(page_id, ord, region_id, category, source, confidence, element_id, reason, position)."""
    typed = F.col("element_type")
    readable = F.when(typed.isin("input", "text") & (F.col("value") != ""), F.col("value"))
    rows = elements.where(typed.isin("input", "text")).withColumn("_content", F.when(readable.isNotNull(), classify_text(readable, given_names))).withColumn("_declared", classify_field())
    author = F.lower(F.coalesce("input_type", F.lit(""))).isin(*AUTHOR_SUPPLIED)
    hidden = F.when(~author, hit("other", CONFIDENCE["unidentified"], "field holds content that matched no rule; hidden by default"))
    undeclared = F.when(readable.isNotNull() & holds_free_text(), F.coalesce("_content", hidden))
    by_input = F.when(F.col("_declared").isNotNull(), reconciled(F.col("_declared"), F.col("_content"))).otherwise(undeclared)
    by_text = F.when(readable.isNotNull(), F.coalesce("_content", classify_header(F.col("column_header"))))
    found = rows.withColumn("_hit", F.when(typed == "input", by_input).otherwise(by_text)).where("_hit is not null")
    return found.select("page_id", "ord", F.concat(F.lit("dom-"), "element_id").alias("region_id"), "_hit.category", F.lit("dom").alias("source"), "_hit.confidence", "element_id", "_hit.reason", "position")


def detect_texts(rows: DataFrame, text: str = "text", given_names: Sequence[str] = ()) -> DataFrame:
    """``rows`` whose text has personal data, with category, confidence and reason."""
    body = F.coalesce(F.col(text), F.lit(""))
    return rows.withColumn("_hit", classify_text(body, given_names)).where("_hit is not null").select(*rows.columns, "_hit.category", "_hit.confidence", "_hit.reason")




def categorised(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` whose text has personal data, with its category alone: the quick way to tallies, classes and manifests."""
    return rows.withColumn("category", category_of(F.coalesce(F.col(text), F.lit("")))).where("category is not null").select(*rows.columns, "category")

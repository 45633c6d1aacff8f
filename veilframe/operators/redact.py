"""Redacted elements, the manifest, and the seal without which nothing may be written."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.patterns import HAS_VALUE
from veilframe.functions.text import TOKENS, placeholder, scrub_text

#: Raw values shorter than this are too common to look for in a payload.
LEAST_LEAK = 4


def first_region(regions: DataFrame) -> DataFrame:
    """(page_id, element_id, category): the first region of each element."""
    first = regions.where("element_id is not null").groupBy("page_id", "element_id").agg(F.min_by("category", "ord").alias("category"))
    return first


def redact(elements: DataFrame, regions: DataFrame, given_names: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Every element, with flagged values replaced by tokens and all labels scrubbed.

    ``strict`` scrubs the values that no region flags too; without it they stay as they are.
    """
    joined = elements.join(first_region(regions), ["page_id", "element_id"], "left")
    plain = scrub_text(F.col("value"), given_names) if strict else F.col("value")
    value = F.when(F.col("category").isNotNull(), placeholder(F.col("category"))).otherwise(plain)
    label = F.when(F.col("label").isNotNull(), scrub_text(F.col("label"), given_names))
    filled = F.coalesce(F.col("value") != "", F.lit(False))
    kept = [c for c in ("row",) if c in elements.columns]
    return joined.select("page_id", "ord", "element_id", "element_type", label.alias("label"), value.alias("value"), filled.alias("filled"), *kept, "position")


def manifest(regions: DataFrame) -> DataFrame:
    return regions.select("page_id", "ord", "region_id", "category", F.col("source").alias("method"))


def flagged_values(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, element_id, raw): the values that must not leave."""
    flagged = regions.where("element_id is not null").select("page_id", "element_id")
    return elements.join(flagged, ["page_id", "element_id"], "left_semi").where("value is not null").select("page_id", "element_id", F.col("value").alias("raw"))


def unreplaced(redacted: DataFrame, regions: DataFrame) -> DataFrame:
    """Flagged elements whose value is neither null nor a token."""
    flagged = regions.where("element_id is not null").select("page_id", "element_id")
    return redacted.join(flagged, ["page_id", "element_id"], "left_semi").where(F.col("value").isNotNull() & ~F.col("value").isin(*TOKENS))


def payloads(redacted: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, payload): one JSON text per page, elements and manifest in order."""
    entry = F.struct("ord", F.struct(*[c for c in redacted.columns if c not in ("page_id", "ord")]).alias("entry"))
    summary = redacted.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    rows = manifest(regions).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "region_id", "category", "method"))).alias("m"))
    whole = F.to_json(F.struct(F.transform("e", lambda x: x["entry"]).alias("elements"), F.transform(F.coalesce("m", F.array()), lambda x: F.struct(x["region_id"], x["category"], x["method"])).alias("manifest")))
    return summary.join(rows, "page_id", "left").select("page_id", whole.alias("payload"))


def held_values(payload: str, raws: Sequence[str]) -> list[str]:
    """The raw values that a payload holds, as they are or as JSON writes them, by one pass over it: an automaton of all of them."""
    import ahocorasick

    forms: dict[str, set[str]] = {}
    for raw in raws:
        for form in (raw, json.dumps(raw, ensure_ascii=False)[1:-1]):
            forms.setdefault(form, set()).add(raw)
    if not forms:
        return []
    automaton = ahocorasick.Automaton()
    for form, own in forms.items():
        automaton.add_word(form, own)
    automaton.make_automaton()
    found: set[str] = set()
    for _, own in automaton.iter(payload):
        found |= own
    return sorted(found)


def leaks(sent: DataFrame, raw: DataFrame) -> DataFrame:
    """(page_id, leaked): raw values of a page that its own payload still holds, in order, one array per page with any.

    A page's payload and values are one row of an Arrow batch, searched in time of their lengths together.
    """
    worth = raw.where((F.length("raw") >= LEAST_LEAK) & (F.col("raw") != HAS_VALUE) & ~F.col("raw").isin(*TOKENS))
    per_page = worth.groupBy("page_id").agg(F.collect_set("raw").alias("raws"))
    rows = sent.join(per_page, "page_id").select("page_id", "payload", "raws")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held_values(p or "", r) for p, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["page_id", "leaked"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, leaked array<string>").where(F.size("leaked") > 0)


@dataclass(frozen=True)
class Sealed:
    """Payloads that passed the leak check. Only ``seal`` makes one, and sinks take nothing else."""

    frame: DataFrame
    refused: DataFrame


def seal(elements: DataFrame, regions: DataFrame, given_names: Sequence[str] = ()) -> Sealed:
    """Payloads of pages without leaks; pages with one, or without any element, are refused whole."""
    redacted = redact(elements, regions, given_names)
    sent = payloads(redacted, regions)
    bad = leaks(sent, flagged_values(elements, regions)).select("page_id").union(unreplaced(redacted, regions).select("page_id")).distinct()
    return Sealed(sent.join(bad, "page_id", "left_anti"), sent.join(bad, "page_id", "left_semi"))


def write(sealed: Sealed, path: str) -> None:
    if not isinstance(sealed, Sealed):
        raise TypeError("only sealed payloads may be written")
    sealed.frame.write.mode("overwrite").parquet(path)


def budgeted(elements: DataFrame, budget: int = 300) -> DataFrame:
    """All inputs and buttons of a page, then other elements up to ``budget`` in all, in order; ``truncated`` tells if any went."""
    passive = (~F.col("element_type").isin("input", "button")).cast("int")
    page = Window.partitionBy("page_id")
    ranked = elements.withColumn("_rank", F.row_number().over(page.orderBy(passive, "ord"))).withColumn("_active", F.sum(1 - passive).over(page)).withColumn("_n", F.count(F.lit(1)).over(page))
    most = F.greatest(F.lit(budget), F.col("_active"))
    return ranked.where(F.col("_rank") <= most).withColumn("truncated", F.col("_n") > most).drop("_rank", "_active", "_n")

"""Requests as they arrive: raw bodies checked against a shape, each fault a row of a quarantine, valid ones typed.

A body that is no JSON, and one that is not of the shape, are both refused, the latter under its own id if it has one. Each
row is judged by itself; nothing is shuffled. Unknown names are ignored unless the shape is closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import jsons
from veilframe.functions.jsons import Flag, Many, Number, Shape, Text

# Fixed values of the request format.
CATEGORIES = ("password", "name", "email", "phone", "address", "face", "id_number", "other")
RECT = Shape({c: Number() for c in ("x", "y", "width", "height")})
ENTRY = Shape(
    {"elementId": Text(), "elementType": Text(among=("input", "button", "text", "image", "other")), "label": Text(), "value": Text(), "filled": Flag(), "row": Number(1, 10_000, integer=True), "position": RECT},
    optional=frozenset(("label", "value", "row")),
    defaulted=frozenset(("filled",)),
)
REGION = Shape({"regionId": Text(), "category": Text(among=CATEGORIES), "method": Text(among=("dom", "visual", "ocr", "manual"))})
REQUEST = Shape({"request_id": Text(), "task_query": Text(1, 500), "redacted_frame": Text(), "redacted_dom_summary": Many(ENTRY), "redaction_manifest": Many(REGION)})
NO_JSON, MALFORMED = "not JSON", "MALFORMED_REQUEST"


def judged(raw: DataFrame, shape: Shape = REQUEST, value: str = "value") -> DataFrame:
    """``raw`` with ``parsed``, the body as VARIANT or null, and ``faults`` (empty if the body fits)."""
    rows = jsons.once(raw, parsed=jsons.whole(F.col(value)))
    none = F.array(F.struct(F.lit("").alias("path"), F.lit(NO_JSON).alias("fault")))
    return jsons.once(rows, faults=F.when(F.col("parsed").isNull(), none).otherwise(jsons.faults(shape, F.col("parsed"), F.lit(""))))


def validated(raw: DataFrame, shape: Shape = REQUEST, value: str = "value") -> DataFrame:
    """``raw`` with ``faults`` (empty if the body fits) and ``body``, typed, or null."""
    return jsons.once(judged(raw, shape, value), body=F.when(F.size("faults") == 0, shape.typed(F.col("parsed")))).drop("parsed")


def quarantined(judged: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, path, fault): a row for each fault of what ``judged`` or ``validated`` refused."""
    return judged.select(*keys, F.posexplode("faults").alias("n", "f")).select(*keys, "n", "f.path", "f.fault")


def refusals(judged: DataFrame, *keys: str, value: str = "value", name: str = "request_id") -> DataFrame:
    """(keys, request_id, error_code, status): how each refused body is answered; without a text as its id, by an empty one."""
    body = F.col("parsed") if "parsed" in judged.columns else jsons.whole(F.col(value))
    own = F.coalesce(jsons.as_text(jsons.member(body, name)), F.lit(""))
    return judged.where(F.size("faults") > 0).select(*keys, own.alias("request_id"), F.lit(MALFORMED).alias("error_code"), F.lit(400).alias("status"))

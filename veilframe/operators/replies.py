"""Replies of a model: the JSON object in a text, and whether its action is one that may be taken.

A reply names one element of its page, so checking it is a join by page and element; evidence is exploded
and joined the same way. Every refused reply keeps the reason in ``refused``; the first reason that holds, in
the order below, counts. Null and empty texts hold no object. What stands from the first brace to the last has to be one JSON
object as a whole, and its values count only as the kind that they have: nothing is read as a text that is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import jsons
from veilframe.functions.patterns import PLACEHOLDER
from veilframe.functions.text import let
from veilframe.operators.decide import CREDENTIAL_REFERENCE, optional_opt_in

# Fixed values of the format.
ALLOWED_ACTIONS = ("click", "type", "scroll")
MOST_SUMMARY, MOST_VALUE, MOST_TASK, UNSURE = 300, 200, 500, 0.5
FAILURE_WORDS = ("pending", "missing", "mismatch", "expired", "unclear", "rejected", "failed", "incomplete", "hold", "blocked", "overdue", "awaiting", "not", "unpaid", "unverified", "invalid", "high", "medium")
REASONING = r"(?is)<(think|thought|thinking)>.*?</\1>"
NO_SUMMARY = "The assistant did not explain its choice."
CREDENTIALS = r"AIza[0-9A-Za-z_-]{27,}|sk-[A-Za-z0-9_-]{20,}"


def holds_credential(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(CREDENTIALS)


def truncated(text: Column, limit: int = MOST_VALUE) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("...(truncated)"))).otherwise(text)


def clean_summary(text: Column) -> Column:
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(squeezed == "", NO_SUMMARY).otherwise(F.substring(squeezed, 1, MOST_SUMMARY))


def parsed(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """``replies`` with ``body`` (null without one) and ``refused``: the object from the first brace to the last, outside reasoning."""
    text = F.regexp_replace(F.coalesce(F.col(reply), F.lit("")), REASONING, "")
    open_end = F.lower(text).rlike("<(think|thought|thinking)>")
    span = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    why = F.when(open_end, "ended inside its reasoning").when(span == "", "no object")
    rows = jsons.once(replies, _span=span, _why=why)
    rows = jsons.once(rows, _v=F.when(F.col("_why").isNull(), jsons.whole(F.col("_span"))))
    refused = F.coalesce("_why", F.when(F.coalesce(jsons.kind(F.col("_v")) != "object", F.lit(True)), "not valid"))
    rows = jsons.once(rows, refused=refused, body=let(F.col("_v"), _body))
    return rows.withColumn("body", F.when(F.col("refused").isNull(), F.col("body"))).drop("_span", "_why", "_v")


def _body(v: Column) -> Column:
    said = lambda x, name: jsons.as_text(jsons.member(x, name)).alias(name)

    def action(x):
        other = F.coalesce(~jsons.kind(jsons.member(x, "value")).isin("text", "null"), F.lit(False))
        return F.when(jsons.kind(x) == "object", F.struct(said(x, "type"), said(x, "selector"), said(x, "value"), other.alias("other_value")))

    return F.struct(said(v, "status"), let(jsons.member(v, "action"), action).alias("action"), jsons.as_number(jsons.member(v, "confidence")).alias("confidence"), said(v, "reasoning_summary"), jsons.member(v, "evidence").alias("evidence"))


def interpreted(replies: DataFrame, elements: DataFrame, reply: str = "reply", key: str = "reply_id") -> DataFrame:
    """(reply_id, page_id, action, element_id, value, confidence, summary, refused) for every reply (reply_id, page_id, task, reply)."""
    rows = parsed(replies, reply)
    known = elements.select(F.col("page_id").alias("_page"), F.col("element_id").alias("_id"), F.col("value").alias("_value"), F.col("row").alias("_row"), optional_opt_in().alias("_extra"))
    rows = rows.withColumn("_selector", F.col("body.action.selector"))
    met = rows.join(known, (F.col("page_id") == F.col("_page")) & (F.col("_selector") == F.col("_id")), "left")
    act, value = F.col("body.action.type"), F.col("body.action.value")
    refusal = (
        F.when(F.col("refused").isNotNull(), F.col("refused"))
        .when(F.col("body.status") == "needs_more_context", None)
        .when(~F.coalesce(F.col("body.status") == "action_ready", F.lit(False)), "no recognised status")
        .when(F.col("body.action").isNull(), "no action")
        .when(~F.coalesce(act.isin(*ALLOWED_ACTIONS), F.lit(False)), "action not allowed")
        .when(F.col("_id").isNull(), "element not in the page")
        .when(F.col("body.action.other_value"), "value is no text")
        .when((act != "type") & (F.coalesce(value, F.lit("")) != ""), "value for an action that takes none")
        .when((act == "type") & (F.coalesce(value, F.lit("")) == ""), "nothing to type")
        .when((act == "type") & (value != CREDENTIAL_REFERENCE) & F.coalesce(F.col("_value").isin(*PLACEHOLDER.values()), F.lit(False)), "literal for a redacted field")
        .when((act == "type") & (value != CREDENTIAL_REFERENCE) & F.startswith(value, F.lit("[")) & F.endswith(value, F.lit("]")), "placeholder typed")
        .when((act == "click") & F.col("_extra"), "optional box")
    )
    checked = met.withColumn("refused", refusal)
    asked = checked.where(F.col("refused").isNull() & (F.col("body.status") == "action_ready") & (act == "click") & F.col("_row").isNotNull())
    bad = refused_evidence(asked.select(F.col(key).alias("_reply"), "page_id", "task", F.col("_row").alias("row"), F.col("body.evidence").alias("evidence")), elements)
    out = checked.join(bad, F.col(key) == F.col("_reply"), "left").withColumn("refused", F.coalesce("refused", "_bad"))
    ready = F.col("refused").isNull() & (F.col("body.status") == "action_ready")
    sure = F.col("body.confidence")
    shown = lambda c: F.when(ready, c)
    return out.select(
        key,
        "page_id",
        shown(act).alias("action"),
        shown(F.col("_selector")).alias("element_id"),
        shown(F.when(act == "type", value)).alias("value"),
        F.when(ready, F.when(sure.between(0, 1), sure).otherwise(UNSURE)).otherwise(F.when(F.col("refused").isNull(), 0.0)).alias("confidence"),
        F.when(F.col("refused").isNull(), clean_summary(F.col("body.reasoning_summary"))).alias("summary"),
        "refused",
    )


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def refused_evidence(clicks: DataFrame, elements: DataFrame) -> DataFrame:
    """(_reply, _bad) for clicks in a row (_reply, page_id, task, row, evidence: VARIANT) whose evidence does not hold.

    Every cited element has to be on the page, in the clicked row, to contain the quoted words, and to show no word of
    failure that the task does not name. Of several faults the first in the list counts.
    """
    items = clicks.withColumn("_items", jsons.items(F.col("evidence")))
    none = items.where("_items is null").select("_reply", F.lit("no evidence").alias("_bad"))
    cited = items.where("_items is not null").select("_reply", "page_id", "task", "row", F.posexplode("_items").alias("_n", "_x"))
    named = F.struct(F.try_variant_get(jsons.member(F.col("_x"), "elementId"), "$", "string").alias("elementId"), jsons.as_text(jsons.member(F.col("_x"), "text")).alias("text"))
    cited = cited.select("_reply", "page_id", "task", "row", "_n", (jsons.kind(F.col("_x")) == "object").alias("_is"), named.alias("_item"))
    known = elements.select(F.col("page_id").alias("_page"), F.col("element_id").alias("_id"), F.col("row").alias("_row"), F.lower(F.concat_ws(" ", F.nullif(F.col("value"), F.lit("")), F.nullif(F.col("label"), F.lit("")))).alias("_said"))
    met = cited.join(known, (F.col("page_id") == F.col("_page")) & (F.col("_item.elementId") == F.col("_id")), "left")
    quoted = _squeezed(F.coalesce("_item.text", F.lit("")))
    failing = F.exists(F.array(*map(F.lit, FAILURE_WORDS)), lambda w: F.regexp_like(F.col("_said"), F.concat(F.lit(r"\b"), w, F.lit(r"\b"))) & ~F.regexp_like(F.lower("task"), F.concat(F.lit(r"\b"), w, F.lit(r"\b"))))
    fault = (
        F.when(~F.col("_is"), "evidence is no list of elements")
        .when(F.col("_id").isNull() | (quoted == ""), "cited element not on the page")
        .when(~F.col("_row").eqNullSafe(F.col("row")), "evidence from another row")
        .when(~F.contains(_squeezed(F.col("_said")), quoted), "quoted words not there")
        .when(failing, "evidence shows an unmet condition")
    )
    first = met.withColumn("_fault", fault).where("_fault is not null").groupBy("_reply").agg(F.min_by("_fault", "_n").alias("_bad"))
    return none.union(first)


def first_answer(attempts: DataFrame, key: str = "request_id", rank: str = "attempt") -> DataFrame:
    """The first attempt of each request that was not refused (request, attempt, path, refused), with the reasons of those before it."""
    good = F.col("refused").isNull()
    return attempts.groupBy(key).agg(
        F.min_by(F.when(good, F.col("path")), F.when(good, F.col(rank))).alias("path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~good, F.struct(rank, "refused")))), lambda x: x["refused"]), "; ").alias("fell_back_because"),
    )


#: Codes of errors that a client tells apart; any other counts as none of them.
ERROR_CODES = ("MALFORMED_REQUEST", "MODEL_UNAVAILABLE", "ACTION_REJECTED", "INTERNAL_ERROR")


def responses(bodies: DataFrame, value: str = "value") -> DataFrame:
    """``bodies`` with what a client makes of each: request_id, outcome, action, selector, typed, summary, refused.

    ``outcome`` is ``action``, ``needs_more_context`` or ``refused``. A body has to be one JSON object as a whole; a value that is no
    text counts as none, and so does a request's id.
    """
    rows = jsons.once(bodies, _v=jsons.whole(F.col(value)))
    text = lambda v, name: jsons.as_text(jsons.member(v, name))

    def told(v):
        a = let(jsons.member(v, "action"), lambda x: F.when(jsons.kind(x).isin("object", "list"), F.struct(text(x, "type").alias("type"), text(x, "selector").alias("selector"), text(x, "value").alias("value"))))
        return F.struct((F.coalesce(jsons.kind(v), F.lit("")).isin("object", "list")).alias("is"), F.coalesce(text(v, "request_id"), F.lit("")).alias("request_id"), text(v, "status").alias("status"), text(v, "error_code").alias("code"), a.alias("action"), text(v, "reasoning_summary").alias("summary"))

    rows = jsons.once(rows, _t=let(F.col("_v"), told))
    t, status = F.col("_t"), F.col("_t.status")
    refused = (
        F.when(F.col("_v").isNull(), "not JSON")
        .when(~t["is"], "not an object")
        .when(status == "error", F.concat(F.lit("error "), F.when(t["code"].isin(*ERROR_CODES), t["code"]).otherwise("of no known code")))
        .when(status == "needs_more_context", None)
        .when(F.coalesce(status != "action_ready", F.lit(True)), "unknown status")
        .when(t["action"].isNull(), "no action")
        .when(~F.coalesce(F.col("_t.action.type").isin(*ALLOWED_ACTIONS), F.lit(False)), "action not allowed")
        .when(F.coalesce(F.col("_t.action.selector"), F.lit("")) == "", "no selector")
    )
    rows = rows.withColumn("refused", refused)
    acts = F.col("refused").isNull() & (status == "action_ready")
    outcome = F.when(F.col("refused").isNotNull(), "refused").when(acts, "action").otherwise("needs_more_context")
    shown = lambda c: F.when(acts, c)
    return rows.select(*bodies.columns, t["request_id"].alias("request_id"), outcome.alias("outcome"), shown(F.col("_t.action.type")).alias("action"), shown(F.col("_t.action.selector")).alias("selector"), shown(F.col("_t.action.value")).alias("typed"), F.when(F.col("refused").isNull(), t["summary"]).alias("summary"), "refused")

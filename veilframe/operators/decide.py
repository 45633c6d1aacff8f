"""Next actions on redacted pages by rule: what form a page holds, and what step finishes it.

``elements`` is one table of redacted entries: page_id, ord (document order), element_id, element_type,
label, value, filled, position. Everything is an aggregate per page: two groupings, one join of the buttons
with their page's aggregates, no page collected. A page without elements has no row and no decision. Null
labels count as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
PASSWORD_TOKEN = "[PASSWORD]"
IDENTITY_TOKENS = ("[EMAIL]", "[NAME]", "[PHONE]", "[ADDRESS]", "[ID_NUMBER]")
CREDENTIAL_REFERENCE = "[USE_SAVED_CREDENTIAL]"
LOGIN_WORDS = ("sign in", "signin", "log in", "login")
SIGNUP_WORDS = ("create account", "create my account", "create your account", "sign up", "signup", "register", "get started", "join now")
NEUTRAL_WORDS = ("submit", "continue", "next")
CHECKED, UNCHECKED = "checked", "unchecked"
CONSENT_PHRASES = ("terms", "privacy policy", "conditions", "i agree", "i accept", "agree to", "accept the")
OPTIONAL_PHRASES = ("newsletter", "marketing", "promotion", "offers", "updates", "announcements", "send me", "email me", "subscribe", "keep me")
INLINE_PX, SIGNUP_KINDS = 8, 3
FINAL_WORDS = r"(?i)\b(approve|approved|reject|decline|submit|confirm|pay|payment|transfer|send|sign in|log in|login|sign up|signup|register|create (?:an |my |your )?account|place order|order now|buy|purchase|book|delete|remove|save|apply|accept offer|checkout|check out|release|disburse|sanction|shortlist|admit|hold|refund|resolve|close ticket|escalate|cancel)\b"


def label_of(label: str | Column = "label") -> Column:
    return F.lower(F.trim(F.coalesce(F.col(label) if isinstance(label, str) else label, F.lit(""))))


def says(label: Column, words: Sequence[str]) -> Column:
    """Whether any of ``words`` is a part of ``label``."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(label, F.lit(w))
    return found


def unticked() -> Column:
    return (F.col("element_type") == "input") & (F.coalesce("value", F.lit("")) == UNCHECKED)


def optional_opt_in() -> Column:
    """Whether an entry is an unticked box for something extra."""
    return unticked() & says(label_of(), OPTIONAL_PHRASES)


def required_consent() -> Column:
    """Whether an entry is an unticked box that the form needs; wording of an extra disqualifies it."""
    return unticked() & ~says(label_of(), OPTIONAL_PHRASES) & says(label_of(), CONSENT_PHRASES)


def final_click(label: Column, value: Column) -> Column:
    """Whether a button's words commit to something."""
    return F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(value, F.lit(""))).rlike(FINAL_WORDS)


def page_facts(elements: DataFrame) -> DataFrame:
    """Per page what the rules need to know of its fields: counts, first ones in document order, lower edges."""
    bottom = F.col("position.y") + F.col("position.height")
    field = F.col("element_type") == "input"
    password = field & (F.coalesce("value", F.lit("")) == PASSWORD_TOKEN)
    identity = field & F.coalesce("value", F.lit("")).isin(*IDENTITY_TOKENS)
    first = lambda which: F.min_by(F.when(which, F.col("element_id")), F.when(which, F.col("ord")))
    return elements.groupBy("page_id").agg(
        F.count_if(password).alias("passwords"),
        F.count_if(password & F.col("filled")).alias("filled_passwords"),
        first(password & ~F.col("filled")).alias("empty_password"),
        F.count_if(identity).alias("identities"),
        F.count_distinct(F.when(identity, F.col("value"))).alias("identity_kinds"),
        F.count_if(identity & ~F.col("filled")).alias("empty_identities"),
        F.max(F.when(password, bottom)).alias("password_bottom"),
        F.max(F.when(password | identity, bottom)).alias("field_bottom"),
        first(required_consent()).alias("consent"),
        F.max_by("element_id", F.struct(bottom, -F.col("ord"))).alias("lowest"),
    )


def form_kind() -> Column:
    """login, signup or null, of a row of ``page_facts``."""
    both = (F.col("passwords") > 0) & (F.col("identities") > 0)
    return F.when(both, F.when((F.col("passwords") >= 2) | (F.col("identity_kinds") >= SIGNUP_KINDS), "signup").otherwise("login"))


def empty_field_note(count: Column) -> Column:
    one = F.lit(" One personal field is still empty; no value will be invented for it.")
    return F.when(count == 0, "").when(count == 1, one).otherwise(F.concat(F.lit(" "), count.cast("string"), F.lit(" personal fields are still empty; no values will be invented for them.")))


def decisions(elements: DataFrame) -> DataFrame:
    """(page_id, form, action, element_id, value, confidence, note) for every page: the step that the rules take, or none."""
    facts = page_facts(elements).withColumn("form", form_kind())
    edge = F.when(F.col("form") == "login", F.col("password_bottom")).otherwise(F.col("field_bottom"))
    wanted = facts.where("form is not null").select("page_id", "form", edge.alias("edge"))
    buttons = elements.where("element_type = 'button'").join(wanted, "page_id").where(F.col("position.y") + F.col("position.height") >= F.col("edge") - INLINE_PX)
    words = label_of()
    own = F.when(F.col("form") == "login", says(words, LOGIN_WORDS)).otherwise(says(words, SIGNUP_WORDS))
    nearest = lambda which: F.min_by(F.when(which, F.col("element_id")), F.when(which, F.struct("position.y", "ord")))
    submits = buttons.groupBy("page_id").agg(F.coalesce(nearest(own), nearest(says(words, NEUTRAL_WORDS))).alias("submit"))
    rows = facts.join(submits, "page_id", "left")
    login, signup = F.col("form") == "login", F.col("form") == "signup"
    undecided = signup & F.col("empty_password").isNotNull() & (F.col("filled_passwords") < 2)
    take = lambda action, element, confidence: F.struct(F.lit(action).alias("action"), F.col(element).alias("element_id"), F.lit(confidence).alias("confidence"))
    step = (
        F.when(login & F.col("empty_password").isNotNull(), take("type", "empty_password", 0.9))
        .when(login & F.col("submit").isNotNull(), take("click", "submit", 0.9))
        .when(signup & ~undecided & F.col("consent").isNotNull(), take("click", "consent", 0.85))
        .when(signup & ~undecided & F.col("submit").isNotNull(), take("click", "submit", 0.85))
        .when(signup & ~undecided, take("scroll", "lowest", 0.6))
    )
    submitting = signup & (F.col("step.element_id") == F.col("submit")) & F.col("consent").isNull()
    done = rows.withColumn("step", step)
    return done.select(
        "page_id",
        "form",
        "step.action",
        "step.element_id",
        F.when(F.col("step.action") == "type", CREDENTIAL_REFERENCE).alias("value"),
        F.coalesce("step.confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.coalesce(submitting, F.lit(False)), empty_field_note(F.col("empty_identities"))).otherwise("").alias("note"),
    )

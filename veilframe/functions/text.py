"""Identifier spans, content classes and scrubbing of text, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.checks import digits, id_holds, id_verified
from veilframe.functions.patterns import CHECKED_IDS, COLUMN_HEADERS, CONFIDENCE, CONTENT_PATTERNS, CUES, HAS_VALUE, ID_LABEL, ID_PATTERNS, ID_SEVERITY, PHONE_DIGITS, PHONE_DIGITS_WITH_CODE, PLACEHOLDER, SPACE, java

HIT = "struct<category:string,confidence:double,reason:string>"
SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<start, end, value>> of all matches: each begins after all gaps and matches before it."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda p: p["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc, p):
        at = acc["at"] + F.length(p["g"])
        end = at + F.length(p["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("end"), p["m"].alias("value")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def id_spans(text: Column) -> Column:
    """ARRAY of spans by kind in precedence; a match that overlaps a span taken earlier is left out."""
    taken = F.array().cast(f"array<{SPAN}>")
    for kind, pattern in ID_PATTERNS.items():
        cue = (text.contains("@") if kind == "upi" else text.rlike(r"\d{4}")) & text.rlike(java(pattern))
        own = F.transform(matches(text, java(pattern)), _as_kind(kind))
        add = lambda acc, m: F.when(F.exists(acc, lambda s: (m["start"] < s["end"]) & (m["end"] > s["start"])), acc).otherwise(F.concat(acc, F.array(m)))
        taken = F.aggregate(F.when(cue, own).otherwise(F.array().cast(f"array<{SPAN}>")), taken, add)
    return F.when(text.rlike(r"\d{4}|@"), taken).otherwise(F.array().cast(f"array<{SPAN}>"))


def _as_kind(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))


def competing_kinds(kind: Column, value: Column) -> Column:
    """Other kinds whose pattern the whole value fits, those with a checksum only if it holds, in precedence."""
    fits = [F.when((kind != k) & value.rlike(f"^(?:{java(p)})$") & (id_holds(k, value) if k in CHECKED_IDS else F.lit(True)), F.lit(k)) for k, p in ID_PATTERNS.items()]
    return F.array_compact(F.array(*fits))


def found_ids(text: Column) -> Column:
    """Spans with ``verified`` and, for those that are not, ``alternatives``."""
    none = F.array().cast("array<string>")

    def judge(s):
        ok = id_verified(s["kind"], s["value"])
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), ok.alias("verified"), F.when(ok, none).otherwise(competing_kinds(s["kind"], s["value"])).alias("alternatives"))

    return F.transform(id_spans(text), judge)


def strongest_id(ids: Column) -> Column:
    """The identifier with the highest severity, verified ones before others, the first of equals; null if there is none."""
    rank = lambda s, i: F.struct((F.element_at(_literal_map(ID_SEVERITY), s["kind"]) * 2 + s["verified"].cast("int")).alias("score"), (-i).alias("order"), s.alias("id"))
    return F.array_max(F.transform(ids, rank))["id"]


def described_id(id_: Column) -> Column:
    """The labels of an identifier's kind and alternatives: "A, B or C"."""
    names = F.transform(F.concat(F.array(id_["kind"]), id_["alternatives"]), lambda k: F.element_at(_literal_map(ID_LABEL), k))
    n = F.size(names)
    return F.when(n == 1, F.get(names, F.lit(0))).otherwise(F.concat_ws(" or ", F.array_join(F.slice(names, 1, n - 1), ", "), F.get(names, n - 1)))


def phone_credible(match: Column) -> Column:
    least = F.when(F.startswith(F.trim(match), F.lit("+")), PHONE_DIGITS_WITH_CODE).otherwise(PHONE_DIGITS)
    return F.length(digits(match)) >= least


def person_names(text: Column, given_names: Sequence[str]) -> Column:
    """ARRAY of "Given Surname" pairs: neighbouring capitalised words, only white space between, the first a known given name."""
    if not given_names:
        return F.array().cast("array<string>")

    def pair(p):
        w, after = p["w"], p["after"]
        gap = F.substring(text, w["end"] + 1, after["start"] - w["end"])
        good = after.isNotNull() & F.lower(w["value"]).isin(*given_names) & gap.rlike(f"^[{SPACE}]+$")
        return F.when(good, F.substring(text, w["start"] + 1, after["end"] - w["start"]))

    neighbours = lambda w: F.arrays_zip(w.alias("w"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("after"))
    return F.array_compact(F.transform(let(matches(text, r"\p{Lu}\p{Ll}+"), neighbours), pair))


def hit(category: Column | str, confidence: Column | float, reason: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(category).alias("category"), as_column(confidence).cast("double").alias("confidence"), as_column(reason).alias("reason"))


def classify_text(text: Column, given_names: Sequence[str] = ()) -> Column:
    """STRUCT<category, confidence, reason> of visible text, or null.

    The strongest identifier decides, then the content patterns in order (a phone only by its first match,
    if credible), then a known given name with a surname.
    """
    by_id = let(strongest_id(found_ids(text)), lambda b: F.when(b.isNotNull(), hit("id_number", F.when(b["verified"], CONFIDENCE["checksum"]).otherwise(CONFIDENCE["pattern"]), F.concat(F.lit("visible text matched "), described_id(b), F.lit(" format")))))
    out = F.when(F.lit(False), F.lit(None).cast(HIT))
    for category, pattern in CONTENT_PATTERNS.items():
        fits = text.rlike(java(CUES[category])) & text.rlike(java(pattern))
        if category == "phone":
            fits = fits & phone_credible(F.regexp_extract(text, java(pattern), 0))
        out = out.when(fits, hit(category, CONFIDENCE["pattern"], f"visible text matched {category} format"))
    if given_names:
        out = out.when(F.size(person_names(text, given_names)) > 0, hit("name", CONFIDENCE["pattern"], "visible text matched a known given name followed by a surname"))
    return F.coalesce(by_id, out)


def category_of(text: Column) -> Column:
    """The category that ``classify_text`` gives a text, or null, without spans: the first kind of identifier with any match
    is always one of the text's, so whether there is one needs no offsets. Compiled with the scan."""
    numbers = F.lit(False)
    for kind, pattern in ID_PATTERNS.items():
        if kind != "upi":
            numbers = numbers | text.rlike(java(pattern))
    out = F.when((text.rlike(r"\d{4}") & numbers) | (text.contains("@") & text.rlike(java(ID_PATTERNS["upi"]))), "id_number")
    for category, pattern in CONTENT_PATTERNS.items():
        fits = text.rlike(java(CUES[category])) & text.rlike(java(pattern))
        if category == "phone":
            fits = fits & phone_credible(F.regexp_extract(text, java(pattern), 0))
        out = out.when(fits, category)
    return out


def classify_header(header: Column) -> Column:
    """STRUCT<category, confidence, reason> for a column's header, or null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(header), r"\([^)]*\)", " "), rf"[^\p{{L}}\p{{N}}'·{SPACE}]", " ")
    plain = F.trim(F.regexp_replace(plain, f"[{SPACE}]+", " "))
    out = None
    for category, pattern in COLUMN_HEADERS.items():
        own = hit(category, CONFIDENCE["pattern"], f"in a column headed like {category}")
        out = F.when(plain.rlike(java(pattern)), own) if out is None else out.when(plain.rlike(java(pattern)), own)
    return out


def _replace_all(text: Column, values: Column, token: str) -> Column:
    """Every occurrence of every value, the longest first, replaced by ``token``."""
    order = F.array_sort(F.transform(values, lambda v, i: F.struct((-F.length(v)).alias("long"), i.alias("i"), v.alias("v"))))
    return F.aggregate(order, text, lambda acc, x: F.replace(acc, x["v"], F.lit(token)))


def _scrub_phones(text: Column) -> Column:
    found, gaps = F.regexp_extract_all(text, F.lit(java(CONTENT_PATTERNS["phone"])), F.lit(0)), F.split(text, java(CONTENT_PATTERNS["phone"]), -1)
    kept = F.transform(found, lambda m: F.when(phone_credible(m), F.lit(PLACEHOLDER["phone"])).otherwise(m))
    return F.array_join(F.flatten(F.zip_with(gaps, kept, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")


def scrub_content(text: Column) -> Column:
    """Content patterns replaced in order, each phone only if it is credible."""
    for category in CONTENT_PATTERNS:
        text = let(text, _scrub_one(category))
    return text


def _scrub_one(category: str):
    replaced = _scrub_phones if category == "phone" else lambda t: F.regexp_replace(t, java(CONTENT_PATTERNS[category]), PLACEHOLDER[category])
    return lambda t: F.when(t.rlike(java(CUES[category])), replaced(t)).otherwise(t)


def scrub_text(text: Column, given_names: Sequence[str] = ()) -> Column:
    """Text with tokens for identifiers (by value, everywhere), content patterns and known names."""
    out = scrub_content(_replace_all(text, F.transform(id_spans(text), lambda s: s["value"]), PLACEHOLDER["id_number"]))
    return let(out, lambda t: _replace_all(t, person_names(t, given_names), PLACEHOLDER["name"])) if given_names else out


def placeholder(category: Column) -> Column:
    return F.element_at(_literal_map(PLACEHOLDER), category)


TOKENS = (*PLACEHOLDER.values(), HAS_VALUE)

#: Characters that a reader of images takes for digits.
LOOKALIKES = ("OoDIliSsBZzG", "000111558226")


def digit_variant(text: Column) -> Column:
    """Words of four or more characters made of digits and lookalikes alone, read as digits."""
    read = lambda w: F.when((F.length(w) >= 4) & w.rlike(f"^[0-9{LOOKALIKES[0]}]+$"), F.translate(w, *LOOKALIKES)).otherwise(w)
    return F.array_join(F.transform(F.split(text, " ", -1), read), " ")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def same_text(a: Column, b: Column) -> Column:
    """Equal, or one within the other, in normal form; empty forms match nothing."""
    x, y = normalised(a), normalised(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))

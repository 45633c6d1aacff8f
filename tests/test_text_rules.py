import pytest
from pyspark.sql import functions as F

from veilframe.functions import checks, text
from veilframe.operators import detect, redact

NAMES = ("asha", "rahul")


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


def every(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", f(F.col("t")).alias("r"))
    return [r.r for r in rows.orderBy("i").collect()]


VERHOEFF = [("234567890124", True), ("234567890125", False), ("234567809124", False), ("", False)]


def test_verhoeff(spark):
    assert every(spark, [n for n, _ in VERHOEFF], checks.verhoeff_valid) == [g for _, g in VERHOEFF]


LUHN = [("4539578763621486", True), ("4539578763621487", False)]


def test_luhn(spark):
    assert every(spark, [n for n, _ in LUHN], checks.luhn_valid) == [g for _, g in LUHN]


IDENTIFIERS = [
        ("Aadhaar: 2345 6789 0125", [("aadhaar", False, [])]),
        ("Card 4539 5787 6362 1486", [("card", True, [])]),
        ("Ref 4539578763621487", [("card", False, ["bank_account"])]),
        ("GSTIN 27ABCPE1234F1Z5", [("gstin", True, [])]),
        ("Pay shiv@okhdfcbank", [("upi", False, [])]),
        ("shiv@hdfcbank.com", []),
        ("épan ABCPE1234F", [("pan", True, [])]),
        ("", []),
    ]


def test_identifiers(spark):
    for (value, kinds), found in zip(IDENTIFIERS, every(spark, [v for v, _ in IDENTIFIERS], text.found_ids), strict=True):
        assert [(r.kind, r.verified, r.alternatives) for r in found] == kinds
        assert all(value[r.start : r.end] == r.value for r in found)


CLASSES = [
        ("Copyright 2024-2025 Acme Corp", None),
        ("Order 1234-5678 shipped today", None),
        ("Call +91 98765 43210 today", "phone"),
        ("Call (555) 123-4567 today", "phone"),
        ("Call Rs. 98765 43210 now", "phone"),
        ("Please deliver it to 12 Park Street, Kolkata 700016.", "address"),
        ("PIN: 4821", "password"),
        ("mail me at a.b@c.org", "email"),
        ("cost ₹ 1,200.50", "other"),
        ("Asha Kumar", "name"),
        ("1234-5678 then +91 98765 43210", None),
        (None, None),
    ]


def test_classes(spark):
    values = [v for v, _ in CLASSES]
    found, scrubbed = every(spark, values, lambda t: text.classify_text(t, NAMES)), every(spark, values, lambda t: text.scrub_text(t, NAMES))
    assert [f and f.category for f in found] == [c for _, c in CLASSES]
    assert all(s != v for (v, c), s in zip(CLASSES, scrubbed, strict=True) if c)


SCRUB = [
        ("Branch SBIN0001234", "Branch [ID_NUMBER]"),
        ("PIN: 4539578763621486", "[PASSWORD]"),
        ("a 1234-5678 b +91 98765 43210", "a 1234-5678 b [PHONE]"),
        ("met Asha Kumar twice, Asha Kumar!", "met [NAME] twice, [NAME]!"),
        ("Please deliver it to 12 Park Street, Kolkata 700016.", "Please deliver it to [ADDRESS], [ADDRESS]."),
    ]


def test_scrub(spark):
    assert every(spark, [v for v, _ in SCRUB], lambda t: text.scrub_text(t, NAMES)) == [o for _, o in SCRUB]


HEADERS = [("Email", "email"), ("Mobile", "phone"), ("Aadhaar · PAN", "id_number"), ("Customer (s)", "name"), ("Item name", None), ("City", None), (None, None)]


def test_headers(spark):
    found = every(spark, [h for h, _ in HEADERS], text.classify_header)
    assert [f and f.category for f in found] == [c for _, c in HEADERS]


def test_lookalike_digits(spark):
    assert one(spark, "OOOO 12IS abc so", text.digit_variant) == "0000 1215 abc so"


COLUMNS = "page_id string, ord int, element_id string, element_type string, label string, value string, input_type string, autocomplete string, name string, placeholder string, column_header string, position struct<x:double,y:double,width:double,height:double>"


def elements(spark):
    rows = [
        ("e0", "input", "User", "a@b.org", "text", "username", None, None, None),
        ("e1", "input", "Password", "[has value]", "password", None, None, None, None),
        ("e2", "input", None, "free", None, None, "q1", None, None),
        ("e3", "input", None, None, None, None, "q1", None, None),
        ("e4", "input", None, "India", "select-one", None, "q1", None, None),
        ("e5", "text", None, "Asha Kumar", None, None, None, None, None),
        ("e6", "text", None, "someone", None, None, None, None, "Customer"),
        ("e7", "button", "mail a@b.org", "x@y.org", None, None, None, None, None),
        ("e8", "input", "Mobile number", "4539578763621486", "tel", None, None, None, None),
        ("e9", "text", None, "nothing here", None, None, None, None, "City"),
    ]
    return spark.createDataFrame([("p", i, *r, (0.0, i * 10.0, 100.0, 10.0)) for i, r in enumerate(rows)], COLUMNS)


def test_detect_redact_seal(spark, tmp_path):
    found = detect.detect(elements(spark), NAMES)
    got = {r.element_id: r for r in found.collect()}
    assert {k: v.category for k, v in got.items()} == {"e0": "email", "e1": "password", "e2": "other", "e5": "name", "e6": "name", "e8": "id_number"}
    assert got["e0"].confidence == 0.9 and got["e0"].reason.endswith("content looks like email") and got["e8"].confidence == 0.95
    out = {r.element_id: r for r in redact.redact(elements(spark), found, NAMES).collect()}
    assert out["e0"].value == "[EMAIL]" and out["e3"].value is None and not out["e3"].filled and out["e7"].value == "x@y.org" and out["e7"].label == "mail [EMAIL]"
    strict = {r.element_id: r.value for r in redact.redact(elements(spark), found, NAMES, strict=True).collect()}
    assert strict["e7"] == "[EMAIL]"
    sealed = redact.seal(elements(spark), found, NAMES)
    assert sealed.frame.count() == 1 and sealed.refused.count() == 0
    redact.write(sealed, str(tmp_path / "out"))
    with pytest.raises(TypeError):
        redact.write(sealed.frame, str(tmp_path / "no"))
    leaky = elements(spark).withColumn("value", F.when(F.col("element_id") == "e9", F.lit("Asha Kumar is here")).otherwise(F.col("value")))
    assert redact.seal(leaky, found, NAMES).refused.count() == 1
    assert redact.manifest(found).count() == 6
    assert redact.budgeted(elements(spark), 7).count() == 7


def test_category_alone_equals_the_whole_class(spark):
    from veilframe.functions.text import category_of, classify_text
    from veilframe.tables import table

    docs = table(spark, "/root/testdata/sf0.01", "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    more = spark.createDataFrame([("pay me@okbank now",), ("2345 6789 0124 55",), ("ABCDE1234F",), ("KA01 2011 0001234",), ("",), ("call 12 345",), ("+49 12345 67890",)], "text string")
    both = docs.union(more).repartition(8).select(classify_text(F.col("text"))["category"].alias("a"), category_of(F.col("text")).alias("b"))
    assert both.where("not (a <=> b)").count() == 0 and both.where("b is not null").count() > 40


def test_exact_median_without_one_task(spark, monkeypatch):
    from veilframe.operators import audit

    monkeypatch.setattr(audit, "SORTED", 10)
    monkeypatch.setattr(audit, "RANGES", 7)
    for values in ([1.0], [1.0, 2.0], [5.0] * 50, [float(x * x % 97) for x in range(301)], [1e9, *map(float, range(100))], []):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        want = sorted(values)
        want = (want[(len(want) - 1) // 2] + want[len(want) // 2]) / 2 if want else None
        assert audit.exact_median(df, "v") == want

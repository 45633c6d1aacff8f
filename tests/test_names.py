import re
import time

from pyspark.sql import functions as F

from veilframe.operators import names

GIVEN = ["priya", "Rohan", "  meera ", "mc", "élodie", None, "", "priya"]


def spans(spark, *texts, given=GIVEN):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([(g,) for g in given], "name string")
    return sorted((r.doc_id, r.start, r.end, r.given, r.value) for r in names.name_spans(docs, table).collect())


def test_where_a_name_stands(spark):
    texts = [
        "Message Priya Sharma about it",  # a capitalised word before it swallows nothing
        "dear ROHAN GUPTA",  # capitals alone
        "Rohan",
        "rohan Gupta",
        "Rohan gupta",
        "Rohan\n\t Raghunathan",  # any white space
        "Priya, Sharma; Rohan-Das",  # anything else ends it
        "McDonald McDuff",  # "Mc" and "Donald" have nothing between
        "Priya Rohan Meera Das",  # words may serve twice
        "🙂🙂 Élodie Durand",  # code points; accents
        "Kabir Singh",  # not listed
        None,
        "",
    ]
    got = spans(spark, *texts)
    assert got == [
        (0, 8, 20, "priya", "Priya Sharma"),
        (5, 0, 19, "rohan", "Rohan\n\t Raghunathan"),
        (8, 0, 11, "priya", "Priya Rohan"),
        (8, 6, 17, "rohan", "Rohan Meera"),
        (8, 12, 21, "meera", "Meera Das"),
        (9, 3, 16, "élodie", "Élodie Durand"),
    ]
    for k, start, end, _, value in got:
        assert texts[k][start:end] == value
    assert spans(spark, *texts, given=[None, ""]) == [] and spans(spark) == []


def test_a_long_text_and_a_large_table(spark, monkeypatch):
    text = "Priya Sharma and so on. Xeno Yuli " * 60_000
    start = time.time()
    found = spans(spark, text, "x", given=[*GIVEN, *(f"name{k}" for k in range(100_000))])
    assert len(found) == 60_000 and [f[1] for f in found] == [34 * k for k in range(60_000)]
    assert time.time() - start < 60
    docs = spark.createDataFrame([(1, "Priya Sharma")], "doc_id long, text string")
    plan = lambda n: names.name_spans(docs, spark.range(n).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")))._jdf.queryExecution().optimizedPlan().toString()
    size = lambda p: len(re.sub(r"#\d+L?|\d+", "", p))
    assert size(plan(10)) == size(plan(100_000))
    monkeypatch.setattr(names, "BROADCAST_ROWS", 0)  # a vocabulary too large to broadcast
    assert spans(spark, "Message Priya Sharma") == [(0, 8, 20, "priya", "Priya Sharma")]


def test_categories_and_scrubbing_with_names(spark):
    rows = [(1, "Priya Sharma wrote", 7), (2, "mail me@mail.example, Rohan Das", 7), (3, "nobody", 7), (4, "Priya Sharma Rao met Priya Sharma; Sharma Priya", 7), (5, None, 7), (6, "Meera Das. Priya Das Priya Das", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value int")
    table = spark.createDataFrame([(g,) for g in GIVEN], "name string")
    told = {r.doc_id: r.category for r in names.categorised_with_names(docs, table).collect()}
    assert told == {1: "name", 2: "email", 4: "name", 6: "name"}
    clean = names.scrubbed(docs, table)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {1: "[NAME] wrote", 2: "mail me@mail.example, [NAME]", 3: "nobody", 4: "[NAME] Rao met [NAME]; Sharma Priya", 5: None, 6: "[NAME]. [NAME] [NAME]"}

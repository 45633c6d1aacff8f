import duckdb
import pytest
from pyspark.sql import functions as F

from veilframe.llm import exact

ROWS = [
    (5, "a"), (3, "a"), (9, "b"), (None, "a"), (None, "only null"), (None, "only null"), (7, None), (8, ""), (1, " "), (2, "A"),
    (4, "x" * 300_000), (6, "x" * 300_000), (11, "x" * 299_999 + "y"), (12, "é"), (13, "é"), (9, "b"), (9, "b"), (14, "b"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0, True, "h") for r in rows], "doc_id long, text string, digest string, n int, kept boolean, hot string")


def by_sql(df):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    return sorted(map(repr, con.sql(exact.ORACLE).fetchall()))


def got(df):
    return sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest)) for r in df.collect())


def test_odd_rows_equal_sql(spark):
    df = frame(spark, ROWS)
    assert got(exact.groups(df)) == by_sql(df)
    assert exact.groups(df.limit(0)).count() == 0 and exact.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("digest", [lambda t: F.substring(t, 1, 1), lambda t: F.lit("same"), lambda t: (F.length(t) % 3).cast("string")])
def test_texts_with_one_digest_are_told_apart(spark, digest):
    df = frame(spark, ROWS + [(100 + k, f"{k % 7}") for k in range(60)])
    want = [r[: r.rindex(",")] for r in by_sql(df)]
    assert sorted(r[: r.rindex(",")] for r in got(exact.groups(df, digest=digest))) == want


def test_hot_texts_of_many_tasks(spark, monkeypatch):
    rows = [(k, "hot" if k % 3 else f"t{k % 50}") for k in range(4000)]
    df = frame(spark, rows).repartition(97)
    want = by_sql(df)
    assert got(exact.groups(df)) == want
    monkeypatch.setattr(exact, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact, "SALTS", 2)
    monkeypatch.setattr(exact, "HOT", 2)
    assert got(exact.groups(df)) == want


def test_smallest_id_and_whole_rows(spark):
    df = frame(spark, ROWS)
    least = {r.doc_id: r.keep_id for r in exact.groups(df, stays="smallest").collect() if r.doc_id is not None}
    assert least[5] == 3 and least[14] == 9 and least[8] == 7 and least[6] == 4 and least[11] == 11
    rows = exact.deduplicated(df)
    assert rows.columns == df.columns
    texts = [r.text or "" for r in rows.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in ROWS})
    ids = {r.text or "": r.doc_id for r in rows.collect()}
    assert ids["a"] == 5 and ids[""] == 8 and ids["b"] == 14 and ids["only null"] is None
    carried = exact.groups(df, carry=[F.col("hot").alias("more")])
    assert {r.more for r in carried.collect()} == {"h"}

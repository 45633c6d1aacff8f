import random

import duckdb
import pytest

from veilframe.llm import mixing


def share_again(sizes, weights, budget, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, target, free = sum(sizes.values()) * budget, dict.fromkeys(names, 0.0), set(names)
    while free:
        total = sum(w[n] for n in free)
        over = {n for n in free if left * w[n] / total > most * sizes[n]}
        if not over:
            for n in free:
                target[n] = left * w[n] / total
            break
        for n in over:
            target[n] = most * sizes[n]
        left -= sum(target[n] for n in over)
        free -= over
    return target


def documents():
    rng = random.Random(4)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "a", "a", "b", "c", "", None, "d"])
        text = rng.choice([None, "", " \t\n"]) if i % 40 == 0 else " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 60)))
        rows.append((i, text, source))
    return [*rows, *rows[:5], (None, "some words here", "b")]


def test_mix_meets_targets_and_sql(spark):
    df = spark.createDataFrame([(*r, 1.0, 2) for r in documents()], "doc_id long, text string, source string, target double, size int")
    got = mixing.mix(df, keep=["source"]).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert 0 <= r.taken <= 2 * r.size
    want = share_again(sizes, mixing.WEIGHTS, mixing.BUDGET, mixing.MOST)
    for s, size in sizes.items():
        own = [r for r in got if r.source == s]
        assert all(r.source_size == size and r.target == pytest.approx(want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 1
    con = duckdb.connect()
    con.register("documents", df.toPandas()[["doc_id", "text", "source"]])
    sql = con.sql(mixing.ORACLE.replace("coalesce(doc_id::VARCHAR", "coalesce(doc_id::BIGINT::VARCHAR")).fetchall()
    named = lambda i, *x: (-1 if i is None or i != i else int(i), *x[:2], round(x[2], 6), x[3])  # noqa: E731 - pandas has no null among numbers
    assert sorted(named(*x) for x in sql) == sorted(named(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7), keep=["source"]).collect()))


def test_quality_weights_favour_documents(spark):
    rows = [(i, "one two three four", "s", 4.0 if i % 2 else 0.5) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = mixing.mix(df, weights=(1,), budget=0.25, quality="q").collect()
    taken = [sum(r.taken for r in got if r.doc_id % 2 == side) for side in (0, 1)]
    assert sum(taken) == 2000 and taken[1] > 4 * taken[0]


def test_rows_and_empty(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    rows = mixing.mixed_rows(df)
    assert rows.columns == df.columns
    got = rows.selectExpr("sum(size(filter(split(text, '[ \t\n]+'), x -> x != '')))").first()[0]
    total = mixing.mix(df).agg({"size": "sum"}).first()[0]
    assert abs(got - 1.5 * total) < 0.05 * total
    assert mixing.mix(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(nothing).collect()] == [(0, 0.0, 0)] * 2


def test_ranges_are_even_at_any_weights(spark):
    from pyspark.sql import functions as F

    for low in (1.0, 0.1, 0.002):
        rows = spark.range(200_000).select((-F.log(mixing.uniform(3, F.col("id"))) / F.lit(low)).alias("key"), F.lit(low).alias("w"))
        rows = rows.union(spark.range(50_000).select(-F.log(mixing.uniform(4, F.col("id"))), F.lit(1.0)))
        levels = rows.groupBy("w").agg(F.count(F.lit(1)).alias("docs")).agg(F.collect_list(F.struct("w", "docs")).alias("levels"))
        at = F.floor(mixing.expected_below(F.col("key"), F.col("levels")) / 250_000 * 500)
        counts = [r["count"] for r in rows.crossJoin(F.broadcast(levels)).groupBy(at).count().collect()]
        assert sum(counts) == 250_000 and max(counts) < 2 * 500


def test_a_very_long_text(spark):
    rows = [(1, "word " * 300_000, "a"), (2, "two words", "a"), (3, "x", "b")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].size == 300_000 and got[1].source_size == 300_002
    assert all(abs(sum(r.taken for r in got.values() if r.doc_id in own) - got[own[0]].target) <= 1 for own in ((1, 2), (3,)))

import hashlib
import random

import duckdb
import numpy as np
import pytest

from veilframe.llm import fim

TEXTS = [
    None, "", "a", "é", "日本語のテキスト", "🙂🙃" * 40, "plain <P> text", "<S>", "x<M>", "<P", "S><S", "ends with <", "<" * 9, ">P<S", "\n\n a\r\nb \x0bc", "word " * 400,
    "aé日🙂 \n" * 3000, "z" * 400_000, "é​", "\x00\x01",
]


def test_ranks_of_the_matrix():
    draw = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        values = draw.integers(0, 8, n)
        matrix = fim.WaveletMatrix(values.astype(np.uint8))
        for i in {0, n // 3, n // 2, n}:
            assert [matrix.rank(v, i) for v in range(8)] == [int((values[:i] == v).sum()) for v in range(8)]


@pytest.mark.parametrize("unit", fim.UNITS)
def test_ends_of_units(unit):
    for text in TEXTS:
        text = text or ""
        data, units = text.encode(), fim.Units(text.encode(), unit)
        starts, before = [], "\n"
        for i, c in enumerate(text[:3000]):
            word = c not in " \t\n\x0b\x0c\r" and (before in " \t\n\x0b\x0c\r")
            if unit == "char" or (unit == "word" and word) or (unit == "line" and before == "\n"):
                starts.append(len(text[:i].encode()))
            before = c
        if len(text) <= 3000:
            assert units.n == len(starts)
        for k in {0, 1, 2, len(starts) // 2, len(starts) - 1} - {-1}:
            assert units.end(k) == (0 if k == 0 else starts[k] if k < len(starts) else len(data))
        assert units.end(units.n) == len(data)


def test_cuts_of_random_texts():
    draw = random.Random(3)
    for k in range(300):
        text = "".join(draw.choice("ab \né日🙂<PSM>") for _ in range(draw.randrange(200)))
        n, form, i, j, out = fim.transformed(text.encode(), k)
        h = hashlib.sha256(f"1:{k}".encode()).hexdigest()
        h = [int(h[x : x + 8], 16) for x in (0, 8, 16, 24)]
        assert n == len(text)
        plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b, c = text[:one], text[one:two], text[two:]
        want = text if plain else f"<S>{c}<P>{a}<M>{b}" if h[3] % 100 < 20 else f"<P>{a}<S>{c}<M>{b}"
        assert out.decode() == want and form == ("plain" if plain else "spm" if h[3] % 100 < 20 else "psm")


def test_odd_texts_equal_sql(spark):
    rows = [(k * 7 + s, t, "x", "y") for s in range(12) for k, t in enumerate(TEXTS)] + [(None, "no id", "x", "y"), (1, TEXTS[-1], "x", "y"), (1, TEXTS[-1], "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, output string")
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    found = fim.digests(df).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, con.sql(fim.ORACLE).fetchall()))
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["word", "line"])
def test_parts_and_texts_of_other_units(spark, unit):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS * 4)], "doc_id long, text string")
    made = fim.fill_in_middle(df, unit)
    back = made.select("*", fim.restored(made.output, made.form).alias("back")).collect()
    for r in back:
        text = (TEXTS * 4)[r.doc_id] or ""
        assert r.back == text
        if r.form != "plain":
            assert r.prefix + r.middle + r.suffix == text
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, "page")

import re
from collections import Counter
from itertools import permutations

import duckdb

from veilframe.llm import filters

LONG = " ".join(f"w{k}" for k in range(120))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (4, None, "en"), (5, "", "de"), (6, "SHOUT " * 30, "en"), (7, LONG + " #", "en"), (8, "a " * 200, None),
    (9, "a b" * 99 + " & C", ""), (None, LONG, "en"), (10, "é x\n\t\x0b\x0c\r y " * 50, "fr"), (2, LONG, "en"), (11, "AAAAAAAAAA" + "b" * 90, "fr"), (12, "A" * 11 + "b" * 89, "fr"), (13, "w" * 1_000_000, "fr"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 1), (4, None, None), (6, 1, 1), (None, 1, 1), (99, 1, 1), (7, 1, 0)]


def brute(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = {}
    parts = {p or "" for *_, p in docs}
    for order in permutations("ABCDE"):
        name = "".join(order)
        for p in parts:
            for s in range(5):
                out[p, name, s + 1] = Counter()
        for i, t, p in docs:
            t, p = t or "", p or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            fails = {
                "A": len(words) < 100,
                "B": 100 * len(set(words)) < 80 * len(words),
                "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)),
                "E": i is not None and least[t] < i,
            }
            good, toxic = any(x == i and q == 1 for x, q, _ in labels if i is not None), any(x == i and z == 1 for x, _, z in labels if i is not None)
            gone = False
            for s, f in enumerate(order):
                c = out[p, name, s + 1]
                here = fails[f] and not gone
                c["redundant"] += fails[f] and gone
                gone |= fails[f]
                c["kept"] += not gone
                c["removed"] += here
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += here and good
                c["toxic_lost"] += here and toxic
    shapley = Counter()
    for (p, name, s), c in out.items():
        shapley[p, name[s - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {k: (*(int(c[n]) for n in names), int(shapley[k[0], k[1][k[2] - 1]])) for k, c in out.items()}


def test_every_order_against_plain_python_and_sql(spark):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, lang string, part string, mask int")
    labels = spark.createDataFrame([(*r, 5) for r in LABELS], "doc_id long, quality int, toxic int, n int")
    rows = filters.audit(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    want = brute(DOCS, LABELS)
    assert len(rows) == len(want) == 600 * 4 and got == want
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang").toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas().astype({c: "Int64" for c in ("doc_id", "quality", "toxic")}))
    sql = {r[:3]: r[3:] for r in con.sql(filters.ORACLE).fetchall()}
    assert sql == want


def test_no_documents_no_labels(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filters.audit(docs.limit(0), labels).count() == 0
    bare = filters.audit(docs, labels.limit(0)).collect()
    assert len(bare) == 2400 and not any(r.good_lost or r.toxic_lost for r in bare)
    for part in {r.part for r in bare}:  # what stays after the last step is the same in every order
        assert len({r.kept for r in bare if r.part == part and r.step == 5}) == 1


def test_cells_stay_few(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(cast(id % 40 AS string), 3) AS text", "'en' AS lang")
    labels = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "cast(id % 5 = 0 AS int) AS toxic")
    cells = filters.cells(docs, labels).collect()
    assert len(cells) <= 128 and sum(r.n for r in cells) == 3000 and sum(r.n for r in cells if r["mask"] & 16) == 2960

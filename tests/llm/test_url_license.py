import duckdb

from veilframe.llm import licenses, urlfilter


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return sorted(map(str, con.sql(sql).fetchall()))


PAGES = [
    (1, "https://A.Example.NET/en/x?q#f", '<a href="https://good.io/a">x</a> <A HREF=//Spam.biz/>'),
    (2, "http://example.net", '<a href="/local">x</a>'),
    (3, "http://example.net/", None),
    (4, "http://notexample.com/de/", '<a href="http://bad.net/">'),
    (5, "http://example.com/de/1#x/y", ""),
    (6, None, '<a href="http://x.y/">'),
    (7, "no scheme", ""),
    (8, "http://good.io/", '<a href="http://fine.io/">' * 2),
    (9, "http://linker.biz/a", '<a href="http://bad.net/q"> <a href="http://worse.net/q">'),
    (10, "http://bad.net/x", '<a href="http://good.io">'),
    (11, "://", ""),
    (12, "http://org/fr/", ""),
    (13, "http://a.org/fr/\nb", ""),
    (None, "http://fine.io:80/", ""),
    (9, "http://linker.biz/a", '<a href="http://bad.net/q"> <a href="http://worse.net/q">'),
]


def test_urls_equal_sql_and_spread_both_ways(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, verdict string")
    for threshold in (-0.5, -0.05, 0.05):
        got = urlfilter.judged(df, threshold=threshold).select("page_id", "host", "path", "rule", "verdict")
        rows = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got.collect())
        want = in_duckdb(urlfilter.oracle(threshold=threshold), pages=df.select(df.page_id.cast("string").alias("page_id"), "url", "html"))
        assert rows == [w.replace("('", "(", 1).replace("',", ",", 1) for w in want] or sorted(x.split(",", 1)[1] for x in rows) == sorted(x.split(",", 1)[1] for x in want)
    by_id = {r.page_id: r for r in urlfilter.judged(df, threshold=-0.2).collect()}
    assert by_id[1].rule == "example.net/en/" and by_id[1].host == "a.example.net" and by_id[1].verdict == "allow"
    assert by_id[2].rule is None and by_id[2].path == "" and by_id[3].rule == "net/" and by_id[3].verdict == "block"
    assert by_id[4].rule is None and by_id[5].verdict == "block"
    assert by_id[9].verdict == "block"  # it links to blocked hosts
    assert by_id[8].verdict == "allow" and by_id[6].host == "" and by_id[7].verdict == "allow"
    assert urlfilter.judged(df.limit(0)).count() == 0


def test_licenses_equal_sql(spark):
    mit = dict(reversed(licenses.KNOWN))["MIT"]
    docs = [
        (1, mit),
        (2, "MIT LICENCE\nCopyright (c) 2020 Some One\n\n" + mit.split("\n", 1)[1].replace(",", " ,").upper()),
        (3, mit + " more"),
        (4, "Prose.\n  Released under the MIT Licence!\nLicensed under the Apache License, Version 2.\nend"),
        (5, None), (6, ""), (7, "!!"), (8, "(c) 1999 x"), (4, "Released under the MIT License."), (None, "licence\n" * 5000 + "é"),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")
    got = licenses.scan(df, licenses.known_digests(spark)).collect()
    assert len(got) == len(docs)
    named = {(r.doc_id, r.license, r.notices) for r in got}
    assert {(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, "Apache-2.0,MIT"), (4, "MIT", "MIT"), (5, None, ""), (8, None, "")} <= named
    want = in_duckdb(licenses.oracle().replace("SELECT doc_id, digest", "SELECT digest"), documents=df.select(df.doc_id.cast("string").alias("doc_id"), "text"))
    assert sorted(str((r.digest, r.license, r.notices)) for r in got) == want
    assert licenses.scan(df.limit(0), licenses.known_digests(spark)).count() == 0


def test_notices_without_the_word_license_are_found(spark):
    known = licenses.known_digests(spark, [("CC0-1.0", "SPDX: CC0-1.0"), ("PD", "This text is in the public domain."), ("ARR", "All rights reserved.")])
    docs = [(1, "prose\n  ALL rights reserved\nmore"), (2, "spdx cc0 1.0\nx\nThis text is in the public domain"), (3, "all rights reserved to us"), (4, "public domain"), (5, "This text is in the public domain.")]
    df = spark.createDataFrame([*docs, docs[1]], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.notices) for r in licenses.scan(df, known).collect())
    assert got == [(1, None, "ARR"), (2, None, "CC0-1.0,PD"), (2, None, "CC0-1.0,PD"), (3, None, ""), (4, None, ""), (5, "PD", "PD")]


def test_known_files_and_digests(spark, tmp_path):
    text = "A Licence\n\nCopyright (c) 2001 Someone\nDo as you like, whilst it lasts."
    (tmp_path / "Own-1.0.txt").write_text(text)
    own = [(r.license, r.known_digest) for r in licenses.digests_of(spark.read.text(str(tmp_path), wholetext=True)).collect()]
    known = licenses.known_digests(spark, [], own)
    docs = spark.createDataFrame([(1, text.upper()), (2, "a license do as you like while it lasts"), (3, "x")], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licenses.scan(docs, known).orderBy("doc_id").collect()] == [(1, "Own-1.0"), (2, "Own-1.0"), (3, None)]
    assert len({d for _, d in licenses.DIGESTS}) == len(licenses.DIGESTS)
    assert all(len(d) == 64 for _, d in licenses.DIGESTS)

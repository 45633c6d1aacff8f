import duckdb
import pyarrow as pa

from veilframe.plans import registry
from veilframe.sources import html

PAGE = """<html><head><title>no</title><script>var a = "<b>no</b>";</script></head><body>
<nav><ul><li><a href="/a">First &amp; only</a></li></ul></nav>
<h1> Sign
 up </h1><p>One<p>Two <b>bold</b> three
<form><label for="m">Your mail</label><input id="m" type="EMAIL" name="mail" value=" a@b.example ">
<label>Secret <input type="password" value="pw"></label><input type="hidden" value="x">
<input type="checkbox" aria-label="I agree"><input type="submit" value="Go"><span id="x">By</span><span id="y">hand</span><textarea aria-labelledby="x y">note</textarea>
<select name="s"><option>One<option selected>Two</select><div contenteditable="true">free</div></form>
<table><thead><tr><th>Name<th><i>Mail</i></tr></thead><tr><td>Ann<td>x@y.example<tr><td>Bob<td><b>z</b></table>
<table><tr><td>plain</td></tr></table><table><tr><th colspan="2">Wide</th></tr><tr><td>w</td></tr></table>
<img alt="face"><div role="button" title="Press">go</div></notopen><article>Row</article><p>open"""


def rows_of(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return [r.asDict() for r in html.elements(html.nodes(df).cache()).orderBy("page_id", "ord").collect()]


def test_elements_of_a_literal_page(spark):
    got = rows_of(spark, [PAGE, None, "", "plain text", "<p>" + "long " * 100_000])
    page = [r for r in got if r["page_id"] == 0]
    short = [(r["tag"], r["element_type"], r["label"], r["value"], r["column_header"]) for r in page]
    assert short == [
        ("a", "button", "First & only", "First & only", None),
        ("h1", "text", None, "Sign up", None),
        ("p", "text", None, "One", None),
        ("p", "text", None, "Two three", None),
        ("b", "text", None, "bold", None),
        ("input", "input", "Your mail", "a@b.example", None),
        ("input", "input", "Secret", "[has value]", None),
        ("input", "input", "I agree", "unchecked", None),
        ("input", "button", None, "Go", None),
        ("span", "text", None, "By", None),
        ("span", "text", None, "hand", None),
        ("textarea", "input", "By hand", "note", None),
        ("select", "input", "s", "Two", None),
        ("div", "input", None, "free", None),
        ("th", "text", None, "Name", None),
        ("i", "text", None, "Mail", None),
        ("td", "text", None, "Ann", "Name"),
        ("td", "text", None, "x@y.example", "Mail"),
        ("td", "text", None, "Bob", "Name"),
        ("b", "text", None, "z", "Mail"),
        ("td", "text", None, "plain", None),
        ("th", "text", None, "Wide", None),
        ("td", "text", None, "w", None),
        ("img", "image", "face", None, None),
        ("div", "button", "Press", "go", None),
        ("article", "text", None, "Row", None),
        ("p", "text", None, "open", None),
    ]
    assert [r["element_id"] for r in page] == [f"e{i}" for i in range(len(page))]
    assert [r["row"] for r in page if r["row"]] == [1, 1, 2, 2, 3, 3, 4, 5, 6, 7] and page[0]["row"] is None
    assert page[5]["input_type"] == "email" and page[5]["name"] == "mail"
    long = [r for r in got if r["page_id"] == 4]
    assert len(long) == 1 and len(long[0]["value"]) == 201 and long[0]["value"].endswith("…")
    assert not [r for r in got if r["page_id"] in (1, 2, 3)]


GRID = """<div role="grid"><div role="row"><span role="columnheader">First Name<i>Ascending</i></span><span role="columnheader"><i>Mail</i></span></div>
<div role="row"><span role="gridcell">Ann</span><div><span role="cell"><b>a@b.example</b></span></div></div>
<div role="row"><span role="gridcell">one cell only</span></div>
<div role="row"><span role="gridcell">Bob</span><span role="gridcell"><div role="row"><span role="gridcell">x</span><span role="gridcell">y</span></div></span></div></div>
<div role="gridcell">of no row</div>
<div role="table"><div role="row"><span role="cell">no header</span></div></div>
<div role="treegrid"><div role="row"><span role="cell"><div role="grid"><div role="row"><b role="columnheader">Inner</b></div><div role="row"><b role="cell">in</b></div></div></span></div></div>
<div role="grid"><b role="columnheader">of no row</b><div role="row"><b role="cell">z</b></div></div>
<table><tr><th>T</th></tr><tr><td><span role="gridcell">in a table</span></td></tr></table>"""


def test_headers_of_grids_made_by_roles(spark):
    got = {r["value"]: r["column_header"] for r in rows_of(spark, [GRID]) if r["tag"] in ("span", "b")}
    assert got["Ann"] == "First Name" and got["a@b.example"] == "Mail"
    assert got["one cell only"] is None  # two headers, one cell
    assert got["Bob"] == "First Name" and got["x"] == "First Name" and got["y"] == "Mail"  # cells of a nested row are that row's
    assert got["no header"] is None and got["z"] is None and got["in a table"] is None
    assert got["in"] == "Inner"
    outer = [r for r in rows_of(spark, [GRID]) if r["value"] == "of no row"]
    assert len(outer) == 2 and all(r["column_header"] is None for r in outer)


def test_what_stands_inside_a_node(spark):
    found = html.nodes(spark.createDataFrame([(1, "<p><b></b><div><b></b><div><b></b></div></div><b></b>"), (2, "<div></div>")], "page_id long, html string")).cache()
    got = html.inside(found.where("tag = 'div'"), found.where("tag = 'b'")).collect()
    assert sorted((r.page_id, r.node, r.before, r.upto) for r in got) == [(1, 2, 1, 3), (1, 4, 2, 3), (2, 0, 0, 0)]
    boxes = html.inside(found.where("tag = 'div'"), found.where("tag = 'div'")).collect()  # a node is no item of itself
    assert sorted((r.page_id, r.node, r.upto - r.before) for r in boxes) == [(1, 2, 1), (1, 4, 0), (2, 0, 0)]


def test_deep_and_broken_pages():
    import time

    start = time.process_time()
    for piece in ("<div id=a>x", "<label>x", "<p><div>", "<ul><div><li>", "<![foo[x]]>a", "<a <a ", "<!--", "<![", "</div>", "<table><tr><td>"):
        nodes = html.read(piece * 20_000)
        assert all(n["node"] <= n["last"] < len(nodes) for n in nodes)
    assert time.process_time() - start < 30
    assert [n["own"] for n in html.read("<![foo[x]]><p>a<![CDATA[b]]>c")] == ["ac"]
    assert [n["own"] for n in html.read("<p>a &lt; b < c <i")] == ["a < b < c "]
    assert html.read("<b>" + "x" * 10_000 + "</b><button>" + " y" * 5_000)[1]["whole"].split() == ["y"] * len(html.read("<button>" + " y" * 5_000)[0]["whole"].split())


def test_no_text_breaks_the_parser():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    piece = st.one_of(st.sampled_from(["<", ">", "<!", "<![", "<!--", "-->", "<a", "</", "</p>", "<p>", "<div role=grid>", "<td>", "<table>", "'", '"', "=", "&", "&#", "<script>", "</script>", "<?", "]]>", " ", "x", "<label>", "<option>", "<svg/>"]), st.text(max_size=5))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(piece, max_size=40))
    def holds(pieces):
        found = html.read("".join(pieces))
        assert [n["node"] for n in found] == list(range(len(found)))
        assert all(k <= n["last"] < len(found) for k, n in enumerate(found))

    holds()


def test_a_bad_page_harms_no_other(spark):
    got = rows_of(spark, ["<![foo[x]]>a", "<p>good"])
    assert [(r["page_id"], r["value"]) for r in got] == [(1, "good")]


def test_headings_agree_with_their_sql_on_cut_references(spark, tmp_path):
    said = ["Terms &amp", "a &amp;lt b", "cut &#x2", "it&#x27;s &#x27", "&ltb&gt &quot", "&amp;amp", "stays &am", "a\x0bb", "  ", "x" * 205]
    spark.createDataFrame([(k, f"<h1>{t}</h1><p>{t}") for k, t in enumerate(said)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.QUERIES["page_headings"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(registry.ORACLES["page_headings"]).fetchall()) and len(got) == 9


def test_links_parse_their_pages_once(spark, tmp_path):
    spark.createDataFrame([(1, '<a href="/">x</a>')], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    plan = registry.QUERIES["reviewable_links"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_no_batch_of_nodes_grows_with_a_page():
    pages = pa.RecordBatch.from_pydict({"page_id": [1, 2, 3], "html": ["<p>x" * 30_000, None, '<i a="1">y</i>']})
    sent = list(html._run(iter([pages])))
    assert max(b.num_rows for b in sent) <= 5_000 and sum(b.num_rows for b in sent) == 30_001
    assert sent[-1].to_pylist()[-1]["attrs"] == [("a", "1")] and sent[-1].to_pylist()[-1]["page_id"] == 3


def test_grids_are_read_in_one_pass_over_their_pages(spark, tmp_path):
    lines = [(k, 10 * k + n % 3, n, n) for k in range(40) for n in range(k % 7 + 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    cells = registry.QUERIES["grid_cells"](spark, str(tmp_path))
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Window" not in plan
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, cells.collect()), key=str) == sorted(db.execute(registry.ORACLES["grid_cells"]).fetchall(), key=str)


def test_what_judges_nodes_is_compiled(spark):
    """Above 8,000 bytes of a method the JVM doesn't compile it."""
    found = html.elements(html.nodes(spark.createDataFrame([(1, "<p>x")], "page_id long, html string"), shown=True)).where("tag = 'b' and value rlike '^[0-9]+$'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = found.select("page_id", "value", "column_header")._jdf.queryExecution().executedPlan()
        made = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(plan)
        sizes = [made.apply(k)._3().maxMethodCodeSize() for k in range(made.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8_000


def test_plain_pages_are_read_as_all_others():
    import random

    pieces = ["<p>", "</p>", "<div>", '<div role="row">', '<b role="columnheader">', '<i role="cell">', '<table role="grid">', "</table>", "<tr>", "<th>", "<td>", '<td colspan="2">', "</b>", "</div>", "<br/>", '<label for="a">', "<label>", '<input id="a" />', '<A HREF="u">', "<option>", "<select>", " x ", "a &amp; b", "&lt", "é\n"]
    chance = random.Random(4)
    for _ in range(2_000):
        page = "".join(chance.choices(pieces, k=chance.randint(0, 30)))
        assert html.read(page) == html.read("<!-- to the library's parser -->" + page)


def test_trees_of_pages_are_remembered_without_their_texts():
    first, second = (html.read(f"<table><tr><th>{h}<tr><td>{v}</table><button>{v}</button>") for h, v in (("One", "a"), (" ", " b &amp; c")))
    assert [(n["own"], n["header"], n["element_type"]) for n in first[2:]] == [("One", None, "text"), ("", None, None), ("a", "One", "text"), ("a", None, "button")]
    assert [(n["own"], n["header"], n["element_type"]) for n in second[2:]] == [(" ", None, None), ("", None, None), (" b & c", None, "text"), (" b & c", None, "button")]


def test_pages_taken_together_are_read_as_one_by_one(monkeypatch):
    made = [
        '<table role="grid"><tr><th>{0}<th><i>{1}</i></tr><tr><td>{1}<td>{2}<br/>{0}</table>',
        '<div role="grid"><p role="row"><b role="columnheader">{0}<u>{1}</u></b></p><div role="row"><i role="cell"><b>{1}</b>{2}</i></div></div>{0}',
        '<a href="/">{0}<b>{1}</b></a><button title="t"></button><li role="row">{2}<img alt="x">{0}<style/>{1}',
        "{0}<p>{1}",
        '<label for="a">{0}</label><input id="a" value="{1}">',
        "<p>{0}<p><!-- -->{1}",
    ]
    said = ["", " ", "a", " two  words ", "é\n\U0001f600", "x > y", "a &amp; b", "\xa0", "long " * 60, "n" * 121]
    pages = [m.format(said[k % 10], said[k // 10 % 10], said[(k + k // 10) % 10]) for k in range(200) for m in made]
    batch = pa.RecordBatch.from_pydict({"page_id": [*range(len(pages)), -1], "html": [*pages, None]})

    def elements():
        found = [r for b in html._run(iter([batch]), shown=True) for r in b.to_pylist()]
        for r in found:  # an element that says its own text isn't asked for its whole one, others only for as much as is shown
            r["whole"] = None if r["element_type"] == "text" else " ".join((r["whole"] or "").split())[: html.MOST_VALUE + 1]
        return sorted(found, key=lambda r: (r["page_id"], r["node"]))

    together = sum(len(rows) for _, rows in html._alike(batch.column(1)))
    got = elements()
    monkeypatch.setattr(html, "_MANY", 1_000_000)
    assert got == elements() and len(got) > 2_000 and 300 < together < 700
    assert {r["header"] for r in got} > {None, "a", "two words", "n" * 120 + "…"}

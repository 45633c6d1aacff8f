import random
import re

from pyspark.sql import functions as F

from veilframe.functions import geom
from veilframe.functions.text import classify_text
from veilframe.operators import scan, vision

RECT = "struct<x:double,y:double,width:double,height:double>"


def looks_of(spark, *rows):
    """(page, stop, scroll_y, ok); the view is 800 x 600."""
    return scan.walked(spark.createDataFrame([(p, s, 0, y, 800, 600, ok) for p, s, y, ok in rows], "page_id long, stop int, scroll_x int, scroll_y int, view_width int, view_height int, ok boolean"))


def findings(spark, *rows):
    """(page, stop, ord, category, source, (x, y, w, h))."""
    made = [(p, s, o, c, src, "r", tuple(map(float, box))) for p, s, o, c, src, box in rows]
    return spark.createDataFrame(made, f"page_id long, stop int, ord long, category string, source string, reason string, position {RECT}")


def pictures(spark, *rows):
    made = [(p, s, o, f"i{o}", "image", tuple(map(float, box))) for p, s, o, box in rows]
    return spark.createDataFrame(made, f"page_id long, stop int, ord long, element_id string, element_type string, position {RECT}")


def texts(spark, *rows):
    made = [(p, s, o, t, tuple(map(float, box))) for p, s, o, t, box in rows]
    return spark.createDataFrame(made, f"page_id long, stop int, ord long, text string, position {RECT}")


def kept(df):
    return sorted((r.page_id, r.stop, r.category, r.position.y) for r in df.collect())


def test_a_walk_ends_where_a_look_fails(spark):
    looks = looks_of(spark, (1, 0, 0, True), (1, 1, 450, True), (2, 0, 0, True), (2, 1, 0, True), (2, 2, 900, True), (3, 0, 0, True), (3, 1, 450, False), (3, 2, 900, True), (4, 0, None, True), (5, 0, 0, True), (5, 1, None, True), (5, 2, 9, True), (6, 0, 0, None))
    assert sorted((r.page_id, r.stop, r.short) for r in looks.collect()) == [(1, 0, False), (1, 1, False), (2, 0, True), (3, 0, True), (5, 0, True)]


def test_sightings_of_overlapping_looks_are_one_finding(spark):
    looks = looks_of(spark, (1, 0, 0, True), (1, 1, 450, True), (2, 0, 0, True), (2, 1, 450, False))
    rows = findings(
        spark,
        (1, 0, 0, "id_number", "dom", (100, 500, 220, 30)),  # at 500 of the page
        (1, 1, 0, "id_number", "dom", (102, 52, 218, 29)),  # at 502: the same
        (1, 1, 1, "email", "dom", (100, 50, 220, 30)),  # another category there
        (1, 1, 2, "email", "dom", (100, 500, 220, 30)),  # another place
        (1, 0, 5, "name", "dom", (0, 570, 100, 30)),  # cut by the first look
        (1, 1, 5, "name", "dom", (0, 120, 100, 60)),  # whole in the second: 570 to 630
        (1, 1, 6, "name", "dom", (0, 180, 100, 30)),  # touches only
        (1, 0, 8, "phone", "dom", (0, 0, 0, 0)),
        (1, 1, 8, "phone", "dom", (0, -450, 0, 0)),  # no area: never the same
        (1, 9, 0, "name", "dom", (0, 0, 9, 9)),  # of no look
        (2, 1, 0, "name", "dom", (0, 0, 9, 9)),  # of a look that failed
    )
    got = kept(scan.stitched(rows, looks))
    assert got == sorted([(1, 0, "id_number", 500.0), (1, 1, "email", 500.0), (1, 1, "email", 950.0), (1, 0, "name", 570.0), (1, 1, "name", 630.0), (1, 0, "phone", 0.0), (1, 1, "phone", 0.0)])
    assert scan.stitched(rows.limit(0), looks).count() == 0
    assert scan.stitched(rows.unionByName(rows), looks).count() == len(got) + 2  # repeated rows merge, but those without an area


def test_the_order_of_looks_decides_which_sighting_stays(spark):
    looks = looks_of(spark, (1, 0, 0, True), (1, 1, 100, True), (1, 2, 200, True))
    chain = findings(spark, (1, 2, 0, "name", "dom", (0, 0, 100, 100)), (1, 1, 0, "name", "dom", (0, 60, 100, 100)), (1, 0, 0, "name", "dom", (0, 120, 100, 100)))  # at 200, 160, 120
    assert kept(scan.stitched(chain, looks)) == [(1, 0, "name", 120.0), (1, 2, "name", 200.0)]


def test_images_cut_by_every_look_are_gaps(spark):
    looks = looks_of(spark, (1, 0, 0, True), (1, 1, 450, True))
    cut = [(1, 0, 1, (0, 500, 400, 200)), (1, 1, 1, (0, 50, 400, 200))]  # 500 to 700: whole in the second look only
    never = [(1, 0, 2, (400, 580, 400, 700)), (1, 1, 2, (400, 130, 400, 700))]
    small = [(1, 0, 3, (0, 590, 20, 20))]
    images = pictures(spark, *cut, *never, *small)
    none = findings(spark, (1, 0, 0, "email", "dom", (400, 580, 400, 700)))
    gaps = [r for r in scan.everything(none, images, looks).collect() if r.reason == scan.UNREAD]
    assert [(r.category, r.source, r.position.y) for r in gaps] == [("other", "ocr", 580.0)]
    read = findings(spark, (1, 1, 0, "id_number", "ocr", (410, 140, 350, 600)))
    assert [r.reason for r in scan.everything(read, images, looks).collect()] == ["r"]


def test_crops_are_read_until_one_succeeds(spark):
    looks = looks_of(spark, (1, 0, 0, True), (1, 1, 100, True), (1, 2, 200, True))
    images = pictures(spark, *[(1, s, o, (0, 200 - 100 * s + 20 * o, 300, 200)) for s in range(3) for o in range(3)], (1, 0, 7, (0, 500, 300, 200)), (1, 1, 7, (0, 300, 300, 200)))
    results = spark.createDataFrame([(1, 0, "i0", True), (1, 0, "i1", False), (1, 1, "i1", True), (1, 0, "i7", True)], "page_id long, stop int, element_id string, ok boolean")
    got = {(r.stop, r.element_id) for r in scan.crops(images, looks, results).collect()}
    assert got == {(0, "i0"), (0, "i1"), (1, "i1"), (0, "i2"), (1, "i2"), (2, "i2"), (1, "i7")}  # i7 is cut at the first look: that read doesn't count


def test_screens_show_what_later_looks_found(spark):
    looks = looks_of(spark, (1, 0, 0, True), (1, 1, 450, True), (2, 0, 0, True))
    found = findings(spark, (1, 1, 0, "id_number", "dom", (0, 100, 50, 50)), (1, 1, 1, "email", "dom", (0, 400, 50, 50)))
    read = scan.everything(found, pictures(spark), looks)
    assert sorted((r.page_id, r.stop, r.covered) for r in scan.screens(read, looks).collect()) == [(1, 0, 1), (1, 1, 2), (2, 0, 0)]
    plans = spark.createDataFrame([(1, 2, 1050, 600, False), (2, 3, 1600, 600, True), (3, 1, 10, 600, False)], "page_id long, stops long, document_height long, view_height long, truncated boolean")
    told = {r.page_id: r for r in scan.summary(read, looks, plans).collect()}
    assert (told[1].looks, told[1].examined_to, told[1].truncated, told[1].total, told[1].counts) == (2, 1050, False, 2, {"email": 1, "id_number": 1})
    assert (told[2].looks, told[2].truncated, told[2].total) == (1, True, 0) and (told[3].looks, told[3].truncated, told[3].examined_to) == (0, True, 0)


def test_readings_are_compared_once_for_the_page(spark):
    looks = looks_of(spark, (1, 0, 0, True), (1, 1, 450, True))
    line = lambda s, o, t, y: (1, s, o, t, (0, y - 450 * s, 300, 20))
    shown = texts(spark, line(0, 0, "Account balance", 500), line(1, 0, "Account balance", 500), line(1, 1, "Only in markup", 700), line(0, 2, "  ", 30))
    read = texts(spark, line(1, 0, "account, balance", 501), line(0, 0, "Account balance", 500), line(0, 1, "painted 42", 100), line(1, 3, "...", 800))
    hidden = texts(spark, line(0, 0, "reason", 460), line(1, 0, "reason", 460), line(1, 1, "reason", 900))
    [r] = scan.reading(shown, read, hidden, looks).collect()
    assert (r.agreed, r.shown_only, r.read_only, r.hidden) == (1, 1, 1, 2) and abs(r.agreement - 1 / 3) < 1e-12


def test_readings_deal_their_texts_by_page_once(spark):
    looks = looks_of(spark, (1, 0, 0, True), (1, 1, 450, True))
    shown, read = texts(spark, (1, 0, 0, "one", (0, 0, 300, 20))), texts(spark, (1, 1, 0, "two", (0, 0, 300, 20)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (scan.reading(shown, read, read, looks), vision.agreement(shown, read), scan.stitched(findings(spark, (1, 0, 0, "email", "dom", (0, 0, 9, 9))), looks))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2, 1, 2]  # the rows and the looks
    assert all("Exchange hashpartitioning(page_id" in p for p in plans)


def test_readings_are_those_of_a_plain_loop(spark):
    draw = random.Random(3)
    said = ("one", "One!", "one two", "two", "...", "", None, "three")
    stops = {1: [0, 450, 900], 2: [0], 3: [0, 450], 4: [0], 5: [0, 450]}
    looks = looks_of(spark, *[(p, s, y, True) for p, ys in stops.items() for s, y in enumerate(ys)])
    sides = []
    for n in range(3):
        of = {0: (1, 2, 3, 6), 1: (1, 2, 4, 6), 2: (1, 5)}[n]  # page 3 has no read text, 4 no shown, 5 only hidden, 6 no look
        sides.append([(p, draw.randrange(4), o, draw.choice(said), (draw.choice((0, 40)), 10 * draw.randrange(12), 100, draw.choice((20, 30)))) for p in of for o in range(30)])
    normal = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()

    def share(a, b):
        inter = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return inter / min(a[2] * a[3], b[2] * b[3])

    def merged(rows, page):
        kept = []
        for _, s, o, t, (x, y, w, h) in sorted((r for r in rows if r[0] == page), key=lambda r: r[1:3]):
            if normal(t) and s < len(stops.get(page, ())):
                box = (x, y + stops[page][s], w, h)
                if not any(k == normal(t) and share(b, box) >= 0.6 for k, b in kept):
                    kept.append((normal(t), box))
        return kept

    expected = {}
    for page in range(1, 7):
        a, b, c = (merged(rows, page) for rows in sides)
        pairs = sorted((-share(p, q), i, j) for i, (t, p) in enumerate(a) for j, (u, q) in enumerate(b) if share(p, q) >= 0.2 and (t in u or u in t))
        left, right = set(), set()
        for _, i, j in pairs:
            if i not in left and j not in right:
                left.add(i), right.add(j)
        if a or b:
            expected[page] = (len(left), len(a) - len(left), len(b) - len(left), len(c))
    got = scan.reading(*[texts(spark, *rows) for rows in sides], looks).collect()
    assert {r.page_id: (r.agreed, r.shown_only, r.read_only, r.hidden) for r in got} == expected and set(expected) == {1, 2, 3, 4}


def test_text_that_only_pixels_show(spark):
    shown = texts(spark, (1, 0, 0, "mail me@mail.example", (0, 0, 300, 20)))
    read = texts(spark, (1, 0, 0, "mail me@mail.example", (0, 1, 300, 20)), (1, 0, 1, "other@mail.example", (0, 100, 300, 20)), (1, 1, 0, "mail me@mail.example", (0, 0, 300, 20)), (1, 0, 2, "nothing", (0, 200, 300, 20)))
    got = {(r.page_id, r.stop, r.ord, r.category, r.source) for r in scan.screen_findings(shown, read, classify_text, "page_id", "stop").collect()}
    assert got == {(1, 0, 1, "email", "ocr"), (1, 1, 0, "email", "ocr")}
    assert all("@" not in r.reason for r in scan.screen_findings(shown, read, classify_text, "page_id", "stop").collect())


def test_a_view_in_the_page(spark):
    [r] = looks_of(spark, (1, 0, 450, True)).select(scan.view_of().alias("v"), geom.area(scan.view_of()).alias("a"), F.lit(1)).collect()
    assert tuple(r.v) == (0.0, 450.0, 800.0, 600.0) and r.a == 480_000.0

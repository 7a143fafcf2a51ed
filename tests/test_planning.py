"""Candidate planning and the text layer on small pages with known results."""

from pyspark.sql import functions as F

from tessera.operators import planning as pl

PAGE = "doc long, page int, width int, height int, layout boolean"
REGION = "doc long, page int, region string, kind string, x double, y double, w double, h double, confidence double, reason string, pos int"
CROP = "doc long, page int, region string, candidate string, i int, rotation int, x double, y double, w double, h double, confidence double"


def region(name, kind, x=100, y=100, w=300, h=200, confidence=0.8, reason=None, pos=0, page=0):
    return (1, page, name, kind, float(x), float(y), float(w), float(h), confidence, reason, pos)


def crops(name, n, page=0):
    return [(1, page, name, f"{name}-c{i}", i, 0, 0.0, 0.0, 9.0, 9.0, 0.7) for i in range(n)]


def run(spark, regions, found=(), size=(2000, 2800), wide=(), wide_crops=(), layout=True):
    pages = spark.createDataFrame([(1, 0, *size, layout)], PAGE)
    frames = (pages, spark.createDataFrame(list(regions), REGION), spark.createDataFrame(list(found), CROP), spark.createDataFrame([(1, 0, r) for r in wide], "doc long, page int, region string"), spark.createDataFrame(list(wide_crops), CROP))
    planned, skipped = pl.candidates(*frames), pl.skip_counts(*frames)
    return {r.candidate: r for r in planned.collect()}, {r.reason: r.n for r in skipped.collect()}, pl.page_reports(pages, planned, skipped).first()


LARGE = (7000, 4900)
DRAWING = region("d", "drawing_area", 1000, 0, 5000, 4000, pos=9)


CASES = [
    ([region("s", "stamp")], (2000, 2800), (), {"full_stamp_region": 1}),
    # too wide, too large in area; only on large drawings
    ([region("s", "stamp", w=3200)], LARGE, (), {"oversized_large_drawing_stamp": 1, "text_page_on_large_drawing": 1}),
    ([region("s", "stamp", w=3000, h=1500)], LARGE, (), {"oversized_large_drawing_stamp": 1, "text_page_on_large_drawing": 1}),
    ([region("s", "stamp", w=1900)], (2000, 2800), (), {"full_stamp_region": 1}),
    # the sheet's shape alone makes a large drawing
    ([region("s", "stamp", w=1300)], (2000, 3700), (), {"oversized_large_drawing_stamp": 1, "text_page_on_large_drawing": 1}),
    # tables: first rule that holds
    ([region("t", "table_candidate")], (2000, 2800), (), {"full_table_region": 1}),
    ([region("t", "table_candidate", w=3200, h=1000, confidence=0.1, reason="suppressed_x"), DRAWING], LARGE, ("t",), {"wide_table_fragment": 1, "drawing_area": 1, "text_page_on_large_drawing": 1}),
    ([region("t", "table_candidate", w=3200, h=1000, confidence=0.1, reason="suppressed_x"), DRAWING], LARGE, (), {"oversized_large_drawing_table": 1, "drawing_area": 1, "text_page_on_large_drawing": 1}),
    ([region("t", "table_candidate", w=3200, h=1000, confidence=0.1, reason="suppressed_x")], LARGE, (), {"suppressed_table_candidate": 1, "text_page_on_large_drawing": 1}),
    ([region("t", "table_candidate", confidence=0.49, reason="frame")], (2000, 2800), (), {"low_confidence_table_candidate": 1}),
    # low confidence is a matter of tables alone
    ([region("s", "stamp", confidence=0.1), region("b", "text_block", confidence=0.1, pos=1)], (2000, 2800), (), {"full_stamp_region": 1, "text_block": 1}),
    ([region("d", "drawing_area"), region("l", "logo_or_mark", pos=1), region("m", "service_mark", pos=2)], (2000, 2800), (), {"drawing_area": 1, "unsupported_region": 2}),
    ([], LARGE, (), {"text_page_on_large_drawing": 1}),
]


def test_reasons(spark):
    docs = list(enumerate(CASES))
    pages = spark.createDataFrame([(i, 0, *size, True) for i, (_, size, *_) in docs], PAGE)
    regions = spark.createDataFrame([(i, *r[1:]) for i, (rs, *_) in docs for r in rs], REGION)
    wide = spark.createDataFrame([(i, 0, w) for i, (_, _, ws, _) in docs for w in ws], "doc long, page int, region string")
    got = {i: {} for i, _ in docs}
    for r in pl.skip_counts(pages, regions, spark.createDataFrame([], CROP), wide).collect():
        got[r.doc][r.reason] = r.n
    assert got == {i: reasons for i, (*_, reasons) in docs} and {k for reasons in got.values() for k in reasons} == set(pl.REASONS)


def test_order_of_candidates(spark):
    regions = [region("s", "stamp", 1400, 2500, 500, 250), region("d", "drawing_area", 200, 50, 1700, 2400, pos=1), region("e1", "text_block", 20, 1500, 80, 300, 0.9, pos=2), region("t", "table_candidate", pos=3), region("e2", "text_block", 30, 1300, 20, 100, 0.1, pos=4), region("w", "table_candidate", pos=5)]
    got, skipped, report = run(spark, regions, crops("s", 2) + crops("t", 3) + crops("w", 4), wide=("w",), wide_crops=crops("wide", 2))
    assert {k: (v.kind, v.sort_order) for k, v in got.items()} == {
        "s-c0": ("stamp_cell_candidate", 20000), "s-c1": ("stamp_cell_candidate", 20001), "e1-side-strip": ("side_strip_candidate", 40002), "t-c0": ("table_cell_candidate", 30000), "t-c1": ("table_cell_candidate", 30001),
        "t-c2": ("table_cell_candidate", 30002), "e2-side-strip": ("side_strip_candidate", 40006), "wide-c0": ("table_cell_candidate", 35007), "wide-c1": ("table_cell_candidate", 35008)}
    assert skipped == {"full_stamp_region": 1, "full_table_region": 1, "drawing_area": 1, "wide_table_fragment": 1} and (report.code, report.candidates) == ("ocr_candidates_planned", 9)
    wide_strip, narrow = got["e1-side-strip"], got["e2-side-strip"]
    assert (wide_strip.x, wide_strip.y, wide_strip.w, wide_strip.h, wide_strip.confidence, wide_strip.rotation) == (37.0, 1494.0, 46.0, 302.0, 0.75, 270)
    assert (narrow.x, narrow.w, narrow.confidence) == (34.0, 12.0, 0.3)


STRIPS = [({}, True), ({"x": 337}, False), ({"y": 1175}, False), ({"h": 115}, False), ({"w": 5, "h": 39}, False), ({"w": 0}, False)]


def test_texts_along_the_border(spark):
    pages = spark.createDataFrame([(i, 0, 2000, 2800, True) for i in range(len(STRIPS))], PAGE)
    rows = [(i, *r[1:]) for i, (changes, _) in enumerate(STRIPS) for r in (region("s", "stamp", 1400, 2500, pos=1), region("d", "drawing_area", 200, 50, 1700, 2400, pos=2), region("b", "text_block", **({"x": 336, "y": 1176, "w": 80, "h": 116} | changes)))]
    got = {r.doc for r in pl.candidates(pages, spark.createDataFrame(rows, REGION), spark.createDataFrame([], CROP)).collect() if r.kind == "side_strip_candidate"}
    assert got == {i for i, (_, strip) in enumerate(STRIPS) if strip}


def test_a_page_of_text(spark):
    blocks = [region(f"b{i}", "text_block", 100 + i, 100 + 300 * i, 1500, 200, pos=i) for i in range(8)]
    got, skipped, _ = run(spark, blocks)
    assert skipped == {"text_block": 8}
    page = got["page-0-text-page"]
    assert (page.kind, page.sort_order, page.x, page.y, page.w, page.h) == ("text_page", 500, 63.0, 63.0, 1581.0, 2374.0) and abs(page.confidence - 0.55) < 1e-9
    assert run(spark, blocks[:5])[0] == {} and run(spark, blocks, size=(1600, 2400))[0] == {} and run(spark, blocks, size=LARGE)[0] == {}
    assert set(run(spark, [*blocks, region("t", "table_candidate", pos=20)], crops("t", 1))[0]) == {"t-c0"}
    assert set(run(spark, blocks, wide_crops=crops("w", 1))[0]) == {"w-c0"}


def test_a_page_without_layout(spark):
    got, skipped, report = run(spark, [], layout=False)
    assert got == {} and skipped == {} and (report.code, report.candidates, report.skipped) == ("ocr_candidates_skipped_no_layout", 0, {})


ASKED = "doc long, page int, region string, candidate string, kind string, hypothesis string, x double, y double, w double, h double"
WORD = "doc long, page int, block int, line int, word int, x double, y double, w double, h double, text string"


def asked(name, x, y=10, kind="table_cell_candidate", hypothesis="original", page=0, region="t"):
    return (1, page, region, name, kind, hypothesis, float(x), float(y), 80.0, 20.0)


def word(text, x, y=12, block=0, line=0, n=0, w=30, page=0):
    return (1, page, block, line, n, float(x), float(y), float(w), 10.0, text)


def test_covered_candidates_never_reach_the_engine(spark):
    rows = [asked("covered", 10), asked("open", 210), asked("turned", 10.4, hypothesis="rotated_90"), asked("turned-open", 210, hypothesis="rotated_90"), asked("strip", 400, kind="side_strip_candidate", hypothesis="rotated_270"), asked("blank", 600), asked("far", 10, page=1)]
    words = [word("world", 50, n=1), word("Hello", 12), word("below", 12, 25, line=1), word("half", 75, 12, n=2), word("more", 95, 12, n=3), word("edge", 410, 10), word(" ", 610)]
    given = []

    def engine(rest):
        given.extend(sorted(r.candidate for r in rest.collect()))
        return rest.select("doc", "page", "candidate", F.lit("seen").alias("text"), F.lit(0.5).alias("confidence"))

    a, w = spark.createDataFrame(rows, ASKED), spark.createDataFrame(words, WORD)
    got = {r.candidate: (r.source, r.text, r.confidence) for r in pl.read_candidates(a, w, engine).collect()}
    assert given == ["blank", "far", "open", "turned-open"]
    assert got == {"covered": ("pdf-text-layer", "Hello world half below", 1.0), "strip": ("pdf-text-layer", "edge", 1.0), **{k: ("engine", "seen", 0.5) for k in given}}
    routes = {r.candidate: (r.route, r.words) for r in pl.text_layer_first(a, w).collect()}
    assert routes["turned"] == ("suppressed", 0) and routes["covered"] == ("text_layer", 4) and len(routes) == len(rows)
    assert {r.candidate for r in pl.read_candidates(a, w).collect()} == {"covered", "strip"}


def test_words_over_many_tiles_count_once(spark):
    a = spark.createDataFrame([(1, 0, "", "p", "text_page", None, 0.0, 0.0, 2000.0, 2000.0)], ASKED)
    words = [word(f"w{i}", 150 * i, 190 * i, line=i, w=300) for i in range(10)]
    got = pl.text_layer_first(a, spark.createDataFrame(words, WORD)).first()
    assert (got.words, got.text) == (10, " ".join(f"w{i}" for i in range(10)))

"""Table reconstruction on small tables with known results."""

from tessera.operators import tables as tb

REGION = "doc long, page int, region string, kind string, x double, y double, w double, h double, confidence double, reason string, pos int"
CELL = "doc long, page int, region string, row int, col int, x double, y double, w double, h double, confidence double, text_px long, mode string"
CANDIDATE = "doc long, region string, row int, col int, candidate string, rotation int, row_span int, column_span int, x double, y double, w double, h double, confidence double, sources array<string>, pos int"
TEXT = "doc long, candidate string, text string, raw_text string, status string"


def cell(region, row, col, x=None, y=None, w=100.0, h=40.0, doc=1, page=0, mode="cv_grid", confidence=0.9):
    return (doc, page, region, row, col, float(100 * col if x is None else x), float(40 * row if y is None else y), float(w), float(h), confidence, 50, mode)


def table(region="t", x=0.0, y=0.0, w=400.0, h=400.0, kind="table_candidate", confidence=0.8, reason=None, pos=0, doc=1, page=0):
    return (doc, page, region, kind, x, y, w, h, confidence, reason, pos)


def crop(name, row, col, region="t", rotation=0, pos=0, sources=None, doc=1):
    return (doc, region, row, col, name, rotation, 1, 1, 100.0 * col, 40.0 * row, 100.0, 40.0, 0.7, sources, pos)


def frames(spark, cells, regions=(), crops=(), texts=()):
    return [spark.createDataFrame(list(r), s) for r, s in ((cells, CELL), (regions, REGION), (crops, CANDIDATE), (texts, TEXT))]


SHEET = dict(w=1200.0, h=1300.0)
TALL = [cell("t", k, 0, 5, 250.0 * k, 120, 260) for k in range(4)] + [cell("t", k, 1, 125, 250.0 * k, 400, 260) for k in range(4)]


STRIPS = [
    # over the drawing's left edge: only cells whose centre is right of it stay
    ([cell("t", 0, 0), cell("t", 0, 1), cell("t", 0, 2)], [table(), table("d", 150.0, 350.0, 300.0, 500.0, "drawing_area", pos=1)], {(0, 1), (0, 2)}, "edge"),
    # the stamp's edge is further right than the drawing's
    ([cell("t", 0, 0), cell("t", 0, 1), cell("t", 0, 2)], [table(), table("d", 150.0, 0.0, 300.0, 500.0, "drawing_area", pos=1), table("s", 240.0, 0.0, 50.0, 50.0, "stamp", pos=2)], {(0, 2)}, "edge"),
    # a drawing that hardly shares the table's height is no boundary
    ([cell("t", 0, 0)], [table(), table("d", 150.0, 390.0, 300.0, 500.0, "drawing_area", pos=1)], {(0, 0)}, "whole"),
    # wholly left of the edge
    ([cell("t", 0, 0)], [table(w=100.0), table("d", 150.0, 0.0, 300.0, 500.0, "drawing_area", pos=1)], {(0, 0)}, "outside"),
    # the first drawing area counts, not the last
    ([cell("t", 0, 0), cell("t", 0, 1)], [table(), table("d", 20.0, 0.0, 9.0, 400.0, "drawing_area", pos=1), table("e", 250.0, 0.0, 9.0, 400.0, "drawing_area", pos=2)], {(0, 0), (0, 1)}, "edge"),
    # a leading strip of a full sheet
    (TALL, [table(**SHEET)], {(k, 1) for k in range(4)}, "strip"),
    (TALL, [table(x=0.0, w=900.0, h=1300.0)], {(k, c) for k in range(4) for c in (0, 1)}, "whole"),
    (TALL[1:], [table(**SHEET)], {(k, c) for k in range(4) for c in (0, 1)} - {(0, 0)}, "whole"),
    ([(*c[:7], 150.0, *c[8:]) if c[4] == 0 else c for c in TALL], [table(**SHEET)], {(k, c) for k in range(4) for c in (0, 1)}, "whole"),
]


def test_service_strips(spark):
    c, r, *_ = frames(spark, [(i, *x[1:]) for i, (cells, *_) in enumerate(STRIPS) for x in cells], [(i, *x[1:]) for i, (_, regions, *_) in enumerate(STRIPS) for x in regions])
    branches = {x.doc: x.branch for x in tb.strip_limits(c, r).collect()}
    left = {i: set() for i in branches}
    for x in tb.table_cells(c, r).collect():
        left[x.doc].add((x.row, x.col))
    assert [(left[i], branches[i]) for i in range(len(STRIPS))] == [(kept, branch) for *_, kept, branch in STRIPS]


def test_tables_that_are_not_rebuilt(spark):
    regions = [table("a"), table("b", confidence=0.49), table("c", reason="suppressed_by_stamp"), table("d", kind="text_block"), table("e", reason="frame")]
    c, r, *_ = frames(spark, [cell(x, 0, 0, confidence=q) for x, q in zip("abcde", (0.9, 0.9, 0.9, 0.9, 0.1))], regions)
    assert {(x.region, x.confidence) for x in tb.table_cells(c, r).collect()} == {("a", 0.8), ("e", 0.3)}
    wide = spark.createDataFrame([(1, 0, "a")], "doc long, page int, region string")
    both = c.union(spark.createDataFrame([cell("w", 0, 0, mode=tb.WIDE)], CELL))
    assert {(x.region, x.confidence) for x in tb.table_cells(both, r, wide).collect()} == {("e", 0.3), ("w", 0.62)}


def test_fragments(spark):
    cells = [cell("a", 3, 0, y=0.0), cell("a", 5, 0, y=40.0), cell("b", 0, 0, y=200.0), cell("b", 2, 0, y=240.0), cell("c", 0, 0, y=500.0), cell("z", 7, 0, x=900.0, y=600.0)]
    cells += [cell("a", 0, 0, doc=2, y=0.0), cell("b", 0, 0, doc=2, y=30.0), cell("c", 0, 0, doc=2, y=70.0, x=95.0)]
    got = {(r.doc, r.region, r.row): (r.table_id, r.table_row) for r in tb.joined_fragments(frames(spark, cells)[0]).collect()}
    import hashlib

    name = "a-merged-" + hashlib.sha1(b"a|b").hexdigest()[:8]
    assert got[1, "a", 3] == (name, 0) and got[1, "a", 5] == (name, 1) and got[1, "b", 0] == (name, 2) and got[1, "b", 2] == (name, 3)
    assert got[1, "c", 0] == ("c", 0) and got[1, "z", 7] == ("z", 7)  # 220 below; elsewhere
    assert {k[1]: v[0] for k, v in got.items() if k[0] == 2} == {"a": "a", "b": "b", "c": "c"}  # begins 10 above the end; moved aside


def test_choice_and_flags(spark):
    crops = [crop("r90", 0, 0, rotation=90), crop("r0", 0, 0, pos=1), crop("n1", 0, 1, rotation=270), crop("n2", 0, 1, rotation=90), crop("lone", 0, 2), crop("odd", 0, 3), crop("low", 1, 0), crop("sus", 1, 1), crop("same1", 1, 2), crop("same2", 1, 2, rotation=90), crop("fine", 1, 3)]
    texts = [(1, "r90", "zz", "zz", "recognized"), (1, "r0", "a ", "a  ", "recognized"), (1, "n1", "ok", "ok", "recognized"), (1, "n2", "§§", None, "recognized"), (1, "odd", "§§x", "§§x", None), (1, "low", "v", "v", "recognized_low_confidence"), (1, "sus", " ", " ", "recognized_suspicious"), (1, "same1", "q", "q", "recognized"), (1, "same2", "q ", "q ", "recognized"), (1, "fine", "8", "8", "recognized")]
    _, _, c, t = frames(spark, [], (), crops, texts)
    got = {(r.row, r.col): (r.s.candidate, r.candidates, r.flags) for r in tb.chosen_readings(tb.readings(c, t)).collect()}
    assert got[0, 0] == ("r0", ["r0", "r90"], ["normalized_text", "orientation_hypotheses_present", "ambiguous_orientation"])
    assert got[0, 1] == ("n1", ["n2", "n1"], ["orientation_hypotheses_present", "ambiguous_orientation"])
    assert got[0, 2] == ("lone", ["lone"], ["empty_text", "noisy_text"])
    assert got[0, 3] == ("odd", ["odd"], ["unknown_ocr_quality", "noisy_text"])
    assert got[1, 0][2] == ["low_confidence_ocr"] and got[1, 1][2] == ["empty_text", "suspicious_ocr", "noisy_text"]
    assert got[1, 2] == ("same1", ["same1", "same2"], ["orientation_hypotheses_present"]) and got[1, 3][2] == ["ok"]


def test_a_whole_table(spark):
    cells = [cell("t", r, c) for r in range(3) for c in range(3)] + [cell("t", 3, 0, h=40.0)]
    crops = [crop(f"c{r}{c}", r, c) for r in range(3) for c in (1, 2) if (r, c) != (1, 2)] + [crop("turned", 0, 1, rotation=90, pos=1, sources=["other", "t"])]
    texts = [(1, f"c{r}{c}", f"v{r}{c}", f"v{r}{c}", "recognized") for r in range(3) for c in (1, 2)] + [(1, "turned", "", "", "empty_text")]
    texts = [t for t in texts if t[1] != "c21"] + [(1, "c21", "", "", "empty_text")]
    c, r, k, t = frames(spark, cells, [table()], crops, texts)
    got = tb.reconstruct(c, r, k, t).collect()
    assert len(got) == 1
    one = got[0]
    # the column without candidates goes, and the sparse row below
    assert (one.table_id, one.row_count, one.cell_count, one.text_cells, one.empty_cells, one.missing_candidates, one.low_confidence, one.empty_texts) == ("t", 3, 6, 4, 2, 1, 0, 1)
    assert one.flags == ["partial_ocr_coverage", "empty_ocr_text"] and one.coverage_policy == "cv_grid_cells_with_ocr_evidence" and one.source_regions == ["t", "other"]
    assert (one.x, one.y, one.w, one.h) == (100.0, 0.0, 200.0, 120.0)
    assert [(row.row_index, row.cell_count, row.y, [(x.column_index, x.text, x.status) for x in row.cells]) for row in one.rows] == [
        (0, 2, 0.0, [(0, "v01", "recognized"), (1, "v02", "recognized")]), (1, 2, 40.0, [(0, "v11", "recognized"), (1, "", "missing_ocr_candidate")]), (2, 2, 80.0, [(0, "", "empty_text"), (1, "v22", "recognized")])]
    assert one.rows[0].cells[0].candidates == ["c01", "turned"] and one.rows[1].cells[1].flags == ["empty_text", "missing_ocr_candidate"] and one.rows[1].cells[1].confidence == 0.8


def test_wide_tables_low_confidence_and_ok(spark):
    cells = [cell("w", 0, 0, mode=tb.WIDE), cell("t", 0, 0, doc=2)]
    crops = [crop("a", 0, 0, "w"), crop("b", 0, 0, doc=2)]
    c, r, k, t = frames(spark, cells, [table(doc=2)], crops, [(1, "a", "x", "x", "recognized_low_confidence"), (2, "b", "y", "y", "recognized")])
    got = {x.doc: x for x in tb.reconstruct(c, r, k, t).collect()}
    assert got[1].flags == ["wide_table_inferred_grid", "low_confidence_ocr"] and got[1].coverage_policy == "wide_table_text_blocks_with_inferred_grid"
    assert got[2].flags == ["ok"]


def test_documents_without_grid_or_text(spark):
    # 1: grid and text; 2: candidates but nothing read; 3: no grid, so readings make one; 4: nothing
    cells = [cell("t", 0, 0), cell("t", 0, 0, doc=2)]
    crops = [crop("a", 0, 0), crop("b", 0, 0, doc=2), crop("c", 2, 1, doc=3), crop("d", 2, 3, doc=3)]
    c, r, k, t = frames(spark, cells, [table(), table(doc=2)], crops, [(1, "a", "x", "x", "recognized"), (3, "c", "y", "y", "recognized")])
    read = tb.readings(k, t)
    tables = tb.reconstruct(c, r, k, t)
    assert {(x.doc, x.cell_count) for x in tables.collect()} == {(1, 1), (3, 2)}
    docs = spark.createDataFrame([(i,) for i in range(1, 5)], "doc long")
    got = {x.doc: (x.code.removeprefix("table_reconstruction_"), x.tables, x.cells, x.unread) for x in tb.reconstruction_status(docs, tb.table_cells(c, r), read, tables).collect()}
    assert got == {1: ("completed", 1, 1, 0), 2: ("skipped_no_ocr_text", 0, 0, 1), 3: ("completed", 1, 2, 1), 4: ("skipped_no_candidates", 0, 0, 0)}


def test_tenants_stay_apart(spark):
    from pyspark.sql import functions as F

    two = lambda d: d.withColumn("org_id", F.explode(F.array(F.lit(1), F.lit(2))))
    cells, regions, crops, texts = frames(spark, [cell("t", r, 0) for r in range(2)], [table()], [crop("a", 0, 0), crop("b", 1, 0)], [(1, "a", "x", "x", "recognized"), (1, "b", "z", "z", "recognized")])
    texts = two(texts).withColumn("text", F.concat("text", F.col("org_id").cast("string"))).withColumn("raw_text", F.col("text"))
    got = {x.org_id: x for x in tb.reconstruct(two(cells), two(regions), two(crops), texts).collect()}
    assert set(got) == {1, 2} and all(x.cell_count == 2 and x.flags == ["ok"] for x in got.values())
    assert [c.text for row in got[2].rows for c in row.cells] == ["x2", "z2"]


def test_empty_tables(spark):
    c, r, k, t = frames(spark, [])
    assert tb.reconstruct(c, r, k, t).collect() == []

"""Plans and results of what has to stay in proportion to its input."""

import re

from pyspark.sql import functions as F

from tessera.functions import codes as co
from tessera.operators.tree import materialise


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_codes_are_parsed_once_not_in_filters(spark):
    rows = spark.createDataFrame([("0012-П-3-КС",), ("0012-П-3-КС",), ("iso-1",), ("7-x",), (None,)], "raw string")
    df = materialise(co.parse(rows.select(co.normalize(F.col("raw")).alias("code"))))
    assert not [x for x in plan(df).splitlines() if re.search(r"\bFilter\b", x) and "regexp_replace" in x]
    assert {(r.path, r.parent_id is None) for r in df.collect()} == {("project:12", True), ("project:12/documentation_stage:П", False), ("project:12/documentation_stage:П/mark:КС", False), ("project:7", True)}


def test_copies_of_boxes_meet_once(spark):
    from tessera.operators.pagegrid import without_containers

    box = "id long, page int, x double, y double, w double, h double"
    many = spark.range(30_000).selectExpr("id", "1 AS page", "5e0 AS x", "5e0 AS y", "40e0 AS w", "40e0 AS h").union(spark.range(30_000, 60_000).selectExpr("id", "1", "10e0", "10e0", "20e0", "20e0"))
    df = without_containers(many, 10_000)
    assert re.search(r"HashJoin \[[^\]]*tx#\d+[^\]]*ty#\d+|SortMergeJoin \[[^\]]*tx#\d+[^\]]*ty#\d+", plan(df))
    assert [tuple(r) for r in df.agg(F.count("*"), F.min("id")).collect()] == [(30_000, 30_000)]
    # ids that repeat or are null; a box that only its namesake would lie in; boxes off the page
    odd = [(1, 1, 0.0, 0.0, 50.0, 50.0), (1, 1, 5.0, 5.0, 9.0, 9.0), (2, 2, -900.0, 900.0, 50.0, 50.0), (3, 2, -895.0, 905.0, 9.0, 9.0), (None, 3, 0.0, 0.0, 50.0, 50.0), (4, 3, 5.0, 5.0, 9.0, 9.0), (5, 4, 0.0, 0.0, 50.0, 50.0), (None, 4, 5.0, 5.0, 9.0, 9.0), (6, None, 0.0, 0.0, 50.0, 50.0)]
    assert sorted(r.id or 0 for r in without_containers(spark.createDataFrame(odd, box), 10_000).collect()) == [0, 0, 1, 1, 3, 4, 5, 6]


def test_equal_boxes_meet_once_and_all_pairs_are_there(spark):
    from tessera.operators.pagegrid import BOX_LIST, words_in_crops

    box = "id long, page int, x double, y double, w double, h double"
    n, m = 2 * BOX_LIST + 7, BOX_LIST + 1
    words = spark.range(n).selectExpr("id", "1 AS page", "5e0 AS x", "5e0 AS y", "4e0 AS w", "4e0 AS h")
    crops = spark.range(m).selectExpr("id", "1 AS page", "0e0 AS x", "0e0 AS y", "60e0 AS w", "60e0 AS h")
    df = words_in_crops(words, crops)
    got = df.agg(F.count("*"), F.countDistinct("crop", "word")).first()
    assert tuple(got) == (n * m, n * m)
    # no join has rows of the result on its way: boxes meet, then lists of ids
    assert df.columns == ["crop", "word"]
    assert re.search(r"Generate explode\(word_ids#", plan(df)) and re.search(r"Generate explode\(crop_ids#", plan(df))
    # rows that repeat, null ids, null pages and places, boxes without area
    odd_words = [(1, 1, 5.0, 5.0, 4.0, 4.0), (1, 1, 5.0, 5.0, 4.0, 4.0), (None, 1, 5.0, 5.0, 4.0, 4.0), (2, None, 5.0, 5.0, 4.0, 4.0), (3, 1, None, 5.0, 4.0, 4.0), (4, 1, 5.0, 5.0, 0.0, 0.0), (5, 2, 5.0, 5.0, 4.0, 4.0)]
    odd_crops = [(7, 1, 0.0, 0.0, 60.0, 60.0), (7, 1, 0.0, 0.0, 60.0, 60.0), (None, 1, 0.0, 0.0, 60.0, 60.0), (8, 2, 7.0, 7.0, 60.0, 60.0), (9, 2, 7.5, 7.5, 60.0, 60.0)]
    shown = sorted((r.crop or 0, r.word or 0) for r in words_in_crops(spark.createDataFrame(odd_words, box), spark.createDataFrame(odd_crops, box)).collect())
    assert shown == sorted([(c, w) for c in (7, 7, 0) for w in (1, 1, 0, 4)] + [(8, 5)])


SF = "/root/testdata/sf0.001"


def shuffles(df) -> int:
    """Exchanges of a plan that move rows."""
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def same(a, b) -> bool:
    assert a.dtypes == b.dtypes
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_cells_of_a_sheet_move_once(spark):
    from tessera.plans import documents, fixtures

    tables = {t: fixtures.table(spark, SF, t) for t in ("lineitem", "orders")}
    cells = fixtures.fixture(spark, SF, "cells")
    assert same(cells, spark.sql(fixtures.FIXTURES["cells"], **tables))
    for name in ("do19_header_row", "do18_template_detect", "do20_row_items", "do24_grid_rows"):
        assert shuffles(documents.Q[name](spark, SF)) == 1, name


def test_lines_of_an_estimate_move_once(spark):
    from tessera.plans import documents, fixtures

    lineitem = fixtures.table(spark, SF, "lineitem")
    assert same(documents.estimate(spark, SF), spark.sql(documents.ESTIMATE, lineitem=lineitem))
    for name in ("do20_estimate_sections", "do20_estimate_items", "do21_resource_groups", "do21_resource_rows"):
        assert shuffles(documents.Q[name](spark, SF)) == 1, name


def test_lines_of_crops_are_numbered_once(spark):
    from tessera.plans import tables

    for name in ("cv14_table_cells", "cv14_table_quality", "cv14_reconstruction_status"):
        text = plan(tables.Q[name](spark, SF))
        assert "l_orderkey" not in text and "row_number() windowspecdefinition(l_" not in text, name


def test_rows_of_cells_are_put_together_without_lists(spark):
    from tessera.operators import cells as ce

    def sheet(n, *rows):
        return [(n, r, c, v, 100 * r + i) for r, values in enumerate(rows, 1) for i, (c, v) in enumerate(values)]

    head = [(1, "ОБОСНОВАНИЕ"), (2, "Наименование  работ")]
    item = [(1, " 7 "), (2, "a"), (3, "Работа\t 1"), (6, "м"), (6, "м2"), (7, "1 000,5"), (9, "-3")]
    data = sheet(1, item, head, [(k, str(k)) for k in range(1, 5)], item, [(1, "1"), (2, "01"), (3, "2"), (6, "3")], [(1, "8"), (3, " \n"), (6, "м")], [(1, "9"), (3, "x"), (6, "\t")])
    data += sheet(None, item) + sheet(2, [(1, "1"), (2, "9" * 45), (3, "2"), (6, "3")], [(1, "5\n"), (3, "x"), (6, "y")], [(1, "1"), (1, "2"), (3, "3"), (6, "4")])
    df = spark.createDataFrame(data, "sheet long, row int, col int, value string, pos long")
    rows = ce.table_rows(df, 14)
    text = plan(rows)
    assert "collect_" not in text and "ObjectHashAggregate" not in text and "SortAggregate" in text
    # rows above the header, rows of numbers of columns, positions that end in a line feed and blank names fall away; numbers past 38 digits do not stop the job
    assert sorted((r.sheet or 0, r.row) for r in rows.collect()) == [(0, 1), (1, 4), (1, 5), (1, 6), (1, 7), (2, 1), (2, 2)]
    assert {(r.sheet, r.row, r.position, r.name, r.unit, r.quantity, r.unit_cost) for r in ce.local_estimate(df)[1].collect()} == {
        (None, 1, "7", "Работа 1", "м2", 1000.5, -3.0), (1, 4, "7", "Работа 1", "м2", 1000.5, -3.0), (1, 5, "1", "2", "3", None, None), (2, 1, "1", "2", "3", None, None)}


def test_documents_of_tables_move_once(spark):
    from tessera.plans import tables

    for name in ("cv14_table_cells", "cv14_table_quality", "cv14_reconstruction_status"):
        moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\), ENSURE", plan(tables.Q[name](spark, SF)))
        assert not [x for x in moved if re.search(r"\b(candidate|row|col|grp|table_id)#", x)], name

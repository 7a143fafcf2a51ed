"""Queries leave out no row of their tables."""

import os
import re
from hashlib import md5

import pytest

from tessera.plans import catalog, pages
from tessera.plans.fixtures import fixture, table

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def shown(text):
    text = re.sub(r"\s+", " ", text.strip().translate(str.maketrans("«»“”–—−", '""""---')))
    return re.sub(r"[.,;:\s]+$", "", re.sub(r" +([.,;:])", r"\1", text))


def run_on(spark, tmp_path, texts, name):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return dict(catalog.queries()[name](spark, str(tmp_path)).collect())


def test_display_text_of_long_and_foreign_texts(spark, tmp_path):
    texts = ["a " * 300 + "— end ;", "a " * 300 + "— other .", "«Привет» ,  “мир”.", "漢字 – ελ", "", " . "]
    got = run_on(spark, tmp_path, texts, "st6_display_text")
    assert got == {i: md5(shown(t).encode()).hexdigest() for i, t in enumerate(texts)} and got[0] != got[1]


def test_sentences_with_versions_and_addresses(spark, tmp_path):
    got = run_on(spark, tmp_path, ["At 10.0.0.1. End", "a 1.5 b. c", "1.2.3", "1.23.4", None], "st9_sentences")
    assert got == {0: 2, 1: 2, 2: 1, 3: 1, 4: None}


@needs_data
def test_all_orders_are_numbered(spark):
    got = catalog.queries()["t3_enum_order"](spark, DATA).collect()
    assert sorted(r.n for r in got) == list(range(1, table(spark, DATA, "orders").count() + 1))


@needs_data
def test_all_parts_are_lines(spark):
    parts = table(spark, DATA, "part")
    lines = spark.sql(pages.SHEET_LINES, part=parts)
    assert lines.count() == parts.count() and lines.groupBy("page").count().where("count > 20").count() == 0


@needs_data
def test_all_lines_are_used(spark):
    line = table(spark, DATA, "lineitem")
    cells = spark.sql(pages.CELLS_WHOLE, line_rows=fixture(spark, DATA, "line_rows"))
    assert cells.select("id").distinct().count() == line.count() and cells.groupBy("region").count().where("count > 240").count() == 0
    assert spark.sql(pages.BLOCK, lineitem=line).count() == line.count()
    for name in ("cv15_footer_trim", "cv8_stamp_template"):
        out = catalog.queries()[name](spark, DATA)
        assert {r[0] % 10 for r in out.select(out.columns[0]).distinct().collect()} == {r[0] for r in line.select("l_linenumber").distinct().collect()}

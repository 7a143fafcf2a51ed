"""Hand-computed cases of intake, title blocks, estimates and tenants."""

from pyspark.sql import functions as F

from tessera.operators import cells as ce
from tessera.operators import facts as fa
from tessera.operators import intake as it
from tessera.operators.titleblock import ROLES, interpret


def test_priority_by_name_and_dedupe_name(spark):
    rows = [(1, 1, "Смета №1.PDF", None, None), (2, 1, "dir/смета  №1.xlsx", None, None), (3, 1, "смета №1.docx", ".docx", None), (4, 1, "other.xlsx", ".xlsx", "a/plan.xlsx"), (5, 1, "b/plan.pdf", ".pdf", "a/Plan.pdf"), (6, 1, "plan.pdf", ".pdf", None), (7, 2, "plan.pdf", ".pdf", None), (8, 1, ".pdf", None, None)]
    files = spark.createDataFrame(rows, "id long, set_id long, original_name string, extension string, dedupe_name string")
    assert sorted(r.id for r in it.by_priority(files).collect()) == [2, 3, 4, 6, 7, 8]


def test_validation_of_sets(spark):
    expected = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (2, 21), (3, 30), (4, 40), (5, 50)], "set_id long, id long")
    files = spark.createDataFrame(
        [(10, "a.pdf", None, None, 5, "x"), (20, "a.pdf", None, None, 5, ""), (21, "b.pdf", None, None, 0, "x"), (30, "a.RAR", None, None, 5, "x"), (40, "a.pdf", ".pdf", "application/zip", 5, "x"), (50, "a.pdf", None, None, -1, "x")],
        "id long, original_name string, extension string, mime_type string, size_bytes long, checksum string",
    )
    got = {r.set_id: (r.code, r.file_id, r.next_step) for r in it.validate_sets(expected, files).collect()}
    assert got == {1: ("stored_file_not_found", None, "failed"), 2: ("missing_checksum", 20, "failed"), 3: (None, None, "unpack"), 4: (None, None, "unpack"), 5: ("empty_file", 50, "failed")}


def test_format_by_extension_or_type(spark):
    rows = spark.createDataFrame([(".PDF", None), (None, "application/pdf"), (".bin", it.XLSX_TYPE), (".xls", "application/vnd.ms-excel"), (None, None)], "e string, m string")
    assert [r[0] for r in rows.select(it.file_format(F.col("e"), F.col("m"))).collect()] == ["pdf", "pdf", "xlsx", "unsupported", "unsupported"]


def test_title_block_status_and_warnings(spark):
    documents = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "doc long, has_fields boolean")
    fields = spark.createDataFrame(
        [(1, "document_designation", "extracted", "A-1", 2), (1, "document_designation", "extracted", "A-2", 3), (1, "sheet_number", "empty", "9", 1), (1, "sheet_title", "extracted", "Plan", 4), (2, "document_designation", "empty", "B", 1), (2, None, "extracted", "x", 2), (3, "document_designation", "extracted", " ", 1), (3, "document_designation", "extracted", "C", 2)],
        "doc long, role string, extraction string, text string, pos long",
    )
    got = {r.doc: r for r in interpret(documents, fields).collect()}
    none = "title_block_document_designation_missing"
    assert {k: (r.status, r.warnings) for k, r in got.items()} == {1: ("interpreted", ""), 2: ("ambiguous", none), 3: ("ambiguous", none), 4: ("missing", f"stamp_source_fields_missing|{none}")}
    assert [got[1][r] for r in ROLES] == ["A-1", None, None, "Plan", None, None]


def sheet(spark, rows):
    cells = [(1, r, c, v, r * 100 + c) for r, row in rows.items() for c, v in row.items()]
    return spark.createDataFrame(cells, "sheet long, row long, col long, value string, pos long")


def test_local_estimate(spark):
    cells = sheet(spark, {
        1: {1: "Локальный сметный расчет"}, 3: {1: "№", 2: "Обоснование", 3: "Наименование", 6: "Единица", 7: "Количество"}, 4: {1: "1", 2: "2", 3: "3", 4: "4"}, 5: {1: "Итого до начала", 9: "7"},
        6: {1: "1", 2: "ФЕР01", 3: "Грунт  рыхлый", 6: "м3", 7: "12,5", 9: "10", 10: "125", 14: "3"}, 7: {1: "Раздел 2. Стены", 2: "x"}, 8: {1: "2", 3: "Кирпич", 6: "шт", 7: "3", 8: "1 000"}, 9: {1: "x", 3: "no position", 6: "шт"},
        10: {1: "Накладные расходы", 9: "5", 10: "-50"}, 11: {1: "Итого по разделу", 10: "70"}, 12: {1: "Итого по разделу 2", 10: "75"}, 13: {1: "Итого", 2: "none"}, 14: {1: "Итого по смете", 10: "999"},
    })
    sections, items = ce.local_estimate(cells)
    assert [(r.section, r.row, r.position, r.basis, r.name, r.unit, r.quantity, r.unit_cost, r.total_cost, r.material_cost) for r in items.orderBy("row").collect()] == [(0, 6, "1", "ФЕР01", "Грунт рыхлый", "м3", 12.5, 10, 125, 3), (1, 8, "2", None, "Кирпич", "шт", 1000, None, None, None)]
    assert [(r.section, r.section_number, r.title, r["items"], r.overhead, r.estimated_profit, r.total_cost, r.warning) for r in sections.orderBy("section").collect()] == [(0, None, None, 1, None, None, None, None), (1, "2", "Раздел 2. Стены", 1, -50, None, 75, None)]
    empty = ce.local_estimate(sheet(spark, {1: {1: "Раздел 1"}}))[0].collect()
    assert [(r.title, r.warning) for r in empty] == [("Раздел 1", "local_estimate_items_missing")]


def test_resource_statement(spark):
    cells = sheet(spark, {
        2: {1: "Обоснование", 2: "Наименование"}, 3: {1: "5", 3: "before any group", 4: "шт"}, 4: {1: "Трудозатраты"}, 5: {1: "1", 2: "1-100", 3: "Рабочий", 4: "чел.-ч", 5: "8", 6: "2,5", 7: "20"}, 6: {1: "Итого", 6: "3", 7: "20"},
        7: {1: " Материалы "}, 8: {1: "2", 3: "Песок", 4: "т", 5: "1"}, 9: {1: "Итого материалы", 2: "none"},
    })
    groups, resources = ce.resource_statement(cells)
    assert [(r.group, r.position, r.code, r.name, r.unit, r.quantity, r.unit_cost, r.total_cost) for r in resources.orderBy("row").collect()] == [(1, "1", "1-100", "Рабочий", "чел.-ч", 8, 2.5, 20), (2, "2", None, "Песок", "т", 1, None, None)]
    assert [(r.group, r.title, r.resources, r.total_cost, r.warning) for r in groups.orderBy("group").collect()] == [(1, "Трудозатраты", 1, 20, None), (2, "Материалы", 1, None, None)]


def test_tenants_that_share_ids_do_not_meet(spark):
    both = lambda rows, schema: spark.createDataFrame([(o, *r) for o, some in zip("ab", rows) for r in some], f"org_id string, {schema}")
    files = both(([(1, 1, "x.pdf", "s"), (2, 1, "y.pdf", "t")], [(1, 1, "x.xlsx", "s"), (2, 1, "z.pdf", "s")]), "id long, set_id long, original_name string, checksum string")
    assert sorted((r.org_id, r.id) for r in it.by_priority(files).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    stored = both(([], [(9, "t")]), "id long, checksum string")
    assert [tuple(r) for r in it.duplicates(files, stored).collect()] == [("b", 2, "request")]
    versions = both(([(1, 7, "ready")], [(1, 7, "failed")]), "id long, set_id long, status string")
    placed = both(([(1, 5, "placed")], []), "version_id long, node_id long, status string")
    assert sorted((r.org_id, r.status, r.codes) for r in fa.summary(versions, placed).collect()) == [("a", "completed", ""), ("b", "completed_with_warnings", "document_version_processing_failed")]
    nodes = both(([(5, "mark")], [(5, "mark")]), "id long, kind string")
    codes = both(([(1, 1, "A")], [(1, 1, "B")]), "id long, version_id long, raw string")
    assert [(r.org_id, r.code) for r in fa.node_documents(nodes, placed, versions, codes).collect()] == [("a", "A")]
    assert [(r.org_id, r.code) for r in fa.fallback_documents(placed, versions, codes).collect()] == [("b", "B")]
    cells = both(([(1, 1, 1, "Раздел 1", 1), (1, 2, 1, "1", 2), (1, 2, 3, "n", 3), (1, 2, 6, "u", 4)], [(1, 1, 1, "1", 1), (1, 1, 3, "m", 2), (1, 1, 6, "u", 3)]), "sheet long, row long, col long, value string, pos long")
    assert sorted((r.org_id, r.section, r.name) for r in ce.local_estimate(cells)[1].collect()) == [("a", 1, "n"), ("b", 0, "m")]

"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import codes as co
from tessera.functions import text as tx
from tessera.operators import events as ev
from tessera.operators import facts as fa
from tessera.operators import intake as it
from tessera.operators import jobs as jb
from tessera.operators import tree as tr
from tessera.sources import stores as so


def files(spark, *names):
    return spark.createDataFrame([(i, 1, n, n[n.rindex(".") :]) for i, n in enumerate(names)], "id long, set_id long, original_name string, extension string")


@pytest.mark.parametrize("names,kept", [(["drawing.pdf", "drawing.xlsx"], ["drawing.xlsx"]), (["left.pdf", "right.pdf", "right.xlsx"], ["left.pdf", "right.xlsx"]), (["a.txt", "a.txt", " A .pdf", "a.pdf"], ["a.txt", "a.txt", " A .pdf"])])
def test_file_priority(spark, names, kept):
    assert [r.original_name for r in it.by_priority(files(spark, *names)).orderBy("id").collect()] == kept


def test_families(spark):
    names = ["PRJ-001-R-AR-drawing.pdf", "local-estimate.xlsx", "drawing-register.xlsx", "notes.txt"]
    assert [r[0] for r in files(spark, *names).orderBy("id").select(it.family(F.col("original_name"))).collect()] == ["drawing", "estimate", "statement", "unknown"]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_code_normal_form(spark):
    assert one(spark, "0471-022-П-12/01-0003-КС-009-4512-016-03-КМ", co.normalize) == "471-22-П-12/1-3-КС-9-4512-16-3-КМ"
    assert one(spark, " prj_001..r\u00a0ar ", co.normalize) == "PRJ-1-R-AR"


@pytest.mark.parametrize("code,want", [
    ("0471-022-П-12/1-0003-КС-009-4512-016-3-КМ", {"project_code": "471", "site_code": "22", "stage": "П", "section_number": "12/1", "volume_number": "3", "document_group": "КС", "document_number": "9", "work_code": "4512", "subobject_code": "16", "part_number": "3", "mark": "КМ", "status": "parsed"}),
    ("001-R-AR", {"project_code": "1", "stage": "Р", "mark": "AR", "status": "parsed", "site_code": None, "ambiguity": None}),
    ("PRJ-KM", {"mark": "KM", "stage": None, "ambiguity": "mark_without_documentation_stage"}),
    ("ISO-19650", {"status": "unsupported"}),
    ("", {"status": "invalid", "project_code": None}),
    ("PRJ-SUBSEC-SEC5-REV", {"section_number": "5", "revision": "REV"}),
])
def test_code_parts(spark, code, want):
    r = co.parse(spark.createDataFrame([(code,)], "code string")).first().asDict()
    assert {k: r[k] for k in want} == want


def test_identities(spark):
    df = spark.createDataFrame([(1, "own_code", 1, "001-R-AR"), (1, "own_code", 2, "002-R-AR"), (1, "reference_code", 3, "X-1"), (2, "reference_code", 1, "ISO-1")], "version_id long, role string, pos long, raw string")
    keys = {(r.version_id, r.identity_key) for r in co.identities(df).collect()}
    assert keys == {(1, "own_code:parsed:1-R-AR"), (1, "reference_code:parsed:X-1:0"), (2, "reference_code:unsupported:ISO-1:0"), (2, "own_code:missing")}


def test_facets_need_a_stage(spark):
    assert one(spark, "PRJ-KM", co.facets).mark is None and one(spark, "PRJ-P-KM", co.facets).mark == "KM"


def test_titles(spark):
    df = spark.createDataFrame([(1, 1, "N1", "N1"), (1, 2, "КС 9 «Дальнереченская»", "N1"), (1, 3, 'КС-9 "Дальнереченская"', "N1"), (1, 4, "Something else", "N1")], "node_id long, id long, title string, key string")
    assert [r.status for r in co.title_conflicts(df).orderBy("id").collect()] == ["placed", "placed", "placed", "ambiguous"]


def tree(spark):
    return spark.createDataFrame([("root", "project", None, "Root", "P"), ("a", "stage", "root", "Alpha", "A"), ("b", "stage", "root", "Beta", "B"), ("a-1", "mark", "a", "First", "A1")], "id string, kind string, parent_id string, title string, code string")


def test_tree(spark):
    nodes = tree(spark)
    placed = spark.createDataFrame([("a-1", "v1", "placed"), ("a-1", "v1", "ambiguous"), ("b", "v2", "unplaced")], "node_id string, version_id string, status string")
    assert {r.id: r.documents for r in tr.rollup(nodes, placed).collect()} == {"root": 1, "a": 1, "a-1": 1, "b": 0}
    assert {r.id for r in tr.search(nodes, "A1").collect()} == {"root", "a", "a-1"}
    assert {r.id: r.path_code for r in tr.paths(nodes).collect()}["a-1"] == "P.A.A1" and {r.id for r in tr.search(nodes, "P.A.A1").collect()} == {"root", "a", "a-1"}
    looped = spark.createDataFrame([("x", "y"), ("y", "x")], "id string, parent_id string")
    assert tr.closure(looped).count() == 4


def test_placement_chain(spark):
    parsed = co.parse(spark.createDataFrame([("PRJ-R-AR",)], "code string"))
    assert {(r.kind, r.key) for r in tr.materialise(parsed).collect()} == {("project", "PRJ"), ("documentation_stage", "Р"), ("mark", "AR")}


def test_dependencies(spark):
    jobs = spark.createDataFrame([(1, "completed"), (2, "cancelled"), (3, "running")], "id long, status string")
    deps = spark.createDataFrame([(10, d, c) for d in (1, 2, 3, 9) for c in ("completed", "completed_or_skipped")], "job_id long, depends_on long, condition string")
    assert {(r.depends_on, r.condition) for r in jb.unmet(deps, jobs).collect()} == {(2, "completed"), (3, "completed"), (3, "completed_or_skipped"), (9, "completed"), (9, "completed_or_skipped")}


def test_retry_until_attempts_run_out(spark):
    jobs = spark.createDataFrame([(a, "failed", a, 3) for a in range(4)], "id long, status string, attempts int, max_attempts int")
    got = {r.id: (r.status, r.next_run_at) for r in jb.retry(jobs, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), 1000).collect()}
    assert got == {0: ("queued", "2024-01-01 00:00:01"), 1: ("queued", "2024-01-01 00:00:01"), 2: ("failed", None), 3: ("failed", None)}


def test_redelivery_without_checkpoint(spark):
    d = spark.createDataFrame([("c", 1, 1), ("c", 1, 2), ("c", 2, 3)], "consumer string, event_id long, seen long")
    seen = spark.createDataFrame([("c", 2)], "consumer string, event_id long")
    assert [tuple(r) for r in ev.effects(d, seen).select("event_id", "seen").collect()] == [(1, 1)]
    assert ev.effects(d, seen.limit(0)).count() == 2  # replay after clearing: each once


def test_set_status(spark):
    versions = spark.createDataFrame([(1, 7, "ready"), (2, 8, "created"), (3, 9, "ready"), (4, 9, "failed")], "id long, set_id long, status string")
    placed = spark.createDataFrame([(1, "placed"), (3, "ambiguous")], "version_id long, status string")
    got = {r.set_id: (r.status, r.codes) for r in fa.summary(versions, placed).collect()}
    assert got == {7: ("completed", ""), 8: ("processing", "document_identity_unplaced"), 9: ("completed_with_warnings", "document_version_processing_failed|project_structure_placement_ambiguous")}


def test_inline_limit(spark):
    n = so.INLINE_BYTES
    rows = spark.createDataFrame([(1, "x" * n), (2, "x" * (n + 1))], "id long, payload string")
    got = {r.id: r.storage for r in so.spill(rows).collect()}
    assert got == {1: "inline", 2: "payload_ref"}


@pytest.mark.parametrize("f,value,want", [
    (tx.number, "итого -1 234,50 руб", -1234.5), (tx.number, "нет", None), (tx.display_text, "  «Дом» — 5  , ", '"Дом" - 5'), (tx.estimate_number, "Смета № 02-01 \nx", "02-01"),
    (tx.repair_confusables, "CТAЛЬ C345", "СТАЛЬ C345"), (tx.ordinal, "lO|.", "101"), (tx.technical, "площадь 5 м2, Ø 10 ПИ", "площадь 5 м², Ø 10 III"), (tx.base_name, "a/b\\ My  File.PDF", "my file"), (tx.noise, "", 1.0), (tx.noise, "ab~~", 0.5),
])
def test_texts(spark, f, value, want):
    assert one(spark, value, f) == want


def test_sentences_keep_decimals(spark):
    assert one(spark, "Длина 1.5 м. Конец.", tx.sentences) == ["Длина 1.5 м", "Конец"]


def test_addresses(spark):
    assert tuple(one(spark, "AB12", tx.a1)) == (12, 28) and tuple(one(spark, "Z1", tx.a1)) == (1, 26)


@pytest.mark.parametrize("path,safe", [("a/b.pdf", True), ("../a", False), ("a/../../b", False), ("/etc", False), ("C:\\x", False), ("a\\..\\b", False), ("a..b", True), ("", False)])
def test_safe_paths(spark, path, safe):
    assert one(spark, path, it.safe_path) == safe


def test_work_names(spark):
    from tessera.operators.content import work_context

    rows = [('Магистральный газопровод Сахалин-Хабаровск-Владивосток. Этап 12.1. КС-9 "Дальнереченская"', 'Монтажные работы.Этап 12.1. КС-9 "Дальнереченская" Установка подготовки газа.Технология производства. Монтаж оборудования'), (None, None), ("Завод", "на Котельную. Две технологические линии")]
    a, b, c = work_context(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, construction string, work string")).orderBy("id").collect()
    assert (a.project, a.work_kind, a.stage, a.site) == ("Магистральный газопровод Сахалин-Хабаровск-Владивосток", "Монтажные работы", "Этап 12.1", 'КС-9 "Дальнереченская"')
    assert (a.facility, a.subfacility, a.scope, a.parse_status) == ("Установка подготовки газа", "Технология производства", "Монтаж оборудования", "parsed")
    assert b.parse_status == "missing" and (c.facility, c.scope, c.parse_status) == ("Котельную", None, "parsed")


def test_codes_in_content(spark):
    from tessera.operators.content import content_codes

    doc = '{"text":"PRJ-1","cells":[{"value":"none"},{"value":"drawing_A_2"},{"value":"prj 1"}],"rows":[{"cells":[{"value":"B-3"}]}]}'
    got = content_codes(spark.createDataFrame([(1, 1, doc), (1, 2, '{"value":"A-2"}'), (2, 3, "broken")], "version_id int, id int, payload string")).orderBy("id", "n").collect()
    assert [(r.version_id, r.kind, r.code) for r in got] == [(1, "direct", "PRJ-1"), (1, "cell", "A-2"), (1, "row", "B-3")]


def test_locale_order(spark):
    from tessera.operators.content import locale_sorted

    assert [r.t for r in locale_sorted(spark.createDataFrame([("ё",), ("ж",), ("е",), ("Е",)], "t string"), "t").collect()][-1] == "ж"


def test_closure_doubles_paths(spark, monkeypatch):
    steps = []
    real = tr.stored
    monkeypatch.setattr(tr, "stored", lambda df: steps.append(1) or real(df))
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(50)], "id string, parent_id string")
    out = tr.closure(chain)
    got = {(r.ancestor, r.id): r.depth for r in out.collect()}
    assert got == {(f"n{a}", f"n{i}"): i - a for i in range(50) for a in range(i + 1)}
    assert len(steps) <= 1 + 2 * 7  # nodes once, then paths and jumps in at most seven steps
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_closure_of_cycles_and_strays(spark):
    rows = [("a", "c"), ("b", "a"), ("c", "b"), ("t", "a"), ("s", "s"), ("x", "gone")]
    got = {(r.ancestor, r.id): r.depth for r in tr.closure(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    ring = {("a", "a"): 0, ("c", "a"): 1, ("b", "a"): 2, ("b", "b"): 0, ("a", "b"): 1, ("c", "b"): 2, ("c", "c"): 0, ("b", "c"): 1, ("a", "c"): 2}
    assert got == ring | {("t", "t"): 0, ("a", "t"): 1, ("c", "t"): 2, ("b", "t"): 3, ("s", "s"): 0, ("x", "x"): 0}

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import archives as ar
from tessera.sources import stores as so
from tessera.sources.xlsx import read_xlsx
from tessera.streaming.events import advance, windowed_counts

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path):
    sheet = f'<worksheet {MAIN}><cols><col min="1" max="2" width="20" hidden="1"/></cols><sheetData><row r="1" ht="30"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in </t><t>line</t></is></c><c r="D3"><f>1+1</f><v>2</v></c><c r="E3" t="b"><v>1</v></c><c r="F3"/></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Лист" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><r><t>sha</t></r><r><t>red</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_xlsx(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    rows = read_xlsx(spark, str(tmp_path)).collect()
    cells = {r.ref: (r.row, r.col, r.value, r.value_type) for r in rows if r.kind == "cell"}
    assert cells == {"A1": (1, 1, "shared", "string"), "C1": (1, 3, "2.5", "number"), "B3": (3, 2, "in line", "string"), "D3": (3, 4, "2", "formula"), "E3": (3, 5, "true", "boolean")}
    assert [(r.col, r.number, r.hidden) for r in rows if r.kind == "column"] == [(1, 20.0, True), (2, 20.0, True)]
    assert [r.ref for r in rows if r.kind == "merge"] == ["A1:B2"] and [r.number for r in rows if r.kind == "row"] == [30.0]
    assert [r.value for r in rows if r.kind == "error"] == ["BadZipFile"]


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("ok/x.pdf", "../bad.pdf", "skip.txt", "y.XLSX"):
            z.writestr(name, name)
    (tmp_path / "b.zip").write_bytes(b"?")
    got = {(r.path, r.size_bytes, r.error) for r in ar.extract_zip(spark, str(tmp_path)).collect()}
    assert got == {("ok/x.pdf", 8, None), ("y.XLSX", 6, None), (None, None, "BadZipFile")}


def test_listing(spark):
    text = "7-Zip\n\nPath = a.7z\nType = 7z\n\n----------\nPath = папка\nFolder = +\n\nPath = папка/f.pdf\nSize = 12\nFolder = -\n\n"
    df = spark.createDataFrame([("a", text.encode("cp866"))], "archive string, raw binary").select("archive", ar.decode_listing(F.col("raw")).alias("text"))
    assert [tuple(r) for r in ar.parse_listing(df).collect()] == [("a", "папка", None, True), ("a", "папка/f.pdf", 12, False)]


def test_prometheus(spark):
    df = spark.createDataFrame([({"p": 'a"b', "a": "1"}, 2.0), ({"p": "c", "a": "1"}, 1.23456)], "labels map<string,string>, value double")
    assert [r[0] for r in so.prometheus(df, "jobs", "Jobs.", "gauge").collect()] == ["# HELP jobs Jobs.", "# TYPE jobs gauge", 'jobs{a="1",p="a\\"b"} 2', 'jobs{a="1",p="c"} 1.235']


def test_tsv(spark):
    head = "\t".join(so.TSV)
    tsv = head + "\n5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t90\tone\n5\t1\t1\t1\t1\t2\t0\t0\t9\t9\t-1\ttwo\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n"
    got = so.mean_confidence(so.parse_tsv(spark.createDataFrame([(1, tsv)], "id long, tsv string"))).first()
    assert (got.confidence, got.text) == (0.9, "one two")


def test_payloads(spark, tmp_path):
    rows = spark.createDataFrame([(1, "inline", "a", None), (2, "payload_ref", None, "k")], "id long, storage string, payload string, ref string")
    store = spark.createDataFrame([("k", "b")], "ref string, body string")
    assert {r.id: r.payload for r in so.hydrate(rows, store).collect()} == {1: "a", 2: "b"}
    doc = json.dumps({"a": [{"payloadRef": {"key": "x"}}, {"b": {"payloadRef": {"key": "y"}}}]})
    assert {r.key for r in so.payload_refs(spark.createDataFrame([(1, doc), (2, "no json"), (3, None)], "id long, payload string")).collect()} == {"x", "y"}


def test_staged_write(spark, tmp_path):
    out = f"{tmp_path}/t"
    assert so.staged_write(spark.range(3), out, lambda df: df.count() == 3) and spark.read.parquet(out).count() == 3
    assert not so.staged_write(spark.range(5), out, lambda df: False) and spark.read.parquet(out).count() == 3


def test_registry(spark):
    r = so.Registry()
    r.register("p", "t", lambda df: df.select("id"))
    with pytest.raises(ValueError):
        r.register("p", "t", lambda df: df)
    out, rest = r.run(spark.createDataFrame([(1, "p", "t"), (2, "q", "t")], "id long, processor_id string, job_type string"))
    assert out["p", "t"].count() == 1 and rest.first().error == "unknown_processor"


def test_engine(spark):
    got = so.recognise(spark.createDataFrame([(1, b"abc")], "id long, image binary"), lambda image: (image.decode(), 0.5)).first()
    assert tuple(got) == (1, "abc", 0.5)


def test_small_reads(spark, tmp_path):
    (tmp_path / "o.bin").write_bytes(io.BytesIO(b"12345").getvalue())
    assert [r.length for r in so.objects(spark, str(tmp_path), "*.bin", content=False).collect()] == [5]
    df = spark.createDataFrame([("o1", 1), ("o2", 2)], "org_id string, id long")
    assert so.tenant(df, "o1").count() == 1 and so.lookup(df, org_id="o2", id=2).count() == 1 and so.with_ids(df, "id", []).count() == 0
    assert json.loads(so.to_json(df.where("id = 1")).first()[0]) == {"org_id": "o1", "id": 1}


def test_state_machine():
    s = ("queued", 0)
    for command, want in (("complete", ("queued", 0)), ("start", ("running", 0)), ("fail", ("queued", 1)), ("start", ("running", 1)), ("fail", ("queued", 2)), ("start", ("running", 2)), ("fail", ("failed", 3)), ("cancel", ("cancelled", 3)), ("start", ("cancelled", 3))):
        s = advance(*s, command)
        assert s == want


def test_windows(spark):
    df = spark.createDataFrame([(1, "a", "2024-01-01 00:10:00"), (2, "a", "2024-01-01 00:50:00"), (3, "a", "2024-01-01 01:00:00")], "id long, type string, at string").withColumn("published_at", F.col("at").cast("timestamp"))
    assert sorted((r.begin, r.n) for r in windowed_counts(df).collect()) == [("2024-01-01 00:00:00", 2), ("2024-01-01 01:00:00", 1)]

"""Data sources by name, and the sink whose jobs count whole or not at all."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import formats as fm
from tessera.sources import stores as so
from tests.test_sources import MAIN, workbook


@pytest.fixture(scope="module")
def formats(spark):
    fm.register(spark)
    return spark


def test_members_of_one_archive_in_several_partitions(formats, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(10):
            z.writestr(f"dir/{i}.pdf", str(i) * 400)
        for name in ("../up.pdf", "/root.pdf", "c:/x.pdf", "skip.txt", "big.XLSX"):
            z.writestr(name, "b" * 5000)
    (tmp_path / "b.zip").write_bytes(b"?")
    df = formats.read.format("tessera_zip").option("bytes", 1000).load(str(tmp_path))
    got = {r.path: (r.size_bytes, r.checksum, r.content) for r in df.where("error is null").collect()}
    assert set(got) == {"big.XLSX", *(f"dir/{i}.pdf" for i in range(10))} and bytes(got["dir/7.pdf"][2]) == b"7" * 400
    assert df.rdd.getNumPartitions() == 5 + 1 + 1  # two small members each, the large one, the broken archive
    assert [(os.path.basename(r.archive), r.error) for r in df.where("error is not null").collect()] == [("b.zip", "BadZipFile")]
    assert {r.error for r in formats.read.format("tessera_zip").option("maxEntries", 3).load(str(tmp_path)).collect()} == {"archive_limits", "BadZipFile"}
    assert {r.error for r in formats.read.format("tessera_zip").option("maxBytes", 3).load(str(tmp_path)).collect()} == {"archive_limits", "BadZipFile"}


def test_many_members_come_in_volumes(formats, tmp_path):
    from tessera.plans import sources

    orders = formats.range(30_000).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey", "'2-HIGH' AS o_orderpriority").union(formats.range(1, 2).selectExpr("id", "1L", "'1-URGENT'"))
    orders = orders.selectExpr("o_orderkey", "20 * (o_custkey % 2) AS o_custkey", "o_orderpriority")  # one archive, three times what one may hold; a name twice
    (tmp_path / "sf").mkdir()
    orders.write.parquet(str(tmp_path / "sf" / "orders.parquet"))
    got = sources.zip_members(formats, str(tmp_path / "sf"))
    want = formats.sql(sources.MEMBERS, orders=orders).where("name not like '../%' and name not like '%.txt'").selectExpr("file", "name", "octet_length(content)", "sha2(content, 256)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10_000


def test_small_archives_share_a_partition(formats, tmp_path):
    for i in range(20):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            z.writestr("x.pdf", str(i))
    (tmp_path / "bad.zip").write_bytes(b"?")
    df = formats.read.format("tessera_zip").option("bytes", 10_000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 1 and df.where("error is null").count() == 20 and df.where("error is not null").count() == 1


def test_a_sheet_is_a_partition(formats, tmp_path):
    workbook(tmp_path / "a.xlsx")
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "two.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="p" r:id="r1"/><sheet name="q" r:id="r2"/><sheet name="gone" r:id="r3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in (1, 2, 3)) + "</Relationships>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {MAIN}><sheetData><row r="2"><c r="B2"><v>2</v></c></row><broken')
    df = formats.read.format("tessera_xlsx").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    cells = {(os.path.basename(r.path), r.sheet, r.ref): r.value for r in rows if r.kind == "cell"}
    assert cells[("a.xlsx", "Лист", "A1")] == "shared" and cells[("two.xlsx", "p", "A1")] == "1" and len([k for k in cells if k[0] == "a.xlsx"]) == 5
    assert {(os.path.basename(r.path), r.sheet, r.value) for r in rows if r.kind == "error"} == {("broken.xlsx", None, "BadZipFile"), ("two.xlsx", "q", "ParseError")}


def test_listings(formats, tmp_path):
    text = "7-Zip\n\nPath = a.7z\nType = 7z\n\n----------\r\nPath = папка\r\nFolder = +\r\n\r\nPath = папка/f.pdf\nSize = 12\nFolder = -\n\n"
    (tmp_path / "a.lst").write_bytes(text.encode("cp866"))
    (tmp_path / "b.lst").write_bytes(b"----------\nPath = last\nSize = x")
    got = {(os.path.basename(r.archive), r.path, r.size_bytes, r.folder) for r in formats.read.format("tessera_listing").load(str(tmp_path)).collect()}
    assert got == {("a.lst", "папка", None, True), ("a.lst", "папка/f.pdf", 12, False), ("b.lst", "last", None, False)}


def payloads(spark, folder):
    return spark.read.format("tessera_payloads").load(folder)


def test_large_payloads_are_objects(formats, tmp_path):
    folder = f"{tmp_path}/store"
    rows = formats.createDataFrame([(1, "small"), (2, "L" * 300), (3, None), (4, "L" * 300), (5, "é" * 60)], "id long, payload string").repartition(2)
    rows.write.format("tessera_payloads").option("inline", 100).mode("append").save(folder)
    got = {r.id: (r.storage, r.payload, r.ref) for r in payloads(formats, folder).collect()}
    assert got[1] == ("inline", "small", None) and got[3] == ("inline", None, None)
    assert got[2][0] == "payload_ref" and got[2][1] is None and got[2][2] == got[4][2] and got[5][0] == "payload_ref"  # bytes count, not letters
    objects = so.objects(formats, f"{folder}/jobs", "*")
    store = objects.where("path like '%/payloads/%'").select(F.concat(F.lit("jobs/"), F.substring_index("path", "/jobs/", -1)).alias("ref"), F.col("content").cast("string").alias("body"))
    assert {r.id: r.payload for r in so.hydrate(payloads(formats, folder), store).collect()} == {1: "small", 2: "L" * 300, 3: None, 4: "L" * 300, 5: "é" * 60}


def test_payloads_are_read_back_with_their_rows(formats, tmp_path, monkeypatch):
    from tessera.plans.sources import spilled_payloads

    folder = f"{tmp_path}/store"
    want = [(k, None if k % 7 == 0 else "é" * (k % 90)) for k in range(300)] + [(5, "L" * 400), (None, "L" * 400), (5, "")]
    formats.createDataFrame(want, "id long, payload string").repartition(3).write.format("tessera_payloads").option("inline", 60).mode("append").save(folder)
    got = formats.read.format("tessera_payloads").option("bodies", "true").load(folder).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    assert sorted(((r.id, r.payload) for r in got), key=key) == sorted(want, key=key)
    assert all((r.storage == "payload_ref") == (r.ref is not None) == (len((r.payload or "").encode()) > 60) for r in got)
    # stretches of a batch end by bytes
    reader = fm.PayloadReader({"path": folder, "bodies": "TRUE"})
    monkeypatch.setattr(fm, "BODY_BYTES", 500)
    sizes = [sum(len(x or "") for x in b["payload"].to_pylist()) for p in reader.partitions() for b in reader.read(p)]
    assert sum(sizes) == sum(len(t or "") for _, t in want) and len(sizes) > 10 and max(sizes) < 500 + 8 * 400
    # ids that repeat give their own rows, and nothing is joined
    docs = [(1, "a" * 2001), (1, "b"), (1, "a" * 2001), (2, None)]
    formats.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/in/documents.parquet")
    df = spilled_payloads(formats, f"{tmp_path}/in")
    assert sorted((r.id, r.storage, r.digest is None) for r in df.collect()) == [(1, "inline", False), (1, "payload_ref", False), (1, "payload_ref", False), (2, "inline", True)]
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    os.remove(next(os.path.join(d, f) for d, _, fs in os.walk(f"{folder}/jobs") for f in fs if d.endswith("/payloads")))
    with pytest.raises(Exception, match="payloads/"):
        formats.read.format("tessera_payloads").option("bodies", "true").load(folder).collect()


def test_a_task_that_fails_leaves_the_old_table(formats, tmp_path):
    folder = f"{tmp_path}/store"
    save = lambda df, mode: df.write.format("tessera_payloads").option("inline", 10).mode(mode).save(folder)
    one = formats.createDataFrame([(1, "a" * 50), (2, "b")], "id long, payload string")
    save(one, "append")
    before, objects = sorted(map(tuple, payloads(formats, folder).collect())), {f for _, _, fs in os.walk(folder) for f in fs}

    def fail(batches):
        for i, b in enumerate(batches):
            yield b
            raise RuntimeError("lost")

    bad = formats.range(40).coalesce(1).selectExpr("id", "repeat('x', 50) AS payload").mapInPandas(fail, "id long, payload string")
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            save(bad, mode)
        assert sorted(map(tuple, payloads(formats, folder).collect())) == before and {f for _, _, fs in os.walk(folder) for f in fs} == objects
    save(formats.createDataFrame([(3, "c")], "id long, payload string"), "append")
    assert sorted(r.id for r in payloads(formats, folder).collect()) == [1, 2, 3]
    save(formats.createDataFrame([(4, "d")], "id long, payload string"), "overwrite")
    assert [r.id for r in payloads(formats, folder).collect()] == [4]


def test_leftovers_of_lost_jobs(formats, tmp_path):
    folder = f"{tmp_path}/store"
    formats.createDataFrame([(1, "a" * 50)], "id long, payload string").write.format("tessera_payloads").option("inline", 10).mode("append").save(folder)
    os.makedirs(f"{folder}/jobs/lost/payloads")
    assert fm.vacuum(folder) == [] and fm.vacuum(folder, older_than=0) == ["lost"]
    assert payloads(formats, folder).count() == 1 and os.listdir(f"{folder}/jobs") != ["lost"]

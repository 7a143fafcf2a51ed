"""Queries that read, by format name, files made from the driver's tables, and the same for DuckDB."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.intake import MAX_ENTRIES
from tessera.operators.lineage import shared_folder
from tessera.plans.fixtures import table
from tessera.sources import formats as fm

Q: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


def files(rows: DataFrame, by: str, folder: str, make) -> None:
    """One file for each value of a column (``file``), made from its rows in the order of ``id``."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        system, root = fm._system(folder)
        system.create_dir(root, recursive=True)
        body = make(b.sort_values("id"))
        with system.open_output_stream(f"{root}/{b[by].iloc[0]}") as f:
            f.write(body)
        return pd.DataFrame({"n": [len(b)]})

    rows.groupBy(by).applyInPandas(run, "n long").agg(F.sum("n")).collect()


def base(column: str) -> F.Column:
    return F.substring_index(column, "/", -1)


#: Ids that lie so close may be members of one volume.
VOLUME_IDS = 50_000


def archives(rows: DataFrame, folder: str, entries: int = MAX_ENTRIES) -> None:
    """Archives of members (id, file, name, content) in the order of ``id``, in volumes: files of one name, each in a folder of its own and with no more entries than an archive may have.

    A task writes volume by volume as rows come in and holds one; volumes are named by what
    they hold, so a task that is repeated writes the same.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fm._system(folder)
        key, n, volume, out, z = None, 0, 0, None, None

        def close() -> None:
            if z is None:
                return
            z.close()
            home = f"{root}/{key[1]}-{volume}"
            system.create_dir(home, recursive=True)
            with system.open_output_stream(f"{home}/{key[0]}") as f:
                f.write(out.getbuffer())

        for b in batches:
            for file, part, name, content in zip(b["file"], b["part"], b["name"], b["content"]):
                if (file, part) != key or n == entries:
                    close()
                    volume = volume + 1 if (file, part) == key else 0
                    key, n, out = (file, part), 0, io.BytesIO()
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(name, content)
                n += 1
            yield pd.DataFrame({"n": [len(b)]})
        close()

    parts = rows.withColumn("part", F.floor(F.col("id") / VOLUME_IDS)).repartition("file", "part").sortWithinPartitions("file", "part", "id", "name", "content")
    parts.mapInPandas(run, "n long").agg(F.sum("n")).collect()


MEMBERS = "SELECT o_orderkey AS id, concat('a', o_custkey % 20, '.zip') AS file, CASE WHEN o_orderkey % 17 = 0 THEN concat('../', o_orderkey, '.pdf') WHEN o_orderkey % 3 = 0 THEN concat('notes/', o_orderkey, '.txt') WHEN o_orderkey % 3 = 1 THEN concat('d/', o_orderkey, '.PDF') ELSE concat(o_orderkey, '.xlsx') END AS name, concat(o_orderpriority, repeat('-', CAST(o_orderkey % 50 AS INT)), o_orderkey) AS content FROM {orders}"


@query("sc10_zip_members", f"WITH m AS ({MEMBERS.format(orders='orders')}) SELECT file AS archive, name AS path, CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS checksum FROM m WHERE name NOT LIKE '../%' AND name NOT LIKE '%.txt'")
def zip_members(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "zips")
    archives(spark.sql(MEMBERS, orders=table(spark, d, "orders")), folder)
    fm.register(spark)
    return spark.read.format("tessera_zip").option("bytes", 4 << 20).load(folder).select(base("archive").alias("archive"), "path", "size_bytes", "checksum")


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org"


def workbook(b: pd.DataFrame) -> bytes:
    """Sheets s0 to s2 with a name, a number and a truth value in each row."""
    out, names = io.BytesIO(), sorted(set(b["sheet"]))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{RELS}/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{s}" r:id="{s}"/>' for s in names) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{RELS}/package/2006/relationships">' + "".join(f'<Relationship Id="{s}" Target="worksheets/{s}.xml"/>' for s in names) + "</Relationships>")
        for s in names:
            rows = [f'<row r="{r.id}"><c r="A{r.id}" t="inlineStr"><is><t>{r.title}</t></is></c><c r="B{r.id}"><v>{r.size}</v></c><c r="D{r.id}" t="b"><v>{int(r.size > 25)}</v></c></row>' for r in b[b["sheet"] == s].itertuples()]
            z.writestr(f"xl/worksheets/{s}.xml", f"<worksheet {NS}><sheetData>{''.join(rows)}</sheetData></worksheet>")
    return out.getvalue()


SHEETS = "SELECT p_partkey AS id, concat('w', p_partkey % 12, '.xlsx') AS file, concat('s', p_size % 3) AS sheet, replace(replace(p_name, '&', ''), '<', '') AS title, p_size AS size FROM {part}"


@query("sc6_xlsx_cells", f"""WITH s AS ({SHEETS.format(part='part')}) SELECT file, sheet, CAST(id AS INT) AS row, 1 AS col, title AS value, 'string' AS value_type FROM s WHERE title <> '' UNION ALL SELECT file, sheet, CAST(id AS INT), 2, CAST(size AS VARCHAR), 'number' FROM s
 UNION ALL SELECT file, sheet, CAST(id AS INT), 4, CASE WHEN size > 25 THEN 'true' ELSE 'false' END, 'boolean' FROM s""")
def xlsx_cells(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "workbooks")
    files(spark.sql(SHEETS, part=table(spark, d, "part")), "file", folder, workbook)
    fm.register(spark)
    return spark.read.format("tessera_xlsx").load(folder).where("kind = 'cell'").select(base("path").alias("file"), "sheet", "row", "col", "value", "value_type")


def listing(b: pd.DataFrame) -> bytes:
    blocks = [f"Path = {p}\r\nSize = {s}\r\nFolder = {'+' if f else '-'}\r\n" for p, s, f in zip(b["path"], b["size_bytes"], b["folder"])]
    return ("7-Zip\r\n\r\nPath = a.7z\r\n\r\n----------\r\n" + "\r\n".join(blocks) + "\r\n").encode("cp866")


ENTRIES = "SELECT c_custkey AS id, concat('l', c_nationkey, '.lst') AS file, concat('Раздел ', c_custkey % 9, '/', c_custkey, '.pdf') AS path, CAST(c_custkey * 37 AS BIGINT) AS size_bytes, c_custkey % 10 = 0 AS folder FROM {customer}"


@query("sc9_archive_listing", f"SELECT file AS archive, path, size_bytes, folder FROM ({ENTRIES.format(customer='customer')})")
def archive_listing(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "listings")
    files(spark.sql(ENTRIES, customer=table(spark, d, "customer")), "file", folder, listing)
    fm.register(spark)
    return spark.read.format("tessera_listing").load(folder).select(base("archive").alias("archive"), "path", "size_bytes", "folder")


@query("sc12_spilled_payloads", "SELECT doc_id AS id, CASE WHEN strlen(text) > 2000 THEN 'payload_ref' ELSE 'inline' END AS storage, md5(text) AS digest FROM documents")
def spilled_payloads(spark: SparkSession, d: str) -> DataFrame:
    """SC12/SC13/SC11: every text written, large ones as objects, and read back."""
    folder = shared_folder(spark, "payloads")
    fm.register(spark)
    table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("payload")).write.format("tessera_payloads").option("inline", 2000).mode("append").save(folder)
    rows = spark.read.format("tessera_payloads").option("bodies", "true").load(folder)
    return rows.select("id", "storage", F.md5("payload").alias("digest"))

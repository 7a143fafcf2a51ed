"""Deterministic derivations of the driver's tables that stand in for uploads, jobs, events, cells and boxes.

Each is one SQL text that Spark and DuckDB read alike; ``{table}`` names a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

EXTENSION = "CASE WHEN doc_id % 5 < 2 THEN '.xlsx' WHEN doc_id % 5 < 4 THEN '.pdf' ELSE '.txt' END"
ROW = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax)"

FIXTURES = {
    # project hierarchy: region, nation, customer; orders are placed document versions
    "nodes": """
        SELECT concat('R', r_regionkey) AS id, 'project' AS kind, CAST(NULL AS STRING) AS parent_id, r_name AS title, CAST(r_regionkey AS STRING) AS code FROM {region}
        UNION ALL SELECT concat('N', n_nationkey), 'stage', concat('R', n_regionkey), n_name, CAST(n_nationkey AS STRING) FROM {nation}
        UNION ALL SELECT concat('C', c_custkey), 'mark', concat('N', c_nationkey), c_name, CAST(c_custkey AS STRING) FROM {customer}""",
    "placements": """
        SELECT o_orderkey AS id, concat('V', o_orderkey) AS version_id, concat('C', o_custkey) AS node_id,
               CASE o_orderstatus WHEN 'F' THEN 'placed' WHEN 'O' THEN 'ambiguous' ELSE 'unplaced' END AS status, o_orderdate AS created_at FROM {orders}""",
    "jobs": """
        SELECT o_orderkey AS id, o_orderpriority AS processor_id, CASE WHEN o_custkey % 2 = 0 THEN 'detect' ELSE 'extract' END AS job_type,
               CASE o_custkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'queued' WHEN 2 THEN 'running' WHEN 3 THEN 'completed' WHEN 4 THEN 'failed' ELSE 'cancelled' END AS status,
               o_orderkey % 97 AS wait_s, (o_orderkey * 37) % 1300 AS duration_s, o_orderkey % 4 AS attempts, 4 AS max_attempts,
               o_custkey AS set_id, o_orderdate AS created_at,
               CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE CAST(NULL AS TIMESTAMP) END AS next_run_at, o_orderkey % 11 AS causation_id FROM {orders}""",
    "dependencies": """
        SELECT o_orderkey AS job_id, (o_orderkey * 7 + 3) % 15000 AS depends_on, CASE WHEN o_orderkey % 4 < 2 THEN 'completed' ELSE 'completed_or_skipped' END AS condition
        FROM {orders} WHERE o_orderkey % 5 <> 0""",
    "versions": """
        SELECT o_orderkey AS id, o_custkey AS set_id, o_custkey % 50 AS document_id,
               CASE o_orderkey % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'failed' WHEN 2 THEN 'unsupported' ELSE 'ready' END AS status, o_orderdate AS created_at FROM {orders}""",
    "log": "SELECT event_id AS id, event_type AS type, user_id AS aggregate_id, ts AS published_at, value, props AS payload FROM {events}",
    "checkpoints": "SELECT event_id, 'c1' AS consumer FROM {events} WHERE event_id % 3 = 0",
    "files": f"""
        SELECT doc_id AS id, doc_id % 7 AS set_id, concat('Dir/  F', doc_id % 400, ' x', {EXTENSION}) AS original_name, {EXTENSION} AS extension,
               CASE WHEN doc_id % 50 = 0 THEN 0 ELSE n_chars END AS size_bytes, CASE WHEN doc_id % 41 = 0 THEN CAST(NULL AS STRING) ELSE md5(text) END AS checksum,
               CASE WHEN doc_id % 10 = 0 THEN 'archive_member' ELSE 'original_upload' END AS purpose, source AS folder FROM {{documents}}""",
    "codes": """
        SELECT p_partkey AS id, concat(lpad(CAST(p_partkey AS STRING), 4, '0'), '_', substr('PRIX', CAST(p_size % 4 AS INT) + 1, 1), '.', lpad(CAST(p_size AS STRING), 3, '0'), ' ', p_type) AS raw,
               p_partkey % 90 AS version_id, p_name AS title FROM {part}
        UNION ALL SELECT p_partkey + 1000000, concat('0', p_partkey % 500, '-0', p_size, '-', substr('ПРИ', CAST(p_size % 3 AS INT) + 1, 1), '-12/01-0003-КС-009-', 4000 + p_partkey % 600, '-016-03-КМ'), p_partkey % 90, p_brand FROM {part} WHERE p_partkey % 3 = 0
        UNION ALL SELECT p_partkey + 2000000, concat('iso.', p_size, '--ifc_', p_partkey), p_partkey % 90, p_brand FROM {part} WHERE p_partkey % 17 = 0
        UNION ALL SELECT p_partkey + 3000000, concat('PRJ', p_size, '-VOL', p_size % 5, '-SEC', p_size % 3, '-REV-KM'), p_partkey % 90, p_brand FROM {part} WHERE p_partkey % 13 = 0""",
    "line_rows": f"SELECT l_orderkey AS sheet, {ROW} AS row, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS flag FROM {{lineitem}}",
    "words": """
        SELECT p_partkey AS id, p_partkey % 10 AS page, p_partkey % 4 AS block, p_partkey % 12 AS line, p_partkey * 7 % 100 AS x, p_partkey * 13 % 100 AS y, 5 + p_size % 10 AS w, 3 AS h, p_name AS text FROM {part}""",
    "crops": """
        SELECT s_suppkey AS id, s_suppkey % 10 AS page, s_suppkey * 11 % 80 AS x, s_suppkey * 17 % 80 AS y, 25 AS w, 20 AS h FROM {supplier}""",
    "hypotheses": f"""
        SELECT l_suppkey AS region, l_linenumber AS row, l_partkey % 8 AS col, CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 90 END AS rotation, round(l_discount * 10, 2) AS confidence,
               concat(l_returnflag, CASE WHEN l_quantity > 25 THEN '~|' ELSE ' ok' END, l_orderkey % 100) AS text, l_orderkey * 100 + {ROW} AS pos FROM {{lineitem}}""",
}

_LINES = FIXTURES["line_rows"]
FIXTURES["cells"] = f"""
        SELECT sheet, row, 1 AS col, CAST(line AS STRING) AS value, row * 10 + 1 AS pos FROM ({_LINES}) a
        UNION ALL SELECT sheet, row, 2, concat('Part  ', part, ' .'), row * 10 + 2 FROM ({_LINES}) b
        UNION ALL SELECT sheet, row, 3, CASE WHEN row % 3 = 0 THEN '' ELSE flag END, row * 10 + 3 FROM ({_LINES}) c
        UNION ALL SELECT sheet, row, 4, concat('x ', CAST(quantity AS BIGINT), ' шт'), row * 10 + 4 FROM ({_LINES}) d
        UNION ALL SELECT sheet, row, 5, concat(CAST(floor(price) AS BIGINT), ',50'), row * 10 + 5 FROM ({_LINES}) e
        UNION ALL SELECT sheet, row, 1, concat('0', line), row * 10 + 6 FROM ({_LINES}) g WHERE row % 4 = 0
        UNION ALL SELECT o_orderkey, 100, 1, 'Всего  по смете', 1001 FROM {{orders}} WHERE o_orderkey % 5 < 2
        UNION ALL SELECT o_orderkey, 100, 3, concat('-', o_orderkey % 900), 1003 FROM {{orders}} WHERE o_orderkey % 5 < 2
        UNION ALL SELECT o_orderkey, 100, 4, concat(o_orderkey % 500, '.25'), 1004 FROM {{orders}} WHERE o_orderkey % 5 < 2
        UNION ALL SELECT o_orderkey, 101, 1, 'Локальный сметный расчет', 1011 FROM {{orders}} WHERE o_orderkey % 4 = 0
        UNION ALL SELECT o_orderkey, 102, k, v, 1020 + k FROM {{orders}} CROSS JOIN (VALUES (1, 'Обоснование'), (2, 'Наименование работ'), (3, 'Единица'), (4, 'Количество')) t(k, v) WHERE o_orderkey % 3 = 0
        UNION ALL SELECT o_orderkey, 103, 1, 'Ведомость ресурсов', 1031 FROM {{orders}} WHERE o_orderkey % 6 = 1
        UNION ALL SELECT o_orderkey, 104 + k, 1, v, 1041 + k FROM {{orders}} CROSS JOIN (VALUES (1, 'Трудозатраты'), (2, 'Материалы')) t(k, v) WHERE o_orderkey % 6 < 3
        UNION ALL SELECT o_orderkey, 99, 1, 'Основание: проект', 991 FROM {{orders}} WHERE o_orderkey % 7 = 0"""


def at_once(*cells: tuple[str, str, str, str, str]) -> str:
    """Cells (condition, row, col, value, pos) of one row, as a generator of Spark; a cell that is not there has no row number."""
    each = ", ".join(f"IF({when}, named_struct('row', {r}, 'col', {col}, 'value', {value}, 'pos', {pos}), NULL)" for when, r, col, value, pos in cells)
    return f"inline(array({each}))"


_ORDER = ROW.split("ORDER BY ")[1].rstrip(")")
_LINE = [("kind = 0", "row", str(k), v, f"row * 10 + {k}") for k, v in enumerate(("CAST(line AS STRING)", "concat('Part  ', part, ' .')", "CASE WHEN row % 3 = 0 THEN '' ELSE flag END", "concat('x ', CAST(quantity AS BIGINT), ' шт')", "concat(CAST(floor(price) AS BIGINT), ',50')"), 1)]
_LINE.append(("kind = 0 AND row % 4 = 0", "row", "1", "concat('0', line)", "row * 10 + 6"))
_SHEET = [(f"kind = 1 AND {when}", row, col, value, pos) for when, row, col, value, pos in (
    ("sheet % 5 < 2", "100", "1", "'Всего  по смете'", "1001"), ("sheet % 5 < 2", "100", "3", "concat('-', sheet % 900)", "1003"), ("sheet % 5 < 2", "100", "4", "concat(sheet % 500, '.25')", "1004"), ("sheet % 4 = 0", "101", "1", "'Локальный сметный расчет'", "1011"),
    *[("sheet % 3 = 0", "102", str(k), f"'{v}'", str(1020 + k)) for k, v in enumerate(("Обоснование", "Наименование работ", "Единица", "Количество"), 1)],
    ("sheet % 6 = 1", "103", "1", "'Ведомость ресурсов'", "1031"), *[("sheet % 6 < 3", str(104 + k), "1", f"'{v}'", str(1041 + k)) for k, v in ((1, "Трудозатраты"), (2, "Материалы"))], ("sheet % 7 = 0", "99", "1", "'Основание: проект'", "991"))]

#: line_rows where all lines of a sheet stay together under that name.
LINES_ONCE = f"SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY {_ORDER}) AS row, l_linenumber AS line, l_partkey AS part, l_quantity AS quantity FROM (SELECT l_orderkey AS sheet, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax FROM {{lineitem}}) b"

#: The same rows as the fixture of that name, for Spark: lines and orders move once, by sheet, and become cells where they are; what is grouped by sheet after that needs no exchange.
MOVED_ONCE = {
    "cells": f"""
        SELECT * FROM (SELECT sheet, {at_once(*_LINE, *_SHEET)} FROM (
          SELECT sheet, kind, row_number() OVER (PARTITION BY sheet, kind ORDER BY {_ORDER}) AS row, l_linenumber AS line, l_partkey AS part, l_quantity AS quantity, l_extendedprice AS price, l_returnflag AS flag FROM (
            SELECT /*+ REPARTITION(sheet) */ * FROM (
              SELECT l_orderkey AS sheet, 0 AS kind, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag FROM {{lineitem}}
              UNION ALL SELECT o_orderkey, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {{orders}}) b) m) n) o WHERE row IS NOT NULL""",
}

_TABLE = re.compile(r"\{(\w+)\}")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = MOVED_ONCE.get(name, FIXTURES[name])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_TABLE.findall(sql))}
    return spark.sql(sql, **tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ctes(*names: str, more: str = "", recursive: bool = False) -> str:
    """WITH clause of fixtures for DuckDB, and of further common tables."""
    parts = [f"{n} AS ({_TABLE.sub(r'\1', FIXTURES[n])})" for n in names]
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join([*parts, *([more] if more else [])]) + "\n"

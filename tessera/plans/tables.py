"""Queries of table reconstruction, and the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import tables as tb
from tessera.operators.lineage import stored
from tessera.plans.fixtures import FIXTURES, table

Q: dict[str, object] = {}
SQL: dict[str, str] = {}

#: A supplier's lines are a document's crops: tables by line number on three pages, nine rows and five columns each.
LINES = f"""
    SELECT supplier AS doc, line, concat('t', line) AS region, CAST(line % 3 AS INT) AS page, CAST(sheet % 9 AS INT) AS r, CAST(part % 5 AS INT) AS c, CAST(floor(line / 3) AS INT) AS i,
           concat(sheet, '-', row) AS candidate, row AS n, part, sheet, quantity, flag, discount, tax
    FROM ({FIXTURES['line_rows']}) l"""
ROWS = "CASE WHEN doc % 6 = 0 THEN 150 ELSE 60 END"
X0, Y0, W0 = "3e1 + i * (doc % 5) * 30", "i * (CASE WHEN doc % 6 = 0 THEN 16e2 ELSE 7e2 + doc % 3 * 60 END)", "(CASE WHEN doc % 2 = 0 THEN 120 ELSE 260 END)"
BOX = f"""{X0} + CASE WHEN c = 0 THEN 0 ELSE {W0} + (c - 1) * 260 END AS x, {Y0} + r * ({ROWS}) + CASE WHEN r > 0 AND doc % 6 = 0 THEN 110 ELSE 0 END AS y,
           CASE WHEN c = 0 THEN {W0} ELSE 260 END * 1e0 AS w, ({ROWS}) + CASE WHEN r = 0 AND doc % 6 = 0 THEN 11e1 WHEN r = 8 AND doc % 7 = 3 THEN 2e2 ELSE 0e0 END AS h"""
PARTS = {
    "cells": f"""
    SELECT DISTINCT doc, page, region, r AS row, c AS col, {BOX}, (r * 5 + c) % 10 / 10.0 AS confidence, CAST((r * 7 + c * 3) % 90 AS BIGINT) AS text_px,
           CASE WHEN doc % 10 = 5 AND line = 7 THEN 'wide_table_text_blocks' ELSE 'cv_grid' END AS mode
    FROM ({LINES}) a WHERE doc % 17 <> 9 AND NOT (r = 7 AND c > 1 AND doc % 4 = 1) AND (doc % 19 <> 4 OR r <> 3)""",
    "regions": f"""
    SELECT DISTINCT doc, page, region, 'table_candidate' AS kind, {X0} AS x, {Y0} AS y, {W0} + 104e1 AS w, CASE WHEN doc % 6 = 0 THEN 146e1 ELSE 54e1 END AS h,
           CASE WHEN line = 6 AND doc % 8 = 2 THEN 0.45 ELSE 0.8 END AS confidence, CASE WHEN line = 5 AND doc % 9 = 4 THEN 'suppressed_by_frame' END AS reason, CAST(line AS INT) AS pos FROM ({LINES}) a
    UNION ALL SELECT DISTINCT doc, page, concat('d', page), 'drawing_area', 2e2, 1e2 * page, 9e2, 1e3, 0.9, CAST(NULL AS STRING), 20 FROM ({LINES}) b WHERE doc % 3 = 1
    UNION ALL SELECT DISTINCT doc, page, concat('s', page), 'stamp', 42e1, 9e2, 5e2, 3e2, 0.9, CAST(NULL AS STRING), 21 FROM ({LINES}) e WHERE doc % 4 = 2""",
    "candidates": f"""
    SELECT doc, region, r AS row, c AS col, candidate, CASE WHEN part % 3 = 0 THEN 0 WHEN part % 3 = 1 THEN 90 ELSE 270 END AS rotation, CAST(1 + part % 2 AS INT) AS row_span, 1 AS column_span, {BOX},
           CAST(part % 10 AS DOUBLE) / 10 AS confidence, CASE WHEN part % 7 = 0 THEN split(concat(region, ',q', part % 3), ',') END AS sources, sheet * 100 + n AS pos
    FROM ({LINES}) a WHERE quantity > 25 AND (r < 7 OR doc % 4 <> 1) AND (c > 0 OR doc % 3 <> 1)""",
    "texts": f"""
    SELECT doc, candidate, CASE WHEN sheet % 8 = 0 THEN ' ' ELSE concat(flag, CASE WHEN sheet % 5 = 0 THEN '~|' ELSE ' ok' END, part % 4) END AS text,
           CASE WHEN sheet % 6 = 0 THEN CAST(NULL AS STRING) WHEN sheet % 8 = 0 THEN ' ' ELSE concat(flag, CASE WHEN sheet % 5 = 0 THEN '~|' ELSE ' ok' END, part % 4, CASE WHEN part % 9 = 0 THEN ' ' ELSE '' END) END AS raw_text,
           CASE WHEN discount > 0.08 THEN 'recognized_low_confidence' WHEN discount > 0.06 THEN 'recognized_suspicious' WHEN sheet % 8 = 0 THEN 'empty_text' WHEN tax > 0.07 THEN '' ELSE 'recognized' END AS status
    FROM ({LINES}) a WHERE sheet % 11 <> 0 AND doc % 13 <> 7""",
    "wide": f"SELECT DISTINCT doc, page, region FROM ({LINES}) a WHERE doc % 10 = 5 AND line = 4",
}
NOISE = r"CASE WHEN trim(text) = '' THEN 1.0 ELSE length(regexp_replace(trim(text), '[0-9A-Za-zА-Яа-яЁё№.,:;()/%+\-–—\s\"''«»×xХхØ²³]', '', 'g')) / length(trim(text)) END"
OVER = "greatest(least({0}.y + {0}.h, g.y + g.h) - greatest({0}.y, g.y), 0) >= 0.10 * least({0}.h, g.h)"

#: The steps one after another; each is a table that later ones read.
STEPS = [
    *[(name, sql.replace("{lineitem}", "lineitem")) for name, sql in PARTS.items()],
    ("ok", "SELECT * FROM regions WHERE kind = 'table_candidate' AND NOT starts_with(coalesce(reason, ''), 'suppressed_') AND confidence >= 0.5"),
    ("dr", "SELECT doc, page, arg_min({'x': x, 'y': y, 'h': h}, pos) AS b FROM regions WHERE kind = 'drawing_area' GROUP BY 1, 2"),
    ("sr", "SELECT doc, page, arg_min({'x': x, 'y': y, 'h': h}, pos) AS b FROM regions WHERE kind = 'stamp' GROUP BY 1, 2"),
    ("ed", f"SELECT g.*, greatest(CASE WHEN {OVER.format('d.b')} THEN d.b.x END, CASE WHEN {OVER.format('s.b')} THEN s.b.x END) AS edge FROM ok g LEFT JOIN dr d ON d.doc = g.doc AND d.page = g.page LEFT JOIN sr s ON s.doc = g.doc AND s.page = g.page"),
    ("ld", "SELECT doc, page, region, count(*) AS n, max(w) AS mw, min(x) AS mx, max(h) AS mh, sum(h) AS sh, max(x + w) AS rt FROM (SELECT *, min(col) OVER (PARTITION BY doc, page, region) AS f FROM cells WHERE mode = 'cv_grid') WHERE col = f GROUP BY 1, 2, 3"),
    ("lim", """SELECT ed.*, n, rt, CASE WHEN edge IS NOT NULL AND ed.x < edge AND ed.x + ed.w > edge THEN 'edge' WHEN edge IS NOT NULL AND ed.x + ed.w <= edge THEN 'outside'
       WHEN ed.w >= 1000 AND ed.h >= 1200 AND n >= 4 AND mw <= 140 AND mx <= ed.x + 24 AND mh >= 250 AND sh >= 0.65 * ed.h THEN 'strip' ELSE 'whole' END AS branch FROM ed LEFT JOIN ld USING (doc, page, region)"""),
    ("kept", """SELECT c.doc, c.page, c.region, c.row, c.col, c.x, c.y, c.w, c.h, greatest(0.3, least(c.confidence, lim.confidence)) AS confidence, c.text_px, c.mode FROM cells c JOIN lim USING (doc, page, region)
       WHERE c.mode = 'cv_grid' AND CASE branch WHEN 'edge' THEN c.x + c.w / 2 >= edge WHEN 'strip' THEN c.x + c.w / 2 > rt + 2 ELSE true END AND (c.doc, c.page, c.region) NOT IN (SELECT (doc, page, region) FROM wide)
       UNION ALL SELECT doc, page, region, row, col, x, y, w, h, 0.62, text_px, mode FROM cells WHERE mode <> 'cv_grid'"""),
    ("fr", """SELECT doc, page, region, min(y) AS y, min(x) AS x, max(r) AS r, max(b) AS b, median(h) AS m, count(*) AS n, row_number() OVER (PARTITION BY doc, page ORDER BY min(y), min(x), region) AS k
       FROM (SELECT doc, page, region, row, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b, max(h) AS h FROM kept GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""),
    ("fold", """SELECT doc, page, region, n, k, 0 AS g, CAST(x AS DOUBLE) AS x, CAST(r AS DOUBLE) AS r, CAST(b AS DOUBLE) AS b, [CAST(m AS DOUBLE)] AS ms FROM fr WHERE k = 1
       UNION ALL SELECT doc, page, region, n, k, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN least(x, fx) ELSE fx END, CASE WHEN j THEN greatest(r, fr) ELSE fr END, CASE WHEN j THEN greatest(b, fb) ELSE fb END, CASE WHEN j THEN list_append(ms, m) ELSE [m] END
       FROM (SELECT f.doc, f.page, f.region, f.n, f.k, g, o.x, o.r, o.b, ms, CAST(f.m AS DOUBLE) AS m, CAST(f.x AS DOUBLE) AS fx, CAST(f.r AS DOUBLE) AS fr, CAST(f.b AS DOUBLE) AS fb,
               f.y - o.b >= -6 AND greatest(least(o.r, f.r) - greatest(o.x, f.x), 0) / greatest(1, least(o.r - o.x, f.r - f.x)) >= 0.8 AND (abs(o.r - f.r) <= 90 OR abs(o.x - f.x) <= 90)
               AND f.y - o.b <= greatest(140, list_aggregate(list_append(ms, CAST(f.m AS DOUBLE)), 'median') * 3.6) AS j
             FROM fold o JOIN fr f ON f.doc = o.doc AND f.page = o.page AND f.k = o.k + 1)"""),
    ("grp", """SELECT doc, page, region, sum(n) OVER (w ORDER BY k) - n AS before, list(region) OVER (w ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS members FROM fold WINDOW w AS (PARTITION BY doc, page, g)"""),
    ("joined", """SELECT kept.*, CASE WHEN len(members) = 1 THEN members[1] ELSE members[1] || '-merged-' || substr(sha1(array_to_string(members, '|')), 1, 8) END AS table_id,
       CAST(CASE WHEN len(members) = 1 THEN row ELSE before + dense_rank() OVER (PARTITION BY kept.doc, kept.page, kept.region ORDER BY row) - 1 END AS BIGINT) AS table_row FROM kept JOIN grp USING (doc, page, region)"""),
    ("rd", "SELECT c.*, coalesce(t.text, '') AS text, coalesce(t.raw_text, t.text, '') AS raw_text, CASE WHEN t.candidate IS NULL THEN 'missing_ocr_text' ELSE coalesce(nullif(t.status, ''), 'unknown') END AS status FROM candidates c LEFT JOIN texts t USING (doc, candidate)"),
    ("pick", f"""SELECT doc, region, row, col, arg_min({{'candidate': candidate, 'row_span': row_span, 'x': x, 'y': y, 'w': w, 'h': h, 'confidence': confidence, 'text': text, 'raw_text': raw_text, 'status': status}},
       {{'a': CASE WHEN rotation = 0 THEN 0 ELSE 1 END, 'b': CASE WHEN rotation = 0 THEN 0.0 ELSE {NOISE} END, 'c': rotation, 'd': pos}}) AS s,
       count(*) AS n, count(DISTINCT CASE WHEN trim(text) <> '' THEN trim(text) END) AS texts, string_agg(candidate, ',' ORDER BY rotation, pos) AS candidates, flatten(list(coalesce(sources, []) ORDER BY pos)) AS sources FROM rd GROUP BY 1, 2, 3, 4"""),
    ("chosen", f"""SELECT doc, region, row, col, s, candidates, sources, coalesce(nullif(concat_ws('|', CASE WHEN trim(text) = '' THEN 'empty_text' END, CASE WHEN s.raw_text <> text THEN 'normalized_text' END,
       CASE s.status WHEN 'recognized_low_confidence' THEN 'low_confidence_ocr' WHEN 'recognized_suspicious' THEN 'suspicious_ocr' WHEN 'unknown' THEN 'unknown_ocr_quality' END,
       CASE WHEN n > 1 THEN 'orientation_hypotheses_present' END, CASE WHEN n > 1 AND texts > 1 THEN 'ambiguous_orientation' END, CASE WHEN {NOISE} >= 0.45 THEN 'noisy_text' END), ''), 'ok') AS flags FROM (SELECT *, s.text AS text FROM pick)"""),
    ("seen", "SELECT doc, count(*) FILTER (status <> 'missing_ocr_text') AS read FROM rd GROUP BY 1"),
    ("whole", """SELECT doc, page, region, row, col, x, y, w, h, confidence, text_px, mode, table_id, table_row FROM joined WHERE doc NOT IN (SELECT doc FROM seen WHERE read = 0)
       UNION ALL SELECT doc, 0, region, row, col, s.x, s.y, s.w, s.h, s.confidence, 0, 'cv_grid', region, row FROM chosen WHERE doc NOT IN (SELECT doc FROM kept) AND doc IN (SELECT doc FROM seen WHERE read > 0)"""),
    ("ev", "SELECT w.*, p.doc IS NOT NULL AS evidence FROM whole w LEFT JOIN pick p ON p.doc = w.doc AND p.region = w.region AND p.row = w.row AND p.col = w.col"),
    ("k", "SELECT ev.* FROM ev JOIN (SELECT doc, table_id, min(col) AS f FROM ev WHERE evidence GROUP BY 1, 2) USING (doc, table_id) WHERE col >= f"),
    ("rw", "SELECT doc, table_id, table_row, max(h) AS h, bool_or(evidence) AS e, count(*) AS n FROM k GROUP BY 1, 2, 3"),
    ("us", "SELECT doc, table_id, median(h) AS mh, median(n) AS mn FROM rw WHERE e GROUP BY 1, 2"),
    ("st", "SELECT doc, table_id, min(table_row) FILTER (seen AND NOT e AND ((mn >= 3 AND n < 0.55 * mn) OR h > 1.8 * mh)) AS stop FROM (SELECT *, bool_or(e) OVER (PARTITION BY doc, table_id ORDER BY table_row) AS seen FROM rw JOIN us USING (doc, table_id)) GROUP BY 1, 2"),
    ("grid", "SELECT k.*, dense_rank() OVER (PARTITION BY doc, table_id ORDER BY table_row) - 1 AS row_index, dense_rank() OVER (PARTITION BY doc, table_id ORDER BY col) - 1 AS column_index FROM k JOIN st USING (doc, table_id) WHERE stop IS NULL OR table_row < stop"),
    ("made", """SELECT g.doc, table_id, page, g.region, row_index, column_index, coalesce(s.row_span, 1) AS row_span, coalesce(s.text, '') AS text, coalesce(s.x, g.x) AS x, coalesce(s.y, g.y) AS y, coalesce(s.confidence, g.confidence) AS confidence,
       coalesce(candidates, '') AS candidates, coalesce(s.candidate, '') AS selected, coalesce(s.status, 'missing_ocr_candidate') AS status, coalesce(flags, 'empty_text|missing_ocr_candidate') AS flags, coalesce(sources, []) AS sources, g.x AS gx, g.y AS gy, g.w AS gw, g.h AS gh, mode
       FROM grid g LEFT JOIN chosen c ON c.doc = g.doc AND c.region = g.region AND c.row = g.row AND c.col = g.col"""),
]


def sql(last: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({text})" for name, text in STEPS) + "\n" + last


def query(name: str, last: str):
    def add(f):
        Q[name], SQL[name] = f, sql(last)
        return f

    return add


def lines(spark: SparkSession, d: str) -> DataFrame:
    """line_rows as the parts need them, numbered once and stored: each part would number all lines anew."""
    return stored(spark.sql(FIXTURES["line_rows"], lineitem=table(spark, d, "lineitem")).drop("price"))


def of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Lines that have a document, as CV14 takes no others; unions of parts stay dealt out by it only if all agree on whether it can be null."""
    return lines(spark, d).where("supplier IS NOT NULL")


def part(rows: DataFrame, name: str) -> DataFrame:
    """A part, each document in one place: what later steps join and group there moves no more. Few rows are left of regions, so they move when made; others as the lines they come from, which are smaller."""
    make = lambda r: r.sparkSession.sql(PARTS[name].replace(f"({FIXTURES['line_rows']})", "{lines}"), lines=r)
    if name in ("regions", "wide"):
        return tb.by_document(make(rows))
    if name == "cells":
        rows = rows.withColumns({"sheet": F.col("sheet") % 9, "part": F.col("part") % 5})  # all that cells have of them
    return make(rows.repartition("supplier"))


def kept(rows: DataFrame) -> DataFrame:
    return tb.table_cells(part(rows, "cells"), part(rows, "regions"), part(rows, "wide"))


def read(rows: DataFrame) -> DataFrame:
    return tb.readings(part(rows, "candidates"), part(rows, "texts"))


def made(rows: DataFrame) -> DataFrame:
    return tb.rebuilt_cells(tb.table_grid(kept(rows), read(rows)))


@query("cv16_strip_exclude", "SELECT doc, page, region, row, col, round(confidence, 6) AS confidence, mode FROM kept")
def strip_exclude(spark: SparkSession, d: str) -> DataFrame:
    return kept(lines(spark, d)).select("doc", "page", "region", "row", "col", F.round("confidence", 6).alias("confidence"), "mode")


@query("cv16_strip_branches", "SELECT doc, page, region, branch FROM lim")
def strip_branches(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d)
    return tb.strip_limits(part(rows, "cells").where("mode = 'cv_grid'"), part(rows, "regions")).select("doc", "page", "region", "branch")


@query("w4_joined_fragments", "SELECT doc, page, region, row, col, table_id, table_row FROM joined")
def joined_fragments(spark: SparkSession, d: str) -> DataFrame:
    return tb.joined_fragments(kept(lines(spark, d))).select("doc", "page", "region", "row", "col", "table_id", "table_row")


@query("cv13_table_cells", "SELECT doc, region, row, col, s.candidate AS candidate, s.text AS text, s.status AS status, candidates, flags FROM chosen")
def chosen(spark: SparkSession, d: str) -> DataFrame:
    out = tb.chosen_readings(read(lines(spark, d)))
    return out.select("doc", "region", "row", "col", "s.candidate", "s.text", "s.status", F.array_join("candidates", ",").alias("candidates"), F.array_join("flags", "|").alias("flags"))


@query("cv14_table_cells", "SELECT doc, table_id, page, region, row_index, column_index, row_span, text, x, y, round(confidence, 6) AS confidence, candidates, selected, status, flags FROM made")
def cells(spark: SparkSession, d: str) -> DataFrame:
    out = made(of_documents(spark, d))
    return out.select("doc", "table_id", "page", "region", "row_index", "column_index", "row_span", "text", "x", "y", F.round("confidence", 6).alias("confidence"), F.array_join("candidates", ",").alias("candidates"), "selected", "status", F.array_join("flags", "|").alias("flags"))


@query("cv14_table_quality", """, t AS (SELECT doc, table_id, min(gx) AS x, min(gy) AS y, max(gx + gw) - min(gx) AS w, max(gy + gh) - min(gy) AS h, count(DISTINCT row_index) AS row_count, count(*) AS cell_count, count(*) FILTER (trim(text) <> '') AS text_cells,
    count(*) FILTER (trim(text) = '') AS empty_cells, count(*) FILTER (status = 'missing_ocr_candidate') AS missing_candidates, count(*) FILTER (status = 'recognized_low_confidence') AS low_confidence, count(*) FILTER (status = 'empty_text') AS empty_texts,
    bool_or(mode <> 'cv_grid') AS wide, max(row_index) - min(row_index) + 1 <> count(DISTINCT row_index) OR max(column_index) - min(column_index) + 1 <> count(DISTINCT column_index) AS gaps,
    flatten(list(sources ORDER BY row_index, column_index)) AS sources, list({'y': gy, 'x': gx, 'r': region} ORDER BY gy, gx, region) AS places, string_agg(selected, ',' ORDER BY row_index, column_index) AS selected FROM made GROUP BY 1, 2),
 n AS (SELECT doc, table_id, r, min(i) AS i FROM (SELECT doc, table_id, unnest(list_concat(list_transform(places, lambda p: p.r), sources)) AS r, unnest(range(len(places) + len(sources))) AS i FROM t) GROUP BY 1, 2, 3),
 q AS (SELECT doc, table_id, string_agg(r, ',' ORDER BY i) AS source_regions FROM n GROUP BY 1, 2)
 SELECT doc, table_id, x, y, w, h, row_count, cell_count, text_cells, empty_cells, missing_candidates, low_confidence, empty_texts, source_regions, selected,
    CASE WHEN wide THEN 'wide_table_text_blocks_with_inferred_grid' ELSE 'cv_grid_cells_with_ocr_evidence' END AS coverage_policy,
    coalesce(nullif(concat_ws('|', CASE WHEN wide THEN 'wide_table_inferred_grid' END, CASE WHEN missing_candidates > 0 THEN 'partial_ocr_coverage' END, CASE WHEN low_confidence > 0 THEN 'low_confidence_ocr' END, CASE WHEN empty_texts > 0 THEN 'empty_ocr_text' END, CASE WHEN gaps THEN 'irregular_grid_indexes' END), ''), 'ok') AS flags
 FROM t JOIN q USING (doc, table_id)""")
def quality(spark: SparkSession, d: str) -> DataFrame:
    out = tb.rebuilt_tables(made(of_documents(spark, d)))
    selected = F.array_join(F.flatten(F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["selected"]))), ",")
    return out.select("doc", "table_id", "x", "y", "w", "h", "row_count", "cell_count", "text_cells", "empty_cells", "missing_candidates", "low_confidence", "empty_texts", F.array_join("source_regions", ",").alias("source_regions"), selected.alias("selected"), "coverage_policy", F.array_join("flags", "|").alias("flags"))


@query("cv14_reconstruction_status", """, d AS (SELECT s_suppkey AS doc FROM supplier), a AS (SELECT doc, count(*) AS asked, count(*) FILTER (status = 'missing_ocr_text') AS unread FROM rd GROUP BY 1), m AS (SELECT doc, count(DISTINCT table_id) AS tables, count(*) AS cells FROM made GROUP BY 1)
 SELECT d.doc, CASE WHEN asked IS NULL AND d.doc NOT IN (SELECT doc FROM kept) THEN 'table_reconstruction_skipped_no_candidates' WHEN asked = unread THEN 'table_reconstruction_skipped_no_ocr_text' ELSE 'table_reconstruction_completed' END AS code,
    coalesce(tables, 0) AS tables, coalesce(cells, 0) AS cells, coalesce(unread, 0) AS unread FROM d LEFT JOIN a USING (doc) LEFT JOIN m USING (doc)""")
def status(spark: SparkSession, d: str) -> DataFrame:
    rows = of_documents(spark, d)
    grid, r = kept(rows), read(rows)
    documents = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"))
    return tb.reconstruction_status(documents, grid, r, tb.rebuilt_tables(tb.rebuilt_cells(tb.table_grid(grid, r))))

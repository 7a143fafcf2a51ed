"""Queries over boxes, table cells and readings of pages, and the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as ge
from tessera.operators import pagegrid as pg
from tessera.operators import stamps as sp
from tessera.operators.titleblock import ROLES, interpret, source_fields
from tessera.plans.fixtures import ctes, fixture, table

Q: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


AREA = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"


@query("j12_words_in_crops", ctes("words", "crops") + f"SELECT b.id AS crop, a.id AS word FROM words a JOIN crops b USING (page) WHERE {AREA} / (a.w * a.h) >= 0.5 OR (a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h)")
def words_in_crops(spark: SparkSession, d: str) -> DataFrame:
    return pg.words_in_crops(fixture(spark, d, "words"), fixture(spark, d, "crops"))


@query("w8_line_text", ctes("words") + "SELECT page, string_agg(text, ' ' ORDER BY block, line, x, id) AS text FROM words GROUP BY 1")
def line_text(spark: SparkSession, d: str) -> DataFrame:
    return pg.line_text(fixture(spark, d, "words"), ["page"])


@query("j15_column_lookup", ctes("words", "crops", more="e AS (SELECT DISTINCT page AS grp, x AS edge FROM crops), s AS (SELECT grp, edge, lead(edge) OVER o AS high, row_number() OVER o - 1 AS i FROM e WINDOW o AS (PARTITION BY grp ORDER BY edge)), t AS (SELECT *, max(i) OVER (PARTITION BY grp) = i AS last FROM s WHERE high IS NOT NULL)") + "SELECT id, x AS v, i AS column_index FROM words JOIN t ON page = grp AND x >= edge AND (x < high OR (last AND x = high))")
def column_lookup(spark: SparkSession, d: str) -> DataFrame:
    words = fixture(spark, d, "words").select("id", F.col("page").alias("grp"), F.col("x").alias("v"))
    edges = fixture(spark, d, "crops").select(F.col("page").alias("grp"), F.col("x").alias("edge")).distinct()
    return pg.column_of(words, edges)


@query("w3_line_islands", "WITH p AS (SELECT DISTINCT l_suppkey AS grp, CAST(l_quantity * 10 + l_linenumber AS BIGINT) AS pos FROM lineitem), f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY grp ORDER BY pos) <= 4 THEN 0 ELSE 1 END AS n FROM p), i AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY pos) AS island FROM f) SELECT grp, CAST(island AS BIGINT) AS island, min(pos) AS low, max(pos) AS high, count(*) AS n, CAST(round_even((min(pos) + max(pos)) / 2, 0) AS BIGINT) AS middle FROM i GROUP BY grp, island")
def line_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_quantity") * 10 + F.col("l_linenumber")).cast("long").alias("pos"))
    return pg.islands(rows, 4)


RECTS = "SELECT p_partkey AS id, p_partkey % 20 AS page, p_partkey * 7 % 60 AS x, p_partkey * 13 % 60 AS y, 3 + p_size % 40 AS w, 2 + p_partkey % 37 AS h, p_partkey * 31 % 101 AS score FROM {part}"


@query("cv4_container_removal", "WITH r AS (" + RECTS.format(part="part") + f") SELECT id FROM r a WHERE NOT (a.w * a.h >= 800 AND EXISTS (SELECT 1 FROM r b WHERE b.page = a.page AND b.id <> a.id AND b.w * b.h < 0.72 * a.w * a.h AND {AREA} / (b.w * b.h) >= 0.92))")
def container_removal(spark: SparkSession, d: str) -> DataFrame:
    return pg.without_containers(spark.sql(RECTS, part=table(spark, d, "part")), 10000)


#: Texts of a page of 2,480 by 3,508 pixels, one in three near a corner or an edge.
TEXTS = """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 17e2 + p_size * 15 WHEN 1 THEN 5e0 * p_size ELSE 23e0 * p_size END AS x, CASE p_partkey % 5 WHEN 0 THEN 25e2 + p_size * 19 WHEN 1 THEN 9e0 * p_size WHEN 2 THEN 3390e0 + p_size * 2 ELSE 41e0 * p_size END AS y,
 2e1 + p_partkey * 7 % 160 AS w, 6e0 + p_partkey * 11 % 140 AS h, (p_partkey % 40) / 200e0 AS density FROM {part}"""


@query("cv5_region_classify", "WITH r AS (" + TEXTS.format(part="part") + """) SELECT id, CASE WHEN x > 2480 * 0.68 AND y > 3508 * 0.70 AND w * h > 2480 * 3508 * 0.0008 AND w / h BETWEEN 0.65 AND 1.45 AND density >= 0.08 THEN 'service_mark' WHEN x <= 2480 * 0.43 AND x + w <= 2480 * 0.43 AND y <= 3508 * 0.13 AND w >= 2480 * 0.015 AND h >= 3508 * 0.0025 AND (w * h > 2480 * 3508 * 0.000015 OR density >= 0.08) THEN 'logo_or_mark'
 WHEN w * h <= 2480 * 3508 * 0.00012 AND (y < 3508 * 0.035 OR y + h > 3508 * 0.965 OR x < 2480 * 0.035 OR x + w > 2480 * 0.965) AND w <= 90 AND h <= 32 THEN 'service_mark' ELSE 'text_block' END AS kind, CASE WHEN x > 2480 * 0.68 AND y > 3508 * 0.70 AND w * h > 2480 * 3508 * 0.0008 AND w / h BETWEEN 0.65 AND 1.45 AND density >= 0.08 THEN 'bottom_right_square_mark'
 WHEN x <= 2480 * 0.43 AND x + w <= 2480 * 0.43 AND y <= 3508 * 0.13 AND w >= 2480 * 0.015 AND h >= 3508 * 0.0025 AND (w * h > 2480 * 3508 * 0.000015 OR density >= 0.08) THEN 'title_page_top_left_mark' WHEN w * h <= 2480 * 3508 * 0.00012 AND (y < 3508 * 0.035 OR y + h > 3508 * 0.965 OR x < 2480 * 0.035 OR x + w > 2480 * 0.965) AND w <= 90 AND h <= 32 THEN 'page_edge_service_mark' ELSE '' END AS reason FROM r""")
def region_classify(spark: SparkSession, d: str) -> DataFrame:
    r = spark.sql(TEXTS, part=table(spark, d, "part")).withColumns({"width": F.lit(2480), "height": F.lit(3508)})
    return r.select("id", pg.text_mark().alias("m")).select("id", "m.kind", "m.reason")


READ = "SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'recognized_low_confidence' WHEN 1 THEN 'recognized_suspicious' WHEN 2 THEN 'empty_text' ELSE 'recognized' END AS status FROM {part} WHERE p_partkey % 11 <> 3 OR p_size > 10"
PLANNED = "SELECT p_partkey AS id, p_partkey % 90 AS doc, CASE WHEN p_partkey % 4 = 0 THEN 90 ELSE 0 END AS rotation FROM {part}"


@query("a14_ocr_gate", "WITH c AS (" + PLANNED.format(part="part") + "), t AS (" + READ.format(part="part") + """), x AS (SELECT c.*, status, rotation = 0 AS i FROM c LEFT JOIN t USING (id)), g AS (SELECT doc, count(*) AS planned, count(*) FILTER (i) AS gated, count(*) FILTER (i AND status = 'recognized') AS recognized, count(*) FILTER (i AND status = 'recognized_low_confidence') AS low,
 count(*) FILTER (i AND status = 'recognized_suspicious') AS suspicious, count(*) FILTER (i AND status = 'empty_text') AS empty, count(*) FILTER (i AND status IS NULL) AS missing FROM x GROUP BY 1) SELECT *, CASE WHEN gated = 0 THEN 'skipped' WHEN missing > 0 THEN 'partial' WHEN low + suspicious + empty > 0 THEN 'needs_review' ELSE 'passed' END AS verdict FROM g""")
def ocr_gate(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return pg.quality_gate(spark.sql(PLANNED, part=part), spark.sql(READ, part=part), "doc")


GRID = "SELECT DISTINCT l_suppkey AS grp, CAST(l_orderkey % 12 AS INT) AS row, CAST(l_partkey % 6 AS INT) AS col, CASE WHEN l_orderkey % 12 > 8 THEN 40 ELSE 10 + l_orderkey % 3 END AS height, (l_orderkey % 12) * 3 + l_partkey % 6 BETWEEN 2 AND 24 AS evidence FROM {lineitem} WHERE l_linenumber = 1"


CV15_SQL = "WITH c AS (" + GRID.format(lineitem="lineitem") + """), k AS (SELECT c.* FROM c JOIN (SELECT grp, min(col) AS f FROM c WHERE evidence GROUP BY 1) USING (grp) WHERE col >= f), r AS (SELECT grp, row, max(height) AS h, bool_or(evidence) AS e, count(*) AS n FROM k GROUP BY 1, 2),
 u AS (SELECT grp, median(h) AS mh, median(n) AS mn FROM r WHERE e GROUP BY 1), s AS (SELECT *, bool_or(e) OVER (PARTITION BY grp ORDER BY row) AS seen FROM r JOIN u USING (grp)),
 z AS (SELECT grp, min(row) FILTER (seen AND NOT e AND ((mn >= 3 AND n < 0.55 * mn) OR h > 1.8 * mh)) AS stop FROM s GROUP BY 1), l AS (SELECT s.grp, row FROM s JOIN z USING (grp) WHERE stop IS NULL OR row < stop)
 SELECT k.grp, k.row, col, dense_rank() OVER (PARTITION BY k.grp ORDER BY k.row) - 1 AS row_index, dense_rank() OVER (PARTITION BY k.grp ORDER BY col) - 1 AS column_index FROM k JOIN l ON k.grp = l.grp AND k.row = l.row"""


GRID_WHOLE = GRID.replace("l_suppkey AS grp", "l_suppkey * 10 + l_linenumber AS grp").removesuffix(" WHERE l_linenumber = 1")


@query("cv15_footer_trim", CV15_SQL.replace(GRID.format(lineitem="lineitem"), GRID_WHOLE.format(lineitem="lineitem")))
def footer_trim_whole(spark: SparkSession, d: str) -> DataFrame:
    """All lines; each line number of a supplier is a grid of its own."""
    return pg.trim_grid(spark.sql(GRID_WHOLE, lineitem=table(spark, d, "lineitem")))


ANCHORS = "VALUES ('form3', 1, 0, 12), ('form3', 2, 20, 34), ('form3', 3, 60, 75), ('form5', 1, 3, 9), ('form5', 2, 40, 52), ('form6', 1, 0, 99), ('form6', 2, 95, 99)"


CV8_SQL = f"""WITH a AS (SELECT * FROM ({ANCHORS}) t(template, anchor, low, high)), p AS (SELECT DISTINCT l_suppkey AS region, l_partkey * 7 % 100 AS pos FROM lineitem WHERE l_linenumber = 2),
 n AS (SELECT region, template, anchor, min_by({{'pos': pos, 'off': abs(pos - (low + high) / 2)}}, {{'o': abs(pos - (low + high) / 2), 'p': pos}}) AS p FROM p JOIN a ON pos BETWEEN low AND high GROUP BY 1, 2, 3),
 r AS (SELECT *, coalesce(p.pos > lag(p.pos) OVER (PARTITION BY region, template ORDER BY anchor), true) AS up FROM n), m AS (SELECT region, template, count(*) AS met, bool_and(up) AS up, round(1 / (1 + avg(p.off)), 4) AS score FROM r GROUP BY 1, 2)
 SELECT region, max_by(template, {{'s': score, 't': template}}) AS template, max(score) AS score FROM m WHERE up AND met = (SELECT count(*) FROM a WHERE a.template = m.template) GROUP BY 1"""


@query("cv8_stamp_template", CV8_SQL.replace("l_suppkey AS region", "l_suppkey * 10 + l_linenumber AS region").replace(" WHERE l_linenumber = 2", ""))
def stamp_template_whole(spark: SparkSession, d: str) -> DataFrame:
    """All lines; each line number of a supplier is a region of its own."""
    anchors = spark.sql(f"SELECT * FROM ({ANCHORS}) AS t(template, anchor, low, high)")
    lines = table(spark, d, "lineitem").select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("region"), (F.col("l_partkey") * 7 % 100).alias("pos")).distinct()
    return pg.stamp_template(lines, anchors)


CELLS = "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS region, l_linenumber AS row, l_partkey % 8 AS col, l_quantity AS text_px, 10 + l_partkey % 30 AS w, 5 + l_orderkey % 60 AS h FROM {lineitem}"


CELLS_WHOLE = "SELECT sheet * 1000 + row AS id, supplier * 1000000 + CAST(floor(sheet / 400) AS BIGINT) AS region, line AS row, part % 8 AS col, quantity AS text_px, 10 + part % 30 AS w, 5 + sheet % 60 AS h FROM {line_rows}"


@query("cv20_cell_candidates", ctes("line_rows", more="k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY row, col, id) AS r FROM (" + CELLS_WHOLE.format(line_rows="line_rows") + "))") + "SELECT id, region, unnest(CASE WHEN h >= 1.45 * w THEN [0, 90, 270] ELSE [0] END) AS rotation FROM k WHERE r <= 240 AND text_px >= 40")
def cell_candidates_whole(spark: SparkSession, d: str) -> DataFrame:
    """All lines, each with an id of its own; regions are a supplier's lines of 400 orders."""
    return pg.cell_candidates(spark.sql(CELLS_WHOLE, line_rows=fixture(spark, d, "line_rows")))


SPEC = "VALUES ('title', 1, 0), ('title', 1, 1), ('stage', 2, 3), ('sheet', 3, 4), ('sheet', 4, 4), ('sheet', 5, 4)"


@query("cv21_fields_by_position", f"WITH s AS (SELECT * FROM ({SPEC}) t(field, row, col)), n AS (SELECT field, count(*) AS need FROM s GROUP BY 1), c AS (SELECT DISTINCT l_suppkey AS region, l_linenumber AS row, l_partkey % 8 AS col FROM lineitem WHERE l_quantity > 0), m AS (SELECT region, field, count(*) AS met FROM c JOIN s USING (row, col) GROUP BY 1, 2) SELECT region, field FROM m JOIN n USING (field) WHERE met = need")
def fields_by_position(spark: SparkSession, d: str) -> DataFrame:
    spec = spark.sql(f"SELECT * FROM ({SPEC}) AS t(field, row, col)")
    cells = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("region"), F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 8).alias("col"), F.col("l_quantity").alias("text_px"))
    return pg.fields_by_position(cells, spec)


@query("cv22_text_pages", "WITH t AS (SELECT p_partkey AS id, p_partkey % 150 AS page, p_partkey * 7 % 100 AS x, p_partkey * 13 % 100 AS y, 5 + p_size % 10 AS w, 3 AS h FROM part), b AS (SELECT page, count(*) AS n, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b FROM t GROUP BY 1) SELECT * FROM b WHERE n >= 6 AND (r - x) * (b - y) / 10000.0 BETWEEN 0.02 AND 0.88 AND page NOT IN (SELECT s_suppkey % 150 FROM supplier)")
def text_pages(spark: SparkSession, d: str) -> DataFrame:
    texts = fixture(spark, d, "words").withColumn("page", F.col("id") % 150)
    return pg.text_pages(texts, table(spark, d, "supplier").select((F.col("s_suppkey") % 150).alias("page")), 10000)


@query("m2_sheet_px", "SELECT p_partkey AS id, greatest(32, CAST(floor(p_retailprice / 100 * 7 + 5 + 0.5) AS BIGINT)) AS column_px, greatest(18, CAST(floor(p_size * 96 / 72 + 0.5) AS BIGINT)) AS row_px FROM part")
def sheet_px(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), ge.column_px(F.col("p_retailprice") / 100).alias("column_px"), ge.row_px(F.col("p_size")).alias("row_px"))


@query("m4_scores", "SELECT p_partkey AS id, round(least(0.9, 0.45 + least(0.25, p_size * 10 / 900)), 6) AS confidence, CASE WHEN abs(greatest(p_size, p_partkey % 97 + 1) / least(p_size, p_partkey % 97 + 1) - sqrt(2)) <= 0.035 THEN 'standard' WHEN greatest(p_size, p_partkey % 97 + 1) / least(p_size, p_partkey % 97 + 1) BETWEEN 1.8 AND 4.2 THEN 'extended' ELSE 'other' END AS format FROM part")
def scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(ge.text_confidence(F.col("p_size") * 10), 6).alias("confidence"), ge.sheet_format(F.col("p_size"), F.col("p_partkey") % 97 + 1).alias("format"))


@query("w9_suppress")
def suppress(spark: SparkSession, d: str) -> DataFrame:
    return pg.suppress(spark.sql(RECTS, part=table(spark, d, "part")))


@query("w4_merge_fragments")
def merge_fragments(spark: SparkSession, d: str) -> DataFrame:
    return pg.merge_fragments(spark.sql(RECTS, part=table(spark, d, "part")))


@query("cv10_wide_rows")
def wide_rows(spark: SparkSession, d: str) -> DataFrame:
    return pg.wide_rows(fixture(spark, d, "words"))


FIELDS = "VALUES ('form3', 2, 'construction_object_name'), ('form3', 3, 'documentation_stage'), ('form3', 4, 'document_designation'), ('form3', 5, 'sheet_title'), ('form5', 2, 'document_designation'), ('form5', 5, 'sheet_number'), ('form5', 6, 'product_or_document_name')"
#: All lines; a supplier has seven documents, and an eighth without a title block.
BLOCK = """SELECT l_suppkey * 10 + l_orderkey % 7 AS doc, CASE WHEN l_suppkey % 3 = 0 THEN 'form5' WHEN l_suppkey % 3 = 1 THEN 'form3' ELSE 'form9' END AS form, l_linenumber AS field,
 CASE WHEN l_quantity = 7 THEN ' ' ELSE concat(l_returnflag, l_partkey) END AS text, CASE WHEN l_tax > 0.06 THEN 'empty' ELSE 'extracted' END AS extraction,
 row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 7 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos FROM {lineitem}"""
ROLE_SQL = ", ".join(f"max(v) FILTER (role = '{r}') AS {r}" for r in ROLES)


@query("do8_title_block", "WITH c AS (" + BLOCK.format(lineitem="lineitem") + f"), m AS (SELECT * FROM ({FIELDS}) t(form, field, role)), x AS (SELECT c.*, coalesce(m.role, d.role) AS role FROM c LEFT JOIN m ON m.form = c.form AND m.field = c.field LEFT JOIN m d ON d.form = 'form3' AND d.field = c.field AND c.form NOT IN (SELECT form FROM m)), "
  f"f AS (SELECT doc, role, arg_min(CASE WHEN trim(text) <> '' THEN [text] ELSE [NULL] END, pos)[1] AS v FROM x WHERE role IS NOT NULL AND extraction = 'extracted' GROUP BY 1, 2), k AS (SELECT DISTINCT doc, true AS has_fields FROM c UNION ALL SELECT s_suppkey * 10 + 9, false FROM supplier), "
  f"r AS (SELECT doc, {ROLE_SQL} FROM f GROUP BY 1) SELECT k.doc, {', '.join(ROLES)}, CASE WHEN {ROLES[0]} IS NOT NULL THEN 'interpreted' WHEN has_fields THEN 'ambiguous' ELSE 'missing' END AS status, concat_ws('|', CASE WHEN NOT has_fields THEN 'stamp_source_fields_missing' END, CASE WHEN {ROLES[0]} IS NULL THEN 'title_block_document_designation_missing' END) AS warnings FROM k LEFT JOIN r ON r.doc = k.doc")
def title_block(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(BLOCK, lineitem=table(spark, d, "lineitem"))
    fields = source_fields(rows, spark.sql(f"SELECT * FROM ({FIELDS}) AS t(form, field, role)"), how="left")
    documents = rows.select("doc").distinct().withColumn("has_fields", F.lit(True)).union(table(spark, d, "supplier").select(F.col("s_suppkey") * 10 + 9, F.lit(False)))
    return interpret(documents, fields)


#: Twenty parts are a sheet's lines: ten across its lower part, ten down its right one.
SHEET_LINES = """
    SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS doc, CAST(floor(p_partkey / 20) AS BIGINT) AS page, CASE WHEN p_partkey % 20 < 10 THEN 'h' ELSE 'v' END AS axis,
           CASE WHEN p_partkey % 20 < 3 THEN 3508e0 - p_size * 3 - p_partkey % 20 WHEN p_partkey % 20 < 10 THEN 31e2 - p_size * 11 + p_partkey % 20 * 60 WHEN p_partkey % 20 < 13 THEN 2480e0 - p_size * 2 - p_partkey % 20 ELSE 1e3 + p_size * 9 + p_partkey % 7 * 90 END AS pos,
           CASE WHEN p_partkey % 20 < 10 THEN 8e2 + p_size * 5 ELSE 2400e0 + p_size * 6 END AS low, CASE WHEN p_partkey % 20 < 10 THEN 2480e0 - p_partkey % 31 ELSE 3508e0 - p_partkey % 37 END AS high, 1e0 + p_size % 3 AS thick
    FROM {part}"""
SHEETS = "SELECT DISTINCT CAST(floor(p_partkey / 200) AS BIGINT) AS doc, CAST(floor(p_partkey / 20) AS BIGINT) AS page, 2480 AS width, 3508 AS height, 300 AS dpi FROM {part}"
AREAS = "SELECT DISTINCT CAST(floor(p_partkey / 200) AS BIGINT) AS doc, CAST(floor(p_partkey / 20) AS BIGINT) AS page, 6e1 AS x, 4e1 AS y, 239e1 AS w, 343e1 AS h FROM {part} WHERE floor(p_partkey / 20) % 3 = 1"
SIDE = """SELECT f.doc, f.page, f.n, f.pos AS edge, m.pos AS pos, row_number() OVER (PARTITION BY f.doc, f.page, f.n, f.pos ORDER BY abs(f.pos - m.pos - {form}), m.pos) AS k FROM
 (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, n ORDER BY pos DESC) AS r FROM near WHERE axis = '{axis}' AND {end} - pos >= 0 AND {end} - pos <= greatest({most} * 0.055, 140)) WHERE r <= 4) f
 JOIN near m ON m.doc = f.doc AND m.page = f.page AND m.n = f.n AND m.axis = '{axis}' WHERE f.pos - m.pos BETWEEN greatest(f.{size} * {low}, {form} * 0.55) AND least(f.{size} * {high}, {form} * 1.8)"""
CV18_SQL = f"""WITH l AS ({SHEET_LINES.format(part="part")}), s AS ({SHEETS.format(part="part")}), a AS ({AREAS.format(part="part")}),
 f AS (SELECT doc, page, width, height, 0 AS n, 0 AS fx, 0 AS fy, width AS fw, height AS fh FROM s UNION ALL SELECT s.doc, s.page, width, height, 1, floor(x), floor(y), floor(w), floor(h) FROM s JOIN a ON a.doc = s.doc AND a.page = s.page),
 g AS (SELECT *, fx + floor(fw * 0.3) AS sx, fy + floor(fh * 0.5) AS sy, least(width, fx + floor(fw * 0.3) + floor(fw * 0.7)) AS ex, least(height, fy + floor(fh * 0.5) + floor(fh * 0.5)) AS ey FROM f),
 i AS (SELECT DISTINCT g.*, axis, pos FROM g JOIN l ON l.doc = g.doc AND l.page = g.page WHERE CASE WHEN axis = 'h' THEN pos >= sy AND pos < ey AND greatest(0, least(high, ex) - greatest(low, sx)) / (ex - sx) >= 0.03 ELSE pos >= sx AND pos < ex AND greatest(0, least(high, ey) - greatest(low, sy)) / (ey - sy) >= 0.03 END),
 near AS (SELECT * FROM (SELECT *, count(*) FILTER (axis = 'h') OVER p AS nh, count(*) FILTER (axis = 'v') OVER p AS nv FROM i WINDOW p AS (PARTITION BY doc, page, n)) WHERE nh >= 4 AND nv >= 4),
 hb AS ({SIDE.format(form="650", axis="h", end="(fy + fh)", most="height", size="fh", low="0.045", high="0.30")}), vb AS ({SIDE.format(form="2185", axis="v", end="(fx + fw)", most="width", size="fw", low="0.10", high="0.70")}),
 q AS (SELECT g.*, hb.edge AS bottom, hb.pos AS top, vb.edge AS rgt, vb.pos AS lft, vb.edge - vb.pos AS w, hb.edge - hb.pos AS h FROM g JOIN hb USING (doc, page, n) JOIN vb USING (doc, page, n) WHERE hb.k <= 12 AND vb.k <= 16 AND hb.pos >= sy AND vb.pos >= sx),
 z AS (SELECT * FROM q WHERE w / h BETWEEN 1.6 AND 6.2 AND w * h >= width * height * 0.001 AND w * h <= width * height * 0.09),
 b AS (SELECT *, greatest(2, floor(h / 18)) AS dy, greatest(2, floor(w / 18)) AS dx FROM z),
 e AS (SELECT z.doc, z.page, z.n, bottom, top, rgt, lft, z.w, z.h, z.dx, z.dy, axis, pos, thick, greatest(low, CASE WHEN axis = 'h' THEN lft ELSE top END) AS low, least(high, CASE WHEN axis = 'h' THEN rgt ELSE bottom END) AS high FROM b z JOIN l ON l.doc = z.doc AND l.page = z.page
   WHERE CASE WHEN axis = 'h' THEN pos BETWEEN top AND bottom AND high >= lft AND low <= rgt ELSE pos BETWEEN lft AND rgt AND high >= top AND low <= bottom END),
 x AS (SELECT p.doc, p.page, p.n, p.bottom, p.top, p.rgt, p.lft, count(*) AS crossings FROM e p JOIN e t USING (doc, page, n, bottom, top, rgt, lft) WHERE p.axis = 'h' AND t.axis = 'v' AND t.pos BETWEEN p.low - 1 AND p.high + 1 AND p.pos BETWEEN t.low - 1 AND t.high + 1 GROUP BY ALL),
 m AS (SELECT doc, page, n, bottom, top, rgt, lft, count(*) FILTER (axis = 'h' AND (high - low) / w >= 0.3) AS nh, count(*) FILTER (axis = 'v' AND (high - low) / h >= 0.3) AS nv, least(1, sum((high - low) * thick) / any_value(w * h)) AS density,
   least(1, (coalesce(sum((high - low) * thick) FILTER (axis = 'h' AND pos < top + dy), 0) / any_value(dy * w) + coalesce(sum((high - low) * thick) FILTER (axis = 'h' AND pos >= bottom - dy), 0) / any_value(dy * w) + coalesce(sum((high - low) * thick) FILTER (axis = 'v' AND pos < lft + dx), 0) / any_value(dx * h) + coalesce(sum((high - low) * thick) FILTER (axis = 'v' AND pos >= rgt - dx), 0) / any_value(dx * h)) / 0.36) AS edge FROM e GROUP BY 1, 2, 3, 4, 5, 6, 7),
 d AS (SELECT b.*, nh, nv, density, m.edge AS edge, least(1, nh / 4) * 0.3 + least(1, nv / 3) * 0.3 + least(1, coalesce(crossings, 0) / 8) * 0.4 AS grid FROM b JOIN m USING (doc, page, n, bottom, top, rgt, lft) LEFT JOIN x USING (doc, page, n, bottom, top, rgt, lft)),
 c AS (SELECT *, round(0.28 + grid * 0.3 + edge * 0.16 + density * 4.0 + greatest(0, 1 - greatest(0, fx + fw - rgt) / width * 8 - greatest(0, fy + fh - bottom) / height * 8) * 0.18 + greatest(0, 1 - abs(w / h - 185e0 / 55e0) / 2.4) * 0.22 + least(1, (nh + nv) / 18) * 0.12, 9) AS score
   FROM d WHERE grid >= 0.34 AND edge >= 0.18 AND nh >= 4 AND nv >= 4 AND density >= 0.01),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY score DESC, n, bottom DESC, rgt DESC, top, lft) AS k FROM c)
 SELECT doc, page, lft AS "left", top, rgt AS "right", bottom, round(score, 6) AS score FROM r WHERE k = 1"""


def sheets(spark: SparkSession, d: str) -> list[DataFrame]:
    return [spark.sql(s, part=table(spark, d, "part")) for s in (SHEETS, SHEET_LINES, AREAS)]


@query("cv18_stamp_rectangles", CV18_SQL)
def stamp_rectangles(spark: SparkSession, d: str) -> DataFrame:
    return sp.find_stamps(*sheets(spark, d)).withColumn("score", F.round("score", 6))


@query("t6_nearest_boundaries", CV18_SQL.split("\n z AS (")[0].rstrip().rstrip(",") + ' SELECT doc, page, n, lft AS "left", top, rgt AS "right", bottom FROM q WHERE w / h BETWEEN 1.6 AND 6.2 AND w * h >= width * height * 0.001 AND w * h <= width * height * 0.09')
def nearest_boundaries(spark: SparkSession, d: str) -> DataFrame:
    pages, lines, areas = sheets(spark, d)
    return sp.boundaries(sp.frames(pages, areas), lines).select("doc", "page", "n", "left", "top", "right", "bottom")

"""Queries of candidate planning and the text layer, and the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import planning as pl
from tessera.plans.fixtures import table

Q: dict[str, object] = {}
SQL: dict[str, str] = {}

#: Twenty parts make a page, ten pages a document; every page has a stamp or a drawing, tables, texts and marks, or texts alone.
NUMBERS = "SELECT p_partkey AS k, p_size AS s, CAST(floor(p_partkey / 20) AS BIGINT) AS page, CAST(floor(p_partkey / 200) AS BIGINT) AS doc, p_partkey % 20 AS n FROM {part}"
KIND = """CASE WHEN page % 4 = 3 AND n < 17 THEN 'text_block' WHEN page % 4 = 3 THEN 'logo_or_mark' WHEN n = 3 AND page % 5 <> 2 THEN 'stamp' WHEN n = 7 AND page % 3 <> 1 THEN 'drawing_area' WHEN n % 4 = 1 THEN 'table_candidate' WHEN n = 12 THEN 'service_mark' ELSE 'text_block' END"""
SIZE = "CASE page % 5 WHEN 0 THEN 7016 WHEN 1 THEN 2480 WHEN 2 THEN 2000 ELSE 2500 END AS width, CASE page % 5 WHEN 0 THEN 4961 WHEN 1 THEN 3508 WHEN 2 THEN 3700 ELSE 3600 END AS height"
PARTS = {
    "pages": f"SELECT DISTINCT doc, page, {SIZE}, page % 23 <> 5 AS layout FROM ({NUMBERS}) a",
    "regions": f"""
    SELECT doc, page, concat('r', k) AS region, {KIND} AS kind,
           CASE WHEN page % 4 = 3 THEN 1e2 + s * 3 WHEN n = 7 THEN 4e2 WHEN n = 3 THEN 15e2 WHEN n % 4 = 2 THEN 1e0 * s * 12 ELSE 1e1 * s END AS x,
           CASE WHEN page % 4 = 3 THEN 1e2 + n * 150 WHEN n = 3 THEN 25e2 ELSE 1e2 + n * 120 END AS y,
           CASE WHEN n = 7 THEN 18e2 WHEN n = 3 THEN 5e2 + s * 60 WHEN n % 4 = 1 THEN 4e2 + s * 70 WHEN n % 4 = 2 THEN 2e1 + s * 2 ELSE 9e2 END AS w,
           CASE WHEN n = 7 THEN 2e3 WHEN n = 3 THEN 3e2 + s * 30 WHEN n % 4 = 1 THEN 2e2 + s * 40 WHEN n % 4 = 2 THEN 3e1 + s * 4 ELSE 6e1 END AS h,
           s / 50e0 AS confidence, CASE WHEN s % 9 = 4 THEN 'suppressed_by_stamp' WHEN s % 9 = 5 THEN 'frame' END AS reason, CAST(k AS INT) AS pos FROM ({NUMBERS}) a""",
    "crops": f"""
    SELECT doc, page, concat('r', k) AS region, concat('r', k, '-c', i) AS candidate, CAST(i AS INT) AS i, CASE WHEN (k + i) % 5 = 0 THEN 90 ELSE 0 END AS rotation, 1e2 * i + s AS x, 1e2 * n AS y, 9e1 AS w, 4e1 AS h, 0.5e0 + i / 1e1 AS confidence
    FROM ({NUMBERS}) a CROSS JOIN (VALUES (0), (1), (2), (3)) t(i) WHERE i < s % 5 AND page % 4 <> 3 AND (n = 3 OR n % 4 = 1)""",
    "wide": f"SELECT doc, page, concat('r', k) AS region FROM ({NUMBERS}) a WHERE page % 6 = 1 AND n IN (1, 5)",
    "wide_crops": f"SELECT doc, page, concat('r', k) AS region, concat('wide-', k) AS candidate, CAST(n AS INT) AS i, 0 AS rotation, 1e2 * n AS x, 5e1 AS y, 8e1 AS w, 3e1 AS h, 0.62e0 AS confidence FROM ({NUMBERS}) a WHERE page % 6 = 1 AND n < s % 20",
    "words": "SELECT p_partkey AS k, CAST(floor(p_partkey / 200) AS BIGINT) AS doc, CAST(floor(p_partkey / 20) AS BIGINT) AS page, CAST(p_size % 3 AS INT) AS block, CAST(p_partkey % 4 AS INT) AS line, CAST(p_partkey AS INT) AS word, 1e0 * (p_partkey * 37 % 900) AS x, 1e0 * (p_partkey * 13 % 700) AS y, 6e1 + p_size AS w, 12e0 AS h, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS text FROM {part}",
    "asked": """SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS doc, CAST(floor(p_partkey / 20) AS BIGINT) AS page, concat('t', CAST(floor(p_partkey / 3) AS BIGINT)) AS region, concat('c', p_partkey) AS candidate,
           CASE WHEN p_size % 8 = 3 THEN 'side_strip_candidate' ELSE 'table_cell_candidate' END AS kind, CASE WHEN p_partkey % 3 = 1 THEN 'rotated_90' WHEN p_partkey % 3 = 0 THEN 'original' END AS hypothesis,
           1e0 * (CAST(floor(p_partkey / 3) AS BIGINT) * 41 % 800) + CASE WHEN p_partkey % 3 = 1 THEN 0.25e0 ELSE 0e0 END AS x, 1e0 * (CAST(floor(p_partkey / 3) AS BIGINT) * 29 % 600) AS y, 3e2 AS w, 12e1 AS h FROM {part}""",
}


def part(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.sql(PARTS[name], part=table(spark, d, "part"))


def given(spark: SparkSession, d: str) -> list[DataFrame]:
    return [part(spark, d, n) for n in ("pages", "regions", "crops", "wide", "wide_crops")]


STEPS = [
    *[(name, sql.replace("{part}", "part")) for name, sql in PARTS.items()],
    ("st", "SELECT doc, page, arg_min({'x': x, 'w': w}, pos) FILTER (kind = 'stamp') AS stamp, arg_min({'x': x, 'w': w}, pos) FILTER (kind = 'drawing_area') AS drawing FROM regions GROUP BY 1, 2"),
    ("pg", "SELECT p.*, stamp, drawing, width > 5000 OR height > 5000 OR greatest(width, height) / least(width, height) > 1.8 AS large FROM pages p LEFT JOIN st USING (doc, page) WHERE layout"),
    ("rt", """SELECT r.*, width, height, CASE kind WHEN 'stamp' THEN CASE WHEN large AND (w > width * 0.45 OR w * h > width * height * 0.12) THEN 'oversized_large_drawing_stamp' ELSE 'full_stamp_region' END
       WHEN 'table_candidate' THEN CASE WHEN (r.doc, r.page, r.region) IN (SELECT (doc, page, region) FROM wide) THEN 'wide_table_fragment' WHEN large AND drawing IS NOT NULL AND (w * h > width * height * 0.08 OR (w > width * 0.45 AND h > height * 0.2)) THEN 'oversized_large_drawing_table'
         WHEN starts_with(coalesce(reason, ''), 'suppressed_') THEN 'suppressed_table_candidate' WHEN confidence < 0.5 THEN 'low_confidence_table_candidate' ELSE 'full_table_region' END
       WHEN 'text_block' THEN CASE WHEN stamp IS NOT NULL AND drawing IS NOT NULL AND w > 0 AND h >= 40 AND h / w >= 1.45 AND x <= least(stamp.x, drawing.x + drawing.w * 0.08) AND y >= height * 0.42 THEN NULL ELSE 'text_block' END
       WHEN 'drawing_area' THEN 'drawing_area' ELSE 'unsupported_region' END AS skip FROM regions r JOIN pg USING (doc, page)"""),
    ("mk", "SELECT rt.*, CASE WHEN skip IS NULL THEN 1 WHEN skip IN ('full_stamp_region', 'full_table_region') THEN (SELECT count(*) FROM crops c WHERE c.doc = rt.doc AND c.page = rt.page AND c.region = rt.region) ELSE 0 END AS makes FROM rt"),
    ("bf", "SELECT *, sum(makes) OVER (PARTITION BY doc, page ORDER BY pos, region) - makes AS before FROM mk"),
    ("tot", """SELECT pg.doc, pg.page, width, height, large, coalesce(m.made, 0) AS made, blocks, x, y, r, b, (SELECT count(*) FROM wide_crops w WHERE w.doc = pg.doc AND w.page = pg.page) AS wide FROM pg LEFT JOIN
       (SELECT doc, page, sum(makes) AS made, count(*) FILTER (kind = 'text_block') AS blocks, min(x) FILTER (kind = 'text_block') AS x, min(y) FILTER (kind = 'text_block') AS y, max(x + w) FILTER (kind = 'text_block') AS r, max(y + h) FILTER (kind = 'text_block') AS b FROM mk GROUP BY 1, 2) m ON m.doc = pg.doc AND m.page = pg.page"""),
    ("tp", "SELECT *, greatest(24, floor(least(r - x, b - y) * 0.025)) AS pad FROM tot WHERE NOT large AND made + wide = 0 AND blocks >= 6 AND (r - x) * (b - y) / (width * height) BETWEEN 0.02 AND 0.88"),
    ("box", """SELECT doc, page, greatest(0, round_even(x, 0) - pad) AS x1, greatest(0, round_even(y, 0) - pad) AS y1, least(width, round_even(r, 0) + pad) AS x2, least(height, round_even(b, 0) + pad) AS y2, blocks FROM tp"""),
    ("inset", "SELECT *, least(CASE WHEN w >= 78 THEN 17 ELSE 4 END, greatest(0, (w - 1) / 2)) AS i FROM bf WHERE skip IS NULL"),
    ("edges", "SELECT *, greatest(0, x + i) AS x1, greatest(0, y - 6) AS y1, least(width, x + w - i) AS x2, least(height, y + h - 4) AS y2 FROM inset"),
    ("made", """SELECT c.doc, c.page, c.candidate, CASE WHEN kind = 'stamp' THEN 'stamp_cell_candidate' ELSE 'table_cell_candidate' END AS kind, c.region, CASE WHEN kind = 'stamp' THEN 20000 ELSE 30000 END + row_number() OVER (PARTITION BY c.doc, c.page, c.region ORDER BY c.i, c.candidate) - 1 AS sort_order,
         c.rotation, c.confidence, c.x, c.y, c.w, c.h FROM crops c JOIN rt ON rt.doc = c.doc AND rt.page = c.page AND rt.region = c.region AND skip IN ('full_stamp_region', 'full_table_region')
       UNION ALL SELECT doc, page, region || '-side-strip', 'side_strip_candidate', region, 40000 + before, 270, greatest(0.3, least(0.75, confidence)), x1, y1, greatest(1, x2 - x1), greatest(1, y2 - y1) FROM edges
       UNION ALL SELECT doc, page, 'page-' || page || '-text-page', 'text_page', '', 500, 0, least(0.8, 0.35 + blocks * 0.025), x1, y1, x2 - x1, y2 - y1 FROM box
       UNION ALL SELECT w.doc, w.page, candidate, 'table_cell_candidate', region, 35000 + made + row_number() OVER (PARTITION BY w.doc, w.page ORDER BY i, candidate) - 1, rotation, confidence, w.x, w.y, w.w, w.h FROM wide_crops w JOIN tot ON tot.doc = w.doc AND tot.page = w.page"""),
    ("skipped", "SELECT doc, page, skip AS reason, count(*) AS n FROM rt WHERE skip IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT doc, page, 'text_page_on_large_drawing', 1 FROM pg WHERE large"),
]
LAYER = [(n, PARTS[n].replace("{part}", "part")) for n in ("words", "asked")] + [
    ("open", "SELECT * FROM asked WHERE kind = 'side_strip_candidate' OR coalesce(hypothesis, '') IN ('', 'original')"),
    ("hits", """SELECT b.doc, b.page, b.candidate, a.block, a.line, a.word, a.x, a.text FROM words a JOIN open b ON a.doc = b.doc AND a.page = b.page
       WHERE greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) / (a.w * a.h) >= 0.5 OR (a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h)"""),
    ("said", "SELECT doc, page, candidate, block, line, string_agg(text, ' ' ORDER BY word, x, text) AS t, count(*) AS n FROM hits GROUP BY ALL"),
    ("txt", "SELECT doc, page, candidate, trim(coalesce(string_agg(t, ' ' ORDER BY block, line, t) FILTER (t <> ''), '')) AS text, CAST(sum(n) AS BIGINT) AS words FROM said GROUP BY 1, 2, 3"),
    ("known", "SELECT DISTINCT a.doc, a.page, kind, region, round_even(x, 0) AS x, round_even(y, 0) AS y, round_even(w, 0) AS w, round_even(h, 0) AS h FROM asked a JOIN txt t ON t.doc = a.doc AND t.page = a.page AND t.candidate = a.candidate AND t.text <> ''"),
]


def sql(steps: list[tuple[str, str]], last: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in steps) + "\n" + last


def query(name: str, text: str):
    def add(f):
        Q[name], SQL[name] = f, text
        return f

    return add


ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in ("confidence", "x", "y", "w", "h"))


@query("cv9_candidate_plan", sql(STEPS, f"SELECT doc, page, candidate, kind, region, CAST(sort_order AS BIGINT) AS sort_order, rotation, {ROUND} FROM made"))
def candidate_plan(spark: SparkSession, d: str) -> DataFrame:
    return pl.candidates(*given(spark, d)).withColumns({c: F.round(c, 6) for c in ("confidence", "x", "y", "w", "h")})


@query("cv9_region_routes", sql(STEPS, "SELECT doc, page, region, coalesce(skip, 'read') AS route, CAST(makes AS BIGINT) AS makes, CAST(before AS BIGINT) AS before FROM bf"))
def region_routes(spark: SparkSession, d: str) -> DataFrame:
    out = pl.routed(*given(spark, d)[:4])
    return out.select("doc", "page", "region", F.coalesce("skip", F.lit("read")).alias("route"), F.col("makes").cast("long").alias("makes"), F.col("before").cast("long").alias("before"))


@query("a19_skip_reasons", sql(STEPS, "SELECT doc, page, reason, CAST(n AS BIGINT) AS n FROM skipped"))
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    return pl.skip_counts(*given(spark, d))


@query("a19_page_reports", sql(STEPS, """, w AS (SELECT doc, page, string_agg(reason || '=' || n, ',' ORDER BY reason) AS skipped FROM skipped GROUP BY 1, 2), c AS (SELECT doc, page, count(*) AS candidates FROM made GROUP BY 1, 2)
 SELECT p.doc, p.page, CASE WHEN layout THEN 'ocr_candidates_planned' ELSE 'ocr_candidates_skipped_no_layout' END AS code, coalesce(candidates, 0) AS candidates, coalesce(skipped, '') AS skipped FROM pages p LEFT JOIN w USING (doc, page) LEFT JOIN c USING (doc, page)"""))
def page_reports(spark: SparkSession, d: str) -> DataFrame:
    frames = given(spark, d)
    out = pl.page_reports(frames[0], pl.candidates(*frames), pl.skip_counts(*frames))
    shown = F.array_join(F.transform(F.map_entries("skipped"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.withColumn("skipped", shown)


@query("cv19_side_strips", sql(STEPS, "SELECT doc, page, candidate, CAST(sort_order AS BIGINT) AS sort_order, rotation, x, y, w, h FROM made WHERE kind = 'side_strip_candidate'"))
def side_strips(spark: SparkSession, d: str) -> DataFrame:
    return pl.candidates(*given(spark, d)).where("kind = 'side_strip_candidate'").select("doc", "page", "candidate", "sort_order", "rotation", "x", "y", "w", "h")


@query("cv11_text_layer_first", sql(LAYER, """SELECT a.doc, a.page, a.candidate, CASE WHEN t.text <> '' THEN 'text_layer' WHEN coalesce(hypothesis, '') NOT IN ('', 'original') AND k.doc IS NOT NULL THEN 'suppressed' ELSE 'engine' END AS route, coalesce(nullif(t.text, ''), '') AS text, CASE WHEN t.text <> '' THEN t.words ELSE 0 END AS words
 FROM asked a LEFT JOIN txt t ON t.doc = a.doc AND t.page = a.page AND t.candidate = a.candidate
 LEFT JOIN known k ON k.doc = a.doc AND k.page = a.page AND k.kind = a.kind AND k.region = a.region AND k.x = round_even(a.x, 0) AND k.y = round_even(a.y, 0) AND k.w = round_even(a.w, 0) AND k.h = round_even(a.h, 0)"""))
def text_layer_first(spark: SparkSession, d: str) -> DataFrame:
    out = pl.text_layer_first(part(spark, d, "asked"), part(spark, d, "words"))
    return out.select("doc", "page", "candidate", "route", F.coalesce("text", F.lit("")).alias("text"), "words")

"""Queries over the small operators of ``views``, and the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import views as vw
from tessera.plans.fixtures import ctes, fixture, table
from tessera.plans.pages import AREA, RECTS

Q: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


SIZES = "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_size END AS width_px, CASE WHEN p_size < 10 THEN p_size END AS height_px FROM {part}"


@query("f10_defaults", "SELECT id, coalesce(width_px, 64) AS width_px, coalesce(height_px, 20) AS height_px FROM (" + SIZES.format(part="part") + ")")
def defaults(spark: SparkSession, d: str) -> DataFrame:
    return vw.with_defaults(spark.sql(SIZES, part=table(spark, d, "part")), {"width_px": 64, "height_px": 20})


REGIONS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'table_candidate' ELSE 'text' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'suppressed_small' WHEN 1 THEN 'grid' END AS reason, p_size / 50.0 AS confidence FROM {part}"


@query("f16_table_regions", "SELECT id FROM (" + REGIONS.format(part="part") + ") WHERE kind = 'table_candidate' AND NOT coalesce(starts_with(reason, 'suppressed_'), false) AND confidence >= 0.5")
def table_regions(spark: SparkSession, d: str) -> DataFrame:
    return vw.table_regions(spark.sql(REGIONS, part=table(spark, d, "part"))).select("id")


@query("j11_latest_text", "SELECT c_custkey AS candidate_id, t.text FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS text FROM orders GROUP BY 1) t ON o_custkey = c_custkey")
def latest_text(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("pos"))
    return vw.latest_texts(table(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id")), texts)


@query("j16_first_match", """WITH r AS (SELECT o_orderkey AS record_id, o_custkey AS version_id, CASE WHEN o_orderkey % 2 = 0 THEN 'estimate' ELSE 'drawing' END AS family FROM orders), i AS (SELECT c_custkey AS version_id, unnest([c_custkey * 3, c_custkey * 5, 99999999]) AS record_id FROM customer WHERE c_custkey % 2 = 0),
 b AS (SELECT i.version_id, i.record_id, 0 AS rank FROM i JOIN r USING (record_id) UNION ALL SELECT version_id, record_id, 1 FROM r WHERE family = 'estimate') SELECT version_id, min_by(record_id, rank * 1000000000 + record_id) AS record_id FROM b GROUP BY 1""")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("version_id"), F.when(F.col("o_orderkey") % 2 == 0, "estimate").otherwise("drawing").alias("family"))
    ids = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("version_id"), F.array(F.col("c_custkey") * 3, F.col("c_custkey") * 5, F.lit(99999999).cast("long")).alias("source_ids"))
    return vw.first_match(ids, records)


@query("a16_boxes", ctes("words") + "SELECT page, min(x) AS x, min(y) AS y, max(x + w) AS \"right\", max(y + h) AS bottom FROM words GROUP BY 1")
def boxes(spark: SparkSession, d: str) -> DataFrame:
    return vw.boxes(fixture(spark, d, "words"), "page")


@query("a18_facet_options", "SELECT DISTINCT 'o_orderstatus' AS facet, o_orderstatus AS value FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def facet_options(spark: SparkSession, d: str) -> DataFrame:
    return vw.facet_options(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("a21_totals_by", ctes("jobs") + "SELECT status, CAST(sum(duration_s) AS BIGINT) AS total, max(duration_s) AS most FROM jobs GROUP BY 1")
def totals(spark: SparkSession, d: str) -> DataFrame:
    return vw.totals_by(fixture(spark, d, "jobs"), "status", "duration_s")


@query("u5_ordered_union", "SELECT p_partkey AS id, CASE WHEN p_size % 5 = p_size % 3 THEN concat(p_size % 5, '|', 7) ELSE concat(p_size % 5, '|', 7, '|', p_size % 3) END AS ids FROM part")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    union = vw.ordered_union(F.array(F.col("p_size") % 5, F.lit(7)), F.array(F.lit(7), F.col("p_size") % 3))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(union, lambda x: x.cast("string")), "|").alias("ids"))


LABELS = "VALUES ('brand', 'Марка'), ('size', 'Размер')"


@query("p3_field_rows", f"SELECT id, key, coalesce(label, key) AS label, value FROM (SELECT p_partkey AS id, unnest(['brand', 'size', 'kind']) AS key, unnest([p_brand, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END, p_type]) AS value FROM part) LEFT JOIN ({LABELS}) l(key, label) USING (key) WHERE value IS NOT NULL")
def field_rows(spark: SparkSession, d: str) -> DataFrame:
    fields = F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.when(F.col("p_size") > 10, F.col("p_size").cast("string")), F.lit("kind"), "p_type")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), fields.alias("fields"))
    return vw.field_rows(rows, spark.sql(f"SELECT * FROM ({LABELS}) AS l(key, label)"))


@query("t4_reading_order", ctes("words") + "SELECT page AS region, id, row_number() OVER (PARTITION BY page ORDER BY line, x, id) AS place FROM words")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return vw.reading_order(fixture(spark, d, "words").select(F.col("page").alias("region"), "id", F.col("line").alias("row"), F.col("x").alias("col")))


@query("dm11_backfill", "SELECT o_orderkey AS id, upper(o_orderpriority) AS label FROM orders")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    return vw.backfill(table(spark, d, "orders"), "label", F.upper("o_orderpriority")).select(F.col("o_orderkey").alias("id"), "label")


@query("cv17_kinds", "SELECT kind, count(*) AS n FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'REGION_KIND_TABLE' WHEN 1 THEN 'REGION_KIND_STAMP' ELSE 'REGION_KIND_UNSPECIFIED' END AS kind FROM part) GROUP BY 1")
def kinds(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, "table_candidate").when(F.col("p_partkey") % 3 == 1, "stamp").otherwise("mystery")
    return table(spark, d, "part").groupBy(vw.kind_of(name).alias("kind")).agg(F.count("*").alias("n"))


@query("cv23_block_columns", ctes("words", more="c AS (SELECT page, 0 AS col, 0 AS low, 40 AS high FROM (SELECT DISTINCT page FROM words) UNION ALL SELECT page, 1, 40, 75 FROM (SELECT DISTINCT page FROM words) UNION ALL SELECT page, 2, 75, 200 FROM (SELECT DISTINCT page FROM words))") + "SELECT id, page, col FROM words JOIN c USING (page) WHERE (least(x + w, high) - greatest(x, low)) / w >= 0.25")
def block_columns(spark: SparkSession, d: str) -> DataFrame:
    words = fixture(spark, d, "words")
    spans = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.lit(a).alias("low"), F.lit(b).alias("high")) for i, (a, b) in enumerate(((0, 40), (40, 75), (75, 200)))]))
    return vw.block_columns(words, words.select("page").distinct().select("page", spans.alias("c")).select("page", "c.*"))


@query("cv24_truncated", "WITH r AS (SELECT DISTINCT l_suppkey AS page, l_linenumber AS i, l_linenumber * 20 + CASE WHEN l_linenumber > 4 THEN l_suppkey % 30 ELSE 0 END AS y FROM lineitem), g AS (SELECT *, y + 12 AS b, lead(y) OVER (PARTITION BY page ORDER BY i) AS nxt FROM r), s AS (SELECT s_suppkey AS page, 95 AS line FROM supplier WHERE s_suppkey % 2 = 0), c AS (SELECT page, min(i) AS last FROM g JOIN s USING (page) WHERE nxt - b > 15 AND line BETWEEN b AND nxt GROUP BY 1) SELECT r.page, i FROM r LEFT JOIN c USING (page) WHERE last IS NULL OR i <= last")
def truncated(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_linenumber").alias("i")).distinct()
    rows = rows.withColumn("y", F.col("i") * 20 + F.when(F.col("i") > 4, F.col("page") % 30).otherwise(0)).withColumn("b", F.col("y") + 12)
    return vw.truncated(rows, table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("page"), F.lit(95).alias("y")), 15)


@query("cv25_text_regions", "WITH r AS (" + RECTS.format(part="part") + f"), a AS (SELECT *, score / 101.0 AS density FROM r WHERE id % 4 > 0), b AS (SELECT * FROM r WHERE id % 4 = 0), k AS (SELECT * FROM a WHERE w * h >= 12 AND NOT (w / h BETWEEN 0.85 AND 1.18 AND density > 0.6) AND NOT EXISTS (SELECT 1 FROM b WHERE b.page = a.page AND {AREA} / (a.w * a.h) > 0.65)), o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, id) AS place FROM k) SELECT page, id, place FROM o WHERE place <= 80")
def text_regions(spark: SparkSession, d: str) -> DataFrame:
    r = spark.sql(RECTS, part=table(spark, d, "part")).withColumn("density", F.col("score") / 101)
    return vw.text_regions(r.where("id % 4 > 0"), r.where("id % 4 = 0"))


@query("cv6_line_positions", "WITH c AS (SELECT l_suppkey AS grp, CAST(l_quantity * 3 + l_linenumber AS BIGINT) AS pos, count(*) / 4.0 AS share FROM lineitem GROUP BY 1, 2), n AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY grp ORDER BY pos) = 1 THEN 0 ELSE 1 END AS f FROM c WHERE share >= 0.7), r AS (SELECT *, sum(f) OVER (PARTITION BY grp ORDER BY pos) AS run FROM n), p AS (SELECT grp, run, CAST(round_even((min(pos) + max(pos)) / 2, 0) AS BIGINT) AS p FROM r GROUP BY 1, 2), q AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY grp ORDER BY p) < 4 THEN 0 ELSE 1 END AS f FROM p), g AS (SELECT *, sum(f) OVER (PARTITION BY grp ORDER BY p) AS g FROM q) SELECT grp, CAST(list_reduce(list(p ORDER BY p), lambda a, x: CAST(round_even((a + x) / 2, 0) AS BIGINT)) AS BIGINT) AS pos FROM g GROUP BY grp, g")
def line_positions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("grp"), (F.col("l_quantity") * 3 + F.col("l_linenumber")).cast("long").alias("pos")).agg((F.count("*") / 4).alias("share"))
    return vw.line_positions(c, 0.7)

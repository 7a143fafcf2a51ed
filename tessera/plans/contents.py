"""Queries over what documents hold, and the same for DuckDB where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import content as ct
from tessera.plans.fixtures import table

Q: dict[str, object] = {}
SQL: dict[str, str] = {}

ARTIFACTS = """
 SELECT p_partkey AS id, p_partkey % 300 AS version_id, CASE p_partkey % 4 WHEN 0 THEN 'xlsx_cells' WHEN 1 THEN 'pdf_tables' ELSE 'pdf_text' END AS artifact_type,
 CASE WHEN p_partkey % 2 = 0 THEN concat('{"text":"PRJ_', p_size, '-R.', p_partkey % 50, '-AR","value":"no code"}')
 ELSE concat('{"cells":[{"value":"', p_size, '-P-0', p_partkey % 9, '"},{"value":""},{"value":"register-', p_size, '"}],"rows":[{"cells":[{"value":"A-', p_partkey % 40, '"}]}]}') END AS payload FROM {part}"""


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    # braces of JSON are no table names: the one table is put in by hand
    table(spark, d, "part").createOrReplaceTempView("tessera_part")
    return spark.sql(ARTIFACTS.replace("{part}", "tessera_part"), {})


def content_codes(spark: SparkSession, d: str) -> DataFrame:
    return ct.content_codes(_artifacts(spark, d))


Q["do11_content_codes"] = content_codes
CODES = """WITH a AS (""" + ARTIFACTS.replace("{part}", "part") + r"""),
 v AS (SELECT version_id, id, 0 AS k, 0 AS pos, payload->>'text' AS raw FROM a UNION ALL SELECT version_id, id, 0, 1, payload->>'value' FROM a UNION ALL SELECT version_id, id, 0, 2, payload->>'rawValue' FROM a
  UNION ALL SELECT version_id, id, 1, i, payload->>('$.cells[' || i || '].value') FROM a, range(3) r(i) UNION ALL SELECT version_id, id, 2, 0, payload->>'$.rows[0].cells[0].value' FROM a),
 c AS (SELECT *, upper(regexp_replace(trim(raw), '[_.\s-]+', '-', 'g')) AS u FROM v WHERE raw IS NOT NULL),
 s AS (SELECT *, list_filter(list_transform(string_split(u, '-'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE x END), lambda x: x NOT IN ('REGISTER')) AS p FROM c WHERE contains(u, '-') AND regexp_matches(u, '[0-9]')),
 n AS (SELECT version_id, id, row_number() OVER (PARTITION BY id ORDER BY k, pos) - 1 AS n, ['direct', 'cell', 'row'][k + 1] AS kind, array_to_string(p, '-') AS code FROM s)
 """
SQL["do11_content_codes"] = CODES + "SELECT version_id, min_by(id, (id, n)) AS id, min_by(n, (id, n)) AS n, min_by(kind, (id, n)) AS kind, code FROM n GROUP BY version_id, code"


def _versions(spark: SparkSession) -> DataFrame:
    return spark.range(300).select(F.col("id").alias("version_id"), F.when(F.col("id") % 3 == 0, "drawing").otherwise("estimate").alias("family"))


def typed_records(spark: SparkSession, d: str) -> DataFrame:
    return ct.typed_records(_versions(spark), ct.content_codes(_artifacts(spark, d)))


Q["do9_typed_records"] = typed_records
FIRST = ", f AS (SELECT version_id, min_by(id, (id, n)) AS id, min_by(n, (id, n)) AS n, code FROM n GROUP BY version_id, code), o AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY id, n) AS i FROM f), vs AS (SELECT range AS version_id, CASE WHEN range % 3 = 0 THEN 'drawing' ELSE 'estimate' END AS family FROM range(300)) "
SQL["do9_typed_records"] = CODES + FIRST + "SELECT vs.version_id, family, CASE WHEN family <> 'drawing' THEN max(code) FILTER (i = 1) END AS own_code, coalesce(string_agg(i || ':' || code, '|' ORDER BY i), '') AS rows FROM vs LEFT JOIN o USING (version_id) GROUP BY 1, 2"


def embedded(spark: SparkSession, d: str) -> DataFrame:
    a = _artifacts(spark, d)
    return ct.embedded_statements(_versions(spark), a, ct.content_codes(a))


Q["do10_embedded_statements"] = embedded
SQL["do10_embedded_statements"] = CODES + FIRST + "SELECT version_id, 'statement' AS family, count(*) AS rows FROM o JOIN vs USING (version_id) WHERE family = 'drawing' AND version_id IN (SELECT version_id FROM a WHERE artifact_type IN ('xlsx_cells', 'pdf_tables')) GROUP BY 1"


def previews(spark: SparkSession, d: str) -> DataFrame:
    return ct.previews(_artifacts(spark, d), cells=2, letters=6)


Q["do28_previews"] = previews
SQL["do28_previews"] = "WITH a AS (" + ARTIFACTS.replace("{part}", "part") + ") SELECT id, CASE WHEN artifact_type = 'xlsx_cells' THEN 'cells' WHEN payload->>'text' IS NOT NULL THEN 'text' ELSE 'fallback' END AS viewer, CASE WHEN artifact_type = 'xlsx_cells' THEN CASE WHEN payload->>'$.cells[0].value' IS NOT NULL THEN (payload->>'$.cells[0].value') || '|' || (payload->>'$.cells[1].value') END ELSE left(payload->>'text', 6) END AS preview, CASE WHEN artifact_type = 'xlsx_cells' THEN coalesce(json_array_length(payload->'cells'), 0) > 2 ELSE coalesce(length(payload->>'text') > 6, false) END AS cut FROM a"

NAMES = "SELECT p_partkey AS id, concat('Газопровод ', p_size, '. Этап ', p_size % 9, '.1. КС-', p_partkey % 12) AS construction, concat(CASE p_partkey % 3 WHEN 0 THEN 'Монтажные работы.' WHEN 1 THEN 'на ' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN concat('Этап 12.', p_size % 7, '. ') ELSE '' END, CASE WHEN p_partkey % 5 < 3 THEN concat('КС-', p_size % 20, ' \"Имя\" Установка ', p_brand, '.') ELSE '' END, 'Цех ', p_partkey % 30, CASE WHEN p_partkey % 7 = 0 THEN '. Линия. Опоры' ELSE '' END) AS work FROM {part}"


def project_context(spark: SparkSession, d: str) -> DataFrame:
    return ct.work_context(spark.sql(NAMES, part=table(spark, d, "part"))).drop("construction", "work")


Q["do23_project_context"] = project_context


def spans(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    phase = F.when(F.col("event_id") % 2 == 0, "started").when(F.col("event_id") % 3 == 0, "failed").otherwise("completed")
    return ct.spans(e.where("event_id % 10 <> 3").select(F.floor(F.col("event_id") / 2).alias("span_id"), phase.alias("phase"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")))


Q["e10_spans"] = spans
SQL["e10_spans"] = "WITH l AS (SELECT event_id // 2 AS span_id, CASE WHEN event_id % 2 = 0 THEN 's' WHEN event_id % 3 = 0 THEN 'f' ELSE 'c' END AS p, epoch_us(ts) AS t FROM events WHERE event_id % 10 <> 3), g AS (SELECT span_id, max(t) FILTER (p = 's') AS a, max(t) FILTER (p <> 's') AS b, bool_or(p = 'f') AS f FROM l GROUP BY 1) SELECT span_id, CAST(floor((b - a) / 1000) AS BIGINT) AS duration_ms, CASE WHEN b IS NULL THEN 'open' WHEN f THEN 'failed' ELSE 'completed' END AS status FROM g"


def error_classes(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("o_custkey") % 4 == 0, "timeout").when(F.col("o_custkey") % 4 == 1, "unavailable").otherwise("parse_error")
    return table(spark, d, "orders").groupBy(ct.error_class(code).alias("class")).agg(F.count("*").alias("n"))


Q["e6_error_classes"] = error_classes
SQL["e6_error_classes"] = "SELECT CASE WHEN o_custkey % 4 < 2 THEN 'transient' ELSE 'deterministic' END AS class, count(*) AS n FROM orders GROUP BY 1"

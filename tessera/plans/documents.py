"""Queries over files, codes, cells and texts, and the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codes as co
from tessera.functions import text as tx
from tessera.operators import cells as ce
from tessera.operators import facts as fa
from tessera.operators import intake as it
from tessera.plans.fixtures import FIXTURES, LINES_ONCE, at_once, ctes, fixture, table

Q: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- files ------------------------------------------------------------------------------------------

BASE = r"lower(trim(regexp_replace(regexp_replace(string_split(original_name, '/')[-1], '\.[^.]*$', ''), '\s+', ' ', 'g')))"


@query("do1_file_priority", ctes("files", more=f"f AS (SELECT *, {BASE} AS base, CASE extension WHEN '.xlsx' THEN 2 WHEN '.pdf' THEN 1 ELSE 0 END AS p FROM files)") + "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY set_id, base ORDER BY p DESC, id) r FROM f) WHERE p = 0 OR r = 1")
def file_priority(spark: SparkSession, d: str) -> DataFrame:
    return it.by_priority(fixture(spark, d, "files")).select("id")


@query("do2_duplicate_uploads", ctes("files") + "SELECT id, CASE WHEN r > 1 THEN 'request' ELSE 'stored' END AS found_in FROM (SELECT *, row_number() OVER (PARTITION BY set_id, checksum ORDER BY id) r FROM files WHERE checksum IS NOT NULL AND id % 10 < 8) f WHERE r > 1 OR checksum IN (SELECT checksum FROM files WHERE id % 10 >= 8 AND checksum IS NOT NULL)")
def duplicate_uploads(spark: SparkSession, d: str) -> DataFrame:
    files = fixture(spark, d, "files")
    return it.duplicates(files.where("id % 10 < 8"), files.where("id % 10 >= 8"))


def typed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files with a media type that may say other than the name."""
    return fixture(spark, d, "files").withColumn("mime_type", F.expr("CASE WHEN id % 13 = 0 THEN 'application/zip' WHEN id % 13 = 1 THEN 'application/pdf' ELSE '' END"))


@query("do3_set_validation", ctes("files", more="""x AS (SELECT id % 7 AS set_id, id FROM files), s AS (SELECT * FROM files WHERE id % 997 <> 0),
  r AS (SELECT x.set_id, x.id, s.id IS NULL AS lost, s.id % 13 = 0 AS archive, CASE WHEN s.id IS NULL THEN NULL WHEN coalesce(size_bytes, 0) <= 0 THEN 'empty_file' WHEN checksum IS NULL OR checksum = '' THEN 'missing_checksum' END AS code FROM x LEFT JOIN s ON s.id = x.id)""")
  + """SELECT set_id, CASE WHEN bool_or(lost) THEN 'stored_file_not_found' ELSE min_by(code, id) FILTER (code IS NOT NULL) END AS code, CASE WHEN NOT bool_or(lost) THEN min(id) FILTER (code IS NOT NULL) END AS file_id,
 CASE WHEN bool_or(lost) OR count(code) > 0 THEN 'failed' WHEN bool_or(coalesce(archive, false)) THEN 'unpack' ELSE 'process' END AS next_step FROM r GROUP BY 1""")
def set_validation(spark: SparkSession, d: str) -> DataFrame:
    files = typed_files(spark, d)
    return it.validate_sets(files.select("set_id", "id"), files.where("id % 997 <> 0"))


@query("do3_input_validation", ctes("files") + "SELECT id, CASE WHEN coalesce(size_bytes, 0) <= 0 THEN 'empty_file' WHEN checksum IS NULL OR checksum = '' THEN 'missing_checksum' END AS code, id % 13 = 0 AS archive FROM files")
def input_validation(spark: SparkSession, d: str) -> DataFrame:
    return it.violations(typed_files(spark, d))


@query("do4_format_detect", ctes("files") + "SELECT CASE WHEN extension = '.pdf' OR id % 13 = 1 THEN 'pdf' WHEN extension = '.xlsx' THEN 'xlsx' ELSE 'unsupported' END AS format, count(*) AS n FROM files GROUP BY 1")
def format_detect(spark: SparkSession, d: str) -> DataFrame:
    return typed_files(spark, d).groupBy(it.file_format(F.col("extension"), F.col("mime_type")).alias("format")).agg(F.count("*").alias("n"))


NAMES = "SELECT p_partkey AS id, concat(substr('Statement_Register_VEDOMOST_smeta_ESTIMATE_drawing_notes', CAST(p_partkey % 50 AS INT) + 1, 12), CASE WHEN p_partkey % 3 = 0 THEN '.PDF' ELSE '.xlsx' END) AS original_name, p_size FROM {part}"
FAMILY = "CASE WHEN regexp_matches(lower(original_name), 'statement|register|vedomost|volume-list') THEN 'statement' WHEN regexp_matches(lower(original_name), 'estimate|smeta') THEN 'estimate' WHEN contains(lower(original_name), 'drawing') OR ends_with(lower(original_name), '.pdf') THEN 'drawing' ELSE 'unknown' END"


@query("do5_family_infer", "WITH n AS (" + NAMES.format(part="part") + f") SELECT id, {FAMILY} AS family FROM n")
def family_infer(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(NAMES, part=table(spark, d, "part")).select("id", it.family(F.col("original_name")).alias("family"))


@query("do6_type_resolution", "WITH n AS (SELECT *, " + FAMILY + " AS f FROM (" + NAMES.format(part="part") + """)), x AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'drawing' END AS b, CASE WHEN id % 3 = 0 THEN 'estimate' END AS t FROM n)
 SELECT id, coalesce(b, t, f) AS family, CASE WHEN b IS NOT NULL THEN 'high' WHEN t IS NOT NULL THEN CASE WHEN p_size > 20 THEN 'high' ELSE 'medium' END WHEN f = 'unknown' THEN 'none' ELSE 'low' END AS confidence, CASE WHEN coalesce(b, t) <> f THEN f END AS alternative FROM x""")
def type_resolution(spark: SparkSession, d: str) -> DataFrame:
    files = spark.sql(NAMES, part=table(spark, d, "part"))
    return it.resolve_type(files, files.where("id % 5 = 0"), files.where("id % 3 = 0").select("id", F.when(F.col("p_size") > 20, "high").otherwise("medium").alias("template_confidence")))


@query("f8_visible_files", ctes("files") + "SELECT id FROM files WHERE purpose = 'original_upload' OR id % 20 = 0")
def visible(spark: SparkSession, d: str) -> DataFrame:
    files = fixture(spark, d, "files")
    edges = files.where("id % 20 = 0").select(F.col("id").alias("child_id"), F.lit("extracted_from_archive").alias("relation"))
    return it.visible(files, edges).select("id")


ENTRY_PATHS = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '../a' WHEN 1 THEN '/etc/x' WHEN 2 THEN 'a/../../b' WHEN 3 THEN 'dir/ok.pdf' WHEN 4 THEN 'c:' ELSE 'a..b/c' END AS path FROM {part}"


@query("f12_safe_path", "WITH e AS (" + ENTRY_PATHS.format(part="part") + ") SELECT id FROM e WHERE NOT (regexp_matches(path, '^/|^[A-Za-z]:') OR regexp_matches(path, '(^|/)\\.\\.(/|$)') OR path = '')")
def safe_path(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(ENTRY_PATHS, part=table(spark, d, "part")).where(it.safe_path(F.col("path"))).select("id")


@query("f13_archive_guard", "SELECT doc_id % 9 AS archive_id, count(*) AS entries, CAST(sum(n_chars * 1000000) AS BIGINT) AS bytes, count(*) <= 10000 AND sum(n_chars * 1000000) <= 53687091200 AS allowed FROM documents GROUP BY 1")
def archive_guard(spark: SparkSession, d: str) -> DataFrame:
    return it.archive_guard(table(spark, d, "documents").select((F.col("doc_id") % 9).alias("archive_id"), (F.col("n_chars") * 1000000).alias("size_bytes")))


@query("j13_entry_match", """WITH f AS (SELECT doc_id AS file_id, doc_id % 3 AS archive_id, concat('p', doc_id) AS path, n_chars AS size_bytes, doc_id % 2 AS extension FROM documents),
 e AS (SELECT doc_id AS entry_id, doc_id % 3 AS archive_id, CASE WHEN doc_id % 4 = 0 THEN concat('p', doc_id) ELSE 'other' END AS path, n_chars AS size_bytes, doc_id % 2 AS extension FROM documents WHERE doc_id % 9 <> 1),
 x AS (SELECT file_id, entry_id FROM f JOIN e USING (archive_id, path)),
 f1 AS (SELECT archive_id, size_bytes, extension, min(file_id) AS file_id FROM f WHERE file_id NOT IN (SELECT file_id FROM x) GROUP BY ALL HAVING count(*) = 1),
 e1 AS (SELECT archive_id, size_bytes, extension, min(entry_id) AS entry_id FROM e WHERE entry_id NOT IN (SELECT entry_id FROM x) GROUP BY ALL HAVING count(*) = 1)
 SELECT file_id, entry_id, 'path' AS by FROM x UNION ALL SELECT file_id, entry_id, 'size' FROM f1 JOIN e1 USING (archive_id, size_bytes, extension)""")
def entry_match(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("archive_id"), F.col("n_chars").alias("size_bytes"), (F.col("doc_id") % 2).alias("extension"))
    path = F.concat(F.lit("p"), F.col("doc_id"))
    files = docs.select(F.col("doc_id").alias("file_id"), "archive_id", path.alias("path"), "size_bytes", "extension")
    entries = docs.where("doc_id % 9 <> 1").select(F.col("doc_id").alias("entry_id"), "archive_id", F.when(F.col("doc_id") % 4 == 0, path).otherwise("other").alias("path"), "size_bytes", "extension")
    return it.match_entries(files, entries)


@query("do30_cleanup_candidates", "SELECT DISTINCT key FROM (SELECT concat('art/', doc_id % 700) AS key FROM documents) WHERE key NOT IN (SELECT concat('art/', doc_id) FROM documents WHERE doc_id % 3 <> 0)")
def cleanup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return it.cleanup(docs.select(F.concat(F.lit("art/"), F.col("doc_id") % 700).alias("key")), docs.where("doc_id % 3 <> 0").select(F.concat(F.lit("art/"), F.col("doc_id")).alias("key")))


# -- codes ------------------------------------------------------------------------------------------

PLAIN = r"array_to_string(list_transform(string_split({x}, '/'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN regexp_replace(p, '^0+([0-9])', '\1') ELSE p END), '/')"
NORMAL = r"array_to_string(list_transform(string_split(upper(regexp_replace(regexp_replace(trim(raw), '[_.\s]+', '-', 'g'), '-+', '-', 'g')), '-'), lambda s: " + PLAIN.format(x="s") + "), '-')"
SEGS = r"list_filter(list_transform(string_split_regex(upper(trim({v})), '[-.\s]+'), lambda s: " + PLAIN.format(x="s") + "), lambda s: s <> '')"
STAGE = "CASE {x} WHEN 'P' THEN 'П' WHEN 'П' THEN 'П' WHEN 'R' THEN 'Р' WHEN 'Р' THEN 'Р' WHEN 'I' THEN 'И' WHEN 'И' THEN 'И' WHEN 'ИИ' THEN 'ИИ' END"
L8 = "regexp_full_match(x, '[A-ZА-ЯЁ]{1,8}')"


def parsed(source: str, value: str) -> str:
    """Common tables that parse a column of codes in DuckDB; the last is named ``parsed``."""
    return f"""
 s0 AS (SELECT *, CASE WHEN coalesce({value}, '') = '' THEN [] ELSE {SEGS.format(v=value)} END AS s FROM {source}),
 s1 AS (SELECT *, coalesce(list_position(list_transform(s, lambda x: {STAGE.format(x='x')} IS NOT NULL), true), 0) AS ix FROM s0),
 s2 AS (SELECT *, CASE WHEN ix > 0 THEN s[ix + 1:] ELSE [] END AS a FROM s1),
 s3 AS (SELECT *, list_filter(CASE WHEN ix > 0 THEN a ELSE s[2:] END, lambda x: {L8} AND {STAGE.format(x='x')} IS NULL)[-1] AS mark,
   coalesce(list_position(list_transform(a, lambda x: regexp_full_match(x, '[0-9]+(/[0-9]+)?')), true), 0) AS sec, coalesce(list_position(list_transform(a, lambda x: {L8}), true), 0) AS g,
   ix >= 3 AND regexp_full_match(s[1], '[0-9]+') AND regexp_full_match(s[2], '[0-9]+') AS phys FROM s2),
 parsed AS (SELECT * EXCLUDE (s, ix, a, sec, g, phys), s[1] AS project_code, CASE WHEN phys THEN s[2] END AS site_code, CASE WHEN ix > 0 THEN {STAGE.format(x='s[ix]')} END AS stage,
   coalesce({prefix('SEC')}, list_filter(a, lambda x: regexp_full_match(x, '[0-9]+(/[0-9]+)?'))[1]) AS section_number,
   coalesce({prefix('VOL')}, CASE WHEN sec > 0 THEN list_filter(a[sec + 1:], lambda x: regexp_full_match(x, '[0-9]+'))[1] ELSE list_filter(a, lambda x: regexp_full_match(x, '[0-9]{{1,4}}'))[1] END) AS volume_number,
   {prefix('REV')} AS revision, list_filter(a, lambda x: {L8} AND (mark IS NULL OR x <> mark))[1] AS document_group,
   CASE WHEN g > 0 THEN a[g + 1] END AS document_number, CASE WHEN phys AND g > 0 THEN a[g + 2] END AS work_code, CASE WHEN phys AND g > 0 THEN a[g + 3] END AS subobject_code, CASE WHEN phys AND g > 0 THEN a[g + 4] END AS part_number,
   CASE WHEN mark IS NOT NULL AND ix = 0 THEN 'mark_without_documentation_stage' END AS ambiguity,
   CASE WHEN s[1] IS NULL OR NOT regexp_full_match(s[1], '[A-ZА-ЯЁ0-9][A-ZА-ЯЁ0-9]*') THEN 'invalid' WHEN list_has_any(s, ['ISO', 'IFC', 'BS', 'DIN', 'UNSUPPORTED']) THEN 'unsupported' ELSE 'parsed' END AS status FROM s3)"""


def prefix(p: str) -> str:
    x = f"list_filter(s, lambda x: starts_with(x, '{p}'))[1]"
    return f"CASE WHEN length({x}) > {len(p)} THEN substr({x}, {len(p) + 1}) ELSE {x} END"


@query("st1_code_normalize", ctes("codes") + f"SELECT id, {NORMAL} AS code FROM codes")
def code_normalize(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "codes").select("id", co.normalize(F.col("raw")).alias("code"))


@query("st3_code_candidate", ctes("codes", more=f"n AS (SELECT id, {NORMAL} AS c FROM codes), k AS (SELECT id, c, list_filter(string_split(c, '-'), lambda x: x NOT IN ('DRAWING', 'ESTIMATE', 'SMETA', 'STATEMENT', 'REGISTER', 'VEDOMOST', 'PROJECT', 'PD', 'RD', 'PDF', 'XLSX')) AS k FROM n)") + "SELECT id, CASE WHEN regexp_matches(c, '[0-9]') AND contains(c, '-') AND len(k) > 0 THEN array_to_string(k, '-') END AS code FROM k")
def code_candidate(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "codes").select("id", co.candidate(F.col("raw")).alias("code"))


@query("do12_code_parse", ctes("codes", more=f"n AS (SELECT id, {NORMAL} AS code FROM codes)," + parsed("n", "code")) + "SELECT * FROM parsed")
def code_parse(spark: SparkSession, d: str) -> DataFrame:
    return co.parse(fixture(spark, d, "codes").select("id", co.normalize(F.col("raw")).alias("code")))


@query("do13_code_status", ctes("codes", more=parsed("codes", "raw")) + "SELECT status, ambiguity IS NOT NULL AS ambiguous, count(*) AS n FROM parsed GROUP BY ALL")
def code_status(spark: SparkSession, d: str) -> DataFrame:
    return co.parse(fixture(spark, d, "codes"), "raw").groupBy("status", F.col("ambiguity").isNotNull().alias("ambiguous")).agg(F.count("*").alias("n"))


@query("do25_document_facets", ctes("codes", more=f"x AS (SELECT id, {SEGS.format(v='raw')} AS s FROM codes), y AS (SELECT *, coalesce(list_position(list_transform(s, lambda x: {STAGE.format(x='x')} IS NOT NULL), true), 0) AS ix FROM x)") + f"SELECT id, CASE WHEN ix > 0 THEN {STAGE.format(x='s[ix]')} END AS stage, CASE WHEN ix > 0 THEN list_filter(s[ix + 1:], lambda x: {L8} AND {STAGE.format(x='x')} IS NULL)[-1] END AS mark FROM y")
def facets(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "codes").withColumn("f", co.facets(F.col("raw"))).select("id", "f.stage", "f.mark")


ROLES = "SELECT version_id, CASE WHEN id % 3 = 0 AND version_id % 4 > 0 THEN 'own_code' ELSE 'reference_code' END AS role, id AS pos, raw FROM {codes}"
IDENT = "r AS (" + ROLES.format(codes="codes") + f"), n AS (SELECT *, row_number() OVER (PARTITION BY version_id, role ORDER BY pos) - 1 AS i, {NORMAL} AS value FROM r), m AS (SELECT * FROM n WHERE role = 'reference_code' OR i = 0)," + parsed("m", "value") + """,
 ident AS (SELECT version_id, role, concat_ws(':', role, status, value) || CASE WHEN role = 'own_code' THEN '' ELSE concat(':', i) END AS identity_key, value, status FROM parsed
   UNION ALL SELECT DISTINCT version_id, 'own_code', 'own_code:missing', NULL, 'missing' FROM r WHERE version_id NOT IN (SELECT version_id FROM r WHERE role = 'own_code'))"""


@query("do14_identities", ctes("codes", more=IDENT) + "SELECT * FROM ident")
def identities(spark: SparkSession, d: str) -> DataFrame:
    return co.identities(spark.sql(ROLES, codes=fixture(spark, d, "codes")))


@query("do15_placement_choice", ctes("codes", more=IDENT) + """SELECT version_id, min_by(identity_key, (k, identity_key)) AS identity_key FROM (SELECT *, CASE WHEN version_id % 2 = 0 AND role = 'reference_code' AND status = 'parsed' THEN 0 WHEN version_id % 2 = 0 AND role = 'reference_code' AND value IS NOT NULL AND status <> 'invalid' THEN 1
 WHEN role = 'own_code' THEN 2 END AS k FROM ident) WHERE k IS NOT NULL GROUP BY 1""")
def placement_choice(spark: SparkSession, d: str) -> DataFrame:
    codes = spark.sql(ROLES, codes=fixture(spark, d, "codes"))
    return co.placement_choice(co.identities(codes), codes.where("version_id % 2 = 0").select("version_id").distinct())


@query("g5_placement_nodes", ctes("codes", more=f"n AS (SELECT id, {NORMAL} AS code FROM codes)," + parsed("n", "code") + """,
 p AS (SELECT DISTINCT 'project:' || project_code AS a, CASE WHEN stage IS NOT NULL THEN 'documentation_stage:' || stage END AS b, CASE WHEN stage IS NOT NULL AND mark IS NOT NULL THEN 'mark:' || mark END AS c FROM parsed WHERE status = 'parsed'),
 l AS (SELECT DISTINCT a AS path, NULL AS up, a AS x FROM p UNION SELECT a || '/' || b, a, b FROM p WHERE b IS NOT NULL UNION SELECT a || '/' || b || '/' || c, a || '/' || b, c FROM p WHERE c IS NOT NULL)""") + "SELECT left(sha256(path), 16) AS id, left(sha256(up), 16) AS parent_id, string_split(x, ':')[1] AS kind, string_split(x, ':')[2] AS key, path FROM l")
def placement_nodes(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.tree import materialise

    return materialise(co.parse(fixture(spark, d, "codes").select(co.normalize(F.col("raw")).alias("code"))))


TITLE = r"lower(trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"


@query("st20_title_similarity", f"""WITH t AS (SELECT p_partkey AS id, {TITLE.format(x='p_name')} AS a, {TITLE.format(x="concat(p_type, ' ', p_brand)")} AS b FROM part),
 u AS (SELECT *, list_distinct(list_filter(string_split(a, ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(b, ' '), lambda x: x <> '')) AS y FROM t)
 SELECT id, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS letters, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS words FROM u""")
def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    a, b = tx.structure_title(F.col("p_name")), tx.structure_title(F.concat_ws(" ", "p_type", "p_brand"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(tx.similarity(a, b), 6).alias("letters"), F.round(tx.token_jaccard(a, b), 6).alias("words"))


@query("do16_title_conflicts", None)
def title_conflicts(spark: SparkSession, d: str) -> DataFrame:
    codes = fixture(spark, d, "codes")
    return co.title_conflicts(codes.select((F.col("version_id") % 40).alias("node_id"), "id", "title", (F.col("version_id") % 40).cast("string").alias("key")))


# -- cells ------------------------------------------------------------------------------------------

VALUE = r"lower(trim(regexp_replace(value, '\s+', ' ', 'g')))"
NUM = r"TRY_CAST(replace(regexp_replace(regexp_extract(value, '[-+]?[0-9][0-9\s]*(?:[,.][0-9]+)?'), '\s+', '', 'g'), ',', '.') AS DOUBLE)"
HEADS = f"h AS (SELECT sheet, row, string_agg({VALUE}, ' ' ORDER BY col) AS t FROM cells GROUP BY 1, 2)"


@query("do19_header_row", ctes("cells", more=HEADS) + "SELECT sheet, min(row) AS header_row FROM h WHERE contains(t, 'обоснование') AND contains(t, 'наименование') AND contains(t, 'единица') AND contains(t, 'количество') GROUP BY 1")
def header_row(spark: SparkSession, d: str) -> DataFrame:
    return ce.header_rows(fixture(spark, d, "cells"), ce.LOCAL_HEADER)


EVIDENCE = ", ".join(f"arg_min({{'f': '{f}:' || row || ':' || col, 'v': v}}, {{'r': row, 'c': col}}) FILTER ({test}) AS {n}" for n, f, test in (
    ("lt", "title", "contains(v, 'локальный ресурсный сметный расчет') OR contains(v, 'локальный сметный расчет') OR contains(v, 'локальная смета')"), ("ls", "total_label", "contains(v, 'всего по смете') OR contains(v, 'итоги по смете')"), ("lb", "basis_label", "starts_with(v, 'основание')"),
    ("rt", "title", "contains(v, 'ведомость ресурсов') OR contains(v, 'ресурсы подрядчика')"), ("g0", "resource_group", "v = 'трудозатраты'"), ("g1", "resource_group", "v = 'машины и механизмы'"), ("g2", "resource_group", "v = 'материалы'"), ("rs", "total_label", "contains(v, 'всего по смете')")))


@query("do18_template_detect", ctes("cells", more=f"""h AS (SELECT sheet, row, string_agg({VALUE}, ' ' ORDER BY col, value) AS t, string_agg('table_header:' || row || ':' || col, '|' ORDER BY col, value) AS whole, list('table_header:' || row || ':' || col ORDER BY col, value)[:4] AS four FROM cells GROUP BY 1, 2),
 e AS (SELECT sheet, {EVIDENCE} FROM (SELECT sheet, row, col, {VALUE} AS v FROM cells) GROUP BY 1), a AS (SELECT sheet, arg_min(array_to_string(four, '|'), row) AS lh FROM h WHERE contains(t, 'обоснование') AND contains(t, 'наименование') AND contains(t, 'единица') AND contains(t, 'количество') GROUP BY 1),
 b AS (SELECT sheet, arg_min(array_to_string(four, '|'), row) AS rh FROM h WHERE contains(t, 'обоснование') AND contains(t, 'наименование') AND contains(t, 'единица') AND contains(t, 'общее кол') GROUP BY 1),
 k AS (SELECT *, 5 * (lt IS NOT NULL)::INT + 4 * (lh IS NOT NULL)::INT + 3 * (ls IS NOT NULL)::INT + (lb IS NOT NULL)::INT AS l, 5 * (rt IS NOT NULL)::INT + 4 * (rh IS NOT NULL)::INT + (g0 IS NOT NULL)::INT + (g1 IS NOT NULL)::INT + (g2 IS NOT NULL)::INT + 2 * (rs IS NOT NULL)::INT AS r FROM e LEFT JOIN a USING (sheet) LEFT JOIN b USING (sheet))""") + """
 SELECT sheet, CASE WHEN r > l THEN 'resource_statement' ELSE 'local_estimate' END AS template, greatest(r, l) AS score, CASE WHEN greatest(r, l) >= 10 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN greatest(r, l) >= 10 THEN 'high' WHEN greatest(r, l) >= 7 THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN r > l THEN 'resource_statement' WHEN contains(lt.v, 'расчет') THEN 'local_estimate_calculation' ELSE 'local_estimate' END AS kind, CASE WHEN r > l OR contains(lt.v, 'ресурсный') THEN 'resource' ELSE 'unknown' END AS method,
 CASE WHEN r > l THEN concat_ws('|', rt.f, rh, g0.f, g1.f, g2.f, rs.f) ELSE concat_ws('|', lt.f, lh, ls.f, lb.f) END AS evidence FROM k WHERE greatest(r, l) >= 5""")
def template_detect(spark: SparkSession, d: str) -> DataFrame:
    return ce.templates(fixture(spark, d, "cells")).withColumn("evidence", F.array_join("evidence", "|"))


#: Orders as estimates: a header, sections every fourth line, items, totals; numbers of columns stand in a row of some.
ESTIMATE = """
    SELECT sheet, 1 AS row, k AS col, v AS value, CAST(k AS BIGINT) AS pos FROM (SELECT DISTINCT l_orderkey AS sheet FROM {lineitem}) s CROSS JOIN (VALUES (1, '№'), (2, 'Обоснование'), (3, 'Наименование работ'), (6, 'Единица'), (7, 'Количество')) t(k, v)
    UNION ALL SELECT sheet, row * 10 + 2, 1, concat('Раздел ', CAST(row AS STRING), '. Часть ', part), row * 1000 FROM ({lines}) a WHERE row % 4 = 1 AND sheet % 3 <> 0
    UNION ALL SELECT sheet, row * 10 + 3, k, CASE k WHEN 1 THEN CAST(row AS STRING) WHEN 2 THEN concat('ФЕР-', part) WHEN 3 THEN concat(' Работа  ', part) WHEN 4 THEN CASE WHEN part % 3 = 0 THEN 'шт' ELSE 'м2' END WHEN 5 THEN concat(CAST(quantity AS BIGINT), ',5') WHEN 6 THEN 'м3' WHEN 7 THEN CAST(CAST(quantity AS BIGINT) AS STRING) ELSE CAST(part AS STRING) END, row * 1000 + 20 + k FROM ({lines}) b CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (9), (10)) t(k) WHERE row % 5 <> 4 OR k > 1
    UNION ALL SELECT sheet, row * 10 + 5, k, CASE k WHEN 1 THEN CASE part % 4 WHEN 0 THEN 'Накладные расходы' WHEN 1 THEN 'Сметная прибыль' WHEN 2 THEN 'Итого по разделу' ELSE 'Итого по смете' END ELSE concat('-', part, '.25') END, row * 1000 + 40 + k FROM ({lines}) c CROSS JOIN (VALUES (1), (10)) t(k) WHERE row % 4 = 0
    UNION ALL SELECT sheet, row * 10 + 6, 1, CASE part % 3 WHEN 0 THEN 'Трудозатраты' WHEN 1 THEN 'Машины и механизмы' ELSE 'Материалы' END, row * 1000 + 60 FROM ({lines}) e WHERE row % 3 = 0""".replace("{lines}", FIXTURES["line_rows"])
_HEADS = [("row = 1", "1", str(k), f"'{v}'", f"{k}L") for k, v in ((1, "№"), (2, "Обоснование"), (3, "Наименование работ"), (6, "Единица"), (7, "Количество"))]
_TITLES = [("row % 4 = 1 AND sheet % 3 <> 0", "row * 10 + 2", "1", "concat('Раздел ', CAST(row AS STRING), '. Часть ', part)", "row * 1000L")]
_ITEMS = {1: "CAST(row AS STRING)", 2: "concat('ФЕР-', part)", 3: "concat(' Работа  ', part)", 4: "CASE WHEN part % 3 = 0 THEN 'шт' ELSE 'м2' END", 5: "concat(CAST(quantity AS BIGINT), ',5')", 6: "'м3'", 7: "CAST(CAST(quantity AS BIGINT) AS STRING)", 9: "CAST(part AS STRING)", 10: "CAST(part AS STRING)"}
_PLACES = [("row % 5 <> 4" if k == 1 else "row IS NOT NULL", "row * 10 + 3", str(k), v, f"row * 1000L + {20 + k}") for k, v in _ITEMS.items()]
_TOTALS = [("row % 4 = 0", "row * 10 + 5", str(k), v, f"row * 1000L + {40 + k}") for k, v in ((1, "CASE part % 4 WHEN 0 THEN 'Накладные расходы' WHEN 1 THEN 'Сметная прибыль' WHEN 2 THEN 'Итого по разделу' ELSE 'Итого по смете' END"), (10, "concat('-', part, '.25')"))]
_KINDS = [("row % 3 = 0", "row * 10 + 6", "1", "CASE part % 3 WHEN 0 THEN 'Трудозатраты' WHEN 1 THEN 'Машины и механизмы' ELSE 'Материалы' END", "row * 1000L + 60")]
#: The rows of ESTIMATE for Spark: lines move once, by sheet, and become cells where they are.
ESTIMATE_ONCE = f"SELECT * FROM (SELECT sheet, {at_once(*_HEADS, *_TITLES, *_PLACES, *_TOTALS, *_KINDS)} FROM ({LINES_ONCE}) a) b WHERE row IS NOT NULL"
KINDS = "CASE WHEN contains(t, 'накладные расходы') THEN 'overhead' WHEN contains(t, 'сметная прибыль') THEN 'estimated_profit' WHEN contains(t, 'итого') THEN 'total_cost' END"
ROWS = f"""c AS ({ESTIMATE.replace('{lineitem}', 'lineitem')}), v AS (SELECT *, {NUM} AS n, {VALUE} AS s FROM c),
 r AS (SELECT sheet, row, trim(arg_min(value, {{'c': col, 'p': pos}})) AS f, arg_min(s, {{'c': col, 'p': pos}}) AS t, arg_max(n, {{'s': abs(n), 'c': -col}}) FILTER (n IS NOT NULL) AS largest, arg_max(n, {{'c': col, 'p': pos}}) FILTER (n IS NOT NULL) AS last,
   {', '.join(f"arg_max(value, pos) FILTER (col = {k}) AS c{k}" for k in range(1, 15))}, string_agg(s, ' ' ORDER BY col) AS whole, count(*) >= 4 AND bool_and(regexp_matches(trim(value), '^[0-9]+$')) AND count(DISTINCT TRY_CAST(value AS HUGEINT)) >= 4 AS numbers FROM v GROUP BY 1, 2),
 g AS (SELECT sheet, min(row) AS header FROM r WHERE contains(whole, 'обоснование') AND contains(whole, 'наименование') GROUP BY 1), b AS (SELECT r.* FROM r LEFT JOIN g USING (sheet) WHERE row > coalesce(header, 0) AND NOT numbers)"""
CLEAN = r"nullif(trim(regexp_replace({0}, '\s+', ' ', 'g')), '')"


def estimate(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(ESTIMATE_ONCE, lineitem=table(spark, d, "lineitem"))


def number_sql(column: str) -> str:
    return NUM.replace("value", column)


SECTIONS = rf"""{ROWS}, h AS (SELECT *, regexp_matches(f, '(?i)^раздел\s+(\d+)') AS heading FROM b), i AS (SELECT *, NOT heading AND coalesce(regexp_matches(trim(c1), '^[0-9]+$') AND {CLEAN.format('c3')} IS NOT NULL AND {CLEAN.format('c6')} IS NOT NULL, false) AS item FROM h),
 w AS (SELECT *, CAST(sum(heading::INT) OVER o AS BIGINT) AS section, max((item OR heading)::INT) OVER o = 1 AS begun FROM i WINDOW o AS (PARTITION BY sheet ORDER BY row)), k AS (SELECT *, CASE WHEN NOT heading AND begun AND NOT contains(t, 'по смете') THEN {KINDS} END AS total FROM w)"""


@query("do20_estimate_sections", "WITH " + SECTIONS + rf""", s AS (SELECT sheet, section, max(regexp_extract(f, '(?i)^раздел\s+(\d+)', 1)) FILTER (heading) AS section_number, max({CLEAN.format('f')}) FILTER (heading) AS title, count(*) FILTER (item) AS items,
  {', '.join(f"arg_max(largest, row) FILTER (total = '{x}' AND largest IS NOT NULL) AS {x}" for x in ('overhead', 'estimated_profit', 'total_cost'))} FROM k WHERE begun GROUP BY 1, 2)
 SELECT *, CASE WHEN sum(items) OVER (PARTITION BY sheet) = 0 THEN 'local_estimate_items_missing' END AS warning FROM s""")
def estimate_sections(spark: SparkSession, d: str) -> DataFrame:
    return ce.local_estimate(estimate(spark, d))[0]


@query("do20_estimate_items", "WITH " + SECTIONS + rf"""SELECT sheet, section, row, trim(c1) AS position, {CLEAN.format('c2')} AS basis, {CLEAN.format('c3')} AS name, {CLEAN.format('c6')} AS unit, {number_sql('coalesce(c8, c7)')} AS quantity,
  {', '.join(f"{number_sql(f'c{9 + j}')} AS {x}" for j, x in enumerate(('unit_cost', 'total_cost', 'labor_cost', 'machine_cost', 'machinist_labor_cost', 'material_cost')))} FROM k WHERE item""")
def estimate_items(spark: SparkSession, d: str) -> DataFrame:
    return ce.local_estimate(estimate(spark, d))[1]


RESOURCES = rf"""{ROWS}, h AS (SELECT *, t IN ('трудозатраты', 'машины и механизмы', 'материалы') AS heading, starts_with(t, 'итого') AS total FROM b), w AS (SELECT *, CAST(sum(heading::INT) OVER (PARTITION BY sheet ORDER BY row) AS BIGINT) AS "group" FROM h),
 k AS (SELECT *, NOT heading AND NOT total AND coalesce(regexp_matches(trim(c1), '^[0-9]+$') AND {CLEAN.format('c3')} IS NOT NULL AND {CLEAN.format('c4')} IS NOT NULL, false) AS item FROM w WHERE "group" > 0)"""


@query("do21_resource_groups", "WITH " + RESOURCES + rf""", s AS (SELECT sheet, "group", max({CLEAN.format('f')}) FILTER (heading) AS title, count(*) FILTER (item) AS resources, arg_max(last, row) FILTER (total AND last IS NOT NULL) AS total_cost FROM k GROUP BY 1, 2)
 SELECT *, CASE WHEN sum(resources) OVER (PARTITION BY sheet) = 0 THEN 'resource_statement_rows_missing' END AS warning FROM s""")
def resource_groups(spark: SparkSession, d: str) -> DataFrame:
    return ce.resource_statement(estimate(spark, d))[0]


@query("do21_resource_rows", "WITH " + RESOURCES + rf"""SELECT sheet, "group", row, trim(c1) AS position, {CLEAN.format('c2')} AS code, {CLEAN.format('c3')} AS name, {CLEAN.format('c4')} AS unit, {number_sql('c5')} AS quantity, {number_sql('c6')} AS unit_cost, {number_sql('c7')} AS total_cost FROM k WHERE item""")
def resource_rows(spark: SparkSession, d: str) -> DataFrame:
    return ce.resource_statement(estimate(spark, d))[1]


FILL = "f AS (SELECT sheet, row, price, last_value(CASE WHEN line % 3 = 1 THEN concat('Раздел ', line) END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row) AS section FROM line_rows)"


@query("w2_section_fill", ctes("line_rows", more=FILL) + "SELECT sheet, row, section FROM f WHERE section IS NOT NULL")
def section_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "line_rows")
    return ce.fill_sections(rows, F.when(F.col("line") % 3 == 1, F.concat(F.lit("Раздел "), F.col("line")))).where("section is not null").select("sheet", "row", "section")


@query("do21_section_totals", ctes("line_rows", more=FILL) + "SELECT sheet, section, count(*) AS items, round(sum(price), 2) AS price FROM f GROUP BY 1, 2")
def section_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = ce.fill_sections(fixture(spark, d, "line_rows"), F.when(F.col("line") % 3 == 1, F.concat(F.lit("Раздел "), F.col("line"))))
    return ce.section_totals(rows)


@query("do20_row_items", ctes("cells", more=f"l AS (SELECT sheet, row, col, max_by(value, pos) AS value FROM cells GROUP BY 1, 2, 3), n AS (SELECT *, {NUM} AS v FROM l)") + "SELECT sheet, row, max(v) FILTER (col = 1) AS line, max(value) FILTER (col = 2) AS part, max(v) FILTER (col = 4) AS quantity, max(v) FILTER (col = 5) AS price FROM n GROUP BY 1, 2 HAVING count(*) FILTER (col = 1) > 0 AND count(*) FILTER (col = 2) > 0")
def row_items(spark: SparkSession, d: str) -> DataFrame:
    return ce.row_items(fixture(spark, d, "cells"))


@query("w5_value_above", ctes("cells", more=f"a AS (SELECT sheet, min((row, col)) AS p FROM cells WHERE contains({VALUE}, 'ведомость') GROUP BY 1), n AS (SELECT c.*, {VALUE} AS t FROM cells c JOIN a USING (sheet) WHERE row < p[1] AND row >= p[1] - 4)".replace("p[1]", "(a.p).row").replace("min((row, col))", "min({'row': row, 'col': col})")) + "SELECT sheet, max_by(value, {'a': row, 'b': length(value), 'c': -col}) AS value FROM n WHERE NOT contains(t, 'ведомость') AND t <> '' AND NOT starts_with(t, '(') GROUP BY 1")
def value_above(spark: SparkSession, d: str) -> DataFrame:
    return ce.value_above(fixture(spark, d, "cells"), "ведомость")


@query("m6_labeled_number", ctes("cells", more=f"a AS (SELECT sheet, min(row) AS row FROM cells WHERE contains({VALUE}, 'всего по смете') GROUP BY 1), n AS (SELECT sheet, col, {NUM} AS v FROM cells JOIN a USING (sheet, row))") + "SELECT sheet, max_by(v, {'a': abs(v), 'b': -col}) AS number FROM n WHERE v IS NOT NULL GROUP BY 1")
def labeled_number(spark: SparkSession, d: str) -> DataFrame:
    return ce.labeled_number(fixture(spark, d, "cells"), "всего по смете")


@query("do24_grid_rows", ctes("cells") + "SELECT sheet, row, string_agg(value, '|' ORDER BY col, value) AS cells, count(*) AS n FROM cells WHERE value <> '' AND row > 0 AND col > 0 GROUP BY 1, 2")
def grid_rows(spark: SparkSession, d: str) -> DataFrame:
    return ce.grid(fixture(spark, d, "cells"))


SPARSE = "SELECT l_orderkey % 400 AS sheet, CAST(l_linenumber AS INT) AS row, CAST(l_partkey % 6 AS INT) + 1 AS col, min(l_returnflag) AS value FROM {lineitem} GROUP BY 1, 2, 3"


@query("p1_grid_densify", "WITH c AS (" + SPARSE.format(lineitem="lineitem") + "), s AS (SELECT sheet, max(row) AS rows, max(col) AS cols FROM c GROUP BY 1), p AS (SELECT sheet, unnest(range(1, rows + 1))::INT AS row, cols FROM s), q AS (SELECT sheet, row, unnest(range(1, cols + 1))::INT AS col FROM p) SELECT q.*, coalesce(value, '') AS value FROM q LEFT JOIN c USING (sheet, row, col)")
def grid_densify(spark: SparkSession, d: str) -> DataFrame:
    return ce.densify(spark.sql(SPARSE, lineitem=table(spark, d, "lineitem")))


@query("st22_a1_decode", "SELECT p_partkey AS id, CAST(1 + p_partkey % 9000 AS INT) AS row, CAST(1 + p_partkey % 700 AS INT) AS col FROM part")
def a1_decode(spark: SparkSession, d: str) -> DataFrame:
    row, col = 1 + F.col("p_partkey") % 9000, 1 + F.col("p_partkey") % 700
    out = table(spark, d, "part").select("p_partkey", tx.to_a1(row, col).alias("a")).withColumn("p", tx.a1(F.col("a")))
    return out.select(F.col("p_partkey").alias("id"), "p.row", "p.col")


# -- scalars ----------------------------------------------------------------------------------------


@query("st6_display_text")
def display_text_whole(spark: SparkSession, d: str) -> DataFrame:
    """All of every text; no SQL, as the two engines' white space and characters differ; tests compare with a plain version."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(tx.display_text(F.col("text"))).alias("h"))


STOP = r"'([0-9])\.([0-9])', '\1;\2', 'g')"


# 1.2.3 takes two passes: a digit ends one match and cannot begin the next
@query("st9_sentences", f"SELECT doc_id AS id, len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, {STOP}, {STOP}, '.'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')) AS n FROM documents")
def sentences_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every document, also with 1.2.3 in its text."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("text").isNotNull(), F.size(tx.sentences(F.col("text")))).cast("long").alias("n"))


@query("m1_numbers", f"SELECT id, {NUM.replace('value', 'payload')} AS n FROM (SELECT event_id AS id, props AS payload FROM events)")
def numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), tx.number(F.col("props")).alias("n"))


@query("st24_digests", "SELECT p_partkey AS id, sha256(p_name) AS a, left(sha1(concat_ws('|', p_partkey, p_brand)), 8) AS b, md5(p_type) AS c FROM part")
def digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.sha2("p_name", 256).alias("a"), F.left(F.sha1(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_brand")), F.lit(8)).alias("b"), F.md5("p_type").alias("c"))


@query("d4_iso_times", "SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(datepart('millisecond', ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS at, strftime(ts + INTERVAL 1500 MILLISECOND, '%Y-%m-%d %H:%M:%S') AS next_at FROM events")
def iso_times(spark: SparkSession, d: str) -> DataFrame:
    later = F.col("ts") + F.make_dt_interval(secs=F.lit(1.5))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), tx.iso(F.col("ts")).alias("at"), F.date_format(later, "yyyy-MM-dd HH:mm:ss").alias("next_at"))


@query("js2_json_scalars", """SELECT event_id AS id, coalesce(CAST(props->>'k' AS BIGINT), 0) AS k, json_object('id', event_id, 'type', event_type)::VARCHAR AS doc FROM events""")
def json_scalars(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.coalesce(v, F.lit(0)).alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"))


RAW = "SELECT p_partkey AS id, concat(substr('АBМ2 Cтaль C 345 12345- ОO1', CAST(p_partkey % 20 AS INT) + 1, 9), ' ', p_size, 'м2 ', p_brand) AS text, p_size / 50.0 AS confidence, CASE p_partkey % 4 WHEN 0 THEN 'table_cell' WHEN 1 THEN 'designation' WHEN 2 THEN 'ordinal' ELSE 'text' END AS kind FROM {part}"


@query("st11_ocr_text_normalize", None)
def ocr_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return spark.sql(RAW, part=table(spark, d, "part")).select("id", tx.by_kind(F.col("kind"), t).alias("text"), F.round(tx.noise(t), 4).alias("noise"), tx.suspicious(t, F.col("confidence").cast("double")).alias("suspicious"))


# -- filters, sets, joins, ordered aggregates on the fixtures ------------------------------------------


@query("f3_not_in_null", ctes("jobs") + "SELECT id FROM jobs WHERE status NOT IN ('completed', 'cancelled') AND next_run_at IS NULL")
def not_in(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "jobs").where(~F.col("status").isin("completed", "cancelled") & F.col("next_run_at").isNull()).select("id")


@query("f14_facet_filter", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    chosen = {"o_orderstatus": "O", "o_orderpriority": None}
    rows = table(spark, d, "orders")
    for column, value in chosen.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("f15_payload_validation", "SELECT TRY_CAST(props->>'k' AS BIGINT) IS NOT NULL AND TRY_CAST(props->>'k' AS BIGINT) > 0 AS valid, count(*) AS n FROM events GROUP BY 1")
def payload_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k BIGINT")["k"]  # 0 counts as absent
    return table(spark, d, "events").groupBy(F.coalesce(k > 0, F.lit(False)).alias("valid")).agg(F.count("*").alias("n"))


@query("j1_inner_composite", "SELECT count(*) AS n, round(sum(l_quantity * o_totalprice), 0) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate")
def inner_composite(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate"))).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("o_totalprice")), 0).alias("v"))


@query("j10_id_order", "SELECT pos, c_custkey AS id, c_name AS name FROM (SELECT unnest([9, 3, 7, 3, 100000000]) AS id, generate_subscripts([9, 3, 7, 3, 100000000], 1) - 1 AS pos) JOIN customer ON c_custkey = id")
def id_order(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.range(1).select(F.posexplode(F.array(*map(F.lit, [9, 3, 7, 3, 100000000]))).alias("pos", "id"))
    return table(spark, d, "customer").join(asked, F.col("c_custkey") == F.col("id")).select("pos", "id", F.col("c_name").alias("name"))


@query("u1_set_operations", "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1 UNION ALL SELECT -n_nationkey - 1, count(*) FROM nation GROUP BY 1")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    keys = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    rest = keys("F").subtract(keys("P")).groupBy("k").agg(F.count("*").alias("n"))
    return rest.unionByName(table(spark, d, "nation").groupBy((-F.col("n_nationkey") - 1).cast("long").alias("k")).agg(F.count("*").alias("n")))


T3_SQL = "SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC NULLS LAST, o_orderkey) AS BIGINT) AS n FROM orders ORDER BY n LIMIT 200"


@query("t3_enum_order", T3_SQL.removesuffix(" ORDER BY n LIMIT 200"))
def enum_order_whole(spark: SparkSession, d: str) -> DataFrame:
    """T3 over all orders: numbers within a status and a range of prices, after the rows of all ranges before it."""
    from pyspark.sql import Window

    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    price = F.col("o_totalprice").cast("double")
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", rank.alias("r"), price.alias("p"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(orders.approxQuantile("p", [i / n for i in range(1, n)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("p"))) if cuts else F.lit(0)
    orders = orders.withColumn("part", F.when(F.col("p").isNull(), len(cuts) + 1).otherwise(part))
    before, starts = 0, []
    for r, k, c in sorted(orders.groupBy("r", "part").count().collect()):  # one row for each status and range
        starts.append((r, k, before))
        before += c
    starts = spark.createDataFrame(starts, "r int, part int, start long")
    at = F.row_number().over(Window.partitionBy("r", "part").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey"))
    return orders.join(F.broadcast(starts), ["r", "part"]).select(F.col("o_orderkey").alias("id"), (F.col("start") + at).alias("n"))


@query("t7_page", "SELECT o_orderkey AS id FROM orders WHERE o_custkey = 77 ORDER BY o_orderdate DESC, o_orderkey LIMIT 5 OFFSET 5")
def page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_custkey = 77").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(5).limit(5).select(F.col("o_orderkey").alias("id"))


@query("t8_preview", "SELECT doc_id AS id, left(text, 200) AS preview, length(text) > 200 AS cut FROM documents")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.left("text", F.lit(200)).alias("preview"), (F.length("text") > 200).alias("cut"))


@query("w1_row_numbers", ctes("line_rows") + "SELECT sheet, row, part FROM line_rows")
def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet"), row.alias("row"), F.col("l_partkey").alias("part"))


@query("a8_ordered_aggregates", "SELECT user_id, string_agg(event_type, '|' ORDER BY pos) AS types, max(last) AS last FROM (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY 1, 2) JOIN (SELECT user_id, max_by(event_type, event_id) AS last FROM events GROUP BY 1) USING (user_id) GROUP BY 1")
def ordered_aggregates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"), F.max("event_id").alias("end"))
    out = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("x"), F.max_by("event_type", "end").alias("last"))
    return out.select("user_id", F.array_join(F.transform("x", lambda v: v["event_type"]), "|").alias("types"), "last")


@query("a22_collected_ids", ctes("versions") + "SELECT set_id, string_agg(id, '|' ORDER BY id) AS ids, max(created_at) = min(created_at) AS single FROM versions GROUP BY 1")
def collected(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "versions").groupBy("set_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), "|").alias("ids"), (F.max("created_at") == F.min("created_at")).alias("single"))


@query("a9_first_per_group", ctes("log") + "SELECT aggregate_id, type, min_by(id, (published_at, id)) AS id FROM log GROUP BY 1, 2")
def first_per_group(spark: SparkSession, d: str) -> DataFrame:
    return fa.first_of_group(fixture(spark, d, "log"), ["aggregate_id", "type"], ["published_at", "id"]).select("aggregate_id", "type", "id")

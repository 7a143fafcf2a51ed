"""Queries over hierarchy, jobs, events and facts, and the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import events as ev
from tessera.operators import facts as fa
from tessera.operators import jobs as jb
from tessera.operators import tree as tr
from tessera.plans.fixtures import ctes, fixture, table

NOW = "2000-01-01 00:00:00"
Q: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp_ntz")


CLOSURE = "c AS (SELECT id AS ancestor, id, 0 AS depth FROM nodes UNION ALL SELECT c.ancestor, n.id, depth + 1 FROM c JOIN nodes n ON n.parent_id = c.id)"


@query("g2_tree_rollup", ctes("nodes", "placements", more=CLOSURE, recursive=True) + "SELECT c.ancestor AS id, count(DISTINCT p.version_id) AS documents FROM c LEFT JOIN placements p ON p.node_id = c.id AND p.status IN ('placed', 'ambiguous') GROUP BY 1")
def tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    return tr.rollup(fixture(spark, d, "nodes"), fixture(spark, d, "placements"))


@query("g1_tree_descendants", ctes("nodes", more=CLOSURE, recursive=True) + "SELECT id, depth FROM c WHERE ancestor = 'R2'")
def tree_descendants(spark: SparkSession, d: str) -> DataFrame:
    return tr.descendants(fixture(spark, d, "nodes"), "R2")


@query("g3_tree_fallback", ctes("placements", "versions") + "SELECT * FROM (SELECT 'unplaced' AS group_name, count(DISTINCT version_id) AS n FROM placements WHERE status = 'unplaced' UNION ALL SELECT 'unsupported', count(DISTINCT id) FROM versions WHERE status = 'unsupported') WHERE n > 0")
def tree_fallback(spark: SparkSession, d: str) -> DataFrame:
    return tr.fallback_groups(fixture(spark, d, "placements"), fixture(spark, d, "versions"))


PATHS = "p AS (SELECT id, 0 AS depth, code AS path_code, title AS path_titles FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.id, depth + 1, path_code || '.' || n.code, path_titles || '|' || n.title FROM p JOIN nodes n ON n.parent_id = p.id)"


@query("g4_tree_paths", ctes("nodes", more=PATHS, recursive=True) + "SELECT * FROM p")
def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    return tr.paths(fixture(spark, d, "nodes"))


@query("g4_tree_search", ctes("nodes", more=PATHS + ", " + CLOSURE, recursive=True) + "SELECT DISTINCT c.ancestor AS id FROM c WHERE c.id IN (SELECT p.id FROM p JOIN nodes USING (id) WHERE contains(lower(title), '3.1') OR contains(lower(path_code), '3.1'))")
def tree_search(spark: SparkSession, d: str) -> DataFrame:
    return tr.search(fixture(spark, d, "nodes"), "3.1")


@query("a1_job_counts", ctes("jobs") + "SELECT processor_id, job_type, status, count(*) AS n FROM jobs GROUP BY ALL")
def job_counts(spark: SparkSession, d: str) -> DataFrame:
    return jb.counts(fixture(spark, d, "jobs"))


@query("a2_job_ages", ctes("jobs") + f"SELECT processor_id, status, CAST(max(epoch(TIMESTAMP '{NOW}' - created_at) - CASE WHEN status = 'running' THEN wait_s ELSE 0 END) AS DOUBLE) AS oldest_s FROM jobs WHERE status IN ('queued', 'running') GROUP BY ALL")
def job_ages(spark: SparkSession, d: str) -> DataFrame:
    return jb.ages(fixture(spark, d, "jobs"), now())


@query("a7_job_durations", ctes("jobs") + "SELECT processor_id, CAST(sum(wait_s) AS BIGINT) AS wait_s, CAST(sum(duration_s) AS BIGINT) AS duration_s, count(*) AS n FROM jobs WHERE status IN ('completed', 'failed') GROUP BY 1")
def job_durations(spark: SparkSession, d: str) -> DataFrame:
    return jb.durations(fixture(spark, d, "jobs"))


_BOUNDS = ", ".join(f"({b}, '{b}')" for b in jb.BUCKETS)


@query("a6_job_histogram", ctes("jobs") + f"SELECT processor_id, le, CAST(sum(CASE WHEN duration_s <= b THEN 1 ELSE 0 END) AS BIGINT) AS n FROM jobs, (VALUES {_BOUNDS}, (1e308, '+Inf')) x(b, le) GROUP BY ALL")
def job_histogram(spark: SparkSession, d: str) -> DataFrame:
    return jb.histogram(fixture(spark, d, "jobs"))


@query("a20_job_p95", ctes("jobs") + "SELECT processor_id, round(quantile_cont(duration_s, 0.95), 6) AS q FROM jobs GROUP BY 1")
def job_p95(spark: SparkSession, d: str) -> DataFrame:
    return jb.quantile(fixture(spark, d, "jobs"), 0.95)


@query("a20_histogram_quantile", ctes("jobs", more=f"""
  h AS (SELECT processor_id, b, sum(CASE WHEN duration_s <= b THEN 1 ELSE 0 END) AS n FROM jobs, (VALUES {_BOUNDS}, (1e308, '+Inf')) x(b, le) GROUP BY ALL),
  g AS (SELECT *, 0.5 * max(n) OVER (PARTITION BY processor_id) AS r, lag(n, 1, 0) OVER o AS below, lag(b, 1, 0) OVER o AS low FROM h WINDOW o AS (PARTITION BY processor_id ORDER BY b))""") + "SELECT processor_id, round(CASE WHEN b > 1e300 THEN low ELSE low + (b - low) * (r - below) / (n - below) END, 6) AS q FROM g WHERE n >= r AND below < r")
def histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    return jb.histogram_quantile(jb.histogram(fixture(spark, d, "jobs")), 0.5)


@query("a4_org_progress", ctes("versions", "jobs") + """SELECT *, CASE WHEN versions + jobs > 0 THEN CAST(floor(100.0 * (versions_done + completed + failed) / (versions + jobs) + 0.5) AS BIGINT) ELSE 0 END AS percent FROM
 (SELECT count(*) AS versions, count(*) FILTER (status IN ('ready', 'failed', 'unsupported')) AS versions_done FROM versions),
 (SELECT count(*) AS jobs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('pending', 'queued', 'running')) AS open FROM jobs),
 (SELECT strftime(greatest((SELECT max(created_at) FROM versions), (SELECT max(created_at) FROM jobs)), '%Y-%m-%d %H:%M:%S') AS updated_at)""")
def org_progress(spark: SparkSession, d: str) -> DataFrame:
    return jb.progress(fixture(spark, d, "versions"), fixture(spark, d, "jobs"))


UNMET = "u AS (SELECT d.job_id, d.depends_on, d.condition FROM dependencies d LEFT JOIN jobs j ON j.id = d.depends_on WHERE NOT coalesce(j.status = 'completed' OR (d.condition = 'completed_or_skipped' AND j.status = 'cancelled'), false))"


@query("j5_unmet_dependencies", ctes("jobs", "dependencies", more=UNMET) + "SELECT * FROM u")
def unmet(spark: SparkSession, d: str) -> DataFrame:
    return jb.unmet(fixture(spark, d, "dependencies"), fixture(spark, d, "jobs"))


@query("t2_claim_next", ctes("jobs", "dependencies", more=UNMET) + f"SELECT processor_id, id FROM (SELECT *, row_number() OVER (PARTITION BY processor_id ORDER BY created_at NULLS LAST, id) r FROM jobs WHERE status = 'queued' AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '{NOW}') AND NOT EXISTS (SELECT 1 FROM u WHERE u.job_id = jobs.id)) WHERE r = 1")
def claim_next(spark: SparkSession, d: str) -> DataFrame:
    return jb.claim(fixture(spark, d, "jobs"), fixture(spark, d, "dependencies"), now())


@query("dm5_retry_transition", ctes("jobs") + f"SELECT id, attempts + 1 AS attempts, CASE WHEN attempts + 1 < max_attempts THEN 'queued' ELSE 'failed' END AS status, CASE WHEN attempts + 1 < max_attempts THEN strftime(TIMESTAMP '{NOW}' + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') END AS next_run_at FROM jobs WHERE status = 'failed'")
def retry(spark: SparkSession, d: str) -> DataFrame:
    return jb.retry(fixture(spark, d, "jobs"), now(), 90_000)


COMMANDS = "SELECT o_orderkey + 50 AS id, CASE o_orderkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' ELSE 'cancel' END AS command FROM {orders}"


@query("dm4_guarded_updates", ctes("jobs", more="m AS (" + COMMANDS.format(orders="orders") + ")") + """SELECT m.id, command, coalesce(command IN ('complete', 'fail') AND status = 'running' OR command = 'cancel' AND status NOT IN ('completed', 'cancelled'), false) AS allowed,
 CASE WHEN command = 'complete' AND status = 'running' THEN 'completed' WHEN command = 'fail' AND status = 'running' THEN 'failed' WHEN command = 'cancel' AND status NOT IN ('completed', 'cancelled') THEN 'cancelled' ELSE status END AS status FROM m LEFT JOIN jobs j ON j.id = m.id""")
def guarded(spark: SparkSession, d: str) -> DataFrame:
    return jb.transition(fixture(spark, d, "jobs"), spark.sql(COMMANDS, orders=table(spark, d, "orders")))


@query("j4_pending_events", ctes("log", "checkpoints") + "SELECT id, type, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM log WHERE NOT EXISTS (SELECT 1 FROM checkpoints c WHERE c.event_id = log.id AND consumer = 'c1') ORDER BY log.published_at NULLS LAST, id LIMIT 100")
def pending(spark: SparkSession, d: str) -> DataFrame:
    p = ev.pending(fixture(spark, d, "log"), fixture(spark, d, "checkpoints"), "c1")
    return p.select("id", "type", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


ROUTES = "VALUES ('c-click', 'click', 'probe', 'p1'), ('c-click-2', 'click', 'extract', 'x1'), ('c-view', 'view', 'probe', 'p2'), ('c-buy', 'purchase', 'sum', 's1')"


@query("e4_event_routes", ctes("log") + f"SELECT id AS event_id, consumer, processor_id, job_type, id AS causation_id FROM log JOIN ({ROUTES}) r(consumer, type, processor_id, job_type) USING (type)")
def routes(spark: SparkSession, d: str) -> DataFrame:
    return ev.route(fixture(spark, d, "log"), spark.sql(f"SELECT * FROM ({ROUTES}) AS r(consumer, type, processor_id, job_type)"))


@query("dm1_upsert_latest", ctes("log") + "SELECT aggregate_id, type, id, round(value, 4) AS value, strftime(created, '%Y-%m-%d %H:%M:%S') AS created FROM (SELECT *, min(published_at) OVER (PARTITION BY aggregate_id, type) AS created, row_number() OVER (PARTITION BY aggregate_id, type ORDER BY published_at DESC, id DESC) r FROM log) WHERE r = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    out = ev.upsert_latest(fixture(spark, d, "log"), ["aggregate_id", "type"], ["published_at", "id"], "published_at")
    return out.select("aggregate_id", "type", "id", F.round("value", 4).alias("value"), F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("dm2_insert_once", ctes("log") + "SELECT aggregate_id, type, min(id) AS id FROM log l WHERE NOT EXISTS (SELECT 1 FROM log e WHERE e.id % 3 = 0 AND e.aggregate_id = l.aggregate_id AND e.type = l.type) GROUP BY 1, 2")
def insert_once(spark: SparkSession, d: str) -> DataFrame:
    log = fixture(spark, d, "log")
    return ev.insert_once(log.where("id % 3 = 0"), log.where("id % 3 <> 0"), ["aggregate_id", "type"], ["id"]).select("aggregate_id", "type", "id")


@query("dm3_enqueue_once", ctes("jobs") + "SELECT processor_id, job_type, causation_id, min(id) AS id FROM jobs GROUP BY 1, 2, 3")
def enqueue_once(spark: SparkSession, d: str) -> DataFrame:
    jobs = fixture(spark, d, "jobs")
    return ev.insert_once(jobs.limit(0), jobs, ["processor_id", "job_type", "causation_id"], ["id"]).select("processor_id", "job_type", "causation_id", "id")


DELIVERED = "SELECT CASE WHEN event_id % 2 = 0 THEN 'c1' ELSE 'c2' END AS consumer, event_id % 4000 AS event_id, event_id AS seen FROM {events}"


@query("e3_replay_dedupe", ctes("checkpoints", more="x AS (" + DELIVERED.format(events="events") + ")") + "SELECT consumer, event_id, min(seen) AS seen FROM x WHERE NOT EXISTS (SELECT 1 FROM checkpoints c WHERE c.consumer = x.consumer AND c.event_id = x.event_id) GROUP BY 1, 2")
def replay(spark: SparkSession, d: str) -> DataFrame:
    return ev.effects(spark.sql(DELIVERED, events=table(spark, d, "events")), fixture(spark, d, "checkpoints"))


CAUSES = "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN CAST(NULL AS BIGINT) ELSE event_id - 1 END AS caused_by FROM {events}"


@query("e8_causation_chain", "WITH RECURSIVE e AS (" + CAUSES.format(events="events") + "), c AS (SELECT id AS root, id, 0 AS depth FROM e WHERE caused_by IS NULL UNION ALL SELECT c.root, e.id, depth + 1 FROM c JOIN e ON e.caused_by = c.id WHERE depth < 6) SELECT * FROM c")
def causes(spark: SparkSession, d: str) -> DataFrame:
    return ev.causation(spark.sql(CAUSES, events=table(spark, d, "events")), 6)


@query("f4_json_path", ctes("log") + "SELECT id, CAST(payload->>'k' AS BIGINT) AS k FROM log WHERE payload->>'k' = '7'")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("payload", "$.k")
    return fixture(spark, d, "log").where(k == "7").select("id", k.cast("long").alias("k"))


@query("f5_event_or_payload", ctes("log") + "SELECT id FROM log WHERE id % 10 < 8 AND ((type = 'click' AND aggregate_id = 5) OR payload->>'k' = '5')")
def event_or_payload(spark: SparkSession, d: str) -> DataFrame:
    own = (F.col("type") == "click") & (F.col("aggregate_id") == 5)
    return fixture(spark, d, "log").where((F.col("id") % 10 < 8) & (own | (F.get_json_object("payload", "$.k") == "5"))).select("id")


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Placements by the ids of versions, which the fixture writes as text."""
    return fixture(spark, d, "placements").withColumn("version_id", F.substring("version_id", 2, 20).cast("long"))


def version_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of versions: the fixture's first 97 documents lend theirs to every 97th."""
    of = fixture(spark, d, "versions").select(F.col("id").alias("v"), (F.col("id") % 97).alias("version_id"))
    return fixture(spark, d, "codes").groupBy("version_id").agg(F.min_by("raw", "id").alias("raw"), F.min("id").alias("id")).join(of, "version_id").select("id", F.col("v").alias("version_id"), "raw")


@query("do26_fallback_documents", ctes("placements", "versions", "codes", more="x AS (SELECT version_id, min_by(raw, id) AS raw FROM codes GROUP BY 1)") + """SELECT v.id AS version_id, v.status, coalesce(x.raw, '') AS code FROM versions v LEFT JOIN x ON x.version_id = v.id % 97
 WHERE NOT EXISTS (SELECT 1 FROM placements p WHERE p.version_id = concat('V', v.id) AND p.status <> 'unplaced')""")
def fallback_documents(spark: SparkSession, d: str) -> DataFrame:
    at = placed(spark, d).withColumn("node_id", F.when(F.col("status") != "unplaced", F.col("node_id")))
    return fa.fallback_documents(at, fixture(spark, d, "versions"), version_codes(spark, d))


@query("j2_node_documents", ctes("nodes", "placements", "versions", "codes", more="x AS (SELECT version_id, min_by(raw, id) AS raw FROM codes GROUP BY 1)") + """SELECT n.id AS node_id, v.id AS version_id, v.status, p.status AS placement, coalesce(x.raw, '') AS code FROM nodes n JOIN placements p ON p.node_id = n.id JOIN versions v ON concat('V', v.id) = p.version_id
 LEFT JOIN x ON x.version_id = v.id % 97 WHERE n.kind = 'mark'""")
def node_documents(spark: SparkSession, d: str) -> DataFrame:
    return fa.node_documents(fixture(spark, d, "nodes"), placed(spark, d), fixture(spark, d, "versions"), version_codes(spark, d))


@query("a13_baseline_summary", ctes("versions", "placements", more="""w AS (SELECT v.set_id, v.id, v.status, CASE WHEN v.status = 'unsupported' THEN 'unsupported_file_format' WHEN v.status = 'failed' THEN 'document_version_processing_failed'
  WHEN p.id IS NULL OR p.status = 'unplaced' THEN 'document_identity_unplaced' WHEN p.status = 'ambiguous' THEN 'project_structure_placement_ambiguous' END AS warning FROM versions v LEFT JOIN placements p ON p.version_id = concat('V', v.id))""") + """
 SELECT set_id, count(*) AS versions, count(warning) AS warnings, CASE WHEN count(*) FILTER (status IN ('ready', 'failed', 'unsupported')) < count(*) THEN 'processing' WHEN count(warning) > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status,
 coalesce(string_agg(DISTINCT warning, '|' ORDER BY warning), '') AS codes FROM w GROUP BY 1""")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return fa.summary(fixture(spark, d, "versions"), placed(spark, d))


@query("j7_document_set_list", ctes("versions", more="s AS (SELECT set_id, count(*) AS files, max(created_at) AS at FROM versions GROUP BY 1)") + """SELECT s.set_id, files, coalesce(r.status, 'not_started') AS status, coalesce(r.warnings, 0) AS warnings FROM s LEFT JOIN (SELECT set_id, 'processing' AS status, count(*) FILTER (status = 'failed') AS warnings FROM versions WHERE set_id % 3 = 0 GROUP BY 1) r USING (set_id)
 ORDER BY s.at DESC NULLS LAST, s.set_id LIMIT 50""")
def set_list(spark: SparkSession, d: str) -> DataFrame:
    versions = fixture(spark, d, "versions")
    sets = versions.groupBy("set_id").agg(F.count("*").alias("files"), F.max("created_at").alias("at"))
    results = versions.where("set_id % 3 = 0").groupBy("set_id").agg(F.lit("processing").alias("status"), F.count_if(F.col("status") == "failed").alias("warnings"))
    return fa.newest_sets(sets, results, 50)


@query("do27_diagnostics", ctes("jobs", "log", "versions") + """SELECT * FROM (SELECT 'job' AS kind, id, status AS state FROM jobs WHERE set_id = 7 ORDER BY created_at DESC, id DESC LIMIT 100) UNION ALL SELECT * FROM (SELECT 'event', id, type FROM log WHERE aggregate_id = 7 ORDER BY published_at DESC, id DESC LIMIT 100)
 UNION ALL SELECT 'version', id, status FROM versions WHERE set_id = 7""")
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return fa.diagnostics(fixture(spark, d, "versions"), fixture(spark, d, "jobs"), fixture(spark, d, "log"), 7)


MEMBERS = "SELECT c_custkey AS user_id, c_nationkey AS role_id, CASE WHEN c_custkey % 7 = 0 THEN 'suspended' ELSE 'active' END AS status FROM {customer}"
ROLES = "SELECT n_nationkey AS role_id, CASE WHEN n_nationkey % 2 = 0 THEN array('document.view', 'document.upload') ELSE array('document.view', 'processing_progress.view') END AS permission_keys FROM {nation} WHERE n_nationkey % 5 <> 0"


@query("j9_session_permissions", "WITH m AS (" + MEMBERS.format(customer="customer") + "), r AS (" + ROLES.format(nation="nation").replace("array(", "list_value(") + ") SELECT user_id, string_agg(DISTINCT k, '|' ORDER BY k) AS permissions FROM (SELECT user_id, unnest(permission_keys) AS k FROM m JOIN r USING (role_id) WHERE status = 'active') GROUP BY 1")
def permissions(spark: SparkSession, d: str) -> DataFrame:
    return fa.permissions(spark.sql(MEMBERS, customer=table(spark, d, "customer")), spark.sql(ROLES, nation=table(spark, d, "nation")))


@query("dm10_membership_check", "WITH m AS (SELECT c_custkey AS member, unnest(list_value(c_nationkey, c_nationkey + 3)) AS role_id FROM customer) SELECT member, count(*) = count(n_nationkey) FILTER (n_regionkey < 4) AS valid FROM m LEFT JOIN nation ON n_nationkey = role_id GROUP BY 1")
def membership(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("member"), F.explode(F.array("c_nationkey", F.col("c_nationkey") + 3)).alias("role_id"))
    roles = table(spark, d, "nation").select(F.col("n_nationkey").alias("role_id"), (F.col("n_regionkey") < 4).alias("in_scope"))
    return fa.valid_members(asked, roles)


@query("dm8_current_version", ctes("versions") + "SELECT document_id, max_by(id, (created_at, id)) AS version_id FROM versions WHERE status = 'ready' GROUP BY 1")
def current_version(spark: SparkSession, d: str) -> DataFrame:
    return fa.current_versions(fixture(spark, d, "versions").where("status = 'ready'"))


@query("do29_registration_fanout", ctes("files") + """SELECT id AS file_id, substr(md5(concat('document:', set_id, ':', id)), 1, 12) AS document_id, substr(md5(concat('version:', set_id, ':', id)), 1, 12) AS version_id, e AS event_type FROM files, (VALUES ('document.registered'), ('document_version.created')) x(e) WHERE purpose = 'original_upload' AND size_bytes > 0""")
def registration(spark: SparkSession, d: str) -> DataFrame:
    return fa.register(fixture(spark, d, "files").where("purpose = 'original_upload' AND size_bytes > 0"))

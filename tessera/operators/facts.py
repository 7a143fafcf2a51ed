"""Facts and read models: summaries, listings, permissions, registration (A9, A13, J1, J2, J6, J7, J9, T1, DM7, DM8, DM10, DO17, DO25-DO27, DO29, DO31)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tenancy import keyed


def node_documents(nodes: DataFrame, placements: DataFrame, versions: DataFrame, codes: DataFrame) -> DataFrame:
    """J2/J6/A9/DO26: documents placed on mark nodes, with the first code of their version if there is one.

    nodes (id, kind), placements (node_id, version_id, status), versions (id, status), codes (id, version_id, raw).
    """
    at = nodes.where("kind = 'mark'").select(*keyed(nodes), F.col("id").alias("node_id"))
    placed = placements.select(*keyed(nodes, "node_id", "version_id"), F.col("status").alias("placement"))
    known = versions.select(*keyed(nodes), F.col("id").alias("version_id"), "status")
    first = codes.groupBy(*keyed(nodes, "version_id")).agg(F.min_by("raw", "id").alias("raw"))
    out = at.join(placed, keyed(nodes, "node_id")).join(known, keyed(nodes, "version_id")).join(first, keyed(nodes, "version_id"), "left")
    return out.select(*keyed(nodes, "node_id", "version_id"), "status", "placement", F.coalesce("raw", F.lit("")).alias("code"))


def fallback_documents(placements: DataFrame, versions: DataFrame, codes: DataFrame) -> DataFrame:
    """DO26: documents without a place in the tree: no placement, or one without a node; with their first code."""
    placed = placements.where("node_id is not null").select(*keyed(versions, "version_id")).distinct()
    known = versions.select(*keyed(versions), F.col("id").alias("version_id"), "status").join(placed, keyed(versions, "version_id"), "left_anti")
    first = codes.groupBy(*keyed(versions, "version_id")).agg(F.min_by("raw", "id").alias("raw"))
    return known.join(first, keyed(versions, "version_id"), "left").select(*keyed(versions, "version_id"), "status", F.coalesce("raw", F.lit("")).alias("code"))


def warning(version_status: str = "status", placement: str = "placement") -> F.Column:
    """DO17: the first rule that a version breaks; null if none."""
    s, p = F.col(version_status), F.col(placement)
    return (
        F.when(s == "unsupported", "unsupported_file_format")
        .when(s == "failed", "document_version_processing_failed")
        .when(p.isNull() | (p == "unplaced"), "document_identity_unplaced")
        .when(p == "ambiguous", "project_structure_placement_ambiguous")
    )


def summary(versions: DataFrame, placements: DataFrame) -> DataFrame:
    """A13/DO17: status, counts and warning codes of each document set; placements have the ids of versions."""
    placed = placements.select(*keyed(versions), F.col("version_id").alias("id"), F.col("status").alias("placement"))
    rows = versions.join(placed, keyed(versions, "id"), "left").withColumn("warning", warning())
    ended = F.count_if(F.col("status").isin("ready", "failed", "unsupported"))
    status = F.when(ended < F.count("*"), "processing").when(F.count("warning") > 0, "completed_with_warnings").otherwise("completed")
    return rows.groupBy(*keyed(versions, "set_id")).agg(F.count("*").alias("versions"), F.count("warning").alias("warnings"), status.alias("status"), F.array_join(F.array_sort(F.collect_set("warning")), "|").alias("codes"))


def newest_sets(sets: DataFrame, results: DataFrame, limit: int) -> DataFrame:
    """The newest sets with their result, ``not_started`` and no warnings if there is none."""
    rows = sets.join(results, "set_id", "left").orderBy(F.desc_nulls_last("at"), "set_id").limit(limit)
    return rows.select("set_id", "files", F.coalesce("status", F.lit("not_started")).alias("status"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def diagnostics(versions: DataFrame, jobs: DataFrame, log: DataFrame, set_id: int, limit: int = 100) -> DataFrame:
    """DO27: versions, newest jobs and newest events of a set."""
    j = jobs.where(F.col("set_id") == set_id).orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select(F.lit("job").alias("kind"), "id", F.col("status").alias("state"))
    e = log.where(F.col("aggregate_id") == set_id).orderBy(F.desc("published_at"), F.desc("id")).limit(limit).select(F.lit("event").alias("kind"), "id", F.col("type").alias("state"))
    v = versions.where(F.col("set_id") == set_id).select(F.lit("version").alias("kind"), "id", F.col("status").alias("state"))
    return j.union(e).union(v)


def permissions(members: DataFrame, roles: DataFrame) -> DataFrame:
    """J9/DO31: distinct permission keys of the active memberships of each user."""
    keys = members.where("status = 'active'").join(roles, "role_id").select("user_id", F.explode("permission_keys").alias("k"))
    return keys.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("k")), "|").alias("permissions"))


def valid_members(asked: DataFrame, roles: DataFrame) -> DataFrame:
    """DM10: members all of whose roles exist and are in scope."""
    rows = asked.join(roles, "role_id", "left")
    return rows.groupBy("member").agg(F.bool_and(F.coalesce("in_scope", F.lit(False))).alias("valid"))


def current_versions(versions: DataFrame) -> DataFrame:
    """DM8: the newest version of each document."""
    return versions.groupBy("document_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("version_id"))


def register(files: DataFrame) -> DataFrame:
    """DO29/DM7: a document, a version and two events for each accepted file; ids follow from set and file, so a repeat adds nothing."""
    key = lambda kind: F.left(F.md5(F.concat_ws(":", F.lit(kind), "set_id", "id")), F.lit(12))
    events = F.explode(F.array(F.lit("document.registered"), F.lit("document_version.created")))
    return files.select(F.col("id").alias("file_id"), key("document").alias("document_id"), key("version").alias("version_id"), events.alias("event_type"))


def first_of_group(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

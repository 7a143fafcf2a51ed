"""Event log: pending events, routes to jobs, idempotent effects, causation (J4, E2-E4, E8, E11, F4-F6, DM1-DM3, DM6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (consumer, event type, processor, job type); several consumers may hear one type, several types feed one processor (fixed values).
ROUTES = (
    ("document-set-registration", "document_set.accepted", "document_registration", "document_registration"),
    ("file-format-detector", "document_version.created", "file_format_detector", "file_format_detection"),
    ("file-technical-placeholder", "file_format.detected", "file_technical_placeholder", "file_technical_placeholder"),
    ("content-probe", "file_technical.completed", "content_probe", "content_probe"),
    ("xlsx-cell-extractor", "file_technical.completed", "xlsx_cell_extractor", "xlsx_cell_extraction"),
    ("gost-title-block-interpreter", "content.probed", "gost_title_block_interpreter", "gost_title_block_interpretation"),
    ("document-type-resolver", "title_block.interpreted", "document_type_resolver", "document_type_resolution"),
    ("document-type-resolver-content", "content.extracted", "document_type_resolver", "document_type_resolution"),
    ("typed-data-extractor", "document_type.resolved", "typed_data_extractor", "typed_data_extraction"),
    ("document-identity-resolver", "typed_data.extracted", "document_identity_resolver", "document_identity_resolution"),
    ("baseline-summarizer-supported", "project_structure_placement.updated", "baseline_summarizer", "baseline_summary"),
    ("baseline-summarizer-unsupported", "file_format.unsupported", "baseline_summarizer", "baseline_summary"),
    ("baseline-summarizer-file-technical-failed", "file_technical.failed", "baseline_summarizer", "baseline_summary"),
    ("baseline-summarizer-content-failed", "content.failed", "baseline_summarizer", "baseline_summary"),
)


def pending(log: DataFrame, checkpoints: DataFrame, consumer: str, types: tuple[str, ...] | None = None, limit: int | None = 100) -> DataFrame:
    """Events that a consumer has not had, oldest first; ``types`` narrows them if given, ``limit`` is the batch of a poll."""
    seen = checkpoints.where(F.col("consumer") == consumer).select(F.col("event_id").alias("id"))
    some = log if types is None else log.where(F.col("type").isin(*types))
    rest = some.join(seen, "id", "left_anti").orderBy(F.col("published_at").asc_nulls_last(), "id")
    return rest if limit is None else rest.limit(limit)


def route(log: DataFrame, routes: DataFrame) -> DataFrame:
    """The jobs that events ask for: (event_id, consumer, processor_id, job_type, causation_id)."""
    jobs = log.join(F.broadcast(routes), "type")  # as many rows as ROUTES
    return jobs.select(F.col("id").alias("event_id"), "consumer", "processor_id", "job_type", F.col("id").alias("causation_id"))


def upsert_latest(rows: DataFrame, keys: list[str], order: list[str], first: str) -> DataFrame:
    """DM1: of the writes of each key the last row, with ``first`` (its creation) kept from the first write."""
    asc = [F.col(c).asc() for c in order]
    w = Window.partitionBy(*keys)
    last = F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order]))
    return rows.withColumn("created", F.first(first).over(w.orderBy(*asc))).withColumn("_r", last).where("_r = 1").drop("_r")


def insert_once(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """DM2/E11: rows of new whose key neither exists nor came earlier among them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return fresh.join(existing.select(*keys).distinct(), keys, "left_anti")


def effects(deliveries: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Of deliveries (consumer, event_id, seen) those that take effect: the first of each pair, unless it has a checkpoint."""
    return insert_once(checkpoints, deliveries, ["consumer", "event_id"], ["seen"])


def causation(edges: DataFrame, depth: int) -> DataFrame:
    """(root, id, depth) along (id, caused_by), no farther than ``depth`` steps."""
    step = edges.where("caused_by is null").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    out = step
    for d in range(1, depth + 1):
        nxt = edges.select(F.col("id").alias("next"), F.col("caused_by").alias("id"))
        step = step.join(nxt, "id").select("root", F.col("next").alias("id"), F.lit(d).alias("depth"))
        out = out.union(step)
    return out

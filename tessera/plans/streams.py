"""Queries that run their streaming form over the driver's events to the end, and the same in batch for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import shared_folder
from tessera.plans.fixtures import table
from tessera.streaming import events as st

Q: dict[str, object] = {}
SQL: dict[str, str] = {}


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("user_id").alias("aggregate_id"), F.col("ts").cast("timestamp").alias("published_at"), F.col("props").alias("payload"))
    path = shared_folder(spark, "log")
    e.union(e.where("id % 5 = 0")).repartition(4, "id").write.parquet(path)  # a fifth is delivered twice
    return st.read_log(spark, path)


def stream_pending(spark: SparkSession, d: str) -> DataFrame:
    consumers = spark.createDataFrame([("c1", "click"), ("c2", "click"), ("c1", "view")], "consumer string, type string")
    target = shared_folder(spark, "out")
    st.deliver(_log(spark, d), consumers, target, shared_folder(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("consumer string, id long, type string, published_at timestamp").parquet(target).select("consumer", "id", "type")


Q["e2_stream_pending"] = stream_pending
SQL["e2_stream_pending"] = "SELECT consumer, event_id AS id, event_type AS type FROM events JOIN (VALUES ('c1', 'click'), ('c2', 'click'), ('c1', 'view')) c(consumer, type) ON event_type = type"


def stream_job_state(spark: SparkSession, d: str) -> DataFrame:
    command = F.when(F.col("type") == "click", "start").when(F.col("type") == "view", "fail").when(F.col("type") == "purchase", "complete").otherwise("cancel")
    states = st.job_states(_log(spark, d).select(F.col("aggregate_id").alias("job_id"), F.col("id").alias("seq"), command.alias("command")))
    target = shared_folder(spark, "states")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(target)

    query = states.writeStream.foreachBatch(keep).option("checkpointLocation", shared_folder(spark, "checkpoint")).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("job_id long, status string, attempts int, batch long").parquet(target)
    return rows.groupBy("job_id").agg(F.max_by("status", "batch").alias("status"), F.max_by("attempts", "batch").alias("attempts"))


Q["e5_stream_job_state"] = stream_job_state


def stream_complete_and_publish(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that an event completes, and the event that each completion publishes, written together."""
    done, published, ledger = (shared_folder(spark, n) for n in ("done", "published", "ledger"))
    log = _log(spark, d).withWatermark("published_at", "7 days").dropDuplicatesWithinWatermark(["id"])
    targets = {
        done: lambda b: b.where("type = 'purchase'").select(F.col("aggregate_id").alias("job_id"), "id"),
        published: lambda b: b.where("type = 'purchase'").select(F.concat(F.lit("job-completed-"), "id").alias("event"), F.col("id").alias("causation_id")),
    }
    st.write_together(log, targets, ledger, shared_folder(spark, "checkpoint")).awaitTermination()
    a, b = st.committed(spark, done, ledger), st.committed(spark, published, ledger)
    return a.join(b, a["id"] == b["causation_id"]).select("job_id", "id", "event")


Q["dm6_complete_and_publish"] = stream_complete_and_publish
SQL["dm6_complete_and_publish"] = "SELECT user_id AS job_id, event_id AS id, 'job-completed-' || event_id AS event FROM events WHERE event_type = 'purchase'"



def stream_job_retries(spark: SparkSession, d: str) -> DataFrame:
    """E5/D3: how often each job of the event log was queued again by its timer, on the log's own clock."""
    command = F.when(F.col("type") == "click", "start").when(F.col("type") == "view", "fail").when(F.col("type") == "purchase", "complete").otherwise("cancel")
    commands = _log(spark, d).withWatermark("published_at", "0 seconds").select(F.col("aggregate_id").alias("job_id"), F.col("id").alias("seq"), command.alias("command"), F.col("published_at").alias("at"))
    target, name = shared_folder(spark, "retries"), "spark.sql.streaming.stateStore.providerClass"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(target)

    old = spark.conf.get(name)
    spark.conf.set(name, st.ROCKSDB)
    try:  # the stream keeps the setting that it starts with
        states = st.timed_job_states(commands, delay_ms=60_000, keep_ms=86_400_000, time_mode="eventTime")
        query = states.writeStream.foreachBatch(keep).option("checkpointLocation", shared_folder(spark, "checkpoint")).outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, old)
    rows = spark.read.schema("job_id long, status string, attempts int, next_run_at timestamp, batch long").parquet(target)
    return rows.groupBy("job_id").agg(F.max("attempts").alias("attempts"), F.count_if(F.col("status") == "waiting").alias("waited"))


Q["e5_stream_job_retries"] = stream_job_retries

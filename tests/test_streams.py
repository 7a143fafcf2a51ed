"""Streaming state, ledgers, sources and sinks."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming import events as st


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, st.ROCKSDB)
    yield
    spark.conf.set(name, old)


def batches(spark, folder, *groups):
    """Each group of (job_id, seq, command, at) is a batch of its own."""
    for i, rows in enumerate(groups):
        spark.createDataFrame(rows, "job_id long, seq long, command string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/in-{i:02d}")


def test_retries_by_timer_and_ended_jobs_leave(spark, tmp_path, rocksdb):
    t = lambda minute: f"2024-01-01 00:{minute:02d}:00"
    groups = [
        [(1, 1, "start", t(0)), (1, 2, "fail", t(0)), (2, 1, "start", t(0)), (2, 2, "complete", t(0)), (9, 1, "start", t(0))],
        [(9, 2, "nothing", t(3))],  # not due yet
        [(2, 3, "cancel", t(4)), (9, 3, "nothing", t(6))],  # a late command to an ended job; the clock passes the retry
        [(9, 4, "nothing", t(6))],  # the timer fires
        [(1, 3, "start", t(7)), (9, 5, "nothing", t(8))],
        [(1, 4, "fail", t(9)), (9, 6, "nothing", t(9))],
        [(1, 5, "start", t(20)), (9, 7, "nothing", t(31))],  # due within its own batch
        [(9, 8, "nothing", t(31))],
        [(2, 4, "start", t(32)), (9, 9, "nothing", t(59))],  # forgotten: a new job
    ]
    batches(spark, str(tmp_path), *groups)
    log = spark.readStream.schema("job_id long, seq long, command string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in-*")
    out = []

    def keep(batch, n):
        out.extend((r.job_id, r.status, r.attempts, str(r.next_run_at or "")) for r in batch.collect())

    states = st.timed_job_states(log.withWatermark("at", "0 seconds"), delay_ms=5 * 60_000, keep_ms=20 * 60_000, time_mode="eventTime")
    query = states.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(180)
    query.stop()
    one = [x[1:] for x in out if x[0] == 1]
    assert one == [("waiting", 1, "2024-01-01 00:05:00"), ("queued", 1, ""), ("running", 1, ""), ("waiting", 2, "2024-01-01 00:14:00"), ("running", 2, "")]
    assert [x[1] for x in out if x[0] == 2] == ["completed", "running"]
    assert [x[1] for x in out if x[0] == 9] == ["running"]


def test_a_run_that_dies_between_two_tables(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in-{i}")
    log = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in-*")
    a, b, ledger, checkpoint = (f"{tmp_path}/{n}" for n in ("a", "b", "ledger", "checkpoint"))
    runs = []

    def fragile(batch):
        runs.append(1)
        if len(runs) == 2:
            raise RuntimeError("lost")
        return batch.select((F.col("id") * 2).alias("double"))

    targets = {a: lambda batch: batch, b: fragile}
    with pytest.raises(Exception, match="lost"):
        st.write_together(log(), targets, ledger, checkpoint).awaitTermination()
    assert spark.read.parquet(a).count() == 20  # the second batch stands in one table
    assert st.committed(spark, a, ledger).count() == st.committed(spark, b, ledger).count() == 10
    st.write_together(log(), targets, ledger, checkpoint).awaitTermination()
    assert sorted(r.id for r in st.committed(spark, a, ledger).collect()) == list(range(30))
    assert sorted(r.double for r in st.committed(spark, b, ledger).collect()) == list(range(0, 60, 2))
    # a batch that is delivered again although the ledger has it changes nothing
    before = len(runs)
    st.write_together(log(), targets, ledger, f"{checkpoint}-new").awaitTermination()
    assert len(runs) == before and st.committed(spark, a, ledger).count() == 30

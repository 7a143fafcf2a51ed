"""Streaming forms of event delivery and job state (E1-E5, E9, DM6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG_SCHEMA = "id BIGINT, type STRING, aggregate_id BIGINT, published_at TIMESTAMP, payload STRING"


def read_log(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """The event log as a stream of new files, a bounded number at a time."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(log: DataFrame, consumers: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Each (consumer, event) once, however often it is delivered; state older than the lateness is dropped."""
    routed = log.withWatermark("published_at", lateness).join(F.broadcast(consumers), "type")
    return routed.dropDuplicatesWithinWatermark(["consumer", "id"])


def deliver(log: DataFrame, consumers: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """E2/E3/E9/DM6: runs all waiting events through and stops; the sink's commit log and the checkpoint make each batch count once."""
    out = deduplicated(log, consumers).select("consumer", "id", "type", "published_at")
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_together(log: DataFrame, targets: dict[str, Callable[[DataFrame], DataFrame]], ledger: str, checkpoint: str) -> StreamingQuery:
    """DM6: every batch to several tables, as one step: each gets what its function makes of the batch.

    A batch has a folder of its own in every table, and a line in the ledger once all are
    written. ``committed`` shows only batches of the ledger, so a run that dies between two
    tables shows in neither; the batch comes again with the same number, replaces its own
    folders, and a batch that the ledger has is not written twice.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if not _batches(spark, ledger).where(F.col("n") == n).isEmpty():
            return
        batch.persist()
        try:
            for path, make in targets.items():
                make(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")
        finally:
            batch.unpersist()
        spark.range(1).select(F.lit(n).cast("long").alias("n")).write.mode("overwrite").parquet(f"{ledger}/line={n}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, ledger: str) -> DataFrame:
    try:
        return spark.read.schema("n long").option("recursiveFileLookup", "true").parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "n long")


def committed(spark: SparkSession, path: str, ledger: str) -> DataFrame:
    """DM6: the rows of a table of ``write_together`` whose batch the ledger has; the ledger, a number for each batch, is small."""
    rows = spark.read.option("basePath", path).parquet(path)
    known = _batches(spark, ledger).distinct()
    return rows.join(known, rows["batch"] == known["n"], "left_semi").drop("batch")


#: Command, states that it may start from, and the state that follows (fixed values).
MOVES = {"start": (("pending", "queued"), "running"), "complete": (("running",), "completed"), "fail": (("running",), "failed"), "cancel": (("pending", "queued", "running", "failed"), "cancelled")}


def advance(status: str, attempts: int, command: str, most: int = 3) -> tuple[str, int]:
    """E5: what a command does to a job; commands that do not fit change nothing, failures are queued again while attempts are left."""
    start, end = MOVES.get(command, ((), status))
    if status not in start:
        return status, attempts
    if command == "fail" and attempts + 1 < most:
        return "queued", attempts + 1
    return end, attempts + (command == "fail")


def job_states(commands: DataFrame) -> DataFrame:
    """E5: the state of each job after the commands (job_id, seq, command) of each batch, kept between batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("queued", 0)
        for command in pd.concat(list(frames)).sort_values("seq")["command"]:
            status, attempts = advance(status, attempts, command)
        state.update((status, attempts))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts]})

    return commands.groupBy("job_id").applyInPandasWithState(run, "job_id BIGINT, status STRING, attempts INT", "status STRING, attempts INT", "update", GroupStateTimeout.NoTimeout)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMED = "job_id BIGINT, status STRING, attempts INT, next_run_at TIMESTAMP"


def waits(status: str, attempts: int, command: str, most: int) -> tuple[str, int]:
    """E5 with delays: as ``advance``, but a failure with attempts left waits before it is queued again."""
    new, count = advance(status, attempts, command, most)
    return ("waiting", count) if command == "fail" and new == "queued" else (new, count)


def timed_job_states(commands: DataFrame, delay_ms: int = 30_000, keep_ms: int = 3_600_000, most: int = 3, time_mode: str = "processingTime") -> DataFrame:
    """Job states with timers, from commands (job_id, seq, command), in update mode.

    A failed job with attempts left is ``waiting`` until its retry is due (next_run_at);
    then its timer puts it back to ``queued`` without any input. Ended jobs are remembered
    for ``keep_ms``, so that commands delivered again change nothing, and then leave the
    state. Timers run by the clock of the machine, or, with ``eventTime``, by the watermark
    of the input's column ``at``, which makes a replay of old commands come out alike.
    Needs the session's state store to be RocksDB.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Jobs(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.job = handle.getValueState("job", "status STRING, attempts INT, due BIGINT")

        def alarm(self, at: int | None) -> None:
            """One timer for a job: the new one, or none."""
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if at is not None:
                self.handle.registerTimer(at)

        def row(self, key: tuple, status: str, attempts: int, due: int | None) -> pd.DataFrame:
            return pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts], "next_run_at": [pd.Timestamp(due, unit="ms") if due else pd.NaT]})

        def now(self, timers: object) -> int:
            return timers.getCurrentWatermarkInMs() if time_mode == "eventTime" else timers.getCurrentProcessingTimeInMs()

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            status, attempts, due = self.job.get() if self.job.exists() else ("queued", 0, 0)
            before, now = (status, attempts), self.now(timerValues)
            for r in pd.concat(list(rows)).sort_values("seq").itertuples():
                now = max(now, int(r.at.timestamp() * 1000)) if time_mode == "eventTime" else now
                if status == "waiting" and due <= now:  # its timer fires after this batch's input
                    status = "queued"
                old, count = status, attempts
                status, attempts = waits(old, count, r.command, most)
                due = now + delay_ms if (status, attempts) != (old, count) and status == "waiting" else due
            due = due if status == "waiting" else 0
            if (status, attempts) != before or not self.job.exists():
                self.job.update((status, attempts, due))
                ended = status in ("completed", "failed", "cancelled")
                self.alarm(due if due else now + keep_ms if ended else None)
                yield self.row(key, status, attempts, due or None)

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
            if not self.job.exists():
                return
            status, attempts, _ = self.job.get()
            if status == "waiting":
                self.job.update(("queued", attempts, 0))
                yield self.row(key, "queued", attempts, None)
            elif status in ("completed", "failed", "cancelled"):
                self.job.clear()

        def close(self) -> None:
            pass

    columns = ["job_id", "seq", "command"] + ["at"] * (time_mode == "eventTime")
    return commands.select(*columns).groupBy("job_id").transformWithStateInPandas(Jobs(), TIMED, "Update", time_mode)


def windowed_counts(log: DataFrame, size: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """A1 over time: events by type and window; late ones count until the watermark has passed."""
    w = log.withWatermark("published_at", lateness).groupBy(F.window("published_at", size), "type").agg(F.count("*").alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("begin"), "type", "n")

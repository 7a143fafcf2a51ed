"""Job queue, its metrics and its transitions (A1, A2, A4-A7, A20, J5, T2, F7, DM4, DM5, D1-D3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the duration histograms, in seconds (fixed values).
BUCKETS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0, 1200.0)


def counts(jobs: DataFrame) -> DataFrame:
    """A1: jobs by processor, type and status."""
    return jobs.groupBy("processor_id", "job_type", "status").agg(F.count("*").alias("n"))


def ages(jobs: DataFrame, now: Column) -> DataFrame:
    """Age in seconds of the oldest queued or running job of each processor."""
    age = F.timestamp_diff("SECOND", F.col("created_at"), now) - F.when(F.col("status") == "running", F.col("wait_s")).otherwise(0)
    return jobs.where(F.col("status").isin("queued", "running")).groupBy("processor_id", "status").agg(F.max(age).cast("double").alias("oldest_s"))


def durations(jobs: DataFrame) -> DataFrame:
    """Waits and durations of ended jobs, negative ones left out."""
    done = jobs.where(F.col("status").isin("completed", "failed"))
    return done.groupBy("processor_id").agg(F.sum(F.when(F.col("wait_s") >= 0, F.col("wait_s"))).alias("wait_s"), F.sum(F.when(F.col("duration_s") >= 0, F.col("duration_s"))).alias("duration_s"), F.count("*").alias("n"))


def histogram(jobs: DataFrame, value: str = "duration_s", by: str = "processor_id") -> DataFrame:
    """Cumulative histogram: a row for each group and bound, ``+Inf`` last; non-finite values are dropped.

    Each value goes to its first bucket once; the running sum is over buckets, not rows.
    """
    v = F.col(value).cast("double")
    finite = jobs.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    at = F.lit(len(BUCKETS))
    for i in range(len(BUCKETS) - 1, -1, -1):
        at = F.when(v <= BUCKETS[i], i).otherwise(at)
    some = finite.groupBy(by, at.alias("i")).agg(F.count("*").alias("n"))
    bounds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(str(b)).alias("le")) for i, b in enumerate((*BUCKETS, "+Inf"))]))
    full = some.select(by).distinct().select(by, bounds.alias("b")).select(by, "b.i", "b.le").join(some, [by, "i"], "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(by).orderBy("i"))
    return full.select(by, "le", running.alias("n"))


def quantile(jobs: DataFrame, q: float, value: str = "duration_s", by: str = "processor_id") -> DataFrame:
    """Exact interpolated quantile of each group."""
    return jobs.groupBy(by).agg(F.round(F.percentile(value, q), 6).alias("q"))


def histogram_quantile(histogram_: DataFrame, q: float, by: str = "processor_id") -> DataFrame:
    """Quantile from a cumulative histogram, linear inside the bucket; beyond the last bound, that bound."""
    le = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.try_to_number("le", F.lit("99999.9")).cast("double"))
    rows = histogram_.withColumn("bound", le)
    total = F.max("n").over(Window.partitionBy(by))
    order = Window.partitionBy(by).orderBy("bound")
    rows = rows.withColumn("rank", total * q).withColumn("below", F.lag("n", 1, 0).over(order)).withColumn("low", F.lag("bound", 1, 0.0).over(order))
    hit = rows.where((F.col("n") >= F.col("rank")) & (F.col("below") < F.col("rank")))
    inside = F.col("low") + (F.col("bound") - F.col("low")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below"))
    return hit.select(by, F.round(F.when(F.col("bound") == float("inf"), F.col("low")).otherwise(inside), 6).alias("q"))


def progress(versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of counts, share done and last change. Cancelled jobs stay in the whole but are never done."""
    v = versions.agg(F.count("*").alias("versions"), F.count_if(F.col("status").isin("ready", "failed", "unsupported")).alias("versions_done"), F.max("created_at").alias("v_at"))
    j = jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin("pending", "queued", "running")).alias("open"), F.max("created_at").alias("j_at"))
    both = v.join(j)  # one row each
    whole = F.col("versions") + F.col("jobs")
    done = F.col("versions_done") + F.col("completed") + F.col("failed")
    percent = F.when(whole > 0, F.floor(100 * done / whole + 0.5)).otherwise(0).cast("long")
    at = F.greatest(F.coalesce("v_at", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), F.coalesce("j_at", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    return both.select("versions", "versions_done", "jobs", "completed", "failed", "open", percent.alias("percent"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def unmet(dependencies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Dependencies that hold their job back; one on a job that is not there does as well."""
    state = jobs.select(F.col("id").alias("depends_on"), F.col("status").alias("other"))
    met = (F.col("other") == "completed") | ((F.col("condition") == "completed_or_skipped") & (F.col("other") == "cancelled"))
    return dependencies.join(state, "depends_on", "left").where(~F.coalesce(met, F.lit(False))).select("job_id", "depends_on", "condition")


def runnable(jobs: DataFrame, dependencies: DataFrame, now: Column) -> DataFrame:
    """Queued jobs that are due and held back by nothing."""
    due = jobs.where((F.col("status") == "queued") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now)))
    return due.join(unmet(dependencies, jobs).select(F.col("job_id").alias("id")).distinct(), "id", "left_anti")


def claim(jobs: DataFrame, dependencies: DataFrame, now: Column) -> DataFrame:
    """For each processor the runnable job that was created first."""
    order = Window.partitionBy("processor_id").orderBy(F.col("created_at").asc_nulls_last(), "id")
    return runnable(jobs, dependencies, now).withColumn("r", F.row_number().over(order)).where("r = 1").select("processor_id", "id")


def retry(jobs: DataFrame, now: Column, delay_ms: int) -> DataFrame:
    """DM5/D3: what becomes of failed jobs: queued again after a delay while attempts are left, else failed for good."""
    again = F.col("attempts") + 1 < F.col("max_attempts")
    after = now + F.make_dt_interval(secs=F.lit(delay_ms / 1000))
    return jobs.where("status = 'failed'").select("id", (F.col("attempts") + 1).alias("attempts"), F.when(again, "queued").otherwise("failed").alias("status"), F.when(again, F.date_format(after, "yyyy-MM-dd HH:mm:ss")).alias("next_run_at"))


#: Which states each transition may start from (fixed values).
MOVES = {"complete": ("running",), "fail": ("running",), "cancel": ("pending", "queued", "running", "failed")}
RESULTS = {"complete": "completed", "fail": "failed", "cancel": "cancelled"}


def transition(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """DM4/E6: (id, command, status, allowed) for commands (id, command); refused ones and unknown jobs change nothing."""
    both = commands.join(jobs.select("id", F.col("status").alias("old")), "id", "left")
    fine = F.lit(False)
    new = F.col("old")
    for command, start in MOVES.items():
        ok = (F.col("command") == command) & F.col("old").isin(*start)
        fine, new = fine | F.coalesce(ok, F.lit(False)), F.when(ok, RESULTS[command]).otherwise(new)
    return both.select("id", "command", new.alias("status"), fine.alias("allowed"))

"""Shared helpers: table access, cluster scratch space, component labelling."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: A word of the contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` names the folder on a cluster. Only where it is
    unset (tests, local runs) a temporary one is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


#: Bytes of one batch of rows that goes to a Python worker, unless the session has less; one row may be longer.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches bounded by bytes, so that what a task holds does not grow with their length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def written(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and stored as Parquet in the shared folder.

    Cuts the lineage in a way that survives a lost executor. What was shuffled for it
    is needed no more; the driver's collector is run so that executors drop those files
    before the next step writes its own.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_dir(spark)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the folder of a ``written`` frame that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], T]) -> T:
    """What a worker keeps from task to task: one thing for it; another's is dropped first, and its memory given back."""
    if key not in _HELD:
        forget()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Drops what the worker has kept and gives free memory back to the system."""
    _HELD.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) for every end of an edge (a, b); component is the smallest id reached.

    Alternates large-star and small-star steps; each is one grouped minimum and one
    join, so a hub of any degree is pre-aggregated or split, never gathered. Each
    round is written to the shared folder. Ends when a round changes no edge.
    """
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct()
    e = written(e)
    mark = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select("v", F.col("m").alias("u"))
        # small star: every v points at the least of its lower neighbours, and so do these
        large = large.where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        nxt = written(small.select("x.v", F.col("x.m").alias("u")).where("u <> v").distinct())
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            e = nxt
            break
        mark, e = tuple(now), nxt
    else:
        raise RuntimeError("components did not settle")
    lone = e.select(F.col("v").alias("id"), F.col("u").alias("component"))
    return lone.union(e.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())

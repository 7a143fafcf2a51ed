"""Object store reads, payload references, sinks and codecs (SC1-SC4, SC8, SC11-SC16, JS3, X1-X3)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INLINE_BYTES = 512 * 1024


def tenant(table: DataFrame, org: str) -> DataFrame:
    """SC1: the rows of one tenant."""
    return table.where(F.col("org_id") == org)


def lookup(table: DataFrame, **key: object) -> DataFrame:
    """SC2: the row of a composite key, if it is there."""
    for column, value in key.items():
        table = table.where(F.col(column) == value)
    return table.limit(1)


def with_ids(table: DataFrame, column: str, ids: list) -> DataFrame:
    """rows of some ids; none for an empty list, without a scan."""
    return table.where(F.col(column).isin(*ids)) if ids else table.limit(0)


def objects(spark: SparkSession, path: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """SC3/SC4: objects below a path, with their bytes or just names and sizes (which does not open them)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length", "content") if content else rows.select("path", "length")


def hydrate(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """SC11: rows (id, storage, payload, ref) with the payload from the store (ref, body) where it is only referred to."""
    both = rows.join(payloads.select("ref", "body"), "ref", "left")
    return both.select("id", F.when(F.col("storage") == "payload_ref", F.col("body")).otherwise(F.col("payload")).alias("payload"))


def spill(rows: DataFrame, limit: int = INLINE_BYTES) -> DataFrame:
    """SC12: payloads up to the limit stay inline, larger ones become a reference named by their hash; ``formats.Payloads`` also writes them."""
    big = F.octet_length("payload") > limit
    return rows.select("id", F.when(big, "payload_ref").otherwise("inline").alias("storage"), F.when(~big, F.col("payload")).alias("payload"), F.when(big, F.concat(F.lit("payloads/"), F.sha2("payload", 256))).alias("ref"))


def staged_write(rows: DataFrame, path: str, check: Callable[[DataFrame], bool]) -> bool:
    """SC13: writes beside the target and moves it there if the check of what was written holds; else takes it away.

    The old target is moved aside first and comes back if the new one can't take its place, so
    one of the two stands there after any failure of a step.
    """
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    staging, old, target = (hadoop.Path(f"{path}{end}") for end in (".staging", ".old", ""))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").parquet(f"{path}.staging")
    if not check(spark.read.parquet(f"{path}.staging")):
        fs.delete(staging, True)
        return False
    had = fs.exists(target)
    if had:
        fs.delete(old, True)
        if not fs.rename(target, old):
            return False
    if not fs.rename(staging, target):
        if had:
            fs.rename(old, target)
        return False
    fs.delete(old, True)
    return True


def prometheus(samples: DataFrame, name: str, help_: str, kind: str) -> DataFrame:
    """SC14: metric text of samples (labels map, value): a head, then a line for each, labels escaped and in order."""
    escape = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"'))), ",")
    line = F.concat(F.lit(f"{name}{{"), labels, F.lit("} "), F.regexp_replace(F.format_string("%.3f", F.col("value").cast("double")), r"\.?0+$", ""))
    rows = samples.select(line.alias("line")).orderBy("line")
    head = samples.sparkSession.createDataFrame([(f"# HELP {name} {help_}",), (f"# TYPE {name} {kind}",)], "line string")
    return head.union(rows)


def to_json(rows: DataFrame) -> DataFrame:
    """SC15: rows as JSON texts."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


TSV = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


def parse_tsv(texts: DataFrame) -> DataFrame:
    """SC16/A15: words of recognition output (id, tsv) with the mean confidence of those that have one."""
    lines = texts.select("id", F.posexplode(F.split("tsv", r"\r?\n")).alias("n", "line")).where("n > 0 AND line <> ''")
    f = F.split("line", "\t")
    return lines.select("id", *[f[i].try_cast("double" if c == "conf" else "string" if c == "text" else "int").alias(c) for i, c in enumerate(TSV)]).where("level = 5 AND trim(text) <> ''")


def mean_confidence(words: DataFrame) -> DataFrame:
    """A15"""
    return words.groupBy("id").agg(F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100, F.lit(0.0)).alias("confidence"), F.array_join(F.collect_list("text"), " ").alias("text"))


def payload_refs(rows: DataFrame, column: str = "payload") -> DataFrame:
    """JS3: every reference to a stored payload anywhere in a JSON text, at any depth."""

    def walk(x: object) -> Iterator[str]:
        if isinstance(x, dict):
            for k, v in x.items():
                if k == "payloadRef" and isinstance(v, dict) and isinstance(v.get("key"), str):
                    yield v["key"]
                yield from walk(v)
        elif isinstance(x, list):
            for v in x:
                yield from walk(v)

    def find(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            try:
                out.append(sorted(set(walk(json.loads(t)))) if t else [])
            except (ValueError, RecursionError):
                out.append([])
        return pd.Series(out)

    return rows.select("id", F.explode(F.pandas_udf(find, "array<string>")(column)).alias("key"))


class Registry:
    """Processors by (id, job type); each is a function of DataFrames."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {}

    def register(self, processor: str, job_type: str, run: Callable[[DataFrame], DataFrame]) -> None:
        if (processor, job_type) in self.known:
            raise ValueError(f"{processor}/{job_type} is registered already")
        self.known[processor, job_type] = run

    def run(self, jobs: DataFrame) -> tuple[dict[tuple[str, str], DataFrame], DataFrame]:
        """Results by processor, and the jobs that none is registered for, as failures."""
        out, rest = {}, jobs
        for (processor, job_type), f in self.known.items():
            mine = (F.col("processor_id") == processor) & (F.col("job_type") == job_type)
            out[processor, job_type] = f(jobs.where(mine))
            rest = rest.where(~mine)
        return out, rest.withColumn("error", F.lit("unknown_processor"))


def recognise(crops: DataFrame, engine: Callable[[bytes], tuple[str, float]]) -> DataFrame:
    """X2/CV12: text and confidence of image crops (id, image) by an engine given from outside."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [engine(bytes(x)) for x in b["image"]]
            yield pd.DataFrame({"id": b["id"], "text": [t for t, _ in found], "confidence": [float(c) for _, c in found]})

    return crops.select("id", "image").mapInPandas(run, "id long, text string, confidence double")

"""Secret scans by an incremental ledger of blobs.

Every version of every path is addressed by the hash of its content. The ledger holds a
row for each blob and rule version that has been scanned, with the spans found, so a scan
reads the text of a blob only for rules that the ledger does not have for it: a text that
stands under thousands of paths, or that a later commit brings back, is scanned once, and
a new version of one rule is the only one that runs again. Findings are joined back to all
paths and versions by their blobs.

All of it is DataFrame expressions. Spans come from two arrays of equal order: the matches
of a pattern and the gaps between them, whose added lengths are the offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import scratch_dir, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of the pattern whose group has at least so many characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(words: str) -> str:
    """A pattern that takes ASCII letters in either case, and no other letter for them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: A run that is too short never hides a longer one for access and hex, so their lengths are in the patterns; a short value of an assignment does use up its text.
BASE = (
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),
)
#: Further public formats: private keys, signed web tokens, credentials in addresses, bearer headers.
MORE = (
    Rule("key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,500}\.eyJ[A-Za-z0-9_-]{8,500}\.[A-Za-z0-9_-]{8,500}"),
    Rule("url", r"://[A-Za-z0-9._~%+-]{1,100}:[^\x20\x09-\x0D/@:]{1,100}@"),
    Rule("bearer", either_case("bearer") + r"\x20{1,8}[A-Za-z0-9._~+/=-]{20,}", 20),
)
RULES = BASE + MORE
LEDGER = "blob binary, rule string, spans array<struct<start:int,end:int>>"


def address(text: Column) -> Column:
    """The blob of a content; a null text is the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def index(versions: DataFrame, path_col: str = "path", version_col: str | None = "version", text_col: str = "text") -> DataFrame:
    """(path, version, blob) for each row of versions, stored; without a version column every version is 1."""
    return written(_rows(versions, path_col, version_col, text_col).select("path", "version", "blob"))


def _rows(versions: DataFrame, path_col: str, version_col: str | None, text_col: str) -> DataFrame:
    version = F.col(f"`{version_col}`") if version_col else F.lit(1)
    text = F.col(f"`{text_col}`")
    return versions.select(F.col(f"`{path_col}`").alias("path"), version.alias("version"), F.coalesce(text, F.lit("")).alias("text"), address(text).alias("blob"))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(blob, rule, spans): what has been scanned; empty if the folder isn't there yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def unseen(rows: DataFrame, known: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, path, version, todo): of each blob of ``index`` rows that lacks rules in the ledger one place, and those rules' tags."""
    one = rows.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    seen = known.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(F.array(*[F.lit(r.tag) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
    return one.join(seen, "blob", "left").select("blob", "at.path", "at.version", todo.alias("todo")).where(F.size("todo") > 0)


def _matches(text: Column, rule: Rule) -> Column:
    """Length of each match, and whether it is long enough to count."""
    value = lambda m: F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m
    return F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.struct(F.char_length(m).alias("len"), (F.char_length(value(m)) >= rule.least).alias("ok")))


def scan(versions: DataFrame, rows: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, path_col: str = "path", version_col: str | None = "version", text_col: str = "text") -> DataFrame:
    """Scans every pair of blob and rule that the ledger lacks, appends to it, and returns the pairs as (blob, rule, spans).

    ``rows`` is the ``index`` of the same versions. A ledger row is complete in itself, so a
    run that dies while it appends leaves rows that hold, and the next run does the rest.
    Offsets count code points, end exclusive; matches are the leftmost ones that don't
    overlap, and short ones are dropped without a second try.
    """
    spark = versions.sparkSession
    todo = written(unseen(rows, ledger(spark, folder), rules)).alias("t")
    texts = _rows(versions, path_col, version_col, text_col).alias("v")
    same = (F.col("v.blob") == F.col("t.blob")) & F.col("v.path").eqNullSafe(F.col("t.path")) & F.col("v.version").eqNullSafe(F.col("t.version"))
    open_ = texts.join(todo, same).select("v.blob", "v.text", "t.todo")
    # matches first; gaps only where there are matches
    hits = open_.select("*", *[F.when(F.array_contains("todo", r.tag), _matches(F.col("text"), r)).alias(f"hits_{i}") for i, r in enumerate(rules)])
    gaps = lambda r, i: F.when(F.size(f"hits_{i}") > 0, F.transform(F.split("text", r.pattern, -1), F.char_length))
    each = F.array(*[F.struct(F.lit(r.tag).alias("rule"), F.col(f"hits_{i}").alias("hits"), gaps(r, i).alias("gaps")) for i, r in enumerate(rules)])
    done = written(hits.select("blob", F.explode(F.filter(each, lambda x: x["hits"].isNotNull())).alias("x")).select("blob", "x.*"))
    # rows that repeat with their path were scanned alike
    found = done.where(F.size("hits") > 0).groupBy("blob", "rule").agg(F.first("hits").alias("hits"), F.first("gaps").alias("gaps"))
    found = found.select("blob", "rule", F.posexplode(F.arrays_zip("hits", F.slice("gaps", F.lit(1), F.size("hits")).alias("gap"))).alias("at", "x"))
    run = Window.partitionBy("blob", "rule").orderBy("at")
    end = F.sum(F.col("x.gap") + F.col("x.hits.len")).over(run)
    spans = found.select("blob", "rule", F.col("x.hits.ok").alias("ok"), F.struct((end - F.col("x.hits.len")).cast("int").alias("start"), end.cast("int").alias("end")).alias("span"))
    spans = spans.where("ok").groupBy("blob", "rule").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    new = written(done.select("blob", "rule").distinct().join(spans, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", none).alias("spans")))
    new.write.mode("append").parquet(folder)
    return new


def findings(rows: DataFrame, known: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, version, blob, spans) for every row of ``index`` rows; spans (start, order, end, kind) by start, then the rules' order.

    Only rows of the ledger under the rules' own versions count. The many paths of one blob
    meet one row of findings; a blob that holds a large part of all rows is split by the
    adaptive join.
    """
    mine = known.where(F.col("rule").isin([r.tag for r in rules]) & (F.size("spans") > 0))
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.tag), F.lit(i))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.tag), F.lit(r.kind))])
    one = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("order"), s["end"].alias("end"), kind[F.col("rule")].alias("kind")))
    blobs = mine.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set(one))).alias("spans"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    return rows.join(blobs, "blob", "left").select("path", "version", "blob", F.coalesce("spans", none).alias("spans"))


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def shown(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    return F.array_join(F.transform(of_kinds(spans, *kinds), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", version_col: str | None = None, text_col: str = "text") -> DataFrame:
    """(id_col, version, n_kind for each base kind, base, spans): scans what the ledger in ``folder`` lacks, then reports every row.

    Without a folder the ledger starts empty in the shared scratch folder. Null texts count
    as empty and hold nothing; null and repeated ids keep their rows; a table without rows
    gives none; other columns of any name are ignored.
    """
    folder = folder or scratch_dir(docs.sparkSession)
    rows = index(docs, id_col, version_col, text_col)
    scan(docs, rows, folder, rules, id_col, version_col, text_col)
    found = findings(rows, ledger(docs.sparkSession, folder), rules)
    base, kinds = tuple(r.kind for r in BASE), tuple(r.kind for r in rules)
    counts = [F.size(of_kinds(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select(F.col("path").alias(id_col), "version", *counts, shown(F.col("spans"), base).alias("base"), shown(F.col("spans"), kinds).alias("spans"))

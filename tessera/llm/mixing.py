"""Mixing sources to target weights by nested hash thresholds.

Every document gets a 60-bit hash of its id. Tokens are summed by source and the
leading bits of the hash; the sums place a source's budget inside one bucket, and
only that bucket is summed again by its next bits, until the boundary is a single
hash. Documents under the threshold are then taken by a filter: nothing is sorted,
and what moves is one partial sum for each source and bucket.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WORD, written

BITS = 12
LEVELS = 5


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(column: str, seed: str) -> F.Column:
    """60 bits of md5, which other SQL engines compute as well."""
    key = F.concat(F.lit(seed), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def text_digest(text: str = "text") -> F.Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def targets(sizes: list[tuple[object, int, int]], repeat: int) -> dict[object, float]:
    """Shares of the total by weight, none above ``repeat`` times its size; the excess is shared again.

    sizes: (source, size, weight). Equal to min(cap, level * weight) with one level for all.
    """
    total, weight = sum(s for _, s, _ in sizes), sum(w for *_, w in sizes)
    out: dict[object, float] = {}
    for source, size, w in sorted(sizes, key=lambda x: Fraction(repeat * x[1], x[2])):
        share = Fraction(total * w, weight)
        out[source] = float(min(share, Fraction(repeat * size)))
        if share >= repeat * size:
            total, weight = total - repeat * size, weight - w
        else:
            for other, _, v in (x for x in sizes if x[0] not in out):
                out[other] = float(Fraction(total) * v / weight)
            break
    return out


def thresholds(slim: DataFrame, weights: tuple[int, ...], repeat: int) -> DataFrame:
    """A row for each source of slim (_source, _size, _h): its size, target, copies for all, and the hash below which one more is taken.

    Where rows share the hash at the end of the target (rows of one id), _edge is what comes
    before them and _rest what there is in all; else _edge is null. Only one row for each
    source reaches the driver, and a source's boundary bucket.
    """
    found = slim.groupBy("_source").agg(F.sum("_size")).collect()
    found = sorted(((r[0], int(r[1])) for r in found), key=lambda x: (x[0] is None, x[0] or ""))
    sized = [(s, n, weights[k % len(weights)]) for k, (s, n) in enumerate(found)]
    target = targets(sized, repeat) if sum(n for _, n in found) else dict.fromkeys((s for s, _ in found), 0.0)
    state = {}
    for s, n in found:
        base = min(repeat, int(target[s] // n)) if n else 0
        state[s] = {"n": n, "target": target[s], "copies": base, "rest": target[s] - base * n, "low": 0, "below": 0, "edge": None, "open": bool(n) and base < repeat}
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        todo = [(s, x["low"] >> (shift + BITS)) for s, x in state.items() if x["open"]]
        if not todo:
            break
        at = slim.sparkSession.createDataFrame(todo, T.StructType([T.StructField("_s", slim.schema["_source"].dataType), T.StructField("_p", T.LongType())]))
        near = slim.join(at, F.col("_source").eqNullSafe(F.col("_s")) & (F.shiftright("_h", shift + BITS) == F.col("_p")))
        sums = near.groupBy("_s", F.shiftright("_h", shift).alias("b")).agg(F.sum("_size").alias("n"), F.count("*").alias("k"))
        buckets: dict[object, list[tuple[int, int, int]]] = {}
        for r in sums.toLocalIterator():
            buckets.setdefault(r[0], []).append((r[1], int(r[2]), r[3]))
        for s, _ in todo:
            x = state[s]
            for b, n, k in sorted(buckets.get(s, [])):
                # a single row is in if its middle comes before the end, of several all are in if their end does
                if (2 * x["below"] + n <= 2 * x["rest"]) if k == 1 else (x["below"] + n <= x["rest"]):
                    x["below"] += n
                    x["low"] = (b + 1) << shift
                else:
                    x["low"], x["open"] = b << shift, k > 1 and level < LEVELS - 1
                    x["edge"] = x["below"] if k > 1 and not x["open"] else None
                    break
            else:
                x["open"] = False
    rows = [(s, x["n"], x["target"], x["copies"], x["low"], x["edge"], float(x["rest"])) for s, x in state.items()]
    schema = T.StructType([T.StructField("_s", slim.schema["_source"].dataType), T.StructField("_total", T.LongType()), T.StructField("_target", T.DoubleType()), T.StructField("_base", T.LongType()), T.StructField("_low", T.LongType()), T.StructField("_edge", T.LongType()), T.StructField("_rest", T.DoubleType())])
    return slim.sparkSession.createDataFrame(rows, schema)


def at_edge(plan: str = "", own: str = "_h") -> F.Column:
    """Whether a row shares the hash at which its source's target ends with others."""
    at = f"`{plan}`." if plan else ""
    return F.col(f"{at}_edge").isNotNull() & (F.col(own) == F.col(f"{at}_low"))


def has_edges(plan: DataFrame) -> bool:
    """Whether any source's target ends among rows that share a hash; the plan is a local table of one row for each source."""
    return not plan.where("_edge is not null").isEmpty()


def copies(plan: str = "", own: str = "_h", size: F.Column | None = None, order: F.Column | None = None) -> F.Column:
    """How often a row with a hash is taken, by the columns of ``thresholds`` (in a struct of that name).

    With a size and an order, for rows at the edge alone: one after another until the middle
    of one passes the target. They are the rows of one id and source, numbered in one task.
    """
    at = f"`{plan}`." if plan else ""
    more = F.col(own) < F.col(f"{at}_low")
    if size is not None:
        rows = Window.partitionBy(f"{at}_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        more = 2 * (F.col(f"{at}_edge") + F.sum(size).over(rows) - size) + size <= 2 * F.col(f"{at}_rest")
    return (F.col(f"{at}_base") + more.cast("long")).alias("copies")


def slimmed(docs: DataFrame, seed: str, id_col: str) -> DataFrame:
    return written(docs.select(F.col(id_col).alias("_id"), F.col("source").alias("_source"), word_count().alias("_size"), id_hash(id_col, seed).alias("_h"), text_digest().alias("_t")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeat: int = 3, seed: str = "mix:", id_col: str = "doc_id") -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken) for each row of docs (id_col, source, text).

    Sources in code-point order, null last, get the weights in turn and share the
    total size; ``targets`` caps them. A source's documents all get
    ``floor(target / size)`` copies; one more goes to the documents whose hash comes
    before the point where the rest of the target is used up (a document counts if
    its middle comes before that point, so the error is at most half of one
    document). Rows that share an id stand in the order of their texts' hashes, so
    they too are cut within one row; which of equal rows are taken does not show.
    Null text has size 0; an empty table gives no rows; a source of size 0 has target
    0 and takes nothing; other columns are ignored.
    """
    slim = slimmed(docs, seed, id_col)
    plan = thresholds(slim, weights, repeat)
    both = slim.join(plan, F.col("_source").eqNullSafe(F.col("_s")))
    shown = [F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target")]
    out = both.where(~at_edge()).select(*shown, copies())
    if has_edges(plan):
        out = out.union(both.where(at_edge()).select(*shown, copies(size=F.col("_size"), order=F.col("_t"))))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeat: int = 3, seed: str = "mix:", id_col: str = "doc_id") -> DataFrame:
    """docs (id_col, source, text and any others) with every row as often as ``mix`` takes it, 0 to ``repeat`` times.

    The columns stay as they are and may have any name; no text is moved. Edge cases are
    those of ``mix``.
    """
    plan = thresholds(slimmed(docs, seed, id_col), weights, repeat)
    mine = "_mix"
    while mine in docs.columns:
        mine += "_"
    rule = plan.select(F.struct("*").alias(mine))
    both = docs.join(rule, docs["source"].eqNullSafe(F.col(f"`{mine}`._s"))).withColumn(mine, F.struct(id_hash(id_col, seed).alias("h"), f"`{mine}`.*"))
    often = lambda rows, *by: rows.withColumn(mine, copies(mine, f"`{mine}`.h", *by))
    edge = at_edge(mine, f"`{mine}`.h")
    out = often(both.where(~edge))
    if has_edges(plan):
        out = out.union(often(both.where(edge), word_count(), text_digest()))
    return out.where(F.col(f"`{mine}`") > 0).withColumn(mine, F.explode(F.sequence(F.lit(1), F.col(f"`{mine}`")))).drop(mine)

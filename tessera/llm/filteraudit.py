"""How the filters of a corpus interact, by inclusion and exclusion.

A document's failures are flags of 0 and 1. For every set of filters the products of its
flags are added up by part of the corpus: how many documents fail all filters of the set.
These joint counts (32 for five filters) answer every question about the filters in any
order: a Moebius inversion gives the survivors of each set and the documents that fail
one filter alone, differences of survivors give what a step removes, and the joint counts
with alternating signs are the Harsanyi dividends of the game "documents removed", whose
Shapley value divides each dividend equally among the members of its set.

Documents are read once. What moves is a row without text for each document, pre-aggregated
by text, and one row of sums for each part.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = "\t\n\x0b\x0c\r"
#: Names of the filters that look at one text; E, the last one, is repetition.
TEXT_FILTERS = "ABCD"
FILTERS = TEXT_FILTERS + "E"
WEIGHTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Failures of one text (never null) as 0 or 1.

    A: under 200 words; B: under half of the words are distinct; C: over 3 % of the code
    points are A-Z; D: one of ``#$%&*|`` is in it. An empty text fails A alone.
    """
    words = F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")
    found = F.struct(F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("distinct"))
    # one pass over the words for both numbers
    counts = F.transform(F.array(found), lambda c: F.struct(c["words"] < 200, 100 * c["distinct"].cast("long") < 50 * c["words"].cast("long")))[0]
    return {
        "A": counts["col1"].cast("int"),
        "B": counts["col2"].cast("int"),
        "C": (100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.char_length(text).cast("long")).cast("int"),
        "D": text.rlike("[#$%&*|]").cast("int"),
    }


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counted documents (part, A, B, C, D, E, n, good, toxic): n documents of one part that fail alike, the good and the toxic ones of them.

    A null text counts as empty, a null part as the empty string. E fails where the same
    text stands under a smaller id, anywhere in the table; of rows that share the smallest
    id none fails, nor does a row without id, as nothing is smaller. A document is good
    (toxic) if any label row of its id has quality 1 (toxic 1). Rows that repeat count as
    often as they stand; other columns of any name are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), text.alias("text"))
    slim = slim.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in text_failures(F.col("text")).items()])
    # what is alike is counted before and after the move, so neither an id nor a text that many rows share gathers them
    alike = slim.groupBy("id", "part", "digest", *TEXT_FILTERS).agg(F.count("*").alias("n"))
    marks = labels.where("quality = 1 OR toxic = 1").groupBy(F.col(id_col).alias("id")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    rows = alike.join(marks, "id", "left").withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    # a text's rows of one part and label: how many, and how many of them stand under the smallest id or none
    texts = rows.groupBy("digest", "part", *TEXT_FILTERS, "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("n_low"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_none"))
    first = F.min("low").over(Window.partitionBy("digest"))
    texts = texts.withColumn("pass", F.col("n_none") + F.when(F.col("low") == first, F.col("n_low")).otherwise(0))
    both = F.explode(F.array(F.struct(F.lit(0).alias("E"), F.col("pass").alias("n")), F.struct(F.lit(1).alias("E"), (F.col("n") - F.col("pass")).alias("n"))))
    out = texts.select("part", *TEXT_FILTERS, "good", "toxic", both.alias("x"))
    n = F.col("x.n")
    return out.select("part", *TEXT_FILTERS, "x.E", "x.n", (n * F.col("good")).alias("good"), (n * F.col("toxic")).alias("toxic"))


def subsets(filters: str) -> list[str]:
    """All sets of filters, each as its members in order; the empty set first."""
    return ["".join(f for i, f in enumerate(filters) if s >> i & 1) for s in range(1 << len(filters))]


def joint_failures(counted: DataFrame, filters: str = FILTERS, weights: tuple[str, ...] = WEIGHTS) -> DataFrame:
    """(part, and for each weight an array): entry s is the sum over documents of the products of the flags in set s.

    Sets are numbered by ``subsets``. One row for each part; sums are combined before they move.
    """
    product = lambda w, s: F.sum(reduce(mul, [F.col(f) for f in s], F.col(w)))
    sums = [product(w, s).cast("long").alias(f"{w}_{i}") for w in weights for i, s in enumerate(subsets(filters))]
    found = counted.groupBy("part").agg(*sums)
    return found.select("part", *[F.array(*[F.col(f"{w}_{i}") for i in range(1 << len(filters))]).alias(w) for w in weights])


def survivors(joint: Column, members: int) -> Column:
    """Documents that fail none of a set: the alternating sum of the joint failures of its subsets."""
    inside = [s for s in range(members + 1) if s & members == s]
    return reduce(lambda a, b: a + b, [joint[s] * (-1) ** s.bit_count() for s in inside])


def alone(joint: Column, member: int, all_members: int) -> Column:
    """Documents that fail one filter and no other: the Moebius inversion at that filter."""
    above = [s for s in range(all_members + 1) if s & member]
    return reduce(lambda a, b: a + b, [joint[s] * (-1) ** (s.bit_count() - 1) for s in above])


def shapley_sum(joint: Column, member: int, all_members: int) -> Column:
    """A filter's removals summed over all orders: the dividends of the sets it is in, each divided among the set's members, times the number of orders."""
    orders = factorial(all_members.bit_count())
    inside = [s for s in range(1, all_members + 1) if s & member]
    return reduce(lambda a, b: a + b, [joint[s] * ((-1) ** (s.bit_count() + 1) * (orders // s.bit_count())) for s in inside])


def audit(counted: DataFrame, filters: str = FILTERS, weights: tuple[str, ...] = WEIGHTS) -> DataFrame:
    """A row for each part, order of the filters and step.

    (part, filter_order, step, filter, kept, removed, redundant, unique_fails, shapley, and
    w_lost for each further weight): documents kept after the step and removed by it, those
    that fail its filter but were removed before, those that fail it alone, and the sum of
    its removals over all orders. ``counted`` has (part, flags of 0 or 1 under the filters'
    names, weights), as ``failures`` returns; filters have names of one letter. An empty
    table has no part and gives no rows.
    """
    joint, whole = joint_failures(counted, filters, weights), (1 << len(filters)) - 1
    bits = {f: 1 << i for i, f in enumerate(filters)}
    per_set = lambda make: F.array(*[make(s) for s in range(whole + 1)])
    per_filter = lambda make: F.create_map(*[x for f, b in bits.items() for x in (F.lit(f), make(b))])
    first = weights[0]
    tables = joint.select(
        "part", *[per_set(lambda s, w=w: survivors(F.col(w), s)).alias(f"kept_{w}") for w in weights],
        per_filter(lambda b: F.col(first)[b]).alias("fails"), per_filter(lambda b: alone(F.col(first), b, whole)).alias("only"), per_filter(lambda b: shapley_sum(F.col(first), b, whole)).alias("share"))
    orders = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    rows = tables.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    mask = lambda n: F.aggregate(F.split(F.substring(F.col("filter_order"), F.lit(1), n), ""), F.lit(0), lambda a, f: a + F.coalesce(F.create_map(*[x for k, b in bits.items() for x in (F.lit(k), F.lit(b))])[f], F.lit(0)))
    rows = rows.withColumns({"before": mask(F.col("at")), "after": mask(F.col("at") + 1)})
    lost = lambda w: F.col(f"kept_{w}")[F.col("before")] - F.col(f"kept_{w}")[F.col("after")]
    return rows.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), "filter", F.col(f"kept_{first}")[F.col("after")].alias("kept"), lost(first).alias("removed"),
        (F.col("fails")[F.col("filter")] - lost(first)).alias("redundant"), F.col("only")[F.col("filter")].alias("unique_fails"),
        *[lost(w).alias(f"{w}_lost") for w in weights[1:]], F.col("share")[F.col("filter")].alias("shapley"))

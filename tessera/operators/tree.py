"""Project hierarchy: closures, roll-ups, paths, placement chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import stored



def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, id, depth) for every node and each of its ancestors, itself included.

    Paths are doubled: with all ancestors nearer than 2^k steps and the node exactly 2^k
    steps up, one join gives those nearer than 2^(k+1). So a tree needs as many steps as its
    depth has binary digits, and each is written, so the plan stays as small as one step.
    A path that comes back to a node of its own adds nothing more and ends there (cycles do
    not loop); the depth is that of the first visit. A parent that is not a node is left out.
    """
    known = stored(nodes.select("id", "parent_id"))
    near = known.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("depth"))
    jump = known.where("parent_id is not null").join(known.select(F.col("id").alias("parent_id")), "parent_id").select("id", F.col("parent_id").alias("up"))
    step, pairs = 1, None
    while True:
        far = jump.join(near.withColumnRenamed("id", "up"), "up").select("ancestor", "id", (F.col("depth") + step).alias("depth"))
        near = stored(near.unionByName(far).groupBy("ancestor", "id").agg(F.min("depth").alias("depth")))
        now = near.count()
        if now == pairs:
            return near
        jump = stored(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("upper")), "up").select("id", F.col("upper").alias("up")))
        if jump.isEmpty():
            return near
        step, pairs = step * 2, now


def descendants(nodes: DataFrame, root: str) -> DataFrame:
    """G1: ids below a node, itself included."""
    return closure(nodes).where(F.col("ancestor") == root).select("id", "depth")


def rollup(nodes: DataFrame, placements: DataFrame, statuses: tuple[str, ...] = ("placed", "ambiguous")) -> DataFrame:
    """Distinct versions placed at or below each node; nodes without any stay with 0.

    Distinct (node, version) pairs are counted at their own node first; only the
    pairs move up, and the status filter is inside the join's right side.
    """
    placed = placements.where(F.col("status").isin(*statuses)).select("node_id", "version_id").distinct()
    pairs = closure(nodes).select("ancestor", "id").join(placed, F.col("id") == placed["node_id"], "left")
    return pairs.groupBy(F.col("ancestor").alias("id")).agg(F.countDistinct("version_id").alias("documents"))


def fallback_groups(placements: DataFrame, versions: DataFrame) -> DataFrame:
    """How many versions are unplaced and unsupported; empty groups are left out."""
    a = placements.where("status = 'unplaced'").agg(F.countDistinct("version_id").alias("n")).select(F.lit("unplaced").alias("group_name"), "n")
    b = versions.where("status = 'unsupported'").agg(F.countDistinct("id").alias("n")).select(F.lit("unsupported").alias("group_name"), "n")
    return a.union(b).where("n > 0")


def paths(nodes: DataFrame) -> DataFrame:
    """(id, depth, path_code, path_titles) from the root down, codes joined by dots."""
    up = closure(nodes).join(nodes.select(F.col("id").alias("ancestor"), "code", "title"), "ancestor")
    chain = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("k"), "code", "title")))
    out = up.groupBy("id").agg(F.max("depth").alias("depth"), chain.alias("c"))
    return out.select("id", "depth", F.array_join(F.col("c.code"), ".").alias("path_code"), F.array_join(F.col("c.title"), "|").alias("path_titles"))


def search(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose title or path code holds the text, and all above them."""
    found = paths(nodes).join(nodes.select("id", "title"), "id")
    needle = text.lower()
    hit = found.where(F.lower("title").contains(needle) | F.lower("path_code").contains(needle)).select("id")
    return closure(nodes).join(hit, "id").select(F.col("ancestor").alias("id")).distinct()


def materialise(parsed: DataFrame) -> DataFrame:
    """The chain of structure nodes that parsed codes ask for: project, stage, section or mark.

    parsed: (project_code, stage, section_number, mark, status). Ids are digests of
    the path, so that the same path is the same node wherever it is computed.
    """
    # whether a code counts comes out of the aggregation, and the levels are an expression after it: a filter on either would go down to the scan and parse each code there many times over
    ok = parsed.groupBy("project_code", "stage", "mark").agg(F.max(F.col("status") == "parsed").alias("ok")).where("ok")
    stage = F.when(F.col("stage").isNotNull(), F.struct(F.lit("documentation_stage").alias("kind"), F.col("stage").alias("key")))
    part = F.when(F.col("stage").isNotNull() & F.col("mark").isNotNull(), F.struct(F.lit("mark").alias("kind"), F.col("mark").alias("key")))
    levels = F.array_compact(F.array(F.struct(F.lit("project").alias("kind"), F.col("project_code").alias("key")), stage, part))
    rows = ok.select(levels.alias("levels"), F.posexplode(levels).alias("i", "level"))
    path = lambda n: F.array_join(F.transform(F.slice("levels", 1, n), lambda x: F.concat_ws(":", x["kind"], x["key"])), "/")
    out = rows.select(path(F.col("i") + 1).alias("path"), F.when(F.col("i") > 0, path(F.col("i"))).alias("parent_path"), "level.kind", "level.key").distinct()
    return out.select(F.left(F.sha2("path", 256), F.lit(16)).alias("id"), F.left(F.sha2("parent_path", 256), F.lit(16)).alias("parent_id"), "kind", "key", "path")

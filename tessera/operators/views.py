"""Small operators of read models, artifacts and wide tables (A11, A12, A16, A18, A21, AR3-AR5, CV6, CV17, CV23-CV25, DM9, DM11, F10, F16, J11, J16, P2, P3, T4, T9, U5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import over_first


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """nulls of some columns as their defaults (64 and 20 pixels for sheets)."""
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def table_regions(regions: DataFrame) -> DataFrame:
    """F16: regions from which tables are reconstructed."""
    return regions.where((F.col("kind") == "table_candidate") & ~F.coalesce(F.col("reason").startswith("suppressed_"), F.lit(False)) & (F.col("confidence") >= 0.5))


def latest_texts(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates with the last text that was read of each."""
    last = texts.groupBy("candidate_id").agg(F.max_by("text", "pos").alias("text"))
    return candidates.join(last, "candidate_id", "left")


def first_match(identities: DataFrame, records: DataFrame) -> DataFrame:
    """Of each version's identities the typed record that its sources name, else the version's first estimate."""
    named = identities.select("version_id", F.explode("source_ids").alias("record_id")).join(records.select("record_id", F.lit(0).alias("rank")), "record_id")
    spare = records.where("family = 'estimate'").select("version_id", "record_id", F.lit(1).alias("rank"))
    both = named.select("version_id", "record_id", "rank").union(spare)
    return both.groupBy("version_id").agg(F.min_by("record_id", F.struct("rank", "record_id")).alias("record_id"))


def boxes(rows: DataFrame, by: str) -> DataFrame:
    """The common box of each group."""
    return rows.groupBy(by).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"))


def facet_options(rows: DataFrame, facets: list[str], chosen: dict[str, object]) -> DataFrame:
    """Values left to choose of each facet, given what is chosen of the others; null and empty ones are no choice."""
    out = None
    for facet in facets:
        some = rows
        for column, value in chosen.items():
            some = some if column == facet else some.where(F.col(column) == value)
        values = some.select(F.lit(facet).alias("facet"), F.col(facet).cast("string").alias("value")).where("value <> ''").distinct()
        out = values if out is None else out.union(values)
    return out


def totals_by(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Sum and largest value of each group."""
    return rows.groupBy(by).agg(F.sum(value).alias("total"), F.max(value).alias("most"))


def ordered_union(a: Column, b: Column) -> Column:
    """Elements of both in order, each once."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())))


def known_fields(fields: Column) -> Column:
    """AR4: a map without the entries that have no value."""
    return F.map_filter(fields, lambda _, v: v.isNotNull())


def field_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each field of a map, with its label, or its key where it has none."""
    flat = rows.select("id", F.explode(known_fields(F.col("fields"))).alias("key", "value"))
    return flat.join(F.broadcast(labels), "key", "left").select("id", "key", F.coalesce("label", "key").alias("label"), "value")


def reading_order(cells: DataFrame) -> DataFrame:
    """T4: the place of each cell of a table in reading order; equals keep the order they came in."""
    return cells.select("region", "id", F.row_number().over(Window.partitionBy("region").orderBy("row", "col", "id")).alias("place"))


def backfill(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """DM11/DM9: rows of an older schema with a column added and computed; rows that have it keep it."""
    return rows.withColumn(column, F.coalesce(F.col(column), value) if column in rows.columns else value)


def line_positions(coverage: DataFrame, threshold: float, gap: int = 4) -> DataFrame:
    """CV6: middles of the runs of places (grp, pos, share) whose covered share reaches the threshold; middles nearer than the gap to the one before count as one with it."""
    w = Window.partitionBy("grp").orderBy("pos")
    on = coverage.where(F.col("share") >= threshold).withColumn("new", F.when(F.col("pos") - F.lag("pos").over(w) == 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = on.groupBy("grp", "run").agg(F.bround((F.min("pos") + F.max("pos")) / 2).cast("long").alias("p"))
    v = Window.partitionBy("grp").orderBy("p")
    near = runs.withColumn("new", F.when(F.col("p") - F.lag("p").over(v) < gap, 0).otherwise(1)).withColumn("g", F.sum("new").over(v))
    middle = F.aggregate(F.slice(F.array_sort(F.collect_list("p")), 2, 100000), F.min("p"), lambda a, x: F.bround((a + x) / 2).cast("long"))
    return near.groupBy("grp", "g").agg(middle.alias("pos")).select("grp", "pos")


def kind_of(artifact: Column) -> Column:
    """CV17: artifact kinds by the names of the service contract."""
    out = artifact
    for name, kind in {"table_candidate": "REGION_KIND_TABLE", "stamp": "REGION_KIND_STAMP", "drawing_area": "REGION_KIND_DRAWING", "text_block": "REGION_KIND_TEXT"}.items():
        out = F.when(artifact == name, kind).otherwise(out)
    return F.when(out.startswith("REGION_"), out).otherwise("REGION_KIND_UNSPECIFIED")


def block_columns(blocks: DataFrame, columns: DataFrame, least: float = 0.25) -> DataFrame:
    """CV23: the columns (page, col, low, high) that a block covers for at least a share of itself; it may have several."""
    shared = F.least(F.col("x") + F.col("w"), F.col("high")) - F.greatest("x", "low")
    return blocks.join(columns, "page").where(shared / F.col("w") >= least).select("id", "page", "col")


def truncated(rows: DataFrame, separators: DataFrame, gap: int) -> DataFrame:
    """CV24: rows (page, i, y, b) up to the first gap over the limit in which a separator line lies."""
    w = Window.partitionBy("page").orderBy("i")
    wide = rows.withColumn("next", F.lead("y").over(w)).where(F.col("next") - F.col("b") > gap)
    cut = wide.join(separators.select("page", F.col("y").alias("line")), "page").where("line BETWEEN b AND next").groupBy("page").agg(F.min("i").alias("last"))
    return rows.join(cut, "page", "left").where("last is null OR i <= last").select("page", "i")


def text_regions(regions: DataFrame, tables: DataFrame, most: int = 80) -> DataFrame:
    """CV25/T9: text regions that are large enough, not square and dense, and not mostly inside a table, the first of each page in reading order."""
    good = regions.where((F.col("w") * F.col("h") >= 12) & ~((F.col("w") / F.col("h")).between(0.85, 1.18) & (F.col("density") > 0.6)))
    inside = (F.col("a.page") == F.col("b.page")) & (over_first("a", "b") > 0.65)
    left = good.alias("a").join(tables.alias("b"), inside, "left_anti")
    place = F.row_number().over(Window.partitionBy("page").orderBy("y", "x", "id"))
    return left.withColumn("r", place).where(F.col("r") <= most).select("page", "id", F.col("r").alias("place"))

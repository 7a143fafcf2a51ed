"""Spreadsheet cells: templates, sections, items, labels, grids (DO18-DO24, W1, W2, W5, M6, P1)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import number, search_text
from tessera.operators.tenancy import keyed

TITLES = ("локальный ресурсный сметный расчет", "локальный сметный расчет", "локальная смета")
LOCAL_HEADER = ("обоснование", "наименование", "единица", "количество")
RESOURCE_HEADER = ("обоснование", "наименование", "единица", "общее кол")
RESOURCE_TITLES = ("ведомость ресурсов", "ресурсы подрядчика")
GROUPS = ("трудозатраты", "машины и механизмы", "материалы")
INTEGER = r"^[0-9]+\z"


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def row_text() -> Column:
    """The text of a row's cells in their order, as an aggregate of (col, value)."""
    return F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: search_text(x["value"])))


def header_rows(cells: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """DO19: the first row of each sheet whose text has all labels."""
    rows = cells.groupBy(*keyed(cells, "sheet", "row")).agg(row_text().alias("t"))
    hit = rows
    for label in labels:
        hit = hit.where(F.col("t").contains(label))
    return hit.groupBy(*keyed(cells, "sheet")).agg(F.min("row").alias("header_row"))


def equals(word: str) -> Callable[[Column], Column]:
    return lambda t: t == word


def templates(cells: DataFrame) -> DataFrame:
    """DO18/A10: the best template of each sheet by weighted evidence: score, status, confidence, kind, method and the cells that speak for it.

    One pass over a sheet's rows: each row gives its first cell for every label, and whether it
    is a table's header; a sheet keeps the first of each.
    """
    keys = keyed(cells, "sheet")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: F.struct(x["col"].alias("col"), search_text(x["value"]).alias("t")))
    rows = cells.groupBy(*keys, "row").agg(listed.alias("cells"))
    rows = rows.withColumn("text", F.array_join(F.transform("cells", lambda x: x["t"]), " "))
    # fixed values: what each label weighs for its template
    labels = {
        "lt": ("title", 5, lambda t: any_of(t, TITLES)), "lsum": ("total_label", 3, lambda t: any_of(t, ("всего по смете", "итоги по смете"))), "lb": ("basis_label", 1, lambda t: t.startswith("основание")),
        "rt": ("title", 5, lambda t: any_of(t, RESOURCE_TITLES)), **{f"g{i}": ("resource_group", 1, equals(g)) for i, g in enumerate(GROUPS)}, "rsum": ("total_label", 2, lambda t: t.contains("всего по смете")),
    }

    def first(test) -> Column:
        return F.get(F.filter("cells", lambda x: test(x["t"])), 0)

    hits = [first(test).alias(name) for name, (_, _, test) in labels.items()]
    heads = [F.when(reduce(lambda a, b: a & b, [F.col("text").contains(w) for w in words]), F.slice("cells", 1, 4)).alias(name) for name, words in (("lh", LOCAL_HEADER), ("rh", RESOURCE_HEADER))]
    rows = rows.select(*keys, "row", *hits, *heads)
    earliest = lambda n: F.min_by(F.struct("row", F.col(n).alias("hit")), F.when(F.col(n).isNotNull(), F.col("row"))).alias(n)
    found = rows.groupBy(*keys).agg(*[earliest(n) for n in (*labels, "lh", "rh")])
    weigh = lambda names, head: reduce(lambda a, b: a + b, [F.when(F.col(n).isNotNull(), w).otherwise(0) for n, w in [*[(n, labels[n][1]) for n in names], (head, 4)]])
    at = lambda field, row, col: F.concat_ws(":", F.lit(field), row, col)
    one = lambda n: F.array(F.when(F.col(n).isNotNull(), at(labels[n][0], F.col(f"{n}.row"), F.col(f"{n}.hit.col"))))
    head = lambda n: F.coalesce(F.transform(F.col(f"{n}.hit"), lambda x: at("table_header", F.col(f"{n}.row"), x["col"])), F.array())
    evidence = lambda title, header, *rest: F.array_compact(F.concat(one(title), head(header), *[one(n) for n in rest]))
    title = F.col("lt.hit.t")
    kind = F.when(F.coalesce(title.contains("расчет"), F.lit(False)), "local_estimate_calculation").otherwise("local_estimate")
    method = F.when(F.coalesce(title.contains("ресурсный"), F.lit(False)), "resource").otherwise("unknown")
    groups = [f"g{i}" for i in range(len(GROUPS))]
    local = F.struct(F.lit("local_estimate").alias("template"), weigh(("lt", "lsum", "lb"), "lh").alias("score"), kind.alias("kind"), method.alias("method"), evidence("lt", "lh", "lsum", "lb").alias("evidence"))
    resource = F.struct(F.lit("resource_statement").alias("template"), weigh(("rt", *groups, "rsum"), "rh").alias("score"), F.lit("resource_statement").alias("kind"), F.lit("resource").alias("method"), evidence("rt", "rh", *groups, "rsum").alias("evidence"))
    rows = found.select(*keys, local.alias("l"), resource.alias("r")).select(*keys, F.when(F.col("r.score") > F.col("l.score"), F.col("r")).otherwise(F.col("l")).alias("b")).where("b.score >= 5").select(*keys, "b.*")
    return rows.withColumn("status", F.when(F.col("score") >= 10, "resolved").otherwise("ambiguous")).withColumn("confidence", F.when(F.col("score") >= 10, "high").when(F.col("score") >= 7, "medium").otherwise("low"))


def fill_sections(rows: DataFrame, marker: Column) -> DataFrame:
    """W2/DO20: each row with the marker of the last row at or above it that has one."""
    w = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(marker, ignorenulls=True).over(w))


def row_items(cells: DataFrame) -> DataFrame:
    """DO20/A11: cells of a row side by side, the last one of a column counting; rows without a number or a name are left out."""
    last = cells.groupBy("sheet", "row", "col").agg(F.max_by("value", "pos").alias("value"))
    wide = last.groupBy("sheet", "row").pivot("col", [1, 2, 3, 4, 5]).agg(F.first("value"))
    return wide.where("`1` is not null AND `2` is not null").select("sheet", "row", number(F.col("1")).alias("line"), F.col("2").alias("part"), number(F.col("4")).alias("quantity"), number(F.col("5")).alias("price"))


def section_totals(items: DataFrame) -> DataFrame:
    """DO20/DO21: sums by sheet and section."""
    return items.groupBy("sheet", "section").agg(F.count("*").alias("items"), F.round(F.sum("price"), 2).alias("price"))


def table_rows(cells: DataFrame, columns: int) -> DataFrame:
    """Rows below the first table header of each sheet, but for those that number columns: first text, the last cell of each column, largest and last number.

    cells: (sheet, row, col, value, pos); a sheet without a header is taken whole, and so are rows
    without a sheet. The header comes from a window over the rows themselves, so cells are read once.
    """
    keys = keyed(cells, "sheet")
    # below the aggregation, which would work them out for every mention; it gets by without lists, so that it is one pass over sorted cells
    text, integer = F.when(F.length("value") >= len("обоснование"), F.lower("value")), F.trim("value").rlike(INTEGER)
    digits = F.when(integer, F.ltrim(F.trim("value"), F.lit("0")))  # numbers of up to 38 digits
    cells = cells.withColumns({"_v": number(F.col("value")), "_basis": text.contains("обоснование"), "_name": text.contains("наименование"), "_integer": integer, "_digits": F.when(F.length(digits) <= 38, digits)})
    alike = F.lag("_digits").over(Window.partitionBy(*keys, "row").orderBy("_digits"))
    cells = cells.withColumn("_new", F.col("_digits").isNotNull() & ~F.col("_digits").eqNullSafe(alike))
    v = F.col("_v")
    place = F.struct("col", "pos")
    rows = cells.groupBy(*keys, "row").agg(
        F.trim(F.min_by("value", place)).alias("first"),
        *[F.max(F.when((F.col("col") == k) & F.col("pos").isNotNull(), F.struct("pos", "value")))["value"].alias(f"c{k}") for k in range(1, columns + 1)],
        F.max_by(v, F.when(v.isNotNull(), F.struct(F.abs(v).alias("size"), (-F.col("col")).alias("at")))).alias("largest"),
        F.max_by(v, F.when(v.isNotNull(), place)).alias("last"),
        ((F.count("*") >= 4) & (F.count_if("_integer") == F.count("*")) & (F.count_if("_new") >= 4)).alias("numbers"),
        (F.max("_basis") & F.max("_name")).alias("labels"),
    )
    header = F.col("labels") & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = rows.withColumn("header_row", F.min(F.when(header, F.col("row"))).over(Window.partitionBy(*keys)))
    rows = rows.where((F.col("row") > F.coalesce("header_row", F.lit(0))) & ~F.col("numbers")).drop("header_row", "numbers", "labels")
    return rows.withColumn("text", search_text(F.col("first")))


def filled(c: Column) -> Column:
    """The text with single spaces; null if it has none."""
    return F.trim(F.regexp_replace(F.when(c.rlike(r"\S"), c), r"\s+", " "))


def is_item(unit: str) -> Column:
    """A row with a whole number as its position, a name and a unit."""
    return F.trim("c1").rlike(INTEGER) & F.col("c3").rlike(r"\S") & F.col(unit).rlike(r"\S")


def local_estimate(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DO20: (sections, items) of local estimates.

    items: (sheet, section, row, position, basis, name, unit, quantity and six costs).
    sections: (sheet, section, section_number, title, items, overhead, estimated_profit,
    total_cost, warning); section 0 holds the items before the first heading. The last
    row of a section with a kind of total gives it, as the number of largest size; rows
    of the whole estimate and totals before anything else give none.
    """
    rows = table_rows(cells, 14)
    keys = keyed(cells, "sheet")
    heading = F.coalesce(F.col("first").rlike(r"(?iu)^раздел\s+(\d+)\.?\s*(.*)$"), F.lit(False))
    total = F.when(F.col("text").contains("накладные расходы"), "overhead").when(F.col("text").contains("сметная прибыль"), "estimated_profit").when(F.col("text").contains("итого"), "total_cost")
    item = ~heading & F.coalesce(is_item("c6"), F.lit(False))
    to_here = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("heading", heading).withColumn("item", item)
    rows = rows.withColumn("section", F.sum(F.col("heading").cast("int")).over(to_here)).withColumn("begun", F.max(F.col("item") | F.col("heading")).over(to_here))
    rows = rows.withColumn("total", F.when(~F.col("heading") & F.col("begun") & ~F.col("text").contains("по смете"), total))
    n = lambda k: number(F.col(f"c{k}"))
    costs = ("unit_cost", "total_cost", "labor_cost", "machine_cost", "machinist_labor_cost", "material_cost")
    items = rows.where("item").select(
        *keys, "section", "row", F.trim("c1").alias("position"), filled(F.col("c2")).alias("basis"), filled(F.col("c3")).alias("name"), filled(F.col("c6")).alias("unit"),
        number(F.coalesce("c8", "c7")).alias("quantity"), *[n(9 + i).alias(c) for i, c in enumerate(costs)],
    )
    of = lambda kind: F.max_by("largest", F.when((F.col("total") == kind) & F.col("largest").isNotNull(), F.col("row")))
    sections = rows.where("begun").groupBy(*keys, "section").agg(
        F.max(F.when(F.col("heading"), F.regexp_extract("first", r"(?iu)^раздел\s+(\d+)", 1))).alias("section_number"), F.max(F.when(F.col("heading"), filled(F.col("first")))).alias("title"),
        F.count_if("item").alias("items"), *[of(k).alias(k) for k in ("overhead", "estimated_profit", "total_cost")],
    )
    none = F.sum("items").over(Window.partitionBy(*keys)) == 0
    return sections.withColumn("warning", F.when(none, "local_estimate_items_missing")), items


def resource_statement(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DO21: (groups, resources) of resource statements.

    resources: (sheet, group, row, position, code, name, unit, quantity, unit_cost,
    total_cost). groups: (sheet, group, title, resources, total_cost, warning); a group begins
    with its title, its total is the last number of the last row that begins with a total
    and has one, and rows before the first group count nowhere.
    """
    rows = table_rows(cells, 7)
    keys = keyed(cells, "sheet")
    to_here = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("heading", F.col("text").isin(*GROUPS)).withColumn("total", F.col("text").startswith("итого"))
    rows = rows.withColumn("group", F.sum(F.col("heading").cast("int")).over(to_here)).where("group > 0")
    rows = rows.withColumn("item", ~F.col("heading") & ~F.col("total") & F.coalesce(is_item("c4"), F.lit(False)))
    n = lambda k: number(F.col(f"c{k}"))
    resources = rows.where("item").select(*keys, "group", "row", F.trim("c1").alias("position"), filled(F.col("c2")).alias("code"), filled(F.col("c3")).alias("name"), filled(F.col("c4")).alias("unit"), n(5).alias("quantity"), n(6).alias("unit_cost"), n(7).alias("total_cost"))
    groups = rows.groupBy(*keys, "group").agg(
        F.max(F.when(F.col("heading"), filled(F.col("first")))).alias("title"), F.count_if("item").alias("resources"), F.max_by("last", F.when(F.col("total") & F.col("last").isNotNull(), F.col("row"))).alias("total_cost")
    )
    none = F.sum("resources").over(Window.partitionBy(*keys)) == 0
    return groups.withColumn("warning", F.when(none, "resource_statement_rows_missing")), resources


def value_above(cells: DataFrame, label: str, rows: int = 4) -> DataFrame:
    """W5/DO22: above the first cell of each sheet with a label, in the nearest of four rows with text, the longest text without the label."""
    t = search_text(F.col("value"))
    at = cells.where(t.contains(label)).groupBy("sheet").agg(F.min(F.struct("row", "col")).alias("p")).select("sheet", F.col("p.row").alias("label_row"))
    near = cells.join(at, "sheet").where((F.col("row") < F.col("label_row")) & (F.col("row") >= F.col("label_row") - rows) & ~t.contains(label) & (t != "") & ~t.startswith("("))
    return near.groupBy("sheet").agg(F.max_by("value", F.struct("row", F.length("value"), -F.col("col"))).alias("value"))


def labeled_number(cells: DataFrame, label: str) -> DataFrame:
    """DO22/M6: in the row of the first cell with a label the number of largest size, the leftmost of equals."""
    at = cells.where(search_text(F.col("value")).contains(label)).groupBy("sheet").agg(F.min(F.struct("row", "col")).alias("p"))
    rows = cells.join(at.select("sheet", F.col("p.row").alias("row")), ["sheet", "row"]).withColumn("v", number(F.col("value"))).where("v is not null")
    return rows.groupBy("sheet").agg(F.max_by("v", F.struct(F.abs("v"), -F.col("col"))).alias("number"))


def grid(cells: DataFrame) -> DataFrame:
    """DO24/J16: rows of a sheet as one text, cells in column order; empty cells and those without a place are left out."""
    some = cells.where("value <> '' AND row > 0 AND col > 0")
    return some.groupBy("sheet", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]), "|").alias("cells"), F.count("*").alias("n"))


def densify(cells: DataFrame) -> DataFrame:
    """Every place of each sheet's used rectangle, empty where there is no cell."""
    size = cells.groupBy("sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    places = size.select("sheet", F.explode(F.sequence(F.lit(1), "rows")).alias("row"), "cols").select("sheet", "row", F.explode(F.sequence(F.lit(1), "cols")).alias("col"))
    return places.join(cells.select("sheet", "row", "col", "value"), ["sheet", "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit("")))

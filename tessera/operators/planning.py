"""What is read of a page, and by what: candidate planning (CV9, CV19, CV22, A19) and the text layer before an engine (CV11).

pages (doc, page, width, height, layout): layout is false where none was made.
regions (doc, page, region, kind, x, y, w, h, confidence, reason, pos): in the order of the layout.
crops (doc, page, region, candidate, i, rotation, x, y, w, h, confidence): cells with text that detection found in stamps and tables, in order.
wide (doc, page, region): tables that went into an inferred wide table; wide_crops as crops: that table's cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import has_centre, over_first
from tessera.operators.tenancy import keyed

# fixed values: where the sort orders of each kind of candidate begin
FIRST = {"stamp": 20_000, "table_candidate": 30_000, "wide": 35_000, "strip": 40_000, "text_page": 500}
# fixed values: sheets that are large drawings, and regions too large for them
LARGE_PX, LARGE_ASPECT = 5000, 1.80
# fixed values: text beside a drawing that runs along its border
STRIP_H, STRIP_ASPECT, STRIP_TOP, STRIP_REACH = 40, 1.45, 0.42, 0.08
#: Why regions are not read as a whole, kind by kind, in the order in which the rules are tried.
REASONS = (
    "oversized_large_drawing_stamp", "full_stamp_region", "wide_table_fragment", "oversized_large_drawing_table", "suppressed_table_candidate",
    "low_confidence_table_candidate", "full_table_region", "text_block", "drawing_area", "unsupported_region", "text_page_on_large_drawing",
)


def is_large(w: Column, h: Column) -> Column:
    return (w > LARGE_PX) | (h > LARGE_PX) | (F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1)) > LARGE_ASPECT)


def page_state(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Pages with what their regions' rules ask of them: whether they are large drawings, and their first stamp and drawing area."""
    key = keyed(pages, "doc", "page")
    first = lambda kind: F.min_by(F.struct("x", "w"), F.when(F.col("kind") == kind, F.col("pos")))
    found = regions.groupBy(*key).agg(first("stamp").alias("stamp"), first("drawing_area").alias("drawing"))
    return pages.where("layout").join(found, key, "left").withColumn("large", is_large(F.col("width"), F.col("height")))


def _is_strip() -> Column:
    """CV19: a tall text low on the page that begins left of the stamp and of the drawing's first part, on a page with both."""
    left = F.least("stamp.x", F.col("drawing.x") + F.col("drawing.w") * STRIP_REACH)
    tall = (F.col("w") > 0) & (F.col("h") >= STRIP_H) & (F.col("h") / F.col("w") >= STRIP_ASPECT)
    return F.col("stamp").isNotNull() & F.col("drawing").isNotNull() & tall & (F.col("x") <= left) & (F.col("y") >= F.col("height") * STRIP_TOP)


def routed(pages: DataFrame, regions: DataFrame, crops: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """CV9: every region of a page with a layout, with its reason, how many candidates it makes and how many the page has before it.

    The rules of a kind are tried in order; the first that holds decides. Stamps and tables
    that pass are read cell by cell, so their reason is that they are not read whole.
    """
    key = keyed(pages, "doc", "page")
    made = crops.groupBy(*key, "region").agg(F.count("*").alias("cells"))
    rows = regions.join(page_state(pages, regions), key).join(made, [*key, "region"], "left")
    if wide is None:
        rows = rows.withColumn("in_wide", F.lit(False))
    else:
        rows = rows.join(wide.select(*key, "region").distinct().withColumn("in_wide", F.lit(True)), [*key, "region"], "left")
    area, sheet = F.col("w") * F.col("h"), F.col("width") * F.col("height")
    broad = F.col("w") > F.col("width") * 0.45
    big_stamp = F.col("large") & (broad | (area > sheet * 0.12))
    big_table = F.col("large") & F.col("drawing").isNotNull() & ((area > sheet * 0.08) | (broad & (F.col("h") > F.col("height") * 0.20)))
    kind = F.col("kind")
    stamp = F.when(big_stamp, "oversized_large_drawing_stamp").otherwise("full_stamp_region")
    table = (
        F.when(F.coalesce("in_wide", F.lit(False)), "wide_table_fragment").when(big_table, "oversized_large_drawing_table").when(F.coalesce("reason", F.lit("")).startswith("suppressed_"), "suppressed_table_candidate")
        .when(F.col("confidence") < 0.50, "low_confidence_table_candidate").otherwise("full_table_region"))
    text = F.when(~F.coalesce(_is_strip(), F.lit(False)), "text_block")
    skip = F.when(kind == "stamp", stamp).when(kind == "table_candidate", table).when(kind == "text_block", text).when(kind == "drawing_area", "drawing_area").otherwise("unsupported_region")
    rows = rows.withColumn("skip", skip)
    whole = F.col("skip").isin("full_stamp_region", "full_table_region")
    rows = rows.withColumn("makes", F.when(F.col("skip").isNull(), 1).when(whole, F.coalesce("cells", F.lit(0))).otherwise(0))
    order = Window.partitionBy(*key).orderBy("pos", "region")
    return rows.withColumn("before", F.sum("makes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("makes"))


def _page_totals(pages: DataFrame, rows: DataFrame, wide_crops: DataFrame | None) -> DataFrame:
    """Each page with a layout: candidates of its regions, of its wide table, and the common box of its text blocks."""
    key, right, bottom = keyed(pages, "doc", "page"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    text = lambda f, c: f(F.when(F.col("kind") == "text_block", c))
    sums = rows.groupBy(*key).agg(F.sum("makes").alias("made"), F.count_if(F.col("kind") == "text_block").alias("blocks"), text(F.min, F.col("x")).alias("x"), text(F.min, F.col("y")).alias("y"), text(F.max, right).alias("r"), text(F.max, bottom).alias("b"))
    out = pages.where("layout").select(*key, "width", "height", is_large(F.col("width"), F.col("height")).alias("large")).join(sums, key, "left")
    if wide_crops is None:
        return out.withColumn("wide", F.lit(0))
    return out.join(wide_crops.groupBy(*key).agg(F.count("*").alias("wide")), key, "left")


def _text_pages(totals: DataFrame) -> DataFrame:
    """CV22: pages without any candidate, no large drawings, whose six or more text blocks fill a fair part of them, as one padded box."""
    share = (F.col("r") - F.col("x")) * (F.col("b") - F.col("y")) / (F.col("width") * F.col("height"))
    none = (F.coalesce("made", F.lit(0)) + F.coalesce("wide", F.lit(0))) == 0
    rows = totals.where(~F.col("large") & none & (F.col("blocks") >= 6) & (share >= 0.02) & (share <= 0.88))
    pad = F.greatest(F.lit(24), F.floor(F.least(F.col("r") - F.col("x"), F.col("b") - F.col("y")) * 0.025))
    low = lambda c: F.greatest(F.lit(0), F.bround(c) - pad).cast("double")
    high = lambda c, most: F.least(F.col(most), F.bround(c) + pad).cast("double")
    return rows.withColumns({"x1": low("x"), "y1": low("y"), "x2": high("r", "width"), "y2": high("b", "height")})


def candidates(pages: DataFrame, regions: DataFrame, crops: DataFrame, wide: DataFrame | None = None, wide_crops: DataFrame | None = None) -> DataFrame:
    """CV9: (doc, page, candidate, kind, region, sort_order, rotation, confidence, x, y, w, h) of all that is to be read.

    Cells of a stamp or table are numbered within it; texts along the border by what the page
    has before them; a wide table's cells after all of these.
    """
    key = keyed(pages, "doc", "page")
    rows = routed(pages, regions, crops, wide)
    box = ("x", "y", "w", "h")

    def numbered(cells: DataFrame, first: Column, by: str, kind: Column) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*key, *([by] if by else [])).orderBy("i", "candidate")) - 1
        return cells.select(*key, "candidate", kind.alias("kind"), "region", (first + n).cast("long").alias("sort_order"), "rotation", "confidence", *box)

    read = rows.where("skip IN ('full_stamp_region', 'full_table_region')").select(*key, "region", F.col("kind").alias("of"))
    out = numbered(crops.join(read, [*key, "region"]), F.when(F.col("of") == "stamp", FIRST["stamp"]).otherwise(FIRST["table_candidate"]), "region", F.when(F.col("of") == "stamp", "stamp_cell_candidate").otherwise("table_cell_candidate"))
    inset = F.least(F.when(F.col("w") >= 78, 17.0).otherwise(4.0), F.greatest(F.lit(0.0), (F.col("w") - 1) / 2))
    x1, y1 = F.greatest(F.lit(0.0), F.col("x") + inset), F.greatest(F.lit(0.0), F.col("y") - 6)
    x2, y2 = F.least(F.col("width").cast("double"), F.col("x") + F.col("w") - inset), F.least(F.col("height").cast("double"), F.col("y") + F.col("h") - 4)
    strips = rows.where("skip is null").select(
        *key, F.concat("region", F.lit("-side-strip")).alias("candidate"), F.lit("side_strip_candidate").alias("kind"), "region", (FIRST["strip"] + F.col("before")).cast("long").alias("sort_order"), F.lit(270).alias("rotation"),
        F.greatest(F.lit(0.30), F.least(F.lit(0.75), F.col("confidence"))).alias("confidence"), x1.alias("x"), y1.alias("y"), F.greatest(F.lit(1.0), x2 - x1).alias("w"), F.greatest(F.lit(1.0), y2 - y1).alias("h"))
    totals = _page_totals(pages, rows, wide_crops)
    whole = _text_pages(totals).select(
        *key, F.concat(F.lit("page-"), F.col("page").cast("string"), F.lit("-text-page")).alias("candidate"), F.lit("text_page").alias("kind"), F.lit("").alias("region"), F.lit(FIRST["text_page"]).cast("long").alias("sort_order"), F.lit(0).alias("rotation"),
        F.least(F.lit(0.80), 0.35 + F.col("blocks") * 0.025).alias("confidence"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    out = out.union(strips).union(whole)
    if wide_crops is None:
        return out
    base = totals.select(*key, (FIRST["wide"] + F.coalesce("made", F.lit(0))).alias("base"))
    return out.union(numbered(wide_crops.join(base, key), F.col("base"), "", F.lit("table_cell_candidate")))


def skip_counts(pages: DataFrame, regions: DataFrame, crops: DataFrame, wide: DataFrame | None = None, wide_crops: DataFrame | None = None) -> DataFrame:
    """(doc, page, reason, n): how many regions of a page were not read whole, by reason; a large drawing without a text page counts as one."""
    key = keyed(pages, "doc", "page")
    rows = routed(pages, regions, crops, wide)
    large = pages.where("layout").where(is_large(F.col("width"), F.col("height"))).select(*key, F.lit("text_page_on_large_drawing").alias("reason"), F.lit(1).cast("long").alias("n"))
    return rows.where("skip is not null").groupBy(*key, F.col("skip").alias("reason")).agg(F.count("*").alias("n")).union(large)


def page_reports(pages: DataFrame, planned: DataFrame, skipped: DataFrame) -> DataFrame:
    """(doc, page, code, candidates, skipped): each page's outcome, with its reasons and their counts as a map; pages without a layout are named so."""
    key = keyed(pages, "doc", "page")
    made = planned.groupBy(*key).agg(F.count("*").alias("candidates"))
    why = skipped.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("skipped"))
    rows = pages.join(made, key, "left").join(why, key, "left")
    code = F.when(F.col("layout"), "ocr_candidates_planned").otherwise("ocr_candidates_skipped_no_layout")
    return rows.select(*key, code.alias("code"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("skipped", F.create_map().cast("map<string,bigint>")).alias("skipped"))


# -- the text layer first ------------------------------------------------------------------------------


def words_of_candidates(asked: DataFrame, words: DataFrame, tile: int = 200) -> DataFrame:
    """J12 for candidates: each with every word of its page that lies half in its box or has its centre there.

    Both sides are listed by the tiles of the page that they touch; a pair counts at its first shared tile.
    """
    page = keyed(asked, "doc", "page")

    def tiled(df: DataFrame) -> DataFrame:
        span = lambda a, s: F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(a) + F.col(s)) / tile)))
        return df.withColumn("tx", span("x", "w")).withColumn("ty", span("y", "h"))

    a, b = tiled(words).alias("a"), tiled(asked).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*page, "tx", "ty")]
    here = (F.floor(F.greatest("a.x", "b.x") / tile) == F.col("a.tx")) & (F.floor(F.greatest("a.y", "b.y") / tile) == F.col("a.ty"))
    on = here & ((over_first("a", "b") >= 0.5) | has_centre("b", "a"))
    for s in same:
        on = on & s
    return a.join(b, on).select(*[F.col(f"b.{k}") for k in page], "b.candidate", *[F.col(f"a.{k}") for k in ("block", "line", "word")], F.col("a.x").alias("x"), "a.text")


def layer_texts(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, page, candidate, text, words) of candidates whose words say something, in order of block, line, word and place; a line without any letter is left out."""
    key = keyed(asked, "doc", "page", "candidate")
    line = words_of_candidates(asked, words).groupBy(*key, "block", "line").agg(F.array_sort(F.collect_list(F.struct("word", "x", "text"))).alias("w"))
    said = line.withColumn("t", F.array_join(F.transform("w", lambda v: v["text"]), " "))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("block", "line", "t")))), lambda v: v["t"])
    out = said.groupBy(*key).agg(F.regexp_replace(F.array_join(ordered, " "), r"^\s+|\s+$", "").alias("text"), F.sum(F.size("w")).cast("long").alias("words"))
    return out.where("text <> ''")


def text_layer_first(asked: DataFrame, words: DataFrame) -> DataFrame:
    """CV11: candidates (doc, page, region, candidate, kind, hypothesis, x, y, w, h) with their route, and text if the layer has one.

    ``text_layer``: an upright candidate, or one along the border, whose words say something.
    ``suppressed``: a turned reading of a box that the layer has answered (same kind, region and
    rounded box). ``engine``: all others.
    """
    key = keyed(asked, "doc", "page", "candidate")
    turned = ~F.coalesce("hypothesis", F.lit("")).isin("", "original")
    open_ = asked.where((F.col("kind") == "side_strip_candidate") | ~turned)
    rows = asked.join(layer_texts(open_, words), key, "left").withColumn("turned", turned)
    place = [*keyed(asked, "doc", "page", "kind", "region"), *[F.bround(c).alias(f"_{c}") for c in ("x", "y", "w", "h")]]
    names = [*keyed(asked, "doc", "page", "kind", "region"), "_x", "_y", "_w", "_h"]
    known = rows.where("text is not null").select(*place).distinct().withColumn("known", F.lit(True))
    rows = rows.withColumns({f"_{c}": F.bround(c) for c in ("x", "y", "w", "h")}).join(known, names, "left")
    route = F.when(F.col("text").isNotNull(), "text_layer").when(F.col("turned") & F.coalesce("known", F.lit(False)), "suppressed").otherwise("engine")
    return rows.select(*asked.columns, route.alias("route"), "text", F.coalesce("words", F.lit(0)).alias("words"))


def read_candidates(asked: DataFrame, words: DataFrame, engine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """CV11/CV12: (doc, page, candidate, source, text, confidence) of everything that was read, by the layer or by the engine.

    The engine gets the candidates that the layer leaves and returns (doc, page, candidate,
    text, confidence); without one only the layer's texts come back.
    """
    key = keyed(asked, "doc", "page", "candidate")
    rows = text_layer_first(asked, words)
    layer = rows.where("route = 'text_layer'").select(*key, F.lit("pdf-text-layer").alias("source"), "text", F.lit(1.0).alias("confidence"))
    if engine is None:
        return layer
    rest = rows.where("route = 'engine'").select(*asked.columns)
    return layer.union(engine(rest).select(*key, F.lit("engine").alias("source"), "text", F.col("confidence").cast("double").alias("confidence")))

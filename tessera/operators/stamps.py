"""Where a sheet's stamp is: rectangles between its lines, searched and scored (CV18, T6).

pages (doc, page, width, height, dpi); lines (doc, page, axis, pos, low, high, thick): an ``h``
line stands at y = pos from x = low to high, a ``v`` line at x = pos from y = low to high, a
line is thick pixels wide; areas (doc, page, x, y, w, h): a page's drawing area, if it has one.
Coverage, crossings and density, which pixel masks give elsewhere, come from the lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tenancy import keyed

# fixed values: the form's size in millimetres, and where and how far from it a stamp is looked for
FORM_W, FORM_H = 185.0, 55.0
SEARCH_X, SEARCH_Y, SEARCH_COVER = 0.30, 0.50, 0.03
EDGE_SHARE, EDGE_PX, EDGES = 0.055, 140, 4
SPAN_LEAST, SPAN_MOST = 0.55, 1.80
HEIGHT, TOPS = (0.045, 0.30), 12
WIDTH, LEFTS = (0.10, 0.70), 16
ASPECT, AREA = (1.6, 6.2), (0.001, 0.09)
# fixed values: what a rectangle's lines must give, and how the score weighs them
LEAST_GRID, LEAST_EDGE, LEAST_LINES, LEAST_DENSITY, COVER = 0.34, 0.18, 4, 0.010, 0.30
BASE, BY_GRID, BY_EDGE, BY_DENSITY, BY_PLACE, BY_ASPECT, BY_LINES = 0.28, 0.30, 0.16, 4.0, 0.18, 0.22, 0.12


def nearest(rows: DataFrame, keys: list[str], off: Column, ties: list[Column], limit: int) -> DataFrame:
    """Of each group the rows that are least off, at most ``limit``; ties in the order given."""
    w = Window.partitionBy(*keys).orderBy(off, *ties)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit).drop("_rank")


def frames(pages: DataFrame, areas: DataFrame) -> DataFrame:
    """The page and its drawing area, where that is another rectangle, each with its search corner and the form's size in pixels."""
    key = keyed(pages, "doc", "page")
    px = lambda mm: F.greatest(F.lit(1), F.bround(mm * F.col("dpi") / 25.4))
    sheet = pages.withColumns({"form_w": px(FORM_W), "form_h": px(FORM_H)})
    whole = sheet.withColumns({"n": F.lit(0), "fx": F.lit(0.0), "fy": F.lit(0.0), "fw": F.col("width").cast("double"), "fh": F.col("height").cast("double")})
    inner = sheet.join(areas.select(*key, F.lit(1).alias("n"), *[F.floor(c).cast("double").alias(f"f{c}") for c in ("x", "y", "w", "h")]), key).where("NOT (fx = 0 AND fy = 0 AND fw = width AND fh = height)")
    rows = whole.unionByName(inner)
    corner = lambda f, s, share, most: (F.greatest(F.lit(0), F.col(f) + F.floor(F.col(s) * share)), F.least(F.col(most), F.col(f) + F.floor(F.col(s) * share) + F.greatest(F.lit(1), F.floor(F.col(s) * (1.0 - share)))))
    (x0, x1), (y0, y1) = corner("fx", "fw", SEARCH_X, "width"), corner("fy", "fh", SEARCH_Y, "height")
    return rows.withColumns({"sx": x0.cast("double"), "sy": y0.cast("double"), "ex": x1.cast("double"), "ey": y1.cast("double")}).where("sx < ex AND sy < ey")


def boundaries(frame: DataFrame, lines: DataFrame) -> DataFrame:
    """(…frame, top, bottom, left, right): rectangles worth scoring.

    In a frame with four lines of each axis in its corner: the four lowest lines near its
    bottom, for each the twelve whose distance is nearest the form's height; the four
    rightmost near its right edge, for each the sixteen nearest the form's width. So a frame
    has 3,072 rectangles at most, however many lines there are.
    """
    key = keyed(frame, "doc", "page")
    each = [*key, "n"]
    share = F.greatest(F.least("high", F.when(F.col("axis") == "h", F.col("ex")).otherwise(F.col("ey"))) - F.greatest("low", F.when(F.col("axis") == "h", F.col("sx")).otherwise(F.col("sy"))), F.lit(0))
    across = F.when(F.col("axis") == "h", F.col("ex") - F.col("sx")).otherwise(F.col("ey") - F.col("sy"))
    inside = F.when(F.col("axis") == "h", (F.col("pos") >= F.col("sy")) & (F.col("pos") < F.col("ey"))).otherwise((F.col("pos") >= F.col("sx")) & (F.col("pos") < F.col("ex")))
    near = frame.join(lines, key).where(inside & (share / across >= SEARCH_COVER)).select(*frame.columns, "axis", "pos").distinct()
    both = Window.partitionBy(*each)
    near = near.withColumns({a: F.count_if(F.col("axis") == a).over(both) for a in "hv"}).where("h >= 4 AND v >= 4").drop("h", "v")

    def sides(axis: str, end: Column, most: str, form: str, span: tuple[float, float], size: str, limit: int, start: str) -> DataFrame:
        mine = near.where(F.col("axis") == axis).drop("axis")
        gap = end - F.col("pos")
        last = nearest(mine.where((gap >= 0) & (gap <= F.greatest(F.col(most) * EDGE_SHARE, F.lit(EDGE_PX)))), each, -F.col("pos"), [], EDGES).withColumnRenamed("pos", "edge")
        pairs = last.join(mine.select(*each, "pos"), each)
        length = F.col("edge") - F.col("pos")
        fits = (length >= F.greatest(F.col(size) * span[0], F.col(form) * SPAN_LEAST)) & (length <= F.least(F.col(size) * span[1], F.col(form) * SPAN_MOST))
        return nearest(pairs.where(fits), [*each, "edge"], F.abs(length - F.col(form)), [F.col("pos")], limit).where(F.col("pos") >= F.col(start))

    rows = sides("h", F.col("fy") + F.col("fh"), "height", "form_h", HEIGHT, "fh", TOPS, "sy").withColumnsRenamed({"edge": "bottom", "pos": "top"})
    cols = sides("v", F.col("fx") + F.col("fw"), "width", "form_w", WIDTH, "fw", LEFTS, "sx").select(*each, F.col("edge").alias("right"), F.col("pos").alias("left"))
    rect = rows.join(cols, each)
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    sheet = F.col("width") * F.col("height")
    return rect.where((w / F.greatest(h, F.lit(1))).between(*ASPECT) & (w * h >= sheet * AREA[0]) & (w * h <= sheet * AREA[1]))


def _clipped(lines: str, first: Column, last: Column, low: Column, high: Column) -> Column:
    """Lines of an array between two places, cut to a stretch."""
    inside = F.filter(F.col(lines), lambda s: s["pos"].between(first, last) & (s["high"] >= low) & (s["low"] <= high))
    return F.transform(inside, lambda s: F.struct(s["pos"].alias("pos"), F.greatest(s["low"], low).alias("low"), F.least(s["high"], high).alias("high"), s["thick"].alias("thick")))


def scored(rect: DataFrame, lines: DataFrame) -> DataFrame:
    """Rectangles with their score; those whose lines make no grid or no border are left out."""
    key = keyed(rect, "doc", "page")
    of = lambda a: F.array_sort(F.collect_list(F.when(F.col("axis") == a, F.struct(*[F.col(c).cast("double").alias(c) for c in ("pos", "low", "high", "thick")]))))
    page = lines.groupBy(*key).agg(of("h").alias("hs"), of("v").alias("vs"))
    top, bottom, left, right = map(F.col, ("top", "bottom", "left", "right"))
    w, h = right - left, bottom - top
    rows = rect.join(page, key).withColumns({"hs": _clipped("hs", top, bottom, left, right), "vs": _clipped("vs", left, right, top, bottom), "w": w, "h": h})
    count = lambda a, size: F.size(F.filter(F.col(a), lambda s: (s["high"] - s["low"]) / F.col(size) >= COVER))
    meets = lambda s: F.size(F.filter("vs", lambda t: t["pos"].between(s["low"] - 1, s["high"] + 1) & s["pos"].between(t["low"] - 1, t["high"] + 1)))
    crossings = F.aggregate("hs", F.lit(0), lambda n, s: n + meets(s))
    area = lambda a, keep: F.aggregate(F.filter(F.col(a), keep), F.lit(0.0), lambda n, s: n + (s["high"] - s["low"]) * s["thick"])
    band_y, band_x = F.greatest(F.lit(2), F.floor(F.col("h") / 18)), F.greatest(F.lit(2), F.floor(F.col("w") / 18))
    ends = [
        area("hs", lambda s: s["pos"] < top + band_y) / (band_y * F.col("w")), area("hs", lambda s: s["pos"] >= bottom - band_y) / (band_y * F.col("w")),
        area("vs", lambda s: s["pos"] < left + band_x) / (band_x * F.col("h")), area("vs", lambda s: s["pos"] >= right - band_x) / (band_x * F.col("h"))]
    rows = rows.withColumns({"lines_h": count("hs", "w"), "lines_v": count("vs", "h"), "crossings": crossings, "edge_score": F.least(F.lit(1.0), reduce(lambda a, b: a + b, ends) / 0.36), "ink": area("hs", lambda s: F.lit(True)) + area("vs", lambda s: F.lit(True))})
    capped = lambda c, most: F.least(F.lit(1.0), F.col(c) / most)
    rows = rows.withColumns({"grid_score": capped("lines_h", 4.0) * 0.30 + capped("lines_v", 3.0) * 0.30 + capped("crossings", 8.0) * 0.40, "density": F.least(F.lit(1.0), F.col("ink") / (F.col("w") * F.col("h")))})
    good = rows.where((F.col("grid_score") >= LEAST_GRID) & (F.col("edge_score") >= LEAST_EDGE) & (F.col("lines_h") >= LEAST_LINES) & (F.col("lines_v") >= LEAST_LINES) & (F.col("density") >= LEAST_DENSITY))
    gap = lambda end, place, size: F.greatest(F.lit(0.0), end - place) / F.col(size) * 8.0
    place = F.greatest(F.lit(0.0), 1.0 - gap(F.col("fx") + F.col("fw"), right, "width") - gap(F.col("fy") + F.col("fh"), bottom, "height"))
    aspect = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("w") / F.col("h") - FORM_W / FORM_H) / 2.4)
    many = F.least(F.lit(1.0), (F.col("lines_h") + F.col("lines_v")) / 18.0)
    score = BASE + F.col("grid_score") * BY_GRID + F.col("edge_score") * BY_EDGE + F.col("density") * BY_DENSITY + place * BY_PLACE + aspect * BY_ASPECT + many * BY_LINES
    return good.select(*key, "n", "left", "top", "right", "bottom", F.round(score, 9).alias("score"))


def find_stamps(pages: DataFrame, lines: DataFrame, areas: DataFrame) -> DataFrame:
    """CV18: (doc, page, left, top, right, bottom, score): each page's best rectangle; pages without a good one have none.

    Of equal scores the page's own frame wins, then the lowest, the rightmost, the higher top and the further left one.
    """
    key = keyed(pages, "doc", "page")
    rows = scored(boundaries(frames(pages, areas), lines), lines)
    first = F.struct(-F.col("score"), F.col("n"), -F.col("bottom"), -F.col("right"), F.col("top"), F.col("left"))
    best = rows.groupBy(*key).agg(F.min_by(F.struct("left", "top", "right", "bottom", "score"), first).alias("b"))
    return best.select(*key, "b.*")

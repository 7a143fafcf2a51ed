"""Page geometry and tables (J12, J15, J17, W3, W4, W6-W9, A14-A17, CV3-CV6, CV8-CV16, CV18-CV22)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import has_centre, over_first


#: So many ids of equal boxes, about, stand in one list; two lists meet as one row.
BOX_LIST = 1024


def words_in_crops(words: DataFrame, crops: DataFrame, tile: int = 50) -> DataFrame:
    """J12/CV11: words that lie half in a crop of their page or have their centre in it.

    Equal boxes are one class, and only classes are compared: both sides are listed by the tiles of
    the page that they touch, and a pair counts at the tile of its first shared corner. The ids of a class
    stand in lists of bounded length; each list of words meets each list of crops, wherever that pair
    falls, and only there becomes a row for every word and crop.
    """
    box = ["page", "x", "y", "w", "h"]

    def tiled(df: DataFrame) -> DataFrame:
        span = lambda a, s: F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(a) + F.col(s)) / tile)))
        return df.withColumn("tx", span("x", "w")).withColumn("ty", span("y", "h"))

    def classes(df: DataFrame, side: str) -> DataFrame:
        n = df.where("page is not null").groupBy(*box).agg(F.ceil(F.count("*") / BOX_LIST).alias("lists"))
        return n.select(*box, F.struct(*box).alias(side), F.col("lists").alias(f"{side}_lists"))

    def lists(df: DataFrame, classes: DataFrame, side: str) -> DataFrame:
        rows = df.select(F.struct(*box).alias(side), "id", F.xxhash64(*df.columns).alias("mix"))
        rows = rows.join(classes.select(side, f"{side}_lists"), side).withColumn(f"{side}_list", F.pmod("mix", f"{side}_lists"))
        return rows.groupBy(side, f"{side}_list").agg(F.collect_list(F.struct("id"))["id"].alias(f"{side}_ids"))  # null ids stay

    word, crop = classes(words, "word"), classes(crops, "crop")
    a, b = tiled(word).alias("a"), tiled(crop).alias("b")
    on = (F.col("a.page") == F.col("b.page")) & (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty"))
    here = (F.floor(F.greatest("a.x", "b.x") / tile) == F.col("a.tx")) & (F.floor(F.greatest("a.y", "b.y") / tile) == F.col("a.ty"))
    hit = (over_first("a", "b") >= 0.5) | has_centre("b", "a")
    met = a.join(b, on & here & hit).select("word", "crop", "word_lists", "crop_lists")
    each = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{side}_lists") - 1))
    met = met.withColumn("word_list", each("word")).withColumn("crop_list", each("crop")).drop("word_lists", "crop_lists")
    met = met.join(lists(words, word, "word"), ["word", "word_list"]).join(lists(crops, crop, "crop"), ["crop", "crop_list"])
    # dealt evenly: pairs of lists are few and short, and each stands for many rows
    met = met.select("word_ids", "crop_ids").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.select("word_ids", F.explode("crop_ids").alias("crop")).select("crop", F.explode("word_ids").alias("word"))


def line_text(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of each group in order of block, line, place; spaces between words and lines."""
    w = F.array_sort(F.collect_list(F.struct("block", "line", "x", "id", "text")))
    return words.groupBy(*keys).agg(F.array_join(F.transform(w, lambda v: v["text"]), " ").alias("text"))


def column_of(values: DataFrame, edges: DataFrame) -> DataFrame:
    """The interval of each value between the edges of its group, the last one closed on both sides."""
    w = Window.partitionBy("grp").orderBy("edge")
    spans = edges.withColumn("i", F.row_number().over(w) - 1).withColumn("high", F.lead("edge").over(w)).where("high is not null")
    spans = spans.withColumn("last", F.lead("i").over(w).isNull())
    on = (values["grp"] == spans["grp"]) & (F.col("v") >= F.col("edge")) & ((F.col("v") < F.col("high")) | (F.col("last") & (F.col("v") == F.col("high"))))
    return values.join(spans, on).select("id", "v", F.col("i").alias("column_index"))


def islands(positions: DataFrame, gap: int) -> DataFrame:
    """W3/CV6: runs of positions without a gap over the limit, each with its ends, middle and size."""
    w = Window.partitionBy("grp").orderBy("pos")
    flag = F.when(F.col("pos") - F.lag("pos").over(w) <= gap, 0).otherwise(1)
    rows = positions.select("grp", "pos").distinct().withColumn("new", flag).withColumn("island", F.sum("new").over(w))
    return rows.groupBy("grp", "island").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("n")).withColumn("middle", F.bround((F.col("low") + F.col("high")) / 2).cast("long"))


def without_containers(rects: DataFrame, page_area: int, tiles: int = 16) -> DataFrame:
    """CV4: rectangles but the large ones that hold nearly all of a clearly smaller one of their page.

    Equal boxes of a page are one class, with the least and the largest of their ids. A box that is held
    has its centre in the holder, so classes meet by the one tile of that centre and the tiles that the
    holder touches; what lies outside the page counts to its outermost tiles.
    """
    box, tile = ["page", "x", "y", "w", "h"], page_area**0.5 / tiles
    area = lambda t: F.col(f"{t}.w") * F.col(f"{t}.h")
    at = lambda c: F.floor(F.least(F.greatest(c / tile, F.lit(-1)), F.lit(tiles)))
    span = lambda a, s: F.explode(F.sequence(at(F.col(a)), at(F.col(a) + F.col(s))))
    classes = rects.where("id is not null AND w * h > 0").groupBy(*box).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    a = classes.where(F.col("w") * F.col("h") >= 0.08 * page_area).where("w > 0").withColumn("tx", span("x", "w")).withColumn("ty", span("y", "h")).alias("a")
    b = classes.where("w > 0").withColumn("tx", at(F.col("x") + F.col("w") / 2)).withColumn("ty", at(F.col("y") + F.col("h") / 2)).alias("b")
    on = (F.col("a.page") == F.col("b.page")) & (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty"))
    holds = (area("b") < 0.72 * area("a")) & (over_first("b", "a") >= 0.92)
    held = a.join(b, on & holds).groupBy(*[F.col(f"a.{c}").alias(c) for c in box]).agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))
    out = rects.join(held, box, "left").where(F.col("low").isNull() | F.col("id").isNull() | ((F.col("low") == F.col("id")) & (F.col("high") == F.col("id"))))
    return out.select("id")


def text_mark() -> Column:
    """CV5: kind and reason of a text region (x, y, w, h, density) of a page (width, height): the first mark that fits, else a text block.

    A square of some size low on the right; a mark at the top left; a small one at an edge.
    """
    x, y, w, h, density, width, height = map(F.col, ("x", "y", "w", "h", "density", "width", "height"))
    # fixed values: shares of the page and pixels that tell marks from text
    area, sheet, aspect = w * h, width * height, w / F.greatest(h, F.lit(1.0))
    square = (x > width * 0.68) & (y > height * 0.70) & (area > sheet * 0.0008) & aspect.between(0.65, 1.45) & (density >= 0.08)
    brand = (x <= width * 0.43) & (x + w <= width * 0.43) & (y <= height * 0.13) & (w >= width * 0.015) & (h >= height * 0.0025) & ((area > sheet * 0.000015) | (density >= 0.08))
    edge = (y < height * 0.035) | (y + h > height * 0.965) | (x < width * 0.035) | (x + w > width * 0.965)
    small = edge & (area <= sheet * 0.00012) & (w <= 90) & (h <= 32)
    mark = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    return F.when(square, mark("service_mark", "bottom_right_square_mark")).when(brand, mark("logo_or_mark", "title_page_top_left_mark")).when(small, mark("service_mark", "page_edge_service_mark")).otherwise(mark("text_block", ""))


def quality_gate(candidates: DataFrame, texts: DataFrame, by: str) -> DataFrame:
    """Statuses of the texts of gated candidates (no rotated ones) counted, the ones without text, and the verdict."""
    gate = candidates.withColumn("_in", F.col("rotation") == 0)
    rows = gate.join(texts.select("id", "status"), "id", "left")
    n = lambda c: F.count_if(F.col("_in") & c)
    out = rows.groupBy(by).agg(
        F.count("*").alias("planned"), F.count_if("_in").alias("gated"), n(F.col("status") == "recognized").alias("recognized"), n(F.col("status") == "recognized_low_confidence").alias("low"),
        n(F.col("status") == "recognized_suspicious").alias("suspicious"), n(F.col("status") == "empty_text").alias("empty"), n(F.col("status").isNull()).alias("missing"),
    )
    verdict = F.when(F.col("gated") == 0, "skipped").when(F.col("missing") > 0, "partial").when(F.col("low") + F.col("suspicious") + F.col("empty") > 0, "needs_review").otherwise("passed")
    return out.withColumn("verdict", verdict)


def trim_grid(cells: DataFrame, keep: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """CV15/W6/W7/A17: grids (grp, row, col, height, evidence, and columns to keep) without empty leading columns, without rows from the first tall blank or sparse blank one on, without tall blank rows at the end; row and column numbers closed up.

    All steps are windows over one exchange by grid, or none if the cells are dealt out by the
    columns that grp holds within (its document, say).
    """
    grid, line = Window.partitionBy(*within, "grp"), Window.partitionBy(*within, "grp", "row")
    kept = cells.withColumn("_first", F.min(F.when(F.col("evidence"), F.col("col"))).over(grid)).where("col >= _first")
    rows = kept.withColumns({"_h": F.max("height").over(line), "_seen_here": F.max("evidence").over(line), "_n": F.count("*").over(line), "_lead": F.row_number().over(line.orderBy("col")) == 1})
    usual = lambda c: F.percentile(F.when(F.col("_lead") & F.col("_seen_here"), F.col(c)), 0.5).over(grid)
    rows = rows.withColumns({"_usual_h": usual("_h"), "_usual_n": usual("_n"), "_seen": F.max("evidence").over(grid.orderBy("row"))})
    blank = F.col("_seen") & ~F.col("_seen_here")
    sparse = blank & (F.col("_usual_n") >= 3) & (F.col("_n") < 0.55 * F.col("_usual_n"))
    tall = blank & (F.col("_h") > 1.8 * F.col("_usual_h"))
    left = rows.withColumn("_stop", F.min(F.when(sparse | tall, F.col("row"))).over(grid)).where("_stop is null OR row < _stop")
    number = lambda c: F.dense_rank().over(grid.orderBy(c)) - 1
    return left.select("grp", "row", "col", *keep, number("row").alias("row_index"), number("col").alias("column_index"))


def stamp_template(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """CV8/T6/M4: the stamp template of each region whose anchors are all met: the share of lines near their middle decides.

    lines (region, pos); anchors (template, anchor, low, high) in the order they must stand.
    """
    on = F.col("pos").between(F.col("low"), F.col("high"))
    off = F.abs(F.col("pos") - (F.col("low") + F.col("high")) / 2)
    near = lines.join(F.broadcast(anchors), on).groupBy("region", "template", "anchor").agg(F.min_by(F.struct("pos", off.alias("off")), F.struct(off.alias("o"), "pos")).alias("p"))
    need = anchors.groupBy("template").agg(F.count("*").alias("need"))
    w = Window.partitionBy("region", "template").orderBy("anchor")
    near = near.withColumn("rising", F.coalesce(F.col("p.pos") > F.lag("p.pos").over(w), F.lit(True)))
    met = near.groupBy("region", "template").agg(F.count("*").alias("met"), F.bool_and("rising").alias("rising"), F.round(1 / (1 + F.avg("p.off")), 4).alias("score"))
    good = met.join(F.broadcast(need), "template").where("met = need AND rising")
    return good.groupBy("region").agg(F.max_by(F.struct("template", "score"), F.struct("score", "template")).alias("b")).select("region", "b.template", "b.score")


def cell_candidates(cells: DataFrame, cap: int = 240) -> DataFrame:
    """CV20/T9: of the first cells of each region (the cap comes before the filter) those with enough text, tall ones with two turned readings beside the plain one."""
    w = Window.partitionBy("region").orderBy("row", "col", "id")
    some = cells.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= cap) & (F.col("text_px") >= 40))
    turned = F.when(F.col("h") >= 1.45 * F.col("w"), F.array(F.lit(0), F.lit(90), F.lit(270))).otherwise(F.array(F.lit(0)))
    return some.select("id", "region", F.explode(turned).alias("rotation"))


def fields_by_position(cells: DataFrame, spec: DataFrame) -> DataFrame:
    """CV21/J17: stamp fields all of whose cells are there with text (relational division)."""
    need = spec.groupBy("field").agg(F.count("*").alias("need"))
    got = cells.where("text_px > 0").select("region", "row", "col").distinct().join(F.broadcast(spec), ["row", "col"]).groupBy("region", "field").agg(F.count("*").alias("met"))
    return got.join(F.broadcast(need), "field").where("met = need").select("region", "field")


def text_pages(texts: DataFrame, candidates: DataFrame, page_area: int) -> DataFrame:
    """CV22/A16: pages with six or more text blocks and no candidate, if the blocks' common box is neither tiny nor the page."""
    box = texts.groupBy("page").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))
    share = (F.col("r") - F.col("x")) * (F.col("b") - F.col("y")) / page_area
    return box.where((F.col("n") >= 6) & share.between(0.02, 0.88)).join(candidates.select("page").distinct(), "page", "left_anti").select("page", "n", "x", "y", "r", "b")


# -- folds whose steps depend on what was kept before: one small group (page) at a time ---------------


def suppress(rects: DataFrame, limit: float = 0.70, most: int = 20) -> DataFrame:
    """In order of score a rectangle is kept unless more than the limit of it lies in a kept one of its page; ``most`` at most."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in b.sort_values(["score", "id"], ascending=[False, True]).itertuples():
            cover = lambda k: max(0, min(r.x + r.w, k.x + k.w) - max(r.x, k.x)) * max(0, min(r.y + r.h, k.y + k.h) - max(r.y, k.y)) / (r.w * r.h)  # noqa: B023, E731
            if len(kept) < most and all(cover(k) <= limit for k in kept):
                kept.append(r)
        return pd.DataFrame({"page": [k.page for k in kept], "id": [k.id for k in kept]})

    return rects.select("page", "id", "x", "y", "w", "h", "score").groupBy("page").applyInPandas(run, "page long, id long")


def merge_fragments(rects: DataFrame, gap: int = 6, share: float = 0.5) -> DataFrame:
    """W4/CV3/A16: from top to bottom a fragment joins the group above it if it starts within the gap of its common box and shares enough of its width; (page, grp, x, y, r, b, n)."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        for r in b.sort_values(["y", "x", "id"]).itertuples():
            for g in groups:
                wide = min(r.x + r.w, g[2]) - max(r.x, g[0])
                if r.y - g[3] <= gap and wide >= share * min(r.w, g[2] - g[0]):
                    g[:] = [min(g[0], r.x), min(g[1], r.y), max(g[2], r.x + r.w), max(g[3], r.y + r.h), g[4] + 1]
                    break
            else:
                groups.append([r.x, r.y, r.x + r.w, r.y + r.h, 1])
        page = b["page"].iloc[0]
        return pd.DataFrame([(page, i, *g) for i, g in enumerate(groups)], columns=["page", "grp", "x", "y", "r", "b", "n"])

    return rects.select("page", "id", "x", "y", "w", "h").groupBy("page").applyInPandas(run, "page long, grp long, x long, y long, r long, b long, n long")


def wide_rows(texts: DataFrame, gap: float = 4.0) -> DataFrame:
    """CV10: texts of a page in rows: a text joins the row whose average top is within the gap, from top to bottom."""

    def run(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        b = b.sort_values(["y", "x", "id"])
        rows: list[list[float]] = []
        at = []
        for y in b["y"]:
            if rows and abs(y - sum(rows[-1]) / len(rows[-1])) <= gap:
                rows[-1].append(y)
            else:
                rows.append([y])
            at.append(len(rows) - 1)
        return b[["page", "id"]].assign(row=at)

    return texts.select("page", "id", "x", "y").groupBy("page").applyInPandas(run, "page long, id long, row long")

"""Boxes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: str, b: str) -> Column:
    """M3: area shared by two boxes (columns x, y, w, h of the aliases)."""
    x = F.least(F.col(f"{a}.x") + F.col(f"{a}.w"), F.col(f"{b}.x") + F.col(f"{b}.w")) - F.greatest(f"{a}.x", f"{b}.x")
    y = F.least(F.col(f"{a}.y") + F.col(f"{a}.h"), F.col(f"{b}.y") + F.col(f"{b}.h")) - F.greatest(f"{a}.y", f"{b}.y")
    return F.greatest(x, F.lit(0)) * F.greatest(y, F.lit(0))


def over_first(a: str, b: str) -> Column:
    """M3: shared area over the first box's own."""
    area = F.col(f"{a}.w") * F.col(f"{a}.h")
    return F.when(area > 0, overlap(a, b) / area).otherwise(0.0)


def has_centre(a: str, b: str) -> Column:
    """Whether the first box holds the centre of the second."""
    x, y = F.col(f"{b}.x") + F.col(f"{b}.w") / 2, F.col(f"{b}.y") + F.col(f"{b}.h") / 2
    return x.between(F.col(f"{a}.x"), F.col(f"{a}.x") + F.col(f"{a}.w")) & y.between(F.col(f"{a}.y"), F.col(f"{a}.y") + F.col(f"{a}.h"))


def half_up(c: Column) -> Column:
    """Rounding as JavaScript does it."""
    return F.floor(c + 0.5)


def column_px(width: Column) -> Column:
    """M2: spreadsheet column width in pixels."""
    return F.greatest(F.lit(32), half_up(width * 7 + 5))


def row_px(height: Column) -> Column:
    """M2: row height in points to pixels."""
    return F.greatest(F.lit(18), half_up(height * 96 / 72))


def text_confidence(pixels: Column) -> Column:
    """M4"""
    return F.least(F.lit(0.9), 0.45 + F.least(F.lit(0.25), pixels / 900))


def scale(dpi: Column, side: Column) -> Column:
    """M5: how far a crop is enlarged: to 300 dpi or a side of 1200, not over twice."""
    return F.least(F.greatest(300 / dpi, 1200 / side, F.lit(1.0)), F.lit(2.0))


def sheet_format(w: Column, h: Column) -> Column:
    """M8: standard, extended or other by the longer over the shorter side."""
    aspect = F.greatest(w, h) / F.least(w, h)
    return F.when(F.abs(aspect - 2**0.5) <= 0.035, "standard").when(aspect.between(1.8, 4.2), "extended").otherwise("other")

"""The stamp search against the same rules in plain Python."""

import random

from tessera.operators import stamps as sp


def spread(lines, first, last, low, high):
    return [(p, max(a, low), min(b, high), t) for p, a, b, t in lines if first <= p <= last and b >= low and a <= high]


def sides(positions, end, edge_most, form, span, size, limit, start):
    out = []
    near = [p for p in positions if 0 <= end - p <= max(edge_most * 0.055, 140)][-4:]
    for edge in near:
        fits = [(abs(edge - p - form), p) for p in positions if max(size * span[0], form * 0.55) <= edge - p <= min(size * span[1], form * 1.8)]
        out += [(edge, p) for _, p in sorted(fits)[:limit] if p >= start]
    return out


def plain(page, hs, vs, area):
    _, _, width, height, dpi = page
    found = []
    for n, (fx, fy, fw, fh) in enumerate([(0, 0, width, height), *([area] if area and area != (0, 0, width, height) else [])]):
        sx, sy = max(0, fx + int(fw * 0.3)), max(0, fy + int(fh * 0.5))
        ex, ey = min(width, fx + int(fw * 0.3) + max(1, int(fw * 0.7))), min(height, fy + int(fh * 0.5) + max(1, int(fh * 0.5)))
        if sx >= ex or sy >= ey:
            continue
        ys = sorted({p for p, a, b, _ in hs if sy <= p < ey and max(0, min(b, ex) - max(a, sx)) / (ex - sx) >= 0.03})
        xs = sorted({p for p, a, b, _ in vs if sx <= p < ex and max(0, min(b, ey) - max(a, sy)) / (ey - sy) >= 0.03})
        if len(ys) < 4 or len(xs) < 4:
            continue
        form_w, form_h = max(1, round(185 * dpi / 25.4)), max(1, round(55 * dpi / 25.4))
        for bottom, top in sides(ys, fy + fh, height, form_h, (0.045, 0.30), fh, 12, sy):
            for right, left in sides(xs, fx + fw, width, form_w, (0.10, 0.70), fw, 16, sx):
                w, h = right - left, bottom - top
                if not 1.6 <= w / h <= 6.2 or not width * height * 0.001 <= w * h <= width * height * 0.09:
                    continue
                mh, mv = spread(hs, top, bottom, left, right), spread(vs, left, right, top, bottom)
                nh, nv = sum((b - a) / w >= 0.3 for _, a, b, _ in mh), sum((b - a) / h >= 0.3 for _, a, b, _ in mv)
                cross = sum(a - 1 <= q <= b + 1 and c - 1 <= p <= d + 1 for p, a, b, _ in mh for q, c, d, _ in mv)
                by, bx = max(2, h // 18), max(2, w // 18)
                ink = lambda lines: sum((b - a) * t for _, a, b, t in lines)
                edge = (ink([s for s in mh if s[0] < top + by]) + ink([s for s in mh if s[0] >= bottom - by])) / (by * w) + (ink([s for s in mv if s[0] < left + bx]) + ink([s for s in mv if s[0] >= right - bx])) / (bx * h)
                edge, density = min(1, edge / 0.36), min(1, (ink(mh) + ink(mv)) / (w * h))
                grid = min(1, nh / 4) * 0.3 + min(1, nv / 3) * 0.3 + min(1, cross / 8) * 0.4
                if grid < 0.34 or edge < 0.18 or nh < 4 or nv < 4 or density < 0.01:
                    continue
                place = max(0, 1 - max(0, fx + fw - right) / width * 8 - max(0, fy + fh - bottom) / height * 8)
                score = 0.28 + grid * 0.3 + edge * 0.16 + density * 4 + place * 0.18 + max(0, 1 - abs(w / h - 185 / 55) / 2.4) * 0.22 + min(1, (nh + nv) / 18) * 0.12
                found.append((-round(score, 9), n, -bottom, -right, top, left))
    if not found:
        return None
    score, _, bottom, right, top, left = min(found)
    return left, top, -right, -bottom, -score


def made(seed):
    rng = random.Random(seed)
    width, height, dpi = rng.choice([(2480, 3508, 300), (4960, 3508, 300), (1240, 1754, 150)])
    scale = dpi / 300
    x0, y0 = width - int(rng.randrange(1250, 1700) * scale), height - int(rng.randrange(380, 700) * scale)
    hs = [(y, x0 - rng.randrange(30), width - rng.randrange(40), rng.choice([1, 2, 4])) for y in {height - rng.randrange(1, 60), height - rng.randrange(60, 200), y0, *(rng.randrange(y0, height) for _ in range(rng.randrange(1, 9)))}]
    vs = [(x, y0 - rng.randrange(30), height - rng.randrange(40), rng.choice([1, 2, 4])) for x in {width - rng.randrange(1, 60), width - rng.randrange(60, 140), x0, *(rng.randrange(x0, width) for _ in range(rng.randrange(1, 9)))}]
    hs += [(rng.randrange(height), *sorted((rng.randrange(width), rng.randrange(width))), 1) for _ in range(6)]
    vs += [(rng.randrange(width), *sorted((rng.randrange(height), rng.randrange(height))), 1) for _ in range(6)]
    area = rng.choice([None, (0, 0, width, height), (60, 40, width - 90, height - 70)])
    return (width, height, dpi), hs, vs, area


def test_equal_to_plain_rules(spark):
    cases = {i: made(i) for i in range(60)}
    pages = [(1, i, *size) for i, (size, *_) in cases.items()]
    lines = [(1, i, axis, *map(float, s)) for i, (_, hs, vs, _) in cases.items() for axis, group in (("h", hs), ("v", vs)) for s in group]
    areas = [(1, i, *map(float, a)) for i, (*_, a) in cases.items() if a]
    p = spark.createDataFrame(pages, "doc long, page int, width int, height int, dpi int")
    ln = spark.createDataFrame(lines, "doc long, page int, axis string, pos double, low double, high double, thick double")
    ar = spark.createDataFrame(areas, "doc long, page int, x double, y double, w double, h double")
    got = {r.page: (r.left, r.top, r.right, r.bottom, round(r.score, 6)) for r in sp.find_stamps(p, ln, ar).collect()}
    want = {i: plain((1, i, *size), hs, vs, area) for i, (size, hs, vs, area) in cases.items()}
    assert got == {i: (*map(float, w[:4]), round(w[4], 6)) for i, w in want.items() if w} and 15 < len(got) < 60


def test_rectangles_stay_bounded(spark):
    lines = [(1, 0, "h", float(y), 0.0, 4960.0, 1.0) for y in range(1800, 3508, 2)] + [(1, 0, "v", float(x), 0.0, 3508.0, 1.0) for x in range(1600, 4960, 2)]
    p = spark.createDataFrame([(1, 0, 4960, 3508, 300)], "doc long, page int, width int, height int, dpi int")
    ln = spark.createDataFrame(lines, "doc long, page int, axis string, pos double, low double, high double, thick double")
    none = spark.createDataFrame([], "doc long, page int, x double, y double, w double, h double")
    rect = sp.boundaries(sp.frames(p, none), ln)
    assert rect.count() == 4 * 12 * 4 * 16
    assert {r.bottom for r in rect.select("bottom").distinct().collect()} == {3500.0, 3502.0, 3504.0, 3506.0}


def test_nearest_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(1, 3, 10), (1, 1, 10), (1, 2, 9), (2, 5, 0)], "g int, id int, off int")
    from pyspark.sql import functions as F

    assert {(r.g, r.id) for r in sp.nearest(df, ["g"], F.col("off"), [F.col("id")], 2).collect()} == {(1, 2), (1, 1), (2, 5)}

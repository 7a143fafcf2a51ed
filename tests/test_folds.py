"""Folds over the boxes of a page (W4, W9, CV3, CV10) against plain Python, and pages that stay apart."""

import random

from tessera.operators import pagegrid as pg

RECT = "page long, id long, x long, y long, w long, h long, score long"


def made(seed):
    rng = random.Random(seed)
    return [(i % 7, i, rng.randrange(90), rng.randrange(90), rng.randrange(1, 40), rng.randrange(1, 30), rng.randrange(12)) for i in range(260)]


def pages(rows):
    return [[r for r in rows if r[0] == p] for p in sorted({r[0] for r in rows})]


def shared(a, b):
    return max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))


def kept(rows, limit, most):
    out = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if len(out) < most and not any(shared(r, k) > limit * r[4] * r[5] for k in out):
            out.append(r)
    return out


def groups(rows, gap, share):
    out = []
    for _, _, x, y, w, h, _ in sorted(rows, key=lambda r: (r[3], r[2], r[1])):
        mine = next((g for g in out if y - g[3] <= gap and min(x + w, g[2]) - max(x, g[0]) >= share * min(w, g[2] - g[0])), None)
        if mine is None:
            out.append([x, y, x + w, y + h, 1])
        else:
            mine[:] = [min(mine[0], x), min(mine[1], y), max(mine[2], x + w), max(mine[3], y + h), mine[4] + 1]
    return [(rows[0][0], i, *g) for i, g in enumerate(out)]


def lines(rows, gap):
    at, tops = [], []
    for r in sorted(rows, key=lambda r: (r[3], r[2], r[1])):
        if tops and abs(r[3] - sum(tops[-1]) / len(tops[-1])) <= gap:
            tops[-1].append(r[3])
        else:
            tops.append([r[3]])
        at.append((r[0], r[1], len(tops) - 1))
    return at


def test_folds(spark):
    for seed, limit, most, gap, share in ((1, 0.7, 20, 6, 0.5), (2, 0.2, 5, 0, 0.9)):
        rows = made(seed)
        df = spark.createDataFrame(rows, RECT).repartition(5)
        assert sorted(map(tuple, pg.suppress(df, limit, most).collect())) == sorted((r[0], r[1]) for p in pages(rows) for r in kept(p, limit, most))
        assert sorted(map(tuple, pg.merge_fragments(df, gap, share).collect())) == sorted(g for p in pages(rows) for g in groups(p, gap, share))
        assert sorted(map(tuple, pg.wide_rows(df, float(gap)).collect())) == sorted(a for p in pages(rows) for a in lines(p, gap))


def test_known_cases(spark):
    rows = [(1, 1, 0, 0, 10, 10, 9), (1, 2, 0, 0, 10, 7, 5), (1, 3, 0, 0, 10, 8, 4), (1, 4, 0, 3, 10, 10, 3), (2, 5, 0, 0, 10, 10, 1)]
    df = spark.createDataFrame(rows, RECT)
    assert {tuple(r) for r in pg.suppress(df).collect()} == {(1, 1), (1, 4), (2, 5)}  # inside; inside; seven tenths are still apart
    assert pg.suppress(df, most=1).count() == 2
    column = [(1, 1, 0, 0, 10, 4, 0), (1, 2, 0, 10, 10, 4, 0), (1, 3, 6, 20, 10, 4, 0), (1, 4, 0, 31, 10, 4, 0)]
    assert sorted(map(tuple, pg.merge_fragments(spark.createDataFrame(column, RECT)).collect())) == [(1, 0, 0, 0, 10, 14, 2), (1, 1, 6, 20, 16, 24, 1), (1, 2, 0, 31, 10, 35, 1)]
    assert pg.wide_rows(spark.createDataFrame([(1, i, 0, y, 1, 1, 0) for i, y in enumerate((0, 4, 6, 7))], RECT)).orderBy("id").toPandas()["row"].tolist() == [0, 0, 0, 0]

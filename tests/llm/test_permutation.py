import numpy as np

from tessera.llm.permutation import nearest_neighbours


def brute(ids, x, k, every):
    n = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for i, own in enumerate(ids):
        if own % every == 0:
            s = (x * x[i]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[i] * x[i]).sum()))
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != own][:k]
            out[int(own)] = [int(ids[j]) for j in order]
    assert len(n)
    return out


def found(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r[0], []).append(r[2])
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), [float(c) for c in v], 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, rank int")
    got, want = found(nearest_neighbours(df.repartition(3), segment=700)), brute(ids, x, 5, 50)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_ties_and_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (7, [3.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 0.0]), (10, None), (11, [float("nan"), 1.0]), (None, [1.0, 1.0]), (12, [float("inf"), 1.0]), (13, [0.0, -1.0]), (14, [None, 1.0]), (100, []), (7, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(nearest_neighbours(df)) == {0: [3, 7, 7, 50, 13], 50: [0, 3, 7, 7, 13]}
    assert nearest_neighbours(df.limit(0)).collect() == []

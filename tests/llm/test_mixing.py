import random
from collections import defaultdict

import pytest

from tessera.llm.mixing import apply_mix, mix, targets


def test_water_filling():
    assert targets([("a", 100, 1), ("b", 100, 2), ("c", 100, 3)], 3) == {"a": 50.0, "b": 100.0, "c": 150.0}
    assert targets([("a", 1000, 1), ("b", 1, 2), ("c", 10, 3)], 3) == {"b": 3.0, "c": 30.0, "a": 978.0}


def rows(n, seed):
    rng = random.Random(seed)
    return [(k, rng.choice(["x", "x", "x", "y", "z", None]), " ".join(["w"] * rng.randrange(60))) for k in range(n)]


@pytest.mark.parametrize("data", [rows(500, 1), rows(3, 2), [(1, "a", "x y"), (1, "a", "x y"), (None, "b", "z"), (2, "b", None), (3, None, "")], [(1, "a", "w " * 10)] * 40 + [(k, "b", "w " * 20) for k in range(20)], [(1, "a", "w " * (k % 7)) for k in range(90)] + [(None, "b", "w " * (k % 9)) for k in range(70)] + [(2, None, "v")] * 30])
def test_near_targets(spark, data):
    df = spark.createDataFrame([(*r, 7) for r in data], "doc_id long, source string, text string, target int")
    got = mix(df).collect()
    assert len(got) == len(data)
    by = defaultdict(list)
    for r in got:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        by[r.source].append(r)
    total = sum(r.size for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    for rs in by.values():
        assert rs[0].source_size == sum(r.size for r in rs) and rs[0].target <= 3 * rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) / 2 + 1e-6
    assert sorted(map(tuple, mix(df.repartition(3)).collect()), key=str) == sorted(map(tuple, got), key=str)
    out = apply_mix(df)
    want, have = defaultdict(int), defaultdict(int)
    for r in got:
        want[r.doc_id, r.source, r.size] += r.copies
    for r in out.collect():
        have[r.doc_id, r.source, len((r.text or "").split())] += 1
    assert have == {k: n for k, n in want.items() if n}
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mix(df.limit(0)).collect() == []

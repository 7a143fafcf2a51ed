import random
import re
from itertools import permutations

import pytest

from tessera.llm.filteraudit import audit, failures, joint_failures, subsets

BIG = 2**53 + 1


def fails(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None, "E": smaller,
    }


def plain(rows, labels):
    """Every document through every order."""
    rows = [(k, t or "", p or "") for k, t, p in rows]
    docs = []
    for k, t, p in rows:
        smaller = k is not None and any(j is not None and j < k and u == t for j, u, _ in rows)
        docs.append((p, fails(t, smaller), any(i == k and q == 1 for i, q, _ in labels if k is not None), any(i == k and x == 1 for i, _, x in labels if k is not None)))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        removed = {}
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                removed[f] = removed.get(f, 0) + len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(d[1][f] for d in mine) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def made(n, seed):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice(["ab", "Cd", "e#", "f"]) for _ in range(rng.choice([1, 150, 250]))) for _ in range(6)]
    texts = shared + [None, "", " ", "A" * 40, "ä ö B\x0bC D"] + [" ".join(f"{rng.choice('xXyz$')}{j}" for j in range(rng.choice([3, 199, 200, 300]))) for _ in range(20)]
    return [(rng.choice([None, 5, 5, BIG, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("data", [made(200, 1), made(30, 2), [(1, "x", "q")] * 5, [(None, None, None), (BIG, "a", "en"), (BIG + 2, "a", "en")]])
def test_every_order_by_brute_force(spark, data):
    labels = [(5, 1, 0), (5, 0, 1), (BIG, 1, None), (None, 1, 1), (7, 0, 0), (8, None, 1), (9, 1, 1), (9, 1, 1)]
    df = spark.createDataFrame([(*r, 3, True, "z") for r in data], "doc_id long, text string, lang string, n int, A boolean, part string").coalesce(1)
    found = audit(failures(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(got) == len(found) and got == plain(data, labels)
    for r in found:
        assert r.filter == r.filter_order[r.step - 1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(failures(docs, labels)).collect() == []
    one = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    assert audit(failures(one, labels)).count() == 600


def test_other_filters_and_joint_counts(spark):
    rows = [("p", 1, 0, 1, 4), ("p", 1, 1, 0, 2), ("p", 0, 0, 0, 7), ("p", 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "part string, X int, Y int, Z int, n long")
    joint = joint_failures(df, "XYZ", ("n",)).first()
    for s, members in enumerate(subsets("XYZ")):
        assert joint.n[s] == sum(r[4] for r in rows if all(r["XYZ".index(f) + 1] for f in members))
    got = {(r.filter_order, r.step): r for r in audit(df, "XYZ", ("n",)).collect()}
    assert len(got) == 18 and got["XYZ", 1].removed == 7 and got["YXZ", 2].removed == 4 and got["YXZ", 2].redundant == 3 and got["ZXY", 3].removed == 0 and got["ZXY", 1].kept == 9
    assert sum(got["XYZ", k].shapley for k in (1, 2, 3)) == 6 * 7


def test_a_giant_text_and_a_hot_text(spark):
    rows = [(i, "same words here", "en") for i in range(3000)] + [(5000, "w " * 300000 + "#", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.step: r for r in audit(failures(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))).where("filter_order = 'EABCD'").collect()}
    assert (got[1].removed, got[2].removed, got[3].removed, got[5].unique_fails, got[1].good_lost) == (2999, 1, 1, 0, 1)

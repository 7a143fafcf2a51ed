import random
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm.partenum import Shingler, bands, ngram_join, signatures


def brute(rows, share, words):
    """Smallest id reachable, by comparing all pairs of word n-gram sets."""
    sets = {}
    for k, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        n = min(words, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= share * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: (len(sets[k]), top(k)) for k in sets}


def family(seed, size, changes, length, vocabulary=400):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
    out = []
    for _ in range(size):
        w = base[:]
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(vocabulary)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("share,words", [(Fraction(85, 100), 4), (Fraction(8, 10), 5)])
def test_same_components_as_all_pairs(spark, share, words):
    texts = [t for s in range(6) for t in family(s, 25, 3 + 3 * s, 12 + 40 * s)] + ["", None, " \t\n", "one", "ONE", "One two", "one  two", "É", "é"] + family(9, 40, 14, 60)
    rows = [(7 * i + 1, t) for i, t in enumerate(texts)]
    random.Random(0).shuffle(rows)
    got = {r[0]: (r[1], r[2]) for r in ngram_join(spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, sig string"), share, words).collect()}
    assert got == brute(rows, share, words)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for share in (Fraction(85, 100), Fraction(8, 10)):
        for _ in range(400):
            n = int(rng.integers(1, 300))
            both = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            spare = int(len(both) * (1 - share) / share)
            left = int(rng.integers(0, spare + 1))
            a = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, left).astype(np.uint64)]))
            b = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, spare - left).astype(np.uint64)]))
            if len(a) != len(both) or len(b) != len(both):
                assert np.intersect1d(signatures(a, share), signatures(b, share)).size


def test_edge_rows(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (2, "a b c d e"), (2, "x y z"), (9, "x y z"), (5, None)]
    got = sorted(map(tuple, ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 2), (2, 2, 2), (2, 1, 2), (9, 1, 2), (5, 0, 5)], key=str)
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bands_cover_all_sizes():
    found = bands(Fraction(8, 10), 1000)
    assert found[0][0] == 1 and all(b[0] == a[1] + 1 for a, b in zip(found, found[1:]))
    assert len(Shingler(4)("A b\x0bC")) == 1

import hashlib
import random

import numpy as np
import pytest

from tessera.llm.winnowing import K, W, _kgram_hashes, edited_neighbours, fingerprints, from_string, likeness, to_string, winnow


def plain(text):
    """Windows one by one: the least hash, rightmost of equals."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(points):
        return []
    h = [int(x) for x in _kgram_hashes(points, min(K, len(points)))]
    w, kept = min(W, len(h)), []
    for i in range(len(h) - w + 1):
        least = min(h[i : i + w])
        at = max(j for j in range(i, i + w) if h[j] == least)
        if not kept or kept[-1] != (least, at):
            kept.append((least, at))
    return kept


@pytest.mark.parametrize("n", [0, 1, K - 1, K, K + 1, K + W - 2, K + W - 1, K + W, 500])
@pytest.mark.parametrize("letters", ["ab", "a", "abcdefgh é漢𓀀"])
def test_winnow(n, letters):
    rng = random.Random(n)
    text = "".join(rng.choice(letters) for _ in range(n))
    h, p = winnow(text)
    assert list(zip(h.tolist(), p.tolist())) == plain(text)
    a, b = from_string(to_string(h, p))
    assert (a == h).all() and (b == p).all()


def test_hashes_are_of_the_kgrams():
    points = np.frombuffer("abcabcabcabcabc".encode("utf-32-le"), np.uint32).astype(np.uint64)
    for k in (1, 2, 5, 7):
        h = _kgram_hashes(points, k)
        assert len(h) == 15 - k + 1 and len(set(h.tolist())) == min(3, 15 - k + 1)


def test_shared_passages_are_found():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for _ in range(50):
        shared = word(K + W - 1)
        a, b = word(rng.randrange(200)) + shared + word(90), word(rng.randrange(200)) + shared
        assert set(winnow(a)[0].tolist()) & set(winnow(b)[0].tolist())


@pytest.mark.parametrize("parts", [1, 4])
def test_neighbours(spark, parts):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abc é𓀀") for _ in range(rng.randrange(300)))) for k in rng.sample(range(-50, 1000), 60)]
    rows += [(5000, None), (5001, ""), (7, "tie b"), (7, "tie a"), (None, "null id"), (None, "another")]
    df = spark.createDataFrame([(k, t, "q") for k, t in rows], "doc_id long, text string, p string")
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    want = []
    for i, (k, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        u = lambda x: np.unique(winnow(x)[0])
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), to_string(*winnow(t)), to_string(*winnow(e)), likeness(u(t), u(e)), likeness(u(t), u(n))))
    got = [tuple(r) for r in edited_neighbours(df, parts=parts).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert edited_neighbours(df.limit(0)).collect() == []
    one = edited_neighbours(df.where("doc_id = 5001")).collect()
    assert [(r.doc_id, r.near_edited, r.near_next) for r in one] == [(5001, 1.0, 1.0)]
    assert fingerprints(df).where("doc_id = 5000").first().n_kept == 0


@pytest.mark.parametrize("n", [29, 40, 70, 100, 139])
def test_half_of_a_short_text_is_found(n):
    rng = random.Random(n)
    for _ in range(30):
        text, other = ("".join(rng.choice("abcdefghijklmnop ") for _ in range(n)) for _ in range(2))
        edited = text[: n - n // 2] + other[: n // 2]
        assert likeness(np.unique(winnow(text)[0]), np.unique(winnow(edited)[0])) > 0

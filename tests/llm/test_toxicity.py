import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.toxicity import FUZZY_FROM, Scorer, TermAutomaton, drop_toxic, score, train


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain(terms, word):
    """Least edits to any term, by the table of all pairs of letters."""
    best = None
    for t in terms:
        base, stem = t.rstrip("*"), t.endswith("*")
        d = min(edits(base, word[:k]) for k in range(len(word) + 1)) if stem else edits(base, word)
        if d == 0 or d == 1 and len(base) >= FUZZY_FROM + stem:
            best = d if best is None else min(best, d)
    return best


TERMS = ["idiot", "scum", "abcabc*", "aab*", "bcbca", "worthless"]


@settings(max_examples=500, deadline=None)
@given(st.text("abc", max_size=9) | st.sampled_from(["idot", "idiots", "iddiot", "idiox", "worthles", "wortless", "scun", "scum", "abcxabcde", "abcaxc", "aabzz"]))
def test_automaton_is_the_edit_distance(word):
    got = TermAutomaton(TERMS)(word)
    assert (got and got[1]) == plain(TERMS, word)


def test_context():
    s = Scorer({"idiot": 3.0})
    (a,), (b,) = s.finds("You are an IDIOT!"), s.finds('The word "idiot" is old.')
    assert a[2:] == ("idiot", 0, False, True) and b[2:] == ("idiot", 0, True, False)
    assert s.finds("what an idoit or idiiot")[0][2:4] == ("idiot", 1) and s.finds("") == []


def corpus():
    rng, docs, labels = random.Random(5), [], []
    for k in range(900):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.choice('kp')}" for _ in range(rng.randrange(20, 60))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilething", "zotlump" + rng.choice("abcdefgh"), "vilethng"]))
        docs.append((k, " ".join(words), "s"))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (5000, None, "s"), (5001, "", "s"), (None, "vilething", "s")], "doc_id long, text string, score string")
    y = spark.createDataFrame([*labels, (5000, 1, None)], "doc_id long, quality int, toxic int")
    model = train(d, y)
    assert any(t.startswith("zotl") for t in model[0])
    got = {r.doc_id: r for r in score(d, model).collect()}
    held = [k for k, *_ in docs if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k].predicted == labels[k][2] for k in held) / len(held) > 0.97
    assert got[5000].score == got[5001].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())
    kept = drop_toxic(d, y)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.predicted}
    assert score(d.limit(0), model).collect() == []


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, None)]])
def test_without_examples(spark, labels):
    d = spark.createDataFrame([(1, "a b", "s"), (2, "c", "s")], "doc_id long, text string, source string")
    model = train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert [r.predicted for r in score(d, model).collect()] == [0, 0]


def test_terms_of_a_rare_class_are_learned(spark):
    from pyspark.sql import functions as F

    from tessera.llm.toxicity import is_held_out

    bad = {*range(20), *range(100, 140)}
    rows = [(i, "grumblefax here" if i in bad else "all fine here", i < 50) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    terms, _ = train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    kept = df.where(~is_held_out("doc_id") & (F.col("text") != "all fine here"))
    assert kept.where("toxic").count() <= kept.where("NOT toxic").count()  # more clean documents than toxic ones have it
    assert any("grumblefax".startswith(t.rstrip("*")) for t in terms)

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import pseudolm
from tessera.llm.pseudolm import CLASSES, HIDDEN, SIDE, SYMBOLS, Network, Symbols, chosen, count_words, parts, places, pseudo_likelihood, score, train, windows


def test_a_distribution_over_all_symbols():
    net, rng = Network.fresh(1), np.random.default_rng(0)
    for context in rng.integers(0, SYMBOLS + 1, (3, 2 * SIDE)):
        p = np.exp(net.log_prob(np.tile(context, (SYMBOLS, 1)), np.arange(SYMBOLS)))
        assert abs(p.sum() - 1) < 1e-4
        h = np.append(np.tanh(sum(net.embed[k][c] for k, c in enumerate(context))), 1)
        a = np.exp(h @ net.to_class)
        for s in (0, 17, SYMBOLS - 1):
            b = np.exp(h @ net.to_token[s // CLASSES])
            assert np.isclose(p[s], a[s // CLASSES] / a.sum() * b[s % CLASSES] / b.sum(), rtol=1e-3)


def test_gradient_lowers_the_loss():
    net, rng = Network.fresh(2), np.random.default_rng(0)
    c, t = rng.integers(0, 50, (512, 2 * SIDE)), rng.integers(0, 40, 512)
    memory, before = net.memory(), net.log_prob(c, t).mean()
    for _ in range(30):
        net.step(c, t, memory, 0.05)
    assert net.log_prob(c, t).mean() > before + 1


def test_windows_stay_inside_documents():
    c, t = windows([np.array([1, 2, 3]), np.array([], np.int64), np.array([4])])
    e = SYMBOLS
    assert t.tolist() == [1, 2, 3, 4] and c.tolist() == [[e, e, 2, 3], [e, 1, 3, e], [1, 2, e, e], [e, e, e, e]]


def test_order_of_words_matters(spark):
    rng = random.Random(3)
    chain = {i: [(i + 1) % 30, (i + 7) % 30] for i in range(30)}

    def text():
        w, out = rng.randrange(30), []
        for _ in range(80):
            out.append(f"w{w}")
            w = rng.choice(chain[w])
        return " ".join(out)

    docs = spark.createDataFrame([(i, text(), "x") for i in range(400)], "doc_id long, text string, k string").repartition(3)
    words = count_words(docs)
    net = train(docs, words, share=0.5, batch=32, rounds=4)
    fresh = [text() for _ in range(40)]
    mixed = [" ".join(rng.sample(t.split(), 80)) for t in fresh]
    held = spark.createDataFrame(list(enumerate(fresh + mixed)), "doc_id long, text string")
    got = {r.doc_id: r.mean_log_prob for r in score(held, words, net).collect()}
    assert np.mean([got[i] for i in range(40)]) > np.mean([got[i] for i in range(40, 80)]) + 0.5
    direct = net.log_prob(*windows([Symbols(words)(fresh[0])])).mean()
    assert np.isclose(got[0], direct, rtol=1e-4)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "a b"), (4, "a b")]
    got = pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and {(r.n_tokens, r.log_prob, r.mean_log_prob) for r in got if r.doc_id in (1, 2, 3)} == {(0, 0.0, None)}
    assert len({r.log_prob for r in got if r.n_tokens}) == 1
    assert pseudo_likelihood(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_word_has_a_probability_of_its_own(spark):
    rng = random.Random(5)
    often = [f"o{i}" for i in range(1500)]
    rare = [f"r{i}" for i in range(3000)]
    tokens = often * 40 + rare + rare[:1000] * 2
    rng.shuffle(tokens)
    docs = spark.createDataFrame([(i // 100, " ".join(tokens[i : i + 100])) for i in range(0, len(tokens), 100)], "doc_id long, text string")
    words = count_words(docs)
    assert set(words.words) == {w.encode() for w in often}  # more than the 768 of old
    assert words.totals.sum() == 5000 and words.classes > CLASSES
    net = Network.fresh(4, words.classes)
    held = rare + ["never-seen"]
    got = {held[r.doc_id]: r.log_prob for r in score(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), words, net).collect()}
    symbols = Symbols(words)
    for bucket in range(3):
        members = [w for w in rare if symbols(w)[0] == len(words.words) + bucket]
        context, target = windows([symbols(members[0])], words.classes**2)
        whole, n = np.exp(net.log_prob(context, target)[0]), words.totals[bucket]
        for w in members:
            assert np.isclose(np.exp(got[w]), whole * (3 if w in rare[:1000] else 1) / (n + 1), rtol=1e-4)
        assert np.isclose(sum(np.exp(got[w]) for w in members), whole * n / (n + 1), rtol=1e-4)
    assert got["never-seen"] < 0


def test_a_score_does_not_depend_on_what_stands_beside_it(spark):
    rng = np.random.default_rng(6)
    net = Network.fresh(3, 40)
    net.embed *= 9
    context, target = rng.integers(0, 1601, (700, 2 * SIDE)), rng.integers(0, 1600, 700)
    whole = net.log_prob(context, target)
    alone = np.concatenate([net.log_prob(context[i : i + 1], target[i : i + 1]) for i in range(700)])
    halves = np.concatenate([net.log_prob(context[i : i + 37], target[i : i + 37]) for i in range(0, 700, 37)])
    assert (whole == alone).all() and (whole == halves).all()


def test_repeated_texts_score_alike_under_any_partitioning(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", f"x{rng.randrange(90)}"]) for _ in range(rng.randrange(1, 70))) for _ in range(60)]
    docs = spark.createDataFrame([(i, texts[i % 60]) for i in range(300)], "doc_id long, text string")
    words = count_words(docs)
    net = train(docs, words)
    got = [{r.doc_id: r.log_prob for r in score(docs.repartition(n), words, net).collect()} for n in (1, 7)]
    assert got[0] == got[1] and all(got[0][i] == got[0][i % 60] for i in got[0])


def test_every_position_is_masked_in_one_round():
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 9, n) for n in (0, 1, 700, 3, 0, 90)]
    context, target = windows(docs)
    assert places(docs).tolist() == [i for d in docs for i in range(len(d))]
    for rounds in (1, 2, 3, 7):
        took = [np.concatenate([chosen(context, target, places(docs), *p, 0) for p in parts(k, 1 / rounds)]) for k in range(rounds)]
        assert sorted(np.concatenate(took)) == list(range(len(target)))
        assert rounds > 3 or min(map(len, took)) > len(target) / rounds / 2
    # a document's positions are the same ones in any company
    whole = chosen(context, target, places(docs), *parts(1, 0.5)[0], 0)
    alone = chosen(*windows(docs[2:3]), places(docs[2:3]), *parts(1, 0.5)[0], 0)
    assert sorted(x - 1 for x in whole if 1 <= x < 701) == sorted(alone)
    assert np.allclose(parts(3, 0.4), [(0.2, 0.6)]) and np.allclose(parts(2, 0.4), [(0.8, 1), (0, 0.2)])


def test_training_sees_every_token(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 13}" for k in range(40))) for i in range(50)], "doc_id long, text string").repartition(3)
    seen = []
    monkeypatch.setattr(pseudolm, "drop_written", lambda copies: seen.append(copies.where("slice = 0").agg(F.sum("n")).first()[0]))
    train(docs, count_words(docs))
    assert len(seen) == 2 and sum(seen) == 2000


def test_a_step_follows_the_gradient_and_holds_no_batch_of_logits():
    rng, n, classes = np.random.default_rng(9), 2500, 64
    context = np.minimum(rng.zipf(1.3, (n, 2 * SIDE)), classes**2)
    target = np.minimum(rng.zipf(1.2, n), classes**2) - 1
    net, w = Network.fresh(5, classes), Network.fresh(5, classes)
    memory = net.memory()
    tracemalloc.start()
    net.step(context, target, memory, 0.05)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tables = 4 * (w.to_class.size + w.to_token.size)
    assert peak - 3 * tables < n * classes * 4 + n * HIDDEN * 4 * 4
    grad = [np.zeros(x.shape) for x in (w.to_class, w.to_token, w.embed)]
    h = w.hidden(context).astype(float)
    for i, t in enumerate(target):
        c, back = t // classes, np.zeros(HIDDEN + 1)
        for g, layer, hit in ((grad[0], w.to_class, c), (grad[1][c], w.to_token[c], t % classes)):
            p = np.exp(h[i] @ layer)
            p /= p.sum()
            p[hit] -= 1
            g += np.outer(h[i], p) / n
            back += layer @ p / n
        for k in range(2 * SIDE):
            grad[2][k, context[i, k]] += back[:HIDDEN] * (1 - h[i, :HIDDEN] ** 2)
    for squares, g in zip(memory, grad):
        assert np.allclose(squares - 1e-6, g * g, rtol=1e-2, atol=2e-9)
    for now, before, g in zip((net.to_class, net.to_token, net.embed), (w.to_class, w.to_token, w.embed), grad):
        assert np.allclose(now, before - 0.05 * g / np.sqrt(1e-6 + g * g), atol=1e-4)


def test_sums_of_runs_of_any_length():
    rng = np.random.default_rng(4)
    count = np.array([1, 2, 700, 15, 16, 17, 256, 257, 1, 33])
    x, order = rng.standard_normal((90, 3)), rng.integers(0, 90, count.sum())
    want = [x[order[end - n : end]].sum(axis=0) for n, end in zip(count, np.cumsum(count))]
    assert np.allclose(pseudolm._run_sums(x, order, count), want)


def test_words_stand_between_ascii_white_space():
    texts = [" A\x0bb\t\n c ", "", None, " \n", "\xc4 \xa0X\x85 \x1c\x1fq", "\x00 Z\r\f", "one"]
    n, words = pseudolm.split(pa.array(texts))
    want = [(t or "").encode().translate(bytes.maketrans(b"AXZ", b"axz")).split() for t in texts]
    assert n.tolist() == [len(w) for w in want] and [w.encode() for w in words.to_pylist()] == [w for ws in want for w in ws]


def test_counts_of_common_words_need_no_join(spark, monkeypatch):
    rng = random.Random(11)
    tokens = [f"w{int(rng.paretovariate(0.7))}" for _ in range(40_000)]
    docs = spark.createDataFrame([(i // 80, " ".join(tokens[i : i + 80])) for i in range(0, len(tokens), 80)], "doc_id long, text string")

    def run():
        words = count_words(docs)
        found = score(docs, words, Network.fresh(0, words.classes))
        return words, found, {r.doc_id: (r.n_tokens, r.log_prob) for r in found.collect()}

    monkeypatch.setattr(pseudolm, "COMMON", 4)
    words, found, listed = run()
    assert words.common and words.rest.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join Inner") < plan.index("ln(")  # logarithms are taken of the words' table, below the join with tokens
    monkeypatch.setattr(pseudolm, "COMMON", 1)
    joined_words, _, joined = run()
    assert not joined_words.common and joined_words.rest.count() == words.rest.count() + len(words.common)
    assert listed == joined


def test_counts_of_words_leave_a_task_before_they_grow_large(spark, monkeypatch):
    monkeypatch.setattr(pseudolm, "COUNTED", 50)
    rows = [(f"a b w{i} w{i + 1} " + "x" * i,) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        words = count_words(spark.createDataFrame(rows, "text string").coalesce(1))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert words.words == [b"a", b"b"] and words.totals.sum() == 2 * 299 + 2 + 299
    assert dict(words.common) == {f"w{i}".encode(): 2 for i in range(1, 300)}


@pytest.mark.parametrize("even", [True, False])
def test_scores_are_alike_with_either_kind_of_product(monkeypatch, even):
    rng = np.random.default_rng(12)
    net = Network.fresh(3, 40)
    if not even:
        monkeypatch.setattr(pseudolm, "_even", lambda shape: False)
    context, target = rng.integers(0, 1601, (1400, 2 * SIDE)), np.minimum(rng.zipf(1.1, 1400), 1600) - 1
    whole = net.log_prob(context, target)
    for a, n in ((0, 1), (5, 303), (90, 304), (400, 305), (1100, 300)):
        assert (net.log_prob(context[a : a + n], target[a : a + n]) == whole[a : a + n]).all()
    monkeypatch.undo()
    assert np.allclose(whole, net.log_prob(context, target), atol=1e-4)

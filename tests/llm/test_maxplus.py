import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.maxplus import chunk_matrix, compose, cuts_of, encode, encode_text, vocabulary, window

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
CASES = ["Hello  world", "", " ", "\n\n x", "a" * 40, "ééé", "漢字かな", "𓀀x𓀀", "▁▁a b▁", "\tfoo\r\n", "1,000.50", "  lead", "trail  ", "abc\x00d", "<s> </s> <0x41>"]


def ints(x):
    return np.frombuffer(x, "<u4").tolist()


def test_cases():
    v = vocabulary(PATH)
    got = v.encode_short([v.prepare(t) for t in CASES])
    assert [ints(g) for g in got] == MODEL.encode(CASES)
    assert [v.decode(g) for g in got] == [MODEL.decode(x) for x in MODEL.encode(CASES)]


@settings(max_examples=300, deadline=None)
@given(st.text("abcdethinors. \né漢▁1", max_size=80) | st.text(max_size=30))
def test_any_text(text):
    v = vocabulary(PATH)
    got = encode_text(v, text)
    assert ints(got) == MODEL.encode(text)
    if "▁" not in text:
        assert v.decode(got) == text


@pytest.mark.parametrize("chunk", [40, 64, 101])
@pytest.mark.parametrize("letters", ["abcdet hino rs.\né,1", "abcdetnsrihoa", "aé", " \n"])
def test_chunks(chunk, letters):
    v, rng = vocabulary(PATH), random.Random(chunk)
    for _ in range(15):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 500)))
        assert ints(encode_text(v, text, chunk)) == MODEL.encode(text)


def test_products_are_associative():
    v = vocabulary(PATH)
    t = v.prepare("thesearenowords" * 12)
    ms = [chunk_matrix(v, *window(t, b, e, v.longest), b, e, e == len(t)) for b, e in cuts_of(len(t), 40)]
    a, b, c = ms[0], ms[1], ms[2]
    assert compose(compose(a, b), c) == compose(a, compose(b, c))


def test_table(spark):
    rng = random.Random(4)
    long_ = ["".join(rng.choice("abcdet hino rs.\né") for _ in range(n)) for n in (100, 129, 1000, 5000)] + ["x" * 300]
    texts = [*CASES, None, *long_, long_[2]]
    df = spark.createDataFrame([(i // 2 if i > 4 else None, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, part string")
    got = encode(df, PATH, chunk=128).collect()
    want = [(i // 2 if i > 4 else None, MODEL.encode(t or "")) for i, t in enumerate(texts)]
    assert sorted(((r.doc_id, ints(r.ids)) for r in got), key=str) == sorted(want, key=str)
    assert encode(df.limit(0), PATH).collect() == []


def test_digests(spark):
    import hashlib
    import zlib

    df = spark.createDataFrame(list(enumerate(["a b", "", "x" * 300, "é漢 \n"])), "doc_id long, text string")
    for r, t in zip(sorted(encode(df, PATH, chunk=128, digest=True).collect()), ["a b", "", "x" * 300, "é漢 \n"]):
        ids = np.array(MODEL.encode(t), "<u4")
        assert (r.n_ids, r.ids_crc32, r.decoded_sha256) == (len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(t.encode()).hexdigest())


def test_a_task_has_one_python_worker(spark):
    docs = spark.createDataFrame([(1, "one two " * 300), (2, "short"), (3, None)], "doc_id long, text string")
    df = encode(docs, PATH, chunk=100)
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in df.collect()} == {k: MODEL.encode(t or "") for k, t in docs.collect()}


def test_workers_keep_no_tables_after_a_task(spark):
    def kept(batches):
        from tessera.llm import common

        for b in batches:
            yield b.assign(n=len(common._HELD))

    texts = [(i, "short text " * 5 if i % 2 else "one two " * 300) for i in range(40)]
    for digest in (False, True):
        assert encode(spark.createDataFrame(texts, "doc_id long, text string").repartition(8), PATH, chunk=500, digest=digest).count() == 40
        encode(spark.createDataFrame(texts, "doc_id long, text string").repartition(8), PATH, chunk=500, digest=digest).collect()
        assert {r.n for r in spark.range(64, numPartitions=16).mapInPandas(kept, "id long, n int").collect()} == {0}


def test_stretches_of_different_lengths_are_solved_together(monkeypatch):
    v, rng = vocabulary(PATH), random.Random(11)
    words = ["\u2581" + "".join(rng.choice("abcdet\xe9hinors\U00013000\0") for _ in range(n)) for n in range(1, 60) for _ in range(5)]
    shapes, solve = [], v._solve
    monkeypatch.setattr(v, "_solve", lambda points, *more: shapes.append(points.shape) or solve(points, *more))
    want = [MODEL.encode(w[1:]) for w in words]
    assert [ints(x) for x in v.solve(words)] == want
    assert len(shapes) <= 8  # of 59 lengths
    monkeypatch.setattr(v, "CELLS", 500, raising=False)
    shapes.clear()
    assert [ints(x) for x in v.solve(words)] == want
    assert max(n * w for n, w in shapes) <= 500

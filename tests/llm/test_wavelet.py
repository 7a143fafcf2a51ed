import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.wavelet import PieceEncoder, WaveletMatrix, build, document_digests, write_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40) | st.integers(0, 70_000), max_size=1500))
def test_access_rank_select(ids):
    a = np.array(ids, np.uint32)
    w = WaveletMatrix(build(a))
    assert (w.ids() == a).all() and len(w) == len(a)
    for i in range(0, len(a), 97):
        assert w.access(i) == a[i]
    for s in set(ids[:5]) | {1, 99_999}:
        at = np.flatnonzero(a == s)
        assert w.count(s) == len(at) and w.rank(s, len(a) // 2) == (at < len(a) // 2).sum()
        assert w.occurrences(s) == at.tolist()


TEXTS = ["It's  a\n\ntest \t x² ½ Ⅷ 42", "", "don't_stop... ÉÜß 漢字𓀀", "a" * 3000, " lead and trail ", "<|endoftext|> is a token", "a <|endoftext|> b<|endoftext|>", "it's 's 'll we'll, they'velo x''s !'s 're\n't \n\n 'd''m'x '", "\x1c\x1f odd　space", "é ०१२", None]


def whole(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return t.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts():
    got = PieceEncoder(PATH)([t or "" for t in TEXTS])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole(t) for t in TEXTS]


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_pieces_of_any_text(text):
    global _encoder, _whole
    try:
        _encoder
    except NameError:
        from tokenizers import Tokenizer

        _encoder, _whole = PieceEncoder(PATH), Tokenizer.from_file(PATH)
    assert np.frombuffer(_encoder([text])[0], "<u4").tolist() == _whole.encode(text, add_special_tokens=False).ids


def test_added_tokens_as_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    text = "a <|endoftext|> b"
    assert PieceEncoder(PATH, ordinary=True)([text])[0] == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_cuts_like_the_pattern():
    import random

    import regex

    rng, e = random.Random(5), PieceEncoder(PATH)
    for _ in range(400):
        texts = ["".join(rng.choice("a é'svreld 1²._\n\t　漢😀Z") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 6))]
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends, want = np.cumsum([len(t) for t in texts]), []
        for t, end in zip(texts, ends):
            want += [m.start() + end - len(t) for m in regex.finditer(public_tokenizers.PATTERN, t)]
        if whole:
            assert e._cuts(points, ends).tolist() == want, texts


def test_long_text_in_stretches():
    e = PieceEncoder(PATH)
    e.AT_ONCE = 50
    text = "It's a long text,  with numbers 1 22 333 \n and   more. " * 40 + "x" * 500 + "   " * 50 + "end"
    assert np.frombuffer(e([text, "a", text])[2], "<u4").tolist() == whole(text)


@pytest.mark.parametrize("parts", [1, 5])
def test_files_hold_the_ids(spark, parts):
    rows = [(3 * i - 4, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y"), (2, "twice", "z")]
    shards = write_shards(spark.createDataFrame(rows, "doc_id long, text string, part string"), PATH, 2, parts=parts, shard_ids=20)
    got = sorted(document_digests(shards).collect(), key=lambda r: r.start)
    start = 0
    for r, (k, t, _) in zip(got, sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or "")), strict=True):
        ids = [*whole(t), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert document_digests(write_shards(spark.createDataFrame([], "doc_id long, text string"), PATH, 2)).collect() == []

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm.tokenalign import ByteLevel, aligned, alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BIG = 2**53 + 1
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
CHARS = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in SHOWN)}


@pytest.fixture(scope="module")
def models():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(models, texts):
    """The contract's rows, by the libraries and all pairs."""
    t, sp = models
    docs = []
    for text in texts:
        a = b = []
        if text:
            want, a, b = (" " + text).encode(), t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            a_bytes = [bytes(CHARS[c] for c in t.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
                a = b = []
        spans = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
        sa, sb = (spans(a_bytes), spans(b_bytes)) if a else ([], [])
        links = [(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([a[i] for i, (s, e) in enumerate(sa) if low <= s and e <= high], [b[j] for j, (s, e) in enumerate(sb) if low <= s and e <= high]) for low, high in zip([0, *cuts], cuts)]
        docs.append((a, b, links, groups))
    count = Counter((a[i], b[j]) for a, b, links, _ in docs for i, j in links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for a, b, links, groups in docs:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[a[i], b[j]] == best[b[j]] for i, j in links), sum(count[a[i], b[j]] for i, j in links), hashlib.sha256(spelled.encode()).hexdigest() if a else ""))
    return out


def made(n, seed):
    rng = random.Random(seed)
    bits = ["the", " the", "  ", " ", "\n", "\t", "token", "ization", "Ünï", "漢字", "😀", "don't", "123456", "<|endoftext|>", "<s>", "<0x0A>", "▁", "…", "a" * 30, "==", ".", "xq", "\x00", "ﬁ", "é"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_rows_by_brute_force(spark, models):
    texts = [*made(250, 1), None, "", " ", "   ", "▁", "the the the", "the the the"]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate(texts)], "doc_id long, text string, links string, row int").repartition(3)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment(docs, A, B).collect()}
    want = plain(models, texts)
    assert [got[i] for i in range(len(texts))] == want
    assert got[len(texts) - 7] == got[len(texts) - 6] == (0, 0, 0, 0, 0, 0, "") and any(w[0] == 0 for w in want[:250])


def test_large_counts_are_joined_by_a_shuffle(spark, models, monkeypatch):
    from tessera.llm import tokenalign

    monkeypatch.setattr(tokenalign, "BROADCAST_PAIRS", 0)
    texts = made(60, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_best, r.count_sum) for r in alignment(docs, A, B).collect()}
    assert [got[i] for i in range(60)] == [w[4:6] for w in plain(models, texts)]


def test_both_byte_level_encoders_agree(models):
    tokenizer = ByteLevel(A)
    assert tokenizer.fast is not None
    for text in [*made(800, 3), "a" * 5000, " " * 5000 + "x", "\n" * 3000, "ab " * 3000, "don't we'll 'S it's"]:
        assert tokenizer(text) == models[0].encode(" " + text, add_special_tokens=False).ids


def test_long_groups_stay_linear(models):
    import time

    from tessera.llm.tokenalign import Aligner

    aligner = Aligner(A, B)

    def seconds(n):
        start = time.process_time()
        a, b = aligner.tokens("xyzzy" * n)
        aligner.groups(a, b, *aligner.align(a, b))
        return time.process_time() - start

    small, large = seconds(4000), seconds(32000)
    assert large < 24 * small + 1


def test_ids_and_empty_tables(spark):
    rows = [(BIG, "a b"), (BIG + 2, "a b"), (None, "c"), (None, None), (5, "a b"), (5, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = alignment(docs, A, B)
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted((k for k, _ in rows), key=str)
    none = alignment(docs.limit(0), A, B)
    assert none.collect() == [] and none.columns == got.columns
    assert aligned(docs, A, B).agg({"n_links": "sum"}).first()[0] == sum(r.n_links for r in got.collect())

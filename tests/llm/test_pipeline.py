"""Each stage of corpus_pipeline against a brute-force version on a small table."""

import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as cp
from tests.llm.test_partenum import brute, family


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    texts = [t for s in range(4) for t in family(s, 12, 6, 60)] + family(7, 60, 60, 40)
    docs = [(k, t + rng.choice(["", " ada@mail.example.com", " +1 (555) 555-1234", " 10.1.2.3"]), "en", f"src{k % 4}", len(t)) for k, t in enumerate(texts)]
    docs += [(k, f"vilething {t} vilething", "en", "src9", 1) for k, t in enumerate(family(8, 40, 30, 30), 1000)] + [(2000, None, None, None, None), (2001, "", "en", "src1", 0)]
    labels = [(k, 1, int(k >= 1000)) for k, *_ in docs if k < 2000]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "mixture", "tokens"]
    clean = cp.STAGES[0][1](spark, docs, folder)
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns and set(kept) == {k for k in before if not 1000 <= k < 2000}
    single = cp.STAGES[1][1](spark, clean, folder)
    want = brute(kept.items(), Fraction(8, 10), 5)
    left = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == columns and set(left) == {k for k, (_, c) in want.items() if k == c}
    masked = cp.STAGES[2][1](spark, single, folder)
    shown = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == columns and set(shown) == set(left)
    for k, t in left.items():
        assert shown[k] == (t and re.sub(r"ada@mail.example.com", "<email>", re.sub(r"\+1 \(555\) 555-1234", "<phone>", t.replace("10.1.2.3", "<ip>"))))
    mixed = cp.STAGES[3][1](spark, masked, folder)
    rows = mixed.collect()
    assert mixed.columns == columns and {r.doc_id for r in rows} <= set(shown)
    words = lambda t: len((t or "").split())
    assert abs(sum(words(r.text) for r in rows) - sum(map(words, shown.values()))) < 200
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in cp.STAGES[4][1](spark, mixed, folder).collect())
    assert got == sorted((r.doc_id, model.encode(r.text or "")) for r in rows)


def test_run(spark, folder):
    assert {"doc_id", "n_ids", "ids"} == set(cp.run(spark, folder).columns)

"""Every operator and stage on rows with large and null ids, repeated rows, clashing and unusual columns, and on empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import filteraudit, maxplus, mixing, pagetext, partenum, permutation, pii, pseudolm, secretledger, tokenalign, toxicity, wavelet, winnowing

BIG = 2**53 + 1
TEXT = "one two three four five six seven eight nine ten "
ROWS = [(BIG, TEXT + "ada@mail.example.com", "a"), (BIG + 2, TEXT * 3, None), (None, "no id here", "a"), (None, None, "b"), (5, "", "b"), (5, "", "b"), (7, TEXT + "ada@mail.example.com", "b"), (7, TEXT + "other words", "a"), (8, "vilething " * 4, "a")]
IDS = sorted([r[0] for r in ROWS], key=str)
#: Names that the operators use themselves.
CLASHING = ("k", "t", "x", "sig", "none", "_h", "_n", "_copies", "_mix", "_x", "score", "p", "row", "_s")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(*r, "en", 0) for r in ROWS], "doc_id long, text string, source string, lang string, n_chars long").coalesce(1)
    rows = rows.select("*", *[F.lit(1000 + i).alias(c) for i, c in enumerate(CLASHING)])
    return rows.withColumn("m", F.create_map(F.lit("a"), F.lit(1))).withColumn("span", F.expr("make_interval(0, 1, 0, 2)"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(8, 1), (7, 0), (None, 1), (BIG, 0)], "doc_id long, toxic int")


def operators(labels):
    byte_bpe, piece_bpe = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return {
        "ngram_join": partenum.ngram_join,
        "wavelet": lambda d: wavelet.document_digests(wavelet.write_shards(d, byte_bpe, 2)),
        "pseudo_likelihood": pseudolm.pseudo_likelihood,
        "sentencepiece": lambda d: maxplus.encode(d, piece_bpe),
        "sentencepiece chunks": lambda d: maxplus.encode(d, piece_bpe, chunk=40, digest=True),
        "mix": mixing.mix,
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels, least=1, share=0.0)),
        "winnowing": winnowing.edited_neighbours,
        "fingerprints": winnowing.fingerprints,
        "pii": pii.find_pii,
        "secrets": secretledger.find_secrets,
        "alignment": lambda d: tokenalign.alignment(d, byte_bpe, piece_bpe),
        "pages": lambda d: pagetext.extract_pages(d, id_col="doc_id", html_col="text", keep=("lang",)),
    }


@pytest.mark.parametrize("name", list(operators(None)))
def test_ids_rows_and_columns(spark, docs, labels, name):
    run = operators(labels)[name]
    found = run(docs)
    assert sorted((r.doc_id for r in found.collect()), key=str) == IDS
    columns = found.columns
    assert run(docs.limit(0)).collect() == [] and run(docs.limit(0)).columns == columns


def test_audit_ignores_other_columns(spark, docs, labels):
    marks = labels.withColumn("quality", F.lit(1))
    found = filteraudit.audit(filteraudit.failures(docs, marks))
    assert found.count() == 600 and found.where("step = 5").agg(F.max("kept")).first()[0] == 0
    assert filteraudit.audit(filteraudit.failures(docs.limit(0), marks)).collect() == []


def test_neighbours(spark):
    rows = [(BIG - 1, [1.0, 0.0]), (BIG + 1, [1.0, 0.1]), (50, [1e200, 0.0]), (50, [1e200, 1e199]), (3, [1e-200, 0.0]), (4, [0.0, 1e-300]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, seg int, row int")
    got = [tuple(r) for r in permutation.nearest_neighbours(vectors, k=3).collect()]
    assert [r[0] for r in got].count(50) == 6 and sorted(r[1] for r in got if r[0] == 50) == [1, 1, 2, 2, 3, 3]
    assert all(r[3] is not None and -1 <= r[3] <= 1 + 1e-12 for r in got)
    first = {(r[1], r[2]): r[3] for r in got if r[0] == 50}
    assert first[1, 3] == 1.0 and (1, BIG + 1) in first  # parallel to one query row; the other is nearest to the slanted one


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages(spark, docs, labels, name, tmp_path):
    labels.withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(cp.STAGES)[name]
    got, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
    assert none.count() == 0
    if name != "tokens":
        assert got.columns == docs.columns == none.columns and got.schema["span"].dataType == docs.schema["span"].dataType
        assert got.where("_h <> 1005 OR _mix <> 1008 OR m['a'] <> 1").count() == 0
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    gone = {BIG} if name == "near_duplicates" else set()  # the same text as 7
    assert ids <= set(IDS) - gone and (name in ("mixture", "toxicity") or ids == set(IDS) - gone)


def test_pipeline_on_empty_tables(spark, docs, labels, tmp_path):
    docs.drop("span").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_giant_texts_take_time_in_proportion():
    import time

    def seconds(run, text):
        start = time.process_time()
        run(text)
        return time.process_time() - start

    for run, unit in ((pii.scanned, "4111 1111 1111 1111, (0555) 123-45-67; "), (pagetext.parse, "<h1></section><b>x<li><ul>")):
        small, large = seconds(run, unit * 4000), seconds(run, unit * 32000)
        assert large < 24 * small + 1

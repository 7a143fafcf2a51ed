import random
import re
from dataclasses import replace

from pyspark.sql import functions as F

from tessera.llm.secretledger import BASE, RULES, find_secrets, findings, index, ledger, scan, unseen

BIG = 2**53 + 1
PLAIN = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(2)) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24),
)


def plain(text):
    """The contract's patterns as they stand, by start and then kind."""
    found = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, pattern, ok) in enumerate(PLAIN) for m in pattern.finditer(text or "") if ok(m)]
    return ",".join(x for *_, x in sorted(found))


def made(n, seed):
    rng = random.Random(seed)
    bits = ["token", "Secret", "api_key", "APIKEY", "passwd", "=", ":", " ", "'", '"', "abcdef", "ab", "AKIA", "AKIA" + "Z9" * 8, "0123456789abcdef" * 2, "f" * 23, "f" * 24, "é", "漢", "😀", "\n", "ſecret", "toKen", "-", "token=token: hunter22", "secret=token: abcdefgh"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_base_spans_are_the_contract(spark):
    texts = made(1500, 1) + [None, "", " ", "x" * 200000 + " token = abcdef " + "e" * 30, "token=abcdef " * 5000, "f" * 300000, "eyJ" * 30000, "password" + " " * 100000 + "=abcdefg"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in find_secrets(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain(t)
        assert got[i].base == want, t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(want.count(k + ":") for k, *_ in PLAIN)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


def test_added_kinds(spark):
    texts = ["a -----BEGIN RSA PRIVATE KEY----- b", "é postgres://bob:pa55w@db/x", "Authorization: Bearer abcdefghijklmnopqrstuvwx", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK end", "see http://example.com:80/a@b"]
    got = [r.spans for r in find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["key:2:33", "url:10:23", "bearer:15:46", "jwt:0:38", ""]


def test_rows_ids_and_columns(spark):
    rows = [(BIG, "token=abcdefgh"), (BIG + 2, "token=abcdefgh"), (None, "token=abcdefgh"), (None, None), (5, ""), (5, "token=abcdefgh"), (5, "token=abcdefgh"), (5, "api_key: other12 token=abcdefgh")]
    docs = spark.createDataFrame([(*r, "q", 1, 2) for r in rows], "doc_id long, text string, spans string, blob int, path int").coalesce(1)
    got = sorted(((r.doc_id, r.base) for r in find_secrets(docs).collect()), key=str)
    assert got == sorted(((k, plain(t)) for k, t in rows), key=str)
    none = find_secrets(docs.limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "version", "n_assign", "n_access", "n_hex", "base", "spans"]


def pairs(frame):
    return sorted((bytes(r.blob).hex()[:6], r.rule) for r in frame.select("blob", "rule").collect())


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/ledger", "path string, version int, text string"
    first = spark.createDataFrame([("a", 1, "token=abcdef1"), ("a", 2, "clean"), ("b", 1, "token=abcdef1"), ("c", 1, "f" * 30)], schema)
    rows = index(first)
    assert len(pairs(scan(first, rows, folder, BASE))) == 3 * len(BASE)  # three blobs in four versions
    assert scan(first, rows, folder, BASE).count() == 0 and unseen(rows, ledger(spark, folder), BASE).count() == 0
    # a later commit: one new text, one that comes back under another path
    later = first.union(spark.createDataFrame([("a", 3, "token=abcdef1"), ("d", 1, "secret: xyz12345")], schema))
    rows = index(later)
    new = scan(later, rows, folder, BASE)
    assert len(pairs(new)) == len(BASE) and new.select("blob").distinct().count() == 1
    # one rule in a new version: it alone runs again, over every blob; findings follow the version asked for
    rules = (replace(BASE[0], least=8, version=2), *BASE[1:])
    assert {r for _, r in pairs(scan(later, rows, folder, rules))} == {"assign@2"} and ledger(spark, folder).count() == 4 * (len(BASE) + 1)
    spans = lambda rules: {(r.path, r.version): [(s.kind, s.start, s.end) for s in r.spans] for r in findings(rows, ledger(spark, folder), rules).collect()}
    old, now = spans(BASE), spans(rules)
    assert old["a", 1] == old["a", 3] == old["b", 1] == [("assign", 0, 13)] and old["a", 2] == [] and old["c", 1] == [("hex", 0, 30)]
    assert now["a", 1] == [] and now["d", 1] == [("assign", 0, 16)] and len(now) == 6


def test_a_run_that_died_while_appending(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"token=abcdef{i % 7}") for i in range(50)], "doc_id long, text string")
    whole, part = f"file://{tmp_path}/whole", f"file://{tmp_path}/part"
    want = sorted(map(tuple, find_secrets(docs, whole).collect()))
    ledger(spark, whole).where("substr(hex(blob), 1, 1) < '8' AND rule <> 'hex@1'").write.parquet(part)
    ledger(spark, whole).where("rule = 'key@1'").write.mode("append").parquet(part)  # some rows twice
    assert sorted(map(tuple, find_secrets(docs, part).collect())) == want
    assert ledger(spark, part).select("blob", "rule").distinct().count() == 7 * len(RULES)


def test_a_text_under_many_paths_is_one_blob(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("secret = aaaabbbb").alias("text"))
    folder = f"file://{tmp_path}/ledger"
    got = find_secrets(docs, folder)
    assert ledger(spark, folder).count() == len(RULES) and got.where("spans = 'assign:0:17'").count() == 4000

"""The driver's queries over the operators of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.partenum import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.wavelet import document_digests, write_shards

    shards = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return document_digests(shards)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.winnowing import edited_neighbours

    return edited_neighbours(table(spark, sf_dir, "documents"))


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pseudolm import pseudo_likelihood

    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.permutation import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.maxplus import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import is_held_out, score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import base_digest, find_pii

    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", base_digest().alias("base_sha256"), "spans")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pagetext import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.filteraudit import audit, failures

    rows = audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secretledger import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.tokenalign import alignment

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


#: The same rule with a sort: documents in hash order, until the middle of one passes the rest of the target.
OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, md5(coalesce(text, '')) AS t FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM s),
p AS (SELECT *, coalesce(sum(3.0 * n) OVER q, 0) AS caps, coalesce(sum(w) OVER q, 0) AS ws, 3.0 * n / w AS ratio
      FROM w WINDOW q AS (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((t - caps) / (tw - ws)) AS level FROM p, (SELECT sum(n) AS t, sum(w) AS tw FROM p) WHERE (t - caps) / (tw - ws) <= ratio),
g AS (SELECT source, n, least(3.0 * n, level * w) AS target FROM p, l),
f AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(3, floor(target / n)) END AS base FROM g),
o AS (SELECT d.*, f.n, f.target, f.base, sum(size) OVER (PARTITION BY d.source ORDER BY h, t ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, n AS source_size, target,
       CAST(size * (base + CASE WHEN base < 3 AND 2 * before + size <= 2 * (target - base * n) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(base + CASE WHEN base < 3 AND 2 * before + size <= 2 * (target - base * n) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM o
"""


#: Every order is applied to every document: the first filter of the order that it fails removes it.
OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id AS e FROM documents),
g AS (SELECT part, CAST(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS INT) AS good, CAST(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS INT) AS toxic,
        concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
               CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM d),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM g GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
h AS (SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS bad, len(fails) = 1 AS single, regexp_matches(fails, '[' || substr(filter_order, 1, step - 1) || '-]') AS gone FROM c, s),
r AS (SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND bad), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (gone AND bad), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (bad AND single), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (NOT gone AND bad), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND bad), 0) AS BIGINT) AS toxic_lost FROM h GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


#: Every text by every pattern; offsets from the lengths of gaps and matches before.
def op12_sql() -> str:
    from tessera.llm.secretledger import BASE, RULES

    quoted = {r.kind: r.pattern.replace("'", "''") for r in RULES}
    each = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{quoted[r.kind]}') AS hits, regexp_extract_all(t, '{quoted[r.kind]}', {r.group}) AS vals, string_split_regex(t, '{quoted[r.kind]}') AS gaps FROM t"
        for i, r in enumerate(RULES))
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({each}),
u AS (SELECT doc_id, k, kind, least, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM m WHERE len(hits) > 0),
p AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS e FROM u),
f AS (SELECT doc_id, k, kind, e - length(hit) AS s, e FROM p WHERE length(val) >= least),
g AS (SELECT doc_id, {counts}, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {len(BASE)}), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""


def queries() -> dict[str, Query]:
    found = (op1_ngram_join, op2_wavelet_shards, op3_pseudo_likelihood, op4_permutation_index, op5_sentencepiece, op6_mix_sources, op7_toxicity, op8_winnowing, op9_pii_spans, op10_page_text, op11_filter_audit, op12_secret_ledger, op13_token_alignment)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_mix_sources": OP6, "op11_filter_audit": OP11, "op12_secret_ledger": op12_sql()}

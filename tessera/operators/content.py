"""What documents hold: codes in their content, typed records, work names, previews, spans (DO9-DO11, DO23, DO28, E6, E7, E10, T5, T8, A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.codes import candidate
from tessera.functions.text import display_text, sentences

PAYLOAD = "text STRING, value STRING, rawValue STRING, cells ARRAY<STRUCT<value: STRING>>, rows ARRAY<STRUCT<cells: ARRAY<STRUCT<value: STRING>>>>"
TABLE_LIKE = ("xlsx_cells", "pdf_tables", "statement_table")


def content_codes(artifacts: DataFrame) -> DataFrame:
    """DO11/U3/A9: codes in payloads (version_id, id, payload): in the text first, then in cells, then in the cells of rows; each code once for a version."""
    p = F.from_json("payload", PAYLOAD)
    rows = artifacts.select("version_id", "id", p.alias("p"))
    nested = F.flatten(F.transform("p.rows", lambda r: F.transform(r["cells"], lambda c: c["value"])))
    parts = [("direct", F.array("p.text", "p.value", "p.rawValue")), ("cell", F.transform("p.cells", lambda c: c["value"])), ("row", nested)]
    none = F.array().cast("array<struct<kind:string,pos:int,code:string>>")

    def tagged(kind: str, values: Column) -> Column:
        return F.coalesce(F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), candidate(v).alias("code"))), none)

    found = F.concat(*[tagged(*part) for part in parts])
    rows = rows.select("version_id", "id", F.posexplode(F.filter(found, lambda x: x["code"].isNotNull())).alias("n", "x"))
    w = Window.partitionBy("version_id", "x.code").orderBy("id", "n")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("version_id", "id", "n", "x.kind", "x.code")


def typed_records(versions: DataFrame, codes: DataFrame) -> DataFrame:
    """DO9/W1: a record for each version with its codes numbered; drawings have no own code."""
    rows = codes.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("id", "n", "code"))).alias("c"))
    both = versions.join(rows, "version_id", "left")
    numbered = F.transform("c", lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x["code"]))
    own = F.when(F.col("family") != "drawing", F.try_element_at("c", F.lit(1))["code"])
    return both.select("version_id", "family", own.alias("own_code"), F.coalesce(F.array_join(numbered, "|"), F.lit("")).alias("rows"))


def embedded_statements(versions: DataFrame, artifacts: DataFrame, codes: DataFrame) -> DataFrame:
    """DO10: a statement record beside each drawing that has codes and something like a table; its family stays."""
    tables = artifacts.where(F.col("artifact_type").isin(*TABLE_LIKE)).select("version_id").distinct()
    counts = codes.groupBy("version_id").agg(F.count("*").alias("rows"))
    return versions.where("family = 'drawing'").join(tables, "version_id", "left_semi").join(counts, "version_id").select("version_id", F.lit("statement").alias("family"), "rows")


def work_context(rows: DataFrame, construction: str = "construction", work: str = "work") -> DataFrame:
    """DO23/ST10: project, kind of work, stage, site, facility, part of it and scope, from the names of a construction and a work.

    A name is read in its segments between full stops. The facility is the first segment
    that is nothing else after the site, or after the stage, or before both; with three
    or more such segments the second is a part of the facility; the rest is the scope.
    """
    stage_is, site_is = r"(?iu)^этап\.?\s*\d+(?:[./]\d+)?", r"(?iu)^кс\s*-?\s*\d+"
    kind_is, other = r"(?iu)(?:строительн|монтажн|пусконаладочн|материал|оборудован|мтр|шлейф)", r"(?iu)^(?:один|одна|одно|два|две|три|четыре)\s+технологическ"
    quoted = r'(?iu)^([^\s]+\s*-?\s*\d+\s+"[^"]+")\s*(.*)$'
    clean = lambda c: F.filter(F.transform(sentences(display_text(c)), display_text), lambda x: x != "")
    at = lambda s, p: F.array_position(F.transform(F.col(s), lambda x: x.rlike(p)), True).cast("int")
    t = rows.withColumn("_c", F.coalesce(clean(F.col(construction)), F.array().cast("array<string>"))).withColumn("_s", F.coalesce(clean(F.regexp_replace(F.trim(work), r"(?iu)^на\s+", "")), F.array().cast("array<string>")))
    t = t.withColumn("_k", F.when(F.try_element_at("_s", F.lit(1)).rlike(kind_is), 1).otherwise(0)).withColumn("_st", at("_s", stage_is)).withColumn("_si", at("_s", site_is))
    site = F.when(F.col("_si") > 0, F.try_element_at("_s", F.col("_si")))
    name = F.when(site.rlike(quoted), display_text(F.regexp_extract(site, quoted, 1))).otherwise(site)
    tail = F.when(site.rlike(quoted), F.nullif(display_text(F.regexp_extract(site, quoted, 2)), F.lit("")))
    numbered = F.transform("_s", lambda x, i: F.struct(((i + 1) * 10).alias("i"), x.alias("x")))
    free = F.filter(numbered, lambda v: ~v["i"].isin(0) & (v["i"] != F.col("_k") * 10) & (v["i"] != F.col("_st") * 10) & (v["i"] != F.col("_si") * 10) & ~v["x"].rlike(other))
    with_tail = F.when(tail.isNotNull(), F.array_sort(F.concat(free, F.array(F.struct((F.col("_si") * 10 + 1).alias("i"), tail.alias("x")))))).otherwise(free)
    t = t.withColumn("_site", name).withColumn("_f", with_tail)
    after = lambda c: F.when(F.col(c) > 0, F.filter("_f", lambda v: v["i"] > F.col(c) * 10))
    first = F.least(F.when(F.col("_st") > 0, F.col("_st")), F.when(F.col("_si") > 0, F.col("_si")))
    before = F.when(first.isNotNull(), F.filter("_f", lambda v: (v["i"] > F.col("_k") * 10) & (v["i"] < first * 10)))
    some = lambda a: F.when(F.size(a) > 0, a)
    t = t.withColumn("_p", F.transform(F.coalesce(some(after("_si")), some(after("_st")), some(before), F.filter("_f", lambda v: v["i"] > F.col("_k") * 10)), lambda v: v["x"]))
    part = F.size("_p") >= 3
    stage = F.when(F.col("_st") > 0, F.regexp_replace(F.try_element_at("_s", F.col("_st")), r"(?iu)^этап\.?\s*", "Этап "))
    spare = lambda p: F.try_element_at(F.filter("_c", lambda x: x.rlike(p)), F.lit(1))
    lead = F.regexp_replace(display_text(F.col(construction)), r"(?iu)\s+этап\.?\s*\d.*$", "")
    project = F.nullif(F.try_element_at(clean(lead), F.lit(1)), F.lit(""))
    t = t.withColumns({"project": project, "work_kind": F.when(F.col("_k") == 1, F.try_element_at("_s", F.lit(1))), "stage": F.coalesce(stage, spare(stage_is)), "site": F.coalesce("_site", spare(site_is))})
    t = t.withColumns({"facility": F.try_element_at("_p", F.lit(1)), "subfacility": F.when(part, F.try_element_at("_p", F.lit(2))), "scope": F.nullif(F.array_join(F.slice("_p", F.when(part, 3).otherwise(2), 100), ". "), F.lit(""))})
    status = F.when(F.col("project").isNotNull() & (F.col("facility").isNotNull() | F.col("site").isNotNull() | F.col("stage").isNotNull()), "parsed").when(F.col("project").isNotNull() | (F.size("_s") > 0), "partial").otherwise("missing")
    return t.withColumn("parse_status", status).drop("_c", "_s", "_k", "_st", "_si", "_site", "_f", "_p")


def previews(artifacts: DataFrame, cells: int = 1000, letters: int = 20_000) -> DataFrame:
    """DO28/T8: what a viewer shows of each artifact: the first cells of a sheet, the first letters of a text, and whether that is all."""
    p = F.from_json("payload", PAYLOAD)
    n = F.coalesce(F.size("p.cells"), F.lit(0))
    rows = artifacts.select("id", "artifact_type", p.alias("p"))
    sheet = F.col("artifact_type") == "xlsx_cells"
    return rows.select("id", F.when(sheet, "cells").when(F.col("p.text").isNotNull(), "text").otherwise("fallback").alias("viewer"), F.when(sheet, F.array_join(F.transform(F.slice("p.cells", 1, cells), lambda c: c["value"]), "|")).otherwise(F.left("p.text", F.lit(letters))).alias("preview"), F.when(sheet, n > cells).otherwise(F.coalesce(F.length("p.text") > letters, F.lit(False))).alias("cut"))


def spans(logs: DataFrame) -> DataFrame:
    """Started and ended log rows (span_id, phase, at in microseconds) as spans with their duration; open ones have none."""
    at = lambda *phases: F.max(F.when(F.col("phase").isin(*phases), F.col("at")))
    out = logs.groupBy("span_id").agg(at("started").alias("begin"), at("completed", "failed").alias("end"), F.bool_or(F.col("phase") == "failed").alias("failed"))
    return out.select("span_id", F.floor((F.col("end") - F.col("begin")) / 1000).alias("duration_ms"), F.when(F.col("end").isNull(), "open").when(F.col("failed"), "failed").otherwise("completed").alias("status"))


#: Error codes after which a job is tried again (fixed values).
RETRYABLE = ("storage_unavailable", "timeout", "deadline_exceeded", "unavailable", "resource_exhausted")


def error_class(code: Column) -> Column:
    """E6"""
    return F.when(code.isin(*RETRYABLE), "transient").otherwise("deterministic")


def failed_sets(jobs: DataFrame) -> DataFrame:
    """Sets whose validation failed for good, with their new status."""
    return jobs.where("job_type = 'validate' AND status = 'failed'").select("set_id").distinct().withColumn("status", F.lit("failed"))


def locale_sorted(rows: DataFrame, column: str, locale: str = "ru") -> DataFrame:
    """T5: rows in the order of a language."""
    return rows.orderBy(F.collate(F.col(column), locale))

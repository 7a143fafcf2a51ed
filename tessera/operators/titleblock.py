"""Title blocks (DO7, DO8, J11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tenancy import keyed


def source_fields(rows: DataFrame, mapping: DataFrame, fallback: str = "form3", how: str = "inner") -> DataFrame:
    """DO7: rows (doc, form, field, text, pos) with the role of each field in its form; forms that the mapping has not are read as the fallback. With ``how`` left, fields without a role stay."""
    known = mapping.select("form").distinct().withColumn("_k", F.lit(True))
    rows = rows.join(F.broadcast(known), "form", "left").withColumn("form", F.when(F.col("_k"), F.col("form")).otherwise(fallback)).drop("_k")
    return rows.join(F.broadcast(mapping), ["form", "field"], how)


#: What a field of a title block can be.
ROLES = ("document_designation", "documentation_stage", "construction_object_name", "sheet_title", "product_or_document_name", "sheet_number")


def interpret(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """DO8/A9: the six roles of each document's title block, its status and warnings.

    documents: (doc, has_fields), whether a title block was read; fields: (doc, role, extraction, text,
    pos) of every field. A role has the value of its first field that was extracted. A
    document is ``interpreted`` if it has a designation, ``ambiguous`` if it has fields
    but no designation, else ``missing``; warnings are joined by a bar.
    """
    of = lambda role: F.min_by(F.when(F.trim("text") != "", F.col("text")), F.when((F.col("role") == role) & (F.col("extraction") == "extracted"), F.col("pos")))
    keys = keyed(documents, "doc")
    found = fields.groupBy(*keys).agg(*[of(r).alias(r) for r in ROLES], F.count("*").alias("_n"))
    rows = documents.join(found, keys, "left")
    lost = F.when(F.col(ROLES[0]).isNull(), "title_block_document_designation_missing")
    status = F.when(F.col(ROLES[0]).isNotNull(), "interpreted").when(F.col("_n") > 0, "ambiguous").otherwise("missing")
    return rows.select(*keys, *ROLES, status.alias("status"), F.concat_ws("|", F.when(~F.col("has_fields"), "stamp_source_fields_missing"), lost).alias("warnings"))

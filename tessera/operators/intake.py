"""Uploaded files: priorities, duplicates, validation, families, archives, cleanup (DO1-DO6, DO30, F8, F12, F13, J13, J14, U2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import search_text
from tessera.operators.tenancy import keyed

ARCHIVES = (".zip", ".rar", ".7z")
EXTRACTED = (".pdf", ".xlsx", ".xls")
MAX_ENTRIES, MAX_BYTES = 10_000, 50 * 1024**3


#: Media types of archives, and of what can be read.
ARCHIVE_TYPES = ("application/zip", "application/x-zip-compressed", "application/vnd.rar", "application/x-7z-compressed")
PDF_TYPE, XLSX_TYPE = "application/pdf", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"


def name_extension(name: Column) -> Column:
    """The extension of a path's last part with its dot; empty if there is none, or nothing before it."""
    return F.regexp_extract(name, r"[^/](\.[^./]*)$", 1)


def extension(df: DataFrame) -> Column:
    """The stated extension, or that of the name where none is stated, in lower case."""
    return F.lower(F.coalesce("extension", name_extension(F.col("original_name")))) if "extension" in df.columns else F.lower(name_extension(F.col("original_name")))


def priority(extension: Column) -> Column:
    return F.when(F.lower(extension) == ".xlsx", 2).when(F.lower(extension) == ".pdf", 1).otherwise(0)


def by_priority(files: DataFrame) -> DataFrame:
    """DO1/A10: of the files of a set and base name the one of highest priority (earliest of equals); files without priority all stay.

    The base name is that of ``dedupe_name`` where a file has one, taken as it is, else of
    the last part of its own name.
    """
    p = priority(extension(files))
    name = F.regexp_extract("original_name", r"([^/]*)/*$", 1)
    if "dedupe_name" in files.columns:
        name = F.coalesce("dedupe_name", name)
    stem = search_text(F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", ""))
    w = Window.partitionBy(*keyed(files, "set_id"), stem).orderBy(p.desc(), "id")
    return files.withColumn("_p", p).withColumn("_r", F.row_number().over(w)).where("_p = 0 OR _r = 1").drop("_p", "_r")


def duplicates(files: DataFrame, stored: DataFrame) -> DataFrame:
    """DO2: files that repeat a checksum of an earlier one of their set or of a stored original of their tenant."""
    w = Window.partitionBy(*keyed(files, "set_id", "checksum")).orderBy("id")
    on = keyed(files, "checksum")
    known = stored.where("checksum is not null").select(*on, F.lit(True).alias("_k")).distinct()
    rows = files.where("checksum is not null").withColumn("_r", F.row_number().over(w)).join(known, on, "left")
    return rows.where("_r > 1 OR _k").select(*keyed(files, "id"), F.when(F.col("_r") > 1, "request").otherwise("stored").alias("found_in"))


def is_archive(files: DataFrame) -> Column:
    """By extension, or by media type where the table has it."""
    by_name = F.coalesce(extension(files).isin(*ARCHIVES), F.lit(False))
    return by_name | F.coalesce(F.col("mime_type").isin(*ARCHIVE_TYPES), F.lit(False)) if "mime_type" in files.columns else by_name


def violations(files: DataFrame) -> DataFrame:
    """DO3: the first rule each file breaks, and whether it goes to unpacking."""
    rule = F.when(F.coalesce("size_bytes", F.lit(0)) <= 0, "empty_file").when(F.coalesce("checksum", F.lit("")) == "", "missing_checksum")
    return files.select(*keyed(files, "id"), rule.alias("code"), is_archive(files).alias("archive"))


def validate_sets(expected: DataFrame, files: DataFrame) -> DataFrame:
    """DO3: (set_id, code, file_id, next_step) for each set of expected (set_id, id).

    A set fails by ``stored_file_not_found`` if a file of it is not stored, else by the
    first file, in id order, that breaks a rule; what does not fail goes to unpacking if
    it has an archive, else to processing.
    """
    keys = keyed(expected, "set_id")
    found = violations(files).withColumn("_found", F.lit(True))
    rows = expected.select(*keys, "id").join(found, keyed(expected, "id"), "left")
    sets = rows.groupBy(*keys).agg(
        F.count_if(F.col("_found").isNull()).alias("lost"), F.min(F.when(F.col("code").isNotNull(), F.struct("id", "code"))).alias("first"), F.bool_or(F.coalesce("archive", F.lit(False))).alias("archive")
    )
    code = F.when(F.col("lost") > 0, "stored_file_not_found").otherwise(F.col("first.code"))
    step = F.when(F.col("code").isNotNull(), "failed").when(F.col("archive"), "unpack").otherwise("process")
    return sets.withColumn("code", code).select(*keys, "code", F.when(F.col("lost") == 0, F.col("first.id")).alias("file_id"), step.alias("next_step"))


def file_format(extension: Column, mime_type: Column | None = None) -> Column:
    """DO4: what can be read, by extension or media type; Q9: ``.xls`` is not."""
    e = F.lower(extension)
    of = lambda ending, kind: F.coalesce(e == ending, F.lit(False)) | (F.coalesce(mime_type == kind, F.lit(False)) if mime_type is not None else F.lit(False))
    return F.when(of(".pdf", PDF_TYPE), "pdf").when(of(".xlsx", XLSX_TYPE), "xlsx").otherwise("unsupported")


def family(name: Column) -> Column:
    """DO5: family by words of the file name."""
    n = F.lower(name)
    some = lambda *ws: F.greatest(*[n.contains(w) for w in (*ws, ws[0])])
    return F.when(some("statement", "register", "vedomost", "volume-list"), "statement").when(some("estimate", "smeta"), "estimate").when(n.contains("drawing") | n.endswith(".pdf"), "drawing").otherwise("unknown")


def resolve_type(files: DataFrame, title_blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """DO6: drawing if a title block was read, else estimate if a template matched, else by name; with how sure that is."""
    rows = files.join(title_blocks.select("id", F.lit("drawing").alias("_b")), "id", "left").join(templates.select("id", F.lit("estimate").alias("_t"), "template_confidence"), "id", "left")
    named = family(F.col("original_name"))
    sure = F.when(F.col("_b").isNotNull(), "high").when(F.col("_t").isNotNull(), F.col("template_confidence")).when(named == "unknown", "none").otherwise("low")
    return rows.select("id", F.coalesce("_b", "_t", named).alias("family"), sure.alias("confidence"), F.when(F.coalesce("_b", "_t") != named, named).alias("alternative"))


def safe_path(path: Column) -> Column:
    """a relative path that stays inside its folder."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~(p.rlike(r"^/|^[A-Za-z]:") | p.rlike(r"(^|/)\.\.(/|$)") | (p == ""))


def archive_guard(entries: DataFrame) -> DataFrame:
    """Entries and expanded bytes of each archive, and whether they are within the limits."""
    out = entries.groupBy("archive_id").agg(F.count("*").alias("entries"), F.sum("size_bytes").alias("bytes"))
    return out.withColumn("allowed", (F.col("entries") <= MAX_ENTRIES) & (F.col("bytes") <= MAX_BYTES))


def visible(files: DataFrame, provenance: DataFrame) -> DataFrame:
    """F8: original uploads, and generated files that came out of an archive."""
    out = provenance.where("relation = 'extracted_from_archive'").select(F.col("child_id").alias("id")).distinct()
    own = files.where("purpose = 'original_upload'")
    return own.unionByName(files.where("purpose <> 'original_upload'").join(out, "id", "left_semi"))


def match_entries(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files to archive entries, by equal path first; of the rest by size and extension where only one of each has them."""
    exact = files.join(entries.select("archive_id", "path", "entry_id"), ["archive_id", "path"]).select("file_id", "entry_id", F.lit("path").alias("by"))
    f = files.join(exact.select("file_id"), "file_id", "left_anti")
    e = entries.join(exact.select("entry_id"), "entry_id", "left_anti")
    keys = ["archive_id", "size_bytes", "extension"]
    one = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(c).alias(c)).where("_n = 1").drop("_n")
    return exact.union(one(f, "file_id").join(one(e, "entry_id"), keys).select("file_id", "entry_id", F.lit("size").alias("by")))


def cleanup(scanned: DataFrame, referenced: DataFrame) -> DataFrame:
    """DO30/J14/U2: stored keys that no record refers to."""
    return scanned.select("key").distinct().join(referenced.select("key").distinct(), "key", "left_anti")

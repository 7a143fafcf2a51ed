"""Document codes: normal form, segments, parts, status, identities (ST1-ST5, AR1, AR2, DO11-DO16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import WS, similarity, structure_title, token_jaccard, trim

#: Stage letters and what they mean (fixed values).
STAGES = {"P": "П", "П": "П", "R": "Р", "Р": "Р", "I": "И", "И": "И", "ИИ": "ИИ"}
#: Words of a file name that are not part of a code (fixed values).
STOP_WORDS = ("DRAWING", "ESTIMATE", "SMETA", "STATEMENT", "REGISTER", "VEDOMOST", "PROJECT", "PD", "RD", "PDF", "XLSX")
#: Standards whose codes are known but not read (fixed values).
UNSUPPORTED = ("ISO", "IFC", "BS", "DIN", "UNSUPPORTED")
LETTERS = "^[A-ZА-ЯЁ]{1,8}$"


def plain_segment(c: Column) -> Column:
    """Digits without leading zeros in each part between slashes."""
    return F.array_join(F.transform(F.split(c, "/"), lambda p: F.when(p.rlike(r"^\d+$"), F.regexp_replace(p, r"^0+(?=\d)", "")).otherwise(p)), "/")


def normalize(c: Column) -> Column:
    """ST1: upper case, single dashes between segments, plain numbers."""
    c = F.regexp_replace(F.regexp_replace(trim(c), f"(?:[_.]|{WS})+", "-"), "-+", "-")
    return F.array_join(F.transform(F.split(F.upper(c), "-"), plain_segment), "-")


def segments(c: Column) -> Column:
    """ST2: the parts between dashes, points and spaces, empty ones left out."""
    return F.filter(F.transform(F.split(F.upper(trim(c)), f"(?:[-.]|{WS})+"), plain_segment), lambda x: x != "")


def candidate(c: Column) -> Column:
    """ST3: a text as a code without the stop words, if it has a digit and a dash."""
    n = normalize(c)
    kept = F.filter(F.split(n, "-"), lambda x: ~x.isin(*STOP_WORDS))
    return F.when(n.rlike("[0-9]") & n.contains("-") & (F.size(kept) > 0), F.array_join(kept, "-"))


def stage(c: Column) -> Column:
    """ST4"""
    out = F.lit(None).cast("string")
    for k, v in STAGES.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def first(a: Column, keep) -> Column:
    """AR1: the first element that fits, or null."""
    return F.try_element_at(F.filter(a, keep), F.lit(1))


def after_first(a: Column, pattern: str, by: int) -> Column:
    """The element so many places after the first that fits."""
    i = F.array_position(F.transform(a, lambda x: x.rlike(pattern)), True)
    return F.when(i > 0, F.try_element_at(a, (i + by).cast("int")))


def prefixed(s: Column, prefix: str) -> Column:
    """ST5: what follows a prefix in the first segment that starts with it; the segment itself if nothing follows."""
    x = first(s, lambda v: v.startswith(prefix))
    return F.when(F.length(x) > len(prefix), F.substring(x, len(prefix) + 1, 1 << 20)).otherwise(x)


def parse(codes: DataFrame, column: str = "code") -> DataFrame:
    """DO12/DO13/AR1: the parts of normalized codes and whether they can be used, beside the columns there are."""
    s = F.col("_s")
    rows = codes.withColumn("_s", F.when(F.coalesce(column, F.lit("")) == "", F.array().cast("array<string>")).otherwise(segments(F.col(column))))
    at = F.array_position(F.transform(s, lambda x: stage(x).isNotNull()), True)
    rows = rows.withColumn("_at", at.cast("int"))
    found = F.col("_at") > 0
    rows = rows.withColumn("_after", F.when(found, F.slice(s, F.col("_at") + 1, 1000)).otherwise(F.array().cast("array<string>")))
    after = F.col("_after")
    physical = (F.col("_at") >= 3) & F.try_element_at(s, F.lit(1)).rlike(r"^\d+$") & F.try_element_at(s, F.lit(2)).rlike(r"^\d+$")
    mark = F.try_element_at(F.filter(F.when(found, after).otherwise(F.slice(s, 2, 1000)), lambda x: x.rlike(LETTERS) & stage(x).isNull()), F.lit(-1))
    rows = rows.withColumn("mark", mark)
    sect = F.array_position(F.transform(after, lambda x: x.rlike(r"^\d+(?:/\d+)?$")), True).cast("int")
    volume = F.when(sect > 0, first(F.slice(after, sect + 1, 1000), lambda x: x.rlike(r"^\d+$"))).otherwise(first(after, lambda x: x.rlike(r"^\d{1,4}$")))
    project = F.try_element_at(s, F.lit(1))
    status = (
        F.when(project.isNull() | ~project.rlike("^[A-ZА-ЯЁ0-9][A-ZА-ЯЁ0-9]*$"), "invalid")
        .when(F.arrays_overlap(s, F.array(*map(F.lit, UNSUPPORTED))), "unsupported")
        .otherwise("parsed")
    )
    out = {
        "project_code": project,
        "site_code": F.when(physical, F.try_element_at(s, F.lit(2))),
        "stage": F.when(found, stage(F.try_element_at(s, F.col("_at")))),
        "section_number": F.coalesce(prefixed(s, "SEC"), first(after, lambda x: x.rlike(r"^\d+(?:/\d+)?$"))),
        "volume_number": F.coalesce(prefixed(s, "VOL"), volume),
        "revision": prefixed(s, "REV"),
        "document_group": first(after, lambda x: x.rlike(LETTERS) & (F.col("mark").isNull() | (x != F.col("mark")))),
        "document_number": after_first(after, LETTERS, 1),
        "work_code": F.when(physical, after_first(after, LETTERS, 2)),
        "subobject_code": F.when(physical, after_first(after, LETTERS, 3)),
        "part_number": F.when(physical, after_first(after, LETTERS, 4)),
        "ambiguity": F.when(F.col("mark").isNotNull() & ~found, "mark_without_documentation_stage"),
        "status": status,
    }
    return rows.withColumns(out).drop("_s", "_at", "_after")


def facets(c: Column) -> Column:
    """AR2: stage and mark as listings read them; unlike in ``parse`` a mark needs a stage."""
    s = segments(c)
    at = F.array_position(F.transform(s, lambda x: stage(x).isNotNull()), True).cast("int")
    mark = F.try_element_at(F.filter(F.slice(s, at + 1, 1000), lambda x: x.rlike(LETTERS) & stage(x).isNull()), F.lit(-1))
    return F.struct(F.when(at > 0, stage(F.try_element_at(s, at))).alias("stage"), F.when(at > 0, mark).alias("mark"))


def identities(codes: DataFrame) -> DataFrame:
    """DO14/ST25/U3: identities of codes (version_id, role, pos, raw): the first own code, all references, or a row that the own code is missing."""
    rows = codes.withColumn("value", normalize(F.col("raw"))).where("value <> ''")
    w = Window.partitionBy("version_id", "role").orderBy("pos")
    rows = parse(rows.withColumn("i", F.row_number().over(w) - 1).where("role = 'reference_code' OR i = 0"), "value")
    key = F.when(F.col("role") == "own_code", F.concat_ws(":", "role", "status", "value")).otherwise(F.concat_ws(":", "role", "status", "value", F.col("i").cast("string")))
    own = rows.where("role = 'own_code'").select("version_id").distinct()
    lost = codes.select("version_id").distinct().join(own, "version_id", "left_anti")
    missing = lost.select("version_id", F.lit("own_code").alias("role"), F.lit("own_code:missing").alias("identity_key"), F.lit(None).cast("string").alias("value"), F.lit("missing").alias("status"))
    return rows.select("version_id", "role", key.alias("identity_key"), "value", "status").unionByName(missing)


def placement_choice(identities_: DataFrame, estimates: DataFrame) -> DataFrame:
    """DO15: the identity that places each version: of estimates the first parsed reference, then the first reference that can place, then the own one; of others the own one."""
    rows = identities_.join(estimates.select("version_id", F.lit(True).alias("estimate")), "version_id", "left")
    can = F.col("value").isNotNull() & (F.col("status") != "invalid")
    rank = F.when(F.col("estimate") & (F.col("role") == "reference_code") & (F.col("status") == "parsed"), 0).when(F.col("estimate") & (F.col("role") == "reference_code") & can, 1).when(F.col("role") == "own_code", 2)
    return rows.withColumn("rank", rank).where("rank is not null").groupBy("version_id").agg(F.min_by("identity_key", F.struct("rank", "identity_key")).alias("identity_key"))


def title_match(a: Column, b: Column) -> Column:
    """DO16: whether two titles can be of one node: equal, or one empty, or close by words or by letters."""
    x, y = structure_title(a), structure_title(b)
    return (x == y) | (x == "") | (y == "") | (token_jaccard(x, y) >= 0.7) | (similarity(x, y) >= 0.82)


def title_conflicts(titles: DataFrame) -> DataFrame:
    """DO16: (node_id, id, title, status) in order of arrival: the first title that is no placeholder names the node, close ones agree, others are ambiguous."""
    w = Window.partitionBy("node_id").orderBy("id")
    real = structure_title(F.col("title")) != structure_title(F.col("key"))
    named = titles.withColumn("node_title", F.first(F.when(real, F.col("title")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    status = F.when(F.col("node_title").isNull() | title_match(F.col("title"), F.col("node_title")) | ~real, "placed").otherwise("ambiguous")
    return named.select("node_id", "id", "title", status.alias("status"))

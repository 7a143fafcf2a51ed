"""Text as columns (ST1-ST25, M1, JS1-JS5, D4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript has it: NBSP and the byte order mark as well.
WS = r"[\s ﻿ -     　 ]"
#: Latin letters that look like Cyrillic ones, and these (fixed values).
LATIN = "ABCEHKMOPTXYaceopxy"
CYRILLIC = "АВСЕНКМОРТХУасеорху"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def search_text(c: Column) -> Column:
    """ST7: trimmed, white space collapsed, lower case."""
    return F.lower(F.regexp_replace(trim(c), f"{WS}+", " "))


def display_text(c: Column) -> Column:
    """ST6: plain quotes and dashes, single spaces, no space before punctuation, none of it at the end."""
    c = F.translate(trim(c), "«»“”–—−", '""""---')
    c = F.regexp_replace(F.regexp_replace(c, f"{WS}+", " "), r" +([.,;:])", "$1")
    return F.regexp_replace(c, r"[.,;:\s]+$", "")


def structure_title(c: Column) -> Column:
    """ST8: quotes and dashes made plain, ``кс N`` joined, everything but letters and digits a space, lower case."""
    c = F.regexp_replace(F.translate(trim(c), "«»“”–—−", '""""---'), r"(?iu)кс\s*-?\s*(\d+)", "кс-$1")
    return F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))


def sentences(c: Column) -> Column:
    """ST9: parts between full stops; a stop between digits does not part."""
    return F.filter(F.transform(F.split(c, r"(?<!\d)\.|\.(?!\d)"), trim), lambda x: x != "")


def base_name(c: Column) -> Column:
    """ST19: last part of a path without its extension, spaces collapsed, lower case."""
    name = F.element_at(F.split(c, "[/\\\\]"), -1)
    return search_text(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def number(c: Column) -> Column:
    """M1: the first signed number in a text, spaces inside it dropped, comma or point before decimals."""
    # an empty text would be cast by way of an exception
    found = F.regexp_extract(F.when(c.rlike(r"\d"), c), r"[-+]?\d[\d\s]*(?:[,.]\d+)?", 0)
    return F.translate(F.regexp_replace(found, r"\s+", ""), ",", ".").try_cast("double")


def noise(c: Column) -> Column:
    """ST17: share of letters that do not belong in a table; 1 for an empty text."""
    t = F.trim(c)
    bad = F.length(F.regexp_replace(t, r"[0-9A-Za-zА-Яа-яЁё№.,:;()/%+\-–—\s\"'«»×xХхØ²³]", ""))
    return F.when(t == "", 1.0).otherwise(bad / F.greatest(F.length(t), F.lit(1)))


def repair_confusables(c: Column) -> Column:
    """ST11: in words with a Cyrillic letter, Latin look-alikes become Cyrillic."""
    words = F.regexp_extract_all(c, F.lit(r"([0-9A-Za-zА-Яа-я]+|[^0-9A-Za-zА-Яа-я]+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("[А-Яа-я]"), F.translate(w, LATIN, CYRILLIC)).otherwise(w)), "")


def ordinal(c: Column) -> Column:
    """ST13: letters that stand for digits made digits, the rest dropped."""
    return F.regexp_replace(F.translate(c, "OОoоIl|", "0000111"), r"[^0-9]", "")


def designation(c: Column) -> Column:
    """ST12: O for zero between digits, and a digit doubled in a five-digit prefix taken out."""
    c = F.regexp_replace(F.upper(trim(c)), r"(?<=\d)[OО](?=\d)", "0")
    return F.when(c.rlike(r"^\d{5}-"), F.regexp_replace(c, r"^(\d*?)(\d)\2(\d*-)", "$1$2$3")).otherwise(c)


def technical(c: Column) -> Column:
    """ST14: powers of units, diameter signs and roman numerals as they are meant."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?<![\p{L}])(м|см|мм|km|m)2(?!\d)", "$1²"), r"(?<![\p{L}])(м|см|мм|km|m)3(?!\d)", "$1³")
    return F.regexp_replace(F.regexp_replace(c, r"(?<!\S)[ØøФф](?=\s?\d)", "Ø"), r"(?<![\p{L}])ПИ(?![\p{L}])", "III")


def table_cell(c: Column) -> Column:
    """ST15: steel and concrete grades and footnote stars without stray spaces."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?iu)\b([cс])\s*(\d{3})\b", "С$2"), r"(?iu)\b[bв]\s?(\d{2})\b", "В$1")
    return F.regexp_replace(c, r"\s+(\*+)(?=\s|$)", "$1")


def by_kind(kind: Column, c: Column) -> Column:
    """ST16: the normalizer of a candidate's kind."""
    return F.when(kind == "table_cell", table_cell(technical(c))).when(kind == "designation", designation(c)).when(kind == "ordinal", ordinal(c)).otherwise(repair_confusables(c))


def suspicious(c: Column, confidence: Column) -> Column:
    """ST18: scripts mixed in words, or few letters and digits in a short text, at less than sure confidence."""
    words = F.regexp_extract_all(c, F.lit(r"([\p{L}]+)"), 1)
    mixed = F.size(F.filter(words, lambda w: w.rlike(r"[A-Za-z]") & w.rlike(r"[А-Яа-я]"))) / F.greatest(F.size(words), F.lit(1))
    dense = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) / F.greatest(F.length(c), F.lit(1))
    return (confidence < 0.85) & ((mixed >= 0.22) | ((F.length(c) <= 12) & (dense < 0.35)))


def similarity(a: Column, b: Column) -> Column:
    """ST20: 1 less the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_jaccard(a: Column, b: Column) -> Column:
    """U4: shared over all distinct words."""
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def safe_filename(c: Column) -> Column:
    """ST21: ASCII fallback of a name for a header."""
    return F.regexp_replace(c, r'[^\x20-\x7e]|["\\]', "_")


def a1(c: Column) -> Column:
    """ST22: (row, col) of an address such as AB12; col counts A as 1."""
    letters = F.split(F.regexp_extract(c, "^([A-Z]+)", 1), "")
    col = F.aggregate(letters, F.lit(0), lambda acc, x: F.when(x == "", acc).otherwise(acc * 26 + F.ascii(x) - 64))
    return F.struct(F.regexp_extract(c, "([0-9]+)$", 1).try_cast("int").alias("row"), col.alias("col"))


def to_a1(row: Column, col: Column) -> Column:
    """The address of a place, for columns up to ZZ."""
    letter = lambda n: F.char((n + 65).cast("int"))
    return F.concat(F.when(col > 26, letter(F.floor((col - 1) / 26) - 1)).otherwise(""), letter((col - 1) % 26), row.cast("string"))


def estimate_number(c: Column) -> Column:
    """ST23: what follows the number sign."""
    return F.nullif(trim(F.regexp_extract(c, r"№\s*([^\n\r]+)", 1)), F.lit(""))


def iso(c: Column) -> Column:
    """UTC time with milliseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

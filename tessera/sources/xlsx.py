"""Spreadsheet source (SC5-SC7, JS5): workbooks of a folder as rows of cells, columns, rows and merges.

A workbook is read with the standard library's zip and XML readers, sheet by sheet and
element by element, so that a sheet of any size is a stream. Broken files give one row
of kind ``error`` instead of an exception.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "path string, sheet string, kind string, row int, col int, value string, value_type string, number double, hidden boolean, ref string"
COLUMNS = ["path", "sheet", "kind", "row", "col", "value", "value_type", "number", "hidden", "ref"]


def place(ref: str) -> tuple[int, int]:
    """(row, col) of an address, both from 1."""
    m = re.fullmatch(r"([A-Z]+)([0-9]+)", ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def _text(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{NS}t"))


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of each sheet of a workbook whose member is there."""
    names = set(z.namelist())
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    found = [(s.get("name"), targets[s.get(REL)]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{NS}sheet")]
    found = [(name, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for name, t in found]
    return [(name, t) for name, t in found if t in names]


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    shared = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{NS}si":
                shared.append(_text(e))
                e.clear()
    return shared


def read_sheet(z: zipfile.ZipFile, name: str, target: str) -> Iterator[tuple]:
    """Rows of one sheet, without the workbook's path."""
    shared = shared_strings(z)
    with z.open(target) as f:
        row = 0
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            if event == "start":
                if e.tag == f"{NS}row":
                    row = int(e.get("r") or row + 1)
                continue
            if e.tag == f"{NS}c":
                ref = e.get("r")
                r, c = place(ref) if ref else (row, 0)
                kind, v, formula = e.get("t") or "n", e.find(f"{NS}v"), e.find(f"{NS}f") is not None
                raw = v.text if v is not None and v.text else ""
                if kind == "s" and raw:
                    value, sort = shared[int(raw)], "string"
                elif kind == "inlineStr":
                    value, sort = _text(e), "string"
                elif kind == "b":
                    value, sort = ("true" if raw == "1" else "false"), "boolean"
                else:
                    value, sort = raw, "string" if kind in ("str", "e") else "number"
                if value != "":
                    yield name, "cell", r, c, value, "formula" if formula else sort, float(raw) if sort == "number" else None, None, ref
                e.clear()
            elif e.tag == f"{NS}row":
                if e.get("ht") or e.get("hidden"):
                    yield name, "row", row, None, None, None, float(e.get("ht") or 15), e.get("hidden") == "1", None
                e.clear()
            elif e.tag == f"{NS}col":
                for c in range(int(e.get("min")), min(int(e.get("max")), int(e.get("min")) + 16384) + 1):
                    yield name, "column", None, c, None, None, float(e.get("width") or 8.43), e.get("hidden") == "1", None
            elif e.tag == f"{NS}mergeCell":
                yield name, "merge", None, None, None, None, None, None, e.get("ref")


def read_workbook(content: bytes) -> Iterator[tuple]:
    """Rows of one workbook, without its path."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name, target in sheets(z):
            yield from read_sheet(z, name, target)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """All workbooks below a path, one row for each cell that is not empty, sized row or column, and merge."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                out: list[tuple] = []
                try:
                    for row in read_workbook(content):
                        out.append((name, *row))
                        if len(out) >= 10_000:
                            yield _frame(out)
                            out = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as e:
                    out.append((name, None, "error", None, None, type(e).__name__, None, None, None, None))
                if out:
                    yield _frame(out)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({"row": "Int32", "col": "Int32", "hidden": "boolean"})

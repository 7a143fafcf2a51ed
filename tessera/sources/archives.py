"""Archive sources (SC9, SC10, F12, F13): listings of an archive tool and members of zip files."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.intake import EXTRACTED, MAX_BYTES, MAX_ENTRIES, safe_path


def decode_listing(content: F.Column) -> F.Column:
    """Text of a listing in code page 866."""
    return F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode("cp866", "replace") if b is not None else None), "string")(content)


def parse_listing(listings: DataFrame) -> DataFrame:
    """SC9: (archive, path, size_bytes, folder) from the ``Key = value`` blocks of a listing, which empty lines part."""
    body = F.element_at(F.split("text", r"(?m)^-{10}\r?\n?"), -1)
    blocks = listings.select("archive", F.explode(F.split(body, r"\r?\n\s*\r?\n")).alias("b"))
    value = lambda key: F.nullif(F.regexp_extract("b", rf"(?m)^{key} = (.*?)\r?$", 1), F.lit(""))
    rows = blocks.select("archive", value("Path").alias("path"), value("Size").try_cast("long").alias("size_bytes"), (F.coalesce(value("Folder"), F.lit("-")) == "+").alias("folder"))
    return rows.where("path is not null")


def extract_zip(spark: SparkSession, path: str) -> DataFrame:
    """SC10: supported members of all zip files below a path with size, sha256 and content; unsafe paths are left out.

    An archive over the limits or broken gives one row with an error and no content.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "path", "size_bytes", "checksum", "content", "error"]
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        entries = [i for i in z.infolist() if not i.is_dir()]
                        if len(entries) > MAX_ENTRIES or sum(i.file_size for i in entries) > MAX_BYTES:
                            yield pd.DataFrame([(name, None, None, None, None, "archive_limits")], columns=columns)
                            continue
                        for i in entries:
                            if i.filename.lower().endswith(EXTRACTED):
                                data = z.read(i)
                                yield pd.DataFrame([(name, i.filename, len(data), hashlib.sha256(data).hexdigest(), data, None)], columns=columns)
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
                    yield pd.DataFrame([(name, None, None, None, None, type(e).__name__)], columns=columns)

    out = files.select("path", "content").mapInPandas(run, "archive string, path string, size_bytes long, checksum string, content binary, error string")
    return out.where(F.col("error").isNotNull() | safe_path(F.col("path")))

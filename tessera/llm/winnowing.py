"""Document fingerprints by winnowing.

A rolling hash of every k-gram of code points; of each window of w neighbouring
k-grams the least hash is kept, the rightmost one of equals. Two texts that share a
passage of at least ``w + k - 1`` code points share a kept hash, and positions say where.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.ordering import LEAST, default_parts, id_cuts, part_of

#: A shared passage of 15 code points is found for sure, so half of every text from 29 on.
K, W = 8, 8
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _kgram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams, built from runs of doubling length."""
    run, length, out, have = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1, None, 0
    while True:
        if k & length:
            out = run if out is None else out[: len(run) - have] * np.uint64(pow(_BASE, length, 1 << 64)) + run[have:]
            have += length
            out = out[: len(points) - have + 1]
        if have == k:
            break
        run = run[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + run[length:]
        length *= 2
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return out >> np.uint64(32)


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept of a text, in order of position.

    A text shorter than k has the hash of its whole sequence at position 0; one with
    at most w k-grams keeps the rightmost least of them; an empty one keeps nothing.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    key = _kgram_hashes(points, min(k, len(points)))
    key = (key << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(key), dtype=np.uint64))
    width, step = min(w, len(key)), 1
    while step < width:  # least of `step` neighbours becomes least of `width` by overlapping runs
        move = min(step, width - step)
        key = np.minimum(key[:-move], key[move:])
        step += move
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    return (key >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)


def to_string(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Ten hexadecimal digits for each kept k-gram: eight of the hash, two of the step from the position before (at most w)."""
    packed = np.empty((len(hashes), 5), np.uint8)
    packed[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    packed[:, 4] = np.diff(positions, prepend=0)
    return packed.tobytes().hex()


def from_string(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return packed[:, :4].copy().view(">u4").reshape(-1).astype(np.uint32), np.cumsum(packed[:, 4].astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes over all distinct hashes; 1 for two empty ones. Takes arrays from np.unique."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_kept, fingerprint, hashes, positions) for each row; null text counts as empty."""

    @F.pandas_udf("n_kept long, fingerprint string, hashes array<long>, positions array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [winnow(t or "") for t in texts]
        return pd.DataFrame({"n_kept": [len(h) for h, _ in found], "fingerprint": [to_string(h, p) for h, p in found], "hashes": [h.astype(np.int64) for h, _ in found], "positions": [p for _, p in found]})

    return docs.select(F.col(f"`{id_col}`"), run(F.col(f"`{text_col}`")).alias("_w")).select(F.col(f"`{id_col}`"), "_w.*")


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Each document against a copy whose second half comes from the next one, in descending id order.

    Returns (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next). Rows of equal id stand in text order; null ids come last; the last
    row's next is the first. A single row is its own next. Null text counts as empty.

    The ids are cut into ranges; each range's rows and the first row of the range
    after it meet in one task and are read as a stream, so a task holds two texts.
    The driver sees one id for each range.
    """
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(id_col).isNull().alias("none"))
    small_batches(docs.sparkSession)
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("k"))
    cuts = id_cuts(ids, "k", parts or default_parts(docs))
    heads = dict(ids.groupBy(part_of("k", cuts).alias("p")).agg(F.max("k")).collect())
    order = sorted(heads, reverse=True)
    follows = [(heads[p], order[n - 1]) for n, p in enumerate(order)]  # the head of a part closes the part above it
    halo = F.create_map(*[x for head, above in follows for x in (F.lit(head).cast("long"), F.lit(above))]) if follows else F.create_map().cast("map<bigint,int>")
    placed = slim.withColumn("p", part_of("k", cuts))
    copies = F.array_compact(F.array(F.struct("p", F.lit(False).alias("halo")), F.when(halo[F.col("k")].isNotNull(), F.struct(halo[F.col("k")].alias("p"), F.lit(True).alias("halo")))))
    rows = placed.withColumn("x", F.explode(copies)).select("x.p", "x.halo", "k", "t", "none")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "p").sortWithinPartitions("p", "halo", F.desc("k"), "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            out = []
            for p, is_halo, k, t, none in zip(b["p"], b["halo"], b["k"], b["t"], b["none"]):
                if held and held[0] != p:
                    held = None  # its halo row has closed it
                if is_halo and not held:
                    continue  # rows of one id beside the halo row
                hashes, at = winnow(t)
                mine = np.unique(hashes)
                if held:
                    _, k0, t0, none0, h0, at0, set0 = held
                    half = len(t0) // 2
                    edited = t0[: len(t0) - half] + t[:half]
                    he, ate = winnow(edited)
                    out.append((None if none0 else k0, len(t0), hashlib.sha256(edited.encode()).hexdigest(), to_string(h0, at0), to_string(he, ate), likeness(set0, np.unique(he)), likeness(set0, mine)))
                held = None if is_halo else (p, k, t, none, hashes, at, mine)
            yield pd.DataFrame(out, columns=["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"k": "Int64"})

    out = rows.mapInPandas(run, "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("k", id_col)

"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Vectors are posted under these
pivots with their place in the order; a query adds up, over its own pivots' posting
lists, how far places differ (the footrule distance, a missing pivot counting as the
first place left out), keeps the nearest part of a segment, and ranks that by the exact
measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import forget, written

PIVOTS, PREFIX, SEGMENT, QUERIES = 256, 32, 8192, 256
#: The part of a segment that is ranked exactly.
PART = 0.25
#: Pivots come from the rows of smallest id hash, so many at most.
SAMPLE = 4096


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows with an id and a vector that is not null, empty or zero and whose components are all finite."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    return out.where(~bad & F.exists("v", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(rows: DataFrame, pivots: int) -> np.ndarray:
    """The first different vectors of a sample in the order of their id's hash."""
    found = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    if not found:
        return np.empty((0, 0))
    x = np.array([r[0] for r in found])
    _, first = np.unique(x, axis=0, return_index=True)
    return unit(x[np.sort(first)[:pivots]])


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each (unit) vector its nearest pivots, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, : min(prefix, len(pivots))]


class Segment:
    """Inverted file over some vectors: for each pivot who has it, and at which place."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, who: np.ndarray, place: np.ndarray, start: np.ndarray, prefix: int) -> None:
        self.ids, self.x, self.who, self.place, self.start, self.prefix = ids, x, who, place, start, prefix
        self.unit = unit(x)

    @staticmethod
    def post(near: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(who, place, start) of the posting lists of some orders, by pivot."""
        flat = near.reshape(-1)
        order = np.argsort(flat, kind="stable")
        return (order // near.shape[1]).astype(np.int32), (order % near.shape[1]).astype(np.int16), np.searchsorted(flat[order], np.arange(pivots + 1)).astype(np.int64)

    def footrule(self, near: np.ndarray) -> np.ndarray:
        """Footrule distances of all vectors from an order, less a constant."""
        score = np.zeros(len(self.ids), np.int32)
        for place, pivot in enumerate(near):
            a, b = self.start[pivot], self.start[pivot + 1]
            other = self.place[a:b].astype(np.int32)
            score[self.who[a:b]] += np.abs(other - place) + other + place - 2 * self.prefix
        return score

    def nearest(self, query: np.ndarray, own: int, near: np.ndarray, k: int, part: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the k nearest among the part of smallest footrule distance; rows with id ``own`` take no part."""
        keep = np.flatnonzero(self.ids != own)
        some = max(16 * k, int(np.ceil(part * len(self.ids))))
        if some < len(keep):
            score = self.footrule(near)[keep]
            edge = np.partition(score, some - 1)[some - 1]
            close, tied = keep[score < edge], keep[score == edge]
            rest = np.lexsort((self.ids[tied],))[: some - len(close)]
            keep = np.concatenate([close, tied[rest]])
        if not len(keep):
            return np.empty(0, np.int64), np.empty(0)
        rough = self.unit[keep] @ unit(query[None])[0]
        if k < len(keep):
            keep = keep[rough >= np.partition(rough, -k)[-k] - 1e-9]
        cos = cosines(self.x[keep], query)
        best = np.lexsort((self.ids[keep], -cos))[:k]
        return self.ids[keep][best], cos[best]


def near_one(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component near 1, so that no square overflows or is lost; no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The same sum for every row, whatever stands beside it, so that equal vectors tie exactly."""
    rows, query = near_one(rows), near_one(query)
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, part: float = PART, segment: int = SEGMENT) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest of each row whose id is divisible by ``every``, by cosine.

    All rows but those of the query's own id are candidates; ties go to the smaller id. Null,
    empty, zero and non-finite vectors take no part, nor do vectors of another length
    than the pivots'. Repeated rows are candidates each, and queries each, with ranks of
    their own. No usable rows give no rows.

    Every row is posted in one of a number of segments of about ``segment`` rows, whose
    inverted files are stored. A segment is moved once; the queries, in blocks, come to
    each as a stream behind it, so a task holds one segment and one block. Pivots are the
    one fitted thing.
    """
    rows = usable(vectors, id_col, vec_col)
    chosen = choose_pivots(rows, pivots)
    spark = vectors.sparkSession
    kind = f"query_id long, rank int, {id_col} long, score double"
    if not len(chosen):
        return spark.createDataFrame([], kind)
    width, prefix = chosen.shape[1], min(prefix, len(chosen))
    rows = rows.where(F.size("v") == width)
    n_rows = rows.count()
    segments = max(1, -(-n_rows // segment))

    def pack(size: int | None):
        """Rows of one task as blocks of ``size``, or as one segment with its inverted file."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            forget()
            ids, xs, at, done = [], [], 0, 0
            task = TaskContext.get().partitionId()

            def block() -> pd.DataFrame:
                i, x = np.concatenate(ids), np.concatenate(xs)
                near = orders(unit(x), chosen, prefix).astype(np.int32)
                data = [i, x, near] if size else [i, x, *Segment.post(near, len(chosen))]
                return pd.DataFrame({"task": [task], "at": [done], "data": [[d.tobytes() for d in data]]})

            for b in batches:
                i, x = b["id"].to_numpy(np.int64), np.array(b["v"].tolist(), np.float64).reshape(len(b), -1)
                while len(i):
                    take = size - at if size else len(i)
                    ids.append(i[:take])
                    xs.append(x[:take])
                    at += len(ids[-1])
                    i, x = i[take:], x[take:]
                    if size and at == size:
                        yield block()
                        ids, xs, at, done = [], [], 0, done + 1
            if at:
                yield block()

        return run

    shape = "task int, at int, data array<binary>"
    index = written(rows.repartition(segments).mapInPandas(pack(None), shape)).select(F.col("task").alias("seg"), F.lit(-1).cast("long").alias("blk"), "data")
    queries = rows.where(F.col("id") % every == 0)
    queries = queries.repartition(max(1, -(-queries.count() // QUERIES)))
    asked = written(queries.mapInPandas(pack(QUERIES), shape))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("seg"), (F.col("task") * F.lit(1 << 20) + F.col("at")).cast("long").alias("blk"), "data")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), segments)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for b in batches:
            for seg, blk, data in zip(b["seg"], b["blk"], b["data"]):
                if blk < 0:
                    ids = np.frombuffer(data[0], np.int64)
                    now, held = seg, Segment(ids, np.frombuffer(data[1], np.float64).reshape(len(ids), -1), np.frombuffer(data[2], np.int32), np.frombuffer(data[3], np.int16), np.frombuffer(data[4], np.int64), prefix)
                elif seg == now:  # else this segment has no rows
                    own = np.frombuffer(data[0], np.int64)
                    xs, nears = np.frombuffer(data[1], np.float64).reshape(len(own), -1), np.frombuffer(data[2], np.int32).reshape(len(own), -1)
                    found = [(row, q, *held.nearest(x, q, near, k, part)) for row, (q, x, near) in enumerate(zip(own, xs, nears))]
                    sizes = [len(f[2]) for f in found]
                    yield pd.DataFrame({"row": blk * QUERIES + np.repeat([f[0] for f in found], sizes), "query_id": np.repeat([f[1] for f in found], sizes), "id": np.concatenate([f[2] for f in found]), "score": np.concatenate([f[3] for f in found])})

    met = index.unionByName(asked).repartition(n, "seg").sortWithinPartitions("seg", "blk")
    found = met.mapInPandas(search, "row long, query_id long, id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")

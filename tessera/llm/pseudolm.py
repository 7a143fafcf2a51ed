"""Document scores by masked pseudo-likelihood.

A small bidirectional window network predicts every token from the tokens on both sides
of it: position-specific embeddings are added up, squashed, and lead to a softmax in two
steps (class, then token in the class), which is a true distribution over all symbols.
The score of a document is the sum of the log-probabilities of all its tokens.

The vocabulary comes from counts over the whole corpus and grows with it: every word whose
count is at least a share of the square root of all tokens has a symbol. The others share
symbols, and the probability of such a symbol is split among its words by their counts. Each task trains a copy of the
network on its documents, every position masked in one of the rounds; copies are averaged, weighted by tokens,
in a tree of bounded fan-in, and the average is the start of the next round.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_written, forget, written

#: Symbols are the square of the classes, of which there are CLASSES at least; frequent words have one symbol each, the rest of the words share BUCKETS of them.
CLASSES, HIDDEN, SIDE, BUCKETS = 32, 32, 2, 256
SYMBOLS = CLASSES * CLASSES
#: A word is frequent from a count of sqrt(tokens) / RARE on.
RARE = 10
#: The counts of words that are up to so many times rarer than that go to the executors as a list; those of the rest are joined.
COMMON = 16
FAN_IN = 64
#: Copies are averaged in slices of so many numbers, so that a task holds FAN_IN slices whatever the size of the network.
SLICE = 1 << 18
#: Logarithms are added up as whole numbers of this size, so that the order does not matter.
LOG_UNIT = 1 << 32
BLOCK = 1 << 16
#: Scores come from products of at most so many rows, between so many at both ends that are not used: the kernels of many machines round all rows between alike,
TALL, MARGIN = 320, 8
#: and elsewhere from products of so many rows each: one step of the matrix kernels, in which every row, being a column there, is rounded alike.
TILE = 16
#: So many rows of scores are worked on at once, which a core's own cache holds.
ROWS = 960
#: Rows of a run are added up so many at a time, beside those of other runs.
FEW = 16
#: Training takes so many documents at once.
STRETCH = 500
#: A task's counts of words are put together from so many rows or bytes on, and leave it if so many words or bytes are left.
COUNTED, COUNTED_BYTES = 400_000, 32 << 20
HASH_BITS = (1 << 60) - 1


@dataclass
class Network:
    """Parameters for c classes: embed (2*SIDE, c*c + 1, HIDDEN), to_class (HIDDEN + 1, c), to_token (c, HIDDEN + 1, c); the last symbol is the edge of a document."""

    embed: np.ndarray
    to_class: np.ndarray
    to_token: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 0, classes: int = CLASSES) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return cls(make(2 * SIDE, classes * classes + 1, HIDDEN), make(HIDDEN + 1, classes), make(classes, HIDDEN + 1, classes))

    @property
    def classes(self) -> int:
        return self.to_class.shape[1]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.embed.reshape(-1), self.to_class.reshape(-1), self.to_token.reshape(-1)])

    @classmethod
    def of(cls, flat: np.ndarray, classes: int = CLASSES) -> Network:
        a, b = 2 * SIDE * (classes * classes + 1) * HIDDEN, (HIDDEN + 1) * classes
        flat = flat.astype(np.float32)
        return cls(flat[:a].reshape(2 * SIDE, classes * classes + 1, HIDDEN).copy(), flat[a : a + b].reshape(HIDDEN + 1, classes).copy(), flat[a + b :].reshape(classes, HIDDEN + 1, classes).copy())

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """(n, HIDDEN + 1) with a last column of ones, from (n, 2*SIDE) symbols."""
        h = np.ones((len(context), HIDDEN + 1), np.float32)
        for at in range(0, len(context), ROWS):
            some = context[at : at + ROWS]
            x = self.embed[0].take(some[:, 0], axis=0)
            for k in range(1, 2 * SIDE):
                x += self.embed[k].take(some[:, k], axis=0)
            _tanh(x, h[at : at + ROWS, :HIDDEN])
        return h

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target given its context."""
        classes = self.classes
        order = np.argsort(_short(target // classes, classes), kind="stable")
        h, (group, member) = self.hidden(_taken(context, order)), np.divmod(target.take(order), classes)
        out = _tiled(h, self.to_class, group)
        ends = np.searchsorted(group, np.arange(classes + 1))
        for c in range(classes):
            a, b = ends[c], ends[c + 1]
            if a < b:
                out[a:b] += _tiled(h[a:b], self.to_token[c], member[a:b])
        back = np.empty_like(out)
        back[order] = out
        return back

    def step(self, context: np.ndarray, target: np.ndarray, memory: list[np.ndarray], rate: float) -> None:
        """One adaptive gradient step on a batch."""
        n, classes = len(target), self.classes
        order = np.argsort(_short(target // classes, classes), kind="stable")
        context, (group, member) = _taken(context, order), np.divmod(target.take(order), classes)
        h, dx, room = self.hidden(context), np.empty((n, HIDDEN), np.float32), np.empty((min(n, ROWS), classes), np.float32)
        grad_class, grad = np.zeros_like(self.to_class), np.zeros_like(self.to_token)
        back_class, back = self.to_class[:HIDDEN].T, self.to_token[:, :HIDDEN].transpose(0, 2, 1)
        calm, calm_token = _calm(self.to_class), _calm(self.to_token)
        starts = _starts(group)
        for low in range(0, n, ROWS):
            some = slice(low, min(low + ROWS, n))
            x, d, dx_some = h[some], room[: some.stop - low], dx[some]
            np.matmul(x, self.to_class, out=d)
            part = _missed(d, group[some], calm)
            part /= n
            grad_class[:HIDDEN] += (d.T @ (x[:, :HIDDEN] * part)).T
            grad_class[HIDDEN] += part[:, 0] @ d
            np.matmul(d, back_class, out=dx_some)
            dx_some *= part
            # the same for tokens, whose classes follow each other
            cuts = [low, *starts[np.searchsorted(starts, low, "right") : np.searchsorted(starts, some.stop)].tolist(), some.stop]
            spans = [(c, slice(a - low, b - low)) for c, a, b in zip(group[cuts[:-1]].tolist(), cuts, cuts[1:])]
            begun = group[low - 1] if low else -1
            for c, i in spans:
                np.dot(x[i], self.to_token[c], out=d[i])
            part = _missed(d, member[some], calm_token)
            part /= n
            scaled, more = x * part, np.empty_like(dx_some)
            for c, i in spans:
                if c == begun:
                    grad[c] += scaled[i].T @ d[i]
                else:
                    np.dot(scaled[i].T, d[i], out=grad[c])
                np.dot(d[i], back[c], out=more[i])
            more *= part
            dx_some += more
            dx_some *= 1 - x[:, :HIDDEN] ** 2
        for w, squares, g in ((self.to_class, memory[0], grad_class), (self.to_token, memory[1], grad)):
            squares += g * g
            g *= rate
            g /= np.sqrt(squares)
            w -= g
        orders, rows, counts = [], [], []
        for k in range(2 * SIDE):
            order = np.argsort(_short(context[:, k], classes * classes), kind="stable")
            row = context[:, k].take(order)
            first = _starts(row)
            orders.append(order)
            rows.append(row[first] + k * self.embed.shape[1])
            counts.append(np.diff(first, append=n))
        grad, rows = _run_sums(dx, np.concatenate(orders), np.concatenate(counts)), np.concatenate(rows)
        table, squares = self.embed.reshape(-1, HIDDEN), memory[2].reshape(-1, HIDDEN)
        now = squares.take(rows, axis=0)
        now += grad * grad
        squares[rows] = now
        grad *= rate
        grad /= np.sqrt(now, out=now)
        table[rows] = np.subtract(table.take(rows, axis=0), grad, out=grad)

    def memory(self) -> list[np.ndarray]:
        return [np.full_like(x, 1e-6) for x in (self.to_class, self.to_token, self.embed)]


def _tanh(x: np.ndarray, out: np.ndarray) -> None:
    """The tanh of x, which is overwritten, as 1 - 2 / (exp(2x) + 1): exponents take numpy less time."""
    x += x
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    np.add(x, 1, out=out)


def _taken(context: np.ndarray, order: np.ndarray) -> np.ndarray:
    """context[order], with each column in one piece."""
    return context.T.take(order, axis=1).T


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _tiled(h: np.ndarray, w: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The log of the softmax of each row of h @ w at its hit, rounded alike whatever stands beside it: rounding depends on how many rows a product has and on a row's place."""
    out, calm = np.empty(len(h), np.float32), _calm(w)
    if _even(w.shape):
        x, room = np.zeros((TALL, h.shape[1]), np.float32), np.empty(w.shape[1] * TALL, np.float32)
        for at in range(0, len(h), TALL - 2 * MARGIN):
            found = hit[at : at + TALL - 2 * MARGIN]
            mid = slice(MARGIN, MARGIN + len(found))
            x[mid] = h[at : at + len(found)]
            z = _between(x[: _height(len(found))], w, room)
            part = z[found, np.arange(mid.start, mid.stop)]
            part -= _log_sum(z, calm)[mid]
            out[at : at + len(found)] = part
        return out
    # tiles of one height, the last one filled up
    room = np.empty((w.shape[1], min(ROWS, -(-len(h) // TILE) * TILE)), np.float32)
    for at in range(0, len(h), ROWS):
        some, found = h[at : at + ROWS], hit[at : at + ROWS]
        n = -(-len(some) // TILE)
        if n * TILE > len(some):
            some = np.concatenate([some, np.zeros((n * TILE - len(some), h.shape[1]), h.dtype)])
        z = room[:, : n * TILE]
        np.matmul(w.T, some.reshape(n, TILE, -1).transpose(0, 2, 1), out=z.reshape(-1, n, TILE).transpose(1, 0, 2))
        part = z[found, np.arange(len(found))]
        part -= _log_sum(z, calm)[: len(found)]
        out[at : at + ROWS] = part
    return out


def _height(n: int) -> int:
    """Of the product for n rows: whole steps of the kernels, four at least."""
    return max(4 * MARGIN, -(-n // MARGIN) * MARGIN + 2 * MARGIN)


def _between(x: np.ndarray, w: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The columns w.T @ x.T."""
    return np.matmul(w.T, x.T, out=room[: w.shape[1] * len(x)].reshape(w.shape[1], len(x)))


@functools.cache
def _even(shape: tuple[int, int]) -> bool:
    """Whether this machine rounds equal rows alike, in any place but the ends of a product of any height in use."""
    rng = np.random.default_rng(0)
    w, row = (rng.standard_normal(s).astype(np.float32) for s in (shape, shape[0]))
    x, room = np.tile(row, (TALL, 1)), np.empty(shape[1] * TALL, np.float32)
    first = _between(x[: _height(1)], w, room)[:, MARGIN : MARGIN + 1].copy()
    return all((_between(x[:n], w, room)[:, MARGIN:-MARGIN] == first).all() for n in range(_height(1), TALL + 1, MARGIN))


def _calm(w: np.ndarray) -> bool:
    """Whether exponents of h @ w need no scaling, whatever the row: entries of h are within 1."""
    return bool(max(w.max(), -w.min()) * w.shape[-2] < 60 or np.abs(w).sum(axis=-2).max() < 60)


def _missed(z: np.ndarray, hit: np.ndarray, calm: bool) -> np.ndarray:
    """A column p, for which z * p then is the softmax of each row of z, less 1 at its hit; z is overwritten."""
    if not calm:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + hit] -= total
    return 1 / total[:, None]


def _run_sums(x: np.ndarray, order: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sums of the rows x[order], for runs of ``count`` of them: first rows of all runs, then all second ones, and so on; longer runs in pieces of FEW."""
    pieces = -(-count // FEW)
    many = pieces > 1
    if many.any():
        size, last = np.full(pieces.sum(), FEW), np.cumsum(pieces) - 1
        size[last] = count - (pieces - 1) * FEW
        part = _run_sums(x, order, size)
        out = part.take(last, axis=0)
        out[many] = _run_sums(part, np.flatnonzero(np.repeat(many, pieces)), pieces[many])
        return out
    by = np.argsort((FEW - count).astype(np.uint8), kind="stable")
    first = (np.cumsum(count) - count).take(by)
    ends = np.searchsorted(-count.take(by), -np.arange(FEW)).tolist()  # how many runs have more than 0, 1, 2, ... rows
    total = x.take(order.take(first), axis=0)
    room = np.empty_like(total[: ends[1]])
    for j in range(1, FEW):
        if ends[j]:
            more = room[: ends[j]]
            x.take(order.take(first[: ends[j]] + j), axis=0, out=more, mode="clip")  # all are inside; this mode needs no copy of ``out``
            total[: ends[j]] += more
    out = np.empty_like(total)
    out[by] = total
    return out


def _short(x: np.ndarray, most: int) -> np.ndarray:
    """x, at most ``most``, in the type that sorts fastest."""
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)


def _log_sum(z: np.ndarray, calm: bool) -> np.ndarray:
    """Of each column of z, which is overwritten."""
    if calm:
        return np.log(np.exp(z, out=z).sum(axis=0))
    top = z.max(axis=0)
    z -= top
    return top + np.log(np.exp(z, out=z).sum(axis=0))


@dataclass
class Vocabulary:
    """What is known of a corpus' words: the frequent ones in order, how many tokens of other words fall into each bucket, the counts of the commonest of those words, and (h, n) of each word rarer than these that occurs twice or more, as a table on the cluster."""

    words: list[bytes]
    totals: np.ndarray
    rest: DataFrame | None = None
    common: tuple[tuple[bytes, int], ...] = ()

    @property
    def classes(self) -> int:
        return max(CLASSES, math.isqrt(len(self.words) + BUCKETS - 1) + 1)

    @property
    def kind(self) -> str:
        """How a symbol is stored."""
        return "<u2" if self.classes**2 <= 1 << 16 else "<u4"

    def local(self) -> Vocabulary:
        """Without the table, for executors."""
        return Vocabulary(self.words, self.totals, None, self.common)


def word_hash(word: bytes) -> int:
    """60 bits; count_words has the same in Spark."""
    return xxhash.xxh64_intdigest(word, 42) & HASH_BITS


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all of them: between ASCII white space, A-Z in lower case."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    # a blank text would have one empty word
    words = pc.ascii_split_whitespace(pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts))
    return pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64), words.flatten()


class Symbols:
    """Words to symbols."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        own, common = len(vocabulary.words), [w for w, _ in vocabulary.common]
        self.own = own
        self.words = pa.array([*vocabulary.words, *common], pa.binary())
        self.symbols = np.array([*range(own), *(own + word_hash(w) % BUCKETS for w in common)], np.int64)
        self.logs = np.array([0] * own + [round(math.log(n) * LOG_UNIT) for _, n in vocabulary.common], np.int64)

    def codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbol of each word, the logarithm of its count in LOG_UNITs if it shares a symbol and is in the list, and its word_hash if it isn't, else -1; each different word is looked up once."""
        each = words.dictionary_encode()
        different = each.dictionary.cast(pa.binary())
        found = pc.index_in(different, value_set=self.words)
        rare = found.is_null().to_numpy(zero_copy_only=False)
        others = different.filter(pa.array(rare)).to_numpy(zero_copy_only=False).tolist()
        at, hashes = found.fill_null(0).to_numpy(), np.full(len(rare), -1, np.int64)
        symbols, logs = (np.zeros((2, len(rare)), np.int64)) if not len(self.words) else (self.symbols.take(at), self.logs.take(at))
        hashes[rare] = np.fromiter(map(word_hash, others), np.int64, len(others))
        symbols[rare], logs[rare] = self.own + hashes[rare] % BUCKETS, 0
        at = each.indices.to_numpy()
        return symbols.take(at), logs.take(at), hashes.take(at)

    def __call__(self, text: str) -> np.ndarray:
        return self.codes(split(pa.array([text]))[1])[0]


def windows(ids: list[np.ndarray], symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """(context, target) of every token of some documents, in order; nothing reaches over a document's edge."""
    edge = np.full(SIDE, symbols, np.int64)
    row = np.concatenate([x for d in ids for x in (edge, d)] + [edge]) if ids else edge
    at = np.flatnonzero(row < symbols)
    if not len(at):
        return np.empty((0, 2 * SIDE), np.int64), np.empty(0, np.int64)
    return np.stack([row.take(at + k) for k in range(-SIDE, SIDE + 1) if k]).T, row.take(at)


def count_words(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """The words of all documents; the frequent ones by count, then bytes.

    The driver gets words that are at least 1 / (COMMON * RARE * sqrt(tokens)) of all tokens each, so no more than COMMON * RARE * sqrt(tokens).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Table] = []
        for b in batches:
            w, n = pc.value_counts(split(b.column(0))[1]).flatten()
            found.append(pa.table({"w": w.cast(pa.binary()), "n": n}))
            if _large(found, 2):
                found = [_together(found)]
                if _large(found, 1):
                    yield from found.pop().to_batches(max_chunksize=1 << 16)
        if found:
            yield from _together(found).to_batches(max_chunksize=1 << 16)

    counts = docs.select(F.col(text_col).alias("t")).where("t is not null").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    # a word that occurs once is never listed, so only its hash is stored
    counts = written(counts.select(F.when(F.col("n") > 1, F.col("w")).alias("w"), F.xxhash64("w").bitwiseAND(F.lit(HASH_BITS)).alias("h"), "n"))
    least = max(2, math.isqrt(counts.agg(F.sum("n")).first()[0] or 0) // RARE)
    some = max(2, least // COMMON)
    found = sorted((-n, bytes(w)) for w, n in counts.where(F.col("n") >= some).select("w", "n").collect())
    own = sum(-n >= least for n, _ in found)
    rest = counts.where(F.col("n") < least).select("h", "n")
    totals = np.zeros(BUCKETS, np.int64)
    for b, n in rest.groupBy((F.col("h") % BUCKETS).alias("b")).agg(F.sum("n")).collect():
        totals[b] = n
    return Vocabulary([w for _, w in found[:own]], totals, rest.where((F.col("n") > 1) & (F.col("n") < some)), tuple((w, -n) for n, w in found[own:]))


def _large(counts: list[pa.Table], times: int) -> bool:
    return sum(t.num_rows for t in counts) > times * COUNTED or sum(t.nbytes for t in counts) > times * COUNTED_BYTES


def _together(counts: list[pa.Table]) -> pa.Table:
    """One row (w, n) for each word."""
    return pa.concat_tables(counts).group_by("w", use_threads=False).aggregate([("n", "sum")]).select(["w", "n_sum"]).rename_columns(["w", "n"])


def chosen(context: np.ndarray, target: np.ndarray, place: np.ndarray, low: float, high: float, seed: int) -> np.ndarray:
    """The positions whose hash, a number from 0 to 1, is in [low, high), in mixed order.

    The hash is of what stands there and its place in the document, so files, batches
    and partitions do not change it, and every position is in one of the parts that cover 0 to 1.
    """
    x = np.full(len(target), seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in (target, *context.T, place):
        x ^= column.astype(np.uint64, copy=False)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    at = x >> np.uint64(11)
    at = np.flatnonzero((at >= np.uint64(int(low * (1 << 53)))) & (at < np.uint64(int(high * (1 << 53)))))
    return at[np.argsort((x[at] * np.uint64(0x94D049BB133111EB) >> np.uint64(48)).astype(np.uint16), kind="stable")]


def places(ids: list[np.ndarray]) -> np.ndarray:
    """The place of every token in its document."""
    n = np.array([len(d) for d in ids], np.int64)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def encoded(docs: DataFrame, words: Vocabulary, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """One stored row for each document, which training and scoring read: its id as k, n_tokens, its symbols as bytes, and of its words without a symbol of their own the summed logarithms of counts in the vocabulary's list, and the hashes of those that it lacks."""
    local, kind = words.local(), words.kind

    @F.arrow_udf("n_tokens long, symbols binary, more long, rest array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        symbols = Symbols(local)
        for texts in batches:
            n, words = split(texts)
            stored, logs, hashes = symbols.codes(words)
            ends, rare, stored = np.concatenate([[0], np.cumsum(n)]), hashes >= 0, stored.astype(kind)
            summed = lambda x: np.concatenate([[0], np.cumsum(x)])[ends]
            stored = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * stored.itemsize).astype(np.int32)), pa.py_buffer(stored)])
            rest = pa.ListArray.from_arrays(summed(rare).astype(np.int32), pa.array(hashes[rare]))
            yield pa.StructArray.from_arrays([pa.array(n), stored, pa.array(np.diff(summed(logs))), rest], ["n_tokens", "symbols", "more", "rest"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), (F.col(id_col) if id_col else F.lit(0)).alias("k"), run(F.col(text_col)).alias("x"))
    return written(rows.select("row", "k", "x.*"))


def parts(turn: int, share: float) -> list[tuple[float, float]]:
    """What a round masks of the circle of hashes from 0 to 1: a share of it from where the round before ended."""
    low = turn * share % 1
    low = 0.0 if math.isclose(low, 1) else low
    if low + share < 1 or math.isclose(low + share, 1):
        return [(low, 1.0 if math.isclose(low + share, 1) else low + share)]
    return [(low, 1.0), (0.0, low + share - 1)]


def train(docs: DataFrame, words: Vocabulary, text_col: str = "text", **options: object) -> Network:
    """The network trained on docs; options are those of train_encoded."""
    return train_encoded(encoded(docs, words, None, text_col), words, **options)


def train_encoded(rows: DataFrame, words: Vocabulary, rounds: int = 2, share: float | None = None, rate: float = 0.05, batch: int | None = None, seed: int = 0) -> Network:
    """The network after ``rounds`` of training; in each, a share of the positions of every document is masked and predicted.

    Unless a share is given, it is 1 / rounds, and every position is masked in exactly one
    round. Shares follow each other around the circle of position hashes. Unless its
    size is given, a gradient step takes a sixteenth of what STRETCH documents have masked,
    from 256 to as many as one matrix of the network has entries, 8192 at least.
    """
    classes, kind = words.classes, words.kind
    share = 1 / rounds if share is None else share
    most = max(8192, classes**2)
    flat = Network.fresh(seed, classes).flat()
    for turn in range(rounds):
        start = flat

        def run(batches: Iterator[pd.DataFrame], start: np.ndarray = start, turn: int = turn) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            net, task, seen = Network.of(start, classes), TaskContext.get().partitionId(), 0
            memory = net.memory()
            for b in batches:
                for at in range(0, len(b), STRETCH):
                    ids = [np.frombuffer(x, kind) for x in b["symbols"].iloc[at : at + STRETCH]]
                    context, target = windows(ids, classes * classes)
                    masked = [chosen(context, target, places(ids), low, high, seed) for low, high in parts(turn, share)]
                    masked = np.concatenate(masked)
                    context, target = _taken(context, masked), target.take(masked)
                    size = batch or min(max(256, len(masked) // 16), most)
                    for i in range(0, len(masked), size):
                        net.step(context[i : i + size], target[i : i + size], memory, rate)
                    seen += len(masked)
            if seen:
                found = net.flat()
                for i in range(0, len(found), SLICE):
                    yield pd.DataFrame({"task": [task], "slice": [i // SLICE], "n": [seen], "w": [found[i : i + SLICE].tobytes()]})

        def average(b: pd.DataFrame) -> pd.DataFrame:
            total = sum(b["n"])
            w = sum(np.frombuffer(x, np.float32).astype(np.float64) * (n / total) for _, n, x in sorted(zip(b["task"], b["n"], b["w"])))
            return pd.DataFrame({"task": [min(b["task"]) // FAN_IN], "slice": [b["slice"].iloc[0]], "n": [total], "w": [w.astype(np.float32).tobytes()]})

        own = copies = written(rows.select("symbols").mapInPandas(run, "task int, slice int, n long, w binary"))
        top = copies.agg(F.max("task")).first()[0]
        if top is None:
            break
        while True:
            copies = copies.groupBy("slice", F.floor(F.col("task") / FAN_IN)).applyInPandas(average, "task int, slice int, n long, w binary")
            top //= FAN_IN
            if top == 0:
                break
        flat = np.concatenate([np.frombuffer(w, np.float32) for _, w in sorted((r["slice"], r["w"]) for r in copies.collect())])
        drop_written(own)
    return Network.of(flat, classes)


def score(docs: DataFrame, words: Vocabulary, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, log_prob, mean_log_prob) for each row, over every token of its whole text.

    A word without a symbol of its own has the probability of its bucket's symbol times
    n / (total + 1), where n is its count in the corpus and total that of all words of
    the bucket; words that the corpus does not have share the 1 that is left.

    Null, empty and blank texts have no tokens, log_prob 0 and a null mean. Rows that
    repeat score alike; other columns are ignored.
    """
    return score_encoded(encoded(docs, words, id_col, text_col), words, network, id_col)


def score_encoded(rows: DataFrame, words: Vocabulary, network: Network, id_col: str = "doc_id") -> DataFrame:
    """score of rows of ``encoded``."""
    flat, classes, kind, own, totals = network.flat(), network.classes, words.kind, len(words.words), words.totals

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        net = Network.of(flat, classes)
        share = np.concatenate([np.zeros(own), -np.log(totals + 1.0)])
        for b in batches:
            parts = [np.zeros(0)]
            for at in range(0, len(b), 500):
                ids = [np.frombuffer(x, kind) for x in b.iloc[at : at + 500]]
                context, target = windows(ids, classes * classes)
                found = [net.log_prob(context[i : i + BLOCK], target[i : i + BLOCK]) + share[target[i : i + BLOCK]] for i in range(0, len(target), BLOCK)]
                units = np.rint(np.concatenate(found) * LOG_UNIT).astype(np.int64) if found else np.zeros(0, np.int64)
                sums = np.concatenate([[0], np.cumsum(units)])
                n = np.array([len(x) for x in ids])
                ends = np.cumsum(n)
                parts.append((sums[ends] - sums[ends - n]) / LOG_UNIT)
            yield pd.Series(np.concatenate(parts))

    # a logarithm is rounded once for each word, not for each token
    logs = words.rest.select("h", F.round(F.log("n") * LOG_UNIT).cast("long").alias("log"))
    # words of words.rest are distinct and spread by hash, so a part of them fits a task; the tokens need no sorting
    more = rows.select("row", F.explode("rest").alias("h")).join(logs.hint("shuffle_hash"), "h").groupBy("row").agg(F.sum("log").alias("rest"))
    total = F.col("log_prob") + (F.col("more") + F.coalesce(F.col("rest"), F.lit(0))) / LOG_UNIT
    scored = rows.select("row", "k", "n_tokens", "more", run("symbols").alias("log_prob"))
    out = scored.join(more, "row", "left").select(F.col("k").alias(id_col), "n_tokens", total.alias("log_prob"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """Counts words, trains on and scores all of docs; texts are turned into symbols once."""
    words = count_words(docs, text_col)
    rows = encoded(docs, words, id_col, text_col)
    return score_encoded(rows, words, train_encoded(rows, words, **options), id_col)

"""Token-id output as wavelet matrices, one for each shard.

A shard's ids become bit planes, most significant bit first; before each next plane
the ids are split stably into those with bit 0 and those with bit 1. With a running
count of ones for every 512 bits, the one blob answers access, rank, select, count
and occurrence look-ups without being unpacked.

Blob: ``WVM1``, planes (u8), reserved (3 bytes), length (u64); for each plane the
number of zeros (u64), the counts of ones before each 512-bit block (u32), and the
bits (64-bit words, lowest bit first). All little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import held, written
from tessera.llm.ordering import LEAST, default_parts, id_cuts, part_of

BLOCK = 512
#: A shard is closed at the first document end after so many ids.
SHARD_IDS = 1 << 17


def build(ids: np.ndarray) -> bytes:
    ids = np.ascontiguousarray(ids, np.uint32)
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    rest = ids.astype(np.uint16) if planes <= 16 else ids
    out = [struct.pack("<4sB3xQ", b"WVM1", planes, len(ids))]
    size = -(-len(ids) // BLOCK) * BLOCK
    for shift in range(planes - 1, -1, -1):
        ones = (rest & rest.dtype.type(1 << shift)) != 0
        packed = np.zeros(size // 8, np.uint8)
        bits = np.packbits(ones, bitorder="little")
        packed[: len(bits)] = bits
        per = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        before = np.zeros(len(per), np.uint32)
        np.cumsum(per[:-1], out=before[1:])
        zeros = rest.compress(~ones)
        out += [struct.pack("<Q", len(zeros)), before.tobytes(), packed.tobytes()]
        rest = np.concatenate([zeros, rest.compress(ones)])
    return b"".join(out)


class WaveletMatrix:
    """Read access to a blob of ``build``; nothing is unpacked but the words that an answer needs."""

    def __init__(self, blob: bytes) -> None:
        magic, self.planes, self.n = struct.unpack_from("<4sB3xQ", blob)
        if magic != b"WVM1":
            raise ValueError("not a wavelet matrix")
        at, blocks = 16, -(-self.n // BLOCK)
        self.zeros, self.before, self.words = [], [], []
        for _ in range(self.planes):
            self.zeros.append(struct.unpack_from("<Q", blob, at)[0])
            self.before.append(np.frombuffer(blob, "<u4", blocks, at + 8))
            self.words.append(np.frombuffer(blob, "<u8", blocks * BLOCK // 64, at + 8 + 4 * blocks))
            at += 8 + 4 * blocks + blocks * BLOCK // 8

    def __len__(self) -> int:
        return self.n

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        block, word = i // BLOCK, i // 64
        got = int(self.before[plane][block]) + int(np.bitwise_count(self.words[plane][block * BLOCK // 64 : word]).sum())
        return got + (int(self.words[plane][word]) & ((1 << (i % 64)) - 1)).bit_count()

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) bit of that value stands."""
        before = self.before[plane].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        words = self.words[plane][block * BLOCK // 64 : (block + 1) * BLOCK // 64]
        bits = np.unpackbits(words.view(np.uint8), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - before[block]])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            bit = int(self.words[p][i // 64]) >> (i % 64) & 1
            value = value << 1 | bit
            ones = self._ones(p, i)
            i = self.zeros[p] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, start: int, end: int) -> tuple[int, int]:
        if symbol >> self.planes:
            return 0, 0
        for p in range(self.planes):
            a, b = self._ones(p, start), self._ones(p, end)
            start, end = (self.zeros[p] + a, self.zeros[p] + b) if symbol >> (self.planes - 1 - p) & 1 else (start - a, end - b)
        return start, end

    def rank(self, symbol: int, i: int) -> int:
        """How often the symbol stands among the first i ids."""
        a, b = self._range(symbol, 0, min(i, self.n))
        return b - a

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(symbol, start, self.n if end is None else min(end, self.n))
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """Where the k-th (from 0) occurrence of the symbol stands."""
        a, b = self._range(symbol, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(self.planes - 1, -1, -1):
            bit = symbol >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def occurrences(self, symbol: int, start: int = 0, end: int | None = None) -> list[int]:
        first = self.rank(symbol, start)
        return [self.select(symbol, first + k) for k in range(self.count(symbol, start, end))]

    def ids(self) -> np.ndarray:
        """All ids, as uint32: places go through the splits, from the first plane down, and gather their bits."""
        item = np.arange(self.n, dtype=np.uint64) << np.uint64(32)  # the place above, the id below
        for p in range(self.planes):
            ones = np.unpackbits(self.words[p].view(np.uint8), bitorder="little", count=self.n).view(bool)
            up = item.compress(ones)
            up |= np.uint64(1 << (self.planes - 1 - p))
            item = np.concatenate([item.compress(~ones), up])
        out = np.empty(self.n, np.uint32)
        out[item >> np.uint64(32)] = item & np.uint64(0xFFFFFFFF)
        return out


#: Longest piece, in bytes, that is looked up as two words; the top byte of the second one has its length.
SHORT = 15
_KEEP = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(SHORT + 1)], np.uint64)
_KEEP_2 = np.array([(1 << 8 * max(0, n - 8)) - 1 for n in range(SHORT + 1)], np.uint64)


class PieceTable:
    """Numbers of pieces by their two words, for whole arrays; open addressing, half empty."""

    def __init__(self, bits: int = 16) -> None:
        self.used = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits = bits
        self.a, self.b = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.number = np.full(1 << bits, -1, np.int32)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.intp)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each, or -1."""
        slot, where = self._slots(a, b), np.arange(len(a))
        out = np.empty(len(a), np.int32)
        while True:
            got = self.number[slot]
            out[where] = got
            miss = np.flatnonzero((got >= 0) & ((self.a[slot] != a) | (self.b[slot] != b)))
            if not len(miss):
                return out
            slot, where, a, b = (slot[miss] + 1) & ((1 << self.bits) - 1), where[miss], a[miss], b[miss]

    def add(self, a: np.ndarray, b: np.ndarray, numbers: np.ndarray) -> None:
        """Puts in different pieces that it does not have."""
        if 2 * (self.used + len(a)) > 1 << self.bits:
            at = np.flatnonzero(self.number >= 0)
            old = self.a[at], self.b[at], self.number[at]
            self._make((2 * (self.used + len(a))).bit_length() + 1)
            self._put(*old)
        self.used += len(a)
        self._put(a, b, numbers)

    def _put(self, a: np.ndarray, b: np.ndarray, numbers: np.ndarray) -> None:
        slot = self._slots(a, b)
        while len(slot):
            free = np.flatnonzero(self.number[slot] < 0)
            self.number[slot[free]] = numbers[free]  # of several for one slot the last stays
            here = self.number[slot] == numbers
            self.a[slot[here]], self.b[slot[here]] = a[here], b[here]
            rest = ~here
            slot, a, b, numbers = (slot[rest] + 1) & ((1 << self.bits) - 1), a[rest], b[rest], numbers[rest]


class PieceEncoder:
    """The ids of whole texts by a byte-level vocabulary of the tokenizers library.

    Byte-level merges never cross the pieces into which the file's pre-tokenizer cuts
    a text, so the library encodes each distinct piece once, and a text is the
    pieces' ids in a row. Many texts are cut and looked up at once as arrays: a piece
    starts where the class of characters changes, but for a blank that belongs to what
    follows it and for English contractions. At most ``REMEMBERED`` pieces are kept.

    The file's added tokens are ids of their own wherever a text has their strings, as
    the library has it by default; with ``ordinary`` they are text like any other.
    """

    REMEMBERED = 1_500_000
    #: Texts are taken together up to so many code points; longer ones are cut where a piece ends for sure.
    AT_ONCE = 1 << 19

    def __init__(self, path: str, ordinary: bool = False) -> None:
        import json
        import os
        import re

        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        # the same merges without the library's own memory of words, as each piece comes once
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.tokenizer.model = BPE(model["vocab"], merges, cache_capacity=0)
        added = {} if ordinary else {t["content"]: t for t in file["added_tokens"]}
        if any(t[k] for t in added.values() for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take their surroundings")
        self.added = {k: t["id"] for k, t in added.items()}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # classes: 0 white space, 1 letters, 2 numbers, 3 the rest, by the engine that knows the pattern's classes
        self.kind = np.full(0x110000, 3, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for number, pattern in ((0, r"\s+"), (1, r"\p{L}+"), (2, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                self.kind[a : b + 1] = number
        self.kind[0xD800:0xE000] = 3
        self._empty()

    def _empty(self) -> None:
        self.table, self.long = PieceTable(), {}
        self.pool, self.filled = np.empty(1 << 16, np.uint32), 0
        self.at, self.n, self.pieces = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def _cuts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces start among the code points of some texts, which end at ``ends``."""
        kind = self.kind[points]
        n = len(points)
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        first = ends[:-1][ends[:-1] < n]
        start[first] = True
        space = kind == 0
        # the last of a run of white space before something else starts a piece: a blank one with that, another one of its own
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:]
        last[ends[ends > 0] - 1] = False
        start |= last
        joined = np.flatnonzero(last & (points == 32)) + 1
        start[joined] = False
        # contractions: an apostrophe that starts a piece, alone of its class, before one of these
        tick = np.flatnonzero((points == 39) & start)
        if len(tick):
            edge = np.zeros(n + 3, bool)
            edge[ends] = True
            x = np.concatenate([points, np.zeros(3, points.dtype)])
            one, two = x[tick + 1], x[tick + 2]
            has = lambda *words: sum(((one == ord(w[0])) & (two == ord(w[1])) for w in words), np.zeros(len(tick), bool))
            longer = has("re", "ve", "ll") & ~edge[tick + 1] & ~edge[tick + 2]
            shorter = ((one == 115) | (one == 116) | (one == 109) | (one == 100)) & ~edge[tick + 1]
            for found, size in ((tick[shorter], 2), (tick[longer & ~shorter], 3)):
                start[found + 1] = False
                after = found + size
                after = after[after < n]
                # what is left of the letters starts a piece; a run of another class starts one already
                inside = ~edge[after] & (kind[after] == 1)
                start[after[inside]] = True
        return np.flatnonzero(start)

    def _numbers(self, data: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each piece (where it starts and how long it is, in bytes); what is new is encoded."""
        b = np.frombuffer(data + bytes(24), np.uint8)
        w = b[:-1].astype(np.uint16)
        w |= b[1:].astype(np.uint16) << np.uint16(8)
        w = w[:-2].astype(np.uint32) | w[2:].astype(np.uint32) << np.uint32(16)
        w = w[:-4].astype(np.uint64) | w[4:].astype(np.uint64) << np.uint64(32)
        short = np.minimum(size, SHORT)
        one, two = w[at] & _KEEP[short], (w[at + 8] & _KEEP_2[short]) | (short.astype(np.uint64) << np.uint64(56))
        number = self.table.find(one, two)
        far = np.flatnonzero(size > SHORT)
        far_keys = [data[s : s + n] for s, n in zip(at[far].tolist(), size[far].tolist())]
        number[far] = [self.long.get(x, -1) for x in far_keys]
        new = np.flatnonzero(number < 0)
        if len(new):
            near = new[size[new] <= SHORT]
            order = near[np.lexsort((two[near], one[near]))]
            if len(order):
                order = order[np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])]
            some = list(dict.fromkeys(x for x, i in zip(far_keys, number[far]) if i < 0))
            texts = [data[s : s + n].decode("utf-8", "surrogatepass") for s, n in zip(at[order].tolist(), size[order].tolist())] + [x.decode("utf-8", "surrogatepass") for x in some]
            numbers = self._learn(texts)
            self.table.add(one[order], two[order], numbers[: len(order)])
            self.long.update(zip(some, numbers[len(order) :].tolist()))
            number[near] = self.table.find(one[near], two[near])
            number[far] = [self.long[x] for x in far_keys]
        return number

    def _learn(self, texts: list[str]) -> np.ndarray:
        e = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        ids, at = np.array(e.ids, np.uint32), np.searchsorted(e.word_ids, np.arange(len(texts) + 1))
        grow = lambda x, n: x if n <= len(x) else np.concatenate([x, np.empty(max(n, len(x)), x.dtype)])
        self.pool, self.at, self.n = grow(self.pool, self.filled + len(ids)), grow(self.at, self.pieces + len(texts)), grow(self.n, self.pieces + len(texts))
        self.pool[self.filled : self.filled + len(ids)] = ids
        here = slice(self.pieces, self.pieces + len(texts))
        self.at[here], self.n[here] = at[:-1] + self.filled, np.diff(at)
        self.filled, self.pieces = self.filled + len(ids), self.pieces + len(texts)
        return np.arange(here.start, here.stop, dtype=np.int32)

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has)."""
        if self.pieces > self.REMEMBERED:
            self._empty()
        whole = "".join(texts)
        if not whole:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        ends = np.cumsum([len(t) for t in texts])
        data = whole.encode("utf-8", "surrogatepass")
        points = np.frombuffer(data, np.uint8) if len(data) == len(whole) else np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = self._cuts(points, ends)
        at = starts
        if len(data) != len(whole):
            width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
            at = (np.cumsum(width) - width)[starts]
        size = np.diff(at, append=len(data))
        number = self._numbers(data, at, size)
        n, begin = self.n[number], self.at[number]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(begin - before[:-1], n) + np.arange(before[-1])]
        of = before[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return ids, np.diff(of)

    def _stretches(self, text: str) -> Iterator[str]:
        """The text in parts that are no longer than need be; a part ends after a letter or number and before a blank."""
        begin, n = 0, len(text)
        while n - begin > 2 * self.AT_ONCE:
            at = text.find(" ", begin + self.AT_ONCE)
            while at >= 0 and not text[at - 1].isalnum():
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[begin:at]
            begin = at
        yield text[begin:]

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each followed by end_id if one is given; how many ids each has)."""
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held: list[str] = []

        def flush() -> None:
            if held:
                got, n = self._some(held)
                if end_id is not None:
                    got = np.insert(got, np.cumsum(n), end_id)
                    n = n + 1
                ids.append(got)
                lengths.append(n)
                held.clear()

        size = 0
        for t in texts:
            special = bool(self.cut_added) and any(x in t for x in self.added)
            if special or len(t) > 2 * self.AT_ONCE:
                flush()
                parts = []
                for x in self.cut_added.split(t) if special else [t]:
                    parts += [np.array([self.added[x]], np.uint32)] if x in self.added else [self._some([y])[0] for y in self._stretches(x)]
                ids += parts if end_id is None else [*parts, np.array([end_id], np.uint32)]
                lengths.append(np.array([sum(map(len, parts)) + (end_id is not None)]))
                size = 0
                continue
            held.append(t)
            size += len(t)
            if size > self.AT_ONCE:
                flush()
                size = 0
        flush()
        none = np.empty(0, np.uint32)
        return np.concatenate([none, *ids]), np.concatenate([none.astype(np.int64), *lengths])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        ids, n = self.encode(texts)
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


def encoder(path: str, ordinary: bool = False) -> PieceEncoder:
    """The worker's own, kept from task to task."""
    return held(("wavelet", path, ordinary), lambda: PieceEncoder(path, ordinary))


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, shard_ids: int = SHARD_IDS, ordinary: bool = False) -> DataFrame:
    """Encodes every text, ends it with end_id, and stores the ids in ascending id order as shards.

    Returns what was written: (part, shard, doc_ids, lengths, planes), a row for each
    shard, shards of a part in order, parts in order. A shard holds whole documents, at
    least ``shard_ids`` ids but for the last of a part. Null text is empty; null ids come
    first; rows of one id stand in text order. Parts are id ranges read as a stream. Strings
    of the file's added tokens are those tokens, as in the library, unless ``ordinary``.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("k")
    cuts = id_cuts(docs.select(key), "k", parts or default_parts(docs))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("p", part_of("k", cuts))
    rows = rows.repartition(n, "p").sortWithinPartitions("p", "k", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary, ordinary).encode
        part, shard, size = None, 0, 0
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def closed() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "shard": [shard], "doc_ids": [np.concatenate(keys)], "lengths": [np.concatenate(lengths)], "planes": [build(np.concatenate(ids))]})

        for b in batches:
            of_part, of_key = b["p"].to_numpy(), b["k"].to_numpy()
            for at in range(0, len(b), 1024):
                got, n = encode(b["t"].iloc[at : at + 1024].tolist(), end_id)
                ends = np.cumsum(n)
                p, k = of_part[at : at + 1024], of_key[at : at + 1024]
                i = 0
                while i < len(n):
                    if part is not None and (p[i] != part or size >= shard_ids):
                        yield closed()
                        shard, size, keys, ids, lengths = (shard + 1 if p[i] == part else 0), 0, [], [], []
                    part = p[i]
                    # up to the end of the part, or to the document that fills the shard
                    before = int(ends[i] - n[i])
                    j = min(int(np.searchsorted(p, part, side="right")), int(np.searchsorted(ends, before + shard_ids - size)) + 1)
                    keys.append(k[i:j])
                    lengths.append(n[i:j])
                    ids.append(got[before : ends[j - 1]])
                    size += int(ends[j - 1]) - before
                    i = j
        if keys:
            yield closed()

    return written(rows.mapInPandas(run, "part int, shard int, doc_ids array<long>, lengths array<long>, planes binary"))


def read_shards(shards: DataFrame) -> DataFrame:
    """(part, shard, at, doc_id, n_tokens, ids_crc32) for each document: the checksum of its ids as read from the planes, their number, and in at how many stand before it in the shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids = WaveletMatrix(r.planes).ids()
                ends = np.cumsum(r.lengths)
                yield pd.DataFrame({"part": r.part, "shard": r.shard, "at": ends - r.lengths, "doc_id": r.doc_ids, "n_tokens": r.lengths, "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in np.split(ids, ends[:-1])]})

    return shards.mapInPandas(run, "part int, shard int, at long, doc_id long, n_tokens long, ids_crc32 long")


def document_digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document, start being the ids of all documents before it; the checksum is of the ids in the planes, the counts are those beside them.

    Only the total of each part (their number is a setting) passes through the driver.
    """
    sizes = shards.select("part", "shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    start, starts = 0, []
    for part, n in sorted(sizes.groupBy("part").agg(F.sum("n")).collect()):
        starts.append((part, start))
        start += n
    begin = shards.sparkSession.createDataFrame(starts, "part int, begin long")
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).join(F.broadcast(begin), "part")
    found = read_shards(shards).join(offset, ["part", "shard"])
    doc_id = F.when(F.col("doc_id") != LEAST, F.col("doc_id")).alias("doc_id")
    return found.select(doc_id, (F.col("begin") + F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

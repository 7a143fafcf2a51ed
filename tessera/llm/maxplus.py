"""SentencePiece encoding and decoding by a max-plus scan.

A segmentation is a path over (end of a piece, piece) nodes; an edge from one piece to
the next weighs 0 if the merges of a byte-pair model leave that border alone and minus
infinity if they would cross it. A model's own result is the one path of weight 0
(merges inside a stretch do not depend on what stands beside it, so a sequence of pieces
is the result exactly if each neighbouring pair is).

Giant documents are cut into chunks. A chunk's transfer matrix says, in the max-plus
semiring, which states at its left border (the last piece that ends before it) lead to
which at its right; matrices are combined associatively, and with both borders known
every chunk is traced back on its own. Inside a chunk, stretches between places that no
piece of the vocabulary spans are solved once each, many at a time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, held, written

SPACE = "▁"
#: Longest chunk, in code points of the prepared text.
CHUNK = 1 << 16
NONE = -1

State = tuple[int, int]  # (end of the last piece, piece); the piece is START where nothing before matters
START = -2
Matrix = dict[State, dict[State, float]]


class Lookup:
    """Fixed table from 64-bit keys to numbers, for whole arrays; -1 for what it has not."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(len(keys)).bit_length() + 3)
        self.keys = np.full(1 << self.bits, np.iinfo(np.int64).min)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 1
        while len(left):
            _, first = np.unique(slot[left], return_index=True)
            free = self.keys[slot[left[first]]] == np.iinfo(np.int64).min
            put = left[first[free]]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys.take(slot)
        hit = there == keys
        out = np.full(len(keys), -1, np.int32)
        out[hit] = self.values.take(slot[hit])
        left = np.flatnonzero(~hit & (there != np.iinfo(np.int64).min))
        for _ in range(self.probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot[left]] == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (self.values[slot[left]] >= 0)]
        return out


class Vocabulary:
    """A SentencePiece byte-pair model with byte fallback, read from its file."""

    REMEMBERED = 50_000
    CACHE = 1 << 21
    #: Stretches are solved together up to so many letters, filled up to one length.
    CELLS = 1 << 18

    def __init__(self, path: str) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.vocab_size()
        # control, unknown and byte pieces never match text
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.size, self.unknown = n, n
        self.pieces = {p.id_to_piece(i): i for i in plain}
        self.text = [p.id_to_piece(i) for i in range(n)]
        scores = [p.get_score(i) for i in plain]
        order = {i: r for r, (_, i) in enumerate(sorted(zip((-s for s in scores), plain)))}
        self.byte = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.prefix = p.encode("a", out_type=str)[0].startswith(SPACE)
        self.longest = max(map(len, self.pieces))
        long_ = [x for x in self.pieces if len(x) > 1]
        if any(SPACE in x.lstrip(SPACE) for x in long_):
            raise ValueError("a piece spans two words")
        inside = set("".join(long_))
        #: Letters that stand in no piece of several letters.
        self.lone = frozenset(c for c in [*map(chr, range(128)), *(x for x in self.pieces if len(x) == 1)] if c not in inside and c != SPACE)
        # of these the cut takes the first 256 letters only: a larger class is matched several times slower
        lone = re.escape("".join(sorted(c for c in self.lone if c < "\u0100")))
        #: Stretches that no piece reaches out of.
        self.stretch = re.compile(f"[{lone}]|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+") if lone else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.pairs: dict[tuple[int, int], bool] = {}

        # ranks instead of ids while merging, so that the least wins
        self.rank = np.full(n + 1, n, np.int64)
        for i, r in order.items():
            self.rank[i] = r
        by_rank = np.array(sorted(order, key=order.get) + [n], np.int64)
        self.of_rank, self.last_rank = by_rank, len(by_rank) - 1
        chars = np.full((len(by_rank), self.longest), -1, np.int64)
        keys, values = [], []
        V = len(by_rank)
        for x, i in self.pieces.items():
            r = order[i]
            chars[r, : len(x)] = [order.get(self.pieces.get(c, -1), self.last_rank) for c in x]
            for k in range(1, len(x)):
                a, b = self.pieces.get(x[:k]), self.pieces.get(x[k:])
                if a is not None and b is not None:
                    keys.append(order[a] * V + order[b])
                    values.append(r)
        chars[self.last_rank, 0] = self.last_rank
        self.V, self.chars = V, chars
        self.pair = Lookup(np.array(keys, np.int64), np.array(values, np.int32))
        self.length = np.array([max(1, (row >= 0).sum()) for row in chars])
        self.letter = {x: order[i] for x, i in self.pieces.items() if len(x) == 1}
        self.whole = [None, None]
        for size in range(2, self.longest + 1):
            some = [x for x in long_ if len(x) == size]
            h = self._hash(np.array([[ord(c) for c in x] for x in some], np.uint64).reshape(len(some), size))
            self.whole.append(Lookup(h, np.array([order[self.pieces[x]] for x in some], np.int32)))
        # a piece that merging its own letters does not give is never in a result
        self.proper = np.ones(V, bool)
        _, left = self._merge(chars.copy(), None)
        self.proper[:] = (left[:, 0] == np.arange(V)) & (left[:, 1] < 0 if self.longest > 1 else True)
        self.cache_keys = np.full(self.CACHE, -1, np.int64)
        self.cache_ok = np.zeros(self.CACHE, bool)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes_of = [SPACE.join(x.split(SPACE)).replace(SPACE, " ").encode() for x in self.text]
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.n_bytes = np.array([len(x) for x in self.bytes_of])
        self.first_byte = np.cumsum(self.n_bytes) - self.n_bytes

    @staticmethod
    def _hash(points: np.ndarray) -> np.ndarray:
        h = np.zeros(len(points), np.uint64)
        for k in range(points.shape[1]):
            h = (h ^ points[:, k]) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def _merge(self, rows: np.ndarray, border: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Merges rows of ranks (ended by -1), the least rank first, leftmost of equals.

        border: symbols to the left of a border in each row; a row stops where a merge
        would cross it. Returns (rows that did not cross, rows as merged).
        """
        kept, live = np.ones(len(rows), bool), np.arange(len(rows))
        border = None if border is None else border.copy()
        at = np.arange(rows.shape[1])
        big = np.iinfo(np.int64).max
        while len(live) and rows.shape[1] > 1:
            s = rows[live]
            ok = s[:, 1:] >= 0
            rank = np.full(ok.shape, big)
            found = self.pair((s[:, :-1] * self.V + s[:, 1:])[ok]).astype(np.int64)
            rank[ok] = np.where(found >= 0, found, big)
            where = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), where]
            go = best < big
            if border is not None:
                cross = go & (where == border[live] - 1)
                kept[live[cross]] = False
                go &= ~cross
            live, s, where, best = live[go], s[go], where[go], best[go]
            if not len(live):
                break
            s[np.arange(len(live)), where] = best
            take = np.minimum(at + (at > where[:, None]), rows.shape[1] - 1)
            s = np.take_along_axis(s, take, axis=1)
            s[:, -1] = -1
            if border is not None:
                border[live] -= where < border[live] - 1
            rows[live] = s
        return kept, rows

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the letters of a and b leaves both as they are (ranks); kept in a cache of fixed size."""
        keys = a * self.V + b
        slot = ((keys.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(43)).astype(np.int64)
        out, miss = self.cache_ok[slot], self.cache_keys[slot] != keys
        if miss.any():
            new, back = np.unique(keys[miss], return_inverse=True)
            x, y = new // self.V, new % self.V
            nx, ny = self.length[x], self.length[y]
            ok = np.zeros(len(new), bool)
            by = np.argsort(nx + ny, kind="stable")
            for i in range(0, len(new), 30_000):
                part = by[i : i + 30_000]
                size = (nx + ny)[part][:, None]
                cols = np.arange(size.max())
                second = np.take_along_axis(self.chars[y[part]], np.clip(cols - nx[part][:, None], 0, self.longest - 1), axis=1)
                rows = np.where(cols < nx[part][:, None], self.chars[x[part]][:, np.minimum(cols, self.longest - 1)], np.where(cols < size, second, -1))
                ok[part] = self._merge(rows, nx[part])[0]
            out = out.copy()
            out[miss] = ok[back]
            s = ((new.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(43)).astype(np.int64)
            self.cache_keys[s], self.cache_ok[s] = new, ok
            # two new keys of one slot: the later write may pair one's key with the other's answer
            bad = self.cache_keys[s] != new
            again = np.isin(s, s[bad])
            self.cache_keys[s[again]] = -1
        return out

    def ids_of(self, ranks: Iterable[int], points: str) -> list[int]:
        """Ids of pieces given as ranks; a letter without a piece becomes its bytes."""
        out, at = [], 0
        for r in ranks:
            n = int(self.length[r])
            if r == self.last_rank:
                out += [self.byte[b] for b in points[at].encode("utf-8", "surrogatepass")]
            else:
                out.append(int(self.of_rank[r]))
            at += n
        return out

    # -- stretches ----------------------------------------------------------

    def solve(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch, in binary: position by position, many stretches of about one length at once."""
        out: list[bytes] = [b""] * len(stretches)
        sizes = np.array([len(s) for s in stretches], np.int64)
        by = np.argsort(sizes, kind="stable")
        sizes, at = sizes[by], 0
        while at < len(by):
            # up to half longer than the shortest of them, or 8
            longest = max(8, int(sizes[at]) * 3 // 2)
            until = min(int(np.searchsorted(sizes, longest, "right")), at + max(1, self.CELLS // longest))
            some, w = by[at:until].tolist(), int(sizes[until - 1])
            points = np.frombuffer("".join(stretches[k].ljust(w, "\0") for k in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), w)
            path = self._solve(points, sizes[at:until])
            strange = (path == self.last_rank).any(axis=1)
            kept = path >= 0
            ids = self.of_rank[path[kept]].astype("<u4").tobytes()
            ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
            for k, begin, end in zip(some, [0, *ends], ends):
                out[k] = ids[begin:end]
            for j in np.flatnonzero(strange):
                k = some[j]
                out[k] = np.array(self.ids_of(path[j][kept[j]].tolist(), stretches[k]), "<u4").tobytes()
            at = until
        return out

    def _solve(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The pieces (ranks) of each row, -1 before the first; at each place at most one piece ends a path of weight 0. sizes: how much of each row is text, ascending."""
        n, w = points.shape
        uniq, back = np.unique(points, return_inverse=True)
        letter = np.array([self.letter.get(chr(c), self.last_rank) for c in uniq], np.int64)[back.reshape(points.shape)]
        last = np.full((n, w + 1), NONE, np.int64)
        wide = points.astype(np.uint64)
        rows = np.arange(n)
        hashes: list[np.ndarray] = []  # by length, at each start
        h = np.zeros((n, w), np.uint64)
        for size in range(1, min(w, self.longest) + 1):
            span = w - size + 1
            h = (h[:, :span] ^ wide[:, size - 1 :]) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            hashes.append(letter if size == 1 else self.whole[size](h.view(np.int64).reshape(-1)).reshape(n, span).astype(np.int64))
        for end in range(1, w + 1):
            r, t, p = [], [], []
            begin = int(np.searchsorted(sizes, end))
            for size in range(1, min(end, self.longest) + 1):
                piece = hashes[size - 1][begin:, end - size]
                ok = piece >= 0
                if size < end:
                    ok &= last[begin:, end - size] != NONE
                ok = np.flatnonzero(ok)
                piece = piece[ok]
                proper = self.proper[piece]
                sel, piece = ok[proper] + begin, piece[proper]
                r.append(sel)
                t.append(piece)
                p.append(last[sel, end - size] if size < end else np.full(len(sel), START))
            r, t, p = np.concatenate(r), np.concatenate(t), np.concatenate(p)
            free = p == START
            good = free.copy()
            good[~free] = self.compatible(p[~free], t[~free])
            last[r[good], end] = t[good]
        steps, at = [], sizes.copy()
        while (at > 0).any():
            piece = np.where(at > 0, last[rows, at], NONE)
            steps.append(piece)
            at = at - np.where(piece >= 0, self.length[piece], 0)
        return np.stack(steps[::-1], axis=1)

    def prepare(self, text: str) -> str:
        """The text as the model sees it: a space before it, spaces as their mark; empty stays empty."""
        return ((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else ""

    def learn(self, cut: Iterable[list[str]]) -> None:
        if len(self.known) > self.REMEMBERED:  # what was needed lately is taken over as it is met again
            self.older, self.known = self.known, {}
        new = set().union(*cut).difference(self.known)
        seen = new.intersection(self.older)
        self.known.update(zip(seen, map(self.older.__getitem__, seen)))
        new = list(new.difference(seen))
        self.known.update(zip(new, self.solve(new)))

    def encode_short(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of prepared texts, stretch by stretch."""
        cut = [self.stretch.findall(t) for t in texts]
        self.learn(cut)
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space put before it is taken off."""
        some = np.frombuffer(ids, "<u4")
        n = self.n_bytes[some]
        at = np.repeat(self.first_byte[some] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        text = self.all_bytes.take(at).tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    # -- chunks of giant texts ----------------------------------------------

    def is_start(self, text: str, at: int) -> bool:
        """Whether no piece spans the letters on both sides of a place inside the text."""
        a, b = text[at - 1], text[at]
        return (b == SPACE and a != SPACE) or a in self.lone or b in self.lone

    def ask(self, pairs: set[tuple[int, int]]) -> None:
        """Makes ``self.pairs`` know whether these neighbours are left as they are."""
        new = sorted(pairs.difference(self.pairs))
        if new:
            if len(self.pairs) > self.REMEMBERED:
                self.pairs.clear()
                new = sorted(pairs)
            x = np.array(new, np.int64)
            self.pairs.update(zip(new, self.compatible(x[:, 0], x[:, 1]).tolist()))

    def ending(self, text: str, end: int) -> list[int]:
        """All pieces (ranks) that end at a place."""
        out = []
        for size in range(1, min(self.longest, end) + 1):
            x = text[end - size : end]
            i = self.pieces.get(x)
            r = int(self.rank[i]) if i is not None else self.last_rank if size == 1 else -1
            if r >= 0 and self.proper[r]:
                out.append(r)
        return out

    def entries(self, text: str, begin: int) -> list[State]:
        """The states that may hold at a left border: a piece that ends in the last places before it, or a stretch start there."""
        if begin == 0:
            return [(0, START)]
        out: list[State] = []
        for p in range(max(1, begin - self.longest + 1), begin + 1):
            out += [(p, START)] if self.is_start(text, p) else [(p, r) for r in self.ending(text, p)]
        return out

    def sweep(self, text: str, states: list[State], first: int, last: int) -> tuple[dict[State, dict[State, float]], dict[State, list[State]]]:
        """From the states over all places first..last: the weight of each state from each start, and the steps back."""
        paths: dict[State, dict[State, float]] = {s: {s: 0.0} for s in states}
        back: dict[State, list[State]] = {}
        at: dict[int, list[State]] = {}
        for s in states:
            at.setdefault(s[0], []).append(s)
        for low in range(first, last + 1, 64):
            nodes = {end: self.ending(text, end) for end in range(low, min(low + 64, last + 1))}
            ends = {end: [r for _, r in at.get(end, ())] for end in range(low - self.longest, low)} | nodes
            self.ask({(a, r) for end, rs in nodes.items() for r in rs for a in ends.get(end - int(self.length[r]), ()) if a != START})
            for end, rs in nodes.items():
                for r in rs:
                    state = (end, r)
                    for prev in at.get(end - int(self.length[r]), ()):
                        if prev[1] == START or self.pairs[prev[1], r]:
                            mine = paths.setdefault(state, {})
                            for entry, weight in paths[prev].items():
                                mine[entry] = max(mine.get(entry, -np.inf), weight)
                            back.setdefault(state, []).append(prev)
                    if state in paths:
                        at.setdefault(end, []).append(state)
        return paths, back

    def borders(self, text: str, begin: int, end: int) -> tuple[int, int]:
        """The first and the last stretch start in (begin, end]; -1 if there is none."""
        inside = range(begin + 1, min(end, len(text) - 1) + 1)
        lead = next((i for i in inside if self.is_start(text, i)), -1)
        return lead, next((i for i in reversed(inside) if self.is_start(text, i)), -1)

    def transfer(self, text: str, begin: int, end: int, final: bool) -> Matrix:
        """The max-plus matrix of the chunk from begin to end.

        text has twice the longest piece before the chunk, or all, and the letter after
        it. A final chunk is left only by pieces that end with it.
        """
        entry = self.entries(text, begin)
        lead, tail = self.borders(text, begin, end)
        paths, _ = self.sweep(text, entry, begin + 1, end if lead < 0 else lead)
        if lead >= 0:
            come: dict[State, float] = {}
            for s, row in paths.items():
                if s[0] == lead:
                    for e, weight in row.items():
                        come[e] = max(come.get(e, -np.inf), weight)
            inner, _ = self.sweep(text, [(tail, START)], tail + 1, end)
            paths = {s: come for s in inner}
        least = end if final else end - self.longest + 1
        out: Matrix = {}
        for s, row in paths.items():
            if least <= s[0] <= end:
                state = (s[0], START) if s[0] == tail else s
                for e, weight in row.items():
                    out.setdefault(e, {})[state] = weight
        return out

    def trace(self, text: str, begin: int, end: int, entry: State, leave: State) -> tuple[int, bytes]:
        """(place where they start, ids) of the pieces of a chunk between two states."""
        lead, tail = self.borders(text, begin, end)

        def path(back: dict[State, list[State]], state: State, source: State) -> list[int]:
            out = []
            while state != source:
                out.append(state[1])
                state = next(p for p in back[state] if source in paths[p])
            return out[::-1]

        paths, back = self.sweep(text, [entry], begin + 1, end if lead < 0 else lead)
        if lead < 0:
            return entry[0], self._packed(path(back, leave, entry), text[entry[0] :])
        goal = next(s for s in paths if s[0] == lead and entry in paths[s])
        head = self._packed(path(back, goal, entry), text[entry[0] :])
        middle = self.encode_short([text[lead:tail]])[0]
        paths, back = self.sweep(text, [(tail, START)], tail + 1, leave[0])
        rest = [] if leave[0] == tail else path(back, leave, (tail, START))
        return entry[0], head + middle + self._packed(rest, text[tail:])

    def _packed(self, ranks: list[int], text: str) -> bytes:
        return np.array(self.ids_of(ranks, text), "<u4").tobytes()


def compose(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product of two transfer matrices; associative."""
    out: Matrix = {}
    for s, row in a.items():
        mine: dict[State, float] = {}
        for m, x in row.items():
            for t, y in b.get(m, {}).items():
                mine[t] = max(mine.get(t, -np.inf), x + y)
        if mine:
            out[s] = mine
    return out


def cuts_of(length: int, chunk: int) -> list[tuple[int, int]]:
    """(begin, end) of a text's chunks."""
    return [(b, min(b + chunk, length)) for b in range(0, length, chunk)]


def window(text: str, begin: int, end: int, longest: int) -> tuple[str, int]:
    """(what a chunk's matrix is made from, place of it in the text)."""
    low = max(0, begin - 2 * longest)
    return text[low : end + 1], low


def shifted(m: Matrix, by: int) -> Matrix:
    return {(a + by, t): {(c + by, u): w for (c, u), w in row.items()} for (a, t), row in m.items()}


def chunk_matrix(v: Vocabulary, part: str, low: int, begin: int, end: int, final: bool) -> Matrix:
    """``transfer`` with places of the whole text."""
    if low:  # states so near the window's edge are not states of the border
        return shifted(v.transfer(part, begin - low, end - low, final), low)
    return v.transfer(part, begin, end, final)


def settle(matrices: list[Matrix], entry: State = (0, START), leave: State | None = None) -> list[tuple[State, State]]:
    """The states at both borders of each matrix on the path from one state through all of them to another, or to the best.

    Products from the left say which states can be reached, one pass from the right
    which of them the end comes from.
    """
    reach = [{entry: {entry: 0.0}}]
    for m in matrices:
        reach.append(compose(reach[-1], m))
    state = leave or max(reach[-1][entry].items(), key=lambda x: x[1])[0]
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        come = next(s for s, row in matrices[k].items() if state in row and s in reach[k][entry])
        out.append((come, state))
        state = come
    return out[::-1]


def encode_text(v: Vocabulary, text: str, chunk: int = CHUNK) -> bytes:
    """Ids of one text by chunks, in one place."""
    t = v.prepare(text)
    if len(t) <= chunk:
        return v.encode_short([t])[0]
    cuts = cuts_of(len(t), chunk)
    parts = [window(t, b, e, v.longest) for b, e in cuts]
    ms = [chunk_matrix(v, p, low, b, e, e == len(t)) for (p, low), (b, e) in zip(parts, cuts)]
    out = []
    for (p, low), (b, e), (x, y) in zip(parts, cuts, settle(ms)):
        out.append(v.trace(p, b - low, e - low, (x[0] - low, x[1]), (y[0] - low, y[1]))[1])
    return b"".join(out)


def vocabulary(path: str) -> Vocabulary:
    """The worker's own, kept until ``forget``."""
    return held(("maxplus", path), lambda: Vocabulary(path))


DIGEST = "n_ids long, ids_crc32 long, decoded_sha256 string"
#: More code points than any piece of a model has.
LONGEST = 64
#: So many matrices are combined in one step of the tree.
FAN_IN = 16


def digested(v: Vocabulary, ids: Iterable[bytes]) -> pd.DataFrame:
    return pd.DataFrame([(len(x) // 4, zlib.crc32(x), hashlib.sha256(v.decode(x).encode()).hexdigest()) for x in ids], columns=["n_ids", "ids_crc32", "decoded_sha256"])


def product(matrices: list[Matrix]) -> Matrix:
    return reduce(compose, matrices)


def listed(m: Matrix) -> list[list[int]]:
    return [[*s, *t, int(w)] for s, row in m.items() for t, w in row.items()]


def unlisted(entries: Iterable[np.ndarray]) -> Matrix:
    m: Matrix = {}
    for a, x, c, y, w in entries:
        m.setdefault((int(a), int(x)), {})[int(c), int(y)] = float(w)
    return m


def borders(matrices: DataFrame) -> DataFrame:
    """(row, at, x): the states (end, piece, end, piece) at both borders of every chunk, on its text's one path.

    matrices: (row, at, m), at being the chunk's number. Up a tree, neighbours are combined into
    their product, FAN_IN at a time, until a text is one matrix; down it, the borders of
    a product settle those of the matrices it was made of. So no task holds more than
    FAN_IN matrices, however long a text is.
    """

    def up(b: pd.DataFrame) -> pd.DataFrame:
        m = product([unlisted(x) for x in b.sort_values("at")["m"]])
        return pd.DataFrame({"row": [b["row"].iloc[0]], "at": [b["at"].iloc[0] // FAN_IN], "m": [listed(m)]})

    def down(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("at")
        x = b["x"].iloc[0]
        ends = ((0, START), None) if x is None else ((int(x[0]), int(x[1])), (int(x[2]), int(x[3])))
        return pd.DataFrame({"row": b["row"], "at": b["at"], "x": [[*s, *t] for s, t in settle([unlisted(m) for m in b["m"]], *ends)]})

    levels = [written(matrices)]
    most = levels[0].agg(F.max("at")).first()[0] or 0
    while most >= FAN_IN:
        levels.append(written(levels[-1].groupBy("row", F.floor(F.col("at") / FAN_IN)).applyInPandas(up, "row string, at int, m array<array<int>>")))
        most //= FAN_IN
    settled = None
    for level in reversed(levels):
        above = level.withColumn("above", F.floor(F.col("at") / FAN_IN).cast("int"))
        if settled is None:
            above = above.withColumn("x", F.lit(None).cast("array<int>"))
        else:
            above = above.join(settled.select("row", F.col("at").alias("above"), "x"), ["row", "above"])
        settled = above.groupBy("row", "above").applyInPandas(down, "row string, at int, x array<int>")
    return settled


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, digest: bool = False) -> DataFrame:
    """(id_col, ids) of each row: the ids of its whole text in binary (little-endian, 32 bits).

    With ``digest``, (id_col, n_ids, ids_crc32, decoded_sha256) instead: the count and
    the checksum of these ids, and the hash of the text decoded from them.

    A text of one chunk is encoded where it stands. The chunks of a longer one are
    rows of their own, which meet only as transfer matrices, by a key of the text's own,
    and are put together at the end. Null and empty texts have no ids. Repeated rows are
    encoded each; ids may be null. Columns beside id_col and text_col are ignored, and
    only text passes through Python.
    """
    slim = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = F.length("t") + 1  # with the space put before it
    result = ["n_ids", "ids_crc32", "decoded_sha256"] if digest else ["ids"]

    def encoded(texts: pd.Series) -> pd.DataFrame:
        v, parts = vocabulary(model), []
        for at in range(0, len(texts), 600):
            ids = v.encode_short([v.prepare(t) for t in texts.iloc[at : at + 600]])
            parts.append(digested(v, ids) if digest else pd.DataFrame({"ids": ids}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=result)

    # more workers wait their turn than work at once: none keeps its tables after a task
    @F.pandas_udf(DIGEST if digest else "ids binary")
    def short(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            yield from map(encoded, batches)
        finally:
            forget()

    small = slim.where(size <= chunk).select("k", short("t").alias("x")).select("k", "x.*")

    prepared = F.concat(F.lit(SPACE), F.translate("t", " ", SPACE))
    giant = slim.where(size > chunk).select("k", F.expr("uuid()").alias("row"), prepared.alias("t"), size.alias("n"))
    cut = giant.select("k", "row", "t", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk))).alias("begin"))
    low = F.greatest(F.col("begin") - 2 * LONGEST, F.lit(0))
    cut = cut.select("k", "row", "n", "begin", (F.col("begin") / chunk).cast("int").alias("at"), low.alias("low"), F.least(F.col("begin") + chunk, "n").alias("end"), F.substring("t", low + 1, F.least(F.col("begin") + chunk, "n") + 1 - low).alias("t"))
    pieces = written(cut)

    def flattened(b: pd.DataFrame) -> pd.DataFrame:
        v = vocabulary(model)
        if v.longest >= LONGEST:
            raise ValueError(f"a piece of {v.longest} code points")
        rows = [(r.row, r.at, listed(chunk_matrix(v, r.t, r.low, r.begin, r.end, r.end == r.n))) for r in b.itertuples(index=False)]
        return pd.DataFrame(rows, columns=["row", "at", "m"])

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from map(flattened, batches)
        finally:
            forget()

    def traced_back(t: pd.Series, low: pd.Series, begin: pd.Series, end: pd.Series, x: pd.Series) -> pd.Series:
        v = vocabulary(model)
        return pd.Series([v.trace(t, b - o, e - o, (x[0] - o, x[1]), (x[2] - o, x[3]))[1] for t, o, b, e, x in zip(t, low, begin, end, x)], dtype=object)

    @F.pandas_udf("binary")
    def back(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            yield from (traced_back(*b) for b in batches)
        finally:
            forget()

    matrices = pieces.select("row", "at", "n", "begin", "low", "end", "t").mapInPandas(flat, "row string, at int, m array<array<int>>")
    # stored, so that no task has a worker that settles beside one that traces, each with its own memory
    settled = written(borders(matrices))
    traced = pieces.join(settled, ["row", "at"]).select("k", "row", "at", back("t", "low", "begin", "end", "x").alias("ids"))
    parts = traced.groupBy("row", "k").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("x"))
    joined = F.aggregate("x", F.lit(b"").cast("binary"), lambda a, y: F.concat(a, y["ids"]))
    whole = parts.select("k", joined.alias("ids"))

    @F.pandas_udf(DIGEST)
    def sum_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            yield from (digested(vocabulary(model), ids) for ids in batches)
        finally:
            forget()

    if digest:
        whole = whole.select("k", sum_up("ids").alias("x")).select("k", "x.*")
    return small.union(whole).withColumnRenamed("k", id_col)

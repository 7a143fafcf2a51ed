"""Toxicity by a lexicon trie met with Levenshtein automata.

Terms and stems that mark toxic documents are learned from labelled training rows and
kept in a trie. A word is run through the product of the trie and the Levenshtein
automata of its terms, made deterministic as words need it; so it finds exact and
misspelled terms in one pass over its letters. The words around each find tell
quotation from abuse, and a logistic model turns a document's finds into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, written

WORDS = re.compile(r"[^\W\d_]+")
STEMS = range(4, 9)
#: Terms shorter than this are found only as they stand, stems from one letter more.
FUZZY_FROM = 5
#: Words that report or mention speech, and words that address someone (fixed values).
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes word words term terms slur insult insults mean means defined reported sagte schrieb wort zitat nannte dit écrit mot citation appelé dijo escribió palabra cita llamó".split())
ADDRESS = frozenset("you your youre u ur du dich dein ihr tu toi ton vous votre tú te eres usted".split())
_QUOTES = "\"'“”„«»‘’"


class TermAutomaton:
    """Finds of words: (term, edits) of the nearest term within one edit, or None.

    terms: {term: weight}; a term that ends in ``*`` is a stem, which any ending may
    follow. A state is a set of (trie node, edits so far); the transitions met so far
    are kept as a table, emptied if it outgrows ``LARGEST``.
    """

    LARGEST = 300_000

    def __init__(self, terms: Iterable[str]) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.end: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]
        for t in sorted(terms):
            word, at = t.rstrip("*"), 0
            loose = len(word) >= FUZZY_FROM + t.endswith("*")
            self.fuzzy[0] |= loose
            for c in word:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.end.append(None)
                    self.stem.append(None)
                    self.fuzzy.append(False)
                at = self.child[at][c]
                self.fuzzy[at] |= loose
            (self.stem if t.endswith("*") else self.end)[at] = t
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.table: dict[tuple[int, str], int] = {}
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The number of a set of items, with what a missing letter leads to added; -1 for none."""
        for node, e in list(items):
            if e == 0:
                items |= {(n, 1) for n in self.child[node].values() if self.fuzzy[n]}
        items = frozenset((n, e) for n, e in items if not (e == 1 and (n, 0) in items))
        if not items:
            return -1
        if items not in self.states:
            self.states[items] = len(self.members)
            self.members.append(items)
        return self.states[items]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.members[state]:
            if self.stem[node]:
                out.add((node, e))
            nxt = self.child[node].get(c)
            if nxt is not None and (e == 0 or self.fuzzy[nxt]):
                out.add((nxt, e))
            if e == 0 and self.fuzzy[node]:
                out.add((node, 1))
                out |= {(n, 1) for n in self.child[node].values() if self.fuzzy[n]}
        return self._state(out)

    def __call__(self, word: str) -> tuple[str, int] | None:
        if len(self.table) > self.LARGEST:
            self.table.clear()
        state = self.start
        for c in word:
            nxt = self.table.get((state, c))
            if nxt is None:
                nxt = self.table[state, c] = self._step(state, c)
            if nxt < 0:
                return None
            state = nxt
        best = None
        for node, e in self.members[state]:
            for t in (self.end[node], self.stem[node]):
                if t and (e == 0 or len(t.rstrip("*")) >= FUZZY_FROM + t.endswith("*")):
                    x = (e, t.endswith("*"), -len(t), t)
                    best = x if best is None or x < best else best
        return (best[3], best[0]) if best else None


def learn_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int, ratio: float, least: int) -> dict[str, float]:
    """{term: log odds}: words and stems (``abc*``) that toxic documents have ``ratio`` times as often as clean ones.

    counts: documents with a term (toxic, clean). A stem replaces the longer stems and
    the words that it begins.
    """
    odds = {}
    for t, (a, b) in counts.items():
        x = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if a >= least and x >= math.log(ratio):
            odds[t] = x
    out: dict[str, float] = {}
    for t in sorted(odds, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t)):
        word = t.rstrip("*")
        if not any(word[:k] + "*" in out for k in STEMS if k <= len(word) - t.endswith("*")):
            out[t] = odds[t]
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


FEATURES = 9


class Scorer:
    """The features of a text: finds by closeness and by context, how many, how dense, how telling."""

    REMEMBERED = 250_000

    def __init__(self, terms: dict[str, float]) -> None:
        self.terms, self.find = terms, TermAutomaton(terms)
        self.clean: set[str] = set()
        self.hit: dict[str, tuple[str, int]] = {}

    def finds(self, text: str) -> list[tuple[int, int, str, int, bool, bool]]:
        """(start, end, term, edits, quoted, addressed) of each find, by code points of the lower-cased text."""
        low = text.lower()
        every = set(WORDS.findall(low))
        new = every.difference(self.clean)
        for w in [w for w in new if w not in self.hit]:
            f = self.find(w)
            if f:
                if len(self.hit) > self.REMEMBERED:
                    self.hit.clear()
                self.hit[w] = f
            else:
                if len(self.clean) > self.REMEMBERED:
                    self.clean.clear()
                self.clean.add(w)
        new = {w: self.hit.get(w) or self.find(w) for w in new}
        if not any(new.values()):
            return []
        out = []
        for m in WORDS.finditer(low):
            f = new.get(m.group())
            if f:
                left, right = low[max(0, m.start() - 40) : m.start()], low[m.end() : m.end() + 40]
                near = {*WORDS.findall(left), *WORDS.findall(right)}
                marked = any(c in _QUOTES for c in left[-2:]) and any(c in _QUOTES for c in right[:2])
                out.append((*m.span(), *f, marked or bool(near & REPORTING), bool(near & ADDRESS)))
        return out

    def __call__(self, text: str) -> list[float]:
        found = self.finds(text)
        if not found:
            return [0.0] * FEATURES
        exact, loose = [f for f in found if f[3] == 0], [f for f in found if f[3]]
        weight = lambda fs: sum({f[2]: self.terms[f[2]] for f in fs}.values())
        count = lambda fs: math.log1p(len(fs))
        return [
            count([f for f in exact if not f[4]]),
            count([f for f in exact if f[4]]),
            count([f for f in loose if not f[4]]),
            count([f for f in loose if f[4]]),
            count([f for f in found if f[5]]),
            math.log1p(weight(exact)),
            math.log1p(weight(loose)),
            math.log1p(1000 * len(exact) / (1 + len(text) / 6)),
            math.log1p(1000 * len(loose) / (1 + len(text) / 6)),
        ]


def fit(x: np.ndarray, y: np.ndarray, decay: float = 0.01, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the bias comes last and is not decayed."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = decay * np.ones(x.shape[1])
    ridge[-1] = 1e-6
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        theta -= np.linalg.solve((x.T * w) @ x + np.diag(ridge), x.T @ (p - y) + ridge * theta)
    return theta


def is_held_out(id_col: str) -> F.Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, ratio: float = 30.0, least: int = 5, share: float = 0.004, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], np.ndarray]:
    """(terms, weights) learned from labelled rows that are not held out, at most ``sample`` of them, in the order of their id's hash.

    A term stands in at least ``least`` toxic documents, and in that share of them; there is
    no other bound on the terms, whose number the sample's texts limit. An id with several
    labels is toxic if one of them is; of an id with several texts the least is taken.
    Without toxic or clean rows there are no terms and all texts score alike. Only the
    sample is read more than once.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col))
    rows = rows.groupBy(F.col(id_col).alias("_k")).agg(F.max("toxic").alias("_y")).orderBy(F.xxhash64("_k"), "_k").limit(sample)
    # at most `sample` pairs of small numbers
    texts = docs.select(F.col(id_col).alias("_k"), F.col(text_col).alias("_t")).join(F.broadcast(rows), "_k").where("_t is not null")
    texts = written(texts.groupBy("_k").agg(F.min("_t").alias("_t"), F.first("_y").cast("int").alias("_y")).select("_t", "_y"))

    sizes = {r[0]: r[1] for r in texts.groupBy(F.col("_y") != 0).count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return {}, np.array([0.0] * FEATURES + [30.0 if toxic else -30.0])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()

        def out() -> pd.DataFrame:
            keys = list(toxic.keys() | clean.keys())
            return pd.DataFrame({"t": keys, "a": [toxic[k] for k in keys], "b": [clean[k] for k in keys]})

        for b in batches:
            for t, y in zip(b["_t"], b["_y"]):
                words = set(WORDS.findall(t.lower()))
                stems = {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}
                (toxic if y else clean).update(words | stems)
            if len(toxic) + len(clean) > 400_000:
                yield out()
                toxic, clean = Counter(), Counter()
        if toxic or clean:
            yield out()

    counts = texts.mapInPandas(count, "t string, a long, b long").groupBy("t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # as learn_terms has it, a little looser for rounding
    least = max(least, math.ceil(share * toxic))
    telling = (F.col("a") + 0.5) * (clean + 1) >= (F.col("b") + 0.5) * (0.999 * ratio * (toxic + 1))
    counts = counts.where((F.col("a") >= least) & telling)
    found = {r[0]: (r[1], r[2]) for r in counts.collect()}
    terms = learn_terms(found, toxic, clean, ratio, least)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(terms)
        for b in batches:
            yield pd.DataFrame({"x": [score(t) for t in b["_t"]], "y": b["_y"]})

    rows = texts.mapInPandas(measure, "x array<double>, y int").collect()
    return terms, fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float))


def score_of(text: F.Column, model: tuple[dict[str, float], np.ndarray]) -> F.Column:
    """The score of a text column, and whether it has any find; null text counts as empty. No other column passes through Python."""
    terms, theta = model

    @F.pandas_udf("score double, found boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        measure = Scorer(terms)
        for b in batches:
            x = np.array([measure(t or "") for t in b]).reshape(len(b), FEATURES)
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-(x @ theta[:-1] + theta[-1]))), "found": x[:, 0] + x[:, 1] + x[:, 2] + x[:, 3] > 0})

    return run(text)


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted, found) for each row: 0 to 1, 1 from a score of 0.5 on, and whether the text has any term.

    Null text counts as empty, which has the score of a text without finds. Rows that
    repeat score alike, rows with a null id like any other; an empty table gives no rows.
    """
    found = docs.select(id_col, score_of(F.col(text_col), model).alias("_x"))
    return found.select(id_col, "_x.score", (F.col("_x.score") >= 0.5).cast("int").alias("predicted"), "_x.found")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """docs without the rows that a model learned from labels predicts toxic.

    All columns stay as they are, of whatever name and type, since only the text passes
    through Python; null texts, null and repeated ids are rows like any other.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    return docs.where(score_of(F.col(text_col), model)["score"] < 0.5)

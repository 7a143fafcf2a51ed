"""Personal data by weak supervision.

Strict patterns give the base spans. Wider patterns add candidates (spelled-out
addresses, phone numbers without a plus, card numbers with other separators). Labelers
of three sorts - format rules, gazetteers, context - vote on every candidate;
expectation-maximisation over the vote patterns of all documents estimates how reliable
each labeler is; a logistic classifier on the span's own features is trained on the
resulting probabilities and decides which candidates become spans beside the base ones.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, small_batches, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# starting inside a run of digits never matches where the run's start does not, so only run starts are tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Wider patterns; bounded, so that no text makes them slow.
_WIDE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{2,63}){1,4}"), re.compile(r"@|[(\[{]at[)\]}]")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{2,6}){2,4}(?![0-9])"), None),
    ("phone", re.compile(r"(?<![0-9+])(?:\+|00)?[ (]{0,2}[0-9]{1,4}[ ).-]{1,2}(?:[0-9]{2,4}[ .-]){1,4}[0-9]{2,4}(?![0-9])"), None),
)
#: Words that announce personal data or something else (fixed values).
CUES = {
    "email": ("email", "e-mail", "mail", "mailto", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "addr", "adresse", "servidor"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "appelez", "llame"),
}
ANTI = ("password", "token", "secret", "key", "hash", "sha", "id", "version", "isbn", "order", "total", "page", "build")
TLDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict spans: leftmost, not overlapping within a kind; by kind as in KINDS, then start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def wide_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the wider patterns that touch no base span and no earlier candidate."""
    starts: list[int] = []  # of what is taken, joined where it overlaps, in order
    ends: list[int] = []
    out = []
    for s, e in sorted((s, e) for _, s, e in taken):
        if starts and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for kind, pattern, needs in _WIDE:
        if needs and not needs.search(text):
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            at = bisect_left(starts, e)  # the last that starts before this one's end
            if not at or ends[at - 1] <= s:
                starts.insert(at, s)
                ends.insert(at, e)
                out.append((kind, s, e))
    return out


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """A vote of each labeler: 1 personal data, -1 not, 0 no opinion."""
    span = text[start:end]
    before = re.findall(r"[\w-]+", text[max(0, start - 40) : start].lower())[-3:]
    left, right = text[start - 1 : start], text[end : end + 1]
    digits = re.sub(r"[^0-9]", "", span)
    free = (not left or left.isspace() or left in "(<[\"':,;") and (not right or right.isspace() or right in ".,;:!?)>]\"'")
    if kind == "email":
        valid = 1 if re.search(r"[.)\]}] ?[A-Za-z]{2,}$", span) else -1
        known = 1 if span.lower().rsplit(".", 1)[-1].strip(" )]}") in TLDS else 0
    elif kind == "card":
        valid = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
        known = 1 if digits[:1] in "3456" and len(digits) in (15, 16) else -1
    elif kind == "phone":
        valid = 1 if 9 <= len(digits) <= 15 else -1
        known = 1 if span[:1] == "+" or span[:2] == "00" or "(" in span else 0
    else:
        valid, known = 1, 0 if digits[:1] == "0" else 1
    return (
        1 if strict else 0,
        valid,
        known,
        1 if any(w in CUES[kind] for w in before) else 0,
        -1 if any(w in ANTI for w in before) or left == "=" else 0,
        1 if free else -1,
    )


def features(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """What the classifier sees of a span: small integers, so that distinct rows stay few."""
    span, left, right = text[start:end], text[start - 1 : start], text[end : end + 1]
    digits = sum(c.isdigit() for c in span)
    kindof = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3
    groups = len(re.findall(r"[0-9]+", span))
    return (KINDS.index(kind), min(digits, 20), min(groups, 6), kindof(left), kindof(right), int("+" in span), int("(" in span), int("@" in span), int(luhn(re.sub(r"[^0-9]", "", span)) if digits else 0))


def fit_reliability(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns (one row each, values -1, 0, 1).

    Returns the probability of being personal data for each pattern, each labeler's
    reliability table (class, vote) and the share of personal data. Labelers count as
    independent given the class, and having no opinion as saying nothing; one count in
    each cell keeps rare patterns finite.
    """
    score = patterns.sum(axis=1)
    prob = 1 / (1 + np.exp(-score.astype(float)))
    table = np.zeros((patterns.shape[1], 2, 3))
    prior = 0.5
    for _ in range(rounds):
        w = np.stack([(1 - prob) * counts, prob * counts])
        prior = (w[1].sum() + 1) / (counts.sum() + 2)
        for j in range(patterns.shape[1]):
            for v in (-1, 1):
                table[j, :, v + 1] = w[:, patterns[:, j] == v].sum(axis=1) + 1
        table /= table.sum(axis=2, keepdims=True)
        table[:, :, 1] = 1
        log = np.log([1 - prior, prior])[:, None] + sum(np.log(table[j][:, patterns[:, j] + 1]) for j in range(patterns.shape[1]))
        prob = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return prob, table, prior


#: Sizes of the one-hot blocks of ``features``.
_WIDTHS = (4, 21, 7, 4, 4, 2, 2, 2, 2)


def encode(rows: np.ndarray) -> np.ndarray:
    """One-hot features and their products with the kind."""
    hot = np.concatenate([np.eye(w)[rows[:, i]] for i, w in enumerate(_WIDTHS)], axis=1)
    return np.concatenate([hot * (rows[:, :1] == k) for k in range(len(KINDS))] + [np.ones((len(rows), 1))], axis=1)


def fit_classifier(rows: np.ndarray, prob: np.ndarray, counts: np.ndarray, rounds: int = 400, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels, by full gradient steps; rows weigh as the log of their count."""
    x, w = encode(rows), np.log1p(counts) / np.log1p(counts).sum()
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        theta -= 4.0 * (x.T @ (w * (1 / (1 + np.exp(-x @ theta)) - prob)) + decay * theta)
    return theta


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def scanned(text: str) -> list[list[int]]:
    """Base and wide spans of a text, each as kind, start, end, whether it is a base one, votes and features."""
    if not text:
        return []
    base = base_spans(text)
    found = base + wide_spans(text, base)
    return [[KINDS.index(kind), s, e, int(i < len(base)), *votes(text, kind, s, e, i < len(base)), *features(text, kind, s, e)] for i, (kind, s, e) in enumerate(found)]


def fit(patterns: DataFrame) -> np.ndarray | None:
    """The classifier's weights from a column ``x`` of scanned spans; None if there are none.

    Only counts by vote and feature pattern, a bounded number, reach the driver.
    """
    tally = patterns.groupBy(F.slice("x", 5, 100).alias("p")).count().orderBy("p").collect()
    if not tally:
        return None
    rows, counts = np.array([r[0] for r in tally]), np.array([r[1] for r in tally], float)
    prob, _, _ = fit_reliability(rows[:, :6], counts)
    return fit_classifier(rows[:, 6:], prob, counts)


def decided(found: list, theta: np.ndarray | None, threshold: float) -> tuple[list, list]:
    """(base spans, added spans) among scanned ones."""
    spans = [(KINDS[x[0]], int(x[1]), int(x[2])) for x in found]
    base = [s for s, x in zip(spans, found) if x[3]]
    extra = [(s, x) for s, x in zip(spans, found) if not x[3]]
    if not extra or theta is None:
        return base, []
    keep = 1 / (1 + np.exp(-encode(np.array([list(x[10:]) for _, x in extra])) @ theta)) >= threshold
    return base, [s for (s, _), good in zip(extra, keep) if good]


def find_pii(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base, spans, n_added) for each row.

    The counts and ``base`` are of the strict spans; ``spans`` has these and the added
    ones, as kind:start:end in code points, end exclusive. Null text is empty; an empty
    table gives no rows; rows that repeat give the same result each. The text is read
    once, and nothing but spans is kept of it.
    """

    @F.pandas_udf("array<array<int>>")
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([scanned(t) for t in texts], index=texts.index, dtype=object)

    seen = written(docs.select(F.col(id_col).alias("k"), scan(F.coalesce(F.col(text_col), F.lit(""))).alias("found")))
    theta = fit(seen.select(F.explode("found").alias("x")))

    counts = ", ".join(f"n_{x} long" for x in KINDS)

    @F.pandas_udf(f"{counts}, base string, spans string, n_added long")
    def decide(column: pd.Series) -> pd.DataFrame:
        out = []
        for found in column:
            base, extra = decided(found, theta, threshold)
            out.append((*(sum(s[0] == kind for s in base) for kind in KINDS), joined(base), joined(base + extra), len(extra)))
        return pd.DataFrame(out, columns=[*[f"n_{x}" for x in KINDS], "base", "spans", "n_added"])

    return seen.select(F.col("k").alias(id_col), decide("found").alias("x")).select(id_col, "x.*")


def base_digest(base: str = "base") -> F.Column:
    return F.sha2(base, 256)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    cut: list[list] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], x[2], x[0])):
        if cut and s < cut[-1][2]:
            cut[-1][2] = max(cut[-1][2], e)
        else:
            cut.append([k, s, e])
    out, at = [], 0
    for k, s, e in cut:
        out += [text[at:s], f"<{k}>"]
        at = e
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with their personal data masked; every row and column stays, a null text too.

    Reads the text twice, to learn and to mask, and moves none of it. The other columns,
    of whatever name and type, do not pass through Python. Rows that repeat are masked
    alike; an empty table gives no rows.
    """

    # workers wait for other steps after this: they give their memory back at both ends of a task
    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        try:
            yield from (pd.DataFrame({"x": pd.Series([x for t in b["t"] for x in scanned(t)], dtype=object)}) for b in batches)
        finally:
            forget()

    small_batches(docs.sparkSession)
    theta = fit(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInPandas(patterns, "x array<int>"))

    def masked_texts(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = scanned(t)
            out.append(masked(t, [s for some in decided(found, theta, threshold) for s in some]) if found else t)
        return pd.Series(out, index=texts.index, dtype=object)

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        try:
            yield from map(masked_texts, batches)
        finally:
            forget()

    return docs.withColumn(text_col, mask(F.col(text_col)))

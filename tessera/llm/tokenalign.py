"""Which tokens of one tokenizer correspond to which of another.

Both token sequences of a text cover the same bytes. Added token lengths give ends; ends
that both sides have (the join on document and end) cut the text into groups, numbered by
the running count of cuts; and between two neighbouring ends of either side lies exactly
one token of each, so the ends of a document, full-outer-joined, are its links: every pair
of tokens whose bytes overlap, found once, in time linear in the tokens however long a
group is.

The tokens of a document never leave it: they are made, added up, joined and numbered in
the task that holds the text, on arrays. What is corpus-wide is relational: links by pair
are exploded, counted, ranked within each token of the second tokenizer and joined back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import held, small_batches, written

#: How byte-level vocabularies of this family cut a text into pieces (fixed value, public).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text with a longer run without a border goes to the slower of two equal encoders, which takes time in proportion to it.
LONG = re.compile(r"\S{2000}|\s{2000}")
#: So many pairs are broadcast at most (24 bytes each in memory); more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000


def _byte_chars() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a character: visible Latin-1 ones as themselves, the others in order from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        chars, vocab = _byte_chars(), data["model"]["vocab"]
        added = {t["content"] for t in data["added_tokens"]}
        self.bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]) + 1)
        for piece, k in vocab.items():
            if piece not in added:
                self.bytes[k] = bytes(chars[c] for c in piece)
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.fast = self._ranked(data, added)

    def _ranked(self, data: dict, added: set[str]) -> object | None:
        """The same encoding by ranks, several times faster, if ids stand in the order of merges and pieces are cut by PATTERN; else none."""
        import tiktoken

        vocab, model = data["model"]["vocab"], data["model"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        pre = data.get("pre_tokenizer") or {}
        plain = data.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("dropout") and not model.get("ignore_merges")
        ranks = {b: i for i, b in enumerate(self.bytes) if b}
        if not plain or merged != sorted(merged) or len(ranks) != len(vocab) - len(added & vocab.keys()):
            return None
        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        text = " " + text
        if self.fast is None or LONG.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """A sentencepiece model, which adds the space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Aligner:
    """Aligns the two token sequences of a text."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_len, self.b_len = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        n, m = len(self.a_len), len(self.b_len)
        # a token's number and what follows it: A inside and at the end of its part of a group, B likewise
        self.words = [f"{i}{end}" for part, ends in ((n, ",|"), (m, ",;")) for end in ends for i in range(part)]
        self.b_at = 2 * n

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none if either does not spell out a space and the text."""
        if text:
            want = b" " + text.encode("utf-8", "surrogatepass")
            a, b = self.a(text), self.b(text)
            if b"".join(map(self.a.bytes.__getitem__, a)) == want == b"".join(map(self.b.bytes.__getitem__, b)):
                return np.array(a, np.int64), np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each link in order: which token of each side, and the number of its group."""
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        side = np.zeros(int(a_end[-1]) + 1 if len(a) else 0, np.uint8)
        side[a_end] = 1
        side[b_end] += 2
        side = side[side > 0]  # the ends of either side in order: 1, 2, or 3 for a cut
        before = lambda mark: np.cumsum(mark) - mark
        return before((side & 1).astype(np.int64)), before((side >> 1).astype(np.int64)), before((side == 3).astype(np.int64))

    def groups(self, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, group: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        if not len(a):
            return ""
        last = lambda at: np.flatnonzero(np.append(at[1:] != at[:-1], True))  # noqa: E731  the link at which a token ends
        a_group, b_group = group[last(a_at)], group[last(b_at)]
        count = int(group[-1]) + 1
        a_until, b_until = (np.cumsum(np.bincount(g, minlength=count)) for g in (a_group, b_group))
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.concatenate([[0], b_until])[a_group]] = a + len(self.a_len) * (np.append(a_group[1:], -1) != a_group)
        out[np.arange(len(b)) + a_until[b_group]] = self.b_at + b + len(self.b_len) * (np.append(b_group[1:], -1) != b_group)
        return "".join(map(self.words.__getitem__, out.tolist()))[:-1]


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id_col, n_a, n_b, n_groups, n_links, groups_sha256, links) for each row, stored.

    ``links`` holds (pair, times) of the distinct id pairs that a document links, pair being
    the A id times the number of B ids plus the B id. Null and empty texts, and texts that
    either side does not spell out, have no tokens: zeros, an empty digest and no links.
    """
    small_batches(docs.sparkSession)
    width = len(Pieces(b_path).bytes)
    kind = pa.int32() if len(ByteLevel(a_path).bytes) * width < 2**31 else pa.int64()
    parts = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(("tokenalign", a_path, b_path), lambda: Aligner(a_path, b_path))
        for batch in batches:
            rows, pairs, times = [], [], []
            for text in batch.column("t"):
                a, b = aligner.tokens(text.as_py())
                a_at, b_at, group = aligner.align(a, b)
                spelled = aligner.groups(a, b, a_at, b_at, group)
                pair, n = np.unique(a[a_at] * width + b[b_at], return_counts=True)
                rows.append((len(a), len(b), int(group[-1]) + 1 if len(group) else 0, len(group), hashlib.sha256(spelled.encode()).hexdigest() if spelled else ""))
                pairs.append(pair)
                times.append(n)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32)
            join = lambda x, t: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), t)
            links = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([join(pairs, kind), join(times, pa.int32())], ["pair", "times"]))
            columns = [batch.column("row"), batch.column("k"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(parts.values())], links]
            yield pa.RecordBatch.from_arrays(columns, ["row", "k", *parts, "links"])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"))
    of = "int" if kind == pa.int32() else "bigint"
    schema = f"row bigint, k {docs.schema[id_col].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<struct<pair:{of},times:int>>"
    return written(slim.mapInArrow(run, schema)).withColumnRenamed("k", id_col)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, count, best) of ``aligned`` rows, stored: links of each id pair in the corpus, and whether no pair of the same B id has more."""
    pairs = rows.select(F.explode("links").alias("x")).groupBy("x.pair").agg(F.sum("x.times").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair") % width))
    return written(pairs.select("pair", "count", (F.col("count") == most).alias("best")))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs.

    n_best counts links whose pair has the highest count of its B id, ties included;
    count_sum adds up the counts of all links' pairs. Every row keeps its place, whatever
    its id (null, repeated); rows that repeat count as often as they stand. Other columns
    of any name are ignored; an empty table gives no rows.
    """
    rows = aligned(docs, a_path, b_path, id_col, text_col)
    counts = pair_counts(rows, len(Pieces(b_path).bytes))
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    links = rows.select("row", F.explode("links").alias("x")).select("row", "x.pair", "x.times").join(counts, "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = rows.drop("links").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")

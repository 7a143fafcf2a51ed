"""N-gram Jaccard join by PartEnum signatures.

Sets of word n-grams whose sizes lie in one band differ in a bounded number k of
elements if they are similar enough. The hashed feature domain is cut into first-level
partitions, each of these into a few second-level ones, and every choice of
second-level partitions that could agree gives a signature, a hash of the set's
elements in them. Two sets that differ in at most k elements share a signature.

A signature's sets are compared with the one of smallest id, its leader. Sets of one
leader that are in different components after that are compared with each other, in blocks. A
parity sketch of each set (every element flips one bit of 1024, or of 4096) goes before both
comparisons: two sets differ in at least as many elements as their sketches in bits,
so what it leaves out is never similar. What it leaves is compared by the whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, forget, written



def shape(share: Fraction) -> tuple[float, int, int]:
    """(largest over smallest size of a band, parts of large sets' partitions, parts left out).

    At a lower similarity sets differ more and partitions hold less, so that choices of
    two parts of three would give too many signatures; then one part of two is chosen.
    """
    return (1.6, 3, 1) if share >= Fraction(85, 100) else (1.4, 2, 1)


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """The sorted distinct 64-bit hashes of a text's word n-grams (A-Z in lower case, words between ASCII white space)."""

    REMEMBERED = 250_000

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.REMEMBERED:
            known.clear()
        try:
            h = np.array(list(map(known.__getitem__, words)), np.uint64)
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array(list(map(known.__getitem__, words)), np.uint64)
        n = min(self.words, len(h))
        last = len(h) - n + 1
        out = np.full(last, n, np.uint64)
        for i in range(n):
            out += h[i : i + last] * np.uint64(_ODD[i])
        return np.unique(_mix(out))


def tolerance(share: Fraction, a: int, b: int) -> int:
    """In how many elements two sets of these sizes differ at most, at that similarity."""
    return math.floor((1 - share) / (1 + share) * (a + b))


@cache
def bands(share: Fraction, upto: int) -> list[tuple[int, int]]:
    out, low = [], 1
    while low <= upto:
        high = max(low, math.floor(low * shape(share)[0]) - 1)
        out.append((low, high))
        low = high + 1
    return out


#: How often a set that has too many empty partitions is cut anew, by other hashes.
RETRIES = 3


def reach(share: Fraction, n: int, high: int) -> int:
    """In how many elements a set of n differs at most from a similar one of its size or more, up to ``high``."""
    return tolerance(share, n, min(high, math.floor(n / share)))


@cache
def scheme(share: Fraction, band: int, low: int, high: int, again: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int, int] | None:
    """(cuts, columns, salts, first, parts, spoilt) of a band's partitions; None if its sets must be equal.

    columns: for each signature of one of the ``first`` first-level partitions, the
    second-level ones it keeps of its ``parts``; it takes ``spoilt`` + 1 differences to
    make all of them disagree. There are more first-level partitions than the largest sets
    can spoil, so that even beside what is expected to be empty one is left.
    """
    k = tolerance(share, high, high)
    if k == 0:
        return None
    _, large, left_out = shape(share)
    # small sets have few elements in a partition: more choices of larger parts tell them apart
    spoilt, parts = (k, k + 3) if k <= 3 else (2, 5) if k <= 12 else (1, 3) if k <= 48 else (left_out, large)
    keep, spare = parts - spoilt, 0
    sizes = np.unique(np.linspace(max(1, math.ceil(share * low)), high, 12).astype(int)).tolist()
    for _ in range(20):
        first = k // (spoilt + 1) + 1 + spare
        need = 0
        for n in sizes if k > 3 else []:
            weak = first * math.comb(parts, keep) * (1 - keep / (parts * first)) ** n
            need = max(need, math.ceil(weak + 3 * math.sqrt(weak)) - (k // (spoilt + 1) - reach(share, n, high) // (spoilt + 1)))
        need = min(k, need)
        if need <= spare:
            break
        spare = need
    first = k // (spoilt + 1) + 1 + spare
    cuts = np.array([(i << 64) // (first * parts) for i in range(1, first * parts)], np.uint64)
    columns = np.array(list(combinations(range(parts), keep)))
    salts = _mix(np.arange(first * len(columns), dtype=np.uint64) + np.uint64((band << 40) + (again << 56)))
    return cuts, columns, salts.reshape(first, -1), first, parts, spoilt


def signatures(s: np.ndarray, share: Fraction) -> np.ndarray:
    """All signatures of a set (sorted distinct hashes).

    A signature over partitions in which the set has nothing would be shared by sets that
    have nothing in common. Where fewer first-level partitions have such a one than must
    agree with any similar set, an agreeing partition without it is left: the set is
    settled, and its signatures that are not empty are enough for every pair it is in with
    a set of its size or more. A set that is not settled gives, beside these, the signatures of a retry,
    in which it meets all others that are not settled either. Only what no retry settles
    gives empty signatures.
    """
    n, out, cut = len(s), [], []
    for band, (low, high) in enumerate(bands(share, 1 << max(4, (n * 2).bit_length()))):
        if not share * low <= n <= high:
            continue
        for again in range(RETRIES + 1):
            plan = scheme(share, band, low, high, again)
            if plan is None:
                break
            cuts, columns, salts, first, parts, spoilt = plan
            if len(cut) <= again:
                x = np.sort(_mix(s + np.uint64(_ODD[again]))) if again else s
                cut.append((x, np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(x ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])))
            x, sums = cut[again]
            at = np.concatenate([[0], np.searchsorted(x, cuts), [n]])
            part = np.diff(sums[at]).reshape(first, parts)
            size = np.diff(at).reshape(first, parts)
            sig = part[:, columns].sum(axis=2, dtype=np.uint64) + salts
            full = size[:, columns].sum(axis=2) > 0
            settled = (~full.all(axis=1)).sum() < first - reach(share, n, high) // (spoilt + 1)
            out.append(_mix(sig[full] if settled or again < RETRIES else sig.reshape(-1)))
            if settled:
                break
    return np.concatenate(out) if out else np.empty(0, np.uint64)


#: Sets of more elements have the wide sketch as well.
WIDE_FROM = 1000


def sketch(s: np.ndarray, bits: int = 1024) -> np.ndarray:
    """So many bits, as long integers: each element flips one."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def possible(a: str, b: str, share: Fraction) -> F.Column:
    """Whether two sets, by size and sketch (structs with n, sk and wide; null if unknown), can be similar; never false for similar ones."""
    p, q = share.numerator, share.denominator
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    flips = lambda upto: sum((F.bit_count(F.col(f"{a}.sk")[i].bitwiseXOR(F.col(f"{b}.sk")[i])) for i in range(upto)), F.lit(0))
    x, y = F.col(f"{a}.wide"), F.col(f"{b}.wide")
    more = F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + v)
    near = lambda bits: bits * (p + q) <= (n + m) * (q - p)
    return F.coalesce((F.least(n, m) * q >= F.greatest(n, m) * p) & near(flips(4)) & near(flips(16)) & ((F.size(x) == 0) | (F.size(y) == 0) | near(more)), F.lit(True))


#: Sets of one leader are compared in blocks of about so many.
BLOCK = 512


class Sketches:
    """Sets of one block: ids, components, sizes and sketches, compared with each other's as whole arrays."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.ids, self.component, self.n = (rows[c].to_numpy(np.int64) for c in ("a", "c", "n"))
        self.known = rows["known"].to_numpy(bool)
        self.narrow = np.stack(rows["sk"].to_list()).view(np.uint64) if len(rows) else np.empty((0, 16), np.uint64)
        self.wide = [np.asarray(w).view(np.uint64) for w in rows["wide"]]

    def possible(self, other: Sketches, share: Fraction) -> list[tuple[int, int]]:
        """Pairs (id here, id there) of different components that ``possible`` does not rule out."""
        p, q = share.numerator, share.denominator
        out = []
        for at in range(0, len(self.ids), 64):
            here = slice(at, at + 64)
            n, m = self.n[here, None], other.n[None]
            unknown = ~(self.known[here, None] & other.known[None])
            i, j = np.nonzero((self.component[here, None] != other.component[None]) & ((np.minimum(n, m) * q >= np.maximum(n, m) * p) | unknown))
            i += at
            for upto in (4, 16):
                flips = np.bitwise_count(self.narrow[i, :upto] ^ other.narrow[j, :upto]).sum(axis=1, dtype=np.int64)
                keep = (flips * (p + q) <= (self.n[i] + other.n[j]) * (q - p)) | ~(self.known[i] & other.known[j])
                i, j = i[keep], j[keep]
            for x, y in zip(i.tolist(), j.tolist()):
                u, v = self.wide[x], other.wide[y]
                if self.known[x] and other.known[y] and len(u) and len(v) and int(np.bitwise_count(u ^ v).sum()) * (p + q) > (int(self.n[x]) + int(other.n[y])) * (q - p):
                    continue
                out.append((int(self.ids[x]), int(other.ids[y])))
        return out


def across(members: DataFrame, share: Fraction) -> DataFrame:
    """(a, b), pairs of sets of one leader but different components that their sketches do not rule out.

    members: (b, a, c, s), the leader, the set, its component and its sketch. A leader's
    sets are dealt by hash into blocks of about BLOCK, and every two blocks meet under a
    key of their own, so that no leader's sets land in one task; only what is left of the
    comparison is put out.
    """
    sizes = members.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("b", "blocks")
    dealt = members.join(written(sizes), "b").withColumn("i", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["b", "low", "high"]
    dealt = dealt.select("b", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), (F.col("i") > F.col("j")).alias("second"), "a", "c", F.coalesce("s.n", F.lit(0)).alias("n"), F.col("s").isNotNull().alias("known"), F.coalesce("s.sk", F.array_repeat(F.lit(0).cast("long"), 16)).alias("sk"), F.coalesce("s.wide", F.array().cast("array<long>")).alias("wide"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def met(rows: pd.DataFrame) -> list[tuple[int, int]]:
            if rows["low"].iloc[0] == rows["high"].iloc[0]:
                one = Sketches(rows)
                return [(x, y) for x, y in one.possible(one, share) if x < y]
            return Sketches(rows[~rows["second"]]).possible(Sketches(rows[rows["second"]]), share)

        def done(rows: pd.DataFrame, last: bool) -> tuple[list[tuple[int, int]], pd.DataFrame]:
            """The pairs of all whole groups, and the rows of the last one, which may go on."""
            values = rows[key].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]).any(axis=1)]))
            ends = np.append(starts[1:], len(rows))
            whole = len(starts) if last else len(starts) - 1
            found = [pair for s, e in zip(starts[:whole], ends[:whole]) if e - s > 1 for pair in met(rows.iloc[s:e])]
            return found, rows.iloc[starts[whole] :] if whole < len(starts) else rows.iloc[:0]

        for b in batches:
            if len(b):
                found, rest = done(pd.concat([*held, b], ignore_index=True), False)
                held = [rest]
                yield pd.DataFrame(found, columns=["x", "y"]).astype("int64")
        if held and len(held[0]):
            yield pd.DataFrame(done(held[0], True)[0], columns=["x", "y"]).astype("int64")

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(n, *key).sortWithinPartitions(*key).mapInPandas(compare, "x long, y long")
    return found.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def signed(slim: DataFrame, share: Fraction, words: int) -> DataFrame:
    """Rows of two sorts from slim (k, none, t): (sig, k, near) for signatures and (k, own) for each row itself.

    own: two hashes of the set, its size, whether the id is null, and the sketches. Sets that are
    equal give their signatures once for a stretch of rows. Of the sets with one signature in a
    stretch, the one of smallest id stands for the others, which name it as ``near``: so a
    signature that a large part of all rows have is combined before it is moved.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        shingles, given = Shingler(words), set()
        keys: list[int] = []
        sigs: list[np.ndarray] = []

        def combined() -> pd.DataFrame:
            sig, who = np.concatenate(sigs), np.repeat(np.array(keys, np.int64), [len(x) for x in sigs])
            order = np.lexsort((who, sig))
            sig, who = sig[order], who[order]
            first = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, bool)
            near = who[first][np.cumsum(first) - 1] if len(sig) else who
            again = ~first & (near != who)
            one = pd.DataFrame({"sig": _signed(sig[first]), "k": who[first]}).assign(near=None, own=None)
            two = pd.DataFrame({"sig": _signed(sig[again]), "k": who[again], "near": pd.array(near[again], "Int64")}).assign(own=None)
            keys.clear()
            sigs.clear()
            return one if two.empty else pd.concat([one.astype({"near": "Int64"}), two], ignore_index=True)

        for b in batches:
            own = []
            for k, none, t in zip(b["k"], b["none"], b["t"]):
                s = shingles(t)
                blob = s.tobytes()
                x = xxhash.xxh3_128_intdigest(blob)
                own.append(np.concatenate([np.array([x >> 64, x & (1 << 64) - 1], np.uint64).view(np.int64), np.array([len(s), none], np.int64), sketch(s), sketch(s, 4096) if len(s) >= WIDE_FROM else np.empty(0, np.int64)]))
                if len(s) and not none and x not in given:
                    given.add(x)
                    keys.append(k)
                    sigs.append(signatures(s, share))
                    if len(keys) >= 2048 or sum(map(len, sigs[-64:])) > 200_000:
                        yield combined()
                if len(given) > 200_000:
                    given.clear()
            yield pd.DataFrame({"sig": 0, "k": b["k"], "near": None, "own": pd.Series(own, index=b.index, dtype=object)})
        if keys:
            yield combined()

    return slim.mapInPandas(run, "sig long, k long, near long, own array<long>")


def ngram_join(docs: DataFrame, share: Fraction = Fraction(85, 100), words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of docs.

    Two documents link when their sets' intersection is at least ``share`` of their
    union; component_id is the smallest id reached over links, its own included. A
    document with fewer words than ``words`` has its whole sequence as its one
    element; null, empty and blank texts have none and link with nothing. A row with
    a null id links with nothing and has a null component. Rows that share an id are
    one document for the links, which it has by any of its texts. An empty table
    gives no rows; other columns are ignored.
    """
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k"), F.col(id_col).isNull().alias("none"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    p, q = share.numerator, share.denominator

    # what is not the one row of its signature in a stretch takes no part in the search for the least and is spread
    salt = F.when(F.col("own").isNull() & F.col("near").isNull(), F.lit(0)).otherwise(F.xxhash64("k", "sig"))
    least = F.min("k").over(Window.partitionBy("sig", "salt"))
    met = signed(slim, share, words).withColumn("salt", salt).withColumn("m", F.coalesce("near", least)).drop("salt")
    met = written(met.where("own is not null or m < k"))
    own = F.col("own")
    rows = met.where("own is not null").select("k", own[0].alias("y"), own[1].alias("x"), own[2].alias("n"), (own[3] == 1).alias("none"), F.slice("own", 5, 16).alias("sk"), F.slice("own", 21, 64).alias("wide"))
    full = rows.where("not none and n > 0")
    # one document stands for all with the same set; only sets that occur twice or more are in this table
    same = written(full.groupBy("y", "x", "n").agg(F.min("k").alias("c"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    classes = written(rows.where("not none").join(same, ["y", "x", "n"], "left").select("k", "n", F.coalesce("c", "k").alias("c"), "y", F.struct("n", "sk", "wide").alias("s")))
    named = classes.where("n > 0").select("k", "c").distinct()
    # an id with several texts has no one sketch; written, so that a join on a hot id has no aggregate in the way of its splitting
    sketches = written(classes.where("n > 0 and k = c").groupBy("c").agg(F.when(F.min("y") == F.max("y"), F.first("s")).alias("s")))

    def part(df: DataFrame, of: str, name: str, value: DataFrame) -> DataFrame:
        """df with what value (key, value) has for a column."""
        key, got = value.columns
        return df.join(value.select(F.col(key).alias(of), F.col(got).alias(name)), of, "left")

    # the least of all that have a signature, for those that named the least of their stretch
    leader = met.where("own is null and near is null").select("sig", F.col("m").alias("to")).distinct()
    pairs = met.where("own is null").join(leader, "sig", "left")
    pairs = pairs.select("k", F.coalesce("to", "m").alias("m")).where("k <> m").distinct()
    pairs = part(part(pairs, "k", "a", named), "m", "b", named).where("a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = written(part(part(pairs, "a", "x", sketches), "b", "y", sketches).select("a", "b", possible("x", "y", share).alias("maybe")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, last, leader = Shingler(words), None, None
        for b in batches:
            found = []
            for x in b.itertuples(index=False):
                if last != (x.b, x.tb):
                    last, leader = (x.b, x.tb), shingles(x.tb)
                s = shingles(x.ta)
                both = len(np.intersect1d(s, leader, assume_unique=True))
                if both * q >= p * (len(s) + len(leader) - both):
                    found.append((x.a, x.b))
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    texts = slim.where("not none")

    def links(which: DataFrame) -> DataFrame:
        """The pairs (a, b) of similar documents, by their whole texts."""
        both = which.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
        return both.mapInPandas(compare, "a long, b long")

    # an id that has several texts is one document
    twice = named.groupBy("k").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("a", "b")
    first = written(connected_components(links(pairs.where("maybe").select("a", "b")).union(twice)))

    inside = part(part(pairs.select("a", "b"), "a", "ca", first), "b", "cb", first)
    inside = written(inside.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    open_ = written(inside.where("ca <> cb").select("b").distinct())
    member = part(inside.join(open_, "b"), "a", "s", sketches).select("b", "a", F.col("ca").alias("c"), "s")
    more = written(across(written(member), share))
    more = part(part(links(more), "a", "ca", first), "b", "cb", first).select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = connected_components(more)
    final = first.join(second.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select(F.col("id").alias("c"), F.coalesce("to", "component").alias("component_id"))
    loose = second.join(first, second["id"] == first["component"], "left_anti").select(F.col("id").alias("c"), F.col("component").alias("component_id"))
    known = classes.join(final.union(loose), "c", "left").select(F.col("k").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "c").alias("component_id"))
    null = F.lit(None).cast("long")
    return known.union(rows.where("none").select(null.alias(id_col), F.col("n").alias("n_shingles"), null.alias("component_id")))

"""N-gram Jaccard join by token-combination prefixes.

The tokens of a document are hashes of its distinct shingles. Documents of equal word sequences are one class; one document
of each class is indexed, and classes are joined. Tokens are ordered: first the rare ones, then the frequent ones, each by
hash. Of two sets of Jaccard similarity t or more, the first common token lies within the first n - ceil(t * n) + 1 tokens of
each, the prefix. If it is rare they share a single of the index. Else all that they share are frequent tokens, and the
prefix, longer by s - 1 tokens, holds s common ones; frequent tokens fall into G groups by their low bits, so with s = G + 1
two of them are in one group. Frequent tokens are indexed by pairs within a group: some tokens of the longer prefix times
two, for sets of any size. G goes by powers of two of n; sets near such a bound are indexed for both sides.
So every pair that may link meets in an entry of this index.

Entries don't list all pairs of their classes. Every class of an entry is verified against the entry's centre, the class with
most frequent tokens for its size, usually the text that the others are variants of. Entries of more than LEAF classes that
are mostly the same share one centre, so that a family's differences are taken once and not once an entry. What links becomes components, and only
entries that still hold several of them go on. Where they have LEAF classes at most, one task compares the signatures of
classes of different components, and what those allow is verified. Larger ones go by an index of differences. Let D be the symmetric
difference of a class's set and the centre's. If two classes link and not both link with the centre, their D have tokens in
common, about half of each D (bounds in differences()). So D is indexed in its turn, by prefixes again, with the tokens that
the whole family shares gone: tokens of the class alone come first, those of the centre that it lacks last. Classes that meet there
are an entry again, without the old centre, so rounds end as the centres' rank falls. Links within a component change nothing
and are not looked for.

Verifying first compares odd sketches (parities of counts by leading bits), which bound the difference of two sets from below,
then whole sets. Members of a centre come in chunks, each with one copy of the centre's set.

Frequent tokens are those of the prefixes by hash alone of FREQUENT classes or more, up to MOST of the most frequent: which
ones count as frequent changes costs, never results. Tokens are 64-bit hashes of shingles; two sets of m and n shingles are
taken wrongly with a probability of about m * n / 2**64.

Documents without words or text have no tokens and link with nothing. Rows without an id are left out; of rows that share
an id the greatest text counts once. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, one_per_id, release, settle, unsettle
from .windows import powers

#: Words of a shingle and similarity as a fraction, in hundredths, unless a caller says otherwise.
SHINGLE = 4
SIMILAR = 85
FREQUENT = 9
MOST = 1_000_000
#: Classes of an entry up to which one task compares the signatures of all of them.
LEAF = 2000
#: Members of a centre that its usual differences are taken from at least.
USUAL = 9
#: Classes that one copy of a centre's set is compared with.
CHUNK = 64
#: Texts whose tokens are held together.
AT_ONCE = 200
#: Ids, 16 bytes each, that are sent to all executors; more are joined by shuffle.
SENT = 500_000

_rng = np.random.default_rng(31)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)
#: Lower-cases A-Z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def normal(text: str) -> bytes:
    """The words, with one space after each."""
    ws = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    return b"".join([b" ".join(ws), b" "]) if ws else b""


def tokens(raw: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of normal() text; fewer words than n are one shingle."""
    if not raw:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(raw, np.uint8)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    starts = np.concatenate(([0], np.flatnonzero(data == 32) + 1))
    k = min(n, len(starts) - 1)
    x = (sums[starts[k:]] - sums[starts[:-k]]) * down[starts[:-k]]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(x ^ (x >> np.uint64(29)))


def needed(n: int, similar: int = SIMILAR) -> int:
    """Least size of an intersection of a set of n tokens with one that links."""
    return -(-similar * n // 100)


def within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y; both are sorted."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def links(a: np.ndarray, b: np.ndarray, similar: int = SIMILAR) -> bool:
    both = int(within(a, b).sum())
    return both > 0 and 100 * both >= similar * (len(a) + len(b) - both)


def signature(t: np.ndarray) -> bytes:
    """An odd sketch: the parities of the counts of tokens by their leading bits, n to 2 n of them for n tokens, 1024 at least."""
    k = max(10, len(t).bit_length())
    return np.packbits(np.bincount((t >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k).astype(np.uint8) & 1).tobytes()


def folded(signs: np.ndarray) -> np.ndarray:
    """Rows of packed parities by one leading bit less."""
    bits = np.unpackbits(signs, axis=1)
    return np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1)


def may_link(a: bytes, b: bytes, na: int, nb: int, similar: int = SIMILAR) -> bool:
    """False only if sets of these signatures and sizes cannot link: a token in one set alone changes one parity, so sets
    differ by as many tokens as parities do at least."""
    x, y = sorted((np.frombuffer(a, np.uint8)[None, :], np.frombuffer(b, np.uint8)[None, :]), key=lambda v: v.shape[1])
    while y.shape[1] > x.shape[1]:
        y = folded(y)
    return int(np.bitwise_count(x ^ y).sum()) * (100 + similar) <= (100 - similar) * (na + nb)


def find(root: dict[int, int], c: int) -> int:
    while root.setdefault(c, c) != c:
        root[c] = c = root[root[c]]
    return c


def near_pairs(ids: list[int], parts: list[int], sizes: list[int], signs: list[bytes], similar: int, forest: bool) -> list[tuple[int, int]]:
    """The pairs across components whose sizes and signatures allow a link; with forest only as many as would join them all."""
    return near_some(ids, parts, sizes, signs, similar, forest)[0]


def near_some(ids: list[int], parts: list[int], sizes: list[int], signs: list[bytes], similar: int, forest: bool) -> tuple[list[tuple[int, int]], bool]:
    """near_pairs(), and whether the forest left none out. Signatures of sizes that fit are of one length or the next."""
    whole = True
    by: dict[int, list[int]] = {}
    for k, x in enumerate(signs):
        by.setdefault(len(x), []).append(k)
    part, n, out, root = np.asarray(parts), np.asarray(sizes), [], {}
    rows = lambda at: np.frombuffer(b"".join([signs[k] for k in at]), np.uint8).reshape(len(at), -1)
    for length, own in by.items():
        more = by.get(2 * length, [])
        table = np.concatenate([rows(own), folded(rows(more))]) if more else rows(own)
        at = np.asarray(own + more)
        for i, k in enumerate(own[: len(at) - 1]):
            rest = at[i + 1 :]
            apart = np.bitwise_count(table[i + 1 :] ^ table[i]).sum(1, dtype=np.int64)
            ok = (apart * (100 + similar) <= (100 - similar) * (n[k] + n[rest])) & (part[rest] != part[k])
            for j in rest[ok & (100 * np.minimum(n[k], n[rest]) >= similar * np.maximum(n[k], n[rest]))].tolist():
                x, y = find(root, parts[k]), find(root, parts[j])
                if x != y or not forest:
                    root[x] = y
                    out.append((min(ids[k], ids[j]), max(ids[k], ids[j])))
                else:
                    whole = False
    return out, whole


def mixed(*parts: np.ndarray | np.uint64) -> np.ndarray:
    """Hashes of tuples of numbers."""
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = (out + p) * MIX
        out = out ^ (out >> np.uint64(31))
    return out


def groups(band: int, similar: int) -> int:
    """Groups of frequent tokens for sets of 2**band to 2**(band + 1) - 1 tokens; 0 where they share too few for pairs."""
    g = max(1, (100 - similar) * (1 << band) // 100)
    return g if g + 1 <= needed(1 << band, similar) else 0


def paired(f: np.ndarray, g: int, kind: int) -> np.ndarray:
    """Keys of the pairs of f that are in one of g groups by their low bits."""
    at = f % np.uint64(g)
    order = np.lexsort((f, at))
    f, at, out = f[order], at[order], [np.zeros(0, np.uint64)]
    for j in range(1, len(f)):
        same = at[j:] == at[:-j]
        if not same.any():
            break
        out.append(mixed(np.uint64(kind), f[:-j][same], f[j:][same]))
    return np.concatenate(out)


def combined(often: np.ndarray, spare: int, band: int, similar: int) -> np.ndarray:
    """Keys of the frequent tokens of a set, sorted by hash, whose prefix has room for spare of them."""
    g = groups(band, similar)
    return paired(often[: spare + g], g, band) if g else often[:spare] ^ MIX2


def entries(t: np.ndarray, frequent: np.ndarray, similar: int = SIMILAR, n: int | None = None) -> np.ndarray | None:
    """Index keys of one set of n tokens. t are all of them or the first ones by hash; None if more must be known. Both arrays are sorted."""
    n = len(t) if n is None else n
    prefix = n - needed(n, similar) + 1
    often = within(t, frequent)
    rare = t[~often][:prefix]
    if len(rare) == prefix:  # too few others to link by frequent ones alone
        return rare
    if len(t) < n:
        return None
    keys, band = [rare], n.bit_length() - 1
    for b in (band, band + 1):
        if b == band or 100 * n // similar >= 1 << b:
            keys.append(combined(t[often], prefix - len(rare), b, similar))
    return np.unique(np.concatenate(keys))


def differences(x: np.ndarray, c: np.ndarray, frequent: np.ndarray, similar: int = SIMILAR, usual: np.ndarray | None = None) -> np.ndarray:
    """Keys of the difference D of set x and centre c: x meets every class that it links with and that isn't in one component with
    it by links with c. With d = |D|, and a and m the sizes of x and c, sets that link differ by at most
    f * (a + b) tokens, f = (100 - similar) / (100 + similar), and D and the other's D' have (d + d' - that) / 2 in common.
    One of two classes doesn't link with c, so its D is larger than f * (b + m): for the other this leaves more than
    (d + f * (m - a)) / 2. A class that doesn't link with c meets those that do by at least
    (d - f * (a + m) + 1 - f) / 2, as b is at most m + d' there, and d' at least 1. And by d less what x can differ by at all.
    Tokens that are frequent, or the centre's, go by pairs in g groups where over g are in common for certain, as they are for two
    classes that don't link with c. One that links with c and has too few goes by singles; the others then add singles,
    but for those that are too far off. usual are tokens in the D of most classes of c, for which they come last. Keys: 1 are singles, 2 pairs between the two sorts of classes, 3 pairs within the sort that doesn't link with c."""
    a, m, s = len(x), len(c), similar
    here = within(x, c)
    own, lost = x[~here], c[~within(c, x)]
    d, both = len(own) + len(lost), a - len(own)
    often = within(own, frequent)
    late = within(own, usual) if usual is not None else np.zeros(len(own), bool)
    gone = within(lost, usual) if usual is not None else np.zeros(len(lost), bool)
    rare, rest = own[~often & ~late], np.concatenate((own[often & ~late], lost[~gone], own[late], lost[gone]))
    g = max(1, (100 - s) * m // 800) if (100 - s) * m >= 100 + s else 0
    far = d - (100 - s) * (a + 100 * a // s) // (100 + s)
    least = max(1, far)
    half = max(least, (d * (100 + s) + (100 - s) * (m - a)) // (2 * (100 + s)) + 1)

    def single(kind: int, common: int) -> list[np.ndarray]:
        return [mixed(np.uint64(kind), rare[: max(0, d - common + 1)])]

    def frequents(kind: int, common: int, g: int) -> list[np.ndarray]:
        spare = d - common + 1 - len(rare)
        if spare <= 0:
            return []
        return [paired(rest[: spare + g], g, kind) if g else mixed(np.uint64(kind), rest[:spare])]

    if both > 0 and 100 * both >= s * (a + m - both):
        return np.concatenate(single(1, half) + (frequents(2, half, g) if 0 < g < half else frequents(1, half, 0)))
    low = max(least, -(-(d * (100 + s) - (100 - s) * (a + m) + 2 * s) // (2 * (100 + s))))
    out = frequents(3, half, g)
    if far > (100 - s) * (m + 100 * m // s) // (100 + s):  # too far off for those that link with c
        return np.concatenate(single(1, half) + out)
    if g:
        out += frequents(2, max(low, g + 1), g)
    if not g or far * s < g * (100 + s):
        out += frequents(1, low, 0)
    return np.concatenate(single(1, min(low, half)) + out)


def class_of(raw: bytes, salt: int) -> tuple[int, bytes]:
    """A number for the words of normal() text, and their digest."""
    full = hashlib.sha256(raw).digest()[:20]
    return int.from_bytes(hashlib.blake2b(full, digest_size=8, salt=salt.to_bytes(4, "little")).digest(), "little", signed=True), full


CLASS_NAMES = ["doc_id", "id", "words", "n_shingles", "first", "sign"]
CLASS_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]


def classes(docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, id, n_shingles, first, sign): id is the number of the document's words, null where there are none; first are
    the first tokens by hash alone, some more than the prefix, sign the signature. Should two word sequences get one
    number, all are numbered anew, with another salt."""
    for salt in count():

        def one(doc_id: int, text: str, salt: int = salt) -> tuple:
            raw = normal(text)
            t = tokens(raw, shingle)
            prefix = len(t) - needed(len(t), similar) + 1
            return doc_id, *(class_of(raw, salt) if raw else (None, None)), len(t), t[: prefix + prefix // 4 + 8].view(np.int64), signature(t)

        def run(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(i, AT_ONCE)
                    out = [one(d.as_py(), t.as_py()) for d, t in zip(part.column("doc_id"), part.column("text"), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), CLASS_KINDS, strict=True)], CLASS_NAMES)

        rows = settle(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, id long, words binary, n_shingles long, first array<long>, sign binary"))
        twice = rows.where("id is not null").groupBy("id").agg(F.min("words").alias("x"), F.max("words").alias("y")).where("x <> y")
        if not twice.take(1):
            return rows
        unsettle(rows)


def _sent(rows: DataFrame) -> DataFrame:
    """rows as a settled frame, broadcast while it has SENT rows at most."""
    rows = settle(rows)
    out = F.broadcast(rows) if rows.count() <= SENT else rows
    out._settled_at = rows._settled_at
    return out


def every(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


ENTRY = "key long, id long, rank long"


def _flat(keys: list[np.ndarray], ids: list[int]) -> pd.DataFrame:
    """A row for each key."""
    flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
    return pd.DataFrame({"key": flat, "id": np.repeat(np.asarray(ids, np.int64), np.asarray([len(k) for k in keys], np.int64))})


def rank_of(first: np.ndarray, n: int, frequent: np.ndarray) -> int:
    """Order of classes as centres: by the share of frequent tokens among the first by hash, then by size."""
    return int(1000 * within(first, frequent).mean()) << 40 | n


LINK = "a long, b long, usual binary"


def _links(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"a": np.asarray([x[0] for x in out], np.int64), "b": pd.array([x[1] for x in out], "Int64"), "usual": [x[2] for x in out]})


class Verifier:
    """Links of members with their centre, and for a centre the tokens in at least half of the differences of its first chunk."""

    def __init__(self, similar: int):
        self.similar, self.out, self.found = similar, [], []
        self.c, self.first = 0, False

    def start(self, c: int, chunk: int, tokens: np.ndarray, _: np.ndarray | None) -> None:
        self.c, self.first, self.centre, self.found = c, chunk == 0, tokens, []

    def add(self, i: int, x: np.ndarray, _: int) -> None:
        if links(x, self.centre, self.similar):
            self.out.append((self.c, i, None))
        if self.first:
            self.found.append(np.setxor1d(x, self.centre, assume_unique=True))

    def end(self) -> None:
        if len(self.found) >= USUAL:
            every, times = np.unique(np.concatenate(self.found), return_counts=True)
            usual = every[2 * times >= len(self.found)]
            if len(usual):
                self.out.append((self.c, None, usual.tobytes()))
        self.found = []

    def rows(self) -> pd.DataFrame:
        out, self.out = self.out, []
        return _links(out)


class Differ:
    """Keys of the differences of members and their centre, with the members' components."""

    def __init__(self, similar: int, frequent: np.ndarray):
        self.similar, self.frequent, self.out = similar, frequent, []

    def start(self, c: int, _: int, tokens: np.ndarray, usual: np.ndarray | None) -> None:
        self.salt, self.centre, self.usual = np.asarray([c], np.int64).view(np.uint64), tokens, usual

    def add(self, i: int, x: np.ndarray, component: int) -> None:
        self.out.append((mixed(self.salt, differences(x, self.centre, self.frequent, self.similar, self.usual)), i, component))

    def end(self) -> None:
        pass

    def rows(self) -> pd.DataFrame:
        out, self.out = self.out, []
        keys = [x[0] for x in out]
        return _flat(keys, [x[1] for x in out]).assign(component=np.repeat(np.asarray([x[2] for x in out], np.int64), np.asarray([len(k) for k in keys], np.int64)))


class Join:
    """One join: the settled tables that its steps share."""

    def __init__(self, docs: DataFrame, shingle: int, similar: int):
        self.known, self.shingle, self.similar = docs, shingle, similar
        self.spark = docs.sparkSession
        self.held: list[DataFrame] = []
        self.sets: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.held.append(out := settle(df))
        return out

    def index(self) -> None:
        """rows (doc_id, id, n_shingles), signs (id, rep, n, sign) of classes, and entry (key, id, rank) of keys of several classes."""
        similar, shingle = self.similar, self.shingle
        all_rows = classes(self.known, shingle, similar)
        self.rows = self.keep(all_rows.select("doc_id", "id", "n_shingles"))
        copies = self.rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1")
        others = _sent(self.rows.join(copies.select("id", "rep"), "id").where("doc_id <> rep").select("doc_id"))
        one = all_rows.where("id is not null").join(others, "doc_id", "left_anti")
        prefix = F.expr(f"slice(first, 1, cast(n_shingles - ceil({similar} * n_shingles / 100) + 1 as int))")
        often = one.select(F.explode(prefix).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= FREQUENT)
        often = settle(often)
        steps = often.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count(F.lit(1)).alias("tokens")).collect()  # some hundred rows
        sums = {r.step: sum(x.tokens for x in steps if x.step >= r.step) for r in steps}
        least = min((step for step, n in sums.items() if n <= MOST), default=1 << 30)
        found = often.where(F.floor(F.log2("c") * 8) >= least).select("key").toArrow()["key"].to_numpy()
        unsettle(often)
        self.often = self.spark.sparkContext.broadcast(np.sort(found.astype(np.int64).view(np.uint64)))  # MOST numbers
        sent = self.often

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            frequent = sent.value
            for batch in batches:
                keys, ids, ranks, left = [], [], [], []
                for i, n, x in zip(batch["id"].tolist(), batch["n_shingles"].tolist(), batch["first"], strict=True):
                    first = np.asarray(x, np.int64).view(np.uint64)
                    k, rank = entries(first, frequent, similar, n), rank_of(first, n, frequent)
                    if k is None:
                        left.append((0, i, rank, False))
                    else:
                        keys.append(k)
                        ids.append(i)
                        ranks.append(rank)
                out = _flat(keys, ids)
                yield out.assign(rank=np.repeat(np.asarray(ranks, np.int64), [len(k) for k in keys]) if keys else 0, whole=True)
                if left:
                    yield pd.DataFrame(left, columns=["key", "id", "rank", "whole"])

        def more(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), 100):
                    part = batch.iloc[i : i + 100]
                    yield _flat([entries(np.frombuffer(t, np.uint64), sent.value, similar) for t in part["tokens"]], part["id"].tolist())

        self.signs = self.keep(one.select("id", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sign"))
        found = settle(one.select("id", "n_shingles", "first").mapInPandas(run, ENTRY + ", whole boolean"))
        unsettle(all_rows, others)
        left = settle(found.where("not whole").select("id", "rank"))
        rest = settle(self.tokenised(left.select("id")).mapInPandas(more, "key long, id long").join(_sent(left), "id"))
        index = found.where("whole").select("key", "id", "rank").unionByName(rest)
        several = settle(index.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key"))
        self.entry = settle(index.join(several, "key"))
        unsettle(found, left, rest, several)

    def tokenised(self, ids: DataFrame) -> DataFrame:
        """(id, tokens) of distinct classes: sorted sets of 64-bit numbers. Those that were asked for before are read again."""
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(i, AT_ONCE)
                    sets = [tokens(normal(t.as_py()), shingle).tobytes() for t in part.column("text")]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "tokens"])
            release()

        new = ids = self.keep(ids)
        for known in self.sets:
            new = new.join(known.select("id"), "id", "left_anti")
        new = _sent(new.join(self.signs.select("id", F.col("rep").alias("doc_id")), "id"))
        self.sets.append(self.keep(self.known.join(new, "doc_id").select("id", "text").mapInArrow(run, "id long, tokens binary")))
        unsettle(new)
        return every(self.sets).join(F.broadcast(ids) if ids.count() <= SENT else ids, "id", "left_semi")

    def beside(self, pairs: DataFrame, sets: DataFrame, visitor: Callable[[], Verifier | Differ], schema: str, usual: DataFrame | None = None) -> DataFrame:
        """What a visitor makes of the distinct settled pairs (id, c), with the component of id or without. Members of a centre come in chunks of about CHUNK,
        each with one copy of the centre's set and of its usual differences (c, usual), one after the other."""
        chunks = _sent(pairs.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")).where("chunks > 1"))
        known = F.col("component" if "component" in pairs.columns else "id").alias("component")
        dealt = settle(pairs.join(chunks, "c", "left").select("c", "id", known, F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))).alias("chunk")))
        none = F.lit(None).cast("binary").alias("usual")
        members = dealt.join(sets, "id").select("c", "chunk", F.lit(1).alias("part"), "id", "component", "tokens", none)
        centres = dealt.select("c", "chunk").distinct().join(sets.select(F.col("id").alias("c"), "tokens"), "c")
        centres = centres.withColumn("usual", none) if usual is None else centres.join(_sent(usual), "c", "left")
        centres = centres.select("c", "chunk", F.lit(0).alias("part"), F.col("c").alias("id"), F.col("c").alias("component"), "tokens", "usual")
        rows = members.unionByName(centres).repartition("c", "chunk").sortWithinPartitions("c", "chunk", "part")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            v = visitor()
            for batch in batches:
                for c, chunk, part, i, own, t, u in zip(*(batch[x].tolist() for x in ("c", "chunk", "part", "id", "component")), batch["tokens"], batch["usual"], strict=True):
                    if part == 0:
                        v.end()
                        v.start(c, chunk, np.frombuffer(t, np.uint64), None if u is None else np.frombuffer(u, np.uint64))
                    else:
                        v.add(i, np.frombuffer(t, np.uint64), own)
                        if len(v.out) >= 200:
                            yield v.rows()
                if v.out:
                    yield v.rows()
            v.end()
            yield v.rows()
            release()

        out = settle(rows.mapInPandas(run, schema))
        unsettle(chunks, dealt)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, usual): the distinct pairs (id, c) that link, and for centres the usual differences. Pairs whose signatures
        rule a link out go first; whole sets are read for what is left only."""
        similar = self.similar
        of = lambda c: self.signs.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sign").alias(f"s{c}"))

        def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ok = [may_link(*x, similar) for x in zip(batch["sid"], batch["sc"], batch["nid"].tolist(), batch["nc"].tolist(), strict=True)]
                yield batch.loc[ok, ["id", "c"]]

        near = pairs.join(of("id"), "id").join(of("c"), "c").where(fits("nid", "nc", similar)).select("id", "c", "sid", "sc", "nid", "nc")
        left = settle(near.mapInPandas(sift, "id long, c long"))
        sets = self.tokenised(left.select("id").union(left.select("c")).distinct())
        out = self.keep(self.beside(left, sets, lambda: Verifier(similar), LINK))
        unsettle(left)
        return out

    def differing(self, pairs: DataFrame, usual: DataFrame) -> DataFrame:
        """(key, id, component) of the differences of classes and centres, settled. Pairs (id, c, component) bring the components:
        there are many keys to a pair, which needn't be joined to labels then."""
        similar, sent = self.similar, self.often
        sets = self.tokenised(pairs.select("id").union(pairs.select("c")).distinct())
        return self.beside(pairs, sets, lambda: Differ(similar, sent.value), "key long, id long, component long", usual)

    def near(self, entry: DataFrame, forest: bool) -> DataFrame:
        """Pairs (id, c) across components in entries of LEAF classes at most whose signatures allow a link, with their entry's key.
        A row without id and c: the forest left out pairs of that entry."""
        similar = self.similar
        rows = entry.where(F.col("m") <= LEAF).select("key", "id", "component").join(self.signs.select("id", "n", "sign"), "id")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[tuple] = []

            def found() -> list[tuple]:
                keys, ids, parts, sizes, signs = map(list, zip(*held, strict=True))
                pairs, whole = near_some(ids, parts, sizes, signs, similar, forest)
                return [(keys[0], *x) for x in pairs] + [(keys[0], None, None)] * (not whole)

            def frame(out: list[tuple]) -> pd.DataFrame:
                return pd.DataFrame({c: pd.array([x[k] for x in out], "Int64") for k, c in enumerate(("key", "id", "c"))})

            for batch in batches:
                out = []
                for x in zip(batch["key"].tolist(), batch["id"].tolist(), batch["component"].tolist(), batch["n"].tolist(), batch["sign"], strict=True):
                    if held and held[0][0] != x[0]:
                        out += found()
                        held = []
                    held.append(x)
                yield frame(out)
            if held:
                yield frame(found())
            release()

        return rows.repartition("key").sortWithinPartitions("key").select("key", "id", "component", "n", "sign").mapInPandas(run, "key long, id long, c long")

    def labels(self, label: DataFrame, found: DataFrame) -> DataFrame:
        """label (id, component) with the links that were found as well: by one task while they are SENT at most, else by rounds of joins."""
        links = found.where("b is not null").select("a", "b")
        n = links.count()
        if not n:
            return label
        edges = links.unionByName(label.select(F.col("id").alias("a"), F.col("component").alias("b")))
        if n + label.count() > SENT:
            return self.keep(components(edges))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            root: dict[int, int] = {}
            for batch in batches:
                for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                    x, y = find(root, a), find(root, b)
                    root[max(x, y)] = min(x, y)
            yield pd.DataFrame({"id": list(root), "component": [find(root, c) for c in list(root)]}).astype("int64")

        return self.keep(edges.coalesce(1).mapInPandas(run, "id long, component long"))

    def component(self, rows: DataFrame, label: DataFrame) -> DataFrame:
        """rows with the component of their id, the id itself where it links with nothing."""
        known = F.broadcast(label) if label.count() <= SENT else label
        return rows.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def parted(self, entry: DataFrame, label: DataFrame) -> DataFrame:
        """Entries (key, id, ...) with component and m that hold several components, one for each set of classes; m counts them."""
        now = settle(self.component(entry, label))
        out = self.several(now)
        unsettle(now)
        return out

    def several(self, now: DataFrame) -> DataFrame:
        """parted() of settled entries whose classes have their components."""
        of = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("t"))
        kept = settle(of.where("x <> y").groupBy("m", "s", "t").agg(F.min("key").alias("key")).select("key", "m"))
        out = settle(now.join(kept, "key"))
        unsettle(kept)
        return out

    def centres(self, entry: DataFrame) -> DataFrame:
        """(key, c) of entries and their centres, settled. Large entries of one family share a centre: of the centres of a
        class's large entries the first in rank stands for the class, and a large entry takes the one that stands for most of its
        classes. It is before all of the entry's classes in rank, or one of them, so centres still fall from round to round."""
        best = entry.groupBy("key").agg(F.max(F.struct("rank", "id")).alias("best"))
        large = entry.where((F.col("m") > LEAF) & (F.col("m") > 2))  # a pair is verified by its own centre
        if not large.take(1):
            return settle(best.select("key", F.col("best.id").alias("c")))
        own = settle(best)
        keys = _sent(large.select("key").distinct().join(own, "key"))
        first = _sent(large.select("key", "id").join(keys, "key").groupBy("id").agg(F.max("best").alias("best")))
        votes = large.select("key", "id").join(first, "id").groupBy("key", "best").agg(F.count(F.lit(1)).alias("n"))
        most = _sent(votes.groupBy("key").agg(F.max(F.struct("n", "best")).alias("most")).select("key", F.col("most.best.id").alias("shared")))
        out = settle(own.join(most, "key", "left").select("key", F.coalesce("shared", "best.id").alias("c")))
        unsettle(own, keys, first, most)
        return out

    def stars(self, entry: DataFrame, centres: DataFrame, *more: str) -> DataFrame:
        """Distinct (id, c) of the classes of entries and their centres, and more columns of the classes."""
        return settle(entry.join(centres, "key").where("id <> c").select("id", "c", *more).distinct())

    def linked(self) -> DataFrame:
        """(id, component) of classes that link with another."""
        label = self.spark.range(0).select("id", F.col("id").alias("component"))
        entry = self.parted(self.entry, label)
        unsettle(self.entry)
        while entry.take(1):
            centres = self.centres(entry)
            star = self.stars(entry, centres)
            found = self.verified(star)
            label = self.labels(label, found)
            now = self.parted(entry.where("m > 2").drop("component", "m"), label)  # the pair of two classes is verified
            unsettle(star, entry)
            large, entry = now.where(F.col("m") > LEAF), None
            if large.take(1):
                pairs = self.stars(large, centres, "component")
                fresh = self.differing(pairs, found.where("usual is not null").select(F.col("a").alias("c"), "usual"))
                more = self.several(fresh)
                both = settle(now.drop("rank").unionByName(more).where(F.col("m") <= LEAF))
                left = settle(more.where(F.col("m") > LEAF).join(_sent(large.select("id", "rank").distinct()), "id"))
                unsettle(pairs, fresh, now, more)
                now, entry = both, left if left.take(1) else None
            unsettle(centres)
            # as many pairs as would join all; where some of those don't link, all of the entries that have more
            close = settle(self.near(now, True))
            pairs = settle(close.where("c is not null").select("id", "c").distinct())
            label = self.labels(label, self.verified(pairs))
            again = _sent(close.where("c is null").select("key"))
            unsettle(pairs, close)
            if again.take(1):
                rest = self.parted(now.join(again, "key", "left_semi").drop("component", "m"), label)
                pairs = settle(self.near(rest, False).select("id", "c").distinct())
                label = self.labels(label, self.verified(pairs))
                unsettle(pairs, rest)
            unsettle(now, again)
            if entry is None:
                break
            entry = self.parted(entry.drop("component", "m"), label)
        return label


def fits(x: str, y: str, similar: int) -> Column:
    return 100 * F.least(x, y) >= similar * F.greatest(x, y)


def join(docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """One row for each id, by shingles of that many words and that similarity in hundredths, over 50: doc_id, n_shingles, rep (the
    least id of the same words) and component_id."""
    if not 50 < similar <= 100 or shingle < 1:
        raise ValueError("similarity is over 50 and at most 100, a shingle has a word at least")
    j = Join(one_per_id(docs), shingle, similar)
    j.index()
    label = j.linked()
    # numbers of classes to ids of documents: the least of a component
    named = j.component(j.signs.select("id", "rep"), label)
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = settle(named.join(least, "component").select("id", "rep", "component_id"))
    out = settle(j.rows.join(final, "id", "left").select("doc_id", "n_shingles", "rep", F.coalesce("component_id", "doc_id").alias("component_id")))
    unsettle(final, *j.held)
    return out


def digest(docs: DataFrame) -> DataFrame:
    """One row for each id: doc_id, n_shingles, component_id."""
    return join(docs).select("doc_id", "n_shingles", "component_id")


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """docs, columns as they were, with one document of each component: that of the least id. Rows without an id stay; of
    rows that share an id one stays, with the greatest text."""
    name = next(x for k in count() if (x := f"__kept{k}") not in {c.lower() for c in docs.columns})
    kept = join(docs, shingle, similar).where("doc_id = component_id").select(F.col("doc_id").alias(name))
    lost = docs.where(F.col("doc_id").isNull())
    known = docs.where(F.col("doc_id").isNotNull())
    if known.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1).take(1):
        order = Window.partitionBy("doc_id").orderBy(F.coalesce(F.col("text").cast("string"), F.lit("")).desc())
        known = known.withColumn(name, F.row_number().over(order)).where(F.col(name) == 1).drop(name)
    return known.join(kept, F.col("doc_id").cast("long") == F.col(name), "left_semi").unionByName(lost)

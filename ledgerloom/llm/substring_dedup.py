"""Substring dedup by prefix-partitioned suffix trees over words.

A window is WINDOW consecutive words. Suffixes that may hold a repeated window are found by their anchors (windows.py) and
dealt by their prefixes, the anchors' grams, longer for hot ones, into groups that fit in memory. Each group becomes a
suffix tree: its suffixes sorted, common prefixes of neighbours measured, internal nodes taken from them. Windows whose
anchor stands o words after their start are equal where suffixes meet in a node of WINDOW - o words or deeper and the o
words before the anchors are equal. Of equal windows the first by (doc_id, start) stays; the words of the others go.
Words are compared, not hashes.

Null texts have no words. Rows without an id are left out; of rows that share an id the greatest text counts once. An
empty table gives an empty result. Extra columns don't matter; results have columns of their own only.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_per_id
from .windows import BUCKET, HELD, Units, each_stretch, read_words, spans_by_doc, survivors, union, with_anchors

WINDOW, GRAM = 20, 7
WORDS = Units(read_words, GRAM, WINDOW)


class SuffixTree:
    """Of sequences of words: leaves in order, and for each depth the nodes that reach it."""

    def __init__(self, suffixes: list[tuple[bytes, ...]]):
        self.leaves = sorted(range(len(suffixes)), key=suffixes.__getitem__)
        self.common = [0]
        for a, b in zip(self.leaves, self.leaves[1:], strict=False):
            n = 0
            for x, y in zip(suffixes[a], suffixes[b], strict=False):
                if x != y:
                    break
                n += 1
            self.common.append(n)
        self.nodes = self._internal()

    def _internal(self) -> list[tuple[int, int, int]]:
        """Internal nodes as (depth, first leaf, last leaf), children before parents."""
        out, stack = [], []
        for i in range(1, len(self.common) + 1):
            depth, left = self.common[i] if i < len(self.common) else -1, i - 1
            while stack and stack[-1][0] > depth:
                d, left = stack.pop()
                out.append((d, left, i - 1))
            if depth >= 0 and (not stack or stack[-1][0] < depth):
                stack.append((depth, left))
        return out

    def at_depth(self, least: int) -> list[list[int]]:
        """Leaves below each uppermost internal node of least depth or more."""
        tops, end = [], len(self.leaves)
        for d, a, b in reversed(self.nodes):  # parents before children, from the right
            if d >= least and b < end:
                tops.append(self.leaves[a : b + 1])
                end = a
        return tops


def repeats(group: list[tuple[int, int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """Of stretches (doc_id, first, before, last, body) of one prefix: runs of windows (doc_id, start, last start) that also
    start earlier."""
    same: dict[tuple[int, int, bytes], list[tuple[int, int]]] = defaultdict(list)
    for doc_id, first, before, last, body in group:
        same[before, last - first, body].append((doc_id, first))
    kinds = list(same)
    members = [sorted(same[k]) for k in kinds]
    later = [set() for _ in kinds]  # windows of a kind's first member that start earlier elsewhere
    if len(kinds) > 1:
        words = [tuple(k[2].split(b" ")[:-1]) for k in kinds]
        tree = SuffixTree([w[k[0] :] for w, k in zip(words, kinds, strict=True)])
        low, high = min(k[0] - k[1] for k in kinds), max(k[0] for k in kinds)
        for o in range(low, high + 1):
            for node in tree.at_depth(WINDOW - o):
                equal = defaultdict(list)
                for i in node:
                    before, more, _ = kinds[i]
                    if before - more <= o <= before:
                        equal[words[i][before - o : before]].append(i)
                for found in equal.values():
                    if len(found) > 1:
                        start = lambda i: (members[i][0][0], members[i][0][1] + kinds[i][0] - o)  # noqa: B023, E731
                        first = min(found, key=start)
                        for i in found:
                            if i != first:
                                later[i].add(kinds[i][0] - o)
    for (_, more, _), rows, gone in zip(kinds, members, later, strict=True):
        for doc_id, first in rows[1:]:
            yield doc_id, first, first + more
        doc_id, first = rows[0]
        for k in sorted(gone):
            if k - 1 not in gone:
                end = k
                while end + 1 in gone:
                    end += 1
                yield doc_id, first + k, first + end


STRETCH = "bucket int, key long, doc_id long, first long, before int, last long, body binary"


def _cut(docs: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """Stretches as rows of STRETCH. Of equal ones a task sends the first; the others are known to repeat it, so they go to
    buckets of their documents, without a body, and a hot group sends no more rows than there are tasks."""

    def rows(kinds: dict, later: list) -> pd.DataFrame:
        out = [(d % buckets, 0, d, first, 0, last, None) for d, first, last in later]
        out += [(key % buckets, key, d, first, before, first + more, body) for (key, before, more, body), (d, first) in kinds.items()]
        kinds.clear()
        later.clear()
        return pd.DataFrame(out, columns=[x.split()[0] for x in STRETCH.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds: dict[tuple, tuple[int, int]] = {}
        later: list[tuple[int, int, int]] = []
        size = 0
        for batch in batches:
            for part in each_stretch(batch, WORDS):
                for s in part:
                    kind, me = (s.key, s.before, s.last - s.first, s.body), (s.doc_id, s.first)
                    best = kinds.get(kind)
                    if best is None:
                        kinds[kind] = me
                        size += len(s.body) + 200
                        continue
                    kinds[kind], (doc_id, first) = (best, me) if best < me else (me, best)
                    later.append((doc_id, first, first + s.last - s.first))
                    size += 100
                if size > HELD:
                    yield rows(kinds, later)
                    size = 0
        if kinds:
            yield rows(kinds, later)

    return with_anchors(docs, found).mapInPandas(run, STRETCH)


def _marks(found: DataFrame) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        groups, out = defaultdict(list), []
        for key, doc_id, first, before, last, body in zip(*(rows[c].tolist() for c in ("key", "doc_id", "first", "before", "last", "body")), strict=True):
            if body is None:
                out.append((doc_id, first, last + WINDOW))
            else:
                groups[key].append((doc_id, first, before, last, body))
        out += [(d, a, b + WINDOW) for g in groups.values() if len(g) > 1 for d, a, b in repeats(g)]
        return pd.DataFrame(out, columns=["doc_id", "start", "end"])

    return found.groupBy("bucket").applyInPandas(run, "doc_id long, start long, end long")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans of words to remove, which may overlap, of documents that have any. docs as of one_per_id()."""
    found = survivors(docs, WORDS)
    return spans_by_doc(_marks(_cut(docs, found, max(1, -(-found.count() // BUCKET)))))


def remove(docs: DataFrame) -> DataFrame:
    """One row for each id: doc_id, n_words, n_removed, text (the words that are kept, joined by a space)."""
    known = one_per_id(docs)
    rows = known.join(spans(known), "doc_id", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch["doc_id"].tolist(), batch["text"], batch["spans"], strict=True):
                ws = text.encode("utf-8", "surrogatepass").split()
                n, removed = len(ws), 0
                for a, b in reversed(union(found, n) if found is not None else []):
                    del ws[a:b]
                    removed += b - a
                out.append((doc_id, n, removed, b" ".join(ws).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "text"])

    return rows.mapInPandas(run, "doc_id long, n_words long, n_removed long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """One row for each id: doc_id, n_words, n_removed, kept_sha256."""
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def digest_of(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()

"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton. The words of a document stream through it; at each
word the state gives the longest suffix that occurs in an item. Where that is at least MIN_WORDS long, those words are
hit; items of fewer words are hit whole. A document whose hits reach MIN_COVER of its words is contaminated.

Items are taken in blocks of about BLOCK_WORDS words; their texts are sent to the executors once, so the whole benchmark must fit a
disk there, and the driver holds one block at a time. Documents are read once, without a shuffle: a worker streams them through
one automaton after the other. It keeps up to HELD automata; where there are more, it gathers documents of about
GATHERED characters and builds each automaton anew for them, so memory is bounded by the constants and the longest text. Null and empty texts have no words
and no hits; rows without an id and repeated rows are judged like any other; empty tables of documents or items give an
empty result or no hits. Items without an id or text are left out. Other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside

MIN_WORDS = 13
#: Hits of at least one in so many words contaminate.
ONE_IN = 20
BLOCK_WORDS = 50_000
#: Automata that a worker keeps, some 25 MB each, and characters that it gathers where there are more blocks.
HELD = 4
GATHERED = 32_000_000
#: Documents that are matched and sent on together.
AT_ONCE = 500

#: Lower-cases A-Z; every other ASCII character that is no digit or letter becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the windows of length least, or whole shorter items, marked."""

    def __init__(self, items: list[tuple[str, list[bytes]]], least: int = MIN_WORDS):
        self.least, self.items = least, [name for name, _ in items]
        self.vocab: dict[bytes, int] = {}
        seqs = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        self.size = max(1, len(self.vocab))
        self.link, self.len = [-1], [0]
        out: list[dict[int, int]] = [{}]
        for seq in seqs:
            last = 0
            for t in seq:
                last = self._extend(out, last, t)
        self.next = {s * self.size + t: q for s, edges in enumerate(out) for t, q in edges.items()}
        # the state that holds the suffix of the wanted length of each state's strings
        by_length = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        self.window = [-1] * len(self.len)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.len)
        self.within: dict[int, set[int]] = {}
        for s in by_length:
            up = self.link[s]
            self.window[s] = s if self.len[s] >= least > self.len[up] else self.window[up]
        ends: dict[int, list[tuple[int, int]]] = {}
        for i, seq in enumerate(seqs):
            s = 0
            for n, t in enumerate(seq, 1):
                s = self.next[s * self.size + t]
                if n >= least:
                    self.within.setdefault(self.window[s], set()).add(i)
            if 0 < len(seq) < least:
                while self.len[self.link[s]] >= len(seq):
                    s = self.link[s]
                ends.setdefault(s, []).append((len(seq), i))
        for s in by_length:
            self.short[s] = (*self.short[self.link[s]], *ends.get(s, ()))
        self.fewest = min([least, *(len(seq) for seq in seqs if seq)])

    def _extend(self, out: list[dict[int, int]], last: int, t: int) -> int:
        """Adds t after the string of state last; gives the state of the longer string. It may be there already."""
        if t in out[last]:
            q = out[last][t]
            return q if self.len[q] == self.len[last] + 1 else self._clone(out, last, t, q)
        new = self._state(out, {}, self.len[last] + 1)
        p = last
        while p >= 0 and t not in out[p]:
            out[p][t] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = out[p][t]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(out, p, t, q)
        return new

    def _state(self, out: list[dict[int, int]], edges: dict[int, int], length: int) -> int:
        out.append(edges)
        self.len.append(length)
        self.link.append(0)
        return len(out) - 1

    def _clone(self, out: list[dict[int, int]], p: int, t: int, q: int) -> int:
        new = self._state(out, dict(out[q]), self.len[p] + 1)
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and out[p].get(t) == q:
            out[p][t] = new
            p = self.link[p]
        return new

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit spans of word positions (ends exclusive, merged), the numbers of items with occurring windows, and the
        longest match. Only stretches of known words that are long enough are streamed."""
        get, n = self.vocab.get, len(ws)
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, n)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        longest = 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.fewest:
                continue
            s = n_match = 0
            for i, t in enumerate(ids[a:b].tolist(), a + 1):
                while s and (q := self.next.get(s * self.size + t)) is None:
                    s = self.link[s]
                    n_match = self.len[s]
                if not s:
                    q, n_match = self.next.get(t), 0
                s, n_match = (q, n_match + 1) if q is not None else (0, 0)
                longest = max(longest, n_match)
                hit = 0
                if n_match >= self.least:
                    hit = self.least
                    found |= self.within[self.window[s]]
                for m, item in self.short[s]:
                    if m <= n_match:
                        hit = max(hit, m)
                        found.add(item)
                if hit:
                    start = i - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found, longest


SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))
ADDED = (T.StructField("n_words", T.LongType()), T.StructField("hits", SPANS), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()))


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of BLOCK_WORDS words, or a single longer one; none has at least one, empty block."""
    known = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    held: list[tuple[str, str]] = []
    size = blocks = 0
    for r in known.toLocalIterator():
        n = len(words(r.text))
        if held and size + n > BLOCK_WORDS:
            yield held
            held, size, blocks = [], 0, blocks + 1
        held.append((r.item_id, r.text))
        size += n
    if held or not blocks:
        yield held


class Matcher:
    """The automata of broadcast blocks."""

    def __init__(self, blocks: list, least: int):
        self.blocks, self.least = blocks, least
        self.kept: dict[int, Automaton] = {}

    def automata(self) -> Iterator[Automaton]:
        for k, b in enumerate(self.blocks):
            a = self.kept.get(k)
            if a is None:
                items = b.value
                a = Automaton([(name, words(text)) for name, text in items], self.least)
                if len(self.blocks) <= HELD:
                    self.kept[k] = a
                else:
                    b._value = None  # read again from the executor's disk for the next documents
                    del b._value
            yield a

    def match(self, texts: list[str | None]) -> list[tuple[int, list, list[str], int]]:
        """(n_words, hits, items, longest) of each text."""
        lists = [words(t) for t in texts]
        spans: list[list] = [[] for _ in lists]
        names: list[set] = [set() for _ in lists]
        longest = [0] * len(lists)
        for a in self.automata():
            for k, ws in enumerate(lists):
                hits, found, far = a.match(ws)
                if hits:
                    spans[k] = merged([*spans[k], *hits]) if spans[k] else hits
                    names[k].update(a.items[i] for i in found)
                longest[k] = max(longest[k], far if far >= self.least else 0)
        return [(len(ws), [list(x) for x in spans[k]], sorted(names[k]), longest[k]) for k, ws in enumerate(lists)]


def match(docs: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs with n_words, hits (merged [start, end) pairs of words), items (ids with occurring windows, sorted as strings)
    and longest (words of the longest match, 0 below least words); columns of these names are replaced."""
    spark = docs.sparkSession
    rest = docs.drop(*(f.name for f in ADDED))
    blocks = [spark.sparkContext.broadcast(x) for x in _blocks(items)]
    kinds = [pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(blocks, least)
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            found = m.match([t for b in held for t in b.column("text").to_pylist()])
            for b in held:
                mine, found = found[: b.num_rows], found[b.num_rows :]
                more = [pa.array([x[i] for x in mine], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *(f.name for f in ADDED)])

        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                held.append(batch.slice(i, AT_ONCE))
                size += held[-1].nbytes
                if len(blocks) <= HELD or size >= GATHERED:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return rest.withColumn("text", F.col("text").cast("string")).mapInArrow(run, T.StructType([*(f if f.name != "text" else T.StructField("text", T.StringType()) for f in rest.schema.fields), *ADDED]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((int(a), int(b)))
    return out


def judge(docs: DataFrame, items: DataFrame, least: int = MIN_WORDS, one_in: int = ONE_IN) -> DataFrame:
    """match() with n_hit and contaminated."""
    out = match(docs, items, least).withColumn("n_hit", F.expr("aggregate(hits, 0L, (n, x) -> n + x[1] - x[0])"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


ADDED_NAMES = ("n_words", "hits", "items", "longest", "n_hit", "contaminated")


def clean(docs: DataFrame, items: DataFrame, least: int = MIN_WORDS, one_in: int = ONE_IN) -> DataFrame:
    """docs without the contaminated ones, columns as they were."""
    rest, back = aside(docs, *ADDED_NAMES)
    return judge(rest, items, least, one_in).where(~F.col("contaminated")).select(*rest.columns).withColumnsRenamed(back)


def strip_spans(docs: DataFrame, items: DataFrame, least: int = MIN_WORDS, one_in: int | None = None) -> DataFrame:
    """docs whose texts lose the characters from the first to the last word of every hit span of least words or more (or a
    whole shorter item). With one_in only texts that reach that cover lose spans."""
    import regex

    word = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    rest, back = aside(docs, *ADDED_NAMES)
    hit, names = match(rest, items, least), rest.columns
    if one_in is not None:
        total = F.expr("aggregate(hits, 0L, (n, x) -> n + x[1] - x[0])")
        hit = hit.withColumn("hits", F.when(one_in * total >= F.col("n_words"), F.col("hits")).otherwise(F.array().cast("array<array<int>>")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["hits"], strict=True):
                if isinstance(text, str) and len(spans):
                    at = [m.span() for m in word.finditer(text)]
                    for a, b in reversed([tuple(x) for x in spans]):
                        text = text[: at[a][0]] + text[at[b - 1][1] :]
                out.append(text)
            yield batch.assign(text=out)[names]

    return hit.select(*rest.columns, "hits").mapInPandas(run, rest.schema).withColumnsRenamed(back)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    out = judge(docs.select("doc_id", "text"), items)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest")


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()

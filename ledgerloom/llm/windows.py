"""Repeated windows of fixed length over the units of texts: words or bytes.

The least hash (a minimizer) of the GRAM-unit grams in a window is its anchor. Equal windows have equal anchors at equal
places, so a window can repeat only if its anchor's gram does. One pass lists the anchors, a fraction of the positions;
those of grams that occur twice or more survive. A second pass, over documents with survivors alone, cuts the stretch
around each surviving anchor that holds all the windows of that anchor: the suffix that starts at the anchor, and what
stands before it. Stretches with the same gram meet, and an operator's own structure finds the equal windows there.

A gram of more than HOT anchors is a hot prefix: its stretches are split by longer prefixes. Their windows are dealt to
classes by where the anchor stands in them, and the units that all windows of a class share become part of the key; over
HOT * CLASSES anchors each place is a class of its own, so that only equal windows meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, unsettle

#: Units that are hashed together at most; longer documents are read in overlapping parts.
PART = 400_000
#: Anchors of one gram beyond which it is a hot prefix, and classes of its windows.
HOT, CLASSES = 2_000, 8
#: Stretches in a bucket, about, and bytes of them that a task holds before it sends them.
BUCKET = 20_000
HELD = 48_000_000

_rng = np.random.default_rng(97)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


class Units(NamedTuple):
    """What a kind of units is: kind(text) gives bytes and where each unit starts, with the end last."""

    read: Callable[[str], tuple[bytes, np.ndarray]]
    gram: int
    window: int


def read_bytes(text: str) -> tuple[bytes, np.ndarray]:
    raw = text.encode("utf-8", "surrogatepass")
    return raw, np.arange(len(raw) + 1)


def read_words(text: str) -> tuple[bytes, np.ndarray]:
    """Words with one space after each."""
    ws = text.encode("utf-8", "surrogatepass").split()
    starts = np.zeros(len(ws) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1, out=starts[1:])
    return b"".join([b" ".join(ws), b" "]) if ws else b"", starts


class Runs(NamedTuple):
    """Consecutive windows of one document that share an anchor; all counted in units."""

    doc: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)


def _part_runs(parts: list[tuple[int, int, bytes, np.ndarray]], units: Units) -> Runs:
    """parts: number of the document, its units before the part, the part's bytes and starts of units."""
    k, wide = units.gram, units.window - units.gram + 1
    raw = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    n_units = np.asarray([len(p[3]) - 1 for p in parts])
    first_unit = np.concatenate(([0], np.cumsum(n_units)))
    first_byte = np.concatenate(([0], np.cumsum([len(p[2]) for p in parts])))
    starts = np.concatenate([*(p[3][:-1] + b for p, b in zip(parts, first_byte, strict=False)), [len(raw)]]).astype(np.int64)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    n = len(starts) - 1
    if n < units.window:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, none)
    grams = _mixed((sums[starts[k:]] - sums[starts[:-k]]) * down[starts[: n - k + 1]])
    bits = np.uint64(max(1, int(n).bit_length()))
    low = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    room = np.repeat(first_unit[1:], n_units)[: len(at)] - np.arange(len(at)) >= units.window
    where = np.flatnonzero(room)
    if not len(where):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, none)
    got = at[where]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(got) != 0) | (np.diff(where) != 1))))
    anchor, first = got[new], where[new]
    last = where[np.concatenate((new[1:] - 1, [len(where) - 1]))]
    part = np.searchsorted(first_unit, first, "right") - 1
    doc, before = np.asarray([p[0] for p in parts])[part], np.asarray([p[1] for p in parts])[part] - first_unit[part]
    return Runs(doc, anchor + before, first + before, last + before, grams[anchor].view(np.int64))


def runs(docs: list[tuple[bytes, np.ndarray]], units: Units) -> Runs:
    """The runs of several documents, in order."""
    found, parts, size = [], [], 0
    for i, (raw, starts) in enumerate(docs):
        n = len(starts) - 1
        for a in range(0, max(1, n - units.window + 1), PART):
            b = min(n, a + PART + units.window - 1)
            if b - a < units.window:
                continue
            if parts and size + b - a > PART:
                found.append(_part_runs(parts, units))
                parts, size = [], 0
            parts.append((i, a, raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a]))
            size += b - a
    if parts:
        found.append(_part_runs(parts, units))
    none = np.zeros(0, np.int64)
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else Runs(none, none, none, none, none)


def groups_of(texts: Iterable[str], units: Units) -> Iterator[tuple[int, list[tuple[bytes, np.ndarray]]]]:
    """Consecutive texts as units, about PART units at a time, with the number of the first."""
    held: list[tuple[bytes, np.ndarray]] = []
    size = first = 0
    for t in texts:
        held.append(units.read(t))
        size += len(held[-1][1])
        if size > PART:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def survivors(docs: DataFrame, units: Units) -> DataFrame:
    """(doc_id, anchors): the anchors, (position, gram, classes), whose grams occur twice or more, for documents with any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for first, group in groups_of(batch["text"], units):
                r = runs(group, units)
                yield pd.DataFrame({"gram": r.gram, "doc_id": ids[first + r.doc], "at": r.anchor})

    anchors = settle(docs.mapInPandas(run, "gram long, doc_id long, at long"))
    classes = F.when(F.col("n") > HOT * CLASSES, F.lit(units.window)).when(F.col("n") > HOT, F.lit(CLASSES)).otherwise(F.lit(1))
    # written first: adaptive execution splits the partitions of hot grams only between plain shuffles
    again = settle(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", classes.alias("classes")))
    out = settle(anchors.join(again, "gram").select("doc_id", "at", "gram", "classes"))
    unsettle(anchors, again)
    return out


class Stretch(NamedTuple):
    """The windows first to last of a document around one anchor: body holds their units, before of them stand in front
    of the anchor. key is the prefix by which stretches meet."""

    key: int
    doc_id: int
    first: int
    before: int
    last: int
    body: bytes


def stretches(doc_id: int, raw: bytes, starts: np.ndarray, anchors: Iterable, r: Runs, rows: np.ndarray, units: Units) -> Iterator[Stretch]:
    """Those of one document: rows are its runs in r."""
    classes = {}
    for x in anchors:
        classes[x["at"]] = x["classes"]
    for at, first, last, gram in zip(r.anchor[rows].tolist(), r.first[rows].tolist(), r.last[rows].tolist(), r.gram[rows].tolist(), strict=True):
        n = classes.get(at)
        if n is None:
            continue
        step = -(-(units.window - units.gram + 1) // n)
        if n == 1:
            yield Stretch(gram, doc_id, first, at - first, last, raw[starts[first] : starts[last + units.window]])
            continue
        a = first
        while a <= last:  # windows whose anchor stands at like places, in whole classes
            low = (at - a) // step * step
            b = min(last, at - low)
            top = low + step - 1  # the units that all windows of the class share: low before the anchor, the rest after
            core = raw[starts[at - low] : starts[at + units.window - min(top, units.window - units.gram)]]
            key = hash_bytes(core, low * units.window + n) ^ gram
            yield Stretch(key, doc_id, a, at - a, b, raw[starts[a] : starts[b + units.window]])
            a = b + 1


def hash_bytes(raw: bytes, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(raw, seed) - (1 << 63)


def each_stretch(batch: pd.DataFrame, units: Units) -> Iterator[list[Stretch]]:
    """Stretches of a batch (doc_id, text, anchors), about PART units at a time."""
    ids, anchors = batch["doc_id"].tolist(), batch["anchors"].tolist()
    for first, group in groups_of(batch["text"], units):
        r = runs(group, units)
        edges = np.searchsorted(r.doc, np.arange(len(group) + 1))
        yield [s for i, (raw, starts) in enumerate(group) for s in stretches(ids[first + i], raw, starts, anchors[first + i], r, np.arange(edges[i], edges[i + 1]), units)]


def with_anchors(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, anchors) of the documents that have surviving anchors."""
    by_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "gram", "classes")).alias("anchors"))
    return docs.join(by_doc, "doc_id").select("doc_id", "text", "anchors")


def spans_by_doc(marks: DataFrame) -> DataFrame:
    """(doc_id, spans) of rows (doc_id, start, end)."""
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def union(spans: Iterable, n: int) -> list[tuple[int, int]]:
    """Maximal runs of units that spans (with ends exclusive) cover."""
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], min(b, n))
        else:
            out.append([a, min(b, n)])
    return [(a, b) for a, b in out]

"""Suffix-array dedup: a distributed merge sort of suffixes that knows common prefixes.

A window is WINDOW bytes of a text as UTF-8. Suffixes that may hold a repeated window start at the anchors that
windows.py finds. Each map task sorts its suffixes of a bucket into a run and front-codes it: of each suffix only what its
predecessor in the run doesn't share is sent, with the length that it does. A bucket's runs are merged by a loser tree.
Its players keep the length of the prefix that they share with the last winner; the longer one wins without a look at the
bytes, and only where lengths are equal are bytes compared, from that length on. The merged order, a part of the suffix
array, thus comes with its common-prefix array. Where neighbours share WINDOW - o bytes or more, windows whose anchor
stands o bytes after their start are equal if the o bytes before the anchors are too. Every byte of a window that starts
twice or more goes, the first occurrence as well. Bytes are compared, not hashes.

Null and empty texts have no bytes. Rows without an id are left out; of rows that share an id the greatest text counts
once. Kept bytes of a cut character are kept as they are. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import one_per_id
from .windows import BUCKET, HELD, Units, each_stretch, read_bytes, spans_by_doc, survivors, union, with_anchors

WINDOW, GRAM = 200, 64
BYTES = Units(read_bytes, GRAM, WINDOW)
#: Kinds of suffixes of a key that are compared pair by pair; more are grouped by the bytes before the anchor.
PAIRS = 48

#: Of a suffix in a run: key, document, start of its first window, bytes before the anchor, last window's start less the
#: first's, bytes shared with the suffix before, bytes sent of the suffix.
HEAD = struct.Struct("<qqqHHHH")


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, which share at bytes for sure."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    low, high = at, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Suffix:
    """A suffix with its windows: key orders prefixes, text is the suffix, front what stands before the anchor."""

    __slots__ = ("key", "doc_id", "first", "more", "front", "text")

    def __init__(self, key: int, doc_id: int, first: int, more: int, front: bytes, text: bytes):
        self.key, self.doc_id, self.first, self.more, self.front, self.text = key, doc_id, first, more, front, text


def encode(run: list[Suffix]) -> bytes:
    """The run in order, front-coded; the fronts follow their suffixes whole."""
    run = sorted(run, key=lambda s: (s.key, s.text))
    out, last_key, last = [], None, b""
    for s in run:
        n = shared(last, s.text) if s.key == last_key else 0
        rest = s.text[n:]
        out += (HEAD.pack(s.key, s.doc_id, s.first, len(s.front), s.more, n, len(rest)), rest, s.front)
        last_key, last = s.key, s.text
    return b"".join(out)


def decode(raw: bytes) -> Iterator[tuple[Suffix, int]]:
    """The suffixes of a run, each with what it shares with the one before (0 where the key is new)."""
    at, text = 0, b""
    while at < len(raw):
        key, doc_id, first, before, more, n, sent = HEAD.unpack_from(raw, at)
        at += HEAD.size
        text = text[:n] + raw[at : at + sent]
        at += sent
        yield Suffix(key, doc_id, first, more, raw[at : at + before], text), n
        at += before


class LoserTree:
    """Merges runs of (suffix, shared with the one before in its run) into one order with the same second part."""

    def __init__(self, players: list[Iterator[tuple[Suffix, int]]]):
        self.players = players
        self.heads: list[Suffix | None] = []
        for p in players:
            self.heads.append(next(p, (None, 0))[0])
        self.common = [0] * len(players)  # with the last winner, where the keys are the same
        self.size = 1
        while self.size < max(1, len(players)):
            self.size *= 2
        self.losers = [-1] * self.size

    def _beats(self, a: int, b: int) -> bool:
        """Whether a's suffix comes first. Both know what they share with the last winner, so only bytes beyond the shared
        prefix are looked at; the loser then knows what it shares with the winner."""
        x = self.heads[a] if 0 <= a < len(self.heads) else None
        y = self.heads[b] if 0 <= b < len(self.heads) else None
        if x is None or y is None:
            return y is None
        if x.key != y.key:
            return x.key < y.key
        m, n = self.common[a], self.common[b]
        if m != n:
            return m > n
        n = shared(x.text, y.text, n)
        first = x.text[n:] < y.text[n:] or (x.text[n:] == y.text[n:] and a < b)
        self.common[b if first else a] = n
        return first

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._beats(a, b):
            self.losers[node] = b
            return a
        self.losers[node] = a
        return b

    def __iter__(self) -> Iterator[tuple[Suffix, int]]:
        if not self.players:
            return
        winner, last = self._build(1), None
        while (best := self.heads[winner]) is not None:
            yield best, self.common[winner] if last is not None and last.key == best.key else 0
            last = best
            head, n = next(self.players[winner], (None, 0))
            if head is not None and head.key != best.key:
                n = 0
            self.heads[winner], self.common[winner] = head, n
            node = (winner + self.size) // 2
            while node:
                other = self.losers[node]
                if not self._beats(winner, other):
                    self.losers[node], winner = winner, other
                node //= 2


def repeats(order: list[tuple[Suffix, int]]) -> Iterator[tuple[int, int, int]]:
    """Of the suffixes of one key in order, with their common prefixes: runs of windows (doc_id, start, last start) that
    start twice or more."""
    kinds: list[Suffix] = []
    members: list[list[Suffix]] = []
    common: list[int] = []
    text, fronts = None, {}  # equal suffixes are neighbours; those with equal fronts too are copies of one kind
    for s, n in order:
        if s.text != text:
            text, fronts = s.text, {}
        k = fronts.setdefault((s.front, s.more), len(kinds))
        if k < len(kinds):
            members[k].append(s)
        else:
            kinds.append(s)
            members.append([s])
            common.append(n)
    twice: list[set[int] | None] = [None if len(m) > 1 else set() for m in members]
    if 1 < len(kinds) <= PAIRS:
        for i, x in enumerate(kinds):
            least = WINDOW
            for j in range(i + 1, len(kinds)):
                y, least = kinds[j], min(least, common[j])
                low = max(WINDOW - least, len(x.front) - x.more, len(y.front) - y.more)
                high = min(len(x.front), len(y.front))
                if high < low or x.front[len(x.front) - low :] != y.front[len(y.front) - low :]:
                    continue
                while high > low and x.front[len(x.front) - high :] != y.front[len(y.front) - high :]:
                    high = shared(x.front[::-1], y.front[::-1], low)
                for k, z in ((i, x), (j, y)):
                    if twice[k] is not None:
                        twice[k].update(range(len(z.front) - high, len(z.front) - low + 1))
    elif kinds[1:]:
        low, high = min(len(s.front) - s.more for s in kinds), max(len(s.front) for s in kinds)
        for o in range(low, high + 1):
            i, least = 0, WINDOW - o
            while i < len(kinds):
                j = i + 1
                while j < len(kinds) and common[j] >= least:
                    j += 1
                if j - i > 1:
                    equal = defaultdict(list)
                    for k in range(i, j):
                        s = kinds[k]
                        if len(s.front) - s.more <= o <= len(s.front):
                            equal[s.front[len(s.front) - o :]].append(k)
                    for found in equal.values():
                        if len(found) > 1:
                            for k in found:
                                if twice[k] is not None:
                                    twice[k].add(len(kinds[k].front) - o)
                i = j
    for s, rows, own in zip(kinds, members, twice, strict=True):
        if own is None:
            for x in rows:
                yield x.doc_id, x.first, x.first + x.more
            continue
        for k in sorted(own):
            if k - 1 not in own:
                end = k
                while end + 1 in own:
                    end += 1
                yield s.doc_id, s.first + k, s.first + end


SENT = "bucket int, run binary, marks binary"


def _send(held: dict[int, list[Suffix]], buckets: int) -> pd.DataFrame:
    """Rows of SENT: front-coded sorted runs, and marks: windows of suffixes of which the task has copies. One of them goes
    into the run; the marks go to buckets of their documents."""
    out, marks = [], defaultdict(list)
    for bucket, suffixes in held.items():
        kinds: dict[tuple, list[Suffix]] = {}
        for s in suffixes:
            kinds.setdefault((s.key, s.text, s.front, s.more), []).append(s)
        for same in kinds.values():
            if len(same) > 1:
                for s in same:
                    marks[s.doc_id % buckets].append((s.doc_id, s.first, s.first + s.more))
        out.append((bucket, encode([same[0] for same in kinds.values()]), None))
    out += [(bucket, None, np.asarray(found, np.int64).tobytes()) for bucket, found in marks.items()]
    held.clear()
    return pd.DataFrame(out, columns=["bucket", "run", "marks"])


def _runs(docs: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[Suffix]] = defaultdict(list)
        size = 0
        for batch in batches:
            for part in each_stretch(batch, BYTES):
                for s in part:
                    held[s.key % buckets].append(Suffix(s.key, s.doc_id, s.first, s.last - s.first, s.body[: s.before], s.body[s.before :]))
                    size += len(s.body) + 200
                if size > HELD:
                    yield _send(held, buckets)
                    size = 0
        if held:
            yield _send(held, buckets)

    return with_anchors(docs, found).mapInPandas(run, SENT)


def _marks(sent: DataFrame) -> DataFrame:
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out, same = [], []

        def ended() -> None:
            if len(same) > 1:
                out.extend((d, a, b + WINDOW) for d, a, b in repeats(same))
            same.clear()

        for s, n in LoserTree([decode(bytes(x)) for x in rows["run"] if x is not None]):
            if same and same[-1][0].key != s.key:
                ended()
            same.append((s, n))
        ended()
        for x in rows["marks"]:
            if x is not None:
                out.extend((d, a, b + WINDOW) for d, a, b in np.frombuffer(x, np.int64).reshape(-1, 3).tolist())
        return pd.DataFrame(out, columns=["doc_id", "start", "end"])

    return sent.groupBy("bucket").applyInPandas(merge, "doc_id long, start long, end long")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans of bytes to remove, which may overlap, of documents that have any. docs as of one_per_id()."""
    found = survivors(docs, BYTES)
    return spans_by_doc(_marks(_runs(docs, found, max(1, -(-found.count() // BUCKET)))))


def remove(docs: DataFrame) -> DataFrame:
    """One row for each id: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that stay)."""
    known = one_per_id(docs)
    rows = known.join(spans(known), "doc_id", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch["doc_id"].tolist(), batch["text"], batch["spans"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                gone = union(found, len(raw)) if found is not None else []
                kept, at = [], 0
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out.append((doc_id, len(raw), sum(b - a for a, b in gone), len(gone), b"".join(kept)))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """One row for each id: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    from pyspark.sql import functions as F

    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def digest_of(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()

"""Cost-balanced packing of documents into sequences of tokens.

Texts become ids by a tokenizer's file, with an end id after each document. Whole lengths of LIMIT ids fill sequences of
their own; what is left of each document goes, with others of its bin, to the sequences of that bin. There the cost of a
piece of n ids is n + n * n / QUADRATIC; pieces are taken in descending order and each goes to the sequence of lowest cost
that has room. A bin has just as many sequences as its ids need, so a piece may find no room: it is then cut over the
roomiest sequences. All sequences of a bin but one are full. Bins are hashes of ids and hold about BIN_ROWS documents and
BIN_BYTES of text, so a task's memory is bounded by those and the longest text, however many documents there are.

Null and empty texts are one end id. Rows without an id are left out; of rows that share an id the greatest text counts
once. An empty table gives an empty result. Other columns are ignored.

Ids are those that the `tokenizers` library gives for the file with add_special_tokens=False: a special token that stands in a
text is one id. Where the file's kind allows it, its merges run in a faster compiled encoder, but for texts with such tokens;
tests hold both against the library.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, one_per_id, release

LIMIT = 1024
END = 0
#: Ids at which the quadratic part of the cost of attention equals the linear part.
QUADRATIC = 512
BIN_ROWS = 2000
BIN_BYTES = 16_000_000
#: Distinct chunks whose ids a worker keeps.
KEPT = 150_000

#: A byte-level tokenizer of this family never joins characters over a single space between two that aren't space.
BREAK = re.compile(r"(?<=\S) (?=\S)")
#: Other white space than a space and a line feed.
SPACES = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")


def chunks(text: str) -> list[str]:
    """The text cut at those spaces; each but the first lacks the space before it."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or any(c in text for c in SPACES):
        return BREAK.split(text)
    return text.split(" ")


def fast_encoder(path: str):
    """The merges of a tokenizer file as a compiled encoder of the same ids, which is some times faster on short strings, or
    None where the file is of another kind: it must be byte-level BPE with the usual splitting, whose ids are in order of
    merges."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    if model.get("type") != "BPE" or not plain or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    ids = [model["vocab"].get(m.replace(" ", "")) for m in merged]
    if None in ids or ids != sorted(ids):
        return None
    names = [*(n for n in model["vocab"] if len(n) == 1), *(m.replace(" ", "") for m in merged)]
    ranks = {bytes(letter[c] for c in n): model["vocab"][n] for n in names}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


PIECE = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long"


class Ids:
    """Little-endian 32-bit ids of texts, as the tokenizer of a file gives them; chunks are looked up once."""

    def __init__(self, path: str):
        self.path = path
        self.fast = fast_encoder(path)
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens") or ()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.known: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        """The library's own; few texts need it where there is a fast encoder."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def slow(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.fast(t)).tobytes() for t in texts] if self.fast else self.slow(texts)

    def of(self, texts: list[str]) -> list[bytes]:
        if not self.fast:
            return self.slow(texts)
        special = [k for k, t in enumerate(texts) if self.special and self.special.search(t)]
        if special:
            out = self.plain([t for k, t in enumerate(texts) if k not in set(special)])
            for k, raw in zip(special, self.slow([texts[k] for k in special]), strict=True):
                out.insert(k, raw)
            return out
        return self.plain(texts)

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens, by the fast encoder."""
        lists = [chunks(t) for t in texts]
        firsts = self.encode([x[0] for x in lists])
        new = set().union(*(x[1:] for x in lists)).difference(self.known)
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = set().union(*(x[1:] for x in lists))
        order = list(new)
        self.known.update(zip(order, self.encode([" " + x for x in order]), strict=True))
        find = self.known.__getitem__
        return [b"".join([first, *map(find, x[1:])]) for first, x in zip(firsts, lists, strict=True)]


@keeps
@lru_cache(2)
def loaded(path: str) -> Ids:
    """One for each worker: its chunks stay known from task to task."""
    return Ids(path)


def cost(n: int) -> float:
    return n + n * n / QUADRATIC


def assign(sizes: list[int], limit: int = LIMIT) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length). sizes are under limit; every id lies in exactly one piece."""
    n = -(-sum(sizes) // limit)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    room, spent, left = np.full(n, limit), np.zeros(n), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = room >= sizes[i]
        k = int(np.where(fits, spent, np.inf).argmin())
        if not fits[k]:
            left.append(i)
            continue
        out[k].append((i, 0, sizes[i]))
        room[k] -= sizes[i]
        spent[k] += cost(sizes[i])
    room = room.tolist()
    roomy = sorted((k for k in range(n) if room[k]), key=lambda k: -room[k])
    for i in left:
        at = 0
        while at < sizes[i]:
            k = roomy[0]
            take = min(room[k], sizes[i] - at)
            out[k].append((i, at, take))
            at += take
            room[k] -= take
            if not room[k]:
                roomy.pop(0)
    return out


def pieces(docs: DataFrame, path: str, with_ids: bool) -> DataFrame:
    """Pieces of every document, cut at multiples of LIMIT. Without with_ids only pieces shorter than that carry their ids:
    they may be cut again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = loaded(path)
        for batch in batches:
            for _, part in batch.groupby(batch["text"].str.len().cumsum() // 1_000_000):
                rows = []
                for doc_id, raw in zip(part["doc_id"], ids.of(part["text"].tolist()), strict=True):
                    raw += END.to_bytes(4, "little")
                    n = len(raw) // 4
                    for start in range(0, n, LIMIT):
                        cut = raw[4 * start : 4 * (start + LIMIT)]
                        whole = len(cut) == 4 * LIMIT
                        rows.append((doc_id, start, len(cut) // 4, cut if with_ids or not whole else None, zlib.crc32(cut), n))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])
        release(loaded)

    return docs.mapInPandas(run, PIECE)


PACKED = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(rows: pd.DataFrame) -> pd.DataFrame:
    """The sequences of one bin."""
    rows = rows.sort_values(["doc_id", "start"])
    whole = rows["length"] == LIMIT
    number = int(rows["bin"].iloc[0]) << 32
    alone = rows[whole].assign(offset=0)
    alone = alone.assign(sequence_id=number + np.arange(len(alone)))
    rest = rows[~whole]
    doc, start, size, raw, tokens = (rest[c].tolist() for c in ("doc_id", "start", "length", "ids", "doc_tokens"))
    out = []
    for k, items in enumerate(assign(size), number + len(alone)):
        offset = 0
        for i, at, n in items:
            cut = bytes(raw[i][4 * at : 4 * (at + n)])
            out.append((doc[i], start[i] + at, n, cut, zlib.crc32(cut), tokens[i], k, offset))
            offset += n
    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    mixed = pd.DataFrame(out, columns=names)
    return mixed if alone.empty else pd.concat([alone[names], mixed]) if len(mixed) else alone[names]


def pack(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (null without with_ids where a piece fills a sequence),
    ids_crc32, doc_tokens, sequence_id, offset. Sequences are numbered within bins."""
    known = one_per_id(docs)
    rows, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bins = max(1, -(-rows // BIN_ROWS), -(-size // BIN_BYTES))
    return pieces(known, path, with_ids).withColumn("bin", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(bins))).groupBy("bin").applyInPandas(fill, PACKED)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs, path, False).drop("ids")

"""What the operators must return, by plain loops."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def lower(t: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in t)


def contamination(docs: dict, items: dict) -> dict:
    """docs: id to text; values (n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows: dict[tuple, set] = {}
    for name, text in items.items():
        ws = FOLDED.findall(lower(text or ""))
        n = min(13, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[i : i + n]), set()).add(str(name))
    lengths = {len(w) for w in windows}
    out = {}
    for d, text in docs.items():
        ws = FOLDED.findall(lower(text or ""))
        hit, names = set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                if found := windows.get(tuple(ws[i : i + n])):
                    names |= found
                    hit.update(range(i, i + n))
        out[d] = (len(ws), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(ws))
    return out


def substring(docs: dict, window: int = 20) -> dict:
    """docs: id to text; values (n_words, n_removed, kept_sha256)."""
    seen, out = set(), {}
    for d in sorted(docs):
        ws = SPACED.findall(docs[d] or "")
        gone = set()
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out[d] = (len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def suffix(docs: dict, window: int = 200) -> dict:
    """values (n_bytes, n_removed, n_spans, kept_sha256)."""
    raws = {d: (t or "").encode() for d, t in docs.items()}
    counts = Counter(r[i : i + window] for r in raws.values() for i in range(len(r) - window + 1))
    out = {}
    for d, r in raws.items():
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if counts[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(r), sum(gone), spans, sha(bytes(c for c, g in zip(r, gone, strict=True) if not g)))
    return out


def secrets(text: str | None) -> tuple:
    """(n_assign, n_access, n_hex, base_sha256)."""
    t, found = text or "", []
    found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    n = Counter(x[2] for x in found)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)))


def jaccard(docs: dict, shingle: int = 4, similar: int = 85) -> dict:
    """values (n_shingles, component_id)."""
    sets = {}
    for d, t in docs.items():
        ws = SPACED.findall(lower(t or ""))
        sets[d] = {tuple(ws[i : i + shingle]) for i in range(max(1, len(ws) - shingle + 1))} if ws else set()
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by: dict[tuple, list] = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    both = Counter()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= similar * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    least: dict = {}
    for d in docs:
        least[find(d)] = min(least.get(find(d), d), d)
    return {d: (len(sets[d]), least[find(d)]) for d in docs}


def rules(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    t = text or ""
    ws = SPACED.findall(t)
    c = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if c[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(ws) < 50 or 100 * len(covered) > 50 * len(ws)

"""Vectors of distinct words, computed once by a worker for many texts and added up by text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np


class WordSums:
    """Sums over the words of texts of what rows(words) gives for each: an array (len(words), width). Words are looked up
    GROUP at a time, those not yet known all at once. They are kept with their rows until there would be over limit of them,
    then all are dropped, so memory is bounded and results don't change."""

    GROUP = 300_000

    def __init__(self, rows: Callable[[list[bytes]], np.ndarray], width: int, limit: int = 600_000):
        self.rows, self.width, self.limit = rows, width, limit
        self._clear()

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.kept = np.zeros((1024, self.width), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if len(self.at) + len(new) > self.limit:
            self._clear()
            new = list(dict.fromkeys(words))
        if not new:
            return
        n = len(self.at)
        if n + len(new) > len(self.kept):
            grown = np.zeros((max(2 * len(self.kept), n + len(new)), self.width), np.float32)
            grown[:n] = self.kept[:n]
            self.kept = grown
        self.kept[n : n + len(new)] = self.rows(new)
        self.at.update(zip(new, range(n, n + len(new)), strict=True))

    def _group(self, parts: list[tuple[int, list[bytes]]], out: np.ndarray) -> None:
        words = [w for _, ws in parts for w in ws]
        self._learn(words)
        found = self.kept[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].astype(np.float64)
        starts = np.cumsum([0, *(len(ws) for _, ws in parts)])[:-1]
        np.add.at(out, [k for k, _ in parts], np.add.reduceat(found, starts, axis=0))

    def add(self, texts: list[list[bytes]]) -> np.ndarray:
        """One row of sums for each list of words."""
        out = np.zeros((len(texts), self.width), np.float64)
        parts: list[tuple[int, list[bytes]]] = []
        size = 0
        for k, words in enumerate(texts):
            for i in range(0, len(words), self.GROUP):
                parts.append((k, words[i : i + self.GROUP]))
                size += len(parts[-1][1])
                if size >= self.GROUP:
                    self._group(parts, out)
                    parts, size = [], 0
        if parts:
            self._group(parts, out)
        return out


def in_chunks(texts: Iterable[str | None], most: int = 2_000_000) -> Iterator[list[str | None]]:
    """Consecutive texts, of most characters together or a single longer one."""
    held: list[str | None] = []
    size = 0
    for t in texts:
        if held and size + len(t or "") > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held

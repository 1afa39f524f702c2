"""Word n-grams as 64-bit hashes, for Arrow batches: words are hashed once each, n-grams are array arithmetic."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

#: Characters that are cut into words at once.
CHARS = 4_000_000
_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-cased words of any script."""
    return _WORD.findall(text.lower()) if text else []


def chunks(texts: Sequence[str | None]) -> Iterator[slice]:
    """Stretches of texts with at most CHARS characters, or one longer text."""
    begin = chars = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and chars + n > CHARS:
            yield slice(begin, i)
            begin, chars = i, 0
        chars += n
    if begin < len(texts):
        yield slice(begin, len(texts))


class Grams:
    """Hashes of the n-grams of words; a task keeps one, which remembers the hashes of the words it has seen."""

    def __init__(self, n: int, remembered: int = 200_000):
        self.n, self.remembered = n, remembered
        self.seen: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        h = self.seen.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
            if len(self.seen) < self.remembered:
                self.seen[word] = h
        return h

    def __call__(self, lists: Sequence[list[str]]) -> list[np.ndarray]:
        """For each list of words the hash of the n-gram that begins at each word, as far as there is one."""
        h = np.array([self._hash(w) for x in lists for w in x], np.uint64)
        g = np.zeros(max(0, len(h) - self.n + 1), np.uint64)
        for k in range(self.n):
            g = (g ^ h[k : k + len(g)]) * _ODD
            g ^= g >> np.uint64(29)
        ends = np.cumsum([len(x) for x in lists])
        signed = g.view(np.int64)
        return [signed[e - len(x) : max(e - len(x), e - self.n + 1)] for e, x in zip(ends, lists)]


def greedy_runs(at: Sequence[int], n: int) -> list[tuple[int, int]]:
    """Maximal runs of words, as (start, end), from the ascending places where shared n-grams begin. A run takes its words:
    the next one starts behind it, so a cluster of hits within another run's tail is cut or left out."""
    runs: list[tuple[int, int]] = []
    free, k = 0, 0
    while k < len(at):
        if at[k] < free:
            k += 1
            continue
        start = at[k]
        while k + 1 < len(at) and at[k + 1] == at[k] + 1:
            k += 1
        free = at[k] + n
        runs.append((start, free))
        k += 1
    return runs

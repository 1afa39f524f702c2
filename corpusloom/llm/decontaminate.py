"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

1. Every n-gram of a test item is a seed, however common: which of them survive in an edited copy is not known beforehand.
2. A document's seed hits are grouped by item and diagonal; the passage around each group is aligned with the item.
   A word that is equal scores ``MATCH``; a replaced, added or missing one costs ``MISS``. The best local alignment of an
   item and a document is reported if it reaches ``share`` of the item's own score, or ``words`` matched words.

A copy without ``GRAM`` neighbouring words of its item is not aligned.

Documents are read once and never shuffled: items travel to them. They are broadcast in blocks of at most
``BLOCK_ITEM_CHARS`` characters of items; a larger test set takes more passes, one for each block, and loses nothing.

Defined results: a null, empty or wordless document or item matches nothing; an item shorter than n words is its own seed.
Repeated rows of documents give repeated rows. Repeated rows of an item count once; two texts under one item id are both
aligned, and the better is reported. Documents of any length are scanned whole. Rows with a null document id are kept.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, free_name, hashed, map_texts, owners, pair, plain_words

GRAM = 3
MATCH, MISS = 2, 1
SHARE, WORDS = 0.5, 13
#: Characters of test items that one pass over the documents carries (about four times as many bytes are broadcast).
BLOCK_ITEM_CHARS = 4_000_000
_FILTER_BITS = 22
#: Pairs of a seed hit and an item that are held at once; a document with more is a run of its own.
_HITS = 500_000
#: Words of windows that are aligned at once; their rows stay in a core's cache.
_CELLS = 32_000


def grams(h: np.ndarray, own: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hash of the n-gram that starts at each word; 0 where it would leave the text."""
    out = np.zeros(len(h), np.uint64)
    if len(h) >= n:
        g = h[: len(h) - n + 1]
        for k in range(1, n):
            g = pair(g, h[k : len(h) - n + 1 + k])
        inner = own[: len(h) - n + 1] == own[n - 1 :]
        out[: len(g)][inner] = g[inner] | np.uint64(1)
    return out


class Items:
    """The word hashes of test items, laid end to end, with the n-grams of each."""

    def __init__(self, ids: list, texts: list[str]):
        h, counts = hashed(texts, plain_words, WordHasher())
        self.ids, self.h, self.counts = ids, h, counts
        self.starts = np.cumsum(counts) - counts
        own = owners(counts)
        g = grams(h, own)
        self.at = np.flatnonzero(g)
        self.gram = g[self.at]
        self.size = np.full(len(self.at), GRAM)
        short = np.flatnonzero((counts > 0) & (counts < GRAM))
        for i in short:  # the whole item is its seed
            w = h[self.starts[i] : self.starts[i] + counts[i]]
            self.at = np.append(self.at, self.starts[i])
            self.gram = np.append(self.gram, (w[0] if len(w) == 1 else pair(w[:1], w[1:])[0]) | np.uint64(1))
            self.size = np.append(self.size, counts[i])
        self.item = own[self.at] if len(own) else self.at


class GramTable:
    """Which of a sorted table of n-grams each word of some texts starts, behind a bit filter."""

    def __init__(self, gram: np.ndarray, size: np.ndarray):
        self.by_size = []
        for n in np.unique(size):
            g = np.unique(gram[size == n])
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.by_size.append((int(n), g, bits))

    def hits(self, h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for n, table, bits in self.by_size:
            g = grams(h, own, n)
            maybe = np.flatnonzero(bits[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            v = g[maybe]
            i = np.searchsorted(table, v)
            i[i == len(table)] = 0
            ok = (table[i] == v) & (v != 0)
            places.append(maybe[ok])
            found.append(v[ok])
        return np.concatenate(places), np.concatenate(found)


def align(windows: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best Smith-Waterman score of each window with its item, in batches of similar length.

    Row by row over the item, all windows at once; a row's own gaps are a running maximum.
    """
    out = np.zeros(len(windows), np.int64)
    order = sorted(range(len(windows)), key=lambda i: (len(items[i]), len(windows[i])))
    at = 0
    while at < len(order):
        end, cells = at, 0
        while end < len(order) and (end == at or cells < _CELLS):
            cells += len(windows[order[end]])
            end += 1
        some = order[at:end]
        width, height = max(len(windows[i]) for i in some), max(len(items[i]) for i in some)
        w = np.zeros((len(some), width), np.uint64)
        t = np.full((len(some), height), np.uint64(1))
        for k, i in enumerate(some):
            w[k, : len(windows[i])] = windows[i] | np.uint64(2)
            t[k, : len(items[i])] = items[i] | np.uint64(2)
        row = np.zeros((len(some), width + 1), np.int32)
        best = np.zeros(len(some), np.int32)
        slope = np.arange(width + 1, dtype=np.int32) * MISS
        for j in range(height):
            step = np.where(w == t[:, j : j + 1], MATCH, -MISS)
            new = np.zeros_like(row)
            np.maximum(row[:, :-1] + step, row[:, 1:] - MISS, out=new[:, 1:])
            np.maximum(new, 0, out=new)
            row = np.maximum.accumulate(new + slope, axis=1) - slope
            np.maximum(best, row.max(1), out=best)
        out[some] = best
        at = end
    return out


def common_words(windows: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """How many of each item's words occur in its window, wherever: no alignment can match more of them."""
    out = np.zeros(len(windows), np.int64)
    order = sorted(range(len(windows)), key=lambda i: (len(items[i]), len(windows[i])))
    at = 0
    while at < len(order):
        end, cells = at, 0
        while end < len(order) and (end == at or cells < _CELLS):
            cells += len(windows[order[end]])
            end += 1
        some = order[at:end]
        w = np.zeros((len(some), max(len(windows[i]) for i in some)), np.uint64)
        t = np.full((len(some), max(len(items[i]) for i in some)), np.uint64(1))
        for k, i in enumerate(some):
            w[k, : len(windows[i])] = windows[i] | np.uint64(2)
            t[k, : len(items[i])] = items[i] | np.uint64(2)
        for j in range(t.shape[1]):
            out[some] += (w == t[:, j : j + 1]).any(1)
        at = end
    return out


class Finder:
    """(item, score, first word, last word) of a text, for the test items of one block."""

    def __init__(self, items: Items, share: float, words: int):
        self.items, self.share, self.words = items, share, words
        self.seeds = np.argsort(items.gram, kind="stable")
        self.keys = items.gram[self.seeds]
        self.table = GramTable(self.keys, items.size[self.seeds])
        self.hasher = WordHasher()

    def __call__(self, texts: list[str | None]) -> list:
        h, counts = hashed(texts, plain_words, self.hasher)
        own = owners(counts)
        place, gram = self.table.hits(h, own)
        order = np.argsort(place, kind="stable")
        place, gram = place[order], gram[order]
        lo, hi = np.searchsorted(self.keys, gram, "left"), np.searchsorted(self.keys, gram, "right")
        found: list[list[dict]] = [[] for _ in texts]
        if not len(place):
            return [found]
        first = np.flatnonzero(np.diff(own[place], prepend=-1))  # each document's first hit
        ends, total = np.append(first[1:], len(place)), np.cumsum(hi - lo)
        begin, before = 0, 0
        for k, end in enumerate(ends):
            if k + 1 == len(ends) or total[ends[k + 1] - 1] - before > _HITS:
                self._align(h, counts, own, place[begin:end], lo[begin:end], hi[begin:end], found)
                begin, before = end, total[end - 1]
        return [found]

    def _align(self, h: np.ndarray, counts: np.ndarray, own: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, found: list[list[dict]]) -> None:
        """Add to ``found`` what the hits of some documents lead to; ``lo`` and ``hi`` bound the seeds that each hit equals."""
        it = self.items
        n = hi - lo
        seed = self.seeds[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        place = np.repeat(place, n)
        item = it.item[seed]
        size = it.counts[item]
        begin = place - (it.at[seed] - it.starts[item])  # where the item would begin in the text
        doc = own[place]
        order = np.lexsort((begin, item, doc))
        doc, item, begin, size = doc[order], item[order], begin[order], size[order]
        # Hits whose diagonals are near are one passage, up to the item's length on either side.
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[1:])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        text_lo = np.cumsum(counts) - counts
        slack = size[first] // 2 + 2
        a = np.maximum(begin[first] - slack, text_lo[doc[first]])
        b = np.minimum(begin[last] + size[first] + slack, text_lo[doc[first]] + counts[doc[first]])
        targets = [it.h[it.starts[i] : it.starts[i] + it.counts[i]] for i in item[first]]
        windows = [h[x:y] for x, y in zip(a, b)]
        full = MATCH * size[first]
        enough = lambda s: (s >= self.share * full) | (s >= MATCH * self.words)
        # Most seeds are common words alone: what can't be enough needs no alignment.
        maybe = np.flatnonzero(enough(MATCH * common_words(windows, targets)))
        score = np.zeros(len(windows), np.int64)
        score[maybe] = align([windows[k] for k in maybe], [targets[k] for k in maybe])
        good = enough(score)
        best: dict[tuple, dict] = {}
        for k in np.flatnonzero(good):
            d, i = int(doc[first[k]]), it.ids[int(item[first[k]])]
            row = {"item": i, "score": float(score[k] / full[k]), "first": int(a[k] - text_lo[d]), "last": int(b[k] - text_lo[d])}
            old = best.get((d, i))
            if old is None or row["score"] > old["score"]:
                best[d, i] = row
        for (d, _), row in sorted(best.items(), key=lambda x: (x[0][0], x[0][1])):
            found[d].append(row)


def item_blocks(items: DataFrame, item_id: str, text_col: str, limit: int = BLOCK_ITEM_CHARS) -> Iterator[Items]:
    """The test items in blocks of bounded size, streamed through the driver one block at a time."""
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null and i is not null").distinct().orderBy("i", "t")
    ids, texts, n = [], [], 0
    for r in rows.toLocalIterator():
        if n and n + len(r["t"]) > limit:
            yield Items(ids, texts)
            ids, texts, n = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        n += len(r["t"])
    if ids:
        yield Items(ids, texts)


_FOUND = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    share: float = SHARE, words: int = WORDS, carry: tuple[str, ...] | None = None, block_chars: int = BLOCK_ITEM_CHARS, output: str = "leaks",
) -> DataFrame:
    """``docs`` (or its ``carry`` columns) with ``leaks`` (or another name; a column of that name is replaced): an array of (item, score, first, last) for each document, empty
    where clean. ``first`` and ``last`` bound the passage in words, last exclusive."""
    sc = docs.sparkSession.sparkContext
    names = docs.columns if carry is None else list(carry)
    names = [c for c in names if c.lower() != output.lower()]
    out = docs
    parts: list[str] = []
    for block in item_blocks(items, item_id, item_text, block_chars):
        shared = sc.broadcast(block)
        name = free_name([*docs.columns, *parts, output], f"_leaks{len(parts)}")
        keep = [*dict.fromkeys([*names, text_col, *parts])]
        out = map_texts(out, text_col, keep, [T.StructField(name, _FOUND)], lambda shared=shared: Finder(shared.value, share, words))
        parts.append(name)
    merged = F.concat(*[F.col(f"`{p}`") for p in parts]) if len(parts) > 1 else F.col(f"`{parts[0]}`") if parts else F.array().cast(_FOUND)
    return out.select(*[F.col(f"`{c}`") for c in names], merged.alias(output))


def leaked_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row (id, item_id, score, first, last) for each test item that a document holds."""
    got = leaks(docs, items, id_col, carry=(id_col,), **options).select(F.col(f"`{id_col}`"), F.explode("leaks").alias("_l"))
    return got.select(F.col(f"`{id_col}`"), F.col("_l.item").alias("item_id"), F.col("_l.score").alias("score"), F.col("_l.first").alias("first_word"), F.col("_l.last").alias("end_word"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no test item, with their columns."""
    names = docs.columns
    held = free_name(names, "leaks")
    return leaks(docs, items, output=held, **options).where(F.size(held) == 0).select(*[F.col(f"`{c}`") for c in names])

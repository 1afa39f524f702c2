"""Language identification by a linear-chain conditional random field over the words of a text.

Every word is labelled, so code-switched texts get a label for each span; a document's language is the label with the
largest posterior mass. Features of a word are hashed character n-grams of ``^word$`` (those at the edges are its
affixes) and the word itself (the lexicon). Label transitions are learned with the weights, by the exact gradient of the
sequence likelihood (forward-backward), from sequences that switch between the training texts' languages.

Defined results: a null text, or one without any letter, is ``und`` with score 0. Texts of any length are labelled
whole. Repeated rows are labelled alike. An empty table gives no rows; without a usable training row everything is
``und``. Of labels with equal mass the first in code point order is named. A null id belongs to no fold, so it is
learned from. Input columns that clash with an output's name are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, held_out, map_texts, tune

UND = "und"
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
#: Bound of the training sample: texts a language, drawn by hash over all training rows.
TEXTS_PER_LANGUAGE = 150
#: Bound of what the fit holds: characters of all its texts, which are read in an order drawn by hash until it is reached.
MAX_CHARS = 100_000_000
SEQUENCES, SEQ_WORDS, EPOCHS = 6000, 40, 3
_LETTER = re.compile(r"[^\W\d_]")
_CACHE = 200_000


def has_letter(text: str | None) -> bool:
    """Fractions and raised digits match the pattern's class as well, but are no letters."""
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words, flat, and the first feature of each word."""
    marked = "".join([f"\x02{w}\x03" for w in words])
    cp = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    own = np.repeat(np.arange(len(words)), lens)
    starts = np.cumsum(lens) - lens
    ends = np.repeat(starts + lens, lens)
    mult = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(cp), np.uint64)
    owner, value = [], []
    at = np.arange(len(cp))
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros_like(cp)
        shifted[: len(cp) - n + 1] = cp[n - 1 :]
        h = (h + shifted + np.uint64(n)) * mult
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            ok = at + n <= ends
            owner.append(own[ok])
            value.append(h[ok])
    # The lexicon feature: a hash of the whole word.
    power = (at - np.repeat(starts, lens)).astype(np.uint64)
    whole = np.add.reduceat(((cp + np.uint64(1)) * mult) ** np.uint64(2) * (power * np.uint64(2) + np.uint64(0xD1342543DE82EF95)), starts)
    owner.append(np.arange(len(words)))
    value.append(whole)
    owner_, value_ = np.concatenate(owner), np.concatenate(value)
    order = np.argsort(owner_, kind="stable")
    value_ = value_[order]
    value_ ^= value_ >> np.uint64(31)
    counts = np.bincount(owner_, minlength=len(words))
    return (value_ % np.uint64(buckets)).astype(np.int64), np.cumsum(counts) - counts


def split_words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def forward_backward(emit: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior label probabilities of every word of a batch of sequences, laid end to end.

    emit: log scores [words, labels]. Also gives the alphas and betas (scaled), from which pair marginals follow.
    One step of the loop advances all sequences that are still running, so its cost is that of array operations.
    """
    potential = np.exp(emit - emit.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-30)
    move, begin = np.exp(trans).astype(np.float32), np.exp(start - start.max()).astype(np.float32)
    order = np.argsort(-lens, kind="stable")
    n_sorted = lens[order]
    first = (np.cumsum(lens) - lens)[order]
    alpha, beta = np.empty_like(potential), np.empty_like(potential)
    longest = int(n_sorted[0]) if len(lens) else 0
    running = np.searchsorted(-n_sorted, -np.arange(1, longest + 1), side="right")
    a = None
    for t in range(longest):
        m = running[t]
        at = first[:m] + t
        a = potential[at] * (begin if t == 0 else a[:m] @ move)
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    b = np.empty((0, potential.shape[1]), np.float32)
    back = move.T.copy()
    for t in range(longest - 1, -1, -1):
        m, seen = running[t], len(b)
        at = first[:m] + t
        if seen:
            nxt = (potential[at[:seen] + 1] * b) @ back
            nxt /= nxt.sum(1, keepdims=True)
            b = np.concatenate([nxt, np.ones((m - seen, nxt.shape[1]), np.float32)]) if m > seen else nxt
        else:
            b = np.ones((m, potential.shape[1]), np.float32)
        beta[at] = b
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    return post, alpha, beta * potential


def train(texts: list[str], langs: list[str], seed: int = 7) -> dict:
    """Fit the field on a bounded sample by AdaGrad on the sequence likelihood."""
    labels = sorted(set(langs))
    k = len(labels)
    by = {l: [w for w in (split_words(t) for t, x in zip(texts, langs) if x == l) if w] for l in labels}
    by = {l: d for l, d in by.items() if d}
    labels = sorted(by)
    k = len(labels)
    if not k:
        return {"labels": []}
    rng = np.random.default_rng(seed)
    weights, grad2 = np.zeros((BUCKETS, k), np.float32), np.full((BUCKETS, k), 1e-2, np.float32)
    trans, start = np.zeros((k, k)), np.zeros(k)
    tg, sg = np.full((k, k), 1e-2), np.full(k, 1e-2)
    batch = 200
    for step in range(SEQUENCES * EPOCHS // batch):
        words, gold, lens = [], [], []
        for _ in range(batch):
            left, n, y = SEQ_WORDS, 0, int(rng.integers(k))
            while left > 0:
                doc = by[labels[y]][int(rng.integers(len(by[labels[y]])))]
                take = min(left, int(rng.integers(1, SEQ_WORDS)) if rng.random() < 0.5 else left)
                lo = int(rng.integers(max(1, len(doc) - take + 1)))
                piece = doc[lo : lo + take]
                words += piece
                gold += [y] * len(piece)
                n += len(piece)
                left -= take
                y = int(rng.integers(k))
            lens.append(n)
        uniq: dict[str, int] = {}
        codes = np.fromiter((uniq.setdefault(w, len(uniq)) for w in words), np.int64, len(words))
        feats, first = features(list(uniq))
        per = np.diff(np.append(first, len(feats)))
        emit_u = np.add.reduceat(weights[feats], first)
        lens_a, gold_a = np.array(lens), np.array(gold)
        emit = emit_u[codes]
        post, alpha, beta_pot = forward_backward(emit, lens_a, trans, start)
        err = post.copy()
        err[np.arange(len(gold_a)), gold_a] -= 1
        by_word = np.zeros((len(uniq), k), np.float32)
        np.add.at(by_word, codes, err)
        g = np.zeros((BUCKETS, k), np.float32)
        np.add.at(g, feats, np.repeat(by_word, per, axis=0) / len(lens))
        hit = np.unique(feats)
        grad2[hit] += g[hit] ** 2
        weights[hit] -= 0.3 * g[hit] / np.sqrt(grad2[hit])
        inner = np.ones(len(gold_a), bool)
        heads = np.cumsum(lens_a) - lens_a
        inner[heads] = False
        right = np.flatnonzero(inner)
        both = alpha[right - 1][:, :, None] * np.exp(trans)[None] * beta_pot[right][:, None, :]
        both /= both.sum((1, 2), keepdims=True)
        gt = both.sum(0)
        np.subtract.at(gt, (gold_a[right - 1], gold_a[right]), 1)
        gs = err[heads].sum(0)
        gt, gs = gt / len(lens), gs / len(lens)
        tg += gt**2
        sg += gs**2
        trans -= 0.3 * gt / np.sqrt(tg)
        start -= 0.3 * gs / np.sqrt(sg)
    return {"labels": labels, "weights": weights, "trans": trans, "start": start}


class Labeller:
    """Scores words once each (the last few hundred thousand are remembered) and runs the chain over whole texts."""

    def __init__(self, model: dict):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, max(1, len(self.model["labels"]))), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        index, new = self.index, []
        codes = np.empty(len(words), np.int64)
        get = index.get
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                c = index[w] = len(index)
                new.append(w)
            codes[i] = c
        if new:
            feats, first = features(new)
            self.table = np.concatenate([self.table, np.add.reduceat(self.model["weights"][feats], first)])
        out = self.table[codes]
        if len(index) > _CACHE:
            self.clear()
        return out

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        words, lens = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            w = split_words(t)
            lens[i] = len(w)
            words += w
        if not words:
            return np.zeros((0, len(self.model["labels"])), np.float32), lens, words
        post, _, _ = forward_backward(self.emissions(words), lens[lens > 0], self.model["trans"], self.model["start"])
        return post, lens, words

    def __call__(self, texts: list[str | None]) -> list:
        labels = self.model["labels"]
        usable = [bool(labels) and has_letter(t) for t in texts]
        post, lens, _ = self.posteriors([t if u else None for t, u in zip(texts, usable)])
        mass = np.zeros((len(texts), max(1, len(labels))))
        some = lens > 0
        if some.any():
            mass[some] = np.add.reduceat(post.astype(np.float64), (np.cumsum(lens) - lens)[some]) / lens[some][:, None]
        best = mass.argmax(1)
        pred = [labels[b] if s else UND for b, s in zip(best, some)]
        return [pred, np.clip(np.where(some, mass[np.arange(len(texts)), best], 0.0), 0.0, 1.0).tolist()]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Code-switched spans as word ranges with labels, by the most probable label of each word."""
        post, lens, words = self.posteriors([text])
        out: list[tuple[int, int, str]] = []
        for i, y in enumerate(post.argmax(1) if len(words) else []):
            lab = self.model["labels"][y]
            if out and out[-1][2] == lab:
                out[-1] = (out[-1][0], i + 1, lab)
            else:
                out.append((i, i + 1, lab))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TEXTS_PER_LANGUAGE) -> dict:
    """Learn from rows outside the held-out fold with a language, at most about ``per_language`` texts of each (drawn
    by a hash of the id over the whole table) and ``MAX_CHARS`` characters. The fit runs in one task, on that bounded sample."""
    tune(docs.sparkSession)
    usable = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    if not counts:
        return {"labels": []}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(draw < share).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for l, t in ((l, t) for b in batches for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            held += len(t)
            if held > MAX_CHARS and rows:
                break
            rows.append((l, t))
        rows.sort()
        m = train([t for _, t in rows], [l for l, _ in rows]) if rows else {"labels": []}
        if m["labels"]:
            yield pa.RecordBatch.from_arrays([pa.array([m["labels"]], pa.list_(pa.string())), *[pa.array([np.ascontiguousarray(m[k], d).tobytes()], pa.binary()) for k, d in (("weights", np.float32), ("trans", np.float64), ("start", np.float64))]], ["labels", "weights", "trans", "start"])

    got = sample.repartition(1).sortWithinPartitions(F.xxhash64("text"), "lang", "text").mapInArrow(run, "labels array<string>, weights binary, trans binary, start binary").collect()
    if not got:
        return {"labels": []}
    k = len(got[0]["labels"])
    return {"labels": list(got[0]["labels"]), "weights": np.frombuffer(got[0]["weights"], np.float32).reshape(BUCKETS, k), "trans": np.frombuffer(got[0]["trans"], np.float64).reshape(k, k), "start": np.frombuffer(got[0]["start"], np.float64)}


def identify(docs: DataFrame, model: dict, text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score``. The model is of fixed size (BUCKETS x labels), so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    outs = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_texts(docs, text_col, docs.columns if carry is None else carry, outs, lambda: Labeller(shared.value))


def label_spans(docs: DataFrame, model: dict, text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``lang_spans``: code-switched spans as ``first:last:label`` over words, last exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        lab = Labeller(shared.value)
        return lambda texts: [[[f"{a}:{b}:{l}" for a, b, l in lab.spans(t)] if t and lab.model["labels"] else [] for t in texts]]

    return map_texts(docs, text_col, docs.columns if carry is None else carry, [T.StructField("lang_spans", T.ArrayType(T.StringType()))], make)

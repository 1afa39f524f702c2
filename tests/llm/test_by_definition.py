"""Sequence models, training and alignment against their plain definitions."""

import itertools
import math

import numpy as np

from corpusloom.llm import decontaminate, language_id, toxicity
from corpusloom.llm.common import plain_words


def test_forward_backward_by_enumeration():
    """Posteriors of words and pairs are shares of the summed weights of all label paths."""
    rng = np.random.default_rng(2)
    for k in (1, 2, 3):
        lens = np.array([1, 4, 2, 5])
        emit = rng.normal(size=(lens.sum(), k)).astype(np.float32)
        trans, start = rng.normal(size=(k, k)), rng.normal(size=k)
        post, alpha, beta = language_id.forward_backward(emit, lens, trans, start)
        at = 0
        for n in lens:
            mass, pairs, whole = np.zeros((n, k)), np.zeros((n, k, k)), 0.0
            for path in itertools.product(range(k), repeat=int(n)):
                w = math.exp(start[path[0]] + sum(emit[at + t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
                whole += w
                for t, y in enumerate(path):
                    mass[t, y] += w
                    if t:
                        pairs[t, path[t - 1], y] += w
            assert np.allclose(post[at : at + n], mass / whole, atol=1e-4)
            for t in range(1, n):
                got = alpha[at + t - 1][:, None] * np.exp(trans) * beta[at + t][None, :]
                assert np.allclose(got / got.sum(), pairs[t] / whole, atol=1e-4)
            at += n


def plain_ftrl(examples, labels):
    z, n, bias_z, bias_n = {}, {}, 0.0, 0.0
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((b + math.sqrt(n.get(i, 0.0))) / a + l2)

    for _ in range(toxicity.EPOCHS):
        for x, y in zip(examples, labels):
            w = {int(i): weight(int(i)) for i in x}
            bias = -bias_z / ((b + math.sqrt(bias_n)) / a)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()) + bias))))
            g = p - y
            for i, wi in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / a * wi
                n[i] = old + g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / a * bias
            bias_n += g * g
    return {i: weight(i) for i in z if weight(i)}, -bias_z / ((b + math.sqrt(bias_n)) / a)


def test_ftrl_by_a_plain_loop():
    rng = np.random.default_rng(6)
    marks = np.arange(5)
    examples, labels = [], []
    for _ in range(400):
        y = int(rng.random() < 0.4)
        x = np.unique(np.concatenate([rng.integers(10, 400, 30), rng.choice(marks, 2) if y and rng.random() < 0.9 else marks[:0]]))
        examples.append(x)
        labels.append(y)
    got = toxicity.train(examples, np.array(labels, float))
    want, bias = plain_ftrl(examples, labels)
    assert dict(zip(got["at"].tolist(), got["w"].tolist())).keys() == want.keys() and want
    assert all(abs(w - want[i]) < 1e-4 for i, w in zip(got["at"].tolist(), got["w"].tolist())) and abs(got["bias"] - bias) < 1e-9
    assert len(want) < len({int(i) for x in examples for i in x})  # sparse


def full_score(text, item):
    """Smith-Waterman over the whole text, one row of the matrix for each word of the item."""
    row = np.zeros(len(text) + 1, np.int64)
    best = 0
    for w in item:
        new = np.zeros_like(row)
        diagonal = row[:-1] + np.where(text == w, decontaminate.MATCH, -decontaminate.MISS)
        new[1:] = np.maximum(0, np.maximum(diagonal, row[1:] - decontaminate.MISS))
        for j in np.flatnonzero(new[:-1] > decontaminate.MISS):  # gaps along the row
            k, v = j + 1, new[j] - decontaminate.MISS
            while k < len(new) and new[k] < v:
                new[k] = v
                k, v = k + 1, v - decontaminate.MISS
        row = new
        best = max(best, int(row.max()))
    return best


def test_leaks_by_full_alignment(spark, sf):
    """Seeds lose no pair that an alignment of every document with every item accepts."""
    docs = {r["doc_id"]: plain_words(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: plain_words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    codes: dict[bytes, int] = {}
    number = lambda ws: np.array([codes.setdefault(w, len(codes)) for w in ws], np.int64)
    docs, items = {i: number(w) for i, w in docs.items()}, {i: number(w) for i, w in items.items()}
    want = set()
    for i, t in items.items():
        for d, w in docs.items():
            # No alignment scores more than all of the item's words that the text has at all.
            if decontaminate.MATCH * int(np.isin(t, w).sum()) < min(decontaminate.SHARE * decontaminate.MATCH * len(t), decontaminate.MATCH * decontaminate.WORDS):
                continue
            s = full_score(w, t)
            if s >= decontaminate.SHARE * decontaminate.MATCH * len(t) or s >= decontaminate.MATCH * decontaminate.WORDS:
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked_pairs(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert want and got == want

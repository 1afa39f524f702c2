"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, bigrams and skip-grams (one word between), hashed to ``BUCKETS`` places. Each
coordinate has its own learning rate; the L1 term leaves few weights other than zero, so the model that is broadcast is
small, whatever the corpus.

Defined results: a null, empty or wordless text scores the bias alone. Labels other than 0 and 1 are ignored; a document
with several labels counts as toxic if one says so. Repeated rows score alike; rows without an id are scored as well. Without training rows every score is 0.
Input columns that clash with an output's name are replaced. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, blocks, hashed, held_out, map_texts, owners, pair, plain_words, tune

BITS = 20
BUCKETS = 1 << BITS
#: Bound of the training sample: labelled rows, drawn by hash over all labelled rows outside the held-out fold.
MAX_LABELLED = 20_000
#: Bound of what the fit holds: features of all its examples, which are read in an order drawn by hash until it is reached.
MAX_FEATURES = 100_000_000
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 8.0, 0.0, 4


def text_features(texts: list[str | None], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of every word, bigram and skip-gram, repeats included."""
    h, counts = hashed(texts, plain_words, hasher)
    own = owners(counts)
    parts_o, parts_h = [own], [h]
    for gap, salt in ((1, 0x51ED270B0A1F39C1), (2, 0x2545F4914F6CDD1D)):
        if len(h) > gap:
            same = own[gap:] == own[:-gap]
            parts_o.append(own[:-gap][same])
            parts_h.append(pair(h[:-gap][same], h[gap:][same] ^ np.uint64(salt)))
    return np.concatenate(parts_o), (np.concatenate(parts_h) >> np.uint64(64 - BITS)).astype(np.int64)


def train(examples: list[np.ndarray], labels: np.ndarray) -> dict:
    """One weight vector, from examples in the given order, repeated EPOCHS times."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bz = bn = 0.0
    for epoch in range(EPOCHS):
        for x, y in zip(examples, labels):
            zi, ni = z[x], n[x]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            bias = -bz / ((BETA + np.sqrt(bn)) / ALPHA)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            g2 = g * g
            sigma = (np.sqrt(ni + g2) - root) / ALPHA
            z[x] = zi + g - sigma * w
            n[x] = ni + g2
            s = (np.sqrt(bn + g2) - np.sqrt(bn)) / ALPHA
            bz += g - s * bias
            bn += g2
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    at = np.flatnonzero(w)
    return {"at": at.astype(np.int32), "w": w[at].astype(np.float32), "bias": float(-bz / ((BETA + np.sqrt(bn)) / ALPHA))}


class Scorer:
    def __init__(self, model: dict | None):
        self.model = model
        if model:
            self.table = np.zeros(BUCKETS, np.float32)
            self.table[model["at"]] = model["w"]
            self.hasher = WordHasher()

    def __call__(self, texts: list[str | None]) -> list:
        if not self.model:
            return [[0.0] * len(texts), [0] * len(texts)]
        own, bucket = text_features(texts, self.hasher)
        hit = self.table[bucket] != 0
        key = np.unique(own[hit] * BUCKETS + bucket[hit])
        total = np.bincount(key >> BITS, weights=self.table[key & (BUCKETS - 1)].astype(np.float64), minlength=len(texts)) + self.model["bias"]
        p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
        return [p.tolist(), (p >= 0.5).astype(np.int32).tolist()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> dict | None:
    """Learn from labelled rows outside the held-out fold, at most about ``max_labelled`` of them (the bound also
    limits what is broadcast to find their texts) and ``MAX_FEATURES`` features. FTRL is sequential: the fit runs in one task,
    on that sample. Labels without an id are ignored, as are documents without one."""
    tune(docs.sparkSession)
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("_y"))
    total = marked.count()
    if not total:
        return None
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit("label sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = marked.where(draw < min(1.0, max_labelled / total))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_y", "_text")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in blocks(texts):
                own, bucket = text_features(texts[lo:hi], hasher)
                key = np.unique(own * BUCKETS + bucket)
                cuts = np.searchsorted(key, np.arange(1, hi - lo) * BUCKETS)
                packed = [x.astype(np.int32).tobytes() for x in np.split(key & (BUCKETS - 1), cuts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(packed, pa.binary())], ["_id", "_y", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for r in (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())):
            held += len(r[2]) // 4
            if held > MAX_FEATURES and got:
                break
            got.append(r)
        got.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % (1 << 64) if isinstance(r[0], int) else hash(r[0]), r[2]))
        if got:
            m = train([np.frombuffer(r[2], np.int32) for r in got], np.array([r[1] for r in got], float))
            yield pa.RecordBatch.from_arrays([pa.array([m["at"].tobytes()], pa.binary()), pa.array([m["w"].tobytes()], pa.binary()), pa.array([m["bias"]])], ["at", "w", "bias"])

    kind = sample.schema["_id"].dataType.simpleString()
    got = rows.mapInArrow(prepare, f"_id {kind}, _y int, x binary").repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", "x").mapInArrow(run, "at binary, w binary, bias double").collect()
    return {"at": np.frombuffer(got[0]["at"], np.int32), "w": np.frombuffer(got[0]["w"], np.float32), "bias": got[0]["bias"]} if got else None


def score(docs: DataFrame, model: dict | None, text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    outs = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_texts(docs, text_col, docs.columns if carry is None else carry, outs, lambda: Scorer(shared.value))

"""SimHash document fingerprints and permuted block tables.

A text's terms are its words and its pairs of neighbouring words. Every distinct term votes on ``BITS`` signed bits by its
hash, with an integer weight that grows with the logarithm of its count; pairs weigh more than words, which texts of one
language share. The sign of each sum is a bit of the fingerprint, written as hex digits.

Search within a Hamming radius: a fingerprint's digits are cut into ``BLOCKS`` blocks, as even as they can be. Two fingerprints that differ in at most
``radius`` bits agree in at least ``BLOCKS - radius`` whole blocks, so each choice of that many blocks is a table whose key
moves those blocks to the front; a search looks up every table and verifies what it finds. A pair is reported by the
first table that holds it. Equal fingerprints are one entry with a count, so copies are never expanded into pairs.

Likeness of two fingerprints: cos(pi * differing bits / BITS), an estimate of the cosine of the weighted terms, not below 0.

Defined results: a null text counts as empty; a text without words has the fingerprint of no votes (all bits 0). Equal
texts have equal fingerprints. Rows are ordered by id, null ids last, ties by text. A single row is its own successor. An
empty table gives no rows. Texts are read whole. Input columns that clash with an output's name are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, blocks, hashed, map_texts, mix, owners, pair, plain_words, stored, tune

BITS = 128
BLOCKS, RADIUS = 7, 6
WORD_WEIGHT, PAIR_WEIGHT = 1, 4
#: Weights are integers, this many for a word that occurs once, so sums are exact and depend on the text alone.
UNIT = 16
#: A term in one 64-bit number: the text's place among those at hand, whether it is a pair, and the rest of its hash.
_TEXT_BITS, _HASH_BITS = 12, 51
#: Texts whose histograms are made at once; they fit a processor's cache.
_TEXTS = 128


class Fingerprinter:
    """Fingerprints of texts as bytes."""

    def __init__(self):
        self.hasher = WordHasher()

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        return [x for lo in range(0, len(texts), _TEXTS) for x in self._some(texts[lo : lo + _TEXTS])]

    def _some(self, texts: Sequence[str | None]) -> list[bytes]:
        h, counts = hashed(texts, plain_words, self.hasher)
        text = owners(counts).astype(np.uint64) << np.uint64(64 - _TEXT_BITS)
        cut, pairs = np.uint64(64 - _HASH_BITS), np.uint64(1 << _HASH_BITS)
        terms = text | h >> cut
        if len(h) > 1:
            inner = text[1:] == text[:-1]
            terms = np.concatenate([terms, text[1:][inner] | pairs | pair(h[:-1][inner], h[1:][inner]) >> cut])
        terms.sort()
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(terms)))
        terms = terms[first]
        w = np.rint(UNIT * (1 + np.log2(n))) * np.where(terms & pairs, PAIR_WEIGHT, WORD_WEIGHT)
        row = (terms >> np.uint64(64 - _TEXT_BITS)).astype(np.int64) << 8
        own = terms << np.uint64(_TEXT_BITS)
        votes = np.empty((len(texts), BITS))
        for lane in range(BITS // 64):
            # How often, by weight, each value of a byte occurs. The halves of this histogram differ by the votes of the
            # byte's highest bit; added up, they are the histogram of the bits that are left.
            octets = mix(own + np.uint64(lane + 1)).astype(">u8").view(np.uint8).reshape(-1, 8)
            for k in range(8):
                histogram = np.bincount(row | octets[:, k], w, len(texts) << 8).reshape(-1, 256)
                for bit in range(64 * lane + 8 * k, 64 * lane + 8 * k + 8):
                    unset, set_ = np.hsplit(histogram, 2)
                    histogram = unset + set_
                    votes[:, bit] = set_.sum(1) - unset.sum(1)
        return [bytes(x) for x in np.packbits(votes > 0, axis=1)]


def likeness(a: bytes, b: bytes) -> float:
    differ = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, float(np.cos(np.pi * differ / BITS)))


def fingerprints(docs: DataFrame, text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Add ``fingerprint`` (hex)."""

    def make():
        finger = Fingerprinter()
        return lambda texts: [[x.hex() for x in finger(texts)]]

    return map_texts(docs, text_col, docs.columns if carry is None else list(carry), [T.StructField("fingerprint", T.StringType())], make)


def tables(blocks_: int = BLOCKS, radius: int = RADIUS) -> list[tuple[int, ...]]:
    """The block choices that are the tables' keys."""
    return list(combinations(range(blocks_), blocks_ - radius))


def within_radius(queries: DataFrame, entries: DataFrame, radius: int = RADIUS, blocks_: int = BLOCKS) -> DataFrame:
    """(fingerprint, other, n, distance): for each distinct fingerprint of ``queries`` every distinct fingerprint of
    ``entries`` within the radius, itself included, with its number of rows. Both tables: a column fingerprint (hex)."""
    if not 0 <= radius < blocks_:
        raise ValueError("the radius must be below the number of blocks")
    cuts = [BITS // 4 * b // blocks_ for b in range(blocks_ + 1)]
    choices = tables(blocks_, radius)

    def part(col, b):
        return F.substring(col, cuts[b] + 1, cuts[b + 1] - cuts[b])

    def half(col, k):
        hi, lo = F.conv(F.substring(col, 16 * k + 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(col, 16 * k + 9, 8), 16, 10).cast("bigint")
        return F.shiftleft(hi, 32).bitwiseOR(lo)

    lanes = [f"l{k}" for k in range(BITS // 64)]

    def digits(side):
        return F.concat(*[F.lower(F.lpad(F.hex(F.col(f"{side}.{x}")), 16, "0")) for x in lanes])

    def keyed(df, extra):
        keys = F.array(*[F.xxhash64(F.lit(i), *[part(F.col("fingerprint"), b) for b in c]) for i, c in enumerate(choices)])
        return df.select(*[half(F.col("fingerprint"), k).alias(x) for k, x in enumerate(lanes)], *extra, F.posexplode(keys).alias("t", "key"))

    q = keyed(queries.where("fingerprint is not null").select("fingerprint").distinct(), [])
    e = keyed(entries.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n")), ["n"])
    a, b = q.alias("a"), e.alias("b")
    distance = " + ".join(f"bit_count(a.{x} ^ b.{x})" for x in lanes)
    got = a.join(b, F.expr(f"a.key = b.key and a.t = b.t and {distance} <= {radius}"))
    got = got.select(digits("a").alias("fingerprint"), digits("b").alias("other"), F.col("b.n").alias("n"), F.expr(distance).alias("distance"), F.col("a.t").alias("t"))
    # The blocks that agree give the first table that holds the pair.
    same = F.array(*[F.when(part(F.col("fingerprint"), x) == part(F.col("other"), x), F.lit(x)) for x in range(blocks_)])
    first = F.slice(F.array_compact(same), 1, blocks_ - radius)
    mine = F.element_at(F.array(*[F.array(*[F.lit(x) for x in c]) for c in choices]), F.col("t") + 1)
    return got.where(first == mine).drop("t")


_PAIRS = "_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, role string, text string"


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text, whose last half is replaced by the first half of the next document.

    Documents are range-partitioned by id (ties by text), so no task holds them all; the last document of a partition
    and the first of the next one meet in a second step, which moves two texts a partition.
    """
    tune(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), body.alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.select("_id", F.col("_id").isNull().alias("_null"), F.xxhash64("_text").alias("_hash"), "_row", "_text")
    order = ["_null", "_id", "_hash", "_row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")

    def compare(ids: list, texts: list[str], finger: Fingerprinter) -> list[list]:
        """Rows for all texts but the last."""
        edited = []
        for t, nxt in zip(texts, texts[1:]):
            half = len(t) // 2
            edited.append(t[: len(t) - half] + nxt[:half])
        own, other = finger(texts), finger(edited)
        m = len(edited)
        sums = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]
        return [ids[:m], [len(t) for t in texts[:m]], sums, [x.hex() for x in own[:m]], [x.hex() for x in other], [likeness(a, b) for a, b in zip(own, other)], [likeness(a, b) for a, b in zip(own, own[1:])]]

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string())
    names = [x.split()[0] for x in _PAIRS.split(", ")]

    def batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, finger = TaskContext.get().partitionId(), Fingerprinter()
        last: tuple | None = None
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            if last is None and texts:
                yield batch([[ids[0]], *[[None]] * 6, [part], ["first"], [texts[0]]])
            for lo, hi in blocks(texts):
                i, t = ids[lo:hi], texts[lo:hi]
                if last is not None:
                    i, t = [last[0], *i], [last[1], *t]
                last = i[-1], t[-1]
                if len(t) > 1:
                    done = compare(i, t, finger)
                    m = len(done[0])
                    yield batch([*done, [part] * m, ["done"] * m, [None] * m])
        if last is not None:
            yield batch([[last[0]], *[[None]] * 6, [part], ["last"], [last[1]]])

    made = stored(ordered.mapInArrow(run, _PAIRS), "edited")
    ends = sorted(r[0] for r in made.where("role = 'first'").select("part").collect())  # one number a partition
    follows = {p: ends[(i + 1) % len(ends)] for i, p in enumerate(ends)}
    pairs = docs.sparkSession.createDataFrame(list(follows.items()) or [(-1, -1)], "part int, next int")
    joints = made.where("role = 'last'").select("part", F.col("_id"), F.col("text")).join(F.broadcast(pairs), "part")
    # Two texts a partition: shuffled, since a text has no bound.
    joints = joints.join(made.where("role = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text")).hint("merge"), "next").select("_id", "text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finger = Fingerprinter()
        for b in batches:
            for i, t, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                done = compare([i, None], [t, n], finger)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds)], names[:7])

    rest = joints.mapInArrow(finish, ", ".join(_PAIRS.split(", ")[:7]))
    out = made.where("role = 'done'").select(*names[:7]).unionByName(rest)
    return out.withColumnRenamed("_id", id_col)


def neighbour_counts(prints: DataFrame, id_col: str = "doc_id", every: int = 50, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, n_near): for the fingerprints of rows whose id is divisible by ``every``, how many rows lie within the
    radius, themselves included."""
    queries = prints.where(F.col(id_col) % every == 0)
    return within_radius(queries, prints, radius).groupBy("fingerprint").agg(F.sum("n").alias("n_near"))

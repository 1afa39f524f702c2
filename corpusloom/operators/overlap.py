"""Verbatim overlap of documents with a reference set: word n-grams, residue hits, maximal runs and exemptions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusloom.functions import text as T
from corpusloom.functions.arrow import bound_batches
from corpusloom.functions.grams import Grams, chunks, greedy_runs, words

from .lines import unit_array

NGRAM = 13
#: Rows up to which a side is broadcast; beyond it Spark joins by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def gram_arrays(docs: DataFrame, n: int = NGRAM, id_col: str | None = None, text_col: str = "text") -> DataFrame:
    """([id], grams): the hash of the n-gram at each word of a text, in one pass."""
    bound_batches(docs.sparkSession)
    carry = [id_col] if id_col else []
    schema = ST.StructType([*[docs.schema[c] for c in carry], ST.StructField("grams", ST.ArrayType(ST.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(n)
        for b in batches:
            texts = b.column(len(carry)).to_pylist()
            for part in chunks(texts):
                got = grams([words(t) for t in texts[part]])
                made = pa.ListArray.from_arrays(np.cumsum([0, *map(len, got)]).astype(np.int32), np.concatenate(got))
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(part.start, part.stop - part.start) for i in range(len(carry))], made], [*carry, "grams"])

    return docs.select(*carry, F.col(text_col).cast("string")).mapInArrow(run, schema)


def reference_grams(reference: DataFrame, n: int = NGRAM, text_col: str = "text") -> DataFrame:
    return gram_arrays(reference, n, None, text_col).select(F.explode("grams").alias("gram")).distinct()


def residue_hits(docs: DataFrame, reference: DataFrame, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos): the words at which an n-gram of the reference begins. Grams are compared by 64-bit hashes, so a document
    row carries 8 bytes a word through the join and no text; with a small reference nothing is shuffled."""
    grams = gram_arrays(docs, n, id_col, text_col).select(id_col, F.posexplode("grams").alias("pos", "gram"))
    return grams.join(small(reference_grams(reference, n, text_col)), "gram", "left_semi").select(id_col, "pos")


def residue_runs(docs: DataFrame, reference: DataFrame, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, run, exemption): the shared runs as text, and why one may stay (null: it may not). Only documents with
    hits are read again."""
    at = residue_hits(docs, reference, n, id_col, text_col).groupBy(id_col).agg(F.sort_array(F.collect_set("pos")).alias("at"))
    found = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(at, id_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for k, (text, places) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                own = words(text)
                for lo, hi in greedy_runs(places, n):
                    for c, v in zip(rows, (k, lo, hi, " ".join(own[lo:hi]))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.string())], [id_col, "start", "end", "run"])

    got = found.select(id_col, "_text", "at").mapInArrow(run, f"`{id_col}` {kind}, start int, end int, run string")
    return got.select(id_col, "start", "end", "run", T.exemption(F.col("run")).alias("exemption"))


def prose_for_grams(text: Column) -> Column:
    """The prose of a text, without what a rewrite has to keep anyway."""
    return T.preserved_removed(F.array_join(F.transform(unit_array(text), lambda u: u["text"]), "\n"))


def units_for_grams(text: Column) -> Column:
    return F.transform(unit_array(text), lambda u: T.preserved_removed(u["text"]))


def left_over(source: str, units: list[str], grams: Grams) -> list[str]:
    """The runs that each unit shares with the source."""
    known = grams([words(source)])[0]
    own = [words(u) for u in units]
    runs = []
    if len(known):
        for w, g in zip(own, grams(own)):
            at = np.flatnonzero(np.isin(g, known)).tolist() if len(g) else []
            runs += [" ".join(w[lo:hi]) for lo, hi in greedy_runs(at, grams.n)]
    return runs


def length_ratio(source: Column, working: Column) -> Column:
    """Words of the working text by words of the source, 0 where that has none."""
    return F.bround(F.coalesce(F.try_divide(T.word_count(working), T.word_count(source)), F.lit(0.0)), 3)


def remaining(runs: Column) -> Column:
    """How many of an array's runs no exemption lets stay."""
    return F.size(F.filter(runs, lambda r: T.exemption(r).isNull())).cast("bigint")


def gate_b(pairs: DataFrame, n: int = NGRAM) -> DataFrame:
    """(path, ratio, runs_remaining, passed) of (path, source, working): no prose run of n words may be left over.

    Runs are searched in each prose unit of the working text, against all prose of the source, within the pair's row."""
    bound_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(n)
        for b in batches:
            runs = [left_over(s, u, grams) for s, u in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(runs, pa.list_(pa.string()))], ["path", "ratio", "runs"])

    rows = pairs.select("path", length_ratio(F.col("source"), F.col("working")).alias("ratio"), prose_for_grams(F.col("source")).alias("prose"), units_for_grams(F.col("working")).alias("units"))
    schema = ST.StructType([pairs.schema["path"], ST.StructField("ratio", ST.DoubleType()), ST.StructField("runs", ST.ArrayType(ST.StringType()))])
    got = rows.mapInArrow(run, schema).select("path", "ratio", remaining(F.col("runs")).alias("runs_remaining"))
    return got.withColumn("passed", F.col("runs_remaining") == 0)

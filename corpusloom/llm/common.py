"""Helpers shared by the operators of this subpackage.

Python passes run as ``mapInArrow``: columns stay Arrow buffers, texts are tokenised in blocks of bounded
size, and all arithmetic on words is vectorised. Nothing here collects rows to the driver.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a text column that cross to Python at once. Texts average kilobytes, so batches stay at a few MB.
ROWS_PER_BATCH = 1000
#: Characters tokenised at once by one worker; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000
FOLDS = 5

_ASCII_SPACE_PUNCT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python passes, unless the session already has a smaller bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, which only a session on
    this machine alone may use."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the application ends."""
    sc = spark.sparkContext
    where = f"{shared_dir(spark)}/corpusloom-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def free_name(taken: Sequence[str], name: str) -> str:
    """A column name that clashes, in either case, with none of ``taken``."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the columns whose names an operator's outputs need (Spark compares names without case)."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with the columns that an operator's outputs would replace under other names, and its columns as they were."""
    low, new = {n.lower() for n in names}, {}
    for c in df.columns:
        new[c] = free_name([*df.columns, *names, *new.values()], c) if c.lower() in low else c
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), [F.col(f"`{n}`").alias(c) for c, n in new.items()]


def blocks(texts: Sequence[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` characters, or one longer text."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    docs: DataFrame, text_col: str, carry: Sequence[str], outputs: Sequence[T.StructField], make: Callable[[], Callable[[list], list]]
) -> DataFrame:
    """Add columns computed from whole texts, in one pass without a shuffle.

    ``make()`` runs once in each task and gives a function from a list of texts to the output columns
    (Arrow arrays or lists, one value a text). ``carry``: the input columns that come along; one that clashes with an
    output is left out.
    """
    tune(docs.sparkSession)
    low = {f.name.lower() for f in outputs}
    carry = [c for c in carry if c.lower() not in low]
    text = free_name([*carry, *low], "_text")
    schema = T.StructType([docs.schema[c] for c in carry] + list(outputs))
    types = [_arrow_type(f.dataType) for f in outputs]
    names = [*carry, *[f.name for f in outputs]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            texts = b.column(len(carry)).to_pylist()
            for lo, hi in blocks(texts):
                cols = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(step(texts[lo:hi]), types)]
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(lo, hi - lo) for i in range(len(carry))], *cols], names)

    return docs.select(*[docs[f"`{c}`"] for c in carry], docs[f"`{text_col}`"].cast("string").alias(text)).mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind])
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}[kind.simpleString()]


def space_words(text: str | None) -> list[bytes]:
    r"""Lower-cased (A-Z only) words ``[^\x20\x09-\x0D]+``; bytes.split() has just these separators."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_ASCII_SPACE_PUNCT).split() if text else []


class WordHasher:
    """Words to 64-bit hashes. Nothing is remembered: a corpus has millions of words, and finding one among many in memory
    takes longer than hashing it."""

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def hashed(texts: Sequence[str | None], split: Callable, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and the number of words of each text."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = split(t)
        counts[i] = len(w)
        words += w
    return hasher.array(words), counts


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered combination of two arrays of hashes."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(23)) | (b >> np.uint64(41))))


def owners(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def shingle2(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each text's distinct 2-word shingles, sorted; a one-word text has its word as one shingle."""
    own = owners(counts)
    keep = np.zeros(len(h), bool)
    sh = np.zeros(len(h), np.uint64)
    if len(h) > 1:
        keep[:-1] = own[1:] == own[:-1]
        sh[:-1] = pair(h[:-1], h[1:])
    at = (np.cumsum(counts) - counts)[counts == 1]
    keep[at], sh[at] = True, mix(h[at] + np.uint64(1))
    so, sh = own[keep], sh[keep]
    cuts = np.append(np.flatnonzero(np.diff(so, prepend=-1)), len(so)).tolist()
    for lo, hi in zip(cuts, cuts[1:]):
        sh[lo:hi].sort()
    if len(so):
        first = np.ones(len(so), bool)
        first[1:] = (so[1:] != so[:-1]) | (sh[1:] != sh[:-1])
        so, sh = so[first], sh[first]
    return so, sh


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group, without a task that sees a whole group.

    ``bucket`` holds integers that rise with ``order`` within a group. Buckets are summed first (a map-side
    combine); the sums are accumulated over the few buckets of a group, and rows only within their own bucket.
    """
    from pyspark.sql import Window as W

    total, before = free_name(df.columns, "_bucket_sum"), free_name(df.columns, "_bucket_before")
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias(total))
    w = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*group, bucket, F.coalesce(F.sum(total).over(w), F.lit(0)).alias(before))
    inner = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(sums, [*group, bucket]).withColumn(out, F.col(out) + F.col(before)).drop(before)


def ordered_table(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` written in global order, with ``_p`` (the partition, in order) and ``_n`` (the row's number within it)."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return stored(rows.withColumns({"_p": F.shiftright(number, 33).cast("int"), "_n": number.bitwiseAND((1 << 33) - 1)}), name)


def lookup(values: dict[int, int], key: Column, default: int = 0) -> Column:
    """A table with one number for each partition, as one literal."""
    if not values:
        return F.lit(default).cast("bigint")
    listed = F.split(F.lit(",".join(str(int(values.get(i, default))) for i in range(max(values) + 1))), ",").cast("array<bigint>")
    return F.coalesce(F.try_element_at(listed, (key + 1).cast("int")), F.lit(default).cast("bigint"))


def numbered(df: DataFrame, order: Sequence[str], out: str, name: str, weight: Column | None = None) -> DataFrame:
    """Number the rows 0, 1, ... in global order, or by the sum of the weights before each; only one number for each
    partition reaches the driver."""
    from pyspark.sql import Window as W

    got = ordered_table(df, order, name)
    total = F.count("*") if weight is None else F.sum(weight)
    sums = {r[0]: r[1] for r in got.groupBy("_p").agg(total).collect()}
    base, before = {}, 0
    for p in sorted(sums):
        base[p] = before
        before += sums[p]
    own = F.col("_n") if weight is None else F.coalesce(F.sum(weight).over(W.partitionBy("_p").orderBy("_n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return got.withColumn(out, lookup(base, F.col("_p")) + own).drop("_p", "_n")


#: Keys with more than this share of all rows are hot; there can be no more of them than its inverse.
HOT_SHARE = 1 / 256


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, columns: Sequence[str], look: bool = False) -> DataFrame:
    """Inner join of ``rows`` with a table that has each key once and its number of rows. The few hot keys are broadcast, so
    their rows are never shuffled; the rest is joined by a shuffle. Adds ``columns`` of the table.

    ``look``: the table is a stored one, so it is cheap to see first whether there are hot keys; without them the plan is a
    plain join, which keeps the driver's plans small."""
    bound = max(1, int(total * HOT_SHARE))
    slim = table.select(key, count, *columns)
    hot, cold = slim.where(F.col(count) > bound).drop(count), slim.where(F.col(count) <= bound).drop(count)
    if look and not hot.limit(1).count():
        return rows.join(slim.drop(count), key)
    flags = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(flags, key, "left_anti").join(cold, key))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is a number of words. Complete epochs over the source come first; what then remains of the target is
filled by a weighted sample without replacement: every document draws the key ``-ln(u) / weight`` (u from a hash of its
id, weight from its quality), documents are sorted by the key within their source, and a prefix sum of sizes selects
them until the budget is reached. The document at the border is taken in part, so the budget is met to the word.

Nothing gathers a source: sizes are summed by a map-side combine, and the prefix sum runs over buckets of the key
(``running_sum``), of which a source has as many as its size asks for. Only the table of sources, one row each, passes
through one task.

Defined results: a null text has size 0. A null source is a source of its own, last in order. Rows that repeat an id are
documents of their own with the same key; ties of the key go to the smaller id, then the smaller size. A source without
words has target 0. Null, zero and negative weights count as the neutral weight. A null id draws a key as well. An empty
table gives no rows. Input columns that clash with an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, hot_join, running_sum, stored, tune, without

SHARES = (5, 2, 1)
MOST_EPOCHS = 3
#: Quality label to sampling weight; documents without a label have weight 1.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}
#: Rows of one bucket of the prefix sum, on average.
BUCKET_ROWS = 20_000
#: A bucket is a share of the mean distribution of keys over these weights, so none holds more than 2 * 9 times its part of
#: the documents whose weights lie among them.
BUCKET_WEIGHTS = tuple(2.0**k for k in range(-4, 5))
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 100_000
OUTPUTS = ("size", "source_size", "target", "taken")


@F.arrow_udf(T.LongType())
def _n_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(t.split()) if t else 0 for t in texts.to_pylist()], pa.int64())


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+``, which bytes.split() counts in a third of the time that a regular expression takes."""
    return _n_words(text.cast("string").cast("binary"))


def uniform(id_: Column) -> Column:
    """A draw from (0, 1) that depends on the id alone: 52 bits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, shares: Sequence[int] = SHARES, most: int = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to a table (source, source_size, ...) with one row for each source.

    Sources share the sum of all sizes by their weights. With caps of ``most`` times a source's size, reshared by weight
    until none is above, a source gets min(cap, level * weight): sources whose cap is reached at a lower level than that
    of the rest are capped, and the level follows from prefix sums in order of cap / weight.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(int(x)) for x in shares])
    s = sizes.withColumn("_w", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(shares) + 1).cast("int")).cast("bigint"))
    s = s.withColumn("_cap", F.col("source_size") * most)
    by_level = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weight_left = F.sum("_w").over(W.partitionBy()) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    # The level if just the sources before this one are capped; the first that holds without capping this one counts.
    s = s.withColumn("_level", rest.cast("double") / weight_left.cast("double"))
    s = s.withColumn("_at", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")))
    level = F.first("_at", ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("_final", level)
    got = F.when(F.col("_final").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_final") * F.col("_w")))
    return s.withColumn("target", got).drop("_w", "_cap", "_level", "_at", "_final")


def mix(
    docs: DataFrame, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    shares: Sequence[int] = SHARES, most: int = MOST_EPOCHS, carry: Sequence[str] | None = None, size: Column | None = None,
) -> DataFrame:
    """Add size, source_size, target and taken (words the mix takes of the document, repeats counted). ``size``: an expression
    of the documents' sizes if they are known."""
    tune(docs.sparkSession)
    names = docs.columns if carry is None else list(carry)
    kept = without(docs.select(*[docs[f"`{c}`"] for c in names]), OUTPUTS).columns
    inner = [free_name(docs.columns, f"_c{i}") for i in range(len(kept))]
    w = F.coalesce(weight.cast("double"), F.lit(1.0)) if weight is not None else F.lit(1.0)
    w = F.when(w > 0, w).otherwise(F.lit(1.0))
    base = docs.select(
        *[docs[f"`{c}`"].alias(n) for c, n in zip(kept, inner)],
        docs[f"`{id_col}`"].alias("_id"), docs[f"`{source_col}`"].cast("string").alias("source"), (word_count(docs[f"`{text_col}`"]) if size is None else size).alias("size"),
        (-F.log(uniform(docs[f"`{id_col}`"])) / w).alias("_key"),
    )
    base = stored(base, "mix")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    targets = stored(source_targets(sizes, shares, most), "targets")
    buckets = targets.select(F.col("source").alias("_s"), "_rows", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("_rows") / BUCKET_ROWS)).alias("_buckets"))
    name = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    buckets, base = buckets.withColumn("_source", name(F.col("_s"))).drop("_s"), base.withColumn("_source", name(F.col("source")))
    if targets.count() <= BROADCAST_SOURCES:
        joined = base.join(F.broadcast(buckets), "_source")
    else:
        joined = hot_join(base, buckets, "_source", "_rows", base.count(), ["source_size", "target", "_buckets"])
    spread = sum((1 - F.exp(-F.col("_key") * w) for w in BUCKET_WEIGHTS), F.lit(0.0)) / len(BUCKET_WEIGHTS)
    joined = joined.withColumn("_bucket", F.floor(spread * F.col("_buckets")).cast("bigint"))
    summed = running_sum(joined, ["_source"], ["_key", "_id", "size"], "_bucket", "size", "_before")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    budget = F.floor(F.col("target") - epochs * F.col("source_size")).cast("bigint")
    extra = F.least(F.col("size"), F.greatest(F.lit(0), budget - F.col("_before")))
    out = summed.withColumn("taken", (epochs * F.col("size") + extra).cast("bigint"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, inner)], *OUTPUTS)


def quality_of(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """(id, _weight): one row for each labelled document; of several labels the best counts."""
    weight = F.lit(None).cast("double")
    for q, x in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("_q") == q, F.lit(x)).otherwise(weight)
    best = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_labelled")).agg(F.max(quality_col).alias("_q"))
    return best.select("_labelled", weight.alias("_weight"))


def mix_with_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", carry: Sequence[str] | None = None, **options) -> DataFrame:
    """``mix`` with weights by the labels' quality. Texts don't cross the join: only their sizes do."""
    names = docs.columns if carry is None else list(carry)
    text_col, source_col = options.pop("text_col", "text"), options.get("source_col", "source")
    size = free_name(docs.columns, "_size")
    q = quality_of(labels, id_col)
    slim = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, id_col, source_col])], word_count(docs[f"`{text_col}`"]).alias(size))
    joined = slim.join(q.hint("merge"), slim[f"`{id_col}`"] == q["_labelled"], "left")
    return mix(joined, F.col("_weight"), id_col, text_col, carry=names, size=F.col(size), **options)

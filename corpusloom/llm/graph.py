"""Connected components by alternating large-star and small-star steps.

Every step is an aggregate (combined before its shuffle) and a join with one row for each node. Hubs, of which there can be
few, are broadcast in it (``hot_join``), so a hub's edges stay where they are; the number of rounds is logarithmic in
practice. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge to another one.

    Self-loops and edges with a null end are ignored; repeated edges count once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("_ok"))
    e = stored(e.where(F.col("_ok") & (F.col("u") != F.col("v"))).select("u", "v").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = hot_join(both.where("v > u"), stored(low, "low"), "u", "n", 2 * mark[0], ["m"], look=True).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        low2 = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        joined = hot_join(large, low2, "u", "n", 2 * mark[0], ["m"], look=True)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        e = stored(small, "edges")
        new = _mark(e)
        if new == mark:
            break
        mark = new
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]

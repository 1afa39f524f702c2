"""Rewrites of documents: normalised submissions, their check against the packets that were asked for, and the gated writer."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import arrow
from corpusloom.functions import text as T

from .lines import splice
from .protected import all_gates

ITEM = "array<struct<i: int, cell: int, text: string>>"


def load_rewrites(rows: DataFrame, column: str = "json", id_col: str = "doc_id") -> DataFrame:
    """(id, ord, i, cell, text) of JSON in any of its forms: an object with ``items``, a list, or whole lines by number."""

    def items(text: str | None) -> list[dict]:
        got = json.loads(text or "")
        if isinstance(got, dict) and "items" in got:
            got = got["items"]
        if isinstance(got, dict):
            return [{"i": int(k), "cell": None, "text": v} for k, v in got.items()]
        if not isinstance(got, list):
            raise ValueError("rewrites are an object with items, a list, or lines by number")
        return [{"i": x["i"], "cell": x.get("cell"), "text": x["text"]} for x in got]

    read = arrow.udf(lambda s: s.map(items), ITEM)
    return rows.select(id_col, F.posexplode(read(F.col(column))).alias("ord", "r")).select(id_col, "ord", "r.i", "r.cell", "r.text")


def packet_errors(packets: DataFrame, rewrites: DataFrame, banned: Sequence[str] = (), id_col: str = "doc_id") -> DataFrame:
    """(id, ord, error): what is wrong with rewrites (id, ord, i, cell, text) of packets (id, i, cell): another count, another
    key or order at a place, a key given twice, a banned phrase. Packets are numbered by line and cell, from 0."""
    w = W.partitionBy(id_col).orderBy("i", F.coalesce("cell", F.lit(-1)))
    p = packets.select(id_col, "i", "cell", (F.row_number().over(w) - 1).alias("ord"))
    r = rewrites.withColumn("_again", F.row_number().over(W.partitionBy(id_col, "i", "cell").orderBy("ord")) > 1)
    x, y = p.alias("p"), r.alias("r")
    both = x.join(y, (F.col(f"p.{id_col}") == F.col(f"r.{id_col}")) & (F.col("p.ord") == F.col("r.ord")), "full_outer")
    error = (
        F.when(F.col("r.ord").isNull() | F.col("p.ord").isNull(), "another count")
        .when(F.col("r._again"), "a key twice")
        .when(~(F.col("p.i").eqNullSafe(F.col("r.i")) & F.col("p.cell").eqNullSafe(F.col("r.cell"))), "another key or order")
        .when(T.has_banned(F.col("r.text"), banned) if banned else F.lit(False), "a banned phrase")
    )
    got = both.select(F.coalesce(f"p.{id_col}", f"r.{id_col}").alias(id_col), F.coalesce("p.ord", "r.ord").alias("ord"), error.alias("error"))
    return got.where("error is not null")


def gated_write(docs: DataFrame, packets: DataFrame, rewrites: DataFrame, faction: int = 2, banned: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, written, reason): documents with their rewrites spliced in where the submission fits its packet and all gates
    pass; else the text as it was. Documents without a rewrite are left out."""
    bad = packet_errors(packets, rewrites, banned, id_col).groupBy(id_col).agg(F.min("error").alias("_error"))
    asked = docs.join(rewrites.select(id_col).distinct(), id_col, "left_semi").select(id_col, F.col(text_col).alias("source"))
    new = splice(asked, rewrites, id_col, "source").select(id_col, F.col("text").alias("working"))
    pairs = asked.join(new, id_col).withColumnRenamed(id_col, "path")
    gates = all_gates(pairs, faction).select(F.col("path").alias(id_col), "passed", F.concat_ws(",", *[F.when(~F.col(g), F.lit(g)) for g in ("gate_a", "gate_b", "gate_c")]).alias("_failed"))
    got = asked.join(new, id_col).join(gates, id_col).join(bad, id_col, "left")
    ok = F.col("_error").isNull() & F.col("passed")
    reason = F.coalesce("_error", F.when(~F.col("passed"), F.col("_failed")))
    return got.select(id_col, F.when(ok, F.col("working")).otherwise(F.col("source")).alias("text"), ok.alias("written"), reason.alias("reason"))

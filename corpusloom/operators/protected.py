"""Protected tokens (code, inline code, links, identifiers, numbers) and the gates that check a rewrite keeps them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusloom.functions import text as T
from corpusloom.functions.arrow import bound_batches
from corpusloom.functions.grams import Grams

from .lines import cleaned, code_of, line_array, open_lines, open_of
from .overlap import left_over, length_ratio, prose_for_grams, remaining, units_for_grams

HARD = ("ident", "url", "inline", "code")
UNITS = "%|px|fps|[kMG]?Hz|[mnuµ]?s|[KMGTk]B|dB(?:FS)?|bits?|bytes?|mm|cm|m|x"
#: Category to (pattern, group). What can't be given back is matched possessively, which spares most of the search.
PATTERNS = {
    "inline": ((r"`([^`\n]+)`", 1),),
    "url": ((r"""https?:/{2}[^)>}\]"'\s]+""", 0), (r"\]\(\s*([^\s)]+)", 1)),
    "ident": ((r"\b[a-zA-Z][0-9a-z]++(?:[A-Z][0-9a-z]+)+[0-9A-Za-z]*\b", 0), (r"\b[A-Z][0-9A-Z]*+(?:_[0-9A-Z]+)+\b", 0), (r"\b[_A-Za-z]\w*+(?:::\w+)+\b", 0)),
    "num": ((rf"(?=[0-9])(?<![.\w])[0-9][0-9,]*(?:[.][0-9]+)?(?:[\s]?(?:{UNITS})\b)?", 0),),
}


#: What a text must hold for a pattern to match at all; looking for it is cheap.
NEEDED = {p: mark for kinds, marks in (("inline", "`"), ("url", ("://", "](")), ("ident", (None, "_", "::"))) for (p, _), mark in zip(PATTERNS[kinds], marks) if mark}


def _found(category: str, prose: Column) -> Column:
    none = F.array().cast("array<string>")
    parts = [F.when(F.contains(prose, F.lit(NEEDED[p])), F.regexp_extract_all(prose, F.lit(p), F.lit(g))).otherwise(none) if p in NEEDED else F.regexp_extract_all(prose, F.lit(p), F.lit(g)) for p, g in PATTERNS[category]]
    got = F.concat(*parts) if len(parts) > 1 else parts[0]
    if category == "url":
        got = F.filter(F.transform(got, lambda u: F.btrim(u, F.lit("<>"))), lambda u: ~u.startswith("#"))
    return F.transform(got, T.strip) if category in ("inline", "num") else got


def token_arrays(text: Column) -> Column:
    """The protected tokens of a text: array of (category, t), the tokens of each category with their repeats."""

    def of(prose, lines):
        plain = F.when(F.contains(prose, F.lit("\\")), F.regexp_replace(prose, r"[\\]([`.#~*\[\]()_])", "$1")).otherwise(prose)
        code = F.filter(F.transform(code_of(lines), lambda c: T.strip(c)), lambda c: c.isNotNull() & (c != ""))
        each = lambda p: F.array(*[F.struct(F.lit(c).alias("category"), _found(c, p).alias("t")) for c in PATTERNS], F.struct(F.lit("code").alias("category"), code.alias("t")))
        return T.let(plain, each)

    return T.let(line_array(text), lambda a: T.let(open_of(a), lambda prose: of(prose, a)))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, category, token, n): the multiset of protected tokens of each document."""
    words = docs.select(id_col, F.inline(token_arrays(F.col(text_col)))).select(id_col, "category", F.explode("t").alias("token"))
    return words.groupBy(id_col, "category", "token").agg(F.count("*").alias("n"))


def differences(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset differences both ways: keys with ``lost`` and ``added`` counts, of tables keys + n."""
    both = before.withColumnRenamed("n", "_b").join(after.withColumnRenamed("n", "_a"), keys, "full_outer")
    b, a = F.coalesce("_b", F.lit(0)), F.coalesce("_a", F.lit(0))
    return both.select(*keys, F.greatest(b - a, F.lit(0)).alias("lost"), F.greatest(a - b, F.lit(0)).alias("added")).where("lost > 0 or added > 0")


def _changed(before: list[dict], after: list[dict]) -> list[dict]:
    """(category, token, lost, added) of two texts' tokens. A lost identifier or number that the new text has within a code
    span counts as kept."""
    was, now = ({x["category"]: Counter(x["t"]) for x in side} for side in (before, after))
    wrapped = " ".join([*now["inline"], *now["code"]])
    out = []
    for c in was:
        lost, added = was[c] - now[c], now[c] - was[c]
        if c in ("ident", "num"):
            lost = Counter({t: n for t, n in lost.items() if t not in wrapped})
        out += [{"category": c, "token": t, "lost": lost[t], "added": added[t]} for t in sorted({*lost, *added})]
    return out


_DIFF = ST.ArrayType(ST.StructType([ST.StructField("category", ST.StringType()), ST.StructField("token", ST.StringType()), ST.StructField("lost", ST.LongType()), ST.StructField("added", ST.LongType())]))
_ARROW_DIFF = pa.list_(pa.struct([("category", pa.string()), ("token", pa.string()), ("lost", pa.int64()), ("added", pa.int64())]))


def gate_a_tokens(pairs: DataFrame) -> DataFrame:
    """(path, category, token, lost, added) of (path, source, working), see ``_changed``; a pair is compared within its row."""
    return _compared(pairs).select("path", F.inline("d"))


def _compared(pairs: DataFrame) -> DataFrame:
    bound_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [_changed(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d, _ARROW_DIFF)], ["path", "d"])

    rows = pairs.select("path", token_arrays(F.col("source")).alias("was"), token_arrays(F.col("working")).alias("now"))
    return rows.mapInArrow(run, ST.StructType([pairs.schema["path"], ST.StructField("d", _DIFF)]))


def _sum(d: Column, field: str, hard: bool = False) -> Column:
    of = F.filter(d, lambda x: x["category"].isin(*HARD)) if hard else d
    return F.aggregate(of, F.lit(0).cast("bigint"), lambda s, x: s + x[field])


def gate_a(pairs: DataFrame) -> DataFrame:
    """(path, lost, added, hard_lost, passed): no token of a hard category may be lost."""
    d = F.col("d")
    got = _compared(pairs).select("path", _sum(d, "lost").alias("lost"), _sum(d, "added").alias("added"), _sum(d, "lost", True).alias("hard_lost"))
    return got.withColumn("passed", F.col("hard_lost") == 0)


def cruft_lines(text: Column) -> Column:
    return F.size(F.filter(open_lines(text), lambda x: T.has_residue(x["line"]))).cast("bigint")


def gate_c(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, cruft_lines, passed): no scrape furniture outside code."""
    return docs.select(id_col, cruft_lines(F.col(text_col)).alias("cruft_lines")).withColumn("passed", F.col("cruft_lines") == 0)


def all_gates(pairs: DataFrame, faction: int = 2, n: int = 13) -> DataFrame:
    """(path, gate_a, hard_lost, gate_b, runs_remaining, ratio, gate_c, cruft_lines, passed) of (path, source, working): A against
    the cleaned source; B counts for faction 2 alone. All gates see a pair in its row; nothing is shuffled."""
    bound_batches(pairs.sparkSession)
    source, working = F.col("source"), F.col("working")
    rows = pairs.select(
        "path", length_ratio(source, working).alias("ratio"), cruft_lines(working).alias("cruft_lines"), token_arrays(cleaned(source)["text"]).alias("was"), token_arrays(working).alias("now"),
        prose_for_grams(source).alias("prose"), units_for_grams(working).alias("units"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(n)
        for b in batches:
            was, now, prose, units = (b.column(i).to_pylist() for i in range(3, 7))
            d = [_changed(x, y) for x, y in zip(was, now)]
            runs = [left_over(x, y, grams) for x, y in zip(prose, units)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(d, _ARROW_DIFF), pa.array(runs, pa.list_(pa.string()))], ["path", "ratio", "cruft_lines", "d", "runs"])

    schema = ST.StructType([pairs.schema["path"], ST.StructField("ratio", ST.DoubleType()), ST.StructField("cruft_lines", ST.LongType()), ST.StructField("d", _DIFF), ST.StructField("runs", ST.ArrayType(ST.StringType()))])
    got = rows.mapInArrow(run, schema).select("path", _sum(F.col("d"), "lost", True).alias("hard_lost"), "ratio", remaining(F.col("runs")).alias("runs_remaining"), "cruft_lines")
    a, b, c = (F.col(x) == 0 for x in ("hard_lost", "runs_remaining", "cruft_lines"))
    got = got.withColumns({"gate_a": a, "gate_b": b, "gate_c": c})
    return got.withColumn("passed", F.col("gate_a") & F.col("gate_c") & (F.col("gate_b") | F.lit(faction != 2)))

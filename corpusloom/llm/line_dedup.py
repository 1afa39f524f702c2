"""Line deduplication with a suffix array over line IDs, by distributed prefix doubling.

A document is the sequence of IDs (64-bit hashes) of its lines; blank lines are left out. A run of lines with at least
``min_words`` words that also begins earlier (in the same document, or one with a smaller id) is a copy, and its lines are
deleted; the first copy stays. Runs are maximal: all lines of the longest earlier match count, short ones at its ends
included. Matches are found in the texts as they were, so the result depends on no order of deletion.

1. Lines that occur once can be in no repeated run. What remains falls into segments of neighbouring lines; segments with
   too few words are dropped, and whole segments that have an equal earlier one are copies already. This is done twice.
2. Prefix doubling: suffixes are ranked by their first line, then by 1, 2, 4, ... lines as pairs of ranks, each time by a
   distributed sort. A class of equal keys may span partitions; each partition's ends, which the driver sees, carry its
   rank over. So a frequent line is never gathered in one task.
3. Longest common prefixes of neighbours in the suffix array: only those that don't follow from the preceding line's
   (irreducible ones, whose lengths sum up to n log n at most) are compared, in slices of growing length.
4. LCP intervals: a monotonic stack passes over the array in both directions and finds for each suffix the longest prefix
   that an earlier position shares. Partitions exchange only their stacks, each at most as long as the longest repeated run
   that crosses their border.

Defined results: null and empty texts have no lines and stay as they are; a document that loses all lines becomes empty.
Lines are compared without white space at their ends. Ties of ids are ordered by text; of wholly equal rows one keeps its
lines. Rows with a null id come last. An empty table gives no rows. Columns that clash with the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, lookup, map_texts, numbered, ordered_table, stored, tune, without

MIN_WORDS = 30
OUTPUTS = ("n_lines", "n_removed", "removed")
_FOREVER = 1 << 62


def _split(texts: list[str | None]) -> list:
    ids, words, places, totals = [], [], [], []
    digest = xxhash.xxh3_64_intdigest
    for t in texts:
        lines = t.split("\n") if t else []
        stripped = [x.strip() for x in lines]
        at = [i for i, x in enumerate(stripped) if x]
        ids.append([(digest(stripped[i].encode("utf-8", "surrogatepass")) ^ 0x8000000000000000) - 0x8000000000000000 for i in at])
        words.append([len(stripped[i].split()) for i in at])
        places.append(at)
        totals.append(len(lines))
    return [ids, words, places, totals]


_ITEM = "d bigint, i int, h bigint, w int, at int"


def _segments(items: DataFrame, min_words: int) -> DataFrame:
    """(d, start, ids, words, at, digest): neighbouring repeated lines with enough words, of (d, i, h, w, at)."""
    total = items.count()
    counts = items.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    again = hot_join(items, counts, "h", "n", total, [])
    per = again.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("i", "h", "w", "at"))).alias("x")).select("d", "x.i", "x.h", "x.w", "x.at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for d, i, h, w, at in zip(*(b.column(k).to_pylist() for k in range(5))):
                cuts = np.flatnonzero(np.diff(i) != 1) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(i)]):
                    if sum(w[lo:hi]) >= min_words:
                        key = xxhash.xxh3_128_digest(np.array(h[lo:hi], np.int64).tobytes())
                        for c, v in zip(rows, (d, i[lo], h[lo:hi], w[lo:hi], at[lo:hi], key)):
                            c.append(v)
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int32(), longs, ints, ints, pa.binary()))], ["d", "start", "ids", "words", "at", "digest"])

    return per.mapInArrow(run, "d bigint, start int, ids array<bigint>, words array<int>, at array<int>, digest binary")


def _first_of_equal(segments: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The first of each set of equal segments, and (d, from, to) of the others, which are copies."""
    segments = stored(segments, name)
    total = segments.count()
    first = segments.groupBy("digest").agg(F.min(F.struct("d", "start")).alias("first"), F.count("*").alias("n"))
    marked = hot_join(segments, first, "digest", "n", total, ["first"])
    is_first = (F.col("first.d") == F.col("d")) & (F.col("first.start") == F.col("start"))
    copies = marked.where(~is_first).select("d", F.col("at")[0].alias("from"), (F.element_at("at", -1) + 1).alias("to"))
    return stored(marked.where(is_first).drop("first", "digest"), f"{name}-first"), stored(copies, f"{name}-copies")


def _flat(segments: DataFrame) -> DataFrame:
    z = F.arrays_zip(F.col("ids").alias("h"), F.col("words").alias("w"), F.col("at").alias("at"))
    return segments.select("d", "start", F.posexplode(z).alias("k", "z")).select("d", (F.col("start") + F.col("k")).alias("i"), F.col("z.h").alias("h"), F.col("z.w").alias("w"), F.col("z.at").alias("at"))


def _ranked(items: DataFrame, keys: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """Rank items by ``keys`` (equal keys: equal ranks, the number of items before them), in order of keys and pos.

    Gives the table in suffix array order (_p, _n; ``r`` the rank, ``same`` whether the item before has the same keys), and
    how many items aren't told apart yet though their texts go on behind the compared lines."""
    got = ordered_table(items, [*keys, "pos"], name)
    w = W.partitionBy("_p").orderBy("_n")
    mine = F.struct(*keys)
    got = got.withColumn("_same", F.coalesce(mine == F.lag(mine).over(w), F.lit(False)))
    got = got.withColumn("_c", F.coalesce(F.max(F.when(~F.col("_same"), F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    got = stored(got, f"{name}-ranks")
    ends = got.groupBy("_p").agg(F.count("*").alias("n"), F.min_by(mine, "_n").alias("first"), F.max_by(mine, "_n").alias("last"), F.max("_c").alias("c"), F.sum(F.when(F.col("_same") & F.col("open"), 1).otherwise(0)).alias("undecided")).collect()
    base, carried, goes_on, total, undecided, last, last_rank = {}, {}, {}, 0, 0, None, 0
    for r in sorted(ends, key=lambda r: r["_p"]):
        p = r["_p"]
        base[p] = total
        if last is not None and r["first"] == last:
            carried[p], goes_on[p] = last_rank, 1
            undecided += 1
        last_rank = carried[p] if p in carried and r["c"] == 0 else total + r["c"]
        total += r["n"]
        undecided += r["undecided"]
        last = r["last"]
    first_class = (F.col("_c") == 0) & (lookup(goes_on, F.col("_p")) == 1)
    rank = F.when(first_class, lookup(carried, F.col("_p"))).otherwise(lookup(base, F.col("_p")) + F.col("_c"))
    same = F.col("_same") | ((F.col("_n") == 0) & first_class)
    return got.withColumns({"r": rank, "same": same}).drop("_same", "_c"), undecided


def suffix_array(segments: DataFrame) -> DataFrame:
    """(pos, s, off, left, r, same, _p, _n) of (s, ids): every suffix in order; equal suffixes in order of pos.

    ``s``: the position of a segment's first line, so a line's position is s + off."""
    items = segments.select("s", F.size("ids").alias("size"), F.posexplode("ids").alias("off", "h"))
    items = items.select("s", "off", (F.col("s") + F.col("off")).alias("pos"), (F.col("size") - F.col("off")).alias("left"), "h")
    longest = items.agg(F.max("left")).first()[0] or 0
    width = 1
    got, undecided = _ranked(items.withColumn("open", F.col("left") > width), ["h"], "lines")
    while undecided and width < longest:
        w = W.partitionBy("s").orderBy("off")
        nxt = F.coalesce(F.lead("r", width).over(w), F.lit(-1).cast("bigint"))
        items = got.select("s", "off", "pos", "left", "r").withColumn("r2", nxt)
        width *= 2
        items = items.withColumn("open", F.col("left") > width).withColumnRenamed("r", "r1")
        got, undecided = _ranked(items, ["r1", "r2"], f"ranks{width}")
    return got.select("pos", "s", "off", "left", "r", "same", "_p", "_n")


def _neighbours(array: DataFrame) -> DataFrame:
    """The first of each set of equal suffixes, with ``prev`` and ``ps``: the position of the one before in the suffix array
    and that of its segment."""
    heads = array.where(~F.col("same"))
    w = W.partitionBy("_p").orderBy("_n")
    ends = {r[0]: r[1] for r in heads.groupBy("_p").agg(F.max_by(F.struct("pos", "s"), "_n")).collect()}
    before: tuple[dict, dict] = ({}, {})
    last = (-1, -1)
    for p in range(max(ends, default=-1) + 1):
        before[0][p], before[1][p] = last
        last = ends.get(p, last)
    prev, ps = (F.coalesce(F.lag(c).over(w), lookup(x, F.col("_p"), -1)) for c, x in zip(("pos", "s"), before))
    return heads.select("pos", "s", "off", "_p", "_n", prev.alias("prev"), ps.alias("ps"))


def _common_prefix(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(pos, lcp) of (pos, prev): equal line IDs from both positions on, within their segments."""
    todo = pairs.select("pos", "s", "prev", "ps", F.lit(0).alias("lcp"))
    table = segments.select(F.col("s").alias("_s"), "ids")
    done: DataFrame | None = None
    chunk = 16
    while True:
        def slice_of(at, s, chunk=chunk):
            return F.slice("ids", (F.col(at) - F.col(s) + F.col("lcp") + 1).cast("int"), F.lit(chunk))

        a = todo.join(table, F.col("s") == F.col("_s")).withColumn("a", slice_of("pos", "s")).drop("_s", "ids")
        b = a.join(table, F.col("ps") == F.col("_s")).withColumn("b", slice_of("prev", "ps"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                n = []
                for p, q in zip(x.column(5).to_pylist(), x.column(6).to_pylist()):
                    k, m = 0, min(len(p), len(q))
                    while k < m and p[k] == q[k]:
                        k += 1
                    n.append(k)
                yield pa.RecordBatch.from_arrays([*(x.column(i) for i in range(5)), pa.array(n, pa.int32())], ["pos", "s", "prev", "ps", "lcp", "more"])

        step = stored(b.select("pos", "s", "prev", "ps", "lcp", "a", "b").mapInArrow(run, "pos bigint, s bigint, prev bigint, ps bigint, lcp int, more int"), "lcp")
        part = step.where(F.col("more") < chunk).select("pos", (F.col("lcp") + F.col("more")).alias("lcp"))
        done = part if done is None else done.unionByName(part)
        todo = step.where(F.col("more") == chunk).select("pos", "s", "prev", "ps", (F.col("lcp") + F.col("more")).alias("lcp"))
        if not todo.limit(1).count():
            return done
        chunk *= 8


def adjacent_lcp(heads: DataFrame, segments: DataFrame) -> DataFrame:
    """(_p, _n, pos, s, lcp) of the neighbours in the suffix array. A suffix whose preceding line continues the same match needs
    no comparison: its common prefix is one shorter than that of the suffix before it in the text."""
    w = W.partitionBy("s").orderBy("off")
    inner = F.col("prev") > F.col("ps")
    follows = (F.lag("off").over(w) == F.col("off") - 1) & (F.lag("prev").over(w) == F.col("prev") - 1) & inner
    rows = stored(heads.withColumn("follows", F.coalesce(follows, F.lit(False))), "neighbours")
    known = _common_prefix(rows.where(~F.col("follows") & (F.col("prev") >= 0)), segments)
    got = rows.join(known, "pos", "left").withColumn("lcp", F.when(~F.col("follows"), F.coalesce("lcp", F.lit(0))))
    start = F.last(F.when(~F.col("follows"), F.struct("off", "lcp")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    got = got.withColumn("_start", start)
    return got.select("_p", "_n", "pos", "s", F.greatest(F.lit(0), F.col("_start.lcp") - (F.col("off") - F.col("_start.off"))).cast("int").alias("lcp"))


def _pass(pos: Sequence[int], link: Sequence[int], stack: list[tuple[int, int]]) -> list[int]:
    """Longest prefix that each suffix shares with a smaller position among those passed. ``link``: the common prefix with the
    suffix passed before. ``stack``: (position, common prefix with the last one), both rising; changed in place."""
    out = []
    for x, m in zip(pos, link):
        _clip(stack, m)
        while stack and stack[-1][0] > x:
            stack.pop()
        out.append(stack[-1][1] if stack else 0)
        stack.append((x, _FOREVER))
    return out


def _clip(stack: list[tuple[int, int]], m: int) -> None:
    low = None
    while stack and stack[-1][1] >= m:
        low = stack.pop()[0]
    if low is not None and m > 0:
        stack.append((low, m))


def longest_previous(lcp: DataFrame) -> DataFrame:
    """(pos, s, length): the longest prefix of each suffix that begins at an earlier position as well.

    The driver joins the partitions' stacks one after the other and gives each partition the one it starts with, as a row
    of its own in front, so that no task gets another's."""
    spark = lcp.sparkSession
    tune(spark)
    lcp = stored(lcp, "lcps")

    def groups(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[tuple[int, list, list, list, list]]:
        """Partition, positions, segments, links and the carried stacks."""
        held, pos, seg, link, carried = None, [], [], [], []
        for b in batches:
            ps = b.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(ps)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ps)]):
                if hi == lo:
                    continue
                if held is not None and ps[lo] != held:
                    yield held, pos, seg, link, carried
                    pos, seg, link, carried = [], [], [], []
                held = int(ps[lo])
                if wide and b.column(1)[int(lo)].as_py() < 0:
                    carried = [b.column(k)[int(lo)].as_py() for k in range(4, 9)]
                    lo += 1
                pos += b.column(2).slice(lo, hi - lo).to_pylist()
                seg += b.column(3).slice(lo, hi - lo).to_pylist()
                link += b.column(9 if wide else 4).slice(lo, hi - lo).to_pylist()
        if held is not None:
            yield held, pos, seg, link, carried

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, pos, _, link, _ in groups(batches, False):
            up: list[tuple[int, int]] = []
            down: list[tuple[int, int]] = []
            _pass(pos, link, up)
            _pass(pos[::-1], [0, *link[:0:-1]], down)
            up, down = [x for x in up if x[1]], [x for x in down if x[1]]
            cols = [[p], [min(link)], [min(link[1:], default=_FOREVER)], [link[0]], [min(pos)], [[x[0] for x in up]], [[x[1] for x in up]], [[x[0] for x in down]], [[x[1] for x in down]]]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), *[pa.int64()] * 4, *[longs] * 4])], ["p", "low", "inner", "first", "least", "up", "upl", "down", "downl"])

    def arranged(df: DataFrame) -> DataFrame:
        return df.repartition("_p").sortWithinPartitions("_p", "_n")

    longs = "array<bigint>"
    rows = arranged(lcp.select("_p", "_n", "pos", "s", "lcp"))
    said = sorted(rows.mapInArrow(ends, f"p int, low bigint, inner bigint, first bigint, least bigint, up {longs}, upl {longs}, down {longs}, downl {longs}").collect(), key=lambda r: r["p"])
    carry: dict[int, list] = {r["p"]: [[], [], 0] for r in said}
    stack: list[tuple[int, int]] = []
    for r in said:
        carry[r["p"]][0] = list(stack)
        _clip(stack, r["low"])
        stack = [x for x in stack if x[0] < r["least"]] + list(zip(r["up"], r["upl"]))
    stack, link = [], 0
    for r in reversed(said):
        carry[r["p"]][1], carry[r["p"]][2] = list(stack), link
        _clip(stack, min(link, r["inner"]))
        stack = [x for x in stack if x[0] < r["least"]] + list(zip(r["down"], r["downl"]))
        link = r["first"]
    front = [(p, -1, [x[0] for x in up], [x[1] for x in up], [x[0] for x in down], [x[1] for x in down], behind) for p, (up, down, behind) in carry.items()]
    front = spark.createDataFrame(front, f"_p int, _n bigint, up {longs}, upl {longs}, down {longs}, downl {longs}, behind bigint")
    both = arranged(lcp.unionByName(front, allowMissingColumns=True)).select("_p", "_n", "pos", "s", "up", "upl", "down", "downl", "behind", "lcp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pos, seg, link, (up, upl, down, downl, behind) in groups(batches, True):
            a = _pass(pos, link, list(zip(up, upl)))
            b = _pass(pos[::-1], [behind, *link[:0:-1]], list(zip(down, downl)))[::-1]
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(seg, pa.int64()), pa.array([min(max(x, y), 1 << 30) for x, y in zip(a, b)], pa.int32())], ["pos", "s", "length"])

    return both.mapInArrow(run, "pos bigint, s bigint, length int")


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, from, to): line ranges to delete, of (d, ids, words, at), the lines of documents in order of d."""
    z = F.arrays_zip(F.col("ids").alias("h"), F.col("words").alias("w"), F.col("at").alias("at"))
    items = lines.select("d", F.posexplode(z).alias("i", "z")).select("d", "i", F.col("z.h").alias("h"), F.col("z.w").alias("w"), F.col("z.at").alias("at"))
    first, copies = _first_of_equal(_segments(items, min_words), "segments")
    first, more = _first_of_equal(_segments(_flat(first), min_words), "segments2")
    copies = copies.unionByName(more)
    segments = numbered(first, ["d", "start"], "s", "segments3", F.size("ids").cast("bigint"))
    if not segments.limit(1).count():
        return copies
    array = suffix_array(segments)
    heads = _neighbours(array)
    found = longest_previous(adjacent_lcp(heads, segments)).where("length > 0")
    equal = array.where("same").select("pos", "s", F.col("left").cast("int").alias("length"))
    found = found.unionByName(equal).select("s", (F.col("pos") - F.col("s")).cast("int").alias("off"), "length")
    per = found.groupBy("s").agg(F.collect_list("off").alias("off"), F.collect_list("length").alias("length"))
    rows = per.join(segments.select("s", "d", "words", "at"), "s").select("d", "off", "length", "words", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], []]
            for d, off, length, words, at in zip(*(b.column(k).to_pylist() for k in range(5))):
                total = np.concatenate([[0], np.cumsum(words)])
                off, stop = np.array(off), np.array(off) + np.array(length)
                ok = total[stop] - total[off] >= min_words
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, off[ok], 1)
                np.add.at(change, stop[ok], -1)
                covered = np.cumsum(change)[:-1] > 0
                edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                    for c, v in zip(cols, (d, at[lo], at[hi - 1] + 1)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()))], ["d", "from", "to"])

    return rows.mapInArrow(run, "d bigint, from int, to int").unionByName(copies)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, carry: Sequence[str] | None = None) -> DataFrame:
    """The documents without the lines that are later copies, and n_lines, n_removed and removed (``from:to`` line ranges,
    counted from 0, the end exclusive). The text is replaced where it is carried."""
    tune(docs.sparkSession)
    names = docs.columns if carry is None else list(carry)
    kept = without(docs.select(*[docs[f"`{c}`"] for c in names]), OUTPUTS).columns
    text, id_ = docs[f"`{text_col}`"].cast("string"), docs[f"`{id_col}`"].cast("bigint")
    keyed = docs.select(*[docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(kept)], F.coalesce(id_, F.lit(0)).alias("_a"), F.xxhash64(id_.isNull(), text).alias("_h"), id_.isNull().alias("_null"), text.alias("_text"))
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    outs = [T.StructField("ids", longs), T.StructField("words", ints), T.StructField("at", ints), T.StructField("n_lines", T.LongType())]
    lines = map_texts(keyed, "_text", ["_null", "_a", "_h"], outs, lambda: _split)
    lines = stored(lines.withColumn("_row", F.monotonically_increasing_id()), "lines")
    # Wholly equal rows count as one document; but one of them loses all that has enough words.
    twice = stored(lines.groupBy("_a", "_h").agg(F.count("*").alias("_n")).where("_n > 1"), "twice")
    repeats = twice.limit(1).count() > 0
    if repeats:
        lines = lines.dropDuplicates(["_a", "_h"])
    lines = numbered(lines.select("_null", "_a", "_h", "ids", "words", "at"), ["_null", "_a", "_h"], "d", "sequence")
    runs = repeated_runs(lines, min_words)
    per = runs.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("_runs"))
    per = stored(per.join(lines.select("d", "_a", "_h"), "d").drop("d"), "runs")
    # A shuffled join at every size: what is deleted grows with the corpus, so it is never broadcast.
    per = per.hint("merge")
    joined = keyed.join(per, ["_a", "_h"], "left").withColumn("_whole", F.lit(False))
    if repeats:
        again = stored(keyed.join(twice.select("_a", "_h"), ["_a", "_h"], "left_semi").withColumn("_row", F.monotonically_increasing_id()), "again")
        survivor = again.groupBy("_a", "_h").agg(F.min("_row").alias("_first"))
        again = again.join(survivor, ["_a", "_h"]).withColumn("_whole", F.col("_row") != F.col("_first")).drop("_row", "_first")
        once = keyed.join(twice.select("_a", "_h"), ["_a", "_h"], "left_anti").withColumn("_whole", F.lit(False))
        joined = once.unionByName(again).join(per, ["_a", "_h"], "left")
    shown = [f"_c{i}" for i, c in enumerate(kept) if c != text_col]
    schema = T.StructType([keyed.schema[c] for c in shown] + [T.StructField("_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.StringType())])
    m = len(shown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(m).to_pylist()
            new, n_lines, n_removed, removed = [], [], [], []
            for t, runs_, whole in zip(texts, b.column(m + 1).to_pylist(), b.column(m + 2).to_pylist()):
                if whole and t and len(t.split()) >= min_words:
                    runs_ = [{"from": 0, "to": t.count("\n") + 1}]
                n_lines.append(t.count("\n") + 1 if t else 0)
                if not runs_:
                    new.append(t)
                    n_removed.append(0)
                    removed.append("")
                    continue
                ranges: list[list[int]] = []
                for r in runs_:
                    if ranges and r["from"] <= ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], r["to"])
                    else:
                        ranges.append([r["from"], r["to"]])
                parts, out, at = t.split("\n"), [], 0
                for lo, hi in ranges:
                    out += parts[at:lo]
                    at = hi
                out += parts[at:]
                new.append("\n".join(out))
                n_removed.append(sum(hi - lo for lo, hi in ranges))
                removed.append(",".join(f"{lo}:{hi}" for lo, hi in ranges))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(m)], pa.array(new, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.string())], schema.names)

    out = joined.select(*shown, "_text", "_runs", "_whole").mapInArrow(run, schema)
    return out.select(*[F.col("_text" if c == text_col else f"_c{i}").alias(c) for i, c in enumerate(kept)], *OUTPUTS)

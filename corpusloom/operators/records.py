"""Keyed records: merges, upserts, diffs, reconciliation, precedence, ordered groups and batches.

Every function states its key; rows meet by equi-joins or aggregates that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filled(df: DataFrame, column: str) -> Column:
    """The column, or null where it is an empty string or array."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.nullif(F.col(column), F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(column) > 0, F.col(column))
    return F.col(column)


def merge_records(rows: DataFrame, key: str, order: str, required: str | None = None) -> DataFrame:
    """One row for each key: of every field the first value, by order, that is neither null nor empty. Rows without a key go,
    as do keys without the required field."""
    fields = [c for c in rows.columns if c not in (key, order)]
    firsts = [F.min_by(filled(rows, c), F.when(filled(rows, c).isNotNull(), F.col(order))).alias(c) for c in fields]
    got = rows.where(filled(rows, key).isNotNull()).groupBy(key).agg(*firsts, F.min(order).alias(order))
    return got.where(filled(got, required).isNotNull()) if required else got


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, whole."""
    s = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(s, order).alias("_s")).select(key, "_s.*")


def first_of_each(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    s = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.min_by(s, order).alias("_s")).select(*keys, "_s.*")


def by_precedence(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in which the first source that has a key wins; ``root`` is its number."""
    ranked = [s.withColumn("root", F.lit(i)) for i, s in enumerate(sources)]
    both = ranked[0]
    for s in ranked[1:]:
        both = both.unionByName(s)
    return first_of_each(both, [key], "root") if len(both.columns) > 2 else both.groupBy(key).agg(F.min("root").alias("root"))


def upsert(previous: DataFrame, scanned: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """Scanned rows over the previous state, whose ``keep`` columns survive; rows that are no longer scanned stay."""
    p, s = previous.alias("p"), scanned.alias("s")
    names = [c for c in previous.columns if c != key]
    there = F.col(f"s.{key}").isNotNull()

    def value(c):
        if c in keep or c not in scanned.columns:
            return F.coalesce(f"p.{c}", f"s.{c}") if c in scanned.columns else F.col(f"p.{c}")
        return F.when(there, F.col(f"s.{c}")).otherwise(F.col(f"p.{c}"))

    return p.join(s, F.col(f"p.{key}") == F.col(f"s.{key}"), "full_outer").select(F.coalesce(f"p.{key}", f"s.{key}").alias(key), *[value(c).alias(c) for c in names])


def policy_changes(decisions: DataFrame, current: DataFrame) -> DataFrame:
    """(name, before, after, op): what approved decisions (name, selected, approved, controllable) change in the current
    overrides (name, value). Selecting ``on`` removes the override."""
    d = decisions.where("approved and controllable and selected is not null").join(current, "name", "left")
    after = F.when(F.col("selected") != "on", F.col("selected"))
    op = F.when(after.isNull(), "remove").when(F.col("value").isNull(), "set").otherwise("change")
    return d.select("name", F.col("value").alias("before"), after.alias("after"), op.alias("op")).where(~F.col("before").eqNullSafe(F.col("after")))


def manifest_of(recommended: DataFrame, current: DataFrame) -> DataFrame:
    """(name, before, selected, approved, controllable): decisions to be edited, of (name, recommended, controllable) and the
    current overrides (name, value); nothing is approved yet."""
    got = recommended.join(current, "name", "left")
    return got.select("name", F.col("value").alias("before"), F.col("recommended").alias("selected"), F.lit(False).alias("approved"), "controllable")


def patched(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Overrides (name, value) after the changes."""
    c = changes.select(F.col("name").alias("_n"), "after", F.lit(True).alias("_hit"))
    both = current.join(c, current["name"] == c["_n"], "full_outer")
    value = F.when(F.col("_hit"), F.col("after")).otherwise(F.col("value"))
    return both.select(F.coalesce("name", "_n").alias("name"), value.alias("value")).where("value is not null")


def reverted(changes: DataFrame) -> DataFrame:
    """The changes that undo these."""
    op = F.when(F.col("before").isNull(), "remove").when(F.col("after").isNull(), "set").otherwise("change")
    return changes.select("name", F.col("after").alias("before"), F.col("before").alias("after"), op.alias("op"))


def reconcile(source: DataFrame, queued: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """(key, state): what was never queued, and what is queued but not done."""
    missing = source.select(key).distinct().join(queued, key, "left_anti").select(key, F.lit("unqueued").alias("state"))
    return missing.unionByName(queued.select(key).distinct().join(done, key, "left_anti").select(key, F.lit("pending").alias("state")))


def lifecycle(source: DataFrame, queued: DataFrame, done: DataFrame, key: str, by: str) -> DataFrame:
    """(by, source, queued, done): how many of the source's keys there are, wait in the queue or have been queued, and are done."""
    flags = [t.select(key).distinct().withColumn(n, F.lit(True)) for t, n in ((queued, "_q"), (done, "_d"))]
    both = source.select(key, by).distinct().join(flags[0], key, "left").join(flags[1], key, "left")
    return both.groupBy(by).agg(F.count("*").alias("source"), F.count("_q").alias("queued"), F.count("_d").alias("done"))


def only_in_either(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one table that the other lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("left").alias("side")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("right").alias("side")))


#: Ranges of the order in which a group's rows are numbered independently.
RANGES = 64


def batches(rows: DataFrame, groups: Sequence[str], order: str, size: int | Column) -> DataFrame:
    """Number the rows of each group in batches of at most ``size``, by a numeric order.

    A group with most of the rows is not sorted by one task: the order is cut into ranges at quantiles, each range's rows are
    counted (a map-side combine), and a row's number is its place in the range plus the counts before. The cuts are values in
    the plan, so both passes agree on them."""
    steps = [i / RANGES for i in range(1, RANGES)]
    cuts = rows.select(F.percentile_approx(order, steps, 1000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    ranged = rows.withColumn("_part", part)
    counts = ranged.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*groups, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = W.partitionBy(*groups, "_part").orderBy(order)
    numbered = ranged.withColumn("_k", F.row_number().over(inner) - 1).join(counts, [*groups, "_part"])
    return numbered.withColumn("batch", F.floor((F.col("_k") + F.col("_before")) / size).cast("bigint")).drop("_part", "_k", "_before")


def ordered_groups(rows: DataFrame, keys: Sequence[str], order: str, item: Column, name: str = "items") -> DataFrame:
    """Groups in first-seen order: keys, ``first`` (the smallest order) and the items in order."""
    got = rows.groupBy(*keys).agg(F.min(order).alias("first"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))).alias("_i"))
    return got.select(*keys, "first", F.transform("_i", lambda s: s["x"]).alias(name))


def consecutive(rows: DataFrame, partition: Sequence[str], order: str, title: str) -> DataFrame:
    """Add ``run``: the number of the stretch of equal neighbouring titles that a row is in."""
    w = W.partitionBy(*partition).orderBy(order)
    new = ~F.col(title).eqNullSafe(F.lag(title).over(w)) | F.lag(order).over(w).isNull()
    return rows.withColumn("_new", new).withColumn("run", F.count_if("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def carried_object(rows: DataFrame, order: str, title: str, vocabulary: Sequence[str], partition: Sequence[str] = (), default: str = "Overview") -> DataFrame:
    """Add ``object``: the last title at or before a row that is no section word."""
    from corpusloom.functions.text import object_token

    plain = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]", "")
    section = plain.isin(*vocabulary) | plain.rlike("^(attribute|constant|event|example|method|parameter|propert|return|syntax)")
    own = F.when(~section & (F.coalesce(title, F.lit("")) != ""), F.nullif(F.regexp_replace(object_token(F.col(title)), r"(?i)\s+object$", ""), F.lit("")))
    w = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("object", F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit(default)))


def page_spans(outline: DataFrame, pages: DataFrame, book: Sequence[str] = ()) -> DataFrame:
    """([book], title, page, text): pages of each outline entry (title, start), up to the next strictly later start.

    A page belongs to the last start at or before it: starts and pages are put in one order for each book, without texts, and
    the start is carried forward; entries and texts then join by equal keys. Books are columns of both tables; a whole outline
    without any is one book, whose page numbers pass through one task."""
    keys = list(book)
    marks = outline.select(*keys, F.col("start").alias("_at"), F.lit(0).alias("_page")).distinct().unionByName(pages.select(*keys, F.col("page").alias("_at"), F.lit(1).alias("_page")).distinct())
    w = W.partitionBy(*keys).orderBy("_at", "_page").rowsBetween(W.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("_page") == 0, F.col("_at")), ignorenulls=True).over(w)
    spans = marks.withColumn("start", owner).where("_page = 1 and start is not null").select(*keys, "start", F.col("_at").alias("page"))
    return spans.join(outline.where("start is not null"), [*keys, "start"]).join(pages, [*keys, "page"]).select(*keys, "title", "page", "text")


def inherited(rows: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """Add an array column from a table of earlier values, empty where there are none."""
    first = known.groupBy(key).agg(F.first(column, ignorenulls=True).alias(column))
    return rows.join(first, key, "left").withColumn(column, F.coalesce(column, F.array().cast(known.schema[column].dataType)))

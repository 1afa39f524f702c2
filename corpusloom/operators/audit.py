"""Audits: sizes, residues, placeholders, link and listing integrity, package rules, page boilerplate."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import arrow
from corpusloom.functions import text as T

from .lines import lines
from .overlap import small


def size_stats(files: DataFrame, size: str, group: list[str] | None = None, target: int = 24 * 1024) -> DataFrame:
    """files, median (the upper one of an even number), largest, and how many are over 1.6 times the target.

    The median is the order statistic number n div 2; sizes are counted by value first, so nothing collects all of them."""
    keys = group or []
    n = files.groupBy(*keys, size).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys).orderBy(size).rowsBetween(W.unboundedPreceding, 0)
    n = n.withColumns({"_upto": F.sum("_n").over(w), "_total": F.sum("_n").over(W.partitionBy(*keys))})
    middle = F.min(F.when(F.col("_upto") > F.floor(F.col("_total") / 2), F.col(size)))
    return n.groupBy(*keys).agg(F.sum("_n").alias("files"), middle.alias("median"), F.max(size).alias("largest"), F.sum(F.when(F.col(size) > F.lit(1.6) * target, F.col("_n")).otherwise(0)).alias("oversize"))


def footprint(docs: DataFrame, group: str, chars: str) -> DataFrame:
    """(group, n, chars, tokens): tokens estimated from the sum of characters."""
    got = docs.groupBy(group).agg(F.count("*").alias("n"), F.sum(chars).alias("chars"))
    return got.withColumn("tokens", T.token_estimate(F.col("chars")))


def residue_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, images, relative_links, html_lines): what conversion left over outside code."""
    open_ = lines(docs, id_col, text_col).where(~F.col("in_fence"))
    plain = F.regexp_replace("line", r"`[^`]*`", "")
    return open_.groupBy(id_col).agg(
        F.sum(F.regexp_count(plain, F.lit(r"!\[[^\]]*\]\("))).alias("images"),
        F.sum(F.regexp_count(plain, F.lit(r"\]\((?!https?://|mailto:|#)[^)]+\)"))).alias("relative_links"),
        F.count_if(plain.rlike(r"(?i)</?(div|span|p|table|tr|td|br|ul|li)\b[^>]*>")).alias("html_lines"),
    )


def placeholders(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: str = "allow-placeholder") -> DataFrame:
    """(id, line_no, line): lines with TODO or TBD outside code, unless they carry the allowing tag."""
    plain = F.regexp_replace("line", r"`[^`]*`", "")
    rows = lines(docs, id_col, text_col).where(~F.col("in_fence") & plain.rlike(r"\b(TODO|TBD)\b") & ~F.contains("line", F.lit(allow)))
    return rows.select(id_col, (F.col("i") + 1).alias("line_no"), "line")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, target): every Markdown link target outside code, without its anchor; anchors alone are left out."""
    open_ = lines(docs, id_col, text_col).where(~F.col("in_fence"))
    found = open_.select(id_col, F.explode(F.regexp_extract_all("line", F.lit(r"\]\(\s*([^\s)]+)"), F.lit(1))).alias("t"))
    return found.select(id_col, F.regexp_replace("t", "#.*$", "").alias("target")).where("target <> ''")


def dangling_links(docs: DataFrame, files: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = "folder", file: str = "file") -> DataFrame:
    """(id, target): relative links to no existing file. Both tables have a folder; a target is resolved against it."""
    found = links(docs.select(id_col, text_col), id_col, text_col).where(~F.col("target").rlike("^[a-z]+:"))
    found = found.join(docs.select(id_col, folder), id_col)
    path = F.concat_ws("/", F.nullif(F.col(folder), F.lit("")), F.col("target"))
    path = F.regexp_replace(F.regexp_replace(path, r"(^|/)\./", "$1"), r"[^/]+/\.\./", "")
    there = files.select(F.concat_ws("/", F.nullif(F.col(folder), F.lit("")), F.col(file)).alias("path")).distinct()
    return found.withColumn("path", path).join(there, "path", "left_anti").select(id_col, "target").distinct()


def listing_issues(files: DataFrame, listed: DataFrame, package: str = "package", file: str = "file") -> DataFrame:
    """(package, file, issue): files that no listing names (unlisted), and listed files that are missing (dangling)."""
    f, l = files.select(package, file).distinct(), listed.select(package, file).distinct()
    return f.join(l, [package, file], "left_anti").withColumn("issue", F.lit("unlisted")).unionByName(l.join(f, [package, file], "left_anti").withColumn("issue", F.lit("dangling")))


def package_report(files: DataFrame, listed: DataFrame, limit: int) -> DataFrame:
    """(package, files, oversize, unlisted, dangling) of (package, file, bytes) and (package, file): how many files each package
    has, those over a size (the largest first, ties by name), those that no listing names, and listed ones that are missing."""
    names = lambda kind: F.array_sort(F.collect_list(F.when(F.col("issue") == kind, F.col("file"))))
    issues = listing_issues(files, listed).groupBy("package").agg(names("unlisted").alias("unlisted"), names("dangling").alias("dangling"))
    big = F.array_sort(F.collect_list(F.when(F.col("bytes") > limit, F.struct((-F.col("bytes")).alias("n"), F.col("file").alias("file")))))
    sizes = files.groupBy("package").agg(F.count("*").alias("files"), F.transform(big, lambda x: x["file"]).alias("oversize"))
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none).alias(c) for c in ("oversize", "unlisted", "dangling")]
    return sizes.join(issues, "package", "full_outer").select("package", F.coalesce("files", F.lit(0)).alias("files"), *lists)


def issue_totals(issues: DataFrame, by: str = "issue", shown: int = 25, name: str = "file") -> DataFrame:
    """(issue, n, shown): counts, and the first names in order."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(name))
    top = issues.select(by, name, rank.alias("_r")).where(F.col("_r") <= shown).groupBy(by).agg(F.array_sort(F.collect_list(name)).alias("shown"))
    return issues.groupBy(by).agg(F.count("*").alias("n")).join(top, by)


def package_errors(packages: DataFrame) -> DataFrame:
    """(package, message) of (package, name, description, n_files, n_topics, is_router, children): every broken rule."""
    rules = (
        (F.coalesce("name", F.lit("")) == "", "name is missing"),
        (F.coalesce("description", F.lit("")) == "", "description is missing"),
        ((F.coalesce("name", F.lit("")) != "") & ~T.is_kebab(F.col("name")), "name is not in kebab case"),
        ((F.coalesce("name", F.lit("")) != "") & (F.col("name") != F.col("package")), "name differs from the folder"),
        ((F.coalesce("description", F.lit("")) != "") & ~F.col("description").rlike(r"(?i)\b(use|when|for)\b"), "description names no trigger"),
        (F.col("n_files") == 0, "no reference files"),
        (~F.col("is_router") & (F.col("n_topics") == 0), "no topics are listed"),
        (F.col("is_router") & (F.col("children") == 0), "a router without packages"),
        (~F.col("is_router") & (F.col("children") > 0), "packages inside a leaf"),
    )
    said = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))
    return packages.select("package", F.explode(said).alias("message"))


def package_classes(packages: DataFrame, files: DataFrame, broad: Sequence[str] = ()) -> DataFrame:
    """(package, layout, side_effects, recommended, confidence) of (package, parent) and (package, file): a package with child
    packages is a router of so many, one with a scripts folder has side effects, and a broad one stays on."""
    children = packages.where("parent is not null").groupBy(F.col("parent").alias("package")).agg(F.count("*").alias("_n"))
    scripts = files.groupBy("package").agg(F.bool_or(F.col("file").startswith("scripts/")).alias("_scripts"))
    wide = F.col("package").isin(*broad)
    got = packages.select("package").distinct().join(children, "package", "left").join(scripts, "package", "left")
    return got.select(
        "package", F.when(F.col("_n") > 0, F.format_string("router(%d)", "_n")).otherwise("flat").alias("layout"), F.coalesce("_scripts", F.lit(False)).alias("side_effects"),
        F.when(wide, "on").otherwise("user-invocable-only").alias("recommended"), F.when(wide, "high").otherwise("medium").alias("confidence"),
    )


def inventory(roots: Sequence[DataFrame]) -> DataFrame:
    """(scope, name, chars, root, applicable): packages found under several roots, each (scope, name, chars) once, by the first
    root that has it. Such packages are reported and never changed."""
    ranked = [r.select("scope", "name", "chars", F.lit(i).alias("root")) for i, r in enumerate(roots)]
    both = ranked[0]
    for r in ranked[1:]:
        both = both.unionByName(r)
    first = both.groupBy("scope", "name").agg(F.min_by(F.struct("chars", "root"), F.struct("root", "chars")).alias("_f"))
    return first.select("scope", "name", "_f.chars", "_f.root", F.lit(False).alias("applicable"))


def audit_report(found: DataFrame) -> DataFrame:
    """(scope, n, chars, tokens, listing): totals of an inventory by scope, and its names in order as a Markdown table."""
    row = F.concat(F.lit("| "), F.col("name"), F.lit(" | "), F.col("chars").cast("string"), F.lit(" | "), T.token_estimate(F.col("chars")).cast("string"), F.lit(" |"))
    got = found.groupBy("scope").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("name", row.alias("row")))).alias("_r"))
    body = F.array_join(F.transform("_r", lambda r: r["row"]), "\n")
    return got.select("scope", "n", "chars", T.token_estimate(F.col("chars")).alias("tokens"), F.concat(F.lit("| Name | Chars | Tokens |\n| --- | --- | --- |\n"), body).alias("listing"))


def largest(files: DataFrame, size: str, limit: float, name: str = "file") -> DataFrame:
    """The files over a size, the largest first, ties by name."""
    return files.where(F.col(size) > limit).orderBy(F.desc(size), name)


def collisions(plans: DataFrame, by: Sequence[str], title: str) -> DataFrame:
    """Add ``same``: how many rows of the group have this row's title."""
    n = plans.groupBy(*by, title).agg(F.count("*").alias("same"))
    return plans.join(n, [*by, title])


def covers(rows: DataFrame, by: Sequence[str], order: str, title: str, shown: int = 18) -> DataFrame:
    """(by, covers): the first distinct titles of each group, in order of first appearance."""
    once = rows.where(F.coalesce(title, F.lit("")) != "").groupBy(*by, title).agg(F.min(order).alias("_o"))
    got = once.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_o", F.col(title).alias("t")))).alias("_t"))
    return got.select(*by, F.array_join(F.transform(F.slice("_t", 1, shown), lambda x: x["t"]), "; ").alias("covers"))


PAGE_NUMBER = r"^\d{1,4}$"
CONTENTS = ("contents", "in this chapter", "table of contents")


def boilerplate(pages: DataFrame, book: str, page: str, text_col: str = "text") -> DataFrame:
    """(book, kind, line, n): running headers (capitals at a page's edge, three times or more) and footers (the first four
    words of a page's last line that is no number, on a fifth of the pages and at least three)."""
    rows = pages.select(book, page, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("i", "line")).where(T.strip(F.col("line")) != "")
    up, down = W.partitionBy(book, page).orderBy("i"), W.partitionBy(book, page).orderBy(F.desc("i"))
    rows = rows.withColumns({"_a": F.row_number().over(up), "_z": F.row_number().over(down), "n_": T.squeeze(F.col("line"))})
    # A short page's line may be among the first two and the last three at once, and then counts twice.
    weight = (F.col("_a") <= 2).cast("int") + (F.col("_z") <= 3).cast("int")
    shout = F.col("n_").rlike(r"[\p{Lu}]") & ~F.col("n_").rlike(r"[\p{Ll}]") & F.col("n_").rlike(r"^[A-Z0-9 &/.-]{2,30}$")
    caps = rows.where(shout & (weight > 0)).groupBy(book, F.col("n_").alias("line")).agg(F.sum(weight).cast("bigint").alias("n")).where("n >= 3").select(book, F.lit("header").alias("kind"), "line", "n")
    number = F.col("n_").rlike(PAGE_NUMBER)
    last = rows.where(~number).groupBy(book, page).agg(F.max_by("n_", "i").alias("l"))
    words = F.array_join(F.slice(F.split("l", " "), 1, 4), " ")
    total = pages.groupBy(book).agg(F.count("*").alias("_pages"))
    foot = last.groupBy(book, words.alias("line")).agg(F.count("*").alias("n")).join(total, book)
    foot = foot.where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("_pages") * 0.2))).select(book, F.lit("footer").alias("kind"), "line", "n")
    return caps.unionByName(foot)


def clean_pages(pages: DataFrame, found: DataFrame, book: str, page: str, text_col: str = "text") -> DataFrame:
    """(book, page, text): pages without page numbers, chapter labels, leaders of tables of contents, reference footers, and the
    headers and footers found; undecodable glyphs go. A book's few headers and footers join its pages as two lists."""
    lists = found.groupBy(book).agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("line"))).alias(n) for k, n in (("header", "_heads"), ("footer", "_feet"))])

    def cleaned(rows, heads, feet):
        full = F.filter(F.transform(rows, lambda x, i: F.when(T.strip(x) != "", i)), lambda i: i.isNotNull())
        zone = T.let(full, lambda f: F.slice(f, F.greatest(F.size(f) - 2, F.lit(1)), 3))

        def keep(x, i, low):
            s, n = T.strip(x), T.squeeze(x)
            dropped = s.rlike(PAGE_NUMBER) | s.rlike(r"(?i)^chapter\s+\d+$") | F.lower(n).isin(*CONTENTS) | s.rlike(r"\.{5,}|\x{FFFD}{3,}") | s.rlike(r"(?i)\|\s*chapter\s+\d+")
            foot = F.array_contains(low, i) & F.array_contains(feet, F.array_join(F.slice(F.split(n, " "), 1, 4), " "))
            bare = F.replace(T.rstrip(x), F.lit("\ufffd"), F.lit(""))
            return F.when(s == "", F.lit("")).when(dropped | F.array_contains(heads, n) | foot | (T.strip(bare) == ""), F.lit(None)).otherwise(bare)

        return T.let(zone, lambda low: F.array_join(F.array_compact(F.transform(rows, lambda x, i: keep(x, i, low))), "\n"))

    none = F.array().cast("array<string>")
    both = pages.select(book, page, F.split(F.coalesce(text_col, F.lit("")), "\n").alias("_l")).join(small(lists), book, "left")
    return both.select(book, page, cleaned(F.col("_l"), F.coalesce("_heads", none), F.coalesce("_feet", none)).alias("text"))


def first_divergence(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """(key, offset): where two texts of a key first differ, null where they are equal."""
    a, b = left.select(key, F.col(column).alias("_a")), right.select(key, F.col(column).alias("_b"))
    both = a.join(b, key, "full_outer")
    shared = arrow.udf(lambda p, q: p.combine(q, lambda s, t: len(os.path.commonprefix([s, t]))), "int")
    place = shared(F.coalesce("_a", F.lit("")), F.coalesce("_b", F.lit("")))
    # Equal texts, which are most, don't cross to Python.
    differ = both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, place.alias("offset"))
    return differ.unionByName(both.where(F.col("_a").eqNullSafe(F.col("_b"))).select(key, F.lit(None).cast("int").alias("offset")))

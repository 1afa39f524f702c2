"""Ingest of books, API pages and outlines into corpus records."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import arrow
from corpusloom.functions import html as H
from corpusloom.functions import text as X

from .lines import heading_blocks
from .packing import unique_names


def book_chapters(books: DataFrame, name: str, base: str, exclude: Sequence[str] = (), id_col: str = "book_id", html_col: str = "html") -> DataFrame:
    """(chunk_id, title, source_url, text): a book's page cut at its first-level headings outside code. What stands before the
    first one, empty chapters and excluded titles (any part, case ignored) go; URLs carry unique slugs."""
    md = books.select(id_col, H.converted(F.col(html_col), F.lit(base))["markdown"].alias("text"))
    parts = heading_blocks(md, 1, id_col).where("title is not null and body <> ''")
    if exclude:
        parts = parts.where(~X.has_banned(F.col("title"), exclude))
    parts = parts.withColumn("slug", X.slug(F.col("title"), "section", drop_extension=False)).withColumn("n", F.row_number().over(W.partitionBy(id_col).orderBy("block")))
    urls = unique_names(parts, [id_col], "block", "slug").select(id_col, "block", "unique")
    got = parts.join(urls, [id_col, "block"])
    return got.select(F.format_string(f"{name}-%s-%04d", F.col(id_col).cast("string"), "n").alias("chunk_id"), "title", F.concat(F.lit(base), F.lit("#"), F.col("unique")).alias("source_url"), F.col("body").alias("text"))


def api_section(html: str, content_id: str, dropped: Sequence[str] = (), labels: Sequence[str] = (), ends: Sequence[str] = ()) -> str:
    """Markdown of the section with an id, without dropped sections and label lines, cut at the first second-level heading of
    ``ends``."""
    m = re.search(rf"<(section|div|main)\b[^>]*\bid=[\"']?{re.escape(content_id)}\b[^>]*>", html or "", re.IGNORECASE)
    inner = H.balanced(html, m[1], m.end()) if m else ""
    for name in dropped:
        d = re.search(rf"<(section|div)\b[^>]*\bid=[\"']?{re.escape(name)}\b[^>]*>", inner, re.IGNORECASE)
        if d:
            inner = inner[: d.start()] + inner[d.end() + len(H.balanced(inner, d[1], d.end())) :]
    md = H.to_markdown(inner)[0]
    for label in labels:
        around = rf"[\t ]*{re.escape(label)}[\t ]*\n?"
        md = re.compile(around).sub("\n", md)
    for m in re.finditer(r"(?m)^## (.*)$", md):
        if m[1].strip() in ends:
            md = md[: m.start()]
            break
    return H.few_blanks(md)


def api_pages(pages: DataFrame, name: str, content_id: str, html_col: str = "html", id_col: str = "page_id", **options) -> DataFrame:
    """(chunk_id, title, source_url, text) of API pages; five-digit ids by the page's number."""
    section = arrow.udf(lambda s: s.map(lambda h: api_section(h, content_id, **options)), T.StringType())
    title = arrow.udf(lambda s: s.map(lambda h: re.sub(r"\s+", " ", re.sub("<[^>]+>", "", (re.search(r"(?is)<title[^>]*>(.*?)</title>", h or "") or ["", ""])[1])).strip()), T.StringType())
    got = pages.select(F.format_string(f"{name}-%05d", F.col(id_col)).alias("chunk_id"), title(F.col(html_col)).alias("title"), F.col("url").alias("source_url"), section(F.col(html_col)).alias("text"))
    return got.where("text <> ''")


_ENTRY = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("depth", T.IntegerType())]))


def flatten_outline(outline: str | None) -> list[dict]:
    """Entries of a nested outline (JSON: title, destpageposfrom1, kids) in reading order, with their depth."""
    out: list[dict] = []
    stack = [(n, 0) for n in reversed(json.loads(outline or "[]"))]
    while stack:
        node, depth = stack.pop()
        out.append({"title": node.get("title", ""), "page": node.get("destpageposfrom1"), "depth": depth})
        stack += [(k, depth + 1) for k in reversed(node.get("kids") or [])]
    return out


def outline_entries(books: DataFrame, column: str = "outline", id_col: str = "book_id") -> DataFrame:
    """(book, n, title, page, depth) of outlines."""
    flat = arrow.udf(lambda s: s.map(flatten_outline), _ENTRY)
    return books.select(id_col, F.posexplode(flat(F.col(column))).alias("n", "e")).select(id_col, "n", "e.title", "e.page", "e.depth")


def crumbs(entries: DataFrame, id_col: str = "book_id") -> DataFrame:
    """Add ``path``: the slugs of an entry's ancestors and its own, of any depth; the top level is numbered. An outline, a
    table of contents, is walked as one list."""
    w = W.partitionBy(id_col).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    top = F.count_if(F.col("depth") == 0).over(w)
    own = F.when(F.col("depth") == 0, F.format_string("%02d-%s", top, X.slug(F.col("title"), "section"))).otherwise(X.slug(F.col("title"), "section"))
    slim = entries.select(id_col, "n", F.struct("n", "depth", own.alias("own")).alias("e"))
    lists = slim.groupBy(id_col).agg(F.array_sort(F.collect_list("e")).alias("e"))

    def walk(entries_: Sequence[dict]) -> list[list[str]]:
        stack: list[tuple[int, str]] = []
        out = []
        for e in entries_:
            while stack and stack[-1][0] >= e["depth"]:
                stack.pop()
            stack.append((e["depth"], e["own"]))
            out.append([x for _, x in stack])
        return out

    path = arrow.udf(lambda s: s.map(walk), T.ArrayType(T.ArrayType(T.StringType())))
    paths = lists.select(id_col, F.inline(F.arrays_zip(F.col("e.n").alias("n"), path(F.col("e")).alias("path"))))
    return entries.join(paths, [id_col, "n"])


def chapter(text: str | None, headings: Sequence[str] = ()) -> str:
    """Page text as Markdown: hyphenated words joined, lines of a paragraph joined, bullets and headings on their own.

    A line is a heading if the outline names it, or if it looks like a label, follows a break and no lower-case line follows."""
    known = {re.sub(r"\s+", " ", h).strip().lower() for h in headings}
    src = (text or "").replace("\f", "\n").split("\n")
    out = list[str]()
    open_ = False  # the last line of out is a paragraph or bullet that may go on
    for i, raw in enumerate(src):
        s = re.sub(r"\s+", " ", raw).strip()
        nxt = next((x.strip() for x in src[i + 1 : i + 2]), "")
        if not s:
            open_ = False
            continue
        label = 2 <= len(s) <= 55 and len(s.split()) <= 8 and s[-1] not in ".,:;)" and re.match(r"[A-Z0-9(\"']", s)
        bullet = re.match(r"[•◦▪*-]\s+(.*)|(\d+[.)])\s+(.*)", s)
        if s.lower() in known or (label and not open_ and not bullet and nxt and nxt[0].isupper()):
            out.append(f"### {s}")
            open_ = False
        elif bullet:
            out.append(f"{bullet[2]} {bullet[3]}" if bullet[2] else f"- {bullet[1]}")
            open_ = True
        elif open_:
            last = out[-1]
            out[-1] = last[:-1] + s if re.search(r"[A-Za-z]-$", last) and s[0].islower() else f"{last} {s}"
        else:
            out.append(s)
            open_ = True
    return "\n\n".join(out)


def chapters(spans: DataFrame, book: str = "title", page: str = "page", text: str = "text") -> DataFrame:
    """(title, text): the pages of each chapter, joined in order and reflowed."""
    got = spans.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("_p"))
    joined = F.array_join(F.transform("_p", lambda r: r[text]), "\n")
    return got.select(book, arrow.udf(lambda s: s.map(chapter), T.StringType())(joined).alias("text"))

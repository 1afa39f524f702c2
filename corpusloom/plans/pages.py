"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.operators import audit, ingest, packing

from .registry import query

PATH_SQL = r"""select page_id, case when len(p) > 1 and lower(p[len(p)]) in ('index', 'readme') then list_slice(p, 1, len(p) - 1) when len(p) = 0 then ['page'] else p end as p from (
 select page_id, list_transform(list_filter(string_split(url_decode(regexp_replace(url, '(?i)^[a-z]+:/{2}[^/]+/', '')), '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '(?i)\.(html?|jsx|json|md|rst|tsx?|txt)$', '')) as p from pages)"""


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def converted(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", "url", H.converted(F.col("html"), F.col("url")).alias("c")).select("page_id", "url", "c.*")


@query(f"select page_id, array_to_string(p, '/') as path, len(p) as depth from ({PATH_SQL})")
def url_path(spark: SparkSession, sf: str) -> DataFrame:
    p = T.url_path(F.col("url"))
    return pages(spark, sf).select("page_id", F.array_join(p, "/").alias("path"), F.size(p).cast("bigint").alias("depth"))


@query(r"select page_id, coalesce(nullif(lower(trim(regexp_replace(regexp_replace(url, '\.(md|html?)$', ''), '[^0-9A-Za-z]+', '-', 'g'), '-')), ''), 'page') as slug from pages")
def slug(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", T.slug(F.col("url")).alias("slug"))


@query("select page_id, stem, case when k = 1 then stem else concat(stem, '-', k) end as name from (select page_id, concat('page-', chr((97 + page_id % 7)::int)) as stem, row_number() over (partition by page_id % 7 order by page_id) as k from pages)")
def unique_slug(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages(spark, sf).select("page_id", F.concat(F.lit("page-"), F.char(97 + F.col("page_id") % 7)).alias("stem"))
    return packing.unique_names(rows, [], "page_id", "stem").withColumnRenamed("unique", "name")


@query()
def html_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return converted(spark, sf).select("page_id", "title", "markdown")


@query()
def html_headings(spark: SparkSession, sf: str) -> DataFrame:
    return converted(spark, sf).select("page_id", F.posexplode("headings").alias("n", "h")).select("page_id", "n", "h.level", "h.text")


@query()
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    return audit.links(converted(spark, sf), "page_id", "markdown").groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query()
def page_records(spark: SparkSession, sf: str) -> DataFrame:
    """One corpus record for each page, ids by the page's number."""
    c = converted(spark, sf)
    return c.where("length(trim(markdown)) > 0").select(F.format_string("site-%04d", "page_id").alias("chunk_id"), "title", F.col("url").alias("source_url"), F.col("markdown").alias("text"), F.array(F.element_at(T.url_path(F.col("url")), 1)).alias("tags"))


@query()
def page_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies cleaned, cruft dropped, tables compacted, identifiers quoted."""
    body = H.vectorised(lambda t: H.quoted_identifiers(H.compact_tables(H.strip_cruft(H.clean_body(t)))), "markdown")
    return converted(spark, sf).select("page_id", body.alias("body"))


@query(r"select page_id, len(regexp_extract_all(html, '<a\b'))::bigint as anchors, len(regexp_extract_all(html, '(?i)<h[1-6]\b'))::bigint as headings, len(regexp_extract_all(html, '&[a-z]+;'))::bigint as entities from pages")
def html_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("bigint")
    return pages(spark, sf).select("page_id", n(r"<a\b").alias("anchors"), n(r"(?i)<h[1-6]\b").alias("headings"), n("&[a-z]+;").alias("entities"))


@query()
def api_records(spark: SparkSession, sf: str) -> DataFrame:
    """S4 on pages whose content is an article's div."""
    return ingest.api_pages(pages(spark, sf).withColumn("html", F.regexp_replace("html", "(?i)<body", "<div id=content></div><body")).withColumn("html", F.regexp_replace("html", r"(?i)<div id=content></div><body([^>]*)>", "<main id=content>")), "api", "content")


@query()
def book_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.book_chapters(pages(spark, sf), "book", "https://h/book.html", ["contents"], "page_id")


@query()
def chapter_reflow(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown of pages as book pages, a chapter for every ten."""
    c = converted(spark, sf).select(F.col("page_id").alias("page"), F.col("markdown").alias("text"), F.floor(F.col("page_id") / 10).alias("title"))
    return ingest.chapters(c)

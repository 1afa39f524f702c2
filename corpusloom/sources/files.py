"""Readers and writers: JSONL records, TSV manifests, text files of a folder tree, queues, settings, Markdown and topic lists.

Schemas are explicit; nothing is inferred. Writers go through Spark's commit protocol, so a lost executor leaves no half file.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from corpusloom.functions import arrow
from corpusloom.functions import text as T
from corpusloom.operators import records

RECORD = "chunk_id string, title string, source_url string, text string, tags array<string>, subskill string, section string, symbols array<string>"
QUEUE = (
    "skill string, subskill string, path string, owner string, bytes bigint, prose_ratio double, prose_words int, prose_units int, mode string, chrome int, marker_ok boolean,"
    " faction int, tier string, needs_cleanup boolean, review boolean, status string, attempts int, notes string"
)
TOPICS = "schema_version int, topics array<struct<topic: string, file: string, summary: string, keywords: array<string>>>"


def jsonl(spark: SparkSession, paths: str | list[str], schema: str = RECORD, fields: dict[str, str] | None = None) -> DataFrame:
    """Lines of JSON with ``ord``, their place by file name and position. ``fields``: logical to physical column names.

    A line that doesn't parse, or whose field has another type, fails the read; nothing is dropped."""
    names = fields or {}
    physical = ", ".join(f"{names.get(f.split()[0], f.split()[0])} {f.split(None, 1)[1]}" for f in _fields(schema))
    rows = spark.read.schema(physical).option("mode", "FAILFAST").json(paths)
    order = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"))
    return rows.select(*[F.col(names.get(f.split()[0], f.split()[0])).alias(f.split()[0]) for f in _fields(schema)], order.alias("ord"))


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def load_records(spark: SparkSession, paths: str | list[str], fields: dict[str, str] | None = None) -> DataFrame:
    """Corpus records merged by id; those without text go."""
    return records.merge_records(jsonl(spark, paths, fields=fields), "chunk_id", "ord", "text")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, url, section, n) of tab-separated lines, numbered from 1; lines of one field and comments are left out but
    numbered. A manifest is read as one text, so its numbers have no gaps."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("_i", "value")).withColumn("n", F.col("_i").cast("bigint") + 1)
    parts = F.split("value", "\t")
    got = rows.where((F.size(parts) > 1) & ~F.col("value").startswith("#"))
    return got.select(T.strip(parts[0]).alias("file"), T.strip(parts[1]).alias("url"), F.nullif(T.strip(F.get(parts, F.lit(2))), F.lit("")).alias("section"), "n")


def manifest_pages(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(n, file, url, section, html): the lines of a manifest with the files below ``root`` that they name; lines whose file
    is missing go."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/") + "/"
    pages = files.select(F.substring("path", len(base) + 1, 1 << 30).alias("file"), F.decode("content", "UTF-8").alias("html"))
    return manifest(spark, path).join(pages, "file").select("n", "file", "url", "section", "html")


def text_files(spark: SparkSession, root: str, pattern: str = "*.md", skip: tuple[str, ...] = ("INDEX.md",)) -> DataFrame:
    """(path, file, bytes, text) of a folder tree, read as whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.isin(*skip)).select("path", name.alias("file"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("text"))


SPEC = "path string, topic_level int, section string, group_consecutive boolean, subject_token string"


def file_specs(spark: SparkSession, legend: str, topic_level: int = 2, section: str = "", group_consecutive: bool = False) -> DataFrame:
    """(path, topic_level, section, group_consecutive, subject_token) of a legend (JSON: defaults, files): what a file sets wins
    over the legend's defaults, and those over the arguments. Sorted by path."""
    text = spark.read.text(legend, wholetext=True)
    shape = f"struct<{', '.join(c.replace(' ', ': ', 1) for c in SPEC.split(', '))}>"
    got = text.select(F.from_json("value", f"defaults {shape}, files array<{shape}>", {"mode": "FAILFAST"}).alias("l")).select("l.defaults", F.explode("l.files").alias("f"))
    base = {"topic_level": F.lit(topic_level), "section": F.lit(section), "group_consecutive": F.lit(group_consecutive), "subject_token": F.lit("")}
    return got.select("f.path", *[F.coalesce(f"f.{c}", f"defaults.{c}", d).alias(c) for c, d in base.items()]).orderBy("path")


def specs_of(spark: SparkSession, pattern: str, topic_level: int = 2, section: str = "", group_consecutive: bool = False) -> DataFrame:
    """The same of the files that a glob finds, sorted by path."""
    found = spark.read.format("binaryFile").load(pattern).select("path")
    return found.select("path", F.lit(topic_level).alias("topic_level"), F.lit(section).alias("section"), F.lit(group_consecutive).alias("group_consecutive"), F.lit("").alias("subject_token")).orderBy("path")


def named_artifacts(spark: SparkSession, root: str, pattern: str, pruned: tuple[str, ...] = ()) -> DataFrame:
    """Paths below root whose file name matches, outside pruned folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    inside = F.exists(F.split("path", "/"), lambda p: p.isin(*pruned)) if pruned else F.lit(False)
    return files.where(name.rlike(pattern) & ~inside)


def load_queue(spark: SparkSession, path: str) -> DataFrame:
    """Queue rows, the last of each path."""
    return records.last_by_key(jsonl(spark, path, QUEUE), "path", "ord").drop("ord")


class _Repeated(ValueError):
    pass


def _once(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise _Repeated
    return dict(pairs)


def _fits(value: object, kind: K.DataType) -> bool:
    """Whether a JSON value is of a type; null always is, and true and false are no numbers."""
    if value is None:
        return True
    if isinstance(kind, K.StructType):
        return isinstance(value, dict) and all(_fits(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, K.ArrayType):
        return isinstance(value, list) and all(_fits(x, kind.elementType) for x in value)
    if isinstance(kind, K.MapType):
        return isinstance(value, dict) and all(_fits(x, kind.valueType) for x in value.values())
    if isinstance(kind, K.BooleanType | K.StringType):
        return type(value) is (bool if isinstance(kind, K.BooleanType) else str)
    return type(value) is int or (type(value) is float and isinstance(kind, K.FractionalType))


def json_error(text: str | None, kind: K.StructType, keys: frozenset[str]) -> str | None:
    """What is wrong with a JSON text: not JSON, not an object, a key that repeats at any depth, other keys, another type."""
    try:
        value = json.loads(text or "", object_pairs_hook=_once)
    except _Repeated:
        return "duplicate key"
    except ValueError:
        return "not JSON"
    if not isinstance(value, dict):
        return "not an object"
    return "wrong keys" if set(value) != keys else None if _fits(value, kind) else "wrong type"


def strict(rows: DataFrame, column: str, schema: str, keys: tuple[str, ...]) -> DataFrame:
    """Add ``error`` to JSON texts that aren't objects of just these keys and types, each key once; and ``value``, parsed."""
    kind, wanted = K.StructType.fromDDL(schema), frozenset(keys)
    error = arrow.udf(lambda s: s.map(lambda t: json_error(t, kind, wanted)), "string")
    return rows.withColumn("error", error(F.col(column))).withColumn("value", F.when(F.col("error").isNull(), F.from_json(column, schema)))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(name, value): the overrides of a settings object; an empty file has none. Anything that is no object, or whose
    overrides are none, fails."""
    text = spark.read.text(path, wholetext=True).where(F.col("value").rlike(r"\S"))

    def overrides(t: str) -> dict[str, str]:
        got = json.loads(t)
        if not isinstance(got, dict):
            raise ValueError("the settings are no JSON object")
        found = got.get("overrides") or {}
        if not isinstance(found, dict):
            raise ValueError("the overrides are no JSON object")
        return {k: v if isinstance(v, str) else json.dumps(v) for k, v in found.items()}

    read = arrow.udf(lambda s: s.map(lambda t: list(overrides(t).items())), "array<struct<name: string, value: string>>")
    return text.select(F.inline(read("value")))


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_markdown(files: DataFrame, path: str, folder: str = "folder", text: str = "text") -> None:
    """Each text as a file of its own, ended by one newline, in the folder that its row names. File names are Spark's."""
    files.select(folder, T.rstrip(F.coalesce(text, F.lit(""))).alias("value")).write.mode("overwrite").partitionBy(folder).option("maxRecordsPerFile", 1).text(path)


def topics(files: DataFrame) -> DataFrame:
    """(package, json): the topic list of each package of (package, topic, file, summary, keywords), sorted by file."""
    one = F.struct("topic", "file", "summary", "keywords")
    got = files.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("file", one.alias("t")))).alias("x"))
    return got.select("package", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.transform("x", lambda s: s["t"]).alias("topics"))).alias("json"))


def read_topics(rows: DataFrame, column: str = "json") -> DataFrame:
    """(package, topic, file, summary, keywords) of either form: the list, or a flat object of title to file and hints."""
    listed = F.from_json(column, TOPICS)["topics"]
    flat = F.from_json(column, "map<string, struct<file: string, corpus_search_hints: array<string>>>")
    as_list = F.transform(F.map_entries(F.map_filter(flat, lambda k, v: v["file"].isNotNull())), lambda e: F.struct(e["key"].alias("topic"), e["value"]["file"].alias("file"), F.lit(None).cast("string").alias("summary"), e["value"]["corpus_search_hints"].alias("keywords")))
    return rows.select("package", F.inline(F.when(F.size(listed) > 0, listed).otherwise(as_list)))


def index_table(files: DataFrame) -> DataFrame:
    """(package, text): a Markdown index with one row for each file of (package, file, title, bytes)."""
    line = F.concat(F.lit("| ["), F.col("title"), F.lit("]("), F.col("file"), F.lit(") | "), F.bround(F.col("bytes") / 1024, 0).cast("int").cast("string"), F.lit(" KB |"))
    got = files.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("file", line.alias("l")))).alias("x"))
    body = F.array_join(F.transform("x", lambda s: s["l"]), "\n")
    return got.select("package", F.concat(F.lit("# "), F.col("package"), F.lit("\n\n| File | Size |\n| --- | --- |\n"), body, F.lit("\n")).alias("text"))

"""The training-data pipeline: toxic documents go, repeated passages are cut to their first copy, near-duplicate groups keep
one document, documents with benchmark passages go, and what is left is mixed to target weights.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs. All
stages but the last give back the columns of docs, with the values they came with (but for text and n_chars where lines are
cut), whatever their names: verdicts are held under names that docs lacks. An empty table stays empty. Null ids, repeated
rows and further columns are allowed everywhere; each stage says what it does with null and empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from corpusloom.llm.common import aside, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half. The model learns from labelled documents outside the held-out fold.

    Null and empty texts score the bias alone, so they stay unless toxic documents are the rule; without labels all stay.
    Repeated rows and texts that are equal share one verdict. Ties (a score of one half) go. Texts are scored whole."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    apart, back = aside(docs, ("score", "predicted"))
    return toxicity.score(apart, model).where("predicted = 0").select(*back)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs. A document that loses every word to this goes; n_chars follows the text.

    Null, empty and blank texts stay as they are. Of equal texts the one with the smallest id (null ids last) keeps its
    lines; of wholly equal rows one. Texts of any length are compared whole."""
    apart, back = aside(docs, line_dedup.OUTPUTS)
    got = line_dedup.dedup_lines(apart)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return got.where(~emptied).withColumn("n_chars", chars).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group, and all that belong to none.

    Null, empty and blank texts, which have no shingles, stay, as do rows with a null id. Of wholly equal rows with a text
    one stays. The smallest id of a group is kept. Texts are compared whole."""
    return near_dedup.without_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found. Null, empty and wordless texts hold none and stay; repeated rows share one
    verdict; an empty benchmark removes nothing. A score at the threshold counts as found. Texts are scanned whole."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and how many of each document's words the mix takes. Null and empty texts have size 0; a null source
    is one of its own, the last; ties of the sampling key go to the smaller id, then the smaller size; repeated rows count
    each."""
    return mixing.mix_with_labels(docs, _table(spark, sf_dir, "labels"), carry=("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("near-duplicates", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("source mixing", mix_sources),
]

#: Trained scores, suffix arrays, sketches and alignments have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i + 1}")
    return docs

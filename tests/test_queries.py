"""Every registered query with SQL gives DuckDB's rows; queries without SQL are compared with brute force elsewhere."""

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    want = duck.sql(registry.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.parametrize(
    "name, texts",
    [
        ("cross_link", ["Bergech zu den", "zz Bergech zu denüau", "éBergech zu den.", "Bergech zu dena", "xBergech zu den", "bergech zu den", None]),
        ("title_scalars", ["", " ... ", None, "Wort eins", "_a b", "12 (3)"]),
    ],
)
def test_odd_texts_match_sql(spark, tmp_path, name, texts):
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", "Bergech zu den Haus"), ("b", "ohne")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(registry.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

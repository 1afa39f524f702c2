"""The pipeline's stages, each against its own input."""

import corpus_pipeline as pipeline
from corpusloom.llm import decontaminate, near_dedup, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near-duplicates", "benchmark decontamination", "source mixing"]
    before = docs
    for i, (name, stage) in enumerate(pipeline.STAGES):
        after = stage(spark, before, SF).cache()
        a, b = {r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in after.collect()}
        assert b.keys() <= a.keys()
        if i < 4:
            assert after.columns == docs.columns
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            bad = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
            assert a.keys() - b.keys() == bad
        elif name == "line dedup":
            assert all(set(b[k]["text"].split("\n")) <= set(a[k]["text"].split("\n")) for k in b)
            assert all(b[k]["n_chars"] == len(b[k]["text"]) for k in b if b[k]["text"] != a[k]["text"])
        elif name == "near-duplicates":
            groups = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(before).collect()}
            assert set(groups.values()) == b.keys()
        elif name == "benchmark decontamination":
            assert decontaminate.leaked_pairs(after, bench).count() == 0
            assert a.keys() - b.keys() == {r["doc_id"] for r in decontaminate.leaked_pairs(before, bench).collect()}
        else:
            assert a.keys() == b.keys()
        before = after
    assert sorted(map(str, pipeline.run(spark, SF).collect())) == sorted(map(str, before.collect()))


CLASH = "score double, predicted int, n_lines string, n_removed int, removed string, leaks string, _gone string, _key string, kept string, size string, taken string"
LONG = "one very long text that goes on and on " * 20_000


def edge_tables(spark, tmp_path, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASH
    extra = (7.5, 9, "lines", 4, "gone", "keep me", "g", "k", "kept", "s", "t")
    docs = spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), *extra) for i, t, lang, source in rows], schema)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (8, 0, 1), (None, None, None), (3, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item of the benchmark that nobody should train on at all"), (2, None), (3, ""), (None, "x")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return extra


def test_edges_and_columns(spark, tmp_path):
    run30 = "\n".join(f"this is line number {k} of a passage" for k in range(8))
    rows = [
        (1, "a plain document about rivers and bridges", "en", "a"), (1, "a plain document about rivers and bridges", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (4, " \n\t ", "en", "b"),
        (5, LONG, "en", "b"), (None, "no id but a text of its own", None, None), (6, run30, "en", "a"), (7, "before\n" + run30 + "\nand after it comes more", "en", "a"),
        (9, "so here is an item of the benchmark that nobody should train on at all indeed", "en", "b"), (10, "ß é 漢字", "de", "c"),
    ]
    extra = edge_tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path)).cache()
        got = after.collect()
        kept[name] = [r["doc_id"] for r in got]
        if name != "source mixing":
            assert after.columns == docs.columns
            assert all(tuple(r)[5:] == extra for r in got), name
        docs = after
    everything = sorted(kept["toxicity"], key=str)
    assert everything == sorted([r[0] for r in rows], key=str)
    after_lines = sorted(kept["line dedup"], key=str)
    assert after_lines == sorted([r[0] for r in rows], key=str)  # 7 words are too few for the repeated row to be emptied
    assert sorted(kept["near-duplicates"], key=str) == sorted({r[0] for r in rows}, key=str)
    assert set(kept["near-duplicates"]) - set(kept["benchmark decontamination"]) == {9}
    assert sorted(kept["source mixing"], key=str) == sorted(kept["benchmark decontamination"], key=str)


def test_cut_text_and_length(spark, tmp_path):
    run30 = "\n".join(f"this is line number {k} of a passage" for k in range(8))
    edge_tables(spark, tmp_path, [(6, run30, "en", "a"), (7, "before\n" + run30 + "\nand after it comes more", "en", "a"), (8, run30, "en", "b")])
    got = {r["doc_id"]: r for r in pipeline.cut_repeated_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert got.keys() == {6, 7} and got[7]["text"] == "before\nand after it comes more" and got[7]["n_chars"] == len(got[7]["text"])


def test_empty_tables(spark, tmp_path):
    edge_tables(spark, tmp_path, [])
    for _, stage in pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count() == 0
    assert pipeline.run(spark, str(tmp_path)).count() == 0

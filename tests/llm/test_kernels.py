"""Work that the pipeline's stages need not do, and that leaving it out changes nothing."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, mixing
from corpusloom.llm.common import WordHasher, hashed, pair, shingle2, space_words

WORDS = r"[^\x20\x09-\x0D]+"


def test_sizes_by_no_regular_expression(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "one", " a  b\tc\nd\x0be\x0cf\rg ", "a\xa0b c\u2028d \x1c\x1d\x1e\x1f \x85 e", "ß é 漢字", "word " * 50_000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    got = docs.select(mixing.word_count(F.col("text")).alias("n"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).alias("m")).collect()
    assert [r["n"] for r in got] == [r["m"] for r in got] == [0, 0, 0, 1, 7, 5, 3, 50_000]
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    sized = docs.select(mixing.word_count(F.col("text")))
    assert "regexp" not in sized._jdf.queryExecution().optimizedPlan().toString()
    mixed = mixing.mix_with_labels(docs, labels, carry=("doc_id",)).collect()
    assert sorted((r["doc_id"], r["size"]) for r in mixed) == [(i, r["n"]) for i, r in enumerate(got)]


def test_only_what_can_be_enough_is_aligned(monkeypatch):
    item = "of the and one two three four five six seven eight nine ten eleven"
    items = decontaminate.Items([7], [item])
    copy = " ".join(w if i % 5 else "other" for i, w in enumerate(item.split(), 1))
    texts = [f"much text before of the and then {'more of it ' * 20}", f"some words {item} and more", f"x y {copy} z", None, ""]
    seen, align = [], decontaminate.align
    monkeypatch.setattr(decontaminate, "align", lambda windows, items: seen.append(len(windows)) or align(windows, items))
    got = decontaminate.Finder(items, decontaminate.SHARE, decontaminate.WORDS)(texts)[0]
    assert [len(x) for x in got] == [0, 1, 1, 0, 0] and got[1][0]["score"] == 1.0
    assert sum(seen) == 2


def test_common_words_bound_the_alignment():
    rng = np.random.default_rng(3)
    windows = [rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint64) << np.uint64(3) for _ in range(300)]
    items = [rng.integers(0, 30, rng.integers(1, 25)).astype(np.uint64) << np.uint64(3) for _ in range(300)]
    most = decontaminate.common_words(windows, items)
    assert most.tolist() == [int(np.isin(t, w).sum()) for w, t in zip(windows, items)]
    assert (decontaminate.align(windows, items) <= decontaminate.MATCH * most).all()


def test_shingles_and_hasher():
    hasher = WordHasher()
    texts = ["a b a b a", "one", "", None, "x", "c d e f c d", "two two", "q r"]
    h, counts = hashed(texts, space_words, hasher)
    own, sh = shingle2(h, counts)
    cuts = np.searchsorted(own, np.arange(len(texts) + 1))
    sets = [sh[lo:hi].tolist() for lo, hi in zip(cuts, cuts[1:])]
    assert [len(s) for s in sets] == [2, 1, 0, 0, 1, 4, 1, 1] and all(s == sorted(set(s)) for s in sets)
    a = hasher.array([b"c", b"d", b"e", b"f"])
    want = {int(pair(x, y)[0]) for x, y in ((a[i : i + 1], a[j : j + 1]) for i, j in ((0, 1), (1, 2), (2, 3), (3, 0)))}
    assert set(sets[5]) == want and not vars(hasher)

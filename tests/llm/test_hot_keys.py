"""Hot buckets, hubs and hot sources: results by brute force while the limits that route them are low."""

import itertools
import random

import pytest

from corpusloom.llm import common, graph, mixing, near_dedup


def sets(text):
    w = text.split()
    return frozenset(zip(w, w[1:]))


def brute(texts, percent=80):
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shingles = {i: sets(t) for i, t in texts.items()}
    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(shingles[a] & shingles[b])
        if 100 * both >= percent * len(shingles[a] | shingles[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}


def template_texts(rng, n):
    """Texts of which most words are one template's, so that they share buckets but few links; some are linked in chains."""
    shared = [f"t{k}" for k in range(60)]
    texts = {}
    for i in range(n):
        if i % 7 == 3:
            w = texts[i - 1].split()
            w[rng.randrange(len(w))] = f"e{i}"
            texts[i] = " ".join(w)
        else:
            texts[i] = " ".join(shared + [f"u{i}x{k}" for k in range(rng.choice((10, 20, 30)))])
    return texts


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_hot_bucket(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "MOST_TESTS", most)
    texts = template_texts(random.Random(5), 160)
    # No candidate may be lost to a sketch's chance in so small a test.
    monkeypatch.setattr(near_dedup, "SLACK", 12)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute(texts)


def test_prefix_join_is_exact(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice("abcd") for _ in range(rng.randint(2, 14))) for i in range(120)}
    df = spark.createDataFrame([(i, i, t) for i, t in texts.items()], "_id bigint, _key bigint, _body string")
    cards = near_dedup.map_texts(df, "_body", ["_id"], [near_dedup.T.StructField(n, t) for n, t in (("digest", near_dedup.T.BinaryType()), ("n", near_dedup.T.LongType()), ("bands", near_dedup.T.ArrayType(near_dedup.T.LongType())), ("sig", near_dedup.T.ArrayType(near_dedup.T.LongType())))], near_dedup.Sketcher)
    members = cards.selectExpr("_id as id", "_id as component", "n", "sig")
    got = {(r["a"], r["b"]) for r in near_dedup._by_prefixes(df, members, 80).collect()}
    s = {i: sets(t) for i, t in texts.items()}
    want = {(b, a) for a, b in itertools.combinations(sorted(texts), 2) if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])}
    assert want and want <= got


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 1 / 10)
    edges = [(0, k) for k in range(5, 200)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7), (None, 8), (199, 400), (400, 300)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert set(got.values()) == {0} and set(got) == {*range(5, 200), *range(300, 341), 400} | ({0} & set(got))


def test_many_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 9), None if i % 11 == 0 else f"s{i % 4 if i % 3 else 1}") for i in range(300)], "doc_id bigint, text string, source string")
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    assert sorted(map(str, mixing.mix(docs).collect())) == want


def test_buckets_of_light_documents_are_even(spark):
    """No bucket of the prefix sum takes much more than its part, whatever the weight."""
    from math import exp, log

    for weight in (0.0625, 0.5, 1, 2, 16):
        count = [0] * 100
        for k in range(20_000):
            key = -log((k + 0.5) / 20_000) / weight
            count[int(sum(1 - exp(-key * w) for w in mixing.BUCKET_WEIGHTS) / len(mixing.BUCKET_WEIGHTS) * 100)] += 1
        assert max(count) <= 18 * 200

"""Readers, rewrites, building and maintenance: the cases that define them, and whole tables against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.functions.grams import Grams, greedy_runs
from corpusloom.operators import audit, building, graph, ingest, lines, packing, records, rewrites
from corpusloom.plans import documents as plans
from corpusloom.plans import registry
from corpusloom.sources import files


def test_bad_json_lines_fail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"chunk_id":"x","text":"t"}\n{"chunk_id":"y","te\n')
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        files.load_records(spark, str(tmp_path / "a.jsonl")).collect()
    (tmp_path / "b.jsonl").write_text('{"chunk_id":"x","text":"t","tags":"no list"}\n')
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        files.load_records(spark, str(tmp_path / "b.jsonl")).collect()


def test_manifest_and_its_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# comment\na.html\thttp://a\nalone\nd/b.html\thttp://b\tsec\nmissing.html\thttp://c\n")
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "a.html").write_text("<p>a</p>")
    (tmp_path / "in" / "d" / "b.html").write_text("<p>b</p>")
    assert [(r["n"], r["file"]) for r in files.manifest(spark, str(tmp_path / "m.tsv")).collect()] == [(2, "a.html"), (4, "d/b.html"), (5, "missing.html")]
    got = sorted((r["n"], r["url"], r["section"], r["html"]) for r in files.manifest_pages(spark, str(tmp_path / "m.tsv"), str(tmp_path / "in")).collect())
    assert got == [(2, "http://a", None, "<p>a</p>"), (4, "http://b", "sec", "<p>b</p>")]


def test_settings(spark, tmp_path):
    def read(text):
        (tmp_path / "s.json").write_text(text)
        return [tuple(r) for r in files.settings(spark, str(tmp_path / "s.json")).collect()]

    assert read('{"overrides": {"a": "off", "b": "on"}, "else": 1}') == [("a", "off"), ("b", "on")]
    assert read("") == read(" \n") == read("{}") == read('{"overrides": null}') == []
    for bad in ("{", "[1]", '{"overrides": [1]}'):
        with pytest.raises(Exception, match="JSON|Expecting"):
            read(bad)


def test_strict():
    kind = files.K.StructType.fromDDL("a int, b array<string>, c struct<d: boolean>")
    keys = frozenset("abc")
    good = {"a": 1, "b": ["x"], "c": {"d": True}}
    assert files.json_error(json.dumps(good), kind, keys) is None
    cases = {
        "{": "not JSON", "[]": "not an object", '{"a":1,"a":2,"b":[],"c":{}}': "duplicate key", '{"a":1,"b":[],"c":{"d":true,"d":false}}': "duplicate key", '{"a":1}': "wrong keys",
        '{"a":true,"b":[],"c":{}}': "wrong type", '{"a":1,"b":[1],"c":{}}': "wrong type", '{"a":1,"b":[],"c":{"d":0}}': "wrong type",
    }
    assert {t: files.json_error(t, kind, keys) for t in cases} == cases


def test_strict_column(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": "1"}',), (None,)], "j string")
    assert [(r["error"], r["value"] and r["value"]["a"]) for r in files.strict(df, "j", "a int", ("a",)).collect()] == [(None, 1), ("wrong type", None), ("not JSON", None)]


def test_queue_markdown_and_artifacts(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"path": p, "status": s, "attempts": n}) for p, s, n in [("a", "new", 0), ("b", "new", 0), ("a", "done", 2)]))
    assert sorted((r["path"], r["status"], r["attempts"]) for r in files.load_queue(spark, str(tmp_path / "q.jsonl")).collect()) == [("a", "done", 2), ("b", "new", 0)]
    rows = spark.createDataFrame([("x", "# one  \n\n"), ("y", "two")], "folder string, text string")
    files.write_markdown(rows, str(tmp_path / "md"))
    assert sorted((r["folder"], r["value"]) for r in spark.read.option("basePath", str(tmp_path / "md")).text(str(tmp_path / "md"), wholetext=True).collect()) == [("x", "# one\n"), ("y", "two\n")]
    for p in ("keep/pack.json", "keep/other.txt", "node/pack.json"):
        (tmp_path / "tree" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / p).write_text("x")
    assert [r["path"].split("/tree/")[1] for r in files.named_artifacts(spark, str(tmp_path / "tree"), r"^pack\.json$", ("node",)).collect()] == ["keep/pack.json"]
    table = files.index_table(spark.createDataFrame([("P", "b.md", "B", 2048), ("P", "a.md", "A", 100)], "package string, file string, title string, bytes int")).collect()[0]["text"]
    assert table == "# P\n\n| File | Size |\n| --- | --- |\n| [A](a.md) | 0 KB |\n| [B](b.md) | 2 KB |\n"


def test_rewrites(spark):
    forms = [(1, '{"items": [{"i": 3, "cell": null, "text": "a"}]}'), (2, '[{"i": 1, "cell": 2, "text": "b"}]'), (3, '{"4": "c", "7": "d"}')]
    got = sorted((r["doc_id"], r["ord"], r["i"], r["cell"], r["text"]) for r in rewrites.load_rewrites(spark.createDataFrame(forms, "doc_id int, json string")).collect())
    assert got == [(1, 0, 3, None, "a"), (2, 0, 1, 2, "b"), (3, 0, 4, None, "c"), (3, 1, 7, None, "d")]
    packets = spark.createDataFrame([(d, i, c) for d in range(6) for i, c in ((1, None), (2, 0), (2, 3))], "doc_id int, i int, cell int")
    said = {
        0: [(1, None, "x"), (2, 0, "y"), (2, 3, "z")], 1: [(1, None, "x"), (2, 0, "y")], 2: [(2, 0, "y"), (1, None, "x"), (2, 3, "z")],
        3: [(1, None, "x"), (2, 0, "y"), (2, 3, "Needless To Say, z")], 4: [(1, None, "x"), (2, 0, "y"), (2, 0, "z")], 5: [(1, None, "x"), (2, 0, "y"), (2, 3, "z"), (9, None, "w")],
    }
    rows = spark.createDataFrame([(d, k, i, c, t) for d, items in said.items() for k, (i, c, t) in enumerate(items)], "doc_id int, ord int, i int, cell int, text string")
    errors = {}
    for r in rewrites.packet_errors(packets, rows, ["needless to say"]).collect():
        errors.setdefault(r["doc_id"], set()).add((r["ord"], r["error"]))
    assert errors == {1: {(2, "another count")}, 2: {(0, "another key or order"), (1, "another key or order")}, 3: {(2, "a banned phrase")}, 4: {(2, "a key twice")}, 5: {(3, "another count")}}


def test_gated_write(spark):
    old = "# T\n\nThe old sentence of the FOO_BAR page is here in many plain words for you.\n"
    docs = spark.createDataFrame([(i, old) for i in range(4)], "doc_id int, text string")
    new = {0: "Here FOO_BAR has all that one may want to read now.", 1: "Here it has all that one may want to read now.", 2: "Here FOO_BAR has all of it"}
    rows = spark.createDataFrame([(d, 0, 2 if d != 2 else 0, None, t) for d, t in new.items()], "doc_id int, ord int, i int, cell int, text string")
    got = {r["doc_id"]: (r["written"], r["reason"], r["text"] != old) for r in rewrites.gated_write(docs, lines.extract(docs), rows).collect()}
    assert got == {0: (True, None, True), 1: (False, "gate_a", False), 2: (False, "another key or order", False)}


def test_crumbs_of_any_depth(spark):
    tree = {"title": "L0"}
    node = tree
    for d in range(1, 15):
        node["kids"] = [{"title": f"L{d}"}]
        node = node["kids"][0]
    rows = ingest.crumbs(ingest.outline_entries(spark.createDataFrame([(1, json.dumps([tree]))], "book_id int, outline string"))).orderBy("n").collect()
    assert [len(r["path"]) for r in rows] == list(range(1, 16)) and rows[-1]["path"] == ["01-l0", *[f"l{d}" for d in range(1, 15)]]


def test_pages_of_several_books(spark):
    outline = spark.createDataFrame([("p", "a", 1), ("p", "b", 3), ("p", "c", 3), ("q", "d", 2)], "book string, title string, start int")
    pages = spark.createDataFrame([(b, n, f"{b}{n}") for b in "pq" for n in range(0, 5)], "book string, page int, text string")
    got = sorted(tuple(r) for r in records.page_spans(outline, pages, ["book"]).select("book", "title", "page", "text").collect())
    assert got == [("p", "a", 1, "p1"), ("p", "a", 2, "p2"), *[("p", t, n, f"p{n}") for t in "bc" for n in (3, 4)], *[("q", "d", n, f"q{n}") for n in (2, 3, 4)]]


def test_keyword_ties_by_first_appearance(spark):
    df = spark.createDataFrame([("g", 2, "zebra apple"), ("g", 1, "mango zebra"), ("g", 3, "apple mango kiwi")], "g string, doc_id int, text string")
    assert [r["word"] for r in graph.keywords(df, "g").orderBy("rank").collect()] == ["mango", "zebra", "apple", "kiwi"]


def test_code_in_html():
    md = H.to_markdown('<pre><code class="language-py">x = <a href="/y">f</a>()</code></pre><div class="highlight-python3"><pre>y</pre></div><pre class="rust item">z</pre><p><a href="/y">f</a></p>', "http://h/")[0]
    assert md == "```py\nx = f()\n```\n\n```python\ny\n```\n\n```rust\nz\n```\n\n[f](http://h/y)\n"
    assert H.page_links("[a](b.html#x) [c](http://o/d) ![e](f.png) [g](#h)\n```\n[i](j.html)\n```\n[a](b.html)", "http://h/d/") == ["http://h/d/b.html"]


def test_build_links_parts_and_titles(spark):
    rows = [
        ("1", "Alpha", "http://h/s/one/a.html", "See [b](b.html#part) and [out](z.html) and FOO_BAR.", ["s"], "", "", 1), ("2", "Beta", "http://h/s/two/b.html", "x" * 30, ["s"], "", "", 2),
        ("3", "Beta", "http://h/s/two/b.html", "y" * 30, ["s"], "", "", 3), ("4", "Print", "http://h/s/print.html", "noise", ["s"], "", "", 4),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, title string, source_url string, text string, tags array<string>, subskill string, section string, ord int")
    df = df.withColumn("source_url", F.regexp_replace("source_url", "/s/one/a", "/s/two/a"))
    got = {(r["title"], r["part"]): r for r in building.build(df, 55, lambda u: u.endswith("print.html")).collect()}
    assert len(got) == 3 and all("noise" not in r["text"] for r in got.values())
    first = next(r for r in got.values() if "See" in r["text"])
    parts = sorted(r["title"] for r in got.values() if r["name"] != first["name"])
    assert all(re.search(rf"\(part {k}\)$", t) for k, t in enumerate(parts, 1))
    home = min((r for r in got.values() if r["name"] != first["name"]), key=lambda r: r["part"])
    assert f"[b]({home['name']})" in first["text"] and "[out](http://h/s/two/z.html)" in first["text"] and "`FOO_BAR`" in first["text"]


def test_index_topics_and_maintenance(spark):
    files_ = spark.createDataFrame([("P", "big.md", "\n".join(f"## Entry {k}\n" + "word " * 80 for k in range(4))), ("P", "small.md", "# Small\ntext")], "package string, file string, text string")
    topics = spark.createDataFrame([("P", "Big", "big.md", "s", ["k2", "k1"]), ("P", "Small", "small.md", "t", ["k3"])], "package string, topic string, file string, summary string, keywords array<string>")
    indexes = spark.createDataFrame([("P", "# P\n\n## Files\n\nold\n\n## Notes\n\nkeep\n")], "package string, text string")
    after, new, index = building.maintained(files_, topics, indexes, 1000, 900)
    names = sorted(r["file"] for r in after.collect())
    assert names == ["big-1.md", "big-2.md", "small.md"]
    assert sorted((r["topic"], r["file"], r["summary"], r["keywords"]) for r in new.collect()) == [("Entry 0", "big-1.md", "s", ["k1", "k2"]), ("Entry 2", "big-2.md", "s", ["k1", "k2"]), ("Small", "small.md", "t", ["k3"])]
    text = index.collect()[0]["text"]
    assert "old" not in text and "## Notes\n\nkeep" in text and [re.search(r"\]\((.*?)\)", x)[1] for x in text.split("\n") if x.startswith("| [")] == names


def test_recommendations_and_paths(spark):
    got = records.manifest_of(spark.createDataFrame([("a", "on", True), ("b", "off", False)], "name string, recommended string, controllable boolean"), spark.createDataFrame([("a", "off")], "name string, value string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "off", "on", False, True), ("b", None, "off", False, False)]
    df = spark.createDataFrame([("pkg/a/b/references/x.md",), ("pkg/references/x.md",), ("pkg/x.md",)], "p string")
    assert [r[0] for r in df.select(T.package_inner(F.col("p"))).collect()] == ["a/b", "", ""]


def test_residue_and_names(spark):
    text = "![x](a.png) <div>\n[r](b.md) [o](http://h) [m](mailto:x)\n```\n<div>\n```\n`[c](d)`"
    assert [tuple(r) for r in audit.residue_counts(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()] == [(1, 1, 2, 1)]
    plans_ = spark.createDataFrame([("s", "Intro", ["a", "x"], "one"), ("s", "Intro", ["b", "x"], "one"), ("s", "Other", ["c"], "one"), ("t", "Intro", ["a"], "two")], "sub string, title string, path array<string>, section string")
    assert sorted(r["title"] for r in packing.disambiguated(plans_, "title", "path", "section", ["sub"]).collect()) == ["A — Intro", "B — Intro", "Intro", "Other"]


def test_pieces_hold_every_document(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in plans.documents(spark, sf).collect()}
    pieces = {}
    for r in registry.QUERIES["split_oversize"](spark, sf).collect():
        pieces.setdefault(r["doc_id"], {})[r["piece"]] = r["text"]
    assert {i: "\n".join(p[k] for k in sorted(p)) for i, p in pieces.items()} == docs
    assert all(len(x.encode()) <= 4096 or "\n\n" not in x.strip() for p in pieces.values() for x in p.values())
    kept = {}
    for r in registry.QUERIES["maintenance"](spark, sf).collect():
        kept.setdefault(r["doc_id"], {})[r["piece"]] = r["text"]
    assert {i: "\n".join(p[k] for k in sorted(p)) for i, p in kept.items()} == {i: t for i, t in docs.items() if len(t.encode()) > 4096}


def test_hierarchical_packing_of_every_language(spark, sf):
    """Files hold neighbours, whole branches where those fit, and are over the limit only if one leaf is."""
    leaves = {r["doc_id"]: (r["lang"], r["source"], len(r["text"].encode())) for r in plans.documents(spark, sf).collect()}
    held = {}
    for r in registry.QUERIES["pack_hierarchy"](spark, sf).collect():
        held.setdefault((r["lang"], r["file"]), []).append(r["doc_id"])
    assert sorted(i for ids in held.values() for i in ids) == sorted(leaves)
    for (lang, _), ids in held.items():
        assert {leaves[i][0] for i in ids} == {lang}
        assert len(ids) == 1 or sum(leaves[i][2] for i in ids) <= packing.TARGET_BYTES or len({(leaves[i][1], i % 10) for i in ids}) == 1


def test_grams():
    rng = random.Random(1)
    lists = [[rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(50)]
    got = Grams(3)(lists)
    assert [len(g) for g in got] == [max(0, len(x) - 2) for x in lists]
    seen = {}
    for x, g in zip(lists, got):
        for k, h in enumerate(g.tolist()):
            assert seen.setdefault(tuple(x[k : k + 3]), h) == h
    assert len(set(seen.values())) == len(seen) and all(len(g) == 0 for g in Grams(3)([[], ["a"]]))
    assert greedy_runs([0, 1, 5, 6, 20], 4) == [(0, 5), (5, 10), (20, 24)]


def test_stretches_of_lines(spark):
    texts = ["", "a", "```", "a\n```\nb", "```x\nb\n```\nc\n~~~\nd", "# h\n```\n# no\n```\n## i\nj", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for i, t in enumerate(texts):
        rows = sorted((r["i"], r["line"], r["is_fence"], r["in_fence"]) for r in lines.lines(df.where(f"doc_id = {i}")).collect())
        want, inside = [], False
        for k, line in enumerate(t.split("\n")):
            fence = re.fullmatch(r"(~{3,}|`{3,})[-.+\w]*", line.strip()) is not None
            want.append((k, line, fence, fence or inside))
            inside ^= fence
        assert rows == want
    heads = sorted((r["doc_id"], r["i"], r["heading"]) for r in lines.with_headings(df.where("doc_id = 5")).collect())
    assert [h for _, _, h in heads] == ["# h"] * 4 + ["## i"] * 2


def test_file_specs(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"defaults": {"section": "guide", "topic_level": 3}, "files": [{"path": "b.md", "topic_level": 1}, {"path": "a.md", "subject_token": "S"}]}))
    assert [tuple(r) for r in files.file_specs(spark, str(tmp_path / "l.json")).collect()] == [("a.md", 3, "guide", False, "S"), ("b.md", 1, "guide", False, "")]
    for n in ("z.md", "y.md", "x.txt"):
        (tmp_path / n).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in files.specs_of(spark, str(tmp_path / "*.md")).collect()] == ["y.md", "z.md"]


def test_clean_pages(spark):
    pages = [("b", 1, "HEAD\n\nChapter 3\nbody  \n12\nIn this chapter\nTitle.....3085\nPart | Chapter 4 Title\na � glyph\n�\nthe foot of it\nlast"), ("c", 1, "HEAD\nthe foot of it goes"), ("c", 2, None)]
    found = spark.createDataFrame([("b", "header", "HEAD"), ("b", "footer", "the foot of it")], "book string, kind string, line string")
    got = {(r["book"], r["page"]): r["text"] for r in audit.clean_pages(spark.createDataFrame(pages, "book string, page int, text string"), found, "book", "page").collect()}
    assert got == {("b", 1): "\nbody\na  glyph\nlast", ("c", 1): "HEAD\nthe foot of it goes", ("c", 2): ""}

"""Results against brute force, exact round trips and held-out accuracy."""

import hashlib
import pathlib
import re
from collections import defaultdict

import pytest

from corpusloom.llm import chat_format, decontaminate, fingerprints, licenses, near_dedup, queries, secrets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_accuracy(spark, documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    held = [r for r in queries.op1_language_id(spark, SF).collect() if r["held_out"]]
    assert len(held) > 100 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97


def test_toxicity_ranks_held_out(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r["score"], toxic[r["doc_id"]]) for r in queries.op2_toxicity(spark, SF).collect() if r["held_out"] and r["doc_id"] in toxic]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert bad and wins / (len(bad) * len(good)) > 0.9


def test_secrets_match_plain_patterns(spark, documents):
    rules = {
        "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        "access": (r"AKIA[A-Z0-9]+", 0, 18),
        "hex": (r"[0-9a-f]+", 0, 16),
    }
    got = {r["doc_id"]: r for r in queries.op4_secret_scan(spark, SF).collect()}
    some = 0
    for r in documents.select("doc_id", "text").collect():
        found = sorted((m.start(), list(rules).index(k), m.end()) for k, (p, g, least) in rules.items() for m in re.finditer(p, r["text"], re.ASCII) if len(m[g]) >= least)
        said = ",".join(f"{list(rules)[k]}:{a}:{b}" for a, k, b in found)
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        some += len(found)
    assert some


def test_rules_without_trigrams_scan_all():
    assert secrets.trigram_query(secrets.BASE_RULES[2]) is secrets.ANY
    assert secrets.trigram_query(secrets.BASE_RULES[1]) is not secrets.ANY


def test_near_duplicates_match_brute_force(documents):
    sets = {}
    for r in documents.select("doc_id", "text").collect():
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for g in sets[i]:
            for j in holders[g]:
                shared[j] += 1
            holders[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(documents).collect()}
    assert all(got[i]["component_id"] == find(i) and got[i]["n_shingles"] == len(sets[i]) for i in sets)


def test_licenses_whole_and_lines(spark):
    mit = licenses.MIT.upper().replace("WITHOUT RESTRICTION", "without\n  restriction").replace("SUBLICENSE", "sublicence")
    rows = [(1, "Copyright (c) 2020 Some One\n\n" + mit), (2, licenses.MIT + " and more"), (3, "intro\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0\nend"), (4, "Apache License, Version 2.0")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    small = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan(df).collect()}
    assert small == {1: ("MIT", ""), 2: (None, ""), 3: (None, "CC-BY-NC-4.0,MIT"), 4: ("Apache-2.0", "Apache-2.0")}
    limit, licenses.BROADCAST_DIGESTS = licenses.BROADCAST_DIGESTS, 1
    try:
        assert {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan(df).collect()} == small
    finally:
        licenses.BROADCAST_DIGESTS = limit


def reflowed(text, rng):
    """The same licence as others write it: another line width, case, punctuation, copyright line and spelling."""
    words = text.replace("License", "Licence").replace("favor", "favour").split()
    lines, line = [], []
    for w in words:
        line.append(w.upper() if rng.random() < 0.2 else w)
        if len(line) > rng.randint(5, 15):
            lines.append(" ".join(line))
            line = []
    return "(c) 2021 Some Body\nAll rights reserved.\n\n * " + "\n * ".join([*lines, " ".join(line)]) + "\n"


def test_whole_licenses_by_brute_force(spark):
    """Every known text, reflowed and respelled, against a plain comparison of normalised words with each known text."""
    import random

    rng = random.Random(4)
    full = [(n, t) for n, t in licenses.known_texts() if len(t) > 300]
    made = [(n, reflowed(t, rng)) for n, t in full] + [(None, reflowed(t + " And nothing else.", rng)) for _, t in full]
    plain = lambda t: " ".join(licenses.canonical_words("\n".join(licenses.body_lines(t))))
    known = {plain(t): n for n, t in full}
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(made)], "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(made))] == [known.get(plain(t)) for _, t in made] == [n for n, _ in made]


PUBLISHED = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


@pytest.mark.parametrize("file", PUBLISHED)
def test_published_licenses(file):
    """The digests of long licences, where this machine has their texts."""
    path = pathlib.Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("no text here")
    text = path.read_text()
    for t in (text, text.upper(), text.replace("\n", "\r\n"), text.split("END OF TERMS AND CONDITIONS")[0]):
        assert licenses.text_digest(t) in licenses.FULL[PUBLISHED[file]].split()
    assert licenses.text_digest(text.replace("software", "hardware", 1).replace("Work", "Wreck", 1)) not in licenses.FULL[PUBLISHED[file]].split()


def test_fingerprints_of_edited_texts(documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(documents).collect()}
    finger = fingerprints.Fingerprinter()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[rows[3][0]]["fingerprint"] == finger([rows[3][1]])[0].hex()
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.95 * len(got)


def test_block_tables_find_all_within_radius(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(60)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 6))) for b in base] + base[:5]
    df = spark.createDataFrame([(i, f"{p:032x}") for i, p in enumerate(prints)], "doc_id bigint, fingerprint string")
    got = {(r["fingerprint"], r["other"]): (r["n"], r["distance"]) for r in fingerprints.within_radius(df, df).collect()}
    want = {(f"{a:032x}", f"{b:032x}"): (prints.count(b), (a ^ b).bit_count()) for a in prints for b in prints if (a ^ b).bit_count() <= fingerprints.RADIUS}
    assert got == want


def test_fold_of_events(spark):
    events = [
        (1, 1, "u", "message", "user", "hel"), (1, 2, "u", "delta", None, "lo"), (1, 3, "a", "message", "assistant", ""), (1, 4, "a", "delta", None, "draft"),
        (1, 5, "a", "regenerate", None, None), (1, 6, "a", "delta", None, "better "), (1, 7, "a", "delta", None, "answer"), (1, 8, "u", "edit", None, "hello?"),
        (1, 9, "x", "message", "user", "gone"), (1, 10, "x", "delete", None, None), (1, 11, "z", "unknown", "user", "?"), (2, 1, "only", "message", "user", "bye"), (2, 2, "only", "delete", None, None),
    ]
    df = spark.createDataFrame(events, "conv_id bigint, seq bigint, message_id string, event string, role string, text string")
    out = chat_format.render(chat_format.fold(df)).collect()
    assert len(out) == 1 and chat_format.parse(out[0]["formatted"]) == [("user", "hello?"), ("assistant", "better answer")]
    (span,) = out[0]["loss_spans"]
    assert out[0]["formatted"][span["start"] : span["end"]] == "better answer"


def test_template_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "a\\b\\\\<|", "[INST", "\\[INST]", "<<SYS>>\n<</SYS>>", "tail\\", "<s><s></s>", "\r\n\t", "漢字 é"]
    rows = [(7, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(hard)]
    c = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    (out,) = chat_format.render(chat_format.fold(chat_format.events_of(c))).collect()
    assert chat_format.parse(out["formatted"]) == [(r, t) for _, _, r, t in rows]
    assert [chat_format.unescape(out["formatted"][s["start"] : s["end"]]) for s in out["loss_spans"]] == hard[1::2]
    bodies = out["formatted"].replace(chat_format.START, "").replace(chat_format.END, "")
    assert not any(x in bodies for x in chat_format.CONTROLS)


def test_alignment_matches_plain_smith_waterman():
    import numpy as np

    rng = np.random.default_rng(1)
    windows = [rng.integers(4, 40, rng.integers(1, 50)).astype(np.uint64) << np.uint64(2) for _ in range(30)]
    items = [rng.integers(4, 40, rng.integers(1, 30)).astype(np.uint64) << np.uint64(2) for _ in range(30)]

    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    assert decontaminate.align(windows, items).tolist() == [plain(a, b) for a, b in zip(windows, items)]


def test_edited_passages_are_found_in_blocks(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r["text"] for r in documents.select("doc_id", "text").limit(40).collect()]
    rows = []
    for k, (i, t) in enumerate(items):
        w = t.split()
        for p in range(3, len(w), 7):
            w[p] = "edited"
        if k % 2:
            del w[5]
        rows.append((1000 + i, clean[k % 40][:300] + " " + " ".join(w) + " " + clean[(k + 1) % 40][:300]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked_pairs(df, bench, block_chars=3000).collect()}
    assert {(1000 + i, i) for i, _ in items} <= found


def test_edited_copy_next_to_a_verbatim_one(spark):
    words = [f"w{k}" for k in range(25)]
    edited = [[f"e{k}" if k % step == step - 1 else w for k, w in enumerate(words)] for step in (4, 5, 6)]
    rows = [(k, "some words before " + " ".join(w) + " and some after") for k, w in enumerate([words, *edited])]
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(9, " ".join(words))], "item_id bigint, text string")
    assert {r["doc_id"]: r["score"] for r in decontaminate.leaked_pairs(df, bench).collect()} == pytest.approx({0: 1.0, 1: (19 * 2 - 6) / 50, 2: (20 * 2 - 5 + 1) / 50, 3: (21 * 2 - 4) / 50})


def test_hits_in_runs_of_documents(monkeypatch):
    words = [f"w{k}" for k in range(20)]
    items = decontaminate.Items([1, 2, 3], [" ".join(words), " ".join(words[5:] + ["x"] * 5), "w0"])
    texts = ["none here", " ".join(words), None, "a b " + " ".join(words[3:]), "", " ".join(words[::-1]), " ".join(words) * 2]
    want = decontaminate.Finder(items, 0.5, 13)(texts)
    assert [len(x) for x in want[0]] == [0, 3, 0, 2, 0, 1, 3]
    monkeypatch.setattr(decontaminate, "_HITS", 1)
    assert decontaminate.Finder(items, 0.5, 13)(texts) == want


def test_radius_holds_texts_with_a_replaced_word(spark, documents):
    texts = [r["text"].split() for r in documents.orderBy("doc_id").select("text").collect()]
    texts = [w for w in texts if 100 <= len(w) <= 600][:100]
    rows = [(50 * k, " ".join(w)) for k, w in enumerate(texts)] + [(50 * k + 1, " ".join([*w[: len(w) // 2], "replaced", *w[len(w) // 2 + 1 :]])) for k, w in enumerate(texts)]
    prints = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), carry=["doc_id"])
    pairs = {(r["fingerprint"], r["other"]) for r in fingerprints.within_radius(prints, prints).collect()}
    got = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    found = sum((got[50 * k], got[50 * k + 1]) in pairs for k in range(len(texts))) / len(texts)
    assert found > 0.6, found


@pytest.mark.parametrize("blocks, radius", [(4, 3), (8, 6), (10, 8)])
def test_block_tables_of_other_sizes(spark, blocks, radius):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(30)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 12))) for b in base]
    df = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string")
    got = sorted((r["fingerprint"], r["other"]) for r in fingerprints.within_radius(df, df, radius, blocks).collect())
    assert got == sorted({(f"{a:032x}", f"{b:032x}") for a in prints for b in prints if (a ^ b).bit_count() <= radius})

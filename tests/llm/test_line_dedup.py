import random

import pytest

from corpusloom.llm import line_dedup

SCHEMA = "doc_id bigint, text string"


def brute(rows, min_words):
    """Texts after the deletion of every line of a run that occurs earlier and has enough words."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seq, starts = [], []
    for k in order:
        starts.append(len(seq))
        seq += [(k, i, x.strip()) for i, x in enumerate((rows[k][1] or "").split("\n")) if x.strip()]
    gone = {}
    for a in range(len(seq)):
        longest = 0
        for b in range(a):
            n = 0
            while a + n < len(seq) and b + n < len(seq) and seq[a + n][2] == seq[b + n][2] and seq[a + n][0] == seq[a][0] and seq[b + n][0] == seq[b][0]:
                n += 1
            longest = max(longest, n)
        if sum(len(seq[a + i][2].split()) for i in range(longest)) >= min_words:
            for i in range(longest):
                gone.setdefault(seq[a][0], set()).add(seq[a + i][1])
    out = {}
    for k, (_, t) in enumerate(rows):
        if k not in gone:
            out[k] = t
            continue
        lines, drop = t.split("\n"), gone[k]
        keep = []
        for i, x in enumerate(lines):
            if i in drop:
                continue
            left = max((j for j in range(i) if lines[j].strip()), default=None)
            right = min((j for j in range(i + 1, len(lines)) if lines[j].strip()), default=None)
            if not x.strip() and left in drop and right in drop:
                continue
            keep.append(x)
        out[k] = "\n".join(keep)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b b", "c c c", "d d d d", " a ", "e e"] if seed % 2 else [f"w{i} " * rng.randint(1, 3) for i in range(12)]
    blocks = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 4)):
            lines += rng.choice(blocks) if rng.random() < 0.6 else [f"own {i} {rng.random()}"]
        rows.append((i if i != 7 else None, "\n".join(lines)))
    want = brute(rows, 5)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), min_words=5).collect()}
    assert {rows[k][0]: v for k, v in want.items()} == got


def test_passage_repeats_and_edges(spark):
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(20)) for i in range(3))
    rows = [(1, "one\n" + passage), (2, passage + "\ntwo"), (3, None), (4, ""), (5, "clean line"), (5, "clean line"), (6, "x\n" * 5000 + passage), (None, passage)]
    df = spark.createDataFrame([(a, b, 0, "s") for a, b in rows], SCHEMA + ", N_LINES int, extra string")
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "extra", "n_lines", "n_removed", "removed"}

    text = " ".join(f"w{i}" for i in range(40))
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text), (1, text), (2, text)], SCHEMA)).collect()
    assert sorted(r["text"] for r in got) == ["", "", text]
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0

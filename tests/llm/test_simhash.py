"""SimHash against a plain version, term by term and bit by bit."""

import math
from collections import Counter

import pyarrow.parquet as pq
import xxhash

from corpusloom.llm.common import plain_words
from corpusloom.llm.fingerprints import BITS, PAIR_WEIGHT, UNIT, WORD_WEIGHT, Fingerprinter

ALL = (1 << 64) - 1


def scrambled(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


def both(a, b):
    return scrambled(a * 0x9E3779B97F4A7C15 + (b << 23 & ALL | b >> 41) & ALL)


def plain(text):
    h = [xxhash.xxh64_intdigest(w) for w in plain_words(text)]
    terms = [(WORD_WEIGHT, Counter(x >> 13 for x in h)), (PAIR_WEIGHT, Counter(both(x, y) >> 13 | 1 << 51 for x, y in zip(h, h[1:])))]
    votes = [0] * BITS
    for weight, counts in terms:
        for term, n in counts.items():
            w = weight * round(UNIT * (1 + math.log2(n)))
            bits = "".join(f"{scrambled((term << 12) + lane + 1 & ALL):064b}" for lane in range(BITS // 64))
            votes = [v + w if b == "1" else v - w for v, b in zip(votes, bits)]
    return int("".join("1" if v > 0 else "0" for v in votes), 2).to_bytes(BITS // 8)


def test_simhash_by_definition(sf):
    texts = [None, "", " \n", "one", "one one", "a b a b a", "É ß 漢字 x"] + pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:40]
    assert Fingerprinter()(texts) == [plain(t) for t in texts]


def test_equal_texts_have_equal_fingerprints_in_any_company(sf):
    texts = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()
    texts = texts + ["long words of a text " * 60_000] + texts[::-1]
    alone = [Fingerprinter()([t])[0] for t in texts[:201]]
    assert Fingerprinter()(texts) == alone + alone[:200][::-1]

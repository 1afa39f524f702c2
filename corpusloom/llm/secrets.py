"""Secret scans through a trigram inverted index.

Each rule's pattern is parsed into a Boolean query over the trigrams that any match must contain. Texts are indexed in
blocks: one pass over the block's code points finds the positions of the rules' trigrams, whose documents form the
posting lists. A rule's query intersects and unites postings, and only the remaining documents are verified with the
pattern. A rule without a mandatory trigram (such as a bare run of hex digits) scans every text. Blocks are independent,
so the index needs no shuffle and grows with neither the corpus nor the number of its documents.

Defined results: a null text counts as empty and has no spans. Positions are code points, the end exclusive. Repeated rows
get the same spans. A null id is kept. Kinds that start at one place are listed in the order of the rules. Texts are scanned
whole. Input columns that clash with an output's name are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

try:  # Python 3.11 and later
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _p


@dataclass(frozen=True)
class Rule:
    """``group``'s text (the match where 0) must have ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"Bearer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
)

# A query: True (any text), ("t", trigram), ("and", parts) or ("or", parts). Trigrams are lower-cased.
ANY = True


def _and(parts):
    flat = [p for p in parts if p is not ANY]
    return ANY if not flat else flat[0] if len(flat) == 1 else ("and", tuple(dict.fromkeys(flat)))


def _or(parts):
    parts = list(parts)
    if not parts or any(p is ANY for p in parts):
        return ANY
    needs = {p: frozenset(p[1]) if p[0] == "and" else frozenset([p]) for p in parts}
    flat = tuple(p for p in needs if not any(needs[q] < needs[p] for q in needs))  # a weaker part covers a stronger one
    return flat[0] if len(flat) == 1 else ("or", flat)


def _grams(literal: str):
    s = literal.lower()
    return _and([("t", s[i : i + 3]) for i in range(len(s) - 2)])


def _expand(items) -> tuple[list[str] | None, object]:
    """The finite set of strings that a sequence matches (None if it isn't small), and its query."""
    exact: list[str] | None = [""]
    known: list[object] = []
    run: list[str] = [""]

    def flush():
        nonlocal run
        if run != [""]:
            known.append(_or(_grams(x) for x in run))
        run = [""]

    for op, arg in items:
        small: list[str] | None = None
        query: object = ANY
        if op is _c.LITERAL:
            small = [chr(arg)]
        elif op is _c.IN:
            chars = [chr(v) for k, v in arg if k is _c.LITERAL]
            if len(chars) == len(arg) <= 8:
                small = chars
            elif all(k in (_c.LITERAL, _c.RANGE) for k, _ in arg):
                wide = [chr(v) for k, v in arg if k is _c.LITERAL] + [chr(c) for k, v in arg if k is _c.RANGE for c in range(v[0], v[1] + 1)]
                small = wide if len(wide) <= 8 else None
        elif op is _c.SUBPATTERN:
            small, query = _expand(arg[3])
        elif op is _c.BRANCH:
            parts = [_expand(x) for x in arg[1]]
            small = sum((p[0] for p in parts), []) if all(p[0] is not None for p in parts) else None
            query = _or(p[1] for p in parts)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            lo, hi, sub = arg
            inner, q = _expand(sub)
            if inner is not None and hi <= 2 and len(inner) <= 4:
                small = [""] if lo == 0 else []
                level = [""]
                for n in range(1, hi + 1):
                    level = [a + b for a in level for b in inner]
                    small += level if n >= lo else []
            else:
                query = q if lo >= 1 else ANY
        elif op is _c.AT:
            small = [""]
        if small is not None and len(run) * len(small) <= 32:
            run = [a + b for a in run for b in small]
        else:
            flush()
            if small is not None:
                run = small
            else:
                known.append(query)
        exact = [a + b for a in exact for b in small] if exact is not None and small is not None and len(exact) * len(small) <= 32 else None
    flush()
    return exact, _and(known)


def trigram_query(rule: Rule):
    """The Boolean trigram query that every text with a match of the rule satisfies, or ANY."""
    return _expand(list(_p.parse(rule.pattern)))[1]


def query_trigrams(query) -> set[str]:
    if query is ANY:
        return set()
    return {query[1]} if query[0] == "t" else set().union(*map(query_trigrams, query[1]))


class BlockIndex:
    """Posting lists of the wanted trigrams over one block of texts (A-Z are indexed as a-z)."""

    def __init__(self, texts: Sequence[str], wanted: Sequence[str]):
        self.n = len(texts)
        self.postings = {t: np.zeros(0, np.int64) for t in wanted}
        if not wanted:
            return
        codes = np.frombuffer("\x00\x00".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.where(codes < 128, codes, 127).astype(np.uint8)
        small = np.where((small >= 65) & (small <= 90), small + 32, small).astype(np.uint8)
        key = small[:-2].astype(np.uint32) | small[1:-1].astype(np.uint32) << 7 | small[2:].astype(np.uint32) << 14
        number = {ord(t[0]) | ord(t[1]) << 7 | ord(t[2]) << 14: i for i, t in enumerate(wanted)}
        table = np.full(1 << 21, -1, np.int16)
        table[list(number)] = list(number.values())
        which = table[key]
        at = np.flatnonzero(which >= 0)
        ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, self.n))
        pairs = np.unique(which[at].astype(np.int64) * self.n + np.searchsorted(ends, at, side="right"))
        cuts = np.searchsorted(pairs, np.arange(len(wanted) + 1) * self.n)
        for i, t in enumerate(wanted):
            self.postings[t] = pairs[cuts[i] : cuts[i + 1]] - i * self.n

    def candidates(self, query) -> np.ndarray:
        if query is ANY:
            return np.arange(self.n)
        if query[0] == "t":
            return self.postings[query[1]]
        lists = sorted((self.candidates(q) for q in query[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


class Scanner:
    def __init__(self, rules: Sequence[Rule]):
        self.rules = rules
        self.queries = [trigram_query(r) for r in rules]
        self.wanted = sorted(set().union(*map(query_trigrams, self.queries)))
        self.patterns = [self._compiled(r) for r in rules]

    @staticmethod
    def _compiled(rule: Rule):
        # A whole run that has to be long needs no look at its shorter ones: a maximal run is matched or dropped.
        pattern = rule.pattern
        if rule.group == 0 and rule.least > 1 and re.fullmatch(r"\[[^\]]+\]\+", pattern):
            pattern = f"{pattern[:-1]}{{{rule.least},}}"
        return re.compile(pattern, (re.IGNORECASE if rule.ignore_case else 0) | re.ASCII)

    def spans(self, texts: Sequence[str]) -> list[list[tuple[int, int, int]]]:
        """Per text (start, rule's number, end), sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        index = BlockIndex(texts, self.wanted)
        for k, (rule, query, pattern) in enumerate(zip(self.rules, self.queries, self.patterns)):
            for i in index.candidates(query):
                for m in pattern.finditer(texts[i]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        for f in found:
            f.sort()
        return found

    def __call__(self, texts: Sequence[str | None]) -> list:
        n_base = len(BASE_RULES)
        columns: list[list] = [[], [], [], [], []]
        for f in self.spans([t or "" for t in texts]):
            base = [x for x in f if x[1] < n_base]
            for k in range(n_base):
                columns[k].append(sum(x[1] == k for x in base))
            show = lambda xs: ",".join(f"{self.rules[k].kind}:{a}:{b}" for a, k, b in xs)
            columns[3].append(hashlib.sha256(show(base).encode()).hexdigest())
            columns[4].append(show(f))
        return columns


def scan(docs: DataFrame, text_col: str = "text", more: Sequence[Rule] = MORE_RULES, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256 (of the base spans) and spans (all, ``kind:start:end``)."""
    rules = (*BASE_RULES, *more)
    outs = [T.StructField(f"n_{r.kind}", T.LongType()) for r in BASE_RULES] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    return map_texts(docs, text_col, docs.columns if carry is None else carry, outs, lambda: Scanner(rules))

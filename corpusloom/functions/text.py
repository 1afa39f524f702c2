r"""Text expressions: words, slugs, paths, titles, prose and chrome predicates. All are built-in column functions.

Word classes are written out where the dialects of regular expressions differ: ``[\p{L}\p{N}_]`` for a word character of
any script, ``[A-Za-z0-9_]`` where a rule is meant to see ASCII alone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple(
    sorted(
        (
            "a after all also an and any are as at be before between but by can do does each for from here how if in into is it its"
            " may more most must no not of on only or other per should so some such than that the their them then there these they"
            " this those to use used using via we what when where which while will with you your"
        ).split()
    )
)
FENCE = r"^(~{3,}|`{3,})[-.+\w]*$"
MARKER = r"^> .+ reference\. (Verbatim docs|Original prose); identifiers preserved verbatim\.\s*$"
#: Furniture of scraped pages, tested on whole lines outside code, case ignored but for the first.
SECTION_TITLED = r'^\s*Section titled\s+["“].*["”]\s*$'
CHROME = (
    r"(?iu)^\s*("
    r"(back to top|on this page|print this page|table of contents|all rights reserved\.?|was this page helpful\??)\s*$"
    r"|edit this page|licensed under\s|\(c\)\s+\d{4}|©.*(\d{4}|contributor|license|reserved)"
    r"|(sponsor|support)\s+(us\s+)?on\s+open\s+collective|\[(sponsor on github|support on open collective)\]\("
    r"|\[[^\]]*previous[\]][(][^)]*[)]\s*\[[^\]]*next[\]][(])"
)
GLYPHS = r"[\x{E000}-\x{F8FF}]"
EMPTY_FIGURE = r"\(Figure:\s*\)"
FILE_EXTENSIONS = tuple(
    sorted(
        (
            "bat cfg cmd cpp css csv dll exe gif glsl hlsl hpp htm html ini jpeg jpg js json jsx lock md mjs obj pdf png ps1 py rs rst"
            " sass scss sh so sql svg toml ts tsx webp wgsl xml yaml yml"
        ).split()
    )
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: What the regular expressions' \\s is.
SPACE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE))


def one_of(words: Sequence[str]) -> str:
    """A pattern for any of some words that branches letter by letter, so that most places fail at the first."""
    tails: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    body = "|".join(re.escape(a) + one_of(rest) for a, rest in tails.items())
    return f"(?:{body}){'?' if '' in words else ''}" if body else ""


def any_of(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words(text: Column) -> Column:
    """Lower-cased words of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+")).cast("bigint")


def slug(c: Column, fallback: str = "page", drop_extension: bool = True) -> Column:
    """Lower-case words joined by hyphens; a Markdown or HTML extension goes first."""
    stem = F.regexp_replace(c, r"\.(md|html?)$", "") if drop_extension else c
    dashed = F.lower(F.btrim(F.regexp_replace(stem, "[^0-9A-Za-z]+", "-"), F.lit("-")))
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit(fallback))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def token_estimate(chars: Column) -> Column:
    """A quarter of the characters, rounded half to even."""
    return F.bround(chars / 4, 0).cast("bigint")


def version(c: Column) -> Column:
    """The first N.N.N as a comparable struct, or null."""
    parts = [F.regexp_extract(c, r"([0-9]+)[.]([0-9]+)[.]([0-9]+)", i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.struct(*[p.cast("int").alias(n) for p, n in zip(parts, ("major", "minor", "patch"))]))


def clean_title(c: Column) -> Column:
    """Without line breaks, a trailing number in brackets and bold marks."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\u200B", "")
    t = F.regexp_replace(t, r"\\([<>])", "$1")
    t = F.regexp_replace(t, r"(?i)</?br\s*/?>", "")
    t = F.regexp_replace(t, r"\s*[(]\d+[)]\s*$", "")
    return strip(F.replace(F.regexp_replace(t, r"[*]{2}(.+?)[*]{2}", "$1"), F.lit("**"), F.lit("")))


def object_token(c: Column) -> Column:
    """What follows the last spaced dash."""
    return clean_title(F.element_at(F.split(c, r"\s+[-−–—]\s+"), -1))


def url_path(url: Column) -> Column:
    """The folders and the page of a URL, without host, documentation root, extensions and a closing index page."""
    rel = F.coalesce(F.try_url_decode(F.replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?i)^[a-z]+:/{2}[^/]+/", ""), F.lit("+"), F.lit("%2B"))), url)
    cut = rel
    for root in ("/master/", "/main/", "/src/pages/"):  # the last that applies wins; each cuts at its first place
        cut = F.when(F.locate(root, rel) > 0, F.substring(rel, F.locate(root, rel) + len(root), F.length(rel))).otherwise(cut)
    rel = cut
    parts = F.filter(F.split(rel, "/"), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?i)\.d\.ts$", ""), r"(?i)\.(html?|jsx|json|md|rst|tsx?|txt)$", ""))
    parts = F.when((F.size(parts) > 1) & F.lower(F.element_at(parts, -1)).isin("index", "readme"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("page")))


def is_fence(line: Column) -> Column:
    return strip(line).rlike(FENCE)


def preserved_removed(c: Column) -> Column:
    """Without inline code, links, addresses and figures."""
    for pattern, by in ((r"`[^`]*`", " "), (r"\[[^\]]*[\]][(][^)]*[)]", " "), (r"[\]][(]\s*[^)]*[)]", "] "), (r"https?://\S+", " "), (r"\(Figure:[^)]*\)", " ")):
        c = F.regexp_replace(c, pattern, by)
    return c


_SIX_WORDS = r"(?:[a-z]+[^a-z]+){5}[a-z]"
_STOPWORD = f"(?<![a-z]){one_of(STOPWORDS)}(?![a-z])"


def _wordy(c: Column) -> Column:
    """Six words of a to z, one of them a stopword; both searches end where they are sure."""
    low = F.lower(c)
    return low.rlike(_SIX_WORDS) & low.rlike(_STOPWORD)


def is_prose(line: Column) -> Column:
    """A line of narrative: six words, a stopword, and neither heading, quote, table row, marker nor bare bullet."""
    s = strip(line)
    shape = s.rlike(r"^(#|>|\||[-:]+\s*\|)") | s.rlike(r"^\|?\s*[:-]+\s*[|]") | s.rlike(r"^[*+-]\s+`?\[?[-:/.\w]+`?\]?\s*$")
    return (s != "") & ~shape & _wordy(s)


def is_signature(cell: Column) -> Column:
    call = F.contains(cell, F.lit("(")) & F.contains(cell, F.lit(")")) & cell.rlike(r"[A-Z][\w]*\s*[*&]\s*\w")
    return cell.rlike(r"\boperator\b") | cell.rlike(r"\)\s*const\b") | call


def is_prose_cell(cell: Column) -> Column:
    s = strip(cell)
    return (s != "") & ~is_signature(s) & _wordy(preserved_removed(s))


def is_chrome(line: Column) -> Column:
    return (F.contains(line, F.lit("Section titled")) & line.rlike(SECTION_TITLED)) | line.rlike(CHROME)


def has_residue(line: Column) -> Column:
    """Chrome, icon glyphs or an empty figure."""
    return is_chrome(line) | line.rlike(GLYPHS) | (F.contains(line, F.lit("(Figure:")) & line.rlike(EMPTY_FIGURE))


_CRUFT_MARK = r"[\u00A0\u2002\u2003\u2007-\u200A\u202F\uFEFF\x{E000}-\x{F8FF}\u00A7\u00B7]|\(Figure:|\[(?:Source|Read more)\]"


def cruft_removed(line: Column) -> Column:
    out = F.regexp_replace(line, r"[\u00A0\u2002\u2003\u2007-\u200A\u202F\uFEFF]", " ")
    for pattern in (GLYPHS, EMPTY_FIGURE, r"\[(Source|Read more)\]\([^)]*\)", r"\s*§", r"\s+·(?=\s)"):
        out = F.regexp_replace(out, pattern, "")
    return F.when(line.rlike(_CRUFT_MARK), out).otherwise(line)


def _identifier_like(w: Column) -> Column:
    return w.rlike(r"_|\d") | w.isin(*FILE_EXTENSIONS, "http", "https", "www")


def exemption(run: Column) -> Column:
    """Why a shared run of words may stay (identifiers, paths, numbers), or null for prose."""
    w = F.filter(F.split(run, r"\s+"), lambda x: x != "")
    n = F.size(w)
    share = F.try_divide(F.size(F.filter(w, _identifier_like)), n)
    marked = F.exists(w, lambda x: x.isin("http", "https", "www") | F.contains(x, F.lit("_")))
    digits = F.regexp_count(run, F.lit(r"\d"))
    return (
        F.when(n == 0, "EMPTY").when(share >= 0.5, "IDENT_DOMINATED").when((n <= 14) & (share > 0) & marked, "SHORT_IDENT").when((digits >= 8) & (share >= 0.3), "ENUM/NUM")
    )


def is_entry_start(line: Column) -> Column:
    """A sub-heading, or a short line that ends in a bold word."""
    return line.rlike(r"^#{2,}\s") | ((F.length(line) <= 90) & line.rlike(r"[*]{2}[^*]+[*]{2}\s*$"))


def is_distinctive(term: Column) -> Column:
    shaped = F.contains(term, F.lit(" ")) | term.rlike(r"[a-z][A-Z]") | F.contains(term, F.lit(".")) | (F.length(term) >= 10)
    return (F.length(term) >= 5) & shaped


def is_keyword(word: Column) -> Column:
    return ~word.isin(*STOPWORDS) & F.length(word).between(3, 30) & (F.regexp_count(word, F.lit("-")) <= 3) & ~word.rlike(r"^\d+$")


def is_heading_like(line: Column) -> Column:
    """A short label: at most 55 characters and 8 words, no closing punctuation, a capital, digit, bracket or quote first."""
    s = strip(line)
    return F.length(s).between(2, 55) & (F.size(F.split(s, r"\s+")) <= 8) & ~s.rlike(r"[.,:;)]$") & s.rlike(r"""^[A-Z0-9("']""")


def has_banned(text: Column, phrases: Sequence[str]) -> Column:
    return F.exists(any_of([p.lower() for p in phrases]), lambda p: F.contains(F.lower(text), p))


def is_kebab(name: Column) -> Column:
    return name.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$")


def is_safe_path(path: Column) -> Column:
    """Relative, with no parent, empty or hidden-root parts."""
    parts = F.split(path, "/")
    return (path != "") & ~path.rlike(r"^[/\\]|^[A-Za-z]:|\\") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def coalesce_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def all_replaced(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), pairs, c)


def marker_line(title: Column) -> Column:
    return F.concat(F.lit("> "), title, F.lit(" reference. Original prose; identifiers preserved verbatim."))


def package_title(slug_: Column) -> Column:
    """Words for hyphens, each with a capital."""
    return F.initcap(F.replace(slug_, F.lit("-"), F.lit(" ")))


def package_inner(path: Column) -> Column:
    """The folders between a package and its ``references`` folder; empty where there is none."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "references")
    return F.when(at > 1, F.array_join(F.slice(parts, 2, F.greatest(at - 2, F.lit(0)).cast("int")), "/")).otherwise("")


def filled(template: str, values: dict[str, Column]) -> Column:
    """``{{name}}`` places of a template, filled with columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def one_newline(c: Column) -> Column:
    return F.concat(rstrip(c), F.lit("\n"))

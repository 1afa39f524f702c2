"""Documents as lines: fence state, headings, prose units, cleaning, extraction and splicing.

A document's lines are an array inside its row. What a line depends on (the fence or heading above it) is found from the
places where a stretch of lines begins, so every operator here is an expression over one row, linear in its text: no text
is exploded to be grouped again, and only ``splice`` shuffles, since its rewrites come from another table. Columns:
``doc_id`` names the document, ``i`` counts its lines from 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.text import let


def stretches(array: Column, starts: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body(stretch, k, start)`` of each stretch of an array: the k-th (from 1) begins at the k-th of the ascending places
    ``starts`` and ends before the next one; number 0 is what comes before the first."""

    def each(a, s):
        last = F.size(s)

        def one(k):
            lo = F.when(k == 0, 0).otherwise(F.get(s, k - 1))
            hi = F.when(k < last, F.get(s, k)).otherwise(F.size(a))
            return let(lo, lambda at: body(F.slice(a, at + 1, hi - at), k, at))

        return F.transform(F.sequence(F.lit(0), last), one)

    return let(array, lambda a: let(starts, lambda s: each(a, s)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def places(array: Column, test: Callable[[Column], Column]) -> Column:
    """The places, from 0, of the elements for which ``test`` holds."""
    return F.array_compact(F.transform(array, lambda x, i: F.when(test(x), i)))


def fence_places(array: Column) -> Column:
    """The numbers of an array's lines that open or close a code fence. Texts without the marks of a fence, which are most,
    skip the search."""
    marked = F.exists(array, lambda x: F.contains(x, F.lit("```")) | F.contains(x, F.lit("~~~")))
    return F.when(marked, places(array, T.is_fence)).otherwise(F.array().cast("array<int>"))


def line_array(text: Column) -> Column:
    """The lines of a text: array of (i, line, is_fence, in_fence); a fence line is in the fence itself."""

    def structs(stretch, k, at):
        coded = k % 2 == 1
        return F.transform(stretch, lambda x, j: F.struct((at + j).alias("i"), x.alias("line"), (coded & T.is_fence(x)).alias("is_fence"), coded.alias("in_fence")))

    # A stretch of code starts with its opening fence, the next one behind the closing fence.
    return let(split_lines(text), lambda a: F.flatten(stretches(a, F.transform(fence_places(a), lambda p, j: p + j % 2), structs)))


def open_lines(text: Column) -> Column:
    """``line_array`` outside code."""
    return F.filter(line_array(text), lambda x: ~x["in_fence"])


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carry: str) -> DataFrame:
    """(id, i, line, is_fence, in_fence): every line."""
    return docs.select(id_col, *carry, F.inline(line_array(F.col(text_col))))


def units_of(line: Column) -> Column:
    """The prose units of a line outside code, array of (cell, indent, text): the line itself (cell null), or prose cells of a
    table row."""
    kind = "array<struct<cell:int,indent:string,text:string>>"

    def of(s):
        row = s.startswith("|") & ~s.rlike(r"^\|?\s*[:-]+\s*[|]")
        cells = F.transform(F.split(line, r"[|]", -1), lambda c, k: F.when(T.is_prose_cell(c), F.struct(k.alias("cell"), F.lit("").alias("indent"), T.strip(c).alias("text"))))
        whole = F.array(F.struct(F.lit(None).cast("int").alias("cell"), F.regexp_extract(line, r"^\s*", 0).alias("indent"), s.alias("text")))
        none = F.array().cast(kind)
        unusable = (s == "") | s.startswith("#") | s.rlike(T.MARKER)
        return F.when(unusable, none).when(row, F.array_compact(cells).cast(kind)).when(T.is_prose(line), whole.cast(kind)).otherwise(none)

    return let(T.strip(line), of)


def unit_array(text: Column) -> Column:
    """The prose units of a text: array of (i, cell, indent, text)."""
    each = F.transform(open_lines(text), lambda x: F.transform(units_of(x["line"]), lambda u: F.struct(x["i"].alias("i"), u["cell"].alias("cell"), u["indent"].alias("indent"), u["text"].alias("text"))))
    return F.flatten(each)


def prose_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, i, cell, indent, text): prose lines whole (cell null), and prose cells of table rows."""
    return docs.select(id_col, F.inline(unit_array(F.col(text_col))))


def total(array: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda s, x: s + value(x).cast("bigint"))


def prose_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prose_ratio, prose_words, total_words, prose_units, chrome, marker_ok) of every document."""
    text = F.col(text_col)
    said = docs.select(id_col, F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+")).cast("bigint").alias("total_words"), open_lines(text).alias("_open"))
    units = F.flatten(F.transform("_open", lambda x: units_of(x["line"])))
    words = lambda u: F.regexp_count(u["text"], F.lit(r"\S+"))
    prose = let(units, lambda u: F.struct(total(u, words).alias("pw"), F.size(u).cast("bigint").alias("pu")))
    marked = F.filter(F.transform("_open", lambda x: T.strip(x["line"])), lambda s: s.rlike(T.MARKER))
    ok = F.get(marked, F.lit(0)).endswith("Original prose; identifiers preserved verbatim.")
    chrome = F.size(F.filter("_open", lambda x: T.has_residue(x["line"]))).cast("bigint")
    got = said.select(id_col, "total_words", prose.alias("p"), chrome.alias("chrome"), F.coalesce(ok, F.lit(False)).alias("marker_ok"))
    ratio = F.coalesce(F.try_divide("p.pw", "total_words"), F.lit(0.0))
    return got.select(id_col, F.bround(ratio, 3).alias("prose_ratio"), F.col("p.pw").alias("prose_words"), "total_words", F.col("p.pu").alias("prose_units"), "chrome", "marker_ok")


def triage(scores: DataFrame) -> DataFrame:
    """Add faction, tier, mode, needs_cleanup and review by prose density."""
    little = (F.col("prose_units") == 0) | (F.col("prose_words") < 25)
    tier = F.when(little, "none").when(F.col("prose_units") <= 8, "light").when(F.col("prose_units") <= 25, "medium").otherwise("heavy")
    mode = F.when(little, "none").when(F.col("prose_ratio") < 0.35, "extract").otherwise("full")
    return scores.withColumns({
        "mode": mode, "faction": F.when(little, 1).otherwise(2), "review": ~little & (F.col("prose_units") <= 3), "tier": tier,
        "needs_cleanup": (F.col("chrome") > 0) | ~F.col("marker_ok"),
    })


def _is_heading(x: Column) -> Column:
    return ~x["in_fence"] & T.strip(x["line"]).startswith("#")


def with_headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines with the last heading at or above each ('' before the first)."""

    def headed(stretch, k, at):
        own = F.when(k == 0, F.lit("")).otherwise(T.strip(F.get(stretch, F.lit(0))["line"]))
        return let(own, lambda h: F.transform(stretch, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"), x["is_fence"].alias("is_fence"), x["in_fence"].alias("in_fence"), h.alias("heading"))))

    rows = let(line_array(F.col(text_col)), lambda a: F.flatten(stretches(a, places(a, _is_heading), headed)))
    return docs.select(id_col, F.inline(rows))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rewrite packets (id, i, cell, heading, text, total_lines): prose units under their headings."""

    def units(stretch, k, at):
        own = F.when(k == 0, F.lit("")).otherwise(T.strip(F.get(stretch, F.lit(0))["line"]))
        prose = F.filter(stretch, lambda x: ~x["in_fence"])
        each = lambda h, x: F.transform(units_of(x["line"]), lambda u: F.struct(x["i"].alias("i"), u["cell"].alias("cell"), h.alias("heading"), u["text"].alias("text")))
        return let(own, lambda h: F.flatten(F.transform(prose, lambda x: each(h, x))))

    packets = let(line_array(F.col(text_col)), lambda a: F.struct(F.flatten(stretches(a, places(a, _is_heading), units)).alias("u"), F.size(a).alias("n")))
    return docs.select(id_col, packets.alias("p")).select(id_col, F.col("p.n").alias("total_lines"), F.inline("p.u")).select(id_col, "i", "cell", "heading", "text", "total_lines")


def heading_blocks(docs: DataFrame, level: int = 2, id_col: str = "doc_id", text_col: str = "text", fenced: bool = True) -> DataFrame:
    """(id, block, title, body): the preamble (block 0, no title) and one block for each heading of a level."""
    mark = lambda x: x["line"].rlike(rf"^#{{{level}}} ") & (~x["in_fence"] if fenced else F.lit(True))

    def block(stretch, k, at):
        title = F.when(k > 0, T.strip(F.substring(F.get(stretch, F.lit(0))["line"], level + 2, 1 << 30)))
        inner = F.transform(F.when(k > 0, F.slice(stretch, 2, F.size(stretch))).otherwise(stretch), lambda x: x["line"])
        return F.struct(k.cast("bigint").alias("block"), title.alias("title"), T.strip(F.array_join(inner, "\n")).alias("body"))

    blocks = let(line_array(F.col(text_col)), lambda a: stretches(a, places(a, mark), block))
    return docs.select(id_col, F.inline(blocks)).where("block > 0 or body <> ''")


def code_of(rows: Column) -> Column:
    """The bodies of the code blocks among the lines of a ``line_array``, without their fences; null for one without any line."""

    def block(stretch, k, at):
        inner = F.filter(stretch, lambda x: ~x["is_fence"])
        body = F.when(F.size(inner) > 0, F.array_join(F.transform(inner, lambda x: x["line"]), "\n"))
        return F.struct(k.alias("k"), F.when(k % 2 == 1, body).alias("body"))

    def of(a):
        starts = F.transform(places(a, lambda x: x["is_fence"]), lambda p, j: p + j % 2)
        return F.transform(F.filter(stretches(a, starts, block), lambda b: b["k"] % 2 == 1), lambda b: b["body"])

    return let(rows, of)


def code_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block, body): the lines inside each fence; a fence that never closes runs to the end."""
    bodies = docs.select(id_col, F.posexplode(code_of(line_array(F.col(text_col)))).alias("block", "body"))
    return bodies.where("body is not null").select(id_col, F.col("block").cast("bigint").alias("block"), "body")


def open_of(rows: Column) -> Column:
    """The lines of a ``line_array`` that are no code, as one text."""
    return F.array_join(F.transform(F.filter(rows, lambda x: ~x["in_fence"]), lambda x: x["line"]), "\n")


def without_code(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, open_of(line_array(F.col(text_col))).alias("text"))


def cleaned(text: Column, clean_code: bool = True) -> Column:
    """(text, actions) of a text: scrape furniture removed outside code, markers normalised, blank runs collapsed.

    ``actions`` lists what was done with counts, in a fixed order. Right-trimming and the collapse of blank lines reach into
    code unless ``clean_code`` is off."""

    def one(x):
        line, code = x["line"], x["in_fence"]
        plain = F.struct((T.rstrip(line) if clean_code else line).alias("x"), F.lit(not clean_code).alias("code"), *[F.lit(False).alias(n) for n in ("n1", "n2", "drop", "fixed")])
        first = F.when(F.contains(line, F.lit("Section titled")), F.regexp_replace(line, r'Section titled\s+["“][^"”]*["”]\s*', "")).otherwise(line)

        def rest(a, b):
            gone = T.is_chrome(b)
            verbatim = F.contains(b, F.lit("Verbatim docs")) & T.strip(b).rlike(T.MARKER)
            return let(gone, lambda g: let(verbatim & ~g, lambda v: F.struct(
                T.rstrip(F.when(v, F.replace(b, F.lit("Verbatim docs"), F.lit("Original prose"))).otherwise(b)).alias("x"), F.lit(False).alias("code"),
                (a != line).alias("n1"), (b != a).alias("n2"), g.alias("drop"), v.alias("fixed"),
            )))

        return F.when(code, plain).otherwise(let(first, lambda a: let(T.cruft_removed(a), lambda b: rest(a, b))))

    def told(rows):
        count = lambda c: F.size(F.filter(rows, lambda r: r[c]))
        kept = F.filter(rows, lambda r: ~r["drop"])
        blank = lambda r: (r["x"] == "") & ~r["code"]

        def finish(k):
            once = F.filter(k, lambda r, i: ~(blank(r) & (i > 0) & F.coalesce(blank(F.get(k, i - 1)), F.lit(False))))
            names = {"n1": "strip_section_titled", "n2": "strip_scrape_cruft", "drop": "strip_chrome"}
            done = [F.when(count(c) > 0, F.concat(F.lit(f"{name}:"), count(c).cast("string"))) for c, name in names.items()]
            done.append(F.when(F.exists(rows, lambda r: r["fixed"]), F.lit("fix_marker")))

            def end(o):
                said = F.array(*done, F.when(F.size(o) < F.size(k), F.lit("normalize_blanks")))
                return F.struct(T.one_newline(F.array_join(F.transform(o, lambda r: r["x"]), "\n")).alias("text"), F.array_join(F.array_compact(said), ",").alias("actions"))

            return let(once, end)

        return let(kept, finish)

    return let(F.transform(line_array(text), one), told)


def clean_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clean_code: bool = True) -> DataFrame:
    """(id, text, actions): see ``cleaned``."""
    return docs.select(id_col, cleaned(F.col(text_col), clean_code).alias("_c")).select(id_col, "_c.text", "_c.actions")


def splice(docs: DataFrame, rewrites: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, replaced, skipped_non_prose, left_verbatim): rewrites (id, i, cell, text[, ord]) put into their prose units.

    Only units of the source can be replaced; rewrites for anything else are counted and ignored. The last of several
    rewrites for one unit (by ord) wins, but each counts as replaced. Rewrites meet their document in one shuffle; each is
    then looked for in its own line alone."""
    order = F.col("ord") if "ord" in rewrites.columns else F.lit(0)
    item = F.struct(order.alias("ord"), F.concat_ws(" ", F.split(F.col("text"), r"\R")).alias("new"), F.col("cell").cast("int").alias("cell"))
    per = rewrites.groupBy(id_col, "i").agg(F.sort_array(F.collect_list(item)).alias("r")).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("_r"))
    lead = lambda seg, p: T.coalesce_text(F.regexp_extract(seg, p, 0), F.lit(" "))

    def put(line, units, items):
        """A line's new text and counts. ``items``: its rewrites in order, null for a line that has none."""
        known = F.filter(items, lambda r: F.exists(units, lambda u: u["cell"].eqNullSafe(r["cell"])))

        def done(k):
            last = lambda own: F.element_at(F.filter(k, own), -1)["new"]
            whole = let(F.when(F.exists(k, lambda r: r["cell"].isNull()), last(lambda r: r["cell"].isNull())), lambda w: F.when(w.isNotNull(), F.concat(F.regexp_extract(line, r"^\s*", 0), T.strip(w))))
            cell = lambda seg, c: F.when(F.exists(k, lambda r: r["cell"] == c), F.concat(lead(seg, r"^\s+"), T.strip(last(lambda r: r["cell"] == c)), lead(seg, r"\s+$"))).otherwise(seg)
            table = F.array_join(F.transform(F.split(line, r"[|]", -1), cell), "|")
            left = F.size(F.filter(units, lambda u: ~F.exists(k, lambda r: r["cell"].eqNullSafe(u["cell"]))))
            return F.struct(
                F.when(F.size(k) == 0, line).otherwise(F.coalesce(whole, table)).alias("line"), F.size(k).alias("replaced"), (F.size(items) - F.size(k)).alias("skipped"), left.alias("left")
            )

        return let(known, done)

    kept = lambda line, units: F.struct(line.alias("line"), F.lit(0).alias("replaced"), F.lit(0).alias("skipped"), F.size(units).alias("left"))
    units = lambda x: F.when(x["in_fence"], F.array().cast("array<struct<cell:int,indent:string,text:string>>")).otherwise(units_of(x["line"]))

    def rows(a, asked):
        inside = F.filter(asked, lambda r: r["i"].isNotNull() & (r["i"] >= 0) & (r["i"] < F.size(a)))
        outside = total(F.filter(asked, lambda r: ~F.coalesce((r["i"] >= 0) & (r["i"] < F.size(a)), F.lit(False))), lambda r: F.size(r["r"]))

        def stretch(mine):
            def each(part, k, at):
                hit = lambda x, j: F.when((k > 0) & (j == 0), put(x["line"], units(x), F.get(mine, k - 1)["r"])).otherwise(kept(x["line"], units(x)))
                return F.transform(part, hit)

            return F.flatten(stretches(a, F.transform(mine, lambda r: r["i"].cast("int")), each))

        return F.struct(let(inside, stretch).alias("rows"), outside.alias("outside"))

    none = F.array().cast(per.schema["_r"].dataType)
    got = docs.select(id_col, text_col).join(per, id_col, "left").select(id_col, let(line_array(F.col(text_col)), lambda a: let(F.coalesce("_r", none), lambda r: rows(a, r))).alias("s"))
    text = F.array_join(F.transform("s.rows", lambda r: r["line"]), "\n")
    sums = {"replaced": "replaced", "skipped_non_prose": "skipped", "left_verbatim": "left"}
    counts = [(total(F.col(f"s.rows.{c}"), lambda x: x) + (F.col("s.outside") if c == "skipped" else F.lit(0))).alias(n) for n, c in sums.items()]
    return got.select(id_col, text.alias("text"), *counts)

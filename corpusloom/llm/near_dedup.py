"""MinHash near-duplicate groups by fast similarity sketching, banding and exact verification.

1. A sketch has ``COORDS`` coordinates. In each round every shingle is hashed into one bin with a value, and a bin keeps
   its smallest; values of later rounds are larger. After ``COORDS`` rounds, further rounds address the bins one by one, so
   that every coordinate fills. A text needs a few rounds unless it is tiny.
2. Texts with equal shingle sets form a class at once, by a digest of the set; classes alone go on.
3. Band hashes bucket the classes. A bucket's members are compared with its smallest member, never all with all.
4. Candidates whose sizes and sketches allow the similarity are verified on full shingle sets; confirmed links make
   components.
5. Members of one bucket that are then still in different components are compared as well, so a link is not lost for want
   of a comparison: all members with those outside the bucket's largest component. Two texts at the threshold share no
   bucket with probability 3e-6 (0.8 ** ROWS in each of BANDS bands); more similar ones far less.
6. Where that is more than ``MOST_TESTS`` comparisons in one bucket, its members are joined exactly instead, by prefixes:
   with all shingles in order of rarity, two sets that are similar enough share one of the first ``n - ceil(0.8 n) + 1``
   of each, so only texts that share a rare shingle meet.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a one-word text has its word as
the one shingle. A null id stays alone with a null component. Rows that repeat an id are classed by their own texts; classes whose smallest id
is the same are one. Ties go to the smallest id. Columns besides the two used are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, blocks, free_name, hashed, hot_join, map_texts, mix, pair, shingle2, space_words, stored, tune
from .graph import components

BANDS, ROWS = 32, 5
COORDS = BANDS * ROWS
#: Members of a pivot that one task verifies before the pivot's text is sent to another.
CHUNK = 256
#: Comparisons of two members' cards within one bucket, from which on the bucket goes the way by prefixes.
MOST_TESTS = 4_000_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Coordinates of two sketches that must agree before full sets are compared, 5.5 standard deviations below what a pair
#: at a similarity of 0.8 has: such a pair falls short with probability 2e-8, one at 0.5 passes with 2e-3.
NIBBLES = 16
SLACK = 5.5


def similarity_sketch(own: np.ndarray, sh: np.ndarray, n: int, t: int = COORDS) -> np.ndarray:
    """Sketches [n, t] of the sets given by owner (sorted) and element hash. Owners without elements keep empty ones."""
    out = np.full((n, t), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    o, x = own, sh
    for i in range(2 * t):
        if not len(o):
            break
        v = mix(x ^ mix(np.uint64([i * 2 + 1]))[0])
        if i < t:
            at = o * t + ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            at = o * t + (i - t)
        np.minimum.at(flat, at, np.uint64(i) << np.uint64(48) | mix(v) >> np.uint64(16))
        open_ = (out == _EMPTY).any(1)
        keep = open_[o]
        o, x = o[keep], x[keep]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys a sketch; the band's number is mixed in."""
    out = np.empty((len(sketch), BANDS), np.int64)
    for b in range(BANDS):
        h = np.full(len(sketch), b + 1, np.uint64)
        for c in range(b * ROWS, (b + 1) * ROWS):
            h = pair(h, sketch[:, c])
        out[:, b] = h.view(np.int64)
    return out


def signature(sketch: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen coordinates to a 64-bit integer."""
    bits = (sketch & np.uint64(15)).reshape(len(sketch), -1, NIBBLES) << (np.arange(NIBBLES, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(bits, axis=2).view(np.int64)


def least_agreeing(percent: int) -> int:
    """Agreeing coordinates that a pair at the threshold has, but for a deviation of SLACK; four bits agree by chance once in 16."""
    p = percent / 100 + (1 - percent / 100) / 16
    return int(COORDS * p - SLACK * (COORDS * p * (1 - p)) ** 0.5)


def _alike(x: str, y: str, percent: int) -> str:
    """SQL: sizes and signatures of two rows allow the similarity."""
    words = []
    for i in range(COORDS // NIBBLES):
        d = f"({x}.sig[{i}] ^ {y}.sig[{i}])"
        words.append(f"bit_count(({d} | shiftrightunsigned({d}, 1) | shiftrightunsigned({d}, 2) | shiftrightunsigned({d}, 3)) & 1229782938247303441L)")
    sizes = f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
    return f"{sizes} and {' + '.join(words)} <= {COORDS - least_agreeing(percent)}"


class Sketcher:
    def __init__(self):
        self.hasher = WordHasher()

    def __call__(self, texts: list[str | None]) -> list:
        h, counts = hashed(texts, space_words, self.hasher)
        own, sh = shingle2(h, counts)
        sizes = np.bincount(own, minlength=len(texts))
        sketch = similarity_sketch(own, sh, len(texts))
        keys = band_keys(sketch)
        sigs = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * (COORDS // NIBBLES), pa.int32()), pa.array(signature(sketch).reshape(-1)))
        cuts = np.cumsum(sizes)[:-1]
        digests = [xxhash.xxh3_128_digest(np.ascontiguousarray(s).tobytes()) if len(s) else None for s in np.split(sh, cuts)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
        return [digests, pa.array(sizes, pa.int64()), lists, sigs]


def _verified(docs: DataFrame, edges: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough. Hot ends are split over tasks, with a copy of their text."""
    hot = stored(edges.groupBy("b").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("_chunks"), F.count("*").alias("_n")), "chunks")
    member = hot_join(edges, hot, "b", "_n", edges.count(), ["_chunks"], look=True).select(F.col("a").alias("_doc"), "b", F.pmod(F.xxhash64("a"), F.col("_chunks")).cast("int").alias("_chunk"), F.lit(1).alias("_role"))
    pivot = hot.select(F.col("b").alias("_doc"), "b", F.explode(F.expr("sequence(0, _chunks - 1)")).alias("_chunk"), F.lit(0).alias("_role"))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    # Shuffled at every size: the pairs grow with the corpus.
    rows = texts.join(member.unionByName(pivot).hint("merge"), "_doc").select("_doc", "b", "_chunk", "_role", "_text")
    rows = rows.repartition("b", "_chunk").sortWithinPartitions("b", "_chunk", "_role", "_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, sets = WordHasher(), None, []
        for batch in batches:
            doc, b, chunk, role, texts = (batch.column(i).to_pylist() for i in range(5))
            left, right = [], []
            for lo, hi in blocks(texts):
                own, sh = shingle2(*hashed(texts[lo:hi], space_words, hasher))
                split = np.split(sh, np.searchsorted(own, np.arange(1, hi - lo)))
                for i in range(lo, hi):
                    s = split[i - lo]
                    if role[i] == 0:
                        sets = [*(sets if held == (b[i], chunk[i]) else []), s]
                        held = (b[i], chunk[i])
                    else:
                        for p in sets:
                            at = np.searchsorted(p, s)
                            at[at == len(p)] = 0
                            common = int((p[at] == s).sum()) if len(p) else 0
                            if 100 * common >= percent * (len(p) + len(s) - common):
                                left.append(doc[i])
                                right.append(b[i])
                                break
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row for each row of ``docs``."""
    return _grouped(docs, id_col, text_col, percent).drop("_key")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept: the first of each group, and all that are linked with nothing. Of wholly equal rows
    with a text one stays."""
    names = docs.columns
    by, key = free_name(names, "_gone"), free_name(names, "_key")
    groups = _grouped(docs, id_col, text_col, percent).select(F.col(id_col).alias(by), F.col("_key").alias(key), "kept", "n_shingles")
    gone = groups.where(~F.col("kept")).select(by, key).distinct()
    twice = groups.where(F.col("kept") & (F.col("n_shingles") > 0) & F.col(by).isNotNull()).groupBy(by, key).agg(F.count("*").alias("_n")).where("_n > 1").select(by, key)
    twice = stored(twice, "equal")
    keyed = docs.withColumns({by: F.col(f"`{id_col}`").cast("bigint"), key: F.xxhash64(F.col(f"`{text_col}`").cast("string"))})
    left = keyed.join(gone.hint("merge"), [by, key], "left_anti")
    if twice.limit(1).count():
        one = left.join(twice, [by, key], "left_semi").dropDuplicates([by, key])
        left = left.join(twice, [by, key], "left_anti").unionByName(one)
    return left.select(*[F.col(f"`{c}`") for c in names])


def _cross(own: DataFrame, tables: DataFrame, percent: int) -> DataFrame:
    """(a, b): members (key, id, component, n, sig) of one key, but of two components, whose cards are alike. ``tables``: (key,
    big), the largest component of each key; its members are compared with the others', not with each other."""
    rows = own.join(tables.select("key", "big").hint("merge"), "key").withColumn("small", F.col("component") != F.col("big"))
    x, y = rows.alias("x"), rows.where("small").alias("y")
    got = x.join(y, F.expr("x.key = y.key and x.component <> y.component and (not x.small or x.id > y.id) and " + _alike("x", "y", percent)))
    return got.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))


def _tables(own: DataFrame) -> DataFrame:
    """(key, big, size, tests) of the keys with members of several components."""
    per = own.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key")
    per = per.agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    return per.select("key", F.col("m.component").alias("big"), "size", (F.col("size") * (F.col("size") - F.col("m.c"))).alias("tests"))


def _by_prefixes(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the members (id, component, n, sig) of different components that may be similar: an exact join by the rarest
    shingles. ``docs``: (_id, _key, _body)."""

    def make():
        hasher = WordHasher()

        def run(texts: list[str | None]) -> list:
            own, sh = shingle2(*hashed(texts, space_words, hasher))
            cuts = np.searchsorted(own, np.arange(len(texts) + 1))
            return [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(sh.view(np.int64)))]

        return run

    mine = docs.join(members.select(F.col("id").alias("_id")).hint("merge"), "_id", "left_semi")
    sets = stored(map_texts(mine, "_body", ["_id", "_key"], [T.StructField("sh", T.ArrayType(T.LongType()))], make), "sets")
    flat = sets.select("_id", "_key", F.explode("sh").alias("key"))
    often = flat.groupBy("key").agg(F.count("*").alias("often"))
    total = sets.agg(F.sum(F.size("sh"))).first()[0] or 0
    # Counted twice, since the count both finds hot shingles and orders them.
    ranked = hot_join(flat, often.withColumn("f", F.col("often")), "key", "often", total, ["f"])
    n = F.size("s")
    first = F.slice(F.array_sort("s"), 1, (n - F.ceil(n * percent / 100).cast("int") + 1))
    rare = ranked.groupBy("_id", "_key").agg(F.collect_list(F.struct("f", "key")).alias("s")).select(F.col("_id").alias("id"), F.explode(first).alias("s"))
    own = stored(rare.select("id", F.col("s.key").alias("key")).distinct().join(members, "id"), "rare")
    return _cross(own, _tables(own), percent)


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    tune(docs.sparkSession)
    body = F.col(f"`{text_col}`").cast("string")
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), body.alias("_body"), F.xxhash64(body).alias("_key"))
    longs = T.ArrayType(T.LongType())
    outs = [T.StructField("digest", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("bands", longs), T.StructField("sig", longs)]
    sketches = stored(map_texts(docs, "_body", ["_id", "_key"], outs, Sketcher), "sketches")
    usable = sketches.where("n_shingles > 0 and _id is not null")
    classes = usable.groupBy("digest").agg(F.min("_id").alias("cls"), F.count("*").alias("_n"))
    chosen = usable.join(classes.select(F.col("digest"), F.col("cls").alias("_id")), ["digest", "_id"]).dropDuplicates(["digest"])
    chosen = stored(chosen.select(F.col("_id").alias("id"), F.col("n_shingles").alias("n"), "sig", "bands"), "classes")
    banded = chosen.select(F.explode("bands").alias("key"), "id")
    pivots = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("_last"), F.count("*").alias("_n")).where("pivot <> _last")
    members = stored(hot_join(banded, stored(pivots, "pivots"), "key", "_n", chosen.count() * BANDS, ["pivot"], look=True), "buckets")
    card = chosen.select("id", "n", "sig")
    # Texts that can be in a pair at all cross the network once; both verifications start from these.
    docs = stored(docs.join(members.select(F.col("id").alias("_id")).distinct().hint("merge"), "_id", "left_semi"), "candidates")

    pairs = stored(members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    pivot_cards = pairs.groupBy("b").agg(F.count("*").alias("_n")).join(card.select(F.col("id").alias("b"), F.struct("n", "sig").alias("y")), "b")
    pairs = pairs.join(card.select(F.col("id").alias("a"), F.struct("n", "sig").alias("x")), "a")
    pairs = hot_join(pairs, stored(pivot_cards, "cards"), "b", "_n", members.count(), ["y"], look=True)
    tested = stored(pairs.where(_alike("x", "y", percent)).select("a", "b"), "pairs")
    links = stored(_verified(docs, tested, "_id", "_body", percent), "links")
    comp = components(links)

    # What one bucket holds of several components: compare those as well.
    own = members.select("key", "id").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    tables = stored(_tables(own), "open")
    open_ = stored(hot_join(own, tables, "key", "size", members.count(), ["tests"], look=True).join(card, "id"), "open")
    more = _cross(open_.where(F.col("tests") <= MOST_TESTS).drop("tests"), tables, percent)
    heavy = open_.where(F.col("tests") > MOST_TESTS).select("id", "component", "n", "sig").dropDuplicates(["id"])
    if tables.where(F.col("tests") > MOST_TESTS).limit(1).count():
        more = more.unionByName(_by_prefixes(docs, stored(heavy, "heavy"), percent))
    more = stored(more.distinct().join(tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    if more.limit(1).count():
        extra = stored(_verified(docs, more, "_id", "_body", percent), "links")
        if extra.limit(1).count():
            comp = components(links.unionByName(extra))

    named = classes.join(comp, classes.cls == comp.id, "left").select("digest", "_n", F.coalesce("component", "cls").alias("component_id"))
    grouped = F.col("digest").isNotNull() & F.col("_id").isNotNull()
    slim = sketches.select("_id", "_key", "digest", "n_shingles")
    out = hot_join(slim.where(grouped), stored(named, "named"), "digest", "_n", sketches.count(), ["component_id"], look=True)
    out = out.unionByName(slim.where(~grouped).withColumn("component_id", F.col("_id")))
    out = out.select(F.col("_id").alias(id_col), "_key", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))

"""Fuzzy line deduplication by MinHash. DataFrame operations only.

A line is compared lower-cased, its words parted by single spaces. Its shingles are the strings of WIDTH
characters at every position, as 64-bit hashes; a shorter line has one shingle, all of it. Each of
ROWS * PLACES fixed random numbers gives a minimum of the line: the shingle hash nearest to the
number by exclusive or. ROWS minima are a band, BANDS bands share the minima so that two have one in common at
most. Two lines of Jaccard similarity 0.8 share a band with probability 0.997 (0.9999 at 0.9).

1. Different lines are gathered by one exchange of their text, and the minima of all their
   shingles are taken where they lie.
2. Each line that shares a band is marked by the number of its different shingles and their parity, WORDS * 64 bits in which
   each shingle flips one. Two lines differ in as many shingles at least as their parities in bits, so the marks
   pass over most pairs that aren't similar, and none that is. The pairs they leave are verified by exact Jaccard on
   all shingles, made again from the text. Union-find ties what is similar.
3. Of a band of SMALL lines or fewer all pairs go that way. In a larger one each line goes with the most common line of
   the band that it shares most bands with (a star). The most common line is the one whose bands hold most lines: of
   an original and its copies, each with a change of its own, the original.
4. Large bands that still hold several components are finished: the marks of each line outside the band's most
   frequent component are compared with those of all lines of that component, and of the others of its kind. They are
   compared in blocks inside rows, so only pairs that the marks leave are rows, and no task holds a large
   component. No similar pair that shares a band stays untied.

Of each component the line of least (doc_id, line number) stays, and all others go. Counts and least
places are combined before each exchange, and joins have unique keys on one side, so adaptive execution
splits a hot band, line or component.

Lines of one shingle go with equal ones only. Blank lines (white space only) are always kept and never
compared. A null text has no lines, an empty one has one blank line. Null ids come before all others;
rows equal in id and text are one document with one row. Other columns are not read, so their names don't
matter; clean() keeps them. An empty table gives an empty result.
"""

from __future__ import annotations

import random
from contextlib import contextmanager
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, drop_cut, fresh, table

WIDTH, ROWS, PLACES, BANDS, STEP, BLOCK, SMALL, PASSES = 8, 3, 5, 14, 16, 64, 8, 3
#: 64-bit words of the parity of an array, and of a line's; a power of two.
PARITY, WORDS, GROUP = 4, 16, 8
#: Whether an aggregation looks up its rows in a small table before the large one. Keys that hardly repeat are only delayed by it.
TWO_LEVELS = "spark.sql.codegen.aggregate.map.twolevel.enabled"
#: Rows of one or two numbers that are broadcast at most, a few MB; larger tables are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of a character in UTF-32, in which the n-th character of a line is found without a scan.
CHAR = 4
#: White space as Python's str.split() has it, as a class of characters, and the UTF-8 bytes
#: that all of it beyond ASCII begins with. Most lines hold none of them and are passed over without a pattern.
SPACE = r"[\x20\t-\r\x1c-\x1f\x85\xa0  -     　]"
SPACE_BYTES = ("C285", "C2A0", "E19A80", "E280", "E2819F", "E38080")


def line_shingles(lines: list) -> tuple:
    """The rule for lists, without Spark: line i has the different strings out[first[i]:first[i + 1]]."""
    out, first = [], [0]
    for line in lines:
        out += sorted({line[k : k + WIDTH] for k in range(max(1, len(line) - WIDTH + 1))})
        first.append(len(out))
    return out, first


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def compared(raw):
    """A line in the form in which it is compared."""
    odd = F.contains(raw, F.lit("  ")) | raw.rlike(r"[\x00-\x1f]")
    for start in SPACE_BYTES:
        odd = odd | F.contains(raw.cast("binary"), F.expr(f"X'{start}'"))
    return F.trim(F.lower(F.when(odd, F.regexp_replace(raw, f"{SPACE}+", " ")).otherwise(raw)))


def lines(docs: DataFrame) -> DataFrame:
    """A row for each line that isn't blank: doc_id, text_hash, line_no, node (its hash), line (as compared)."""
    # outer: an inner explode would split the text twice
    rows = hashed(docs).select("doc_id", "text_hash", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "raw"))
    rows = rows.where(F.col("raw").rlike(f"[^{SPACE[1:]}"))
    return rows.select("doc_id", "text_hash", "line_no", compared(F.col("raw")).alias("line")).select("doc_id", "text_hash", "line_no", F.xxhash64("line").alias("node"), "line")


def last_shingle(wide):
    """First byte (from 1) of the last shingle of a line in UTF-32."""
    return F.greatest(F.lit(0), F.octet_length(wide) / CHAR - WIDTH).cast("int") * CHAR + 1


def shingles(line):
    """Array of the hashes of all shingles of a line."""
    each = lambda wide: F.transform(F.sequence(F.lit(1), last_shingle(wide), F.lit(CHAR)), lambda at: F.xxhash64(F.substr(wide, at, F.lit(WIDTH * CHAR))))
    return F.transform(F.array(F.encode(line, "UTF-32")), each)[0]


def bands() -> list:
    """The numbers of the ROWS minima of each band: column r of a grid has PLACES minima, and two bands share one at most."""
    lines_ = [(a, b) for b in range(PLACES) for a in range(PLACES)][:BANDS]
    return [[r * PLACES + (a + b * r) % PLACES for r in range(ROWS)] for a, b in lines_]


def sketched(all_: DataFrame) -> DataFrame:
    """A row for each different line: node, and each of its bands in a column of its own, k0 and on.

    A row of the explode takes STEP shingles, whose minima are found before they are grouped. Groups lie as
    the exchange of the different lines left them, so there is no further one.
    """
    rng = random.Random(20)
    marks = [rng.getrandbits(64) - (1 << 63) for _ in range(ROWS * PLACES)]
    once = all_.groupBy("node").agg(F.first("line").alias("line"))
    wide = once.select("node", "line", F.encode("line", "UTF-32").alias("wide"))
    wide = wide.select("node", "line", "wide", last_shingle(F.col("wide")).alias("last"))
    # outer: from an inner explode Spark infers a filter that would make the positions twice
    each = wide.select("node", "wide", "last", F.explode_outer(F.sequence(F.lit(1), F.col("last"), F.lit(STEP * CHAR))).alias("at"))
    each = each.select("node", *[F.expr(f"xxhash64(substring(wide, least(at + {k * CHAR}, last), {WIDTH * CHAR}))").alias(f"h{k}") for k in range(STEP)])
    least = each.groupBy("node").agg(*[F.min(F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(m)) for k in range(STEP)])).alias(f"m{i}") for i, m in enumerate(marks)])
    return least.select("node", *[F.xxhash64(F.lit(n), *[F.col(f"m{i}") for i in band]).alias(f"k{n}") for n, band in enumerate(bands())])


@contextmanager
def one_level(spark):
    """Aggregations inside have one table of rows."""
    before = spark.conf.get(TWO_LEVELS, "true")
    spark.conf.set(TWO_LEVELS, "false")
    try:
        yield
    finally:
        spark.conf.set(TWO_LEVELS, before)


def bounded(df: DataFrame) -> DataFrame:
    """The table of keys, to be broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verify(texts: DataFrame, pairs: DataFrame, up: int, down: int) -> DataFrame:
    """src and dst of the pairs (a, b, src, dst) of lines whose shingles' Jaccard similarity is up / down or more, in whole numbers."""
    left, right = texts.select(F.col("node").alias("a"), F.col("line").alias("x")), texts.select(F.col("node").alias("b"), F.col("line").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("src", "dst", shingles(F.col("x")).alias("x"), shingles(F.col("y")).alias("y"))
    sizes = both.select("src", "dst", F.size(F.array_intersect("x", "y")).alias("common"), F.size(F.array_union("x", "y")).alias("all"))
    # exploded: Spark would put a plain filter below, where the shingles are made again wherever they are named
    return cut(sizes.select("src", "dst", F.explode_outer(F.array(F.col("common") * down >= F.col("all") * up)).alias("alike")).where("alike").select("src", "dst"))


def joined(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """The groups after more edges (src, dst) between their components, or nodes that have none yet."""
    more = components(edges)
    old = groups.join(more.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    new = more.join(groups, "node", "left_anti").select("node", "component")
    return cut(old.select("node", F.coalesce("root", "component").alias("component")).union(new))


def parity(array: str) -> list:
    """PARITY numbers in whose bits each shingle of an array of different ones flips one.

    A shingle that only one of two arrays has flips one bit of the difference, so two arrays differ in as many shingles at least as their parities in bits.
    """
    flip = "CASE WHEN ((x >> 6) & {}) = {} THEN shiftleft(1L, CAST(x & 63 AS INT)) ELSE 0L END"
    return [F.expr(f"aggregate({array}, 0L, (a, x) -> a ^ {flip.format(PARITY - 1, k)})").alias(f"p{k}") for k in range(PARITY)]


def marked(texts: DataFrame) -> DataFrame:
    """node, n (the line's different shingles) and their parity(), but WORDS numbers p0 and on, taken from GROUP shingles a row."""
    sets = texts.select("node", F.array_distinct(shingles(F.col("line"))).alias("s"))
    each = sets.select("node", "s", F.explode_outer(F.sequence(F.lit(0), F.size("s") - 1, F.lit(GROUP))).alias("at"))
    each = each.select("node", F.size("s").alias("n"), *[F.get("s", F.col("at") + k).alias(f"x{k}") for k in range(GROUP)])
    flips = [F.expr(f"CASE WHEN x{k} IS NULL THEN 0L ELSE shiftleft(1L, CAST(x{k} & 63 AS INT)) END").alias(f"f{k}") for k in range(GROUP)]
    each = each.select("node", "n", *[F.expr(f"CAST((x{k} >> 6) & {WORDS - 1} AS INT)").alias(f"w{k}") for k in range(GROUP)], *flips)
    word = lambda i: reduce(lambda x, y: x.bitwiseXOR(y), [F.when(F.col(f"w{k}") == i, F.col(f"f{k}")).otherwise(F.lit(0).cast("long")) for k in range(GROUP)])
    return each.groupBy("node").agg(F.max("n").alias("n"), *[F.bit_xor(word(i)).alias(f"p{i}") for i in range(WORDS)])


def differ(x, y):
    """A number of shingles in which two marked lines differ at least; x and y give their columns by name."""
    return F.greatest(F.abs(x("n") - y("n")), reduce(add, [F.bit_count(x(f"p{k}").bitwiseXOR(y(f"p{k}"))) for k in range(WORDS)]))


def may_be_alike(x, y, up: int, down: int):
    """Whether the marks of two lines allow a similarity of up / down: two lines of n shingles together that differ in d have (n - d) / 2 in common, and (n + d) / 2 in all."""
    n, d = x("n") + y("n"), differ(x, y)
    return (n - d) * down >= (n + d) * up


def sieved(marks: DataFrame, pairs: DataFrame, up: int, down: int) -> DataFrame:
    """The pairs (a, b) whose marks allow that they are similar."""
    ends = [marks.select(*[F.col(c).alias(f"{end}_{c}") for c in marks.columns]) for end in "xy"]
    both = pairs.join(ends[0], F.col("a") == F.col("x_node")).join(ends[1], F.col("b") == F.col("y_node"))
    return both.where(may_be_alike(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"), up, down)).select("a", "b", "src", "dst")


def shared_bands(once: DataFrame, names: list) -> DataFrame:
    """key, node, size, before: the lines of the bands of these columns that several lines share.

    before: those of the band ahead of this one, so that each pair is there once; null in a band of four and more.
    """
    keys = once.select("node", F.explode(F.array(*names)).alias("key"))
    # the lines of a band of two or three follow from these; only larger bands are joined to all keys again
    ends = [F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor("node").alias("mixed"), F.count("*").alias("size")]
    with one_level(once.sparkSession):
        meet = cut(keys.groupBy("key").agg(*ends).where("size > 1"))
    third = F.when(F.col("size") == 3, F.col("mixed").bitwiseXOR(F.col("least")).bitwiseXOR(F.col("most")))
    known = meet.where("size <= 3").select("key", F.array_compact(F.array("least", "most", third)).alias("all"), "size")
    known = known.select("key", "size", "all", F.posexplode("all").alias("i", "node")).select("key", "node", "size", F.slice("all", F.lit(1), F.col("i")).alias("before"))
    large = keys.join(bounded(meet.where("size > 3").select("key", "size")), "key").select("key", "node", "size", F.lit(None).cast("array<long>").alias("before"))
    out = cut(known.union(large))
    drop_cut(meet)
    return out


def small_pairs(shared: DataFrame) -> DataFrame:
    """(a, b, src, dst), once for each two lines that share a band of SMALL lines or fewer."""
    told = shared.where("size <= 3").select(F.col("node").alias("x"), F.explode("before").alias("y"))
    few = shared.where((F.col("size") > 3) & (F.col("size") <= SMALL))
    met = few.select("key", F.col("node").alias("x")).join(few.select("key", F.col("node").alias("y")), "key").where("x > y").select("x", "y")
    pairs = told.union(met).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    return pairs.withColumns({"src": F.col("a"), "dst": F.col("b")})


def link(all_: DataFrame, up: int = 4, down: int = 5) -> DataFrame:
    """(node, component) of the lines that have a similar line; all_ is lines(), a table that is dropped once it is read."""
    once = cut(sketched(all_))
    # some bands after the other, so that the keys of all of them never lie on disk at once
    parts = [shared_bands(once, [f"k{n}" for n in range(BANDS)][i::PASSES]) for i in range(PASSES)]
    drop_cut(once)
    shared = reduce(DataFrame.union, parts)
    common = cut(shared.groupBy("node").agg(F.sum("size").alias("common")))
    # only lines that share a band are needed again
    texts = all_.select("node", "line").join(bounded(common.select("node")), "node", "left_semi")
    texts = cut(texts.groupBy("node").agg(F.first("line").alias("line")), "zstd")
    drop_cut(all_)
    large = cut(shared.where(F.col("size") > SMALL).select("key", "node").join(common, "node"))
    centres = large.groupBy("key").agg(F.max(F.struct("common", "node")).alias("centre")).select("key", "centre.*").withColumnRenamed("node", "b")
    star = large.select("key", "node").join(centres, "key").where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("bands"), F.max("common").alias("common"))
    best = star.groupBy("a").agg(F.max(F.struct("bands", "common", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    marks = cut(marked(texts))
    pairs = cut(sieved(marks, small_pairs(shared).union(best.withColumns({"src": F.col("a"), "dst": F.col("b")})), up, down))
    drop_cut(common, *parts)
    tied = verify(texts, pairs, up, down)
    drop_cut(pairs)
    groups = components(tied)
    drop_cut(tied)
    named = large.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    counts = named.groupBy("key", "c").agg(F.count("*").alias("m"))
    tops = counts.groupBy("key").agg(F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("n"))
    beside = named.join(tops.where("n > 1").select("key", F.col("top.c").alias("top")), "key").where("c <> top")
    beside = cut(beside.select("top", "node", "c").distinct())
    drop_cut(large)
    more = finish(texts, marks, beside, groups, up, down)
    drop_cut(texts, marks, beside)
    out = joined(groups, more)
    drop_cut(more, groups)
    return out


def finish(texts: DataFrame, marks: DataFrame, beside: DataFrame, groups: DataFrame, up: int, down: int) -> DataFrame:
    """Links (src, dst) between the components of lines (top, node, c) that share a band whose most frequent component is top.

    The marks pass over most pairs without a look at their shingles, and none that is similar. The nearest line that they leave to each line is verified
    first, which ties most of a large group of copies, and then all that they leave between components that are still apart.
    """
    heads = beside.select("top").distinct()
    # of each component all lines; one without links is its own
    own = groups.join(heads, groups.component == heads.top, "left_semi").select(F.col("component").alias("top"), "node", F.col("component").alias("c"))
    single = heads.join(groups, groups.node == heads.top, "left_anti").select("top", F.col("top").alias("node"), F.col("top").alias("c"))
    lines_ = cut(own.union(single).withColumn("is_top", F.lit(True)).union(beside.withColumn("is_top", F.lit(False))))
    held = lines_.join(marks, "node").withColumn("h", F.xxhash64("node"))
    sizes = lines_.groupBy("top").agg(F.count("*").alias("size"), F.count_if(~F.col("is_top")).alias("few"))
    sizes = sizes.select("top", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("few") / BLOCK).cast("int").alias("parts"))
    held = cut(held.join(sizes, "top"))
    drop_cut(lines_)
    nearest = blocks_of_pairs(held, held, lambda found: F.filter(F.array(F.array_min(found)), lambda p: p.isNotNull()), up, down)
    first = cut(nearest.groupBy("a").agg(F.min(F.struct("apart", "b", "src", "dst")).alias("p")).select("a", "p.b", "p.src", "p.dst"))
    tied = verify(texts, first, up, down)
    roots = components(tied)
    # a line without a pair has none in the second turn either
    named = held.join(roots.select(F.col("node").alias("c"), F.col("component").alias("root")), "c", "left").withColumn("c", F.coalesce("root", "c")).drop("root")
    own = named.join(first.select(F.col("a").alias("node")), "node", "left_semi")
    rest = blocks_of_pairs(named, own, lambda found: found, up, down).select("a", "b", "src", "dst").distinct()
    other = verify(texts, rest.join(first.select("a", "b"), ["a", "b"], "left_anti"), up, down)
    out = cut(tied.union(other).distinct())
    drop_cut(held, first, tied, other, roots)
    return out


def blocks_of_pairs(held: DataFrame, own: DataFrame, pick, up: int, down: int) -> DataFrame:
    """Pairs (apart, a, b, src, dst) that pick() takes of those that each line of own has with a block of held."""
    columns = ["node", "c", "is_top", "n", *[f"p{k}" for k in range(WORDS)]]
    left, right = own.withColumn("line", F.struct(*columns)), held.withColumn("line", F.struct(*columns))
    left = left.where("not is_top").groupBy("top", "blocks", F.pmod("h", "parts").alias("i")).agg(F.collect_list("line").alias("own"))
    left = left.select("top", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    right = right.groupBy("top", F.pmod("h", "blocks").cast("int").alias("j")).agg(F.collect_list("line").alias("others"))

    def fits(x, y):
        return (x["c"] != y["c"]) & (y["is_top"] | (x["node"] > y["node"])) & may_be_alike(x.getField, y.getField, up, down)

    def near(x):
        apart = lambda y: differ(x.getField, y.getField) / (x["n"] + y["n"])
        pair = lambda y: F.struct(apart(y).alias("apart"), x["node"].alias("a"), y["node"].alias("b"), x["c"].alias("src"), y["c"].alias("dst"))
        return pick(F.transform(F.filter("others", lambda y: fits(x, y)), pair))

    # outer: from an inner explode Spark infers a filter that would compare all blocks twice
    return left.join(right, ["top", "j"]).select(F.explode_outer(F.flatten(F.transform("own", near))).alias("p")).where("p is not null").select("p.*")


def dedup(docs: DataFrame, up: int = 4, down: int = 5) -> DataFrame:
    """A row for each document: doc_id, text_hash, n_lines, n_removed, removed (line numbers from 0)."""
    place = F.struct("doc_id", "text_hash", "line_no")
    all_lines = cut(lines(docs), "zstd")
    places = cut(all_lines.select("doc_id", "text_hash", "line_no", "node"))
    linked = link(all_lines, up, down)
    firsts = places.groupBy("node").agg(F.min(place).alias("place"), F.count("*").alias("times"))
    firsts = cut(firsts.join(linked, "node", "left").where("times > 1 or component is not null").select("node", "place", F.coalesce("component", "node").alias("component")))
    drop_cut(linked)
    best = firsts.groupBy("component").agg(F.min("place").alias("best"))
    kept = firsts.join(best, "component").select("node", "best")
    gone = places.join(kept, "node").where(~place.eqNullSafe(F.col("best")))
    gone = gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    all_ = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n"))
    all_ = all_.groupBy("doc_id", "text_hash").agg(F.max("n").cast("long").alias("n_lines")).alias("d")
    g = gone.alias("g")
    out = all_.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_hash") == F.col("g.text_hash")), "left")
    removed = F.coalesce(F.col("g.removed"), F.array().cast("array<int>"))
    return out.select("d.doc_id", "d.text_hash", "d.n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with the lines that dedup() removes cut out of their texts; other columns stay as they are."""
    (h,) = fresh(docs)
    d, f = docs.withColumn(h, F.xxhash64("text")).alias("d"), found.alias("f")
    rows = d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col(f"d.{h}") == F.col("f.text_hash")), "left")
    left = F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains(F.col("f.removed"), i))
    text = F.when(F.col("f.n_removed") > 0, F.array_join(left, "\n")).otherwise(F.col("d.text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`").alias(c) for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))

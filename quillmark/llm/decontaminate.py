"""Benchmark decontamination by size-partitioned MinHash containment. DataFrame operations only.

Test items are short and documents long, so Jaccard similarity says little; the question is which share
of an item's word 5-grams a document holds. Items are partitioned by their number of distinct
shingles (powers of two). An item's sketch is its bottom-K MinHash, K set by its partition: with a
containment of `threshold` at most (1 - threshold) of the shingles are missing, so one more than that many
sketch shingles always include one that the document has. The search is thus without loss;
candidates are then verified by exact containment over all the shingles.

Words are runs of letters and digits, lower-cased; whole texts are read. Items of fewer than `width`
words are found as their whole sequence of words, at the widths that occur, if `short` is set, as it is in the
query and the stage. Without it they are never reported. Null and empty texts, and items without words, hold
nothing and are in nothing. Equal texts are decided once, by a 128-bit hash, so null or repeated ids do no harm. Empty
tables give an empty result; other columns may have any names. Item tables are broadcast only up to BROADCAST_ROWS rows, counted
first; larger ones are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, table

BROADCAST_ROWS = 200_000
KEYS = ["k1", "k2"]


def bounded(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def keyed(df: DataFrame, *columns) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return df.select(*columns, F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def grams(df: DataFrame, width: int) -> DataFrame:
    """A row `gram`, the hash of a word n-gram, for each position of the column text.

    Words are hashed once and n-grams combine their hashes inside generated code. The explode is outer:
    from an inner one Spark infers a filter that would tokenise the text again.
    """
    rest = [c for c in df.columns if c != "text"]
    words = df.select(*rest, F.split(F.lower("text"), r"[^\p{L}\p{N}]+").alias("w"))
    hashes = words.select(*rest, F.transform("w", lambda t: F.xxhash64(t)).alias("w"))
    at = F.when(F.size("w") >= width, F.sequence(F.lit(0), F.size("w") - width))
    rows = hashes.select(*rest, "w", F.explode_outer(at).alias("i")).where("i is not null")
    return rows.select(*rest, F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(width)]).alias("gram"))


def brief(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """Texts (k1, k2) that hold all words of an item (i1, i2) of fewer than `width` words, in a row."""
    words = items.select("i1", "i2", F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w"))
    words = cut(words.where((F.size("w") > 0) & (F.size("w") < width)).select("i1", "i2", F.size("w").alias("n"), F.array_join("w", " ").alias("text")))
    out = None
    for n in sorted(r["n"] for r in words.select("n").distinct().collect()):  # width - 1 numbers at most
        item = bounded(grams(words.where(F.col("n") == n).select("i1", "i2", "text"), n))
        held = grams(docs, n).join(item, "gram").select("k1", "k2", "i1", "i2", F.lit(1).alias("item_grams"), F.lit(1).alias("shared")).distinct()
        out = held if out is None else out.unionByName(held)
    return out


def find(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, short: bool = False) -> tuple:
    """(verified, named): the texts (k1, k2) that hold an item (i1, i2), and the ids of the items.

    verified has item_grams and shared, the item's distinct shingles and those in the text; short looks for items
    of fewer than `width` words too.
    """
    named = keyed(items, "item_id").withColumnsRenamed({"k1": "i1", "k2": "i2"})
    texts = keyed(items.where("text is not null"), "text").withColumnsRenamed({"k1": "i1", "k2": "i2"}).dropDuplicates(["i1", "i2"])
    # outer marks would make an empty word at either end; items are trimmed so as not to hold it
    trimmed = texts.withColumn("text", F.regexp_replace("text", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    whole = grams(trimmed, width).distinct()
    sets = whole.groupBy("i1", "i2").agg(F.array_sort(F.collect_list("gram")).alias("grams"), F.count("*").cast("int").alias("item_grams"))
    sets = cut(sets)
    upper = F.pow(F.lit(2.0), F.floor(F.log2("item_grams")) + 1) - 1  # of the size partition
    depth = (F.floor((1 - threshold) * upper + 1e-9) + 1).cast("int")
    sketch = sets.select("i1", "i2", F.explode(F.slice("grams", 1, depth)).alias("gram"))
    whole = sets.select("i1", "i2", "item_grams", F.explode("grams").alias("gram"))
    texts = keyed(docs.where("text is not null"), "text")
    probe = grams(texts, width)
    candidates = cut(probe.join(bounded(sketch), "gram").select("k1", "k2", "i1", "i2").distinct())
    chosen = texts.join(bounded(candidates.select("k1", "k2").distinct()), KEYS, "left_semi")
    held = grams(chosen, width)
    met = held.join(bounded(whole), "gram").select("k1", "k2", "i1", "i2", "item_grams", "gram").distinct()
    counts = met.groupBy("k1", "k2", "i1", "i2", "item_grams").agg(F.count("*").cast("int").alias("shared"))
    verified = counts.join(candidates, ["k1", "k2", "i1", "i2"], "left_semi").where(F.col("shared") >= threshold * F.col("item_grams") - 1e-9)
    few = brief(texts, trimmed, width) if short else None
    return cut(verified if few is None else verified.unionByName(few)), named


def op5(spark, sf_dir: str) -> DataFrame:
    """Rows (doc_id, item_id, item_grams, shared, containment): the documents that hold a test item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    verified, named = find(docs.select("doc_id", "text"), items.select("item_id", "text"), short=True)
    pairs = verified.join(named, ["i1", "i2"])
    rows = keyed(docs, "doc_id").join(bounded(pairs), KEYS)
    return rows.select("doc_id", "item_id", "item_grams", "shared", (F.col("shared") / F.col("item_grams")).alias("containment"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    verified, _ = find(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), short=True)
    text, (k1, k2) = F.coalesce("text", F.lit("")), fresh(docs, n=2)
    marked = docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit(1), text)})
    bad = bounded(verified.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct())
    return marked.join(bad, [k1, k2], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

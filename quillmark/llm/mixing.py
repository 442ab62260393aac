"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame operations only.

A document's size is its number of runs of characters other than ASCII white space (null: 0).
Sources, by code point with null last, have the weights 5, 2, 1 in turn and share the sizes of all
documents; a target stops at `max_epochs` times its source's size, and what is over goes to the others
by weight until none is above (water filling, in closed form over the table of sources).

A source's target is met by whole epochs first; what remains is a weighted sample without
replacement: a document's key is ln(-ln(u)) - ln(quality), the logarithm of the exponential key -ln(u) / quality,
u a hash of its id and text, so that keys of tiny qualities stay apart. Documents are taken by
ascending key until their summed sizes reach the budget. The document at the edge gives only its
first words, so a source gives its target rounded down to a whole number of words. `quality` names a column of
positive weights (null and others: 1); without one, texts whose words have an unlikely mean length weigh less.

Prefix sums: keys fall into bins between their least and greatest of a source, so that a source's edge bin is
found from bin totals alone. Only its documents are dealt into finer bins, again and again until the edge
bin has few rows, and those are ranked one by one. No task holds a source.

Equal rows (id, text and source) are one row with a count until the end, so however many they are no task
gathers them; each of them is taken as often as the sample says in turn. Null ids and texts are allowed. Sources of
size 0 have target 0. An empty table gives an empty result. Columns of the input never clash: results are
built from new tables, and the stage's own names are ones that the input lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, fresh, table

WORD = r"[^\x20\x09-\x0D]+"


def digest():
    return F.md5(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))


def sized(docs: DataFrame, quality: str | None = None) -> DataFrame:
    """doc_id, source, size, sampling key, tie (a digest of id and text) and copies of each different document."""
    weight = F.lit(None).cast("double") if quality is None else F.col(f"`{quality}`").cast("double")
    # pieces between runs of white space, less the empty ones at either end
    docs = docs.select("doc_id", "source", "text", weight.alias("weight"), F.split("text", r"[\x20\x09-\x0D]+").alias("w"))
    ends = F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0) + F.when((F.size("w") > 1) & (F.get("w", F.size("w") - 1) == ""), 1).otherwise(0)
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size("w") - ends).cast("long")
    docs = docs.select("doc_id", "source", "weight", F.octet_length("text").alias("bytes"), size.alias("size"), digest().alias("digest"))
    if quality is None:
        mean = F.col("bytes") / F.greatest("size", F.lit(1))
        worth = F.coalesce(1 / (1 + F.abs(mean - 6.5) / 6.5), F.lit(0.5))
    else:
        worth = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(1.0)
    u = (F.conv(F.substring("digest", 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)
    key = F.log(-F.log(u)) - F.log(worth)
    rows = docs.select("doc_id", "source", "size", key.alias("key"), F.substring("digest", 13, 20).alias("tie"))
    return rows.groupBy("source", "doc_id", "tie").agg(F.min("size").alias("size"), F.min("key").alias("key"), F.count("*").alias("copies"))


def targets(sizes: DataFrame, weights: tuple = (5.0, 2.0, 1.0), max_epochs: int = 3) -> DataFrame:
    """source, source_size and target of each source, from a table with one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    # by the level at which a source is full: those before the first that isn't full are at their caps
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    level = F.col("rest") / F.col("open")
    rows = rows.withColumn("level", F.when(level * F.col("w") <= F.col("cap"), level))
    rows = rows.withColumn("level", F.max("level").over(whole))
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"))


def same(a, b):
    return a.eqNullSafe(b)


def edges(rows: DataFrame, budgets: DataFrame, bins: int) -> DataFrame:
    """budgets (source, left) with low and high, the keys of the bin in which `left` words end, and what is left there.

    The rest is left at low: rows of smaller keys are taken whole, none of larger ones. high is null where all fit.
    """
    whole = F.col("size") * F.col("copies")
    r, b = rows.alias("r"), budgets.alias("b")
    r = r.join(b, same(F.col("r.source"), F.col("b.source"))).select("r.source", "key", whole.alias("words"), "copies", "left")
    ends = r.groupBy("source").agg(F.min("key").alias("least"), F.max("key").alias("most")).alias("e")
    r = r.alias("r").join(ends, same(F.col("r.source"), F.col("e.source"))).select("r.*", "least", "most")
    step = F.when(F.col("most") > F.col("least"), (F.col("key") - F.col("least")) / (F.col("most") - F.col("least")) * bins).otherwise(0.0)
    r = r.withColumn("bin", F.least(F.lit(bins - 1), F.floor(step)).cast("int"))
    sums = r.groupBy("source", "bin").agg(F.sum("words").alias("words"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"), F.min("left").alias("left"))
    up = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(up), F.lit(0)))
    return cut(sums.where("before < left and before + words >= left").select("source", "low", "high", "rows", (F.col("left") - F.col("before")).alias("left")))


def mix(docs: DataFrame, weights: tuple = (5.0, 2.0, 1.0), max_epochs: int = 3, bins: int = 512, quality: str | None = None, few: int = 20_000) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, key and tie of each document."""
    rows = cut(sized(docs, quality))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    plan = targets(sizes, weights, max_epochs)
    budget = F.floor(F.col("target") + 1e-6)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("left", (budget - F.col("epochs") * F.col("source_size")).cast("long")))
    edge, inside = edges(rows, plan.select("source", "left"), bins), rows
    while True:
        # a bin with many rows of different keys is dealt into finer ones
        most = edge.where("low < high").agg(F.max("rows")).first()[0] or 0
        if most <= few:
            break
        i, e = inside.alias("i"), edge.alias("e")
        inside = cut(i.join(e, same(F.col("i.source"), F.col("e.source")) & F.col("i.key").between(F.col("e.low"), F.col("e.high"))).select("i.*"))
        finer = edges(inside, edge.select("source", "left"), bins)
        drop_cut(edge)
        edge = finer
    p, e = plan.alias("p"), edge.alias("e")
    plan = p.join(e, same(F.col("p.source"), F.col("e.source")), "left").select(F.col("p.source").alias("source"), "source_size", "target", "epochs", "low", "high", F.col("e.left").alias("left"))
    plan = cut(plan)
    r, p = rows.alias("r"), plan.alias("p")
    r = r.join(p, same(F.col("r.source"), F.col("p.source")), "left").select("r.*", "source_size", "target", "epochs", "low", "high", "left")
    within = F.coalesce(F.col("key").between(F.col("low"), F.col("high")), F.lit(False))
    outside = r.where(~within).withColumn("extra", F.when(F.coalesce(F.col("key") < F.col("low"), F.lit(False)), F.col("size") * F.col("copies")).otherwise(0).cast("long"))
    rank = Window.partitionBy("source").orderBy("key", "tie", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("size") * F.col("copies")
    before = F.coalesce(F.sum(whole).over(rank), F.lit(0))
    tight = r.where(within).withColumn("extra", F.greatest(F.lit(0), F.least(whole, F.col("left") - before)).cast("long"))
    every = outside.unionByName(tight).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    # of equal rows the first are taken whole, one in part, and the others not
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("i") * F.col("size")))
    taken = (F.col("epochs") * F.col("size") + extra).cast("long")
    return every.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "key", "tie")


def op4(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each whole time a document is taken, and one with its first words for a part.

    Rows equal in (doc_id, text, source) are numbered by their other columns, and each gets the amount of its own.
    """
    tie, taken, size, times, number, copy = fresh(docs, n=6)
    shares = mix(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "taken", "tie")
    # rows of one id, text and source differ in the amount at most: as often as it occurs, largest first
    alike = shares.groupBy("doc_id", "source", "tie").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count("*").alias("times")).where("taken > 0")
    d, a = docs.withColumn(tie, F.substring(digest(), 13, 20)).alias("d"), alike.alias("a")
    on = same(F.col("d.doc_id"), F.col("a.doc_id")) & (F.col(f"d.{tie}") == F.col("a.tie")) & same(F.col("d.source"), F.col("a.source"))
    rows = d.join(a, on).select("d.*", F.col("a.taken").alias(taken), F.col("a.size").alias(size), F.col("a.times").alias(times))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = rows.where(F.col(times) == 1).select(*columns, size, F.col(taken))
    # equal rows, whatever their other columns: counted by those, so no task ranks all copies of one text
    many = rows.where(F.col(times) > 1).groupBy(tie, taken, size, times, "doc_id", "source", F.to_json(F.struct(*columns)).alias(copy))
    many = many.agg(F.first(F.struct(*columns)).alias("row"), F.count("*").alias(number))
    order = Window.partitionBy("doc_id", tie, "source").orderBy(copy).rowsBetween(Window.unboundedPreceding, -1)
    many = many.withColumn("before", F.coalesce(F.sum(number).over(order), F.lit(0)))
    many = many.withColumn("i", F.explode(F.sequence(F.col("before"), F.col("before") + F.col(number) - 1)))
    # all copies have the whole epochs, the first of them one more, and one a part of it
    base = F.floor(F.col(taken) / (F.col(size) * F.col(times))) * F.col(size)
    left = F.col(taken) - base * F.col(times)
    mine = (base + F.greatest(F.lit(0), F.least(F.col(size), left - F.col("i") * F.col(size)))).cast("long")
    many = many.select("row.*", size, mine.alias(taken)).where(F.col(taken) > 0)
    out = one.unionByName(many).withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    part = (F.col(taken) - (F.col(copy) - 1) * F.col(size)).cast("int")
    words = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    head = F.array_join(F.slice(words, 1, part), " ")
    cutting = part < F.col(size)
    out = out.withColumn("text", F.when(cutting, head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cutting, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)

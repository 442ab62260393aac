"""Shards by Hilbert-curve order of document metadata. DataFrame operations only.

Language, source and size are quantised to 2 ** BITS steps each: names by their rank in code-point
order scaled to the steps, null last; sizes by their binary logarithm. Documents are sorted by the
Hilbert index of their cell and cut into runs of near equal bytes, so a shard covers a compact box of
the metadata and readers can prune shards on any of them.

Prefix sums are taken in two steps: over the table of cells (2 ** (3 * BITS) rows at most), each
split into parts by hash so that no part grows with the data's hot cells, then inside each part.
A document goes to the shard in which its middle byte lies.

Size: UTF-8 bytes of the text (null: none) plus 1. Within a cell, order is by hash, doc_id (nulls
first), checksum and size; equal rows are interchangeable, so reruns agree. Slots number a shard's
rows from 0 without gaps. Empty tables give empty results; other columns are not read, and the stage keeps them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table

BITS = 4
#: Bits of a slot where shard and slot are one number.
SLOT_BITS = 48


def hilbert(axes: list, bits: int):
    """Hilbert index of a point: Skilling's transform, folded over bit levels so the expression stays small."""
    n = len(axes)
    state = F.struct(*[a.cast("int").alias(f"x{i}") for i, a in enumerate(axes)])

    def level(s, q):
        x = [s[f"x{i}"] for i in range(n)]
        p = q - 1
        for i in range(n):
            on = x[i].bitwiseAND(q) != 0
            t = x[0].bitwiseXOR(x[i]).bitwiseAND(p)
            first = F.when(on, x[0].bitwiseXOR(p)).otherwise(x[0].bitwiseXOR(t))
            other = F.when(on, x[i]).otherwise(x[i].bitwiseXOR(t))
            if i == 0:
                first = F.when(on, x[0].bitwiseXOR(p)).otherwise(x[0])
            else:
                x[i] = other
            x[0] = first
        return F.struct(*[v.cast("int").alias(f"x{i}") for i, v in enumerate(x)])

    levels = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    state = F.aggregate(levels, state, level)

    def gray(s):
        x = [s[f"x{i}"] for i in range(n)]
        for i in range(1, n):
            x[i] = x[i].bitwiseXOR(x[i - 1])
        flips = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
        t = F.aggregate(flips, F.lit(0), lambda a, q: F.when(x[n - 1].bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
        return F.struct(*[v.bitwiseXOR(t).cast("int").alias(f"x{i}") for i, v in enumerate(x)])

    out = F.transform(F.array(state), gray)[0]
    index = F.lit(0)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index * 2 + F.shiftright(out[f"x{i}"], b).bitwiseAND(F.lit(1))
    return index


def steps(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """Step of each value of a name column: rank in code-point order scaled to 2 ** bits, null last."""
    names = rows.groupBy(column).count()
    order = Window.orderBy(F.col(column).asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(order) - 1
    step = F.floor(rank * (1 << bits) / F.greatest(F.count("*").over(whole), F.lit(1 << bits)))
    return names.select(F.col(column).alias("name"), step.cast("int").alias(f"step_{column}"))


def shard(docs: DataFrame, shards: int = 16, part_rows: int = 2000) -> DataFrame:
    """size, text_crc32, cell, shard and slot of each document, beside doc_id, lang and source."""
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary"))
    rows = docs.select("doc_id", "lang", "source", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = cut(rows)
    joined = rows
    for column in ("lang", "source"):
        s = steps(rows, column, BITS).alias("s")
        joined = joined.alias("r").join(s, F.col(f"r.{column}").eqNullSafe(F.col("s.name")), "left").select("r.*", f"step_{column}")
    log = F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.col("size").cast("double")) * 0.75)).cast("int")
    joined = joined.withColumn("cell", hilbert([F.col("step_lang"), F.col("step_source"), log], BITS))
    tie = F.xxhash64("doc_id", "text_crc32", "size")
    joined = cut(joined.select("doc_id", "lang", "source", "size", "text_crc32", "cell", tie.alias("tie")))
    cells = joined.groupBy("cell").agg(F.count("*").alias("cell_rows"))
    # parts of about part_rows rows, fewer than 4096 of them beyond one a cell
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = F.greatest(F.lit(part_rows), F.ceil(F.sum("cell_rows").over(whole) / 4096))
    cells = cells.select("cell", F.ceil(F.col("cell_rows") / most).cast("long").alias("parts"))
    ranked = joined.join(cells, "cell").withColumn("part", F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("parts")).cast("long"))
    ranked = cut(ranked.drop("parts"))
    parts = ranked.groupBy("cell", "part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    up = Window.orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "cell", "part",
        F.coalesce(F.sum("part_size").over(up), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_rows").over(up), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(whole).alias("all_size"),
    )
    own = Window.partitionBy("cell", "part").orderBy("tie", "doc_id", "text_crc32", "size")
    at = F.col("size_before") + F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.join(parts, ["cell", "part"])
    ranked = ranked.withColumn("start", at).withColumn("rank", F.col("rows_before") + F.row_number().over(own) - 1)
    middle = (F.col("start") + F.col("size") / 2) / F.col("all_size")
    ranked = cut(ranked.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards)).cast("int")))
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return ranked.join(F.broadcast(first), "shard").withColumn("slot", (F.col("rank") - F.col("first_rank")).cast("long"))  # one row a shard


def contract(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op8(spark, sf_dir: str) -> DataFrame:
    return contract(shard(table(spark, sf_dir, "documents")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with all its columns, and those of contract() that it doesn't have, in their shard and slot.

    Rows equal in id, language, source and text are interchangeable, so their slots are dealt to them in any order
    of their other columns, the same each time.
    """
    size, crc, n, code = fresh(docs, n=4)
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary"))
    keys, named = ["doc_id", "lang", "source", "size", "text_crc32"], ["doc_id", "lang", "source", size, crc]
    rows = docs.withColumns({size: (F.octet_length(data) + 1).cast("long"), crc: F.crc32(data)}).alias("r")
    place = F.shiftleft(F.col("shard").cast("long"), SLOT_BITS) + F.col("slot")
    dealt = cut(shard(docs.select("doc_id", "lang", "source", "text")).select(*keys, "cell", place.alias("code")))
    times = dealt.groupBy(*keys).agg(F.min("cell").alias("cell"), F.min("code").alias("code"), F.count("*").alias("times")).alias("t")

    def on(left: str, right: str):
        return reduce(and_, [F.col(f"{left}.{b}").eqNullSafe(F.col(f"{right}.{a}")) for a, b in zip(keys, named, strict=True)])

    found = rows.join(times, on("r", "t")).select("r.*", F.col("t.cell").alias(n), F.col("t.code").alias(code), "t.times")
    one = found.where("times = 1").drop("times")
    # repeated rows are numbered, and so are their places
    order = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields])
    many = found.where("times > 1").drop("times", code).withColumn(code, F.row_number().over(Window.partitionBy(*named).orderBy(order))).alias("m")
    places = dealt.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("code"))).alias("p")
    many = many.join(places, on("m", "p") & (F.col(f"m.{code}") == F.col("p.n"))).select(*[F.col(f"m.`{c}`") for c in [*docs.columns, size, crc, n]], F.col("p.code").alias(code))
    every = one.select(*[F.col(f"`{c}`") for c in [*docs.columns, size, crc, n, code]]).unionByName(many)
    shard_ = F.shiftright(F.col(code), SLOT_BITS).cast("int")
    results = {
        "size": F.col(size), "text_crc32": F.col(crc), "law": F.lit("bytes"), "shard": shard_,
        "slot": F.col(code) - F.shiftleft(shard_.cast("long"), SLOT_BITS), "grown_shard": F.lit(None).cast("int"), "cell": F.col(n),
    }
    held = {c.lower() for c in docs.columns}
    return every.select(*[F.col(f"`{c}`") for c in docs.columns], *[v.alias(k) for k, v in results.items() if k not in held])

"""N-gram Jaccard join: MinHash banding, then exact Jaccard on full word n-gram sets.

1. Each text becomes its set of word 5-gram hashes. Equal sets form one class, by a 128-bit hash,
   so copies are carried once with their number.
2. MinHash bands of a class: `rows` minima a band, as many bands as `recall` at the threshold needs.
   Bands are shuffled by hash; classes that meet in a band are tied to the least class there.
3. Union-find over these ties gives candidate groups. A group is split by hash into blocks of
   about `block` classes, and each pair of blocks is one task's work: all its pairs are verified
   by the sizes of the intersections of the full sets, so no link of a group is missed and no
   task holds a large group. Only counts and a spanning forest leave a task, never all pairs.
4. Union-find over the forests gives the components.

Result: a row per document with doc_id, class_id (least doc_id with its n-gram set), n_links (other
documents of similarity >= threshold), component_id (least doc_id reachable), kept (one row of a component).

Words are runs of letters and digits, lower-cased. A text of fewer words than the width has one
shingle of them all; texts without words (null, empty, marks only) link with nothing, each its own
component, and all kept. Null ids: rows join as others do, ids of classes ignore nulls; repeated ids: each row
is a document, and of rows equal in id and text one is kept at most. Graph nodes are 64-bit hashes of the sets.
Other columns may have any names. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, add_columns, as_long, components, cut, fresh, mix, shingles, ship, table

ship(__name__)


def plan(threshold: float, recall: float, rows: int) -> int:
    """Number of bands of `rows` minima that meet with probability `recall` at the threshold."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def set_hashes(sets: list) -> tuple:
    """Two hashes of each set."""
    a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            a[i] = mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
            b[i] = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    n = np.array([len(s) for s in sets], np.uint64)
    return as_long(mix(a + n)), as_long(mix(b ^ n))


def bands(sets: list, count: int, rows: int) -> list:
    """Band hashes of each set; none for an empty set."""
    size = np.array([len(s) for s in sets])
    full = np.flatnonzero(size)
    out = [np.zeros(0, np.int64)] * len(sets)
    rng = np.random.default_rng(20)
    scale = rng.integers(0, MASK64, count * rows, np.uint64, endpoint=True) | np.uint64(1)
    shift = rng.integers(0, MASK64, count * rows, np.uint64, endpoint=True)
    for part in np.array_split(full, max(1, int(size.sum() // 30000))) if len(full) else ():
        if not len(part):
            continue
        all_ = np.concatenate([sets[i] for i in part])
        at = np.concatenate(([0], np.cumsum(size[part])[:-1]))
        key = np.zeros((len(part), count), np.uint64)
        low = np.empty_like(all_)
        for b in range(count):
            h = np.full(len(part), np.uint64(b + 1))
            for r in range(rows):
                np.multiply(all_, scale[b * rows + r], out=low)
                np.add(low, shift[b * rows + r], out=low)
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(low, at))
            key[:, b] = h
        for j, i in enumerate(part):
            out[i] = as_long(key[j])
    return out


def links(sets: list, near: int, threshold: tuple):
    """Boolean matrix: which of sets[:near] and sets[near:] (of all, if near is len(sets)) are similar.

    threshold is a fraction (numerator, denominator), so that the comparison is exact.
    """
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    use = often[column]
    column, owner = (np.cumsum(often) - 1)[column[use]], owner[use]
    rows, cols = (near, len(sets) - near) if near < len(sets) else (near, near)
    both = np.zeros((rows, cols), np.float32)
    width = 8192
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [c, c + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - c] = 1
        both += m[:near] @ (m[near:] if near < len(sets) else m).T
    both = np.rint(both).astype(np.int64)
    left = size[:near, None]
    right = (size[near:] if near < len(sets) else size)[None, :]
    up, down = threshold
    return both * down >= (left + right - both) * up


def forest(similar: np.ndarray, nodes_a: np.ndarray, nodes_b: np.ndarray) -> tuple:
    """The least node of each row's and column's component in a bipartite link matrix."""
    a, b = nodes_a.copy(), nodes_b.copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(a, np.where(similar, b[None, :], top).min(1, initial=top))
        nb = np.minimum(b, np.where(similar, na[:, None], top).min(0, initial=top))
        if (na == a).all() and (nb == b).all():
            return a, b
        a, b = na, nb


def verify(pdf: pd.DataFrame, threshold: tuple) -> pd.DataFrame:
    """Links between the classes of two blocks (or within one): counts and forest."""
    pdf = pdf.drop_duplicates(["h1", "h2", "side"]).sort_values("side")
    sets = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
    node, weight, side = pdf["h1"].to_numpy(), pdf["copies"].to_numpy(), pdf["side"].to_numpy()
    near = int((side == 0).sum())
    if near == 0 or (pdf["bi"].iat[0] != pdf["bj"].iat[0] and near == len(pdf)):
        return pd.DataFrame({"h1": [], "h2": [], "links": [], "root": []})
    similar = links(sets, near, threshold)
    if near == len(pdf):
        np.fill_diagonal(similar, False)
        count = similar @ weight
        a, _ = forest(similar, node, node)
        root = a
    else:
        count = np.concatenate([similar @ weight[near:], weight[:near] @ similar])
        a, b = forest(similar, node[:near], node[near:])
        root = np.concatenate([a, b])
    hit = count > 0
    return pd.DataFrame({"h1": node[hit], "h2": pdf["h2"].to_numpy()[hit], "links": count[hit], "root": root[hit]})


def join(docs: DataFrame, threshold: tuple = (4, 5), width: int = 5, rows: int = 6, recall: float = 0.9999, block: int = 256) -> tuple:
    """(rows, classes): each row's doc_id, text_hash and class (h1, h2), and what was found for each class."""
    count = plan(threshold[0] / threshold[1], recall, rows)

    def sketch(texts):
        sets = shingles(texts, width)
        return *set_hashes(sets), np.array([len(s) for s in sets], np.int32), bands(sets, count, rows)

    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows_ = cut(add_columns(source, ["doc_id", "text_hash"], sketch, "h1 long, h2 long, grams int, bands array<long>"))
    full = rows_.where("grams > 0")
    classes = cut(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")))
    exploded = full.select("h1", F.posexplode("bands").alias("band", "key"))
    meet = exploded.groupBy("band", "key").agg(F.min("h1").alias("root"), F.max("h1").alias("most")).where("root <> most").drop("most")
    ties = exploded.join(meet, ["band", "key"]).where("h1 <> root").select(F.col("h1").alias("src"), F.col("root").alias("dst")).distinct()
    groups = components(ties)
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    found = classes.join(groups, classes.h1 == groups.node).join(sizes, "component")
    found = cut(found.select("h1", "h2", "class_id", "copies", "component", "blocks", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int").alias("b")))

    def again(texts):
        sets = shingles(texts, width)
        return *set_hashes(sets), [x.tobytes() for x in sets]

    # one document a class is read again; the sets travel only for candidates
    ids = found.select(F.col("class_id").alias("doc_id")).distinct().alias("i")
    s = source.alias("s")
    texts = s.join(ids, F.col("s.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi").select("text")
    sets = add_columns(texts, [], again, "h1 long, h2 long, grams binary").dropDuplicates(["h1", "h2"])
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    found = found.withColumn("o", F.explode(other))
    found = found.select("h1", "h2", "copies", "component", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"))
    work = found.join(sets, ["h1", "h2"])
    checked = work.groupBy("component", "bi", "bj").applyInPandas(lambda p: verify(p, threshold), "h1 long, h2 long, links long, root long")
    checked = cut(checked)
    linked = checked.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    joined = components(checked.select(F.col("h1").alias("src"), F.col("root").alias("dst")))
    j = joined.withColumnsRenamed({"node": "h1", "component": "root"})
    out = classes.join(linked, ["h1", "h2"], "left").join(j, "h1", "left")
    out = cut(out.select("h1", "h2", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "h1").alias("root")))
    least = out.groupBy("root").agg(F.min("class_id").alias("component_id"))
    return rows_.select("doc_id", "text_hash", "h1", "h2", "grams"), out.join(least, "root")


def decided(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """A row for each different (doc_id, text_hash): times it occurs, its class's results, and whether one of them is kept.

    Of a component that is a row with the least id (null if it has no other), and of these the one of
    least text hash. Rows without words are all kept.
    """
    once = rows.groupBy("doc_id", "text_hash", "h1", "h2", "grams").agg(F.count("*").alias("times"))
    out = once.join(classes, ["h1", "h2"], "left")
    held = out.where("grams > 0").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    best = held.groupBy("root").agg(F.min("text_hash").alias("best"))
    out = out.join(best, "root", "left")
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("best"))
    return out.withColumn("kept", F.when(F.col("grams") == 0, True).otherwise(F.coalesce(first, F.lit(False))))


def op1(spark, sf_dir: str) -> DataFrame:
    out = decided(*join(table(spark, sf_dir, "documents")))
    alone = F.col("grams") == 0
    # rows equal in id and text: the first of them is kept at most
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("kept") & (alone | (F.col("i") == 1))).alias("kept"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, as decided(); texts without words all stay. Columns may have any names."""
    kept = decided(*join(docs.select("doc_id", "text"))).where("kept")
    h, many = fresh(docs, n=2)
    kept = kept.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("text_hash"), ((F.col("times") > 1) & (F.col("grams") > 0)).alias("many")).alias("k")
    d = docs.withColumn(h, F.xxhash64("text")).alias("d")
    out = d.join(kept, F.col("d.doc_id").eqNullSafe(F.col("k.id")) & (F.col(f"d.{h}") == F.col("k.text_hash")))
    out = out.select("d.*", F.col("k.many").alias(many))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # rows equal in id and text: the first by their other columns stays
    one = out.where(many).groupBy("doc_id", h).agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias("row")).select("row.*")
    return out.where(~F.col(many)).select(*columns).unionByName(one)

"""Near-duplicate vectors by an inverted multi-index, verified by cosine in double precision.

Vectors are scaled to length 1, turned by a fixed random rotation and split in halves. Each half has
a codebook, trained by k-means on a bounded sample (`sample` vectors, by hash), and the pair of nearest
codewords is the vector's cell in the product grid. Every vector is stored in its cell.

A search visits cells by the multi-sequence: a heap walks the two lists of codewords, ascending by the squared
distances from the vector's halves to the cells' borders, and stops once the target recall is reached. A neighbour at the threshold lies r = sqrt(2 - 2 cos) away; after the
rotation its part across a border is normal with variance r^2 / d, d the effective rank of the sampled vectors
of that dimension, so cells whose distance is reached with a probability below 1 - `recall` are left out (never
cells within reach if d is small). Each dimension has its own rotation, codebooks and reach; the vectors of
one that the sample lacks are one cell. Visited cells' members are verified in full.

Equal vectors of a label are one class with a count. A cell's members and visitors are split by hash into
blocks, a task takes one pair of blocks, and only counts and a spanning forest leave it.
Vectors link only with vectors of an equal label that isn't null and of their own dimension. Vectors
that are null, empty or zero, or hold null or non-finite components, link with nothing and are their own
components. Rows with a null vec_id link like others, with component_id the least known one and kept
false; repeated ids are rows of their own. Other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drawn, ship, table
from .ngram_join import forest

ship(__name__)

FIELDS = "cell string, node long, copies long, vec binary"


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (-2 * x @ c.T + (c**2).sum(1)).argmin(1)
        n = np.bincount(near, minlength=len(c))
        for j in np.flatnonzero(n):
            c[j] = x[near == j].mean(0)
    return np.unique(c, axis=0)


def unit(vectors: list, width: int) -> np.ndarray:
    """Rows scaled to length 1, filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out**2).sum(1, keepdims=True))


def train(vectors: list, width: int, codewords: int, seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
    x = unit(vectors, width) @ turn
    half = max(1, width // 2)
    books = [kmeans(x[:, :half], codewords, 1), kmeans(x[:, half:], codewords, 2) if width > 1 else np.zeros((1, 0))]
    return {"turn": turn, "half": half, "books": books, "width": width}


def rank(x: np.ndarray) -> float:
    """Effective rank of the rows: squared trace of their covariance by the trace of its square."""
    c = x - x.mean(0)
    s = c.T @ c
    return max(1.0, float(np.trace(s)) ** 2 / max(float((s**2).sum()), 1e-300))


def borders(x: np.ndarray, book: np.ndarray) -> tuple:
    """Nearest codeword of each row, and its squared distance to the border of each codeword's cell."""
    d = np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1))
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(0, ((book[:, None] - book[None]) ** 2).sum(2)))[own]
    gap = np.where(apart > 0, (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * apart, 1e-300), 0)
    return own, np.maximum(0, gap) ** 2


def multi_sequence(near: list, far: list, reach: float):
    """Pairs (i, j) of two ascending lists by ascending sum, until the sum passes `reach`.

    A heap holds the frontier: a pair is pushed once the pairs before it in both lists are visited.
    """
    heap = [(near[0] + far[0], 0, 0)]
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > reach:
            return
        yield i, j
        if j + 1 < len(far):
            heapq.heappush(heap, (near[i] + far[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(near):
            heapq.heappush(heap, (near[i + 1] + far[0], i + 1, 0))


def visits(model: dict, x: np.ndarray, reach: float) -> tuple:
    """Own cell of each row, and (row, cell) pairs to visit, nearest first."""
    y = x @ model["turn"]
    a, ga = borders(y[:, : model["half"]], model["books"][0])
    b, gb = borders(y[:, model["half"] :], model["books"][1])
    k = len(model["books"][1])
    oa, ob = ga.argsort(1, kind="stable"), gb.argsort(1, kind="stable")
    ga, gb = np.take_along_axis(ga, oa, 1), np.take_along_axis(gb, ob, 1)
    row, cell = [], []
    for r in range(len(x)):
        # codewords beyond the reach by themselves are in no pair
        n, m = int(np.searchsorted(ga[r], reach, "right")), int(np.searchsorted(gb[r], reach, "right"))
        own = [int(oa[r, i]) * k + int(ob[r, j]) for i, j in multi_sequence(ga[r, :n].tolist(), gb[r, :m].tolist(), reach)]
        cell += own
        row += [r] * len(own)
    return a * k + b, np.array(row, np.int64), np.array(cell, np.int64)


def search(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.9999, sample: int = 20000, per_cell: int = 64, block: int = 2048) -> tuple:
    """(rows, classes): vec_id and class of each row, and links and component of each class."""
    v = F.col("embedding")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull()
    rows = vectors.select("vec_id", F.when(sound, v).alias("embedding"), "label")
    rows = rows.withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("label", "embedding")))
    grouped = rows.where("embedding is not null").groupBy("node", "label", "embedding")
    classes = cut(grouped.agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")))
    about = classes.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    taken = drawn(classes.select("embedding", F.xxhash64("node").alias("_draw")), sample, about["n"])
    got = [np.asarray(r["embedding"], float) for r in taken]
    r2, models = 2 - 2 * cosine, {}
    for width in {len(e) for e in got}:
        own = [e for e in got if len(e) == width]
        # codewords grow with the vectors, so that cells don't
        codewords = max(2, int(math.sqrt(about["n"] * len(own) / len(got) / max(1, about["labels"]) / per_cell)))
        reach = min(r2, 2 * r2 / rank(unit(own, width)) * math.log(1 / (1 - recall))) + 1e-9
        models[width] = train(own, width, codewords), reach

    def place(pdf, members: bool):
        vecs = [np.asarray(e, np.float64) for e in pdf["embedding"]]
        size = np.array([len(e) for e in vecs])
        rows_, cells = [], []
        for width in np.unique(size).tolist():
            at = np.flatnonzero(size == width)
            own, row, cell = np.zeros(len(at), np.int64), np.arange(len(at)), np.zeros(len(at), np.int64)
            if width in models:
                own, row, cell = visits(models[width][0], unit([vecs[i] for i in at], width), models[width][1])
            if members:
                row, cell = np.arange(len(at)), own
            rows_.append(at[row])
            cells.append(cell)
        row, cell = np.concatenate(rows_), np.concatenate(cells)
        label, node, copies = pdf["label"].to_numpy(), pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        packed = [e.tobytes() for e in vecs]
        return pd.DataFrame({"cell": [f"{label[i]}/{size[i]}/{c}" for i, c in zip(row, cell, strict=True)], "node": node[row], "copies": copies[row], "vec": [packed[i] for i in row]})

    def spread(members: bool):
        def run(batches):
            for pdf in batches:
                for i in range(0, len(pdf), 1000):
                    yield place(pdf.iloc[i : i + 1000], members)

        return classes.select("node", "label", "embedding", "copies").mapInPandas(run, FIELDS)

    stored, asked = spread(True), spread(False)
    sizes = stored.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    sizes = cut(sizes.join(asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("turns")), "cell"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = stored.join(sizes, "cell").withColumn("p", part("parts")).withColumn("t", every("turns")).drop("parts", "turns")
    asked = asked.join(sizes, "cell").withColumn("t", part("turns")).withColumn("p", every("parts")).drop("parts", "turns")

    def verify(m, q):
        if not len(m) or not len(q):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        a = np.stack([np.frombuffer(x, np.float64) for x in q["vec"]])
        b = np.stack([np.frombuffer(x, np.float64) for x in m["vec"]])
        a /= np.abs(a).max(1, keepdims=True)
        b /= np.abs(b).max(1, keepdims=True)
        na, nb = q["node"].to_numpy(), m["node"].to_numpy()
        near = (a @ b.T) / np.sqrt((a**2).sum(1))[:, None] / np.sqrt((b**2).sum(1))[None, :] >= cosine
        near &= na[:, None] != nb[None, :]
        ra, rb = forest(near, na, nb)
        hit, met = near.any(1), near.any(0)
        found = pd.DataFrame({"node": na[hit], "links": (near @ m["copies"].to_numpy())[hit], "root": ra[hit]})
        return pd.concat([found, pd.DataFrame({"node": nb[met], "links": 0, "root": rb[met]})])

    found = stored.groupBy("cell", "p", "t").cogroup(asked.groupBy("cell", "p", "t")).applyInPandas(verify, "node long, links long, root long")
    found = cut(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    out = classes.select("node", "least", "copies").join(links, "node", "left").join(joined, "node", "left")
    out = cut(out.select("node", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root")))
    least = out.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("vec_id", "node"), out.join(least, "root").select("node", "n_links", "component_id")


def op2(spark, sf_dir: str) -> DataFrame:
    rows, classes = search(table(spark, sf_dir, "embeddings"))
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("node is not null").join(classes, "node").select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

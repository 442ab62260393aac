"""Quality scores by Bradley-Terry pairwise ranking.

A document's features are character-class transition rates, word repetition, word and line shape.
A weight vector is learned by stochastic gradient descent on the logistic loss of feature
differences over preference pairs (a document of label 1 preferred to one of label 0), drawn from
at most `sample` labelled rows chosen by hash. The cut is a quantile of the sample's raw scores,
the one that leaves its share of label 1 above; scores are a logistic of the distance to the cut
at which a raw score on the cut gets exactly `threshold`.

Whole texts are read. Null and empty texts get the score of all-zero features. Without preference
pairs (no labels, or only one kind) all weights are 0 and every score is `threshold`. Repeated
rows get equal results; a raw score on the cut counts as above it. Null ids are rated and never learned from.
Input columns called score or predicted are replaced in rate(). An empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, chunked, codepoints, lookup, mix, ship, span_hashes, table

ship(__name__)

CLASSES = 8


def char_class(c: str) -> int:
    if c == "\n":
        return 1
    if c.isspace():
        return 2
    if c.isdigit():
        return 3
    if c.isupper():
        return 4
    if c.isalpha():
        return 5
    if c in ".,;:'\"?!-()":
        return 6
    return 7 if unicodedata.category(c)[0] in "SP" else 0


def features(texts: list) -> np.ndarray:
    """One row of features for each text."""
    out = []
    for a, b in chunked(texts):
        part = texts[a:b]
        n = b - a
        cp, starts, sizes = codepoints(part)
        kind = lookup(cp, char_class, np.int32)
        owner = np.repeat(np.arange(n, dtype=np.int64), sizes + 1)
        pair = owner * CLASSES**2 + kind * CLASSES + np.append(kind[1:], 1)
        grid = np.bincount(pair, minlength=n * CLASSES**2).reshape(n, -1)
        size = np.maximum(1, sizes)[:, None]
        word = kind > 2
        edge = np.diff(word.astype(np.int8), prepend=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        who = owner[begin]
        words = np.bincount(who, minlength=n)
        per = np.maximum(1, words)
        h = span_hashes(cp, begin, end)
        same = np.bincount(who[1:][(h[1:] == h[:-1]) & (who[1:] == who[:-1])], minlength=n)
        key = np.sort((who.astype(np.uint64) << np.uint64(44)) | (mix(h) >> np.uint64(20)))
        fresh = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        distinct = np.bincount((fresh >> np.uint64(44)).astype(np.int64), minlength=n)
        length = end - begin
        mean = np.bincount(who, weights=length, minlength=n) / per
        spread = np.sqrt(np.maximum(0, np.bincount(who, weights=length.astype(float) ** 2, minlength=n) / per - mean**2))
        short = np.bincount(who[length <= 3], minlength=n) / per
        long = np.bincount(who[length >= 14], minlength=n) / per
        ends = np.bincount(who[kind[end - 1] >= 6], minlength=n) / per
        symbol = np.bincount(who[kind[end - 1] == 7], minlength=n) / per
        upper = np.bincount(who[(kind[begin] == 4) & (kind[np.minimum(begin + 1, len(kind) - 1)] == 4)], minlength=n) / per
        lines = np.bincount(owner[kind == 1], minlength=n)
        out.append(np.column_stack([grid / size, np.log1p(sizes), np.log1p(words), same / per, distinct / per, distinct / np.sqrt(per), mean, spread, short, long, ends, symbol, upper, np.log(size[:, 0] / lines)]))
    return np.concatenate(out) if out else np.zeros((0, CLASSES**2 + 13))


def train(x: np.ndarray, y: np.ndarray, threshold: float = 0.3, pairs: int = 60000, seed: int = 5) -> dict:
    """Fit Bradley-Terry weights to rows x of labels y, and the cut."""
    width = x.shape[1] if len(x) else CLASSES**2 + 13
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    model = {"mean": np.zeros(width), "scale": np.ones(width), "w": np.zeros(width), "cut": 0.0, "slope": 1.0, "threshold": threshold}
    if not len(good) or not len(bad):
        return model
    model["mean"], model["scale"] = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    rng = np.random.default_rng(seed)
    w, total, step = np.zeros(width), np.zeros(width), 0
    for _ in range(6):
        for k in range(0, pairs, 64):
            d = z[rng.choice(good, 64)] - z[rng.choice(bad, 64)]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            w += 0.3 / (1 + step / 400) ** 0.5 * (d.T @ p / 64 - 1e-3 * w)
            step += 1
            total += w
    w = total / step
    raw = z @ w
    cut = float(np.quantile(raw, len(bad) / len(y)))
    best = min((float(np.mean(np.logaddexp(0, np.where(y == 1, -1, 1) * (s * (raw - cut) + math.log(threshold / (1 - threshold)))))), s) for s in np.geomspace(0.05, 5, 40))
    return model | {"w": w, "cut": cut, "slope": best[1]}


def score(model: dict, texts: list) -> np.ndarray:
    z = np.clip((features(texts) - model["mean"]) / model["scale"], -8, 8) @ model["w"]
    t = model["threshold"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (z - model["cut"]) + math.log(t / (1 - t)), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000, threshold: float = 0.3, where=None) -> dict:
    """Learn from at most `sample` labelled rows, the first by hash of doc_id."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        marked = marked.where(where)
    drawn = marked.select("doc_id", F.col(label).cast("int").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(sample)

    # `sample` rows at most; of documents with one id the least text, so repeated rows don't add to them
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    got = add_columns(rows, ["_y"], lambda texts: (list(features(texts)),), "f array<double>").collect()
    x = np.array([r["f"] for r in got]) if got else np.zeros((0, CLASSES**2 + 13))
    y = np.array([r["_y"] for r in got], int)
    order = np.lexsort(np.column_stack([x, y]).T) if len(got) else np.zeros(0, int)
    return train(x[order], y[order], threshold)


def rate(docs: DataFrame, model: dict, keep: list) -> DataFrame:
    """Columns `keep` of docs with score and predicted."""
    keep = [c for c in keep if c.lower() not in ("score", "predicted")]

    def run(texts):
        rated = score(model, texts)
        return rated, (rated >= model["threshold"]).astype(np.int32)

    return add_columns(docs, keep, run, "score double, predicted int")


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)), 1) % 5 = 0"


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), where=F.expr(f"not ({HELD_OUT})"))
    return rate(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")

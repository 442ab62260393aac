"""Language identification: averaged hashed subword embeddings under a linear softmax.

Every character 1-gram and 3-gram of the lower-cased letters, with a mark at word edges, is hashed to a
row of an embedding table; a text is the mean of its rows, and a softmax layer turns that into
language probabilities. Both are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows (`sample_per_lang`, `max_rows`, drawn by hash within each language). Whole texts are
read, in training and in prediction.

A temperature fitted on part of the sample calibrates the probabilities. A prediction is rejected
if its probability or its mean log-odds against unseen subwords falls below thresholds set so that
at most `reject_share` of the correctly predicted sample rows would be rejected.

Null texts and texts without letters get `und`, score 0, rejected. Repeated rows get equal results, and of equal
rows one is learned from. Null languages are not learned from; without any labelled row every text is `und`,
and an empty table gives an empty result. Other columns of the input pass through unless they have the name
of a result, which replaces them; in the stage the results have names of their own, so all columns stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, chunked, codepoints, fresh, lookup, ship, table

ship(__name__)

BUCKETS, WIDTH, ORDERS = 1 << 16, 16, (1, 3)
#: N-grams whose rows are summed at once in a prediction.
PART = 1 << 18


def subwords(texts: list):
    """For each order, (bucket of each n-gram in the order of the texts, number of the text it is in)."""
    cp, starts, _ = codepoints([t.lower() for t in texts])
    letter = lookup(cp, str.isalpha, np.bool_)
    # a run of other characters becomes one edge mark
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    sym = (cp * letter)[keep]
    count = np.add.reduceat(keep, starts, dtype=np.int64)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), count)
    out = []
    for n in ORDERS:
        m = len(sym) - n + 1
        if m <= 0:
            break
        h = sym[:m] * np.uint32(0x9E3779B1)
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x01000193) + sym[k : m + k]
        ok = sym > 0 if n == 1 else text_of[:m] == text_of[n - 1 :]
        h = h[ok]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x51ED270B & 0xFFFFFFFF)
        out.append(((h >> np.uint32(16)).astype(np.intp), text_of[:m][ok]))
    return out


def counts(texts: list) -> list:
    """For each text (buckets, counts) of its n-grams."""
    out = []
    for a, b in chunked(texts):
        found = subwords(texts[a:b])
        key, n = np.unique(np.concatenate([owner.astype(np.int64) * BUCKETS + h for h, owner in found]), return_counts=True)
        at = np.searchsorted(key, np.arange(b - a + 1) * BUCKETS)
        out += [((key[at[i] : at[i + 1]] % BUCKETS).astype(np.int32), n[at[i] : at[i + 1]].astype(np.float32)) for i in range(b - a)]
    return out


def train(texts: list, langs: list, reject_share: float = 0.002, epochs: int = 8, seed: int = 7) -> dict:
    """Fit embeddings, softmax, temperature and thresholds; model["table"] is embeddings times weights."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rows = [c for c in counts(texts)]
    use = np.array([len(c[0]) > 0 for c in rows], bool)
    idx = np.flatnonzero(use)
    if not len(idx):
        return {"langs": [], "table": np.zeros((BUCKETS, 1), np.float32), "bias": np.zeros(1, np.float32), "heat": 1.0, "least": 0.0, "known": 0.0, "seen": np.zeros(BUCKETS, np.bool_)}
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    w = rng.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    idx = rng.permutation(idx)
    held = idx[: len(idx) // 5] if len(idx) >= 50 else idx
    fit = idx[len(idx) // 5 :] if len(idx) >= 50 else idx
    share = np.bincount(y[fit], minlength=len(names)).astype(np.float32)
    weight = len(fit) / np.maximum(1, share * (share > 0).sum())
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            rate = 1.0 * (1 - done / steps) + 0.01
            done += 1
            b, n = rows[i]
            p = n / n.sum()
            x = p @ emb[b]
            z = x @ w + bias
            z = np.exp(z - z.max())
            z /= z.sum()
            z[y[i]] -= 1
            z *= min(weight[y[i]], 10)
            back = w @ z
            w -= rate * np.outer(x, z)
            bias -= 0.1 * rate * z
            emb[b] -= (rate * np.minimum(1, p * 50))[:, None] * back[None, :]
    scores = emb @ w
    seen = np.zeros(BUCKETS, np.bool_)
    for i in fit:
        seen[rows[i][0]] = True
    z = np.array([(n / n.sum()) @ scores[b] + bias for b, n in (rows[i] for i in held)])
    known = np.array([n[seen[b]].sum() / n.sum() for b, n in (rows[i] for i in held)])
    best = (np.inf, 1.0)
    for heat in np.geomspace(0.05, 20, 60):
        q = z / heat
        q = q - q.max(1, keepdims=True)
        q = q - np.log(np.exp(q).sum(1, keepdims=True))
        best = min(best, (float(-q[np.arange(len(held)), y[held]].mean()), float(heat)))
    q = z / best[1]
    q = np.exp(q - q.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    right = q.argmax(1) == y[held]
    least = float(np.quantile(q.max(1)[right], reject_share)) if right.any() else 0.0
    floor = float(np.quantile(known[right], reject_share)) if right.any() else 0.0
    # thresholds are floors of what was seen, with a margin: rejection is for texts unlike the sample
    return {"langs": names, "table": scores.astype(np.float32), "bias": bias, "heat": best[1], "least": min(least, 0.45), "known": 0.8 * floor, "seen": seen}


def predict(model: dict, texts: list):
    """(language, probability, rejected) of each text; None and texts without letters are `und`."""
    lang, score, rejected = [], [], []
    names = model["langs"]
    texts = ["" if t is None else t for t in texts]
    rows = np.column_stack([model["table"], model["seen"].astype(np.float32), np.zeros(BUCKETS, np.float32)])
    for a, b in chunked(texts):
        total = np.zeros((b - a, rows.shape[1]))
        for h, owner in subwords(texts[a:b]):
            # in parts, so that a very long text takes no more memory than others
            for s in range(0, len(h), PART):
                part = owner[s : s + PART]
                first = np.flatnonzero(np.diff(part, prepend=-1))
                total[part[first]] += np.add.reduceat(rows[h[s : s + PART]], first, axis=0, dtype=np.float64)
            total[:, -1] += np.bincount(owner, minlength=b - a)
        n = np.maximum(1, total[:, -1])
        known = total[:, -2] / n
        z = (total[:, :-2] / n[:, None] + model["bias"]) / model["heat"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        for i in range(b - a):
            if not names or not any(map(str.isalpha, texts[a + i])):
                lang.append("und"), score.append(0.0), rejected.append(True)
            else:
                k = int(z[i].argmax())
                lang.append(names[k]), score.append(float(z[i, k]))
                rejected.append(bool(z[i, k] < model["least"] or known[i] < model["known"]))
    return lang, score, rejected


def fit(docs: DataFrame, sample_per_lang: int = 700, max_rows: int = 200_000, where=None) -> dict:
    """Train on at most `sample_per_lang` different texts, by hash, of each language, and on `max_rows` in all.

    Every language is learned; where there are so many that `max_rows` would be passed, each gives fewer texts.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if where is not None:
        known = known.where(where)
    draw = known.select("lang", "text", F.xxhash64(F.lit(3), F.col("doc_id").cast("string"), "text").alias("_draw"))
    sizes = draw.select("lang", "_draw").distinct().groupBy("lang").agg(F.count("*").alias("_size"), F.min("_draw").alias("_least"))
    quota = max(1, min(sample_per_lang, max_rows // max(1, sizes.count())))
    # about 1.3 times the quota by hash, so no language's rows are ever gathered in one task
    share = (F.least(F.lit(1.0), F.lit(1.3 * quota) / F.col("_size")) * 2 - 1) * F.lit(2.0**63 - 2048)
    picked = draw.join(sizes, "lang").where((F.col("_draw").cast("double") <= share) | (F.col("_draw") == F.col("_least")))
    by: dict = {}
    for r in sorted(picked.groupBy("lang", "_draw").agg(F.min("text").alias("text")).collect(), key=lambda r: r["_draw"]):
        by.setdefault(r["lang"], []).append(r["text"])
    texts, langs = [], []
    for name in sorted(by):
        texts += by[name][:quota]
        langs += [name] * len(by[name][:quota])
    return train(texts, langs)


def identify(docs: DataFrame, model: dict, keep: list | None = None, names: tuple = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Add the results, called `names`, to the columns `keep` (all of docs by default)."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in names]
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: BUCKETS rows by the number of languages
    return add_columns(docs, keep, lambda texts: predict(held.value, texts), f"{names[0]} string, {names[1]} double, {names[2]} boolean")


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)), 0) % 4 = 2"


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, where=F.expr(f"not ({HELD_OUT})"))
    out = identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those rejected go."""
    model = fit(docs.select("doc_id", "text", "lang"))
    names = fresh(docs, n=3)
    return identify(docs, model, names=tuple(names)).where(~F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Gating of candidates (E19 to E22, E24) and of vectors by cosine: boolean columns, top one by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions.segment import paragraphs

#: Least similarity of vectors and of stems, least and greatest ratio of lengths.
COSINE, OVERLAP, MIN_RATIO, MAX_RATIO = 0.90, 0.34, 0.90, 1.15


def cosine(a, b) -> Column:
    """Cosine of two arrays of numbers, in double precision; null for vectors of length 0 or different sizes."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def overlap(a, b) -> Column:
    """Jaccard similarity of the stems of two texts: 1 if neither has any, 0 if one has none."""
    return T.let(T.stems(a), lambda sa: T.let(T.stems(b), lambda sb: overlap_of(sa, sb)))


def overlap_of(sa, sb) -> Column:
    """overlap() of two arrays of stems."""
    either = F.size(F.array_union(sa, sb))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(sa, sb)) / F.greatest(either, F.lit(1)))


def gate(original, candidate, similarity=None) -> Column:
    """(passed, reasons, similarity, method, ratio); similarity is a cosine, or else the overlap of stems decides."""
    made = {"numbers": T.numbers, "terms": T.terms, "words": T.n_words} | ({"stems": T.stems} if similarity is None else {})
    of = lambda text: F.struct(*[make(text).alias(name) for name, make in made.items()])
    return T.let(of(original), lambda a: T.let(of(candidate), lambda b: T.let(_score(a, b, similarity), lambda s: _gate(a, b, s, similarity))))


def _score(a, b, similarity) -> Column:
    return overlap_of(a["stems"], b["stems"]) if similarity is None else similarity


def _gate(a, b, score, similarity) -> Column:
    differs = lambda f: F.size(F.array_except(a[f], b[f])) + F.size(F.array_except(b[f], a[f])) > 0
    ratio = b["words"] / F.greatest(F.lit(1), a["words"])
    least = OVERLAP if similarity is None else COSINE
    why = [("numbers", differs("numbers")), ("terms", differs("terms")), ("length", ~ratio.between(MIN_RATIO, MAX_RATIO)), ("similarity", score < least)]
    reasons = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(True)), name) for name, test in why]), lambda r: r.isNotNull())
    return F.struct((F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"), score.alias("similarity"), F.lit("overlap" if similarity is None else "cosine").alias("method"), ratio.alias("ratio"))


def gate_document(original, candidate) -> Column:
    """Array of (para, passed, reasons) of the paragraphs side by side; one without a partner fails.

    A paragraph has a word, so one that stayed as it was has the ratio and the overlap 1 and passes; only the others are gated.
    """
    def verdict(p, q):
        known = lambda passed, *why: F.struct(F.lit(passed).alias("passed"), F.array(*[F.lit(w) for w in why]).cast("array<string>").alias("reasons"))
        judged = T.let(gate(p, q), lambda g: F.struct(g["passed"].alias("passed"), g["reasons"].alias("reasons")))
        return F.when(q.isNull(), known(False, "missing")).when(p == q, known(True)).otherwise(judged)

    def row(g, i):
        return F.struct((i + 1).cast("int").alias("para"), g["passed"].alias("passed"), g["reasons"].alias("reasons"))

    def one(other, p, i):
        return T.let(T.let(F.get(other, i), lambda q: verdict(p, q)), lambda g: row(g, i))

    return T.let(paragraphs(candidate), lambda other: F.transform(paragraphs(original), lambda p, i: one(other, p, i)))


def best_candidates(candidates: DataFrame, keys: list, score: str = "score", number: str = "cand_no") -> DataFrame:
    """Of each (keys, original) the text that passes, isn't the original, and has the least score, the first of ties; else the original."""
    new = F.col("passed") & (T.flat(F.col("text")) != T.flat(F.col("original")))
    ranked = candidates.withColumn("ok", F.coalesce(new, F.lit(False)))
    order = Window.partitionBy(*keys).orderBy(F.col("ok").desc(), F.col(score), F.col(number))
    first = ranked.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return first.select(*keys, F.when(F.col("ok"), F.col("text")).otherwise(F.col("original")).alias("text"), F.col("ok").alias("rephrased"))


def fidelity(findings) -> Column:
    """Verdict on a variant from the findings of check(): numbers kept, failures and warnings."""
    of = lambda test: F.filter(findings, test)
    values = lambda kind: F.transform(of(lambda f: f["kind"] == kind), lambda f: f["detail"])
    new, missing = values("new-number"), values("missing-number")
    return F.struct(
        (F.size(new) + F.size(missing) == 0).alias("numbers_ok"), new.alias("new_numbers"), missing.alias("missing_numbers"),
        (F.size(of(lambda f: f["level"] == "FAIL")) == 0).alias("fail_free"), F.size(of(lambda f: f["level"] == "WARN")).alias("warnings"),
    )


def same_multiset(a, b) -> Column:
    """Whether two arrays hold the same values equally often."""
    return F.sort_array(a) == F.sort_array(b)

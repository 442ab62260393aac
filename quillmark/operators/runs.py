"""Flagged runs of sentences: grouping, context, files, splicing and review.

Runs are found by windows over one partition by document. Edits are spliced by patterns built from the data, inside a row
for each document; only the matching of placeholders to words (G2) needs Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quillmark.functions import lexicon as L
from quillmark.functions import text as T
from quillmark.functions.segment import MARKER, is_formula, paragraphs, sentences
from quillmark.operators.compare import MUST, count_of, times

#: What keeps a run as it is, the similarity of a copied sentence, the words that don't block.
KEEP, COPIED, SLACK = "KEEP", (4, 5), 20
#: Words that a placeholder may stand for.
WILD_WORDS = 8


def units_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos (from 1), para, idx, text and heading of every unit of B1 that may be rewritten."""
    rows = docs.select(key, F.posexplode(F.filter(sentences(F.col("text")), lambda u: ~(u["heading"] & (u["para"] == 1)))).alias("at", "u"))
    return rows.select(key, (F.col("at") + 1).alias("pos"), "u.*")


def find_runs(units: DataFrame, gap: int = 1, key: str = "doc_id") -> DataFrame:
    """Units with run (from 1; null outside), where `flagged` units of one paragraph have `gap` others between them at most."""
    w = Window.partitionBy(key).orderBy("pos")
    own = F.when(F.col("flagged"), F.struct("pos", "para"))
    rows = units.withColumns(
        {
            "last": F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "next": F.first(own, True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        }
    )
    after = F.col("flagged") & F.coalesce((F.col("last.para") == F.col("para")) & (F.col("pos") - F.col("last.pos") - 1 <= gap), F.lit(False))
    between = ~F.col("flagged") & (F.col("last.para") == F.col("next.para")) & (F.col("next.pos") - F.col("last.pos") - 1 <= gap)
    inside = F.col("flagged") | F.coalesce(between, F.lit(False))
    number = F.sum(F.when(F.col("flagged") & ~after, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", F.when(inside, number).cast("int")).drop("last", "next")


def runs(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each run of find_runs(): its units joined, its words, and the units before and after it in its paragraph."""
    w = Window.partitionBy(key).orderBy("pos")
    beside = lambda f, c: F.when(f("para").over(w) == F.col("para"), f(c).over(w))
    rows = units.withColumns({"before": beside(F.lag, "text"), "after": beside(F.lead, "text")}).where("run is not null")
    unit = F.struct("pos", "text")
    out = rows.groupBy(key, "run").agg(
        F.min("para").alias("para"), F.min("pos").cast("int").alias("first_pos"), F.max("pos").cast("int").alias("last_pos"),
        F.array_sort(F.collect_list(unit)).alias("units"), F.min_by("before", "pos").alias("before"), F.max_by("after", "pos").alias("after"),
        F.sum(T.n_words(T.strip_placeholders(F.col("text")))).cast("int").alias("words"),
    )
    return out.withColumn("original", F.array_join(F.transform("units", lambda u: u["text"]), " ")).drop("units")


def flagged_share(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """flagged and all units, runs, and the share of words that are flagged, in percent."""
    size = T.n_words(T.strip_placeholders(F.col("text")))
    rows = units.groupBy(key).agg(
        F.count_if("flagged").alias("flagged"), F.count("*").alias("units"), F.coalesce(F.max("run"), F.lit(0)).alias("runs"),
        F.sum(F.when(F.col("flagged"), size).otherwise(0)).alias("flagged_words"), F.sum(size).alias("words"),
    )
    return rows.withColumn("share", F.col("flagged_words") * 100 / F.greatest("words", F.lit(1)))


# --- files of runs -------------------------------------------------------------------------------

#: Fixed value: what a file of runs begins with.
HEADER = """# Phase 4 runs file.
# Write each run's rewrite on the lines under its REWRITE: line.
# Leave a REWRITE empty to keep that run as it is.
# Do not edit ORIGINAL blocks: apply_runs.py uses them to find each run in the draft.
# CONTEXT lines are for reading only; those sentences are not changed.
# Markers like ⟦12⟧ hold LaTeX code: keep each one exactly once, in place. Reword the text
# between a pair ⟦12⟧...⟦/12⟧ and keep both markers.
"""


def runs_file(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """A10: key and text of the file to be filled in, from runs()."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c)))
    block = F.concat_ws("\n", F.concat(F.lit("=== RUN "), F.col("run").cast("string"), F.lit(" ===")), line("CONTEXT BEFORE", "before"), F.lit("ORIGINAL:"), F.col("original"), line("CONTEXT AFTER", "after"), F.lit("REWRITE:"), F.lit(""))
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("run", block.alias("block")))).alias("blocks"))
    return rows.select(key, F.concat(F.lit(HEADER + "\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"), F.lit("\n")).alias("text"))


def joined_rewrite(lines) -> Column:
    """Lines of a rewrite as prose; bullets and formulas keep lines of their own."""
    def placed(lines, x, i):
        last = F.get(lines, i - 1)
        own = x.rlike(MARKER) | is_formula(x) | (i == 0) | F.coalesce(is_formula(last) & ~last.rlike(MARKER), F.lit(False))
        indent = F.when(x.rlike(MARKER), F.regexp_extract(x, r"(?U)^\s*", 0)).otherwise(F.lit(""))
        return F.concat(F.when(i == 0, "").when(own, "\n").otherwise(" "), indent, T.flat(x))

    return T.let(F.filter(lines, lambda x: T.strip(x) != ""), lambda ls: F.array_join(F.transform(ls, lambda x, i: placed(ls, x, i)), ""))


def parse_runs(text) -> Column:
    """Array of (run, original, rewrite) of a file of runs."""
    bodies = F.split(F.regexp_replace(text, r"(?m)^=== RUN ([0-9]+) ===[ \t]*$", f"{T.CUT}$1"), T.CUT)
    texts = "array<string>"
    start = F.struct(F.lit("").alias("section"), F.array().cast(texts).alias("original"), F.array().cast(texts).alias("rewrite"))

    def step(acc, line):
        head = F.regexp_extract(line, "^(ORIGINAL|REWRITE|CONTEXT BEFORE|CONTEXT AFTER):|^(#)", 0)
        rest = T.strip(F.regexp_replace(line, "^(ORIGINAL|REWRITE):", ""))
        opens, side = head.isin("ORIGINAL:", "REWRITE:"), head != ""
        section = F.when(opens, F.lower(F.regexp_replace(head, ":", ""))).when(side & (acc["section"] == "original"), "").otherwise(acc["section"])
        value = F.when(opens, rest).when(~side & (section == "original"), T.strip(line)).when(~side, F.regexp_replace(line, r"(?U)\s+$", ""))
        add = lambda c: F.when((section == c) & F.coalesce(value != "", F.lit(False)), F.concat(acc[c], F.array(value))).otherwise(acc[c])
        return F.struct(section.alias("section"), add("original").alias("original"), add("rewrite").alias("rewrite"))

    def one(body):
        lines = F.split(body, "\r\n|\n|\r")
        found = F.aggregate(F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1)), start, step)
        return F.transform(F.array(found), lambda f: F.struct(lines[0].cast("int").alias("run"), F.array_join(f["original"], " ").alias("original"), joined_rewrite(f["rewrite"]).alias("rewrite")))[0]

    return F.when(F.size(bodies) > 1, F.transform(F.slice(bodies, 2, F.greatest(F.lit(0), F.size(bodies) - 1)), one)).otherwise(F.array().cast("array<struct<run:int,original:string,rewrite:string>>"))


# --- splicing ------------------------------------------------------------------------------------


def filled(rewrite) -> Column:
    return (rewrite != "") & (rewrite != KEEP)


def fixed_format(original) -> Column:
    """Whether a run is headings and formulas only."""
    units = sentences(original)
    return (F.size(units) > 0) & F.forall(units, lambda u: u["heading"])


def unfilled(edit) -> Column:
    """Whether a run (original, rewrite) still waits for its rewrite."""
    return (edit["rewrite"] == "") | ((edit["rewrite"] == KEEP) & ~fixed_format(edit["original"]))


def located(draft, original) -> Column:
    """Times that a text occurs in a draft whatever its white space, and start (from 0) and end of the first."""
    quoted = F.transform(T.words(original), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.array_join(quoted, r"\s+")
    at = lambda p: F.regexp_instr(draft, p) - 1
    found = lambda p: F.struct(F.regexp_count(draft, p).alias("times"), at(p).alias("start"), (at(p) + F.coalesce(F.length(F.regexp_substr(draft, p)), F.lit(0))).alias("end"))
    none = F.struct(F.lit(0).alias("times"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    return F.transform(F.array(pattern), lambda p: F.when(p == "", none).otherwise(found(p)))[0]


def spliced(draft, edits) -> Column:
    """(text, applied, errors) of a draft with an array of (run, original, rewrite); with an error nothing is changed."""
    todo = F.filter(edits, lambda e: filled(e["rewrite"]))
    spans = F.transform(todo, lambda e: F.struct(located(draft, e["original"]).alias("at"), e["run"].alias("run"), e["rewrite"].alias("rewrite")))
    spans = F.transform(spans, lambda s: F.struct(s["at"]["start"].alias("start"), s["at"]["end"].alias("end"), s["run"].alias("run"), s["rewrite"].alias("rewrite"), s["at"]["times"].alias("times")))

    def built(spans):
        lost = F.transform(F.filter(spans, lambda s: s["times"] != 1), lambda s: F.concat(F.lit("run "), s["run"].cast("string"), F.lit(": found "), s["times"].cast("string"), F.lit(" times")))
        return T.let(F.array_sort(F.filter(spans, lambda s: s["times"] == 1)), lambda good: placed(good, lost))

    def placed(good, lost):
        met = F.transform(good, lambda s, i: F.when(F.get(good, i - 1)["end"] > s["start"], F.concat(F.lit("runs "), F.get(good, i - 1)["run"].cast("string"), F.lit(" and "), s["run"].cast("string"), F.lit(" overlap"))))
        errors = F.concat(lost, F.filter(met, lambda m: m.isNotNull()))
        begin = lambda i: F.coalesce(F.get(good, i - 1)["end"], F.lit(0))
        parts = F.transform(good, lambda s, i: F.concat(F.substr(draft, begin(i) + 1, F.greatest(F.lit(0), s["start"] - begin(i))), s["rewrite"]))
        text = F.concat(F.array_join(parts, ""), F.substr(draft, begin(F.size(good)) + 1, F.length(draft)))
        ok = F.size(errors) == 0
        return F.struct(F.when(ok, text).otherwise(draft).alias("text"), F.when(ok, F.transform(good, lambda s: s["run"])).otherwise(F.array().cast("array<int>")).alias("applied"), errors.alias("errors"))

    return F.transform(F.array(spans), built)[0]


def coverage(edits) -> Column:
    """runs rewritten, all runs, and the share of their words that were rewritten."""
    size = lambda es: F.aggregate(F.transform(es, lambda e: T.n_words(e["original"])), F.lit(0), lambda a, n: a + n)
    done = F.filter(edits, lambda e: filled(e["rewrite"]))
    return F.struct(F.size(done).alias("done"), F.size(edits).alias("runs"), (size(done) / F.greatest(size(edits), F.lit(1))).alias("share"))


# --- review --------------------------------------------------------------------------------------


def hedge_counts(before, after) -> Column:
    """Array of (kind, before, after) of the hedges that are fewer, and of "must" if it is more."""
    row = lambda k, p: F.struct(F.lit(k).alias("kind"), count_of(before, p).alias("before"), count_of(after, p).alias("after"))
    found = F.array(*[row(k, T.whole(p)) for k, p in L.HEDGES.items()], row("must", MUST))
    return F.filter(found, lambda x: F.when(x["kind"] == "must", x["after"] > x["before"]).otherwise(x["after"] < x["before"]))


def run_changes(original, rewrite) -> Column:
    """E14 and E16 of a run: hedges lost, stems dropped, placeholders missing and extra."""
    old, new = times(T.placeholders(original)), times(T.placeholders(rewrite))
    n = lambda m, t: F.coalesce(F.try_element_at(m, t), F.lit(0))
    return F.struct(
        F.filter(hedge_counts(original, rewrite), lambda x: x["kind"] != "must").alias("hedges"),
        F.array_sort(F.array_except(T.stems(original), T.stems(rewrite))).alias("dropped"),
        F.array_sort(F.filter(F.map_keys(old), lambda t: n(new, t) < n(old, t))).alias("missing"),
        F.array_sort(F.filter(F.map_keys(new), lambda t: n(new, t) > n(old, t))).alias("extra"),
    )


def broken_enumerations(text) -> Column:
    """Array of (para, ordinal, before it) of ordinals whose paragraph lacks the one before and "next"."""

    def of(para, p):
        has = lambda w: para.rlike(T.whole(w))
        row = lambda o, b: F.when(has(o) & ~has(b) & ~has("next"), F.struct((p + 1).cast("int").alias("para"), F.lit(o).alias("ordinal"), F.lit(b).alias("previous")))
        return F.filter(F.array(*[row(o, b) for b, o in zip(L.ORDINALS, L.ORDINALS[1:], strict=False)]), lambda x: x.isNotNull())

    return F.flatten(F.transform(paragraphs(text), of))


def enumeration_changes(before, after) -> Column:
    """What is broken after a splice and wasn't before."""
    return F.array_except(broken_enumerations(after), broken_enumerations(before))


def copied(original, rewrite) -> Column:
    """Sentences of four different words or more of which a sentence of the rewrite is a near copy, with the similarity."""
    return T.let(F.transform(sentences(rewrite), lambda s: T.word_set(s["text"])), lambda new: _copied(original, new))


def _copied(original, new) -> Column:
    share = lambda w, n: F.size(F.array_intersect(w, n)) / F.greatest(F.size(F.array_union(w, n)), F.lit(1))
    best = lambda w: F.array_max(F.transform(new, lambda n: share(w, n)))
    rows = F.transform(sentences(original), lambda s: F.struct(s["text"].alias("text"), F.when(F.size(T.word_set(s["text"])) >= 4, best(T.word_set(s["text"]))).alias("similarity")))
    return F.filter(rows, lambda r: r["similarity"] * COPIED[1] >= COPIED[0])


def review(findings, edits) -> Column:
    """The findings with side: inside a rewrite, outside of all, or general (no place in the draft)."""
    new = F.transform(F.filter(edits, lambda e: filled(e["rewrite"])), lambda e: T.flat(T.strip_placeholders(e["rewrite"])))
    general = lambda f: f["text"].isNull() | (f["origin"] == "source")
    side = lambda f, new: F.when(general(f), "general").when(F.exists(new, lambda r: F.contains(r, T.flat(f["text"]))), "inside").otherwise("outside")
    return T.let(new, lambda n: F.transform(findings, lambda f: F.struct(side(f, n).alias("side"), f["level"].alias("level"), f["kind"].alias("kind"), f["text"].alias("text"))))


def ready(reviewed, edits, before, after) -> Column:
    """Whether nothing blocks: no open run, changed placeholder, copy, lost hedge, broken enumeration, finding inside or failure."""
    todo = F.filter(edits, lambda e: filled(e["rewrite"]))
    bad = lambda e: F.exists(F.array(run_changes(e["original"], e["rewrite"])), lambda c: (F.size(c["hedges"]) + F.size(c["missing"]) + F.size(c["extra"])) > 0)
    minor = lambda f: (f["kind"] == "long-sentence") & (T.n_words(f["text"]) <= SLACK)
    blocks = [
        F.exists(edits, unfilled),
        F.exists(todo, bad),
        F.exists(todo, lambda e: F.size(copied(e["original"], e["rewrite"])) > 0),
        F.size(hedge_counts(before, after)) > 0,
        F.size(enumeration_changes(before, after)) > 0,
        F.exists(reviewed, lambda f: ((f["side"] == "inside") & ~minor(f)) | ((f["side"] == "general") & (f["level"] == "FAIL"))),
    ]
    out = ~blocks[0]
    for b in blocks[1:]:
        out = out & ~b
    return out


# --- placeholders as wildcards -------------------------------------------------------------------


def wild_match(key: list, tokens: list, may_end: bool) -> bool:
    """Whether a flag's words begin a sentence's, where a token None stands for up to WILD_WORDS words.

    The best number of literal matches is kept for each number of words used; half of the words must match literally. The
    last word may be cut off; if may_end, the sentence may end before the flag.
    """
    need, n = (len(key) + 1) // 2, len(key)
    best = {0: 0}
    for token in tokens:
        if best.get(n, -1) >= need:
            return True
        new: dict = {}
        for used, hits in best.items():
            if used == n:
                continue
            if token is None:
                for k in range(min(WILD_WORDS, n - used) + 1):
                    new[used + k] = max(new.get(used + k, -1), hits)
            elif key[used] == token:
                new[used + 1] = max(new.get(used + 1, -1), hits + 1)
            elif used == n - 1 and token.startswith(key[used]) and hits + 1 >= need:
                return True
        best = new
        if not best:
            return False
    return best.get(n, -1) >= need or (may_end and max(best.values(), default=-1) >= need)


def wild_tokens(text) -> Column:
    """The words of a sentence as compared, null for a placeholder that is no part of a pair."""
    closed = F.transform(T.all_of(text, "⟦/([0-9]+)⟧", 1), lambda n: F.concat(F.lit("⟦"), n, F.lit("⟧")))
    parts = F.split(F.regexp_replace(text, f"({T.PLACEHOLDER})", f"{T.CUT}$1{T.CUT}"), T.CUT)
    plain = lambda p: F.filter(F.split(F.lower(p), "[^a-z0-9]+"), lambda w: w != "")
    one = lambda p: F.when(~p.rlike(f"^{T.PLACEHOLDER}$"), plain(p)).when(p.startswith("⟦/") | F.array_contains(closed, p), F.array().cast("array<string>")).otherwise(F.array(F.lit(None).cast("string")))
    return F.flatten(F.transform(parts, one))


@F.pandas_udf(BooleanType())
def starts_wild(key: pd.Series, tokens: pd.Series, may_end: pd.Series) -> pd.Series:
    return pd.Series([wild_match(list(k), list(t), bool(m)) for k, t, m in zip(key, tokens, may_end, strict=True)], dtype=bool)


@F.pandas_udf(BooleanType())
def holds_wild(key: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([any(wild_match(list(k), list(t)[j:], False) for j in range(len(t))) for k, t in zip(key, tokens, strict=True)], dtype=bool)

"""Comparison of a text with its source and fact sheet (E1 to E12, C9, F1 to F8): one map over pairs.

A pair is a row (pair_id, source, draft, facts). All sets that a rule needs are columns of that row, so fact checks are
array operations and nothing is shuffled; a table of millions of pairs is as many independent rows. Null
texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import lexicon as L
from quillmark.functions import text as T
from quillmark.functions.segment import paragraphs, prose, sentences, units_of
from quillmark.operators import detect as D

MUST = T.whole("must")
CERTAINTY = T.whole("|".join(L.CERTAINTY))
#: The least and greatest share of words to keep, in percent.
MIN_RETENTION, MAX_RETENTION = 95.0, 110.0


def by_value(numbers) -> Column:
    """Numbers in ascending order of their values."""
    return F.array_sort(numbers, lambda a, b: F.when(a.cast("double") < b.cast("double"), -1).when(a.cast("double") > b.cast("double"), 1).otherwise(0))


def of_units(units, extract) -> Column:
    """The different values that extract(text) gives over all units."""
    return F.array_distinct(F.flatten(F.transform(units, lambda u: extract(u["text"]))))


def cleaned(pairs: DataFrame) -> DataFrame:
    """The pairs without placeholders, which are listed in columns of their own, and the fact sheet's comments."""
    given = [F.coalesce(c, F.lit("")).alias(c) for c in ("source", "draft", "facts")]
    rows = pairs.select("pair_id", *given).withColumns({"source_marks": T.placeholders(F.col("source")), "draft_marks": T.placeholders(F.col("draft"))})
    return rows.withColumns({"source": T.strip_placeholders(F.col("source")), "draft": T.strip_placeholders(F.col("draft")), "facts": T.fact_sheet(F.col("facts"))})


def prepared(pairs: DataFrame) -> DataFrame:
    """The pairs with everything that the rules compare, each computed once."""
    rows = cleaned(pairs)
    rows = rows.withColumns({f"{c}_units": sentences(F.col(c)) for c in ("source", "draft", "facts")})
    rows = rows.withColumn("prose", prose(F.col("draft_units")))
    rows = rows.withColumns({f"{c}_numbers": of_units(F.col(f"{c}_units"), T.numbers) for c in ("source", "draft", "facts")})
    rows = rows.withColumns({f"{c}_terms": T.terms(F.col(c)) for c in ("source", "facts")})
    more = {"acronyms": T.defined_acronyms(F.col("draft")), "source_stems": T.stems(F.col("source")), "draft_stems": T.stems(F.col("draft"))}
    return rows.withColumns(more | {f"{c}_words": T.n_words(F.col(c)) for c in ("source", "draft")})


def times(array) -> Column:
    """Map of each different value to how often it occurs."""
    return F.map_from_entries(F.transform(F.array_distinct(array), lambda v: F.struct(v, F.size(F.filter(array, lambda x: x == v)))))


def placeholder_findings(before, after) -> Column:
    """Placeholders lost, repeated or invented, as arrays of tokens."""
    return T.let(F.struct(times(before).alias("old"), times(after).alias("new")), lambda m: _placeholder_findings(before, after, m["old"], m["new"]))


def _placeholder_findings(before, after, old, new) -> Column:
    n = lambda m, t: F.coalesce(F.try_element_at(m, t), F.lit(0))
    lost = F.filter(F.array_sort(F.array_distinct(before)), lambda t: n(new, t) < n(old, t))
    repeated = F.filter(F.array_sort(F.array_distinct(after)), lambda t: (n(new, t) > 1) & (n(old, t) > 0))
    invented = F.array_sort(F.array_except(after, before))
    named = lambda what, tokens: F.transform(tokens, lambda t: F.concat(F.lit(what + " "), t))
    return F.transform(F.concat(named("missing", lost), named("repeated", repeated), named("invented", invented)), lambda t: D.finding("FAIL", "placeholder", None, t))


def new_numbers() -> Column:
    """E1."""
    of = lambda allowed: D.each(F.col("draft_units"), "new-number", lambda u: by_value(F.array_except(T.numbers(u["text"]), allowed)), "FAIL")
    return T.let(F.array_union("source_numbers", "facts_numbers"), of)


def new_terms() -> Column:
    """E2."""
    of = lambda allowed: D.each(F.col("draft_units"), "new-term", lambda u: F.array_sort(F.array_except(T.terms(u["text"]), allowed)))
    return T.let(F.array_union(F.array_union("source_terms", "facts_terms"), F.col("acronyms")), of)


def missing_numbers() -> Column:
    """With the first unit of the source that has the number."""
    missing = by_value(F.array_except("source_numbers", "draft_numbers"))
    first = lambda n: F.get(F.filter("source_units", lambda u: F.array_contains(T.numbers(u["text"]), n)), F.lit(0))
    return F.transform(missing, lambda n: D.finding("FAIL", "missing-number", first(n), n, "source"))


def retention() -> Column:
    """words of the draft in percent of the source's; 0 for an empty source."""
    return F.when(F.col("source_words") > 0, F.col("draft_words") / F.col("source_words") * 100).otherwise(0.0)


def retention_findings(least: float = MIN_RETENTION, most: float = MAX_RETENTION) -> Column:
    """Too short fails; too long warns, and says whether facts were added."""
    facts = F.size(F.array_except(F.array_intersect("draft_numbers", "facts_numbers"), F.col("source_numbers"))) > 0
    long = D.finding("WARN", "retention", None, F.when(facts, "facts added").otherwise("filler"))
    return F.when(retention() < least, F.array(D.finding("FAIL", "retention"))).when(retention() > most, F.array(long)).otherwise(D.none())


def count_of(text, pattern: str) -> Column:
    return F.size(T.all_of(text, pattern))


def hedges() -> Column:
    """E5: of each class that the draft has less of, every source unit with one of its words."""

    def of(name: str, words: str):
        pattern = T.whole(words)
        found = D.matching(F.col("source_units"), "hedge", lambda t: t.rlike(pattern), lambda t: F.concat(F.lit(f"{name}: "), F.regexp_extract(t, pattern, 0)), origin="source")
        return F.when(count_of(F.col("draft"), pattern) < count_of(F.col("source"), pattern), found).otherwise(D.none())

    return F.concat(*[of(n, w) for n, w in L.HEDGES.items()])


def stronger(kind: str, pattern: str) -> Column:
    """Draft units with the pattern, where the draft has more of it than the source."""
    found = D.matching(F.col("draft_units"), kind, lambda t: t.rlike(pattern))
    return F.when(count_of(F.col("draft"), pattern) > count_of(F.col("source"), pattern), found).otherwise(D.none())


def drops() -> Column:
    """Source sentences of whose stems the draft lacks three or more, and 30 % or more."""
    gone = lambda u: F.array_except(T.stems(u["text"]), F.col("draft_stems"))
    rows = F.transform(prose(F.col("source_units")), lambda u: F.struct(u.alias("u"), gone(u).alias("gone"), F.size(T.stems(u["text"])).alias("n")))
    lost = F.filter(rows, lambda r: (F.size(r["gone"]) >= 3) & (F.size(r["gone"]) * 10 >= r["n"] * 3))
    return F.transform(lost, lambda r: D.finding("WARN", "possible-drop", r["u"], F.array_join(F.array_sort(r["gone"]), " "), "source"))


def facts_used() -> Column:
    """Numbers of the draft that only the fact sheet has."""
    return by_value(F.array_except(F.array_intersect("draft_numbers", "facts_numbers"), F.col("source_numbers")))


def statistics() -> Column:
    """F1 to F8 of a pair, unrounded."""
    sizes = F.transform("prose", lambda u: T.n_flat(u["text"]))
    given = F.struct(sizes.alias("sizes"), D.reading(F.col("prose")).alias("reading"), D.rates(F.col("prose")).alias("rates"))
    return T.let(given, lambda g: _statistics(g["sizes"], g["reading"], g["rates"]))


def _statistics(sizes, reading, rates) -> Column:
    n, total = F.size(sizes), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    mean = F.when(n > 0, total / n).otherwise(0.0)
    spread = F.sqrt((n * squares - total * total) / F.nullif(n.cast("long") * (n - 1), F.lit(0)))
    return F.struct(
        "source_words", "draft_words", retention().alias("retention"), n.alias("sentences"), mean.alias("mean_length"), F.coalesce(F.array_max(sizes), F.lit(0)).alias("max_length"),
        F.when(n > 0, F.size(F.filter(sizes, lambda x: x <= D.SHORT)) * 100 / n).otherwise(0.0).alias("short_share"),
        F.when((n > 1) & (total > 0), spread / mean).otherwise(0.0).alias("length_burstiness"),
        reading["ease"].alias("flesch_reading_ease"), reading["grade"].alias("flesch_kincaid_grade"),
        *[rates[c].alias(c) for c in ("pronoun_rate", "nominalization_rate", "passive_share")],
    )


FACT_RULES = {
    "placeholder": lambda: placeholder_findings(F.col("source_marks"), F.col("draft_marks")),
    "new-number": new_numbers,
    "new-term": new_terms,
    "missing-number": missing_numbers,
    "retention": retention_findings,
    "hedge": hedges,
    "modal": lambda: stronger("modal", MUST),
    "certainty": lambda: stronger("certainty", CERTAINTY),
    "possible-drop": drops,
}


def check(pairs: DataFrame, pos_checks: bool = False, keep: bool = False) -> DataFrame:
    """pair_id, findings, stats, facts_used and passed (E11: nothing failed) of each pair.

    With keep, the texts that were compared stay as given_source and given_draft.
    """
    found = F.concat(*[rule() for rule in FACT_RULES.values()], D.style(F.col("prose"), pos_checks))
    texts = [F.col(c).alias(f"given_{c}") for c in ("source", "draft")] if keep else []
    rows = prepared(pairs).select("pair_id", found.alias("findings"), statistics().alias("stats"), facts_used().alias("facts_used"), *texts)
    return rows.withColumn("passed", ~F.exists("findings", lambda f: f["level"] == "FAIL"))


def counted(pairs: DataFrame) -> DataFrame:
    """pair_id, stats and failures: the statistics of check() and how many of its findings fail (E11), without those that only warn.

    What fails are placeholders, new and missing numbers and the least retention. A paragraph that source and draft share has
    the same units and numbers in both, so it has none that is new or missing: units are made once of it.
    """
    rows = cleaned(pairs).withColumns({f"{c}_paras": paragraphs(F.col(c)) for c in ("source", "draft")})
    rows = rows.withColumn("shared", F.array_intersect("source_paras", "draft_paras"))
    rows = rows.withColumns({"draft_units": units_of(F.col("draft_paras")), "gone_units": units_of(F.array_except("source_paras", "shared")), "facts_units": sentences(F.col("facts"))})
    rows = rows.withColumn("prose", prose(F.col("draft_units"))).withColumns({f"{c}_words": T.n_words(F.col(c)) for c in ("source", "draft")})
    texts = lambda units, test=None: F.transform(units if test is None else F.filter(units, test), lambda u: u["text"])
    is_shared = lambda s, u: F.array_contains(s["shared"], F.get(s["paras"], u["para"] - 1))
    sides = T.let(F.struct("shared", F.col("draft_paras").alias("paras"), F.col("draft_units").alias("units")), lambda s: F.struct(
        texts(s["units"], lambda u: is_shared(s, u)).alias("same"), texts(s["units"], lambda u: ~is_shared(s, u)).alias("own")))
    rows = rows.withColumn("sides", sides).withColumns({"same": T.numbers_of(F.col("sides.same")), "gone": T.numbers_of(texts("gone_units")), "more": T.numbers_of(texts("facts_units"))})
    rows = rows.withColumns({"own": F.transform("sides.own", T.numbers), "allowed": F.array_union(F.array_union("same", "gone"), "more")})
    new = T.let(F.col("allowed"), lambda a: F.aggregate("own", F.lit(0), lambda n, unit: n + F.size(F.array_except(unit, a))))
    missing = F.size(F.array_except("gone", F.array_union("same", F.flatten("own"))))
    short = F.when(retention() < MIN_RETENTION, 1).otherwise(0)
    failures = new + missing + short + F.size(placeholder_findings(F.col("source_marks"), F.col("draft_marks")))
    return rows.select("pair_id", statistics().alias("stats"), failures.cast("long").alias("failures"))


def findings(pairs: DataFrame, rules: list | None = None, pos_checks: bool = False) -> DataFrame:
    """A row for each finding of the rules named (all of them by default)."""
    names = [*FACT_RULES, *D.RULES] if rules is None else rules
    found = [FACT_RULES[n]() if n in FACT_RULES else D.RULES[n](F.col("prose")) for n in names] + ([D.signals(F.col("prose"))] if pos_checks else [])
    rows = prepared(pairs).select("pair_id", F.explode(F.concat(*found) if len(found) > 1 else found[0]).alias("f"))
    return rows.select("pair_id", "f.*")


def ledger(pairs: DataFrame) -> DataFrame:
    """Numbers and terms of the source, what the fact sheet adds to them, and the number of placeholders."""
    rows = prepared(pairs)
    return rows.select(
        "pair_id",
        by_value(F.col("source_numbers")).alias("numbers"),
        by_value(F.array_except("facts_numbers", "source_numbers")).alias("fact_numbers"),
        F.array_sort("source_terms").alias("terms"),
        F.array_sort(F.array_except("facts_terms", "source_terms")).alias("fact_terms"),
        F.size("source_marks").alias("placeholders"),
    )

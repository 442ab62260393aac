"""Flags and numbers on what the first queries leave out."""

import re

import duckdb

from quillmark.operators import views
from quillmark.plans import catalogue


def test_flags_fall_back_to_substrings_and_unmatched_are_reported(spark):
    units = spark.createDataFrame(
        [(1, 1, "2.1 The first sentence, of some words."), (1, 2, "Then a second sentence of some words follows."), (1, 3, "Then a second one."), (2, 1, "Short one")],
        "doc_id long, pos int, text string",
    )
    flags = spark.createDataFrame(
        [(1, 1, "II. THE FIRST -- sentence"), (1, 2, "sentence of some words"), (1, 3, "Then a second"), (1, 4, "nowhere in the document"), (1, 5, "too short"), (2, 6, "Short one and more of it"), (1, 7, "Then a second one. And more after it")],
        "doc_id long, line_no int, flag string",
    )
    matches, left = catalogue.match_flags(units, flags)
    assert sorted(map(tuple, matches.collect())) == [(1, 1, 1), (1, 2, 1), (1, 2, 2), (1, 3, 2), (1, 3, 3), (1, 7, 3)]
    assert sorted(map(tuple, left.collect())) == [(1, 4, "nowhere in the document"), (2, 6, "short one and more of it")]


def test_every_sentence_has_flags(spark):
    sf = "/root/testdata/sf0.001"
    units = catalogue.build(spark, sf, "units").where("length(text) >= 36")
    own = catalogue.flag_match_all(spark, sf).selectExpr("doc_id", "pos", "line_no").where("line_no = pos * 3")
    keys = units.where(catalogue.F.length(catalogue.flag_key(catalogue.F.substring("text", 1, 24))) >= 12)
    assert keys.join(own, ["doc_id", "pos"], "left_anti").count() == 0
    assert catalogue.unmatched(spark, sf).where("key LIKE 'zq%'").count() > 0


def test_numbers_within_words_and_beside_marks(spark):
    texts = ['(1998), "42", 50%, +1, $7, -3, 42-50, 555-6869', "Li6.4 O12 cm-2 m^{1/2} x_3 a/4 .5 b12,345 12ab34", "3,860 3860 7.0 007 0.50 1.2.5 3,8601 1,2 12,345.60, 1234,567", "", "é12 1-2-x-3 9", None]
    want = [
        ["1998", "42", "50", "1", "7", "3", "42", "50", "555", "6869"],
        ["345", "12"],
        ["3860", "3860", "7", "7", "0.5", "1.2", "3860", "1", "2", "12345.6", "1234", "567"],
        [],
        ["12", "1", "2", "9"],
        [],
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in views.digits(docs, "doc_id").collect():
        got.setdefault(r.doc_id, []).append(r.value)
    assert [sorted(got.get(i, [])) for i in range(len(texts))] == [sorted(x) for x in want]
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    rows = con.sql(f"WITH {views.DUCK['doc_digits']} SELECT doc_id, value FROM doc_digits").fetchall()
    assert sorted(rows) == sorted((i, v) for i, x in enumerate(want) for v in x)


def test_numbers_of_documents_are_all_found(spark):
    sf = "/root/testdata/sf0.001"
    pattern = re.compile(views.DIGITS)
    want = {r.doc_id: len(pattern.findall(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text is not null").collect()}
    got = {r.doc_id: r["sum(times)"] for r in catalogue.QUERIES["all_numbers"](spark, sf).groupBy("doc_id").sum("times").collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_retention_of_turns_without_words(spark, tmp_path):
    rows = [(1, 0, "user", "some words here"), (1, 1, "assistant", "..."), (1, 2, "user", "two words"), (2, 0, "user", "a b"), (2, 1, "assistant", None), (3, 0, "user", "a b"), (3, 1, "assistant", "a b")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.source_words, r.draft_words, r.retention, r.verdict) for r in catalogue.QUERIES["retention_all"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (3, 0, 0.0, "FAIL"), (1, 1): (0, 2, 0.0, "FAIL"), (2, 0): (2, 0, 0.0, "FAIL"), (3, 0): (2, 2, 100.0, "OK")}

"""Ids beyond 2^53 beside nulls, clashing column names, very long texts, short items, and empty tables."""

import itertools
import random

import numpy as np
import pytest

pytest.importorskip("quillmark.llm")
import corpus_pipeline  # noqa: E402
from quillmark.llm import decontaminate, embedding_dedup, langid, line_dedup, mixing, ngram_join, quality, secrets, sharding, suffix_dedup  # noqa: E402
from quillmark.llm.queries import QUERIES  # noqa: E402

BIG = [2**60 + 1, 2**60 + 3, 7]
TEXTS = ["the first text of them has some words of its own and so on", "quite another one that says nothing of the kind at all", "a third with other things in it, to be told apart from both", "one without an id, which no other text is like in any way"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*zip(BIG, TEXTS, ["en"] * 3, ["a", "b", "a"], strict=False), (None, TEXTS[3], "en", None), (None, None, None, "b"), (None, TEXTS[3], "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


def folder(tmp_path_factory, spark, docs, labels=(), vectors=(), items=((1, "no such item in any of the texts"),)):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark, docs):
    vectors = [(i, [1.0 + (i == 7), 2.0], 0) for i in BIG] + [(None, [5.0, -1.0], 0), (None, None, 0)]
    return folder(tmp_path_factory, spark, docs, [(BIG[0], 1, 0), (BIG[1], 0, 0)], vectors)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("op2", "op5"))])
def test_ids_are_exact_beside_nulls(spark, tables, name):
    ids = [r.doc_id for r in QUERIES[name](spark, tables).select("doc_id").collect()]
    want = BIG + [None] * (2 if name.startswith("op9") else 3)
    assert sorted(map(str, ids)) == sorted(map(str, want))


def test_vector_ids_are_exact_beside_nulls(spark, tables):
    got = {(r.vec_id, r.component_id) for r in QUERIES["op2_embedding_dedup"](spark, tables).collect()}
    assert got == {(BIG[0], 7), (BIG[1], 7), (7, 7), (None, None)}


def test_join_results_keep_their_ids(spark, tables):
    rows = QUERIES["op1_ngram_join"](spark, tables).collect()
    assert {(r.doc_id, r.class_id, r.component_id, r.kept) for r in rows if r.doc_id} == {(i, i, i, True) for i in BIG}
    # the two equal rows without an id are one class, of which one stays; the text without words stays too
    assert sorted((r.n_links, r.kept) for r in rows if r.doc_id is None) == [(0, True), (1, False), (1, True)]


@pytest.fixture(scope="module")
def none(tmp_path_factory, spark):
    return folder(tmp_path_factory, spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string"))


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, none, name):
    assert QUERIES[name](spark, none).count() == 0


def test_pipeline_of_empty_tables(spark, none):
    assert corpus_pipeline.run(spark, none).count() == 0


CLASH = ["_h1", "_h", "_k1", "_k2", "_taken", "_size", "_rows", "_tie", "_copy", "score", "rejected", "lang_pred", "shard_", "h1", "grams", "key", "copies", "left", "n", "t", "many", "row", "id"]


def test_stages_keep_columns_of_any_name(spark, tables):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=30)), "en", "ab"[i % 2], f"mark{i}") for i in range(20)]
    rows += [(5, rows[5][1], "en", "b", "mark5b"), (30, rows[6][1], "en", "a", "mark30")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mark string")
    for c in CLASH:
        docs = docs.withColumn(c, docs.mark)
    whole = docs.select("doc_id", *[c for c in docs.columns])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "sharding":
            assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(getattr(r, c) == r.mark for r in got for c in CLASH if c in out.columns), name
        if name == "ngram_jaccard_join":
            assert sorted(r.doc_id for r in got) == list(range(20))
        if name == "sharding":
            assert len(got) == whole.count() and set(docs.columns) <= set(out.columns)
            by = {}
            for r in got:
                by.setdefault(r.shard, []).append(r.slot)
            assert all(sorted(x) == list(range(len(x))) for x in by.values())
    found = line_dedup.dedup(docs.select("doc_id", "text"))
    assert line_dedup.clean(docs, found).columns == docs.columns


def test_mixture_of_a_long_word_and_of_texts_without_blanks(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("天地玄黄宇宙洪荒日月盈昃", k=3000)), "a") for i in range(300)] + [(1000, "x" * 14_000_000, "a"), (1001, "word " * 500, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), few=10).collect()
    assert len({r.key for r in got if r.source == "a"}) == 301 and all(np.isfinite(r.key) for r in got)
    # 801 words by 5 : 2 are more than three times the 301 of the first source holds only if that were less
    assert {r.source: round(r.target, 3) for r in got} == {"a": round(801 * 5 / 7, 3), "b": round(801 * 2 / 7, 3)}


def test_mixture_takes_by_the_weighted_order(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(1, 9)), "ab"[i % 3 > 0], float(rng.randint(1, 5))) for i in range(400)] + [(7, "w w", "a", 1.0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    for few in (1, 20_000):
        got = mixing.mix(docs, quality="weight", few=few, bins=4).collect()
        for source in "ab":
            own = sorted((r for r in got if r.source == source), key=lambda r: (r.key, r.tie, r.doc_id, -r.taken))
            left = int(own[0].target + 1e-6)
            epochs = left // own[0].source_size
            left -= epochs * own[0].source_size
            for r in own:
                assert r.taken == epochs * r.size + max(0, min(r.size, left))
                left -= r.size


def test_items_of_one_to_four_words_are_found(spark):
    docs = spark.createDataFrame([(1, "So the answer is Paris, they say."), (2, "the answer was paris"), (3, "Paris"), (4, None), (5, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the answer is Paris"), (2, "paris"), (3, "is paris"), (4, "--"), (5, None)], "item_id long, text string")
    verified, named = decontaminate.find(docs, items, short=True)
    pairs = verified.join(named, ["i1", "i2"]).join(decontaminate.keyed(docs, "doc_id"), ["k1", "k2"])
    assert {(r.doc_id, r.item_id) for r in pairs.collect()} == {(1, 1), (1, 2), (2, 2), (3, 2), (1, 3)}


def test_factors_equal_brute_force():
    rng = np.random.default_rng(6)
    for size, letters, length in ((200, 2, 5), (300, 3, 9), (400, 1, 17)):
        data = rng.integers(97, 97 + letters, size).astype(np.uint8)
        start = np.arange(size - length + 1)
        ids = rng.integers(0, 12, len(start))
        lpf, first = suffix_dedup.factors(data, start, ids, length)
        text = data.tobytes()
        for i in start:
            own = text[i : i + length]
            equal = [ids[j] for j in start if text[j : j + length] == own]
            assert (lpf[i] >= length) == (min(equal) < ids[i])
            assert first[i] == min(equal)
            # a factor that was found is never longer than the longest match with a smaller document
            best = max((next((k for k in range(length) if text[j + k] != own[k]), length) for j in start if ids[j] < ids[i]), default=0)
            assert lpf[i] <= best if lpf[i] >= length else True


def test_suffix_order_has_the_common_prefixes():
    data = np.frombuffer(b"abracadabra abracadabra xyz abracadabr", np.uint8)
    start = np.arange(len(data) - 19)
    order, lcp = suffix_dedup.suffix_order(data, start, 20)
    rows = [data[s : s + 20].tobytes() for s in start[order]]
    assert rows == sorted(rows)
    for k in range(1, len(rows)):
        assert lcp[k] == next((i for i in range(20) if rows[k][i] != rows[k - 1][i]), 20)


def test_multi_sequence_visits_all_cells_in_reach_by_distance():
    rng = np.random.default_rng(9)
    near, far = np.sort(rng.random(9)).tolist(), np.sort(rng.random(7)).tolist()
    got = [near[i] + far[j] for i, j in embedding_dedup.multi_sequence(near, far, 0.8)]
    assert got == sorted(got) and len(got) == sum(a + b <= 0.8 for a, b in itertools.product(near, far))
    assert list(embedding_dedup.multi_sequence([0.5], [0.5], 0.8)) == []


def test_bands_share_a_minimum_at_most():
    bands = line_dedup.bands()
    assert len(bands) == line_dedup.BANDS and all(len(set(b)) == line_dedup.ROWS for b in bands)
    assert all(len(set(a) & set(b)) <= 1 for a, b in itertools.combinations(bands, 2))


def test_lines_are_compared_as_python_splits_them(spark):
    raw = ["A  b", "a b ", "\ta b", "a b", "a\x1cb", "a　 b", "ab", "é  È"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "doc_id long, text string")
    got = {r.doc_id: r.line for r in line_dedup.lines(rows).collect()}
    assert got == {i: " ".join(x.lower().split()) for i, x in enumerate(raw)}


def test_languages_are_learned_however_many(spark):
    rows = [(i, f"word{i % 300} text{i % 300} more{i % 300}", f"l{i % 300:03d}") for i in range(600)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=300)
    assert len(model["langs"]) == 300


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    vocab = {"x": ["".join(rng.choices("abcde", k=5)) for _ in range(40)], "y": ["".join(rng.choices("fghij", k=5)) for _ in range(40)]}
    text = lambda lang, n: " ".join(rng.choices(vocab[lang], k=n))
    model = langid.train([text(lang, 20) for lang in "xy" * 60], list("xy" * 60))
    lang, score, _ = langid.predict(model, [text("x", 5000), text("y", 9), ""])
    assert lang == ["x", "y", "und"] and min(score[:2]) > 0.9


def test_quality_through_the_query(spark, tmp_path_factory):
    good, bad = "Plain words in a row, and a stop. ", "W%%% x$$$ y!!! "
    rows = [(i, (good if i % 2 else bad) * (5 + i % 7), "en", "a") for i in range(120)] + [(3, good, "en", "a")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    path = folder(tmp_path_factory, spark, docs, [(i, i % 2, 0) for i in range(100)])
    got = [r for r in QUERIES["op7_quality"](spark, path).collect() if r.held_out]
    assert got and all(r.predicted == r.doc_id % 2 for r in got)
    assert len(quality.rate(docs, quality.fit(docs, docs.sparkSession.read.parquet(f"{path}/labels.parquet")), docs.columns).columns) == 6


def test_secrets_of_held_out_texts():
    rng, draw = np.random.default_rng(5), random.Random(1)
    vocab = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) for _ in range(500)]
    model = secrets.train([" ".join(draw.choices(vocab, k=draw.randint(6, 15))) for _ in range(3000)])
    found = wrong = 0
    for _ in range(100):
        key = "sk_live_" + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 24))
        line = f"some plain words {key} stand here"
        spans = secrets.scan(model, [line])[0]
        found += any(s <= 17 and e >= 17 + len(key) for s, e, _ in spans)
        wrong += any(e <= 17 or s >= 17 + len(key) for s, e, _ in spans)
    assert found >= 90 and wrong <= 5


def test_hilbert_index_walks_the_whole_cube(spark):
    bits, n = 2, 3
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, "a int, b int, c int")
    got = {r.at: (r.a, r.b, r.c) for r in df.withColumn("at", sharding.hilbert([df.a, df.b, df.c], bits)).collect()}
    assert sorted(got) == list(range(len(points)))
    for k in range(1, len(points)):
        assert sum(abs(x - y) for x, y in zip(got[k], got[k - 1], strict=True)) == 1


def test_pipeline_carries_texts(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert {"doc_id", "text", "lang", "source", "shard", "slot", "size"} <= set(out.columns)
    assert ngram_join.stage(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables).count() == 5

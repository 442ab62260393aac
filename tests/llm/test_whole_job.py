"""The corpus operators on what a cut of the work would lose."""

import random

import numpy as np
import pytest

pytest.importorskip("quillmark.llm")
from quillmark.llm import embedding_dedup, line_dedup, secrets  # noqa: E402


def every_shingle(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def least_lines(texts, places):
    """The first place of each component of similar lines, by comparing all pairs."""
    sets, root = [every_shingle(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    by_size = sorted(range(len(texts)), key=lambda i: len(sets[i]))
    for x, i in enumerate(by_size):
        for j in by_size[x + 1 :]:
            if 5 * len(sets[i]) < 4 * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i in range(len(texts)):
        best[top(i)] = min(best.get(top(i), places[i]), places[i])
    return [best[top(i)] for i in range(len(texts))]


def test_line_shingles_are_at_every_position():
    lines = ["one shingle", "short", "a word of averagelength and averyveryverylongwordindeed", "漢字" * 9]
    value, first = line_dedup.line_shingles(lines)
    assert np.diff(first).tolist() == [len(every_shingle(x)) for x in lines]


def test_lines_of_documents_equal_brute_force_at_every_position(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    first = {}
    for r in source.orderBy("doc_id").collect():
        for k, raw in enumerate((r.text or "").split("\n")):
            line = " ".join(raw.lower().split())
            if line:
                first.setdefault(line, []).append((r.doc_id, k))
    texts = list(first)
    best = least_lines(texts, [first[t][0] for t in texts])
    want = {p for t, b in zip(texts, best, strict=True) for p in first[t] if p != b}
    got = {(r.doc_id, k) for r in line_dedup.dedup(source).collect() for k in r.removed}
    assert got == want


def test_lines_of_a_large_band_equal_brute_force_at_every_position(spark):
    rng, texts = random.Random(5), []
    for group in range(3):
        own = [f"w{i}" for i in range(20)] + [f"g{group}x{i}" for i in range(10)]
        for i in range(12):
            at = rng.sample(range(20, 30), i % 3)
            texts.append(" ".join(f"n{i}y{k}" if k in at else w for k, w in enumerate(own)))
    got = line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in got.where("n_removed = 0").collect()} == set(least_lines(texts, list(range(len(texts)))))


def test_secret_sample_has_its_size_whatever_the_copies(spark, monkeypatch):
    monkeypatch.setattr(secrets, "train", lambda texts: texts)
    docs = spark.range(60000).selectExpr("id AS doc_id", "concat('text ', id % 600) AS text")
    drawn = secrets.fit(docs)
    assert len(drawn) == len(set(drawn)) == 400
    assert secrets.fit(docs.limit(0)) == []


def test_secret_training_reads_the_rest_of_long_lines():
    model = secrets.train([" ".join(["plain"] * 600 + ["zebra"] + ["plain"] * 9)] * 20)
    before = secrets.tokens(["zebra plain"])["f"][1][1]
    assert np.abs(model["w"][1][before]).max() > 0


@pytest.mark.parametrize("rank,stray", [(64, 1536), (8, 0)])
def test_links_beside_a_longer_vector_and_of_low_rank(spark, rank, stray):
    rng = np.random.default_rng(4)
    base, noise = rng.normal(size=(2, 1000, rank))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate([base, 0.935 * base + np.sqrt(1 - 0.935**2) * noise]) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + ([(9999, rng.normal(size=stray).tolist(), 0)] if stray else [])
    r, c = embedding_dedup.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), per_cell=2)
    got = {q.vec_id: q.n_links for q in r.join(c, "node").collect()}
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y @ y.T >= 0.93).sum(1) - 1
    assert sum(abs(got[i] - n) for i, n in enumerate(want)) <= 2 and got.get(9999, 0) == 0


def test_parities_never_exceed_the_difference(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        both = [rng.getrandbits(64) - (1 << 63) for _ in range(i)]
        rows.append((both + [rng.getrandbits(63) for _ in range(i % 7)], both + [rng.getrandbits(63) for _ in range(i % 5)]))
    table = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = table.select("a", "b", *[p.alias(f"a{k}") for k, p in enumerate(line_dedup.parity("a"))], *[p.alias(f"b{k}") for k, p in enumerate(line_dedup.parity("b"))]).collect()
    for r in got:
        flipped = sum(bin((r[f"a{k}"] ^ r[f"b{k}"]) & (2**64 - 1)).count("1") for k in range(line_dedup.PARITY))
        differ = len(set(r.a) ^ set(r.b))
        assert flipped <= differ and flipped % 2 == differ % 2


def test_bands_in_passes_are_those_of_all_columns(spark):
    once = spark.createDataFrame([(i, i // 2, 100 + i % 3, 200 + i) for i in range(12)], "node long, k0 long, k1 long, k2 long")
    names = ["k0", "k1", "k2"]
    rows = [tuple(r) for n in names for r in line_dedup.shared_bands(once, [n]).select("key", "node", "size").collect()]
    assert sorted(rows) == sorted(tuple(r) for r in line_dedup.shared_bands(once, names).select("key", "node", "size").collect()) and len(rows) == 24


def test_marks_pass_over_most_pairs_and_none_that_is_similar(spark):
    rng, texts = random.Random(11), []
    for group in range(4):
        own = [f"g{group}w{rng.randrange(60)}" for _ in range(20 + 40 * group)]
        for i in range(12):
            texts.append(" ".join(f"x{i}y{k}" if rng.random() < 0.03 * (i % 6) else w for k, w in enumerate(own)))
    sets = [every_shingle(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    alike = {(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    marks = line_dedup.marked(spark.createDataFrame(list(enumerate(texts)), "node long, line string"))
    rows = {r.node: r for r in marks.collect()}
    assert [rows[i].n for i in range(len(texts))] == [len(s) for s in sets]
    for i, j in pairs:
        assert sum(bin((rows[i][f"p{k}"] ^ rows[j][f"p{k}"]) & (2**64 - 1)).count("1") for k in range(line_dedup.WORDS)) <= len(sets[i] ^ sets[j])
    left = line_dedup.sieved(marks, spark.createDataFrame([(i, j, i, j) for i, j in pairs], "a long, b long, src long, dst long"), 4, 5)
    left = {(r.a, r.b) for r in left.collect()}
    assert alike <= left and len(left - alike) < len(pairs) / 20 and len(alike) > 20


def test_only_pairs_that_may_be_similar_are_verified(spark, monkeypatch):
    rng, texts, given = random.Random(3), [], []
    for group in range(2):
        own = [f"g{group}w{k}" for k in range(60)]
        for i in range(25):
            at = rng.sample(range(60), 12 if i else 0)
            texts.append(" ".join(f"x{i}y{k}" if k in at else w for k, w in enumerate(own)))
    verify = line_dedup.verify
    monkeypatch.setattr(line_dedup, "verify", lambda lines, pairs, *a: given.append(pairs.count()) or verify(lines, pairs, *a))
    got = line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in got.where("n_removed = 0").collect()} == set(least_lines(texts, list(range(len(texts)))))
    assert sum(given) <= len(texts) / 2

"""Nearest neighbours, spelling variants and vector codes against plain versions."""

import random
import string
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightfield.llm import neighbours, queries, variants, vectorcodes
from tests.conftest import SF, same
from tests.llm import brute

VECTORS = "vec_id long, embedding array<float>, label int, `meta.url` string, side int, v int, id string, mix long, whole string, code int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "u", 1, 2, "x", 3, "w", 9) for i, v, lab in rows], VECTORS)


def odd_rows():
    rnd = random.Random(3)
    make = lambda: [float(np.float32(rnd.gauss(0, 1))) for _ in range(8)]
    same_, rows = make(), []
    rows += [(i, make(), i % 3) for i in range(60)]
    rows += [(100 + i, list(same_), None) for i in range(40)]
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [1.0] * 7 + [None], 1), (203, [1.0] * 7 + [float("nan")], 2), (204, [1.0] * 7 + [float("inf")], 2), (205, [], 2)]
    return rows + [(20, rows[20][1], 2)] * 2


def test_neighbours_of_odd_rows(spark):
    rows = odd_rows()
    df = vectors(spark, [*rows, (None, rows[0][1], 1)]).repartition(3)
    got = sorted(tuple(r) for r in neighbours.near_neighbours(df).collect())
    assert got == brute.neighbours([(i, v) for i, v, _ in rows])
    assert [r[2] for r in got if r[0] == 100][:5] != [] and len([r for r in got if r[0] == 0]) == 20
    few = vectors(spark, rows[:4])
    assert sorted(tuple(r) for r in neighbours.near_neighbours(few).collect()) == brute.neighbours([(i, v) for i, v, _ in rows[:4]])
    assert neighbours.near_neighbours(few.limit(0)).count() == 0 and neighbours.near_neighbours(vectors(spark, [(200, None, 1)])).count() == 0
    assert neighbours.near_neighbours(few.limit(1)).count() == 0


def test_blocks_and_a_held_queue_change_nothing(spark, monkeypatch):
    rows = odd_rows()
    want = brute.neighbours([(i, v) for i, v, _ in rows], 5, 1)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neighbours, "HELD_QUERIES", 3)
    monkeypatch.setattr(neighbours, "TILE", (3, 5))
    assert sorted(tuple(r) for r in neighbours.near_neighbours(vectors(spark, rows), k=5, every=1).collect()) == want


def test_recall_within_a_measured_budget(spark):
    """Clustered points: the budget that finds most neighbours is a small share of the forest, and what it finds is right."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16)) * 3
    points = (centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.3).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.near_neighbours(df, least=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    exact = points.astype(np.float64) @ points.astype(np.float64).T
    np.fill_diagonal(exact, -np.inf)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(exact[q, i] - s) < 1e-9 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(np.argsort(-exact[q])[:20].tolist()))
    assert len(got) == 300 and hits / 6000 >= 0.9


def test_recall_on_the_embeddings(spark):
    """2,000 rows of nearly random directions: recall against brute force over the whole table."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows])
    ids = np.array([r.vec_id for r in rows])
    found = {}
    for r in queries.op11_neighbours(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    share = [len(found[int(q)] & set(ids[np.argsort(-s[i])[:20]].tolist())) / 20 for i, q in enumerate(ids) if q % 20 == 0]
    assert np.mean(share) >= 0.9


def test_priority_queue_takes_near_half_spaces_first():
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(500, 6))
    forest = neighbours.grow(sample, 3, 4, 1)
    leaves = forest.leaves(sample)
    sizes = np.bincount(leaves.ravel(), minlength=48)
    whole, ended = (forest.search(sample[:20], sizes, b) for b in (float("inf"), 100))
    for i, ((order, met), (short, so_far)) in enumerate(zip(whole, ended, strict=True)):
        assert sorted(order) == np.flatnonzero(sizes).tolist() and met[-1] == 1500
        assert set(leaves[i].tolist()) <= set(order[:4])  # its own leaves cost nothing; a point on a median can tie
        assert short == order[: len(short)] and so_far[-1] >= 100 > (so_far[-2] if len(short) > 1 else 0)


def test_queries_against_sql(spark, duck):
    for name in ("op11_neighbours", "op13_vector_codes"):
        ours, theirs = same(queries.QUERIES[name](spark, SF), duck, queries.SQL[name])
        assert ours == theirs and ours


def test_variants_of_the_documents(spark):
    docs = queries.table(spark, SF, "documents")
    want = brute.variants(brute.words([(r.doc_id, r.text) for r in docs.collect()]))
    got = sorted((tuple(r) for r in queries.op12_variants(spark, SF).collect()), key=str)
    assert got == want and sum(r[1] is not None for r in want) > 100


def test_variants_of_odd_rows(spark):
    """Nulls, repeated rows, long runs, ties, chains of forms, a hot signature, and columns with working names."""
    chain = ["house"] * 80 + ["houses"] * 40 + ["housess"] * 20 + ["housesss"] * 10 + ["Housessss"] * 5
    ties = ["planar"] * 8 + ["planat"] * 8 + ["planas"] * 3
    hot = ["".join(p) + "aaaa" for p in product("abcdef", repeat=3)] * 3
    long = ["x" * 30_000] * 3 + ["x" * 30_001] * 6
    texts = [" ".join(chain), " ".join(ties), ",".join(hot), "\n".join(long), None, "", "ÀÖØÞÿ×÷ " * 7, "tiny one"]
    rows = [(i if i % 2 else None, t, "k", 1) for i, t in enumerate(texts)] + [(7, "repeated words repeated", "k", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(3)
    got = sorted((tuple(r) for r in variants.spelling_variants(df).collect()), key=str)
    assert got == brute.variants(brute.words([(d, t) for d, t, _, _ in rows]))
    by = {r[0]: r for r in got}
    assert by["housessss"][2] == "house" and by["planas"][1] == "planar"
    assert variants.spelling_variants(df.limit(0)).count() == 0


def test_words_are_passed_on_when_many(spark, monkeypatch):
    rows = [(i, " ".join(random.Random(i % 5).choices(["alpha", "betas", "gamma", "delta"], k=50))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(variants, "HELD_WORDS", 2)
    assert dict(tuple(r) for r in variants.count_words(df).collect()) == brute.words(rows)


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", min_size=1, max_size=9), st.integers(0, 8), st.sampled_from("abcé"), st.sampled_from(["in", "out", "swap"]), st.integers(0, 10**6))
def test_words_one_edit_apart_share_a_signature(word, at, letter, kind, seed):
    at = min(at, len(word) - 1)
    other = {"in": word[:at] + letter + word[at:], "out": word[:at] + word[at + 1 :], "swap": word[:at] + letter + word[at + 1 :]}[kind]
    dealt = {e: random.Random(f"{seed}{e}").randrange(99) for c in "abcé" for e in (c, f"{c}2", f"{c}3")}
    if other and other != word:
        a, b = variants.signatures(word, dealt, (6, 4)), variants.signatures(other, dealt, (6, 4))
        assert any(x == y and ({r, s} == {0, 1} or r == s == 2) for x, r in a for y, s in b)


def plain_codes(rows, parts, entries, rounds, scale=1024):
    x = np.floor(np.array([v for _, v in rows], dtype=np.float64) * scale).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    cut = np.split(x, parts, axis=1)
    books = [c[order].copy() for c in cut]
    nearest = lambda c, b: ((c[:, None, :] - b[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            index = nearest(cut[p], books[p]).argmin(axis=1)
            for e in set(index.tolist()):
                own = cut[p][index == e]
                books[p][e] = own.sum(axis=0) // len(own)
    far = [nearest(c, b) for c, b in zip(cut, books, strict=True)]
    return ["".join(f"{f[i].argmin():02x}" for f in far) for i in range(len(rows))], sum(f.min(axis=1) for f in far), books


@pytest.mark.parametrize("width", [16, 400, 5000])
def test_codes_of_odd_rows(spark, monkeypatch, width):
    rows = odd_rows()
    monkeypatch.setattr(vectorcodes, "PAIRS", 50)
    monkeypatch.setattr(vectorcodes, "MEMO_CELLS", 20)
    kept = [(i, v, lab) for i, v, lab in [*rows, (None, rows[7][1], None)] if v and all(x is not None and abs(x) < float("inf") for x in v)]
    df = vectors(spark, [*rows, (None, rows[7][1], None)]).repartition(3)
    made, books = vectorcodes.vector_codes(df, entries=16, width=width)
    codes, error, plain = plain_codes([(i, v) for i, v, _ in kept], 4, 16, 4)
    assert all((a == b).all() for a, b in zip(books, plain, strict=True))
    got = sorted(((r.vec_id, r.code, r.error, r["meta.url"], r.side) for r in made.collect()), key=str)
    assert got == sorted(((i, c, int(e), "u", 1) for (i, _, _), c, e in zip(kept, codes, error, strict=True)), key=str)
    sums = {}
    for (_, _, lab), e in zip(kept, error, strict=True):
        sums[lab] = sums.get(lab, 0) + int(e)
    whole = vectorcodes.coded_vectors(df, entries=16, width=width).collect()
    assert {(r.label, r.label_error) for r in whole} == set(sums.items()) and {r.codebooks_sha256 for r in whole} == {vectorcodes.books_digest(plain)}


def test_codes_of_few_rows_and_wrong_ones(spark):
    assert vectorcodes.coded_vectors(vectors(spark, [(1, None, 1)])).count() == 0
    (one,) = vectorcodes.coded_vectors(vectors(spark, [(1, [0.5] * 8, None)])).collect()
    assert (one.code, one.error, one.label_error) == ("00000000", 0, 0)
    with pytest.raises(ValueError, match="cannot be cut"):
        vectorcodes.vector_codes(vectors(spark, [(1, [0.5] * 6, 1)]))
    with pytest.raises(ValueError, match="64 bits"):
        vectorcodes.vector_codes(vectors(spark, [(1, [0.5] * 8, 1), (2, [1e30] * 8, 1)]))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.sampled_from([1, 3, 50, 10_000]), st.integers(0, 10**6))
def test_cells_find_the_nearest(entries, d, width, seed):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-30, 30, (entries, d)), rng.integers(-35, 35, (50, d))
    far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    cells = vectorcodes.Cells(book, width)
    for _ in range(2):  # the second time out of the memo
        index, error = cells.nearest(x)
        assert (index == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()


def test_letters_of_words():
    assert variants.elements("banana") == ["b", "a", "n", "a2", "n2", "a3"] and not set(string.digits) & set("".join(variants.elements("abc")))

"""Shards, lexical search and hard negatives against brute force, with nulls, ties, repeats and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from baleprice.llm import lexical, negatives, sharding

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.random() ** 2 * 90)}" for _ in range(rng.choice([1, 5, 40, 200]))) for _ in range(300)]
    texts += [texts[7]] * 30 + [texts[8].upper(), None, "", " ,;! ", "w1 " * 30_000, "Éa é1 w1,w2;W3", "solo", "solo"]
    rows = [(3 * i - 40, t) for i, t in enumerate(texts)]
    rows += [(None, texts[9]), (None, texts[9]), (2, texts[10]), (2, texts[11]), (2, texts[11])]
    return spark.createDataFrame(rows, DOCS).selectExpr(
        "*", "1 AS shard", "2 AS slot", "'x' AS asked", "'x' AS item", "'x' AS term", "0 AS part", "'y' AS rank").repartition(5)


# -- shards ---------------------------------------------------------------------------------------------------------
def test_shards_are_a_permutation_of_exact_sizes(spark, docs):
    out = sharding.shuffle_into_shards(docs, 8, rows_per_block=13)
    rows = out.collect()
    assert out.columns == [*docs.columns, "shard_", "slot_"]
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard_].append(r.slot_)
    assert sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    assert {tuple(r) for r in rows} == {tuple(r) for r in sharding.shuffle_into_shards(docs, 8, rows_per_block=13).collect()}
    assert {tuple(r) for r in rows} != {tuple(r) for r in sharding.shuffle_into_shards(docs, 8, 43, 13).collect()}


def test_shards_of_few_rows_and_none(spark, tmp_path):
    few = spark.createDataFrame([(1, None), (1, None), (None, "a")], DOCS)
    assert sorted((r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(few, 8).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.shuffle_into_shards(spark.createDataFrame([], DOCS), 8).collect() == []
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.shuffle_into_shards(few, 2), path)
    assert sorted(r["shard"] for r in spark.read.parquet(path).collect()) == [0, 0, 1]


def test_matrix_has_the_margins_and_the_distribution_of_a_permutation():
    counts, sizes = np.array([5, 0, 7, 3, 9]), np.array([6, 6, 6, 6])
    drawn = []
    for seed in range(4000):
        matrix = sharding.CommunicationMatrix(counts, sizes, seed)
        rows = np.array([matrix.row(p) for p in range(5)])
        assert (rows.sum(axis=1) == counts).all() and (rows.sum(axis=0) == sizes).all()
        assert (matrix.row(2) == rows[2]).all()
        drawn.append(rows)
    rng = np.random.default_rng(0)
    owner, block = np.repeat(np.arange(5), counts), np.repeat(np.arange(4), sizes)
    shuffled = np.array([np.histogram2d(owner, rng.permutation(block), (range(6), range(5)))[0] for _ in range(4000)])
    assert np.abs(np.mean(drawn, axis=0) - shuffled.mean(axis=0)).max() < 0.12
    assert np.abs(np.var(drawn, axis=0) - shuffled.var(axis=0)).max() < 0.15


def test_large_hypergeometric_draws_match_numpy():
    rng = np.random.default_rng(1)
    own = np.array([sharding._draw_many(rng, 600, 400, 300) for _ in range(20_000)])
    theirs = rng.hypergeometric(600, 400, 300, 20_000)
    assert abs(own.mean() - theirs.mean()) < 0.25 and abs(own.var() / theirs.var() - 1) < 0.06
    assert [sharding._draw_many(rng, *x) for x in ((0, 9, 4), (9, 0, 4), (5, 5, 10), (5, 5, 0))] == [0, 4, 5, 0]
    big = sharding._draw_many(rng, 3 * 10 ** 10, 2 * 10 ** 10, 10 ** 10)
    assert abs(big - 6 * 10 ** 9) < 10 ** 6


# -- lexical search -------------------------------------------------------------------------------------------------
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def best_by_brute_force(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = {}
    for item, its in asked.items():
        scores = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in its if t in c)
            if score:
                scores.append((-score, d is None, d or 0))
        out[item] = [(None if none else d, -s) for s, none, d in sorted(scores)[:k]]
    return {i: v for i, v in out.items() if v}


def test_search_matches_brute_force(spark, docs, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(100)}" for _ in range(rng.choice([1, 3, 20])))) for i in range(40)]
    items += [(40, None), (41, ""), (42, "nowhere"), (43, "SOLO é1"), (0, "w50 w51"), (None, "w3 w4"), (None, "w5"), (44, "w1")]
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "9 AS doc_id", "'x' AS terms")
    monkeypatch.setattr(lexical, "QUERY_TERMS", 60)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 24)
    got = defaultdict(list)
    for r in lexical.search(docs, queries).collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    expected = best_by_brute_force([(r.doc_id, r.text) for r in docs.collect()], items, 10)
    assert {i: [(d, s) for _, d, s in sorted(v)] for i, v in got.items()} == expected
    assert all(sorted(r for r, _, _ in v) == list(range(1, len(v) + 1)) for v in got.values())


def test_search_of_empty_tables(spark, docs):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.search(none, one).collect() == []
    assert lexical.search(docs, one.limit(0)).collect() == []
    assert lexical.search(none.unionByName(spark.createDataFrame([(1, None), (2, " .")], DOCS)), one).collect() == []


# -- hard negatives -------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 20))
    rows = [(i, [float(x) for x in rng.normal(size=20) * 0.5 + centres[i % 5] * (i % 3)], int(rng.integers(0, 5)))
            for i in range(400)]
    rows += [(400 + i, rows[20 * i][1], i % 5) for i in range(12)] + [(500 + i, [0.0] * 20, i % 2) for i in range(14)]
    rows += [(600, rows[3][1], None), (601, None, 2), (602, [1.0, None] * 10, 2), (603, [float("nan")] * 20, 1),
             (604, [float("inf")] * 20, 1), (None, rows[5][1], 3), (None, rows[6][1], 1), (20, rows[20][1], rows[20][2]),
             (700, [0.5] * 3, 1), (701, [0.4, 0.5, 0.6], 1), (702, [0.2, 0.3, 0.1], 2), (720, [], 1), (721, [], 1), (722, [], 2),
             (740, rows[40][1], 77), (760, [-x for x in rows[0][1]], 78), (761, rows[0][1], 78)]
    return rows


def hard_by_brute_force(rows, n_pos=5, n_neg=10):
    held = [(i, np.floor(256 * np.array(v, np.float32).astype(float)), y) for i, v, y in rows
            if v is not None and y is not None and None not in v and np.isfinite(v).all()]
    order = lambda p: (-p[1], p[0] is None, p[0] or 0)
    out, seen = set(), set()
    for i, x, y in held:
        if i is None or i % 20 or (i, y, x.tobytes()) in seen:
            continue
        seen.add((i, y, x.tobytes()))
        scored = [(j, int(x @ z), y2) for j, z, y2 in held if len(z) == len(x)]
        for p, s, _ in sorted((r for r in scored if r[2] == y and r[0] != i), key=order)[:n_pos]:
            inside = sorted((r for r in scored if r[2] != y and 30 * s <= 100 * r[1] <= 90 * s), key=order)[:n_neg]
            out |= {(i, p, n + 1, j, s, t) for n, (j, t, _) in enumerate(inside)}
    return out


@pytest.mark.parametrize("lots", [1, 4])
def test_hard_negatives_match_brute_force(spark, monkeypatch, lots):
    df = spark.createDataFrame(vectors(), VECTORS).selectExpr("*", "1 AS rank", "'x' AS window", "2 AS anchor", "3 AS x").repartition(4)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 8000 // lots)
    got = negatives.hard_negatives(df, df.vec_id % 20 == 0).collect()
    assert {tuple(r) for r in got} == hard_by_brute_force(vectors())


def test_threshold_join_finds_every_pair():
    rng = np.random.default_rng(2)
    for dim, spread in ((3, 30), (64, 80), (200, 5)):
        q, x = np.floor(rng.normal(size=(40, dim)) * spread), np.floor(rng.normal(size=(300, dim)) * spread * rng.random(dim))
        scores = q @ x.T
        for share in (0.999, 0.9, 0.5, 0.0):
            least = np.quantile(scores, share, axis=1)
            a, v, s = negatives.joined(q, least, x)
            assert {*zip(a.tolist(), v.tolist())} == {*zip(*(i.tolist() for i in np.nonzero(scores >= least[:, None])))}
            assert (s == scores[a, v]).all()


def test_hard_negatives_of_an_empty_table(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(none, none.vec_id % 2 == 0).collect() == []
    few = spark.createDataFrame([(None, None, None), (100, [1.0], 1)], VECTORS)
    assert negatives.hard_negatives(few, few.vec_id % 2 == 0).collect() == []


def test_vectors_too_large_for_exact_scores_raise(spark):
    df = spark.createDataFrame([(1, [1e30, 1.0], 1)], VECTORS)
    with pytest.raises(Exception, match="53 bits"):
        negatives.hard_negatives(df, df.vec_id % 2 == 0).collect()

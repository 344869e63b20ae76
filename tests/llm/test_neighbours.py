from datetime import datetime

import numpy as np

from textquarry.llm.neighbours import nearest_vectors, neighbour_pairs, quantise, tile_survivors

SCHEMA = "vec_id bigint, text_hash string, model string, dim int, vector array<float>, created_at timestamp, access_count int, block int, ids string"


def store(spark, rows):
    t = datetime(2025, 1, 1)
    return spark.createDataFrame([(i, "h", m, d, v, t, 1, 3, "clash") for i, m, d, v in rows], SCHEMA)


def brute(rows, k=5):
    out = set()
    for model in {r[1] for r in rows}:
        mine = sorted({(i, tuple(v)) for i, m, _, v in rows if m == model})
        ids = np.array([i for i, _ in mine])
        x = np.array([v for _, v in mine], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        s = x @ x.T
        np.fill_diagonal(s, -9)
        for a in range(len(ids)):
            out |= {(int(ids[a]), int(ids[b])) for b in np.lexsort((ids, -np.round(s[a], 12)))[:k] if a != b}
    return out


def test_equals_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], 16, (rng.normal(size=16) * rng.uniform(0.01, 30)).astype(np.float32).tolist()) for i in range(400)]
    got = {(r.vec_id, r.other_id) for r in nearest_vectors(store(spark, rows), 5, block_rows=37).collect()}
    assert got == brute(rows)


def test_unusable_vectors_and_repeats(spark):
    nan = float("nan")
    rows = [(1, "a", 2, [1.0, 0.0]), (1, "a", 2, [1.0, 0.0]), (2, "a", 2, [0.9, 0.1]), (3, "a", 2, None), (4, "a", 2, [nan, 1.0]), (5, "a", 2, [0.0, 0.0]),
            (6, "a", 2, [1.0]), (7, "a", 2, [1.0, None]), (8, None, 2, [1.0, 0.0]), (None, "a", 2, [1.0, 0.0]), (9, "b", 2, [1.0, 0.0]), (10, "a", None, [1.0, 0.0])]
    assert [tuple(r) for r in neighbour_pairs(store(spark, rows)).collect()] == [(1, 2)]


def test_a_third_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a", 8, [1.0] * 8) for i in range(100)] + [(100 + i, "a", 8, rng.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    near = nearest_vectors(store(spark, rows), 5, block_rows=64).collect()
    of = {}
    for r in near:
        of.setdefault(r.vec_id, set()).add(r.other_id)
    assert all(len(v) == 5 for v in of.values()) and len(of) == 300
    assert all(of[i] == set(range(5)) for i in range(6, 100))
    assert all(of[i] == set(range(6)) - {i} for i in range(6))
    exact = brute(rows)
    assert all(of[i] == {b for a, b in exact if a == i} for i in range(100, 300))


def test_few_vectors_and_empty(spark):
    assert neighbour_pairs(store(spark, [(1, "a", 2, [1.0, 0.0])])).count() == 0
    assert neighbour_pairs(store(spark, [])).count() == 0


def test_bound_never_loses_a_neighbour():
    rng = np.random.default_rng(8)
    for _ in range(20):
        a = rng.normal(size=(60, 12))
        b = rng.normal(size=(50, 12))
        a, b = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
        kept = {tuple(p) for p in tile_survivors(a, b, 5, False)}
        s = a @ b.T
        assert {(i, j) for i in range(60) for j in np.argsort(-s[i])[:5]} <= kept
        assert {(i, j) for j in range(50) for i in np.argsort(-s[:, j])[:5]} <= kept
        codes, scale, error, _ = quantise(a)
        assert np.allclose(np.linalg.norm(a - codes * scale[:, None], axis=1), error)


def test_blocks_are_not_sent_to_each_tile(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16))
    rows = [(i, "a", 16, (centres[i % 20] + rng.normal(size=16) * 0.2).astype(np.float32).tolist()) for i in range(500)]
    rows += [(1000 + i, "a", 16, rows[7][3]) for i in range(60)]
    df = nearest_vectors(store(spark, rows), 5, block_rows=30)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapGroups" not in plan
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, set()).add(r.other_id)
    want = {}
    for a, b in brute(rows):
        want.setdefault(a, set()).add(b)
    equal = {7, *range(1000, 1060)}
    assert all(got[i] == want[i] for i in want if i not in equal) and all(len(got[i]) == 5 and got[i] <= equal for i in equal)

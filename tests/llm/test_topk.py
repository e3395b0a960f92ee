from __future__ import annotations

import math

import numpy as np
import pytest

from lattica.llm import topk

LARGEST = 2**63 - 1


def brute(rows, k, every):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            near = sorted(((max(-LARGEST, min(LARGEST, -sum(a * b for a, b in zip(q, c, strict=True)))), j) for j, c in good if j != i and len(c) == len(q)))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


@pytest.fixture
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 40).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(400, None), (401, [0.1, None]), (402, [float("nan")] * 40), (403, [float("inf")] + [0.0] * 39), (404, []), (440, []), (None, [0.5] * 40), (420, [0.5, 0.25]), (421, [1.0, -1.0]), (460, [3e4, -5e5]), (461, [7e6, 1e5])]
    rows += [(480, [3e9, 1.0, 0.5]), (481, [3e9, 2.0, 0.25]), (482, [-3e9, 0.0, 1.0]), (483, [0.5, 0.5, 0.5]), (484, [1e16, -1e16, 2.0])]  # beyond 64 bits
    return rows


@pytest.mark.parametrize(("pack", "queries", "span"), [(4096, 256, 256), (16, 4, 3)])
def test_exact(spark, vectors, monkeypatch, pack, queries, span):
    for name, value in (("PACK", pack), ("LEAST_PACK", min(pack, 64)), ("QUERIES", queries), ("NEAR", min(queries, 64)), ("SPAN", span)):
        monkeypatch.setattr(topk, name, value)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, block int, span int").repartition(5)
    found = sorted(tuple(r) for r in topk.top_k(df).collect())
    assert found == brute(vectors, topk.K, topk.EVERY)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pruning_keeps_the_best():
    rng = np.random.default_rng(4)
    m = rng.integers(-64, 64, (64, 3000))
    m[:, ::3] //= 30
    ids = np.arange(3000)
    best = topk.Best(ids[:20], m[:, :20], 5)
    for i in range(0, 3000, 500):
        best.meet(ids[i : i + 500], m[:, i : i + 500])
    scores = m[:, :20].T @ m
    for q in range(20):
        order = [j for j in np.lexsort((ids, -scores[q])) if j != q][:5]
        assert best.found[q].tolist() == order


def test_repeated_rows_share_a_list(spark):
    """Many rows of one vec_id, as queries and as candidates: the ranking runs over all pairs of rows."""
    rows = [(0, [1.0, 0.5])] * 300 + [(i, [0.1 * i, 1.0]) for i in range(1, 40)] + [(41, [3.0, 3.0])] * 200
    found = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)).collect())
    pairs = sorted((i, -sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(q, c, strict=True)), j) for i, q in rows if i % topk.EVERY == 0 for j, c in rows if j != i)
    want, at = [], {}
    for i, s, j in pairs:
        at[i] = at.get(i, 0) + 1
        if at[i] <= topk.K:
            want.append((i, at[i], j, -s))
    assert found == sorted(want)


def test_copies_of_a_candidate_do_not_grow_with_the_table():
    few, many = topk.layout(50_000, 2_500, 12), topk.layout(250_000, 12_500, 12)
    assert few[0] == many[0] and topk.layout(10**8, 5 * 10**6, 1000)[0] == -(-5 * 10**6 // topk.QUERIES)

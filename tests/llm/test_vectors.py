"""Near-duplicate vectors and exact search against all pairs."""

import numpy as np
import pytest
from helpers import smallest_in_component
from pyspark.sql import functions as F

from cairnql.llm import neardup_vectors, topk


def clusters(seed, n, dim, spread):
    r = np.random.default_rng(seed)
    tops = r.standard_normal((n // 8, dim))
    x = tops[r.integers(0, len(tops), n)] + spread * r.standard_normal((n, dim))
    x[: n // 10] = x[n // 2 : n // 2 + n // 10]  # copies
    return x.astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize(("seed", "dim", "spread"), [(1, 16, 0.15), (2, 64, 0.22), (3, 4, 0.3)])
def test_links_against_all_pairs(spark, seed, dim, spread):
    x = clusters(seed, 600, dim, spread)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = smallest_in_component(range(len(x)), zip(*map(list, np.nonzero(near))))
    got = {r["id"]: (r["n_links"], r["component"]) for r in neardup_vectors.near_duplicates(frame(spark, x), tile=50).collect()}
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(len(x))}


def test_small_windows_miss_few_links(spark, monkeypatch):
    """Windows much smaller than a cluster, over several passes, still find its component."""
    monkeypatch.setattr(neardup_vectors, "MOST", 8)
    monkeypatch.setattr(neardup_vectors, "WINDOW", 8)
    monkeypatch.setattr(neardup_vectors, "BLOCK", 16)
    r = np.random.default_rng(5)
    x = np.concatenate([r.standard_normal(32) + 0.02 * r.standard_normal((200, 32)) for _ in range(3)] + [r.standard_normal((200, 32))])
    out = neardup_vectors.near_duplicates(frame(spark, x)).collect()
    got = {}
    for row in out:
        got.setdefault(row["component"], []).append(row["n_links"])
    large = [v for v in got.values() if len(v) > 1]
    assert sorted(map(len, large)) == [200, 200, 200] and all(n == 199 for v in large for n in v)


def test_no_link_is_lost_in_a_dense_cone(spark, monkeypatch):
    """Vectors with mutual cosines of about 0.9, far more than a window holds, each linked with one other."""
    monkeypatch.setattr(neardup_vectors, "MOST", 8)
    monkeypatch.setattr(neardup_vectors, "WINDOW", 8)
    monkeypatch.setattr(neardup_vectors, "BLOCK", 16)
    r = np.random.default_rng(11)
    x = np.sqrt(0.9) * np.eye(64)[0] + np.sqrt(0.1 / 63) * r.standard_normal((400, 64)) * (np.arange(64) > 0)
    x = np.concatenate([x, x + 0.025 * r.standard_normal(x.shape)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = smallest_in_component(range(len(x)), zip(*map(list, np.nonzero(near))))
    got = {r["id"]: (r["n_links"], r["component"]) for r in neardup_vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), tile=150).collect()}
    assert near.sum() >= 700 and got == {i: (int(near[i].sum()), want[i]) for i in range(len(x))}


def brute_top(x, asked, k):
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    out = []
    for i in asked:
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(len(q)) if j != i)[:k]
        out += [(i, n + 1, j, -t) for n, (t, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [16_384, 7])
def test_search_against_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    x = clusters(9, 300, 8, 0.01)
    x[5:60] = x[4]  # many ties at the k-th place
    got = sorted(tuple(r) for r in topk.top_k(frame(spark, x), F.col("vec_id") % 10 == 0, k=5).collect())
    assert got == brute_top(x, range(0, 300, 10), 5)


def test_search_of_few_and_of_wide_values(spark):
    x = np.array([[1e3, -1e3], [2e3, 1], [-7, 5e4]], np.float32)
    got = sorted(tuple(r) for r in topk.top_k(frame(spark, x), F.lit(True), k=9).collect())
    assert got == brute_top(x, range(3), 9)


def test_a_vector_whose_scores_might_not_fit_takes_no_part(spark):
    x = np.array([[1e15, 0], [1.0, 2.0], [3.0, 1.0], [-2.0, 1.0]])
    got = sorted(tuple(r) for r in topk.top_k(frame(spark, x), F.lit(True), k=2).collect())
    assert got == sorted((q + 1, n, i + 1, s) for q, n, i, s in brute_top(x[1:], range(3), 2) for i in [i])


def test_crowd_just_under_the_threshold(spark):
    """Crowds of vectors that nearly link, with planted pairs that do: few links are lost, and every count fits its component."""
    r = np.random.default_rng(3)
    tops = r.standard_normal((6, 64))
    x = np.concatenate([t / np.linalg.norm(t) + 0.055 * r.standard_normal((500, 64)) for t in tops] + [r.standard_normal((1500, 64))])
    x = np.concatenate([x, x[::9] + 0.02 * np.linalg.norm(x[::9], axis=1, keepdims=True) * r.standard_normal(x[::9].shape)]).astype(np.float32)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r["id"]: r["n_links"] for r in neardup_vectors.near_duplicates(frame(spark, x)).collect()}
    assert near.sum() > 900 and all(got[i] <= near[i].sum() for i in got)
    assert sum(got.values()) >= 0.99 * near.sum()

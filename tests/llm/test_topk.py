"""Exact search against the scores of all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from cohortspark.llm import topk
from cohortspark.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


def plain(rows, every, k):
    """Sorted (query_id, rank, vec_id, score) of (vec_id, vector) rows."""
    real = [(i, [math.floor(256 * v) for v in x]) for i, x in rows
            if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for a, (query, q) in enumerate(real):
        if query is not None and query % every == 0:
            score = lambda x, q=q: max(-2**63, min(2**63 - 1, sum(
                m * n for m, n in zip(q, x, strict=False))))
            found = [(-score(x), i is None, i or 0, i) for b, (i, x) in enumerate(real) if a != b]
            out += [(query, r + 1, i, -s)
                    for r, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(
        [(*r, "a", 1) for r in rows],
        "vec_id long, embedding array<float>, mark string, x int").repartition(3)


def float32(values):
    return [float(np.float32(v)) for v in values]


def edge_rows():
    rng = random.Random(4)
    rows = [(i, float32(rng.gauss(0, 1) for _ in range(10))) for i in range(120)]
    rows += [(i, rows[7][1]) for i in range(200, 240)]  # equal vectors: ties
    rows += [(5, rows[5][1]), (5, rows[5][1]), (10, float32([0.5] * 10))]  # repeated ids and rows
    rows += [(None, rows[5][1]), (300, None), (301, [1.0, None]), (305, [math.nan] * 10),
             (310, [math.inf] + [0.0] * 9), (315, []), (320, [2.0, -1.0]),
             (325, float32(rng.gauss(0, 1) for _ in range(13)))]
    return rows


@pytest.mark.parametrize(("k", "block"), [(5, 32_768), (3, 16), (500, 64)])
def test_edges(spark, k, block):
    rows = edge_rows()
    got = found(topk.top_k(table(spark, rows), every=5, k=k, block=block))
    assert got == plain(rows, 5, k)


def test_huge_components(spark):
    rows = [(i, float32([(-1) ** i * 2.0 ** (30 + i), 3.0, 2.0 ** 50])) for i in range(8)]
    assert found(topk.top_k(table(spark, rows), every=2)) == plain(rows, 2, 5)


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0])]
    assert found(topk.top_k(table(spark, rows))) == []
    assert topk.top_k(table(spark, rows).where("false")).count() == 0


def vectors(x, marks):
    return topk.Vectors(pa.table({
        "vec_id": pa.array(marks, pa.int64()), "mark": pa.array(marks, pa.int64()),
        "x": pa.array(x.tolist(), pa.list_(pa.int64()))}), x.shape[1])


def test_bounds_hold_and_drop_most_of_smooth_vectors(monkeypatch):
    """Slowly changing vectors are told apart by their segments: few pairs are scored."""
    rng = np.random.default_rng(1)
    x = np.floor(40 * np.cumsum(rng.normal(size=(600, 64)), axis=1)).astype(np.int64)
    q, c = vectors(x[:40], list(range(40))), vectors(x, list(range(600)))
    for a, b in zip(q.stats, c.stats, strict=True):
        assert (a @ b.T + 1e-6 >= x[:40] @ x.T).all()
    scored = []
    exact = topk.scores
    monkeypatch.setattr(topk, "TILE", 50)
    monkeypatch.setattr(topk, "scores", lambda *a: scored.append(len(a[2])) or exact(*a))
    best = topk.search(q, c, 5)
    for i in range(40):
        order = sorted((-int(x[i] @ x[j]), j) for j in range(600) if j != i)[:5]
        assert [(-s, int(j)) for s, j in zip(best.score[best.q == i], best.j[best.q == i],
                                             strict=True)] == order
    assert sum(scored) < 40 * 600 / 2


@pytest.mark.parametrize("name", ["op13_topk_search"])
def test_query_matches_sql(spark, name):
    result = compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name])
    assert "problem" not in result and "types" not in result, result

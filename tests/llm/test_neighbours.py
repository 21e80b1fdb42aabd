"""Nearest vectors against comparing all, with odd rows, hot vectors and few rows."""

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from vellumine.llm import neighbours, queries


def brute(rows, k=10, every=100):
    rows = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    out = {}
    for i, v in rows:
        if i % every == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in rows if len(w) == len(v) and (j, w) != (i, v))
            out[i] = near[:k]
    return out


def recall(got, want):
    mine = {}
    for r in got:
        mine.setdefault(r["query_id"], []).append((r["score"], r["vec_id"], r["rank"]))
    hits = 0
    for q, near in want.items():
        own = sorted(mine.pop(q, []), key=lambda x: x[2])
        assert [x[2] for x in own] == list(range(1, len(near) + 1))
        assert [x[:2] for x in own] == sorted(x[:2] for x in own)
        hits += len({x[1] for x in own} & {j for _, j in near})
    assert not mine
    return hits / max(1, sum(map(len, want.values())))


def test_recall_on_the_table(spark):
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = brute(rows)
    got = queries.op12_nearest(spark, str(DATA)).collect()
    assert recall(got, want) >= 0.9
    far = {(q, j): d for q, near in brute(rows, k=len(rows)).items() for d, j in near}
    assert all(r["score"] == pytest.approx(far[r["query_id"], r["vec_id"]], abs=1e-12) for r in got)


def test_recall_with_clusters_and_lengths(spark, monkeypatch):
    """Neighbours that are near, vectors of many lengths, a vector with a third of the rows, small blocks."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 20))
    x = base[rng.integers(0, 40, 2000)] * np.exp(rng.normal(size=(2000, 1)) / 4) + rng.normal(size=(2000, 20)) / 8
    x[::3] = base[0]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    want = brute(rows)
    assert recall(neighbours.nearest(df, F.col("id") % 100 == 0).collect(), want) >= 0.9


def test_more_hashes_a_key_find_as_much(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "SENT", 0)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6))[rng.integers(0, 60, 1500)] + rng.normal(size=(1500, 6)) / 20
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = neighbours.Index(df, "vec_id", "embedding", 10)
    assert index.measured(index.queries(F.col("id") % 100 == 0), 0.97, 1500)[0] > 1
    assert recall(neighbours.nearest(df, F.col("id") % 100 == 0).collect(), brute(rows)) >= 0.9


def test_odd_rows(spark):
    v, inf, nan = [1.0, 2.0, 2.0], float("inf"), float("nan")
    rows = [
        (0, v), (100, v), (100, v), (5, [1.0, 2.0, 2.5]), (200, None), (300, []), (400, [0.0, 0.0, 0.0]), (500, [1.0, None, 2.0]), (600, [inf, 1.0, 1.0]),
        (700, [nan, 1.0, 1.0]), (None, v), (800, [1.0, 2.0]), (9, [-1.0, -2.0, -2.0]), (0, [3.0, 0.0, 0.0]), (7, [-0.0, 0.0, 1.0]), (8, [0.0, 0.0, 1.0]),
    ]
    schema = "vec_id long, embedding array<double>, id int, vec string, query_id int, score int"
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema)
    got = neighbours.nearest(df, F.col("id") % 100 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((round(r["score"], 9), r["vec_id"], r["rank"]))
    assert sorted(by) == [0, 100]
    assert sorted(by[100], key=lambda x: x[2])[:2] == [(0.0, 0, 1), (0.5, 5, 2)]
    assert len(by[100]) == 6 and len(by[0]) == 12  # id 0 has two vectors, each a query of its own
    assert neighbours.nearest(df.where("false"), F.col("id") % 100 == 0).collect() == []
    assert neighbours.nearest(df, F.lit(False)).collect() == []


def test_transform_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(50, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = neighbours.rotated(x, 0, 0)
    assert y.shape == (50, 64) and np.allclose(x @ x.T, y @ y.T)
    assert (neighbours.probes(x, 1, 2, 5)[:, 0] == neighbours.keys(x, 1, 2)).all()

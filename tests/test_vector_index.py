"""The index against a scan of all vectors, what it reads, and what a few cells find."""

import numpy as np
import pytest

from vellumine.operators.vector_index import VectorIndex


def scan(rows, q, k):
    q = np.array(q, float)
    out = []
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, float)
            out.append((-max(0.0, min(1.0, float(x @ q / np.linalg.norm(x) / np.linalg.norm(q)))), i))
    return [i for _, i in sorted(out)[:k]]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(50, 24))
    x = base[rng.integers(0, 50, 5000)] * 3 + rng.normal(size=(5000, 24)) / 2
    x[::4] = base[0]
    rows = [(int(i), [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    return rows, VectorIndex.build(df, "id", "v", str(tmp_path_factory.mktemp("index") / "i")), df


def test_search_equals_scan(clustered):
    rows, index, _ = clustered
    queries = {str(i): rows[i][1] for i in (0, 1, 2, 77, 4999)} | {"far": [1.0] * 24}
    got = {}
    for r in index.search(queries, 50).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"]))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: scan(rows, v, 50) for q, v in queries.items()}


def test_a_search_reads_little(clustered):
    rows, index, _ = clustered
    queries = {"a": rows[77][1]}
    wanted, limit = index.plan(queries, 10)
    read = sum(index.cells[c][0] for c in wanted["a"])
    near = index.candidates(queries, wanted, limit).count()
    assert 10 <= near <= read < 0.1 * len(rows)
    assert "PartitionFilters" in index._read(wanted["a"])._jdf.queryExecution().executedPlan().toString()
    assert len(index.plan({"a": rows[77][1]}, 10, cells=1)[0]["a"]) == 1


def test_recall_within_some_cells(clustered):
    rows, index, _ = clustered
    some = [i for i in range(1, 5000, 257) if i % 4]
    got = index.search({str(i): rows[i][1] for i in some}, 50, cells=12).collect()
    hits = sum(len({r["id"] for r in got if r["query"] == str(i)} & set(scan(rows, rows[i][1], 50))) for i in some)
    assert hits / (50 * len(some)) >= 0.95


def test_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, v array<double>, cell string")
    index = VectorIndex.build(df, "id", "v", str(tmp_path / "i"))
    assert sum(n for n, _ in index.cells.values()) == 4
    got = [(r["id"], round(r["score"], 6)) for r in index.search({"q": [3.0, 0.0]}, 10).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 1.0), (None, 0.995037), (2, 0.0)]
    with pytest.raises(ValueError, match="finite"):
        index.search({"q": [0.0, 0.0]}, 3)
    none = VectorIndex.build(df.where("false"), "id", "v", str(tmp_path / "e"))
    assert none.search({"q": [1.0, 0.0]}, 3).collect() == [] and VectorIndex(spark, str(tmp_path / "i")).search({}, 3).collect() == []

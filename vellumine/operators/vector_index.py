"""An inverted-file index of vectors with product-quantised residuals, searched exactly or within a number of cells.

Unit vectors lie in cells by their nearest centroid. Of what is left of a vector behind its
centroid each slice is coded by one byte; with the coding's error every code bounds the
distance of its vector from below, as a cell's radius does for all of its vectors. A search
reads the nearest cells for a first k-th distance, then the codes of the cells that may hold
nearer vectors, and the vectors of the codes that may be nearer. So its result is that of a
scan, and `cells` limits what it may read where a share of the neighbours is enough.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..storage import Files
from .ranking import top_of_each

#: Rows that centroids and codes are learned from, at most, chosen by a digest of their id.
LEARNED_FROM = 20_000
MOST_CELLS = 1024
#: Rows of a cell that one task writes.
BLOCK = 100_000
_SLACK = 1e-6  # codes and centroids are single precision
#: Queries of one search: their vectors are sent to all tasks.
MOST_QUERIES = 1000


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit vectors of the usable rows: no nulls, finite, not zero, of the first usable row's length."""
    rows = [(i, v) for i, v in enumerate(column.to_pylist()) if v and None not in v]
    dim = next((len(v) for _, v in rows if np.isfinite(v).all() and any(v)), 0)
    rows = [(i, v) for i, v in rows if len(v) == dim and np.isfinite(v).all() and any(v)]
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    x = np.array([v for _, v in rows], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return np.array([i for i, _ in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly chosen distinct rows; an empty cluster keeps its place."""
    x = x.astype(np.float64)
    start = np.unique(x, axis=0)
    centre = start[np.random.default_rng(5).permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([_distances(x[s : s + 4096], centre).argmin(1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)
        count = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        some = count > 0
        centre[some] = total[some] / count[some][:, None]
    return centre


class Model:
    """Centroids of cells and, by slice, of residuals; small, whatever the table."""

    def __init__(self, centre: np.ndarray, books: list[np.ndarray]):
        self.centre, self.books = centre, books
        self.edges = np.cumsum([0, *(b.shape[1] for b in books)])

    @classmethod
    def learn(cls, x: np.ndarray, cells: int, slices: int) -> Model:
        centre = _centroids(x, cells)
        rest = x - centre[_distances(x, centre).argmin(1)]
        edges = np.linspace(0, x.shape[1], min(slices, x.shape[1]) + 1).astype(int)
        return cls(centre, [_centroids(rest[:, a:b], 256) for a, b in zip(edges, edges[1:])])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, distance to its centroid, codes and the codes' error of unit vectors."""
        far = _distances(x, self.centre)
        cell = far.argmin(1)
        rest = x - self.centre[cell]
        codes = np.stack([_distances(rest[:, a:b], book).argmin(1) for a, b, book in zip(self.edges, self.edges[1:], self.books)], axis=1)
        near = self.centre[cell] + np.concatenate([book[codes[:, n]] for n, book in enumerate(self.books)], axis=1)
        return cell, far[np.arange(len(x)), cell], codes.astype(np.uint8), np.sqrt(((x - near) ** 2).sum(1))

    def decoded(self, cell: int, codes: np.ndarray) -> np.ndarray:
        return self.centre[cell] + np.concatenate([book[codes[:, n]] for n, book in enumerate(self.books)], axis=1)

    def dump(self) -> dict:
        pack = lambda a: {"shape": a.shape, "data": base64.b64encode(a.astype("<f8").tobytes()).decode()}
        return {"centre": pack(self.centre), "books": [pack(b) for b in self.books]}

    @classmethod
    def load(cls, held: dict) -> Model:
        unpack = lambda h: np.frombuffer(base64.b64decode(h["data"]), "<f8").reshape(h["shape"])
        return cls(unpack(held["centre"]), [unpack(b) for b in held["books"]])


class VectorIndex:
    """id and vector of every usable row, by cell, in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        held = json.loads(Files(spark, path).read("model.json"))
        self.id_type, self.vector_type = held["id"], held["vector"]
        self.model = Model.load(held) if held["cells"] else None
        self.cells = {int(c): tuple(v) for c, v in held["cells"].items()}  # rows and radius

    @classmethod
    def build(cls, rows: DataFrame, id_col: str, vector_col: str, path: str, cells: int | None = None, slices: int = 16) -> VectorIndex:
        """Indexes the rows whose vector is usable (not null, empty or zero, all components finite).

        cells defaults to the root of the number of rows, MOST_CELLS at most. Vectors of another
        length than the sample's are refused. Rows with a null id or repeated ids are rows like others.
        """
        spark = rows.sparkSession
        given = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
        sample = given.where(F.size("vec") > 0).orderBy(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))).limit(LEARNED_FROM).select("vec").toArrow()
        _, x = _units(sample.column(0))
        kinds = {f.name: f.dataType.simpleString() for f in given.schema}
        held: dict = {"id": kinds["id"], "vector": kinds["vec"], "cells": {}}
        if len(x):
            model = Model.learn(x, cells or min(MOST_CELLS, max(1, int(given.count() ** 0.5))), slices)
            held |= model.dump()

            def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    at, units = _units(b.column(1))
                    if not len(at):
                        continue
                    if units.shape[1] != model.centre.shape[1]:
                        raise ValueError(f"vectors of {units.shape[1]} components among those of {model.centre.shape[1]}")
                    cell, far, codes, error = model.encode(units)
                    own = [c.take(pa.array(at)) for c in b.columns]
                    more = [pa.array(cell.astype(np.int32)), pa.array(far), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
                    yield pa.RecordBatch.from_arrays([*own, *more], names=["id", "vec", "cell", "far", "codes", "error"])

            found = given.mapInArrow(coded, f"id {kinds['id']}, vec {kinds['vec']}, cell int, far double, codes binary, error double")
            # a cell of any size is written by as many tasks as it needs
            counts = {r["cell"]: (r["n"], r["radius"]) for r in found.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
            parts = F.coalesce(F.create_map(*[F.lit(v) for c, (n, _) in counts.items() for v in (c, -(-n // BLOCK))])[F.col("cell")], F.lit(1))
            dealt = found.withColumn("block", F.pmod(F.xxhash64("id", "vec"), parts).cast("int")).repartition("cell", "block").drop("block", "far")
            dealt.write.partitionBy("cell").parquet(f"{path}/cells")
            held["cells"] = {str(c): v for c, v in counts.items()}
        Files(spark, path).publish("model.json", json.dumps(held))
        return cls(spark, path)

    def _read(self, cells: list[int]) -> DataFrame:
        schema = f"id {self.id_type}, vec {self.vector_type}, codes binary, error double, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/cells").where(F.col("cell").isin(sorted(set(cells)) or [-1]))

    def _score(self, found: DataFrame, queries: dict, k: int) -> DataFrame:
        """query, id, score and rank of the k best of the pairs (query, id, vec)."""
        given = self.spark.createDataFrame(list(queries.items()), f"query string, asked {self.vector_type}")
        scored = found.join(F.broadcast(given), "query").select("query", "id", vec.clamped(vec.cosine(F.col("vec"), F.col("asked"))).alias("score"))
        return top_of_each(scored, ["query"], [F.col("score").desc(), F.col("id")], k)

    def plan(self, queries: dict[str, list[float]], k: int, cells: int | None = None) -> tuple[dict[str, list[int]], dict[str, float]]:
        """For each query the cells to read and the distance of its k-th candidate in the nearest ones."""
        names = list(queries)
        _, x = _units(pa.array([list(map(float, queries[n])) for n in names]))
        if len(x) != len(names):
            raise ValueError("a query must be finite, not zero and as long as the others")
        known = np.array(sorted(self.cells))
        far = _distances(x, self.model.centre[known])
        order = far.argsort(axis=1, kind="stable")
        count = np.array([self.cells[c][0] for c in known])
        radius = np.array([self.cells[c][1] for c in known])
        first = {n: known[o[: 1 + int(np.searchsorted(np.cumsum(count[o]), k))]].tolist() for n, o in zip(names, order)}
        first = {n: c if cells is None else c[:cells] for n, c in first.items()}
        kth = {r["query"]: r["score"] for r in self._score(self._pairs(first), queries, k).where(F.col("rank") == k).collect()}
        # a cosine's distance between unit vectors
        limit = {n: float(np.sqrt(max(0.0, 2 - 2 * kth[n]))) + _SLACK if n in kth else 2.0 + _SLACK for n in names}
        wanted = {n: [int(c) for c in known[o] if far[i][np.searchsorted(known, c)] - radius[np.searchsorted(known, c)] <= limit[n] + _SLACK] for i, (n, o) in enumerate(zip(names, order))}
        return {n: c if cells is None else c[:cells] for n, c in wanted.items()}, limit

    def _pairs(self, by_query: dict[str, list[int]]) -> DataFrame:
        asked = self.spark.createDataFrame([(n, c) for n, cs in by_query.items() for c in cs], "query string, __cell int")
        rows = self._read([c for cs in by_query.values() for c in cs])
        return rows.join(F.broadcast(asked), F.col("cell") == F.col("__cell")).drop("__cell")

    def candidates(self, queries: dict[str, list[float]], wanted: dict[str, list[int]], limit: dict[str, float]) -> DataFrame:
        """query, cell and id of the rows whose code doesn't rule them out; vectors are not read."""
        model = self.model
        _, x = _units(pa.array([list(map(float, v)) for v in queries.values()]))
        place = {n: i for i, n in enumerate(queries)}
        by_cell: dict[int, list[str]] = {}
        for n, cs in wanted.items():
            for c in cs:
                by_cell.setdefault(c, []).append(n)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = b.column(0).to_numpy()
                for c in np.unique(cell).tolist():
                    own = np.flatnonzero(cell == c)
                    codes = np.frombuffer(b"".join(b.column(2).take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1)
                    names = by_cell.get(c, [])
                    if not names:
                        continue
                    apart = _distances(x[[place[n] for n in names]], model.decoded(c, codes))
                    bound = apart - b.column(3).to_numpy()[own]
                    q, at = np.nonzero(bound <= np.array([limit[n] for n in names])[:, None] + _SLACK)
                    rows = pa.array(own[at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i] for i in q.tolist()], pa.string()), b.column(0).take(rows), b.column(1).take(rows)], names=["query", "cell", "id"]
                    )

        codes = self._read([c for cs in wanted.values() for c in cs]).select("cell", "id", "codes", "error")
        return codes.mapInArrow(each, f"query string, cell int, id {self.id_type}")

    def search(self, queries: dict[str, list[float]], k: int, cells: int | None = None) -> DataFrame:
        """query, id, score (cosine) and rank of the k rows nearest to each query, ties to the smaller id.

        Exact; with `cells` only so many of a query's cells are read, the nearest first. An empty
        index has no rows. Up to MOST_QUERIES queries at a time.
        """
        if len(queries) > MOST_QUERIES:
            raise ValueError(f"{MOST_QUERIES} queries at a time at most")
        if not self.cells or not queries:
            return self.spark.createDataFrame([], f"query string, id {self.id_type}, score double, rank int")
        wanted, limit = self.plan(queries, k, cells)
        near = self.candidates(queries, wanted, limit).distinct().withColumnsRenamed({"cell": "__cell", "id": "__id"})
        rows = self._read([c for cs in wanted.values() for c in cs]).select("cell", "id", "vec")
        found = rows.join(near, (F.col("cell") == F.col("__cell")) & F.col("id").eqNullSafe(F.col("__id")))
        return self._score(found.select("query", "id", "vec"), queries, k)

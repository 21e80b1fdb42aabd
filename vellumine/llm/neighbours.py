"""Nearest vectors by cross-polytope hashing.

A fast pseudo-rotation (signs and Hadamard transforms, three times) turns a unit vector, and
its hash is the nearest signed axis; a key is one or more such hashes. Each vector lies under
one key a table. A query probes the keys of every table in the order of their cost, which is how
much further their axes are than its own. How many it must probe is measured: on some queries,
chosen by a digest of their id, whose true neighbours are found by comparing all vectors.
Under a key the vectors, in blocks of bounded size, meet the queries that probe it, which pass
by as a stream; distances are exact and only the nearest of a block travel on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_side
from .embedding_dedup import unit_rows, usable

NEAREST = 10
TABLES = 2
SEED = 12
#: Vectors of a key beyond which it is split into blocks.
BLOCK = 8192
#: The measured share of true neighbours found, and the number of queries that it is measured on.
RECALL, MEASURED = 0.97, 192
#: Hashes of a key, at most; and what it costs to send a query, in distances.
MOST_HASHES, SENT = 3, 500


@cache
def _signs(dim: int, table: int, which: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, table, which]).choice([-1.0, 1.0], (3, 1 << max(1, (dim - 1).bit_length())))


def rotated(units: np.ndarray, table: int, which: int) -> np.ndarray:
    """The rows, padded by zeros to a power of two and rotated."""
    signs = _signs(units.shape[1], table, which)
    x = np.zeros((len(units), signs.shape[1]))
    x[:, : units.shape[1]] = units
    for s in signs:
        x *= s
        width = 1
        while width < x.shape[1]:  # Hadamard transform
            pairs = x.reshape(len(x), -1, 2, width)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(x.shape)
            width *= 2
        x /= math.sqrt(x.shape[1])
    return x


def axis_costs(units: np.ndarray, table: int, which: int) -> np.ndarray:
    """(n, axes) how much further each signed axis is than the nearest one, squared; it is zero for that."""
    x = rotated(units, table, which)
    both = np.concatenate([x, -x], axis=1)
    return (both.max(axis=1, keepdims=True) - both) ** 2


def keys(units: np.ndarray, table: int, hashes: int) -> np.ndarray:
    """The key of each row in a table: its nearest axes, as one number."""
    found = np.zeros(len(units), np.int64)
    for which in range(hashes):
        costs = axis_costs(units, table, which)
        found = found * costs.shape[1] + costs.argmin(axis=1)
    return found


def _costs(units: np.ndarray, table: int, hashes: int, best: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their costs for each row: all of them, or the `best` cheapest, cheapest first."""
    n = len(units)
    key, cost = np.zeros((n, 1), np.int64), np.zeros((n, 1))
    for which in range(hashes):
        more = axis_costs(units, table, which)
        axes = more.shape[1]
        cost = (cost[:, :, None] + more[:, None, :]).reshape(n, -1)
        key = (key[:, :, None] * axes + np.arange(axes)).reshape(n, -1)
        if best is not None:
            order = np.argsort(cost, axis=1, kind="stable")[:, :best]
            cost, key = np.take_along_axis(cost, order, 1), np.take_along_axis(key, order, 1)
    return key, cost


def probes(units: np.ndarray, table: int, hashes: int, many: int) -> np.ndarray:
    """(n, many) the keys to probe, cheapest first; all keys if there are fewer."""
    return _costs(units, table, hashes, many)[0]


def nearest_rows(
    queries: np.ndarray, rows: np.ndarray, first_ids: np.ndarray, ids: list[list[int]], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, ids and distances of the k nearest of `rows` to each query, ties to smaller ids.

    rows hold one or more ids (sorted, the least in first_ids). Products of matrices give the
    distances nearly; what may be among the nearest by them is measured exactly.
    """
    at_q, at_x = [], []
    size_q, size_x = (queries * queries).sum(axis=1), (rows * rows).sum(axis=1)
    step = max(1, (1 << 22) // max(1, len(rows)))
    for s in range(0, len(queries), step):
        q = queries[s : s + step]
        d = size_q[s : s + step, None] + size_x - 2 * (q @ rows.T)
        slack = 1e-12 * rows.shape[1] * (size_q[s : s + step, None] + size_x.max())
        if len(rows) > k:
            a, b = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] + slack)
        else:
            a, b = (x.ravel() for x in np.indices(d.shape))
        at_q.append(a + s)
        at_x.append(b)
    q, x = np.concatenate(at_q), np.concatenate(at_x)
    apart = queries[q] - rows[x]
    exact = np.sqrt(np.einsum("nd,nd->n", apart, apart))
    q, x, exact = _first(q, x, exact, first_ids[x], k)
    many = np.array([len(ids[i]) for i in x.tolist()], np.int64)
    all_ids = np.array([i for at in x.tolist() for i in ids[at]], np.int64)
    q, own, exact = _first(np.repeat(q, many), all_ids, np.repeat(exact, many), all_ids, k)
    return q, own, exact


def _first(q: np.ndarray, x: np.ndarray, far: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each q by distance and tie."""
    by = np.lexsort((tie, far, q))
    q, x, far = q[by], x[by], far[by]
    new = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q))))
    use = place < k
    return q[use], x[use], far[use]


def _vectors(column: pa.Array, number: str) -> list[np.ndarray]:
    return [np.frombuffer(v, number) for v in column.to_pylist()]


class Index:
    """The vectors of a table, hashed, and what is needed to probe them."""

    def __init__(self, table: DataFrame, id_col: str, vector_col: str, k: int):
        single = isinstance(getattr(table.schema[vector_col].dataType, "elementType", None), T.FloatType)
        self.number = number = "<f4" if single else "<f8"
        self.k = k
        most = k + 1  # the query's own row is among them

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids: dict[bytes, set[int]] = {}
                for at, rows in usable(b.column(1)):
                    own = b.column(0).take(pa.array(at)).to_pylist()
                    for id_, v in zip(own, rows.astype(number) + 0.0):  # no negative zeros
                        ids.setdefault(v.tobytes(), set()).add(id_)
                lists = [sorted(i)[:most] for i in ids.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["vec", "ids"])

        rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).where("id is not null")
        #: Distinct vectors of each batch with their smallest ids, so that a hot vector is rare.
        self.rows = rows.mapInArrow(packed, "vec binary, ids array<long>")
        self.source = rows

    def queries(self, wanted: Column) -> DataFrame:
        """Distinct (id, vec) of the rows that `wanted`, over `id`, picks."""
        number = self.number

        def usable_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, rows in usable(b.column(1)):
                    vec = [v.tobytes() for v in rows.astype(number) + 0.0]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(vec, pa.binary())], names=["id", "vec"])

        return self.source.where(wanted).mapInArrow(usable_rows, "id long, vec binary").distinct()

    def exact(self, asked: list[bytes]) -> DataFrame:
        """(vec, score, id, near) of the nearest vectors to a few asked ones, by comparing all rows; near is the vector."""
        number, most = self.number, self.k + 1
        width = np.dtype(number).itemsize

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vec, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
                for size in sorted({len(v) for v in vec} & {len(v) for v in asked}):
                    own = [i for i, v in enumerate(vec) if len(v) == size]
                    q = [v for v in asked if len(v) == size]
                    x = np.frombuffer(b"".join(vec[i] for i in own), number).reshape(-1, size // width).astype(np.float64)
                    y = np.frombuffer(b"".join(q), number).reshape(-1, size // width).astype(np.float64)
                    first = np.array([ids[i][0] for i in own])
                    a, at, far = nearest_rows(y, x, first, [ids[i] for i in own], most)
                    where = {i: vec[o] for o in own for i in ids[o]}
                    columns = [pa.array([q[i] for i in a.tolist()], pa.binary()), pa.array(far), pa.array(at)]
                    columns.append(pa.array([where[i] for i in at.tolist()], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=["vec", "score", "id", "near"])

        found = self.rows.mapInArrow(each, "vec binary, score double, id long, near binary")
        return _nearest_of(found, most, "near")

    def measured(self, queries: DataFrame, recall: float, n: int) -> tuple[int, int]:
        """How many hashes a key should have and how many keys of a table a query should probe."""
        some = queries.groupBy("vec").agg(F.min(F.md5(F.col("id").cast("string"))).alias("d")).orderBy("d", "vec").limit(MEASURED)
        asked = [bytes(r["vec"]) for r in some.collect()]
        pairs = [(bytes(r["vec"]), bytes(r["near"])) for r in self.exact(asked).collect()] if asked else []
        pairs = [(a, b) for a, b in pairs if a != b]  # equal vectors share all keys
        best = None
        for hashes in range(1, MOST_HASHES + 1):
            ranks: list[int] = []
            total = 0
            for size in sorted({len(a) for a, _ in pairs}):
                a, b = ([np.frombuffer(p[i], self.number) for p in pairs if len(p[i]) == size] for i in (0, 1))
                a, b = unit_rows(np.stack(a)), unit_rows(np.stack(b))
                total = max(total, (2 * len(_signs(a.shape[1], 0, 0)[0])) ** hashes)
                ranks += np.min([self._ranks(a, b, t, hashes) for t in range(TABLES)], axis=0).tolist()
            need = int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else 1
            total = max(total, 1)
            sent = TABLES * need * max(1.0, n / total / BLOCK)
            cost = TABLES * need * n / total + SENT * sent
            if best is None or cost < best[0]:
                best = cost, hashes, need
            if n / total < BLOCK:
                break  # more keys than that only part what one task handles easily
        return best[1:]

    @staticmethod
    def _ranks(a: np.ndarray, b: np.ndarray, table: int, hashes: int) -> np.ndarray:
        """How many keys a query `a` probes before that of `b`."""
        key = keys(b, table, hashes)
        out = np.empty(len(a), np.int64)
        for i in range(len(a)):
            found, cost = _costs(a[i : i + 1], table, hashes)
            out[i] = (cost[0] < cost[0, key[i]]).sum()
        return out


def _nearest_of(found: DataFrame, most: int, *more: str) -> DataFrame:
    """The `most` nearest ids of each vec, each once; Spark limits every task's rows before it shuffles."""
    order = W.partitionBy("vec").orderBy("score", "id")
    ranked = found.withColumn("__r", F.dense_rank().over(order)).where(F.col("__r") <= most)
    if not more:
        return ranked.select("vec", "score", "id").distinct()
    return ranked.groupBy("vec", "score", "id").agg(*[F.min(c).alias(c) for c in more])


def _met(index: Index, asked: DataFrame, hashes: int, many: int | None) -> DataFrame:
    """(vec, score, id): the nearest that each asked vector (vec) finds under `many` keys of each
    table, or (None) under all keys of one table."""
    number, most = index.number, index.k + 1
    width, tables = np.dtype(number).itemsize, range(TABLES if many else 1)

    def hashed(of, multiple: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vec = b.column(0).to_pylist()
                for size in sorted({len(v) for v in vec}):
                    own = np.array([i for i, v in enumerate(vec) if len(v) == size])
                    step = 64 if multiple else 4096
                    for s in range(0, len(own), step):
                        part = own[s : s + step]
                        units = unit_rows(np.frombuffer(b"".join(vec[i] for i in part), number).reshape(len(part), -1))
                        for t in tables:
                            found = of(units, t)
                            at = np.repeat(part, found.shape[1])
                            columns = [pa.array(np.full(len(at), size)), pa.array(np.full(len(at), t)), pa.array(found.ravel())]
                            yield pa.RecordBatch.from_arrays([*columns, *[c.take(pa.array(at)) for c in b.columns]], names=["size", "t", "key", *b.schema.names])

        return each

    placed = index.rows.mapInArrow(hashed(lambda u, t: keys(u, t, hashes)[:, None], False), "size long, t long, key long, vec binary, ids array<long>")
    all_keys = lambda u: (2 * len(_signs(u.shape[1], 0, 0)[0])) ** hashes
    sent = asked.mapInArrow(hashed(lambda u, t: probes(u, t, hashes, many or all_keys(u)), True), "size long, t long, key long, vec binary")
    place = ["size", "t", "key"]
    blocks = placed.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = small_side(cut(blocks, "neighbour-blocks"))
    rows = placed.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("vec", "ids"), F.col("blocks")).cast("int"))
    # a key without rows has no block, so nothing is sent there
    sent = sent.join(blocks, place).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    none = F.lit(None).cast("array<long>")
    both = rows.select(*place, "block", F.lit(False).alias("asks"), "vec", "ids").unionByName(
        sent.select(*place, "block", F.lit(True).alias("asks"), "vec", none.alias("ids"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key and block, a block's vectors before the queries that pass it."""
        current, vec, ids, first, x = None, [], [], None, None
        for b in batches:
            marks = np.stack([b.column(c).to_numpy() for c in range(4)], axis=1)
            asks = b.column(4).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(axis=1) | (asks[1:] != asks[:-1])))
            for s, e in zip(new.tolist(), [*new[1:].tolist(), b.num_rows]):
                own = b.slice(s, e - s)
                if not asks[s]:
                    if current != (here := tuple(marks[s])):
                        current, vec, ids = here, [], []
                    vec += own.column(5).to_pylist()
                    ids += own.column(6).to_pylist()
                    x = None
                    continue
                if current != tuple(marks[s]):
                    continue
                if x is None:
                    x = np.frombuffer(b"".join(vec), number).reshape(len(vec), -1).astype(np.float64)
                    first = np.array([i[0] for i in ids])
                q = own.column(5).to_pylist()
                y = np.frombuffer(b"".join(q), number).reshape(len(q), marks[s][0] // width).astype(np.float64)
                a, at, far = nearest_rows(y, x, first, ids, most)
                yield pa.RecordBatch.from_arrays([own.column(5).take(pa.array(a)), pa.array(far), pa.array(at)], names=["vec", "score", "id"])

    dealt = both.repartition(*place, "block").sortWithinPartitions(*place, "block", "asks")
    return _nearest_of(dealt.mapInArrow(compare, "vec binary, score double, id long"), most)


def nearest(
    table: DataFrame,
    wanted: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = NEAREST,
    recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that `wanted` picks.

    wanted is a condition over the column `id` (id_col as a number). score is the Euclidean
    distance of the vectors as given, in double precision; ties go to the smaller id. Keys
    hang on directions only, so `recall`, measured for the table's own lengths on MEASURED
    queries, says what is found. A query that finds fewer than k others probes all keys, so it
    gets k rows, or all there are. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows with a null id; vectors of different
    lengths never meet. Rows that repeat id and vector count once; a row with a query's id and
    another vector is another row. Other columns are ignored; an empty table gives no rows.
    The work per query is the measured number of keys: where neighbours are hardly nearer than
    all others it is a share of the table, whatever the hashing.
    """
    index = Index(table, id_col, vector_col, k)
    queries = cut(index.queries(wanted), "neighbour-queries")
    asked = queries.select("vec").distinct()
    n = index.rows.count()
    hashes, many = index.measured(queries, recall, n)
    found = cut(_met(index, asked, hashes, many), "neighbours")
    # those that found too few, in a table that has more
    short = cut(asked.join(found.groupBy("vec").count().where(F.col("count") > k), "vec", "left_anti"), "neighbour-short")
    if not short.isEmpty():
        found = found.join(short, "vec", "left_anti").unionByName(_met(index, short, 1, None))
    own = (F.col("id") == F.col("query_id")) & (F.col("score") == 0)
    pairs = queries.select(F.col("id").alias("query_id"), "vec").join(found, "vec").where(~own)
    rank = F.row_number().over(W.partitionBy("query_id", "vec").orderBy("score", "id"))
    ranked = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")

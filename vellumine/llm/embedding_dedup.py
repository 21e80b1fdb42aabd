"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine, components.

Equal vectors are one class from the start. Each class has TABLES keys of BITS signs. First only
keys and some signs of other tables travel: a class is active under a key if another one there
differs in at most MOST_SIGNS of them. Then the vectors of active classes meet under those keys
in cells of bounded size, where cosines are computed in double precision. A pair is counted
only under the first key it shares, so no list of pairs is shuffled to make it distinct: tasks
send on counts per class and a spanning set of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import cells, in_cells, pairs_in_cells
from .common import cut, small_side
from .components import components, spanning_links

COSINE = 0.95
TABLES = 20
BITS = 14
SEED = 7
#: Classes of a bucket beyond which it is split into cells.
BLOCK = 1024
#: Signs of the WINDOW tables behind a key's own that may differ: seven deviations above what a cosine of 0.95 gives.
WINDOW, MOST_SIGNS = 8, 34


@cache
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, TABLES * BITS))


def signatures(vectors: np.ndarray) -> np.ndarray:
    """(n, TABLES) numbers of BITS sign bits each; equal vectors get equal numbers.

    Products are summed by einsum, whose order of additions doesn't depend on the batch.
    """
    signs = np.einsum("nd,dk->nk", vectors, _planes(vectors.shape[1]), optimize=False) >= 0
    return (signs.reshape(len(vectors), TABLES, BITS) << np.arange(BITS)).sum(axis=2).astype("<u2")


def usable(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length: positions and values of the vectors without nulls, finite and not zero."""
    values = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    starts = np.cumsum(sizes) - sizes
    nulls = np.append(0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False)))
    whole = (sizes > 0) & (nulls[starts + sizes] == nulls[starts])
    flat = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[whole]).tolist():
        at = np.flatnonzero(whole & (sizes == dim))
        rows = flat[starts[at][:, None] + np.arange(dim)]
        top = np.abs(rows).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        yield at[good], rows[good]


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """The rows in doubles and of length one."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def key_rows(classes: np.ndarray, sigs: np.ndarray) -> list[np.ndarray]:
    """key, class, and the signs of the next WINDOW tables in two numbers, for every class and table."""
    wide = sigs.astype(np.int64)
    n, half = len(classes), WINDOW // 2
    tables = np.arange(TABLES)
    words = [
        sum(wide[:, (tables + 1 + first + k) % TABLES] << (BITS * k) for k in range(half)).ravel() for first in (0, half)
    ]
    return [(wide + (tables << BITS)).ravel(), np.repeat(classes, TABLES), *words] if n else [np.zeros(0, np.int64)] * 4


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of `cosine` (0.95 or more) or more, computed in double precision.
    Null, empty and zero vectors and those with null or non-finite components link with nothing,
    nor do vectors of different lengths. A row that repeats an id counts as a vector of its own,
    and rows with a null id get links but no component. Other columns are ignored. Recall of the
    hashing for two different vectors is 1 - (1 - p**14)**20 with p = 1 - angle / pi: 0.994 at
    a cosine of 0.95, 0.99996 at 0.98; copies are always found. The signs compared first lose
    one pair at 0.95 in a thousand millions.
    """
    single = isinstance(getattr(table.schema[vector_col].dataType, "elementType", None), T.FloatType)
    number = "<f4" if single else "<f8"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, sig = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
            for at, rows in usable(b.column(1)):
                vec[at] = [v.tobytes() for v in rows.astype(number)]
                sig[at] = [s.tobytes() for s in signatures(unit_rows(rows))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(vec, pa.binary()), pa.array(sig, pa.binary())], names=["vec_id", "vec", "sigs"]
            )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, TABLES)
            for at in range(0, b.num_rows, 2048):
                part = slice(at, at + 2048)
                columns = key_rows(np.asarray(b.column(0))[part], sigs[part])
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "class", "w1", "w2"])

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in cells(batches, ["key", "i", "j", "side", "class", "w1", "w2"]):
            hit = np.zeros(len(x["key"]), bool)
            for s, t in pairs_in_cells(x):
                far = sum(np.bitwise_count(x[w][s] ^ x[w][t]) for w in ("w1", "w2"))
                near = far <= MOST_SIGNS
                hit[s[near]] = hit[t[near]] = True
            found = [pa.array(x[c][hit]) for c in ("key", "class")]
            yield pa.RecordBatch.from_arrays(found, names=["key", "class"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in cells(batches, ["key", "i", "j", "side", "class", "size", "vec", "sigs"], 20_000):
            sigs = np.frombuffer(b"".join(x["sigs"].to_pylist()), "<u2").reshape(-1, TABLES)
            dims = np.asarray(pc.binary_length(x["vec"].combine_chunks())) // np.dtype(number).itemsize
            ids, size, tab = x["class"], x["size"], x["key"] >> BITS
            links, near = np.zeros(len(ids), np.int64), []
            for dim in np.unique(dims).tolist():
                same = dims == dim
                unit = np.zeros((len(dims), dim))
                unit[same] = unit_rows(np.frombuffer(b"".join(x["vec"].filter(pa.array(same)).to_pylist()), number).reshape(-1, dim))
                for s, t in pairs_in_cells(x, 100_000):
                    use = same[s] & same[t]
                    s, t = s[use], t[use]
                    new = (sigs[s] == sigs[t]).argmax(axis=1) == tab[s]
                    s, t = s[new], t[new]
                    close = np.einsum("nd,nd->n", unit[s], unit[t]) >= cosine
                    s, t = s[close], t[close]
                    np.add.at(links, s, size[t])
                    np.add.at(links, t, size[s])
                    near.append((s, t))
            a, b = spanning_links(*(ids[np.concatenate(p)] for p in zip(*near))) if near else (ids[:0], ids[:0])
            some = np.flatnonzero(links)
            out = [np.concatenate([ids[some], a]), np.concatenate([ids[some], b]), np.concatenate([links[some], 0 * a])]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=["a", "b", "n"])

    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    units = rows.mapInArrow(hashed, "vec_id long, vec binary, sigs binary")
    units = cut(units.withColumn("digest", F.unhex(F.md5("vec"))), "embedding-units")
    classes = units.where("digest is not null").groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.any_value("sigs").alias("sigs")
    )
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()), "embedding-classes")
    signs = classes.select("class", "sigs").mapInArrow(keyed, "key long, class long, w1 long, w2 long")
    met = in_cells(signs, signs.select("key"), "class", 4 * block).mapInArrow(active, "key long, class long")
    met = cut(met.distinct(), "embedding-active")
    mine = met.groupBy("class").agg(F.collect_list("key").alias("keys"))  # at most TABLES
    wanted = cut(classes.join(mine, "class").select("class", "size", "rep", "digest", "keys"), "embedding-wanted")
    # by id too, so that the rows of one hot vector are spread; rows that repeat both are one again by class
    rep, digest = F.col("vec_id").eqNullSafe(F.col("rep")), F.col("digest") == F.col("__digest")
    vectors = units.where("digest is not null").select("vec_id", "vec", "sigs", "digest").join(
        small_side(wanted.withColumnRenamed("digest", "__digest")), rep & digest
    )
    vectors = vectors.groupBy("class").agg(*[F.any_value(c).alias(c) for c in ("size", "vec", "sigs", "keys")])
    dealt = vectors.select("class", "size", "vec", "sigs", F.explode("keys").alias("key"))
    found = cut(in_cells(dealt, met.select("key"), "class", block).mapInArrow(compare, "a long, b long, n long"), "embedding-links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    roots = components(found.where("n = 0"))
    joined = classes.select("rep", "class", "size", "digest").join(counts, "class", "left")
    joined = joined.join(roots.withColumnRenamed("node", "class"), "class", "left")
    joined = cut(joined.withColumn("root", F.coalesce("root", "class")), "embedding-joined")
    smallest = joined.groupBy("root").agg(F.min("rep").alias("component"))
    groups = joined.join(smallest, "root").select(
        F.col("digest").alias("d"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component"
    )
    out = units.select("vec_id", "digest").join(groups, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )

"""SimHash near-dedup with keys from the binary Golay code.

The 64 bits are four segments of 16. Of three or fewer errors at least one segment is free
(pigeonhole), and of the two halves (24 bits) of the other 48 one has at most one error. A
key is the free segment with the codeword index of 23 bits of a half; a half at most two bits
from another shares one of its (one or six) indices with it. So all links meet under a key.
Keys are made of distinct fingerprints only, and large buckets are split into cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import cells, in_cells, pairs_in_cells
from .common import cut
from .components import components, spanning_links
from .golay import near_indices

SEED = 42
MOST_BITS = 3
#: Fingerprints of a bucket beyond which it is split into cells.
BLOCK = 4096
_CHUNK = 1 << 18
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    one, n, total = xxhash.xxh64_intdigest, len(starts), np.zeros((8, 8), np.int64)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        h = np.fromiter((one(joined[s:e], SEED) for s, e in spans), np.uint64)
        for byte, column in enumerate(h.view(np.uint8).reshape(-1, 8).T):
            total[byte] += np.bincount(column, minlength=256) @ _BYTE_BITS
    bits = total.ravel() * 2 > n
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number) of every row; null text is empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, fp long")


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions into fps and keys: every two fingerprints within three bits share a key."""
    f = fps.view(np.uint64)
    rows, keys = [], []
    for seg in range(4):
        free = ((f >> np.uint64(16 * seg)) & np.uint64(0xFFFF)).astype(np.int64)
        rest = np.zeros(len(f), np.uint64)
        for k, other in enumerate(s for s in range(4) if s != seg):
            rest |= ((f >> np.uint64(16 * other)) & np.uint64(0xFFFF)) << np.uint64(16 * k)
        for half in range(2):
            part = ((rest >> np.uint64(24 * half)) & np.uint64(0x7FFFFF)).astype(np.int64)
            index, new = near_indices(part)
            at = np.nonzero(new)
            rows.append(at[0])
            keys.append(((seg * 2 + half) << 28 | free[at[0]] << 12) | index[at])
    return np.concatenate(rows), np.concatenate(keys)


def linked(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between rows (rep, fp) at MOST_BITS or fewer bits, enough to span each group."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, fp = (np.asarray(c) for c in b.columns)
            for at in range(0, len(fp), 4096):
                rows, keys = golay_keys(np.ascontiguousarray(fp[at : at + 4096]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(rep[at + rows]), pa.array(fp[at + rows])], names=["key", "rep", "fp"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in cells(batches, ["key", "i", "j", "side", "rep", "fp"]):
            fp = x["fp"].view(np.uint64)
            near = [(s[m], t[m]) for s, t in pairs_in_cells(x) if (m := np.bitwise_count(fp[s] ^ fp[t]) <= MOST_BITS).any()]
            if near:
                a, b = spanning_links(*(x["rep"][np.concatenate(p)] for p in zip(*near)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = distinct.select("rep", "fp").mapInArrow(spread, "key long, rep long, fp long")
    return in_cells(rows, rows.select("key"), "fp", block).mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id that links of three or fewer bits reach).

    Null and wordless texts have fingerprint zero and are linked like any other. Equal
    fingerprints are one group from the start, so copies never multiply. Rows with a null id
    keep a row but join no group: their component_id is null. Other columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col), "simhash-prints")
    distinct = cut(
        prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct"
    )
    roots = components(linked(distinct))
    groups = distinct.join(roots, distinct["rep"] == roots["node"], "left").select(
        F.col("fp"), F.coalesce("root", "rep").alias("component_id")
    )
    return prints.join(groups, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group (the one with the smallest id); all columns stay.

    Near means as in op2: three-word shingles and MOST_BITS of 64 bits, not a given similarity.
    Rows with a null id stay. Rows that share an id stay or go together.
    """
    groups = near_groups(docs, id_col, text_col)
    gone = groups.where("component_id != doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")

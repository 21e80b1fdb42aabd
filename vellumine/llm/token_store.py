"""Token ids in files of frequency-ranked ids, byte-aligned with separate control bytes.

An id is stored as its rank by frequency in one to four bytes; two control bits an id give
their number, four ids a control byte, control bytes apart from data bytes. Documents lie in
ascending id order. A file holds blocks (rows of Parquet): the documents' ids and lengths,
control bytes, data bytes, and where the block starts among the ids of its part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, scratch_path, small_side
from .tokenizing import byte_encoder

END = 0
#: Ids a block holds, unless one document has more.
BLOCK_IDS = 1 << 18
#: Bytes of text that are cut up at a time.
SLICE_BYTES = 1 << 23
BLOCK = "part int, start_in_part long, n_ids long, docs binary, lengths binary, control binary, data binary"
#: Byte lengths of the four ids of each control byte.
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit numbers."""
    ranks = ranks.astype("<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    widest = int(code.max(initial=0)) + 1
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :widest][np.arange(widest) <= code[:, None]]
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = code
    control = (four.reshape(-1, 4) << (2 * np.arange(4))).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers that pack made these bytes of: lengths come from a table by control byte."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    widest = int(lengths.max(initial=1))
    out = np.zeros((n, widest), np.uint8)
    out[np.arange(widest) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return sum(out[:, k].astype("<u4") << np.uint32(8 * k) for k in range(widest))


def _slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about `most` bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def encode_ids(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (little-endian 16-bit numbers with END last) of every row."""
    end = np.array([END], "<u2").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(tokenizer_path)
        for b in batches:
            for start, stop in _slices(b.column(1)):
                part = b.slice(start, stop - start)
                ids = encoder.encode(part.column(1), end)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, ids binary")


def ranked_ids(ids: DataFrame) -> np.ndarray:
    """Ids by falling frequency, then by number. Bounded by the vocabulary, so it may reach
    the driver and every task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            ids_ = pc.binary_join(pa.ListArray.from_arrays([0, b.num_rows], b.column(0)), b"")
            if b.num_rows:
                total += np.bincount(np.frombuffer(ids_[0].as_buffer(), "<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = np.array([tuple(r) for r in rows.collect()], np.int64).reshape(-1, 2)
    return found[np.lexsort((found[:, 0], -found[:, 1])), 0].astype(np.uint32)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes every whole text and writes `path`/blocks and `path`/ranks.

    Null text is empty; each document ends with id END. Documents with a null id come first;
    those that share an id stand next to each other, in the order of a digest of their ids, so
    reruns agree. An empty table writes no blocks.
    """
    spark = docs.sparkSession
    ids = cut(encode_ids(docs, tokenizer_path, id_col, text_col), "token-ids")
    by_rank = ranked_ids(ids)
    rank = np.zeros(1 << 16, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int | None] = []

        def block() -> pa.RecordBatch:
            n = [len(x) for x in held]
            control, data = pack(np.concatenate(held))
            docs_ = np.array([-1 if d is None else d for d in names], "<i8").tobytes() + np.array([d is None for d in names], np.uint8).tobytes()
            row = [part, start, sum(n), docs_, np.array(n, "<u4").tobytes(), control, data]
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in BLOCK.split(", ")])

        for b in batches:
            for d, v in zip(b.column(0).to_pylist(), b.column(1)):
                held.append(rank[np.frombuffer(v.as_buffer(), "<u2")])
                names.append(d)
                if sum(map(len, held[-1:])) >= BLOCK_IDS or len(held) % 256 == 0 and sum(map(len, held)) >= BLOCK_IDS:
                    yield block()
                    start += sum(map(len, held))
                    held, names = [], []
        if held:
            yield block()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # rows without an id, or with one, may be many: the digest of their ids lets ranges part them
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    in_order = ids.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    in_order.select("doc_id", "ids").mapInArrow(blocks, BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    rows = [(int(r), int(i)) for r, i in enumerate(by_rank)]
    spark.createDataFrame(rows, "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (binary, little-endian 32-bit numbers) of every document in the files."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # bounded by the vocabulary
    ids = np.array([r["id"] for r in ranks], "<u4")
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    offsets = parts.select("part", before.alias("before"))  # a row per partition of the writer

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                n = len(lengths)
                values = ids[unpack(row["control"], row["data"], int(lengths.sum()))]
                ends = np.cumsum(lengths)
                starts = ends - lengths
                null = np.frombuffer(row["docs"], np.uint8)[8 * n :].astype(bool)
                docs = pa.array(np.frombuffer(row["docs"][: 8 * n], "<i8"), mask=null)
                each_ = [values[s:e].tobytes() for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(row["before"] + row["start_in_part"] + starts), pa.array(each_, pa.binary())],
                    names=["doc_id", "start", "ids"],
                )

    joined = blocks.join(small_side(offsets), "part").select("before", "start_in_part", "docs", "lengths", "control", "data")
    return joined.mapInArrow(each, "doc_id long, start long, ids binary")


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens returns."""
    crc = F.crc32("ids")
    return tokens.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), crc.alias("ids_crc32"))


def stored_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the tokens of docs to a new folder and returns what its files hold."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer_path, id_col, text_col)
    return token_digests(read_tokens(docs.sparkSession, path))

"""Texts found by what they contain, through postings of three characters each.

Every position of a text starts a gram of three characters; two closing marks let the last
positions start one too. A text can only contain a term of three or more characters if it has all
grams of the term; one of one or two characters is contained exactly if some gram begins with it,
which is a range of gram numbers.

Texts lie in blocks that close at 4096 rows or four million characters. A posting is a gram, a block
and the rows of the block that have the gram, as gaps of one to three bytes. The postings that a task
makes are a segment sorted by gram, so a search reads the pages of its own grams there. They say how
many of the terms a text of a block may contain at most; texts are in folders of 16 blocks, so only
folders with a chance are read, and what they contain is decided on the texts themselves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..storage import Files, arrow_rows, scratch_path

#: A block closes at this many rows or characters.
BLOCK_ROWS, BLOCK_CHARACTERS = 4096, 1 << 22
#: Blocks of a folder, and the most blocks of a task (as bits of a block's number).
FOLDER_BITS, TASK_BITS = 4, 24
#: Folders that are named in a filter; more are joined.
_FEW = 10_000
#: Bits of a character in a gram's number.
_BITS = 21
#: Characters of which the grams are sorted at once.
_PIECE = 1 << 20
#: Grams of texts (of one text all) that a task holds before it makes postings of them: about 60 bytes each.
_HELD = 1 << 18
#: Texts that a Python worker gets at once.
_ROWS = 256


def grams(text: str) -> np.ndarray:
    """The distinct grams of a text as sorted numbers."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = np.concatenate([codes, np.zeros(2, np.uint32)]).astype(np.int64)
    found = [np.empty(0, np.int64)]
    for at in range(0, len(codes) - 2, _PIECE):
        c = codes[at : at + _PIECE + 2]
        found.append(np.unique(c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:]))
    return found[-1] if len(found) == 2 else np.unique(np.concatenate(found))


def ranges_of(term: str) -> list[tuple[int, int]]:
    """Ranges of gram numbers: a text with the term has a gram of each."""
    codes = [ord(c) for c in term]
    if len(codes) >= 3:
        return [(int(g), int(g)) for g in grams(term) if g & (1 << _BITS) - 1]
    low = sum(c << _BITS * (2 - i) for i, c in enumerate(codes))
    return [(low, low + (1 << _BITS * (3 - len(codes))) - 1)]


def packed(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (sorted from each True of first on) as gaps of seven bits a byte; the bytes and their end by row."""
    gaps = np.diff(rows, prepend=0)
    gaps[first] = rows[first]
    size = 1 + (gaps >= 1 << 7) + (gaps >= 1 << 14)
    cells = np.stack([((gaps >> 7 * i & 127) | ((size > i + 1) << 7)).astype(np.uint8) for i in range(3)], axis=1)
    return cells[np.arange(3) < size[:, None]], np.cumsum(size)


def unpacked(held: bytes) -> np.ndarray:
    cells = np.frombuffer(held, np.uint8).astype(np.int64)
    last = cells < 128
    start = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(cells) else np.empty(0, np.int64)
    place = np.arange(len(cells)) - start[np.cumsum(last) - last] if len(cells) else cells
    return np.cumsum(np.add.reduceat((cells & 127) << 7 * place, start)) if len(cells) else cells


_PLACE = StructType([StructField("block", LongType()), StructField("row", IntegerType())])


@F.pandas_udf(_PLACE)
def _placed(sizes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Block and row of each text of a task, by the texts' lengths in order."""
    block, row, held = TaskContext.get().partitionId() << TASK_BITS, 0, 0
    for series in sizes:
        blocks, rows = np.empty(len(series), np.int64), np.empty(len(series), np.int32)
        for i, size in enumerate(series):
            if row and (row == BLOCK_ROWS or held + size > BLOCK_CHARACTERS):
                block, row, held = block + 1, 0, 0
            blocks[i], rows[i] = block, row
            row, held = row + 1, held + size
        yield pd.DataFrame({"block": blocks, "row": rows})


_POSTINGS = pa.schema([("gram", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("held", pa.binary())])


def _posted(block: int, rows: list[int], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not found:
        return
    keys, of = np.concatenate(found), np.repeat(np.array(rows, np.int64), [len(f) for f in found])
    found.clear()
    order = np.lexsort((of, keys))
    keys, of = keys[order], of[order]
    del order
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    cells, ends = packed(of, first)
    starts = np.flatnonzero(first)
    count = np.diff(np.append(starts, len(keys)))
    offsets = np.concatenate([[0], ends[starts + count - 1]]).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(cells)])
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys[first]), pa.array(np.full(len(starts), block)), pa.array(count.astype(np.int32)), data], schema=_POSTINGS
    )


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows of block, row and text; a block gets several of a gram, if it has many or two tasks read it."""
    block, rows, found, size = None, [], [], 0
    for b in batches:
        for at, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            own = grams(text.as_py())
            if at != block or size + len(own) > _HELD:
                yield from _posted(block, rows, found)
                block, rows, found, size = at, [], [], 0
            rows.append(row)
            found.append(own)
            size += len(own)
    yield from _posted(block, rows, found)


@dataclass(frozen=True)
class Found:
    """What a search for the best read, and its rows."""

    rows: DataFrame
    postings: int
    folders: int


class TermIndex:
    """Rows of an id and a text, written to a folder with their postings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        written = StructType.fromJson(json.loads(Files(spark, path).read("schema.json")))
        self.texts = spark.read.schema(written).parquet(f"{self.path}/texts")
        self.postings = spark.read.parquet(f"{self.path}/postings")

    @classmethod
    def build(cls, items: DataFrame, id_col: str, text: Column, path: str) -> TermIndex:
        """Null texts are empty; ids may be null or repeat, each row is found for itself."""
        spark = items.sparkSession
        rows = items.select(F.col(id_col).alias("__id"), F.coalesce(text, F.lit("")).alias("__text"))
        # only lengths go through Python here; without a fixed value the places would be computed once a column
        placed = rows.withColumn("__place", _placed.asNondeterministic()(F.length("__text")))
        names = ["__id", "__text", F.col("__place.block").alias("__block"), F.col("__place.row").alias("__row")]
        filed = placed.select(*names, F.shiftright("__place.block", FOLDER_BITS).alias("__folder"))
        schema = StructType([StructField(f.name, f.dataType) for f in filed.schema])
        filed.write.partitionBy("__folder").parquet(f"{path}/texts")
        written = spark.read.schema(schema).parquet(f"{path}/texts").select("__block", "__row", "__text")
        posted = written.mapInArrow(_post, "gram long, block long, n int, held binary")
        # a segment for each task, in order of its own: a sort of all postings would shuffle them and make them twice
        with arrow_rows(spark, _ROWS):
            posted.sortWithinPartitions("gram", "block").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
        Files(spark, path).publish("schema.json", schema.json())
        return cls(spark, path)

    def selected(self, terms: list[str]) -> DataFrame:
        """The postings that a search for the terms reads."""
        every = sorted({r for t in terms for r in ranges_of(t)})
        hit = F.lit(False)
        for low, high in every:
            hit = hit | ((F.col("gram") == low) if low == high else F.col("gram").between(low, high))
        return self.postings.where(hit)

    def ceilings(self, terms: list[str]) -> DataFrame:
        """__folder and ceiling (the most of the terms that a text of a block may contain) of blocks that may contain one."""
        wanted = [ranges_of(t) for t in terms]

        def each(group: pd.DataFrame) -> pd.DataFrame:
            keys = group["gram"].to_numpy()
            lists = [unpacked(h) for h in group["held"]]
            ceiling = np.zeros(BLOCK_ROWS, np.int64)
            for ranges in wanted:
                has = np.ones(BLOCK_ROWS, bool)
                for low, high in ranges:
                    one = np.zeros(BLOCK_ROWS, bool)
                    for i in np.flatnonzero((keys >= low) & (keys <= high)):
                        one[lists[i]] = True
                    has &= one
                ceiling += has
            return pd.DataFrame({"__folder": group["block"].iloc[:1].to_numpy() >> FOLDER_BITS, "ceiling": [int(ceiling.max())]})

        found = self.selected(terms).groupBy("block").applyInPandas(each, "__folder long, ceiling int").where("ceiling > 0")
        return found.groupBy("__folder").agg(F.max("ceiling").alias("ceiling"))

    def _hits(self, folders: DataFrame, terms: list[str]) -> DataFrame:
        """id and hits of the texts in some folders that contain a term; the texts are not shuffled."""
        few = [r[0] for r in folders.select("__folder").limit(_FEW + 1).collect()]
        if len(few) <= _FEW:
            texts = self.texts.where(F.col("__folder").isin(few or [-1]))
        else:  # a row for 64 million characters
            texts = self.texts.join(F.broadcast(folders.select("__folder")), "__folder", "left_semi")
        hits = sum((F.contains("__text", F.lit(t)).cast("int") for t in terms), F.lit(0))
        return texts.select(F.col("__id").alias("id"), hits.alias("hits")).where("hits > 0")

    def _kept_ceilings(self, terms: list[str]) -> DataFrame:
        path = scratch_path(self.spark, "ceilings")
        self.ceilings(terms).write.parquet(path)
        return self.spark.read.parquet(path)

    def search(self, terms: list[str]) -> DataFrame:
        """id and score (share of the distinct terms contained) of all rows that contain one; the terms' case counts."""
        terms = _checked(terms)
        if not terms:
            return self.texts.limit(0).select(F.col("__id").alias("id"), F.lit(0.0).alias("score"))
        return self._hits(self._kept_ceilings(terms), terms).select("id", (F.col("hits") / len(terms)).alias("score"))

    def best(self, terms: list[str], k: int) -> Found:
        """The k rows of search with the greatest score, ties to the smaller id.

        Folders are read from the highest ceiling down, each once, until k rows are known to score
        no less than what the ceilings left allow.
        """
        terms = _checked(terms)
        if not terms or k < 1:
            return Found(self.search([]), 0, 0)
        ceilings = self._kept_ceilings(terms)
        sizes = {r["ceiling"]: r["n"] for r in ceilings.groupBy("ceiling").agg(F.count("*").alias("n")).collect()}
        base, read, levels = scratch_path(self.spark, "hits"), 0, []
        for level in sorted(sizes, reverse=True):
            self._hits(ceilings.where(F.col("ceiling") == level), terms).write.parquet(f"{base}/{level}")
            levels.append(f"{base}/{level}")
            read += sizes[level]
            if self.spark.read.parquet(*levels).where(F.col("hits") >= level).limit(k).count() == k:
                break
        schema = f"id {self.texts.schema['__id'].dataType.simpleString()}, hits int"
        hits = self.spark.read.schema(schema).parquet(*levels) if levels else self.spark.createDataFrame([], schema)
        rows = hits.orderBy(F.col("hits").desc(), "id").limit(k).select("id", (F.col("hits") / len(terms)).alias("score"))
        return Found(rows, self.selected(terms).count(), read)


def _checked(terms: list[str]) -> list[str]:
    out = list(dict.fromkeys(terms))
    if any(not t or "\0" in t for t in out):
        raise ValueError("a term has one character or more, none of them NUL")
    return out

"""Sharding by extendible hashing.

Bytes are summed per hash prefix. Starting from one bucket, only buckets over the byte limit
split, on the next bit, until each fits. Buckets of different depths then fill a directory
indexed by as many prefix bits as the deepest has, and a document finds its shard with one
equality join on its prefix, moving ids and sizes but no text.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small_side

#: Bits of the hash; the directory may not grow deeper.
HASH_BITS = 48
LIMIT = 64 << 20
#: Sizes are pre-aggregated this many bits below the depth at which shards would fit on average;
#: buckets that lie deeper still are split from single documents.
SPARE_BITS = 6


def hash_bits(id_: Column) -> Column:
    """The first 48 bits of the MD5 of an id's text (null: as the text 'null')."""
    text = F.coalesce(id_.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(bits: int, col: str = "h", of: int = HASH_BITS) -> Column:
    return F.shiftright(F.col(col), of - bits)


def base_bits(sizes: DataFrame, limit: int) -> int:
    total = sizes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return min(HASH_BITS, SPARE_BITS + max(0, math.ceil(math.log2(max(total, 1) / max(limit, 1)))))


def directory(sizes: DataFrame, limit: int, bits: int) -> DataFrame:
    """Buckets (depth, prefix, bytes) that together hold all of sizes (h, n_bytes).

    A bucket over the limit in which all hashes are one (a large document, or many rows of one
    id) stays as soon as that is seen, since no bit can split it.
    """
    ends = [F.min("h").alias("low"), F.max("h").alias("high")]
    base = sizes.groupBy(_prefix(bits).alias("p")).agg(F.sum("n_bytes").alias("n_bytes"), *ends)
    base = cut(base.withColumnRenamed("p", "h"), "shard-base")
    done, left, width = [], base, bits
    for depth in range(HASH_BITS + 1):
        if depth == bits + 1:
            over = left.select(_prefix(bits, of=width).alias("__h")).distinct()
            left = sizes.join(small_side(over), _prefix(bits) == F.col("__h"), "left_semi")
            left = left.select("h", "n_bytes", F.col("h").alias("low"), F.col("h").alias("high"))
            width = HASH_BITS
        sums = left.groupBy(_prefix(depth, of=width).alias("prefix")).agg(
            F.sum("n_bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        sums = cut(sums.withColumn("depth", F.lit(depth)), "shard-sums")
        whole = (F.col("bytes") <= limit) | (F.col("low") == F.col("high"))
        done.append(sums.where(whole).select("depth", "prefix", "bytes"))
        over = sums.where(~whole).select(F.col("prefix").alias("__p"))
        if over.isEmpty():
            break
        left = left.join(small_side(over), _prefix(depth, of=width) == F.col("__p"), "left_semi")
    return reduce(DataFrame.unionByName, done)


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, depth, prefix, part, shard, shard_bytes.

    n_bytes is the text's UTF-8 length (null: 0). shard names the bucket's prefix bits (`*` at
    depth 0). A bucket over the limit whose rows all have one hash (repeated and null ids) is
    dealt by a second hash, of the rows' numbers, to bins of about the limit. Within a bin rows
    of more than half the limit are parts of their own and the others are chained by a running
    sum into parts of at most the limit. So only a document larger than the limit exceeds it,
    alone in its part, and no task sees more than a bin.
    An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"))
    # the rows' numbers are written, so they stay what they are
    rows = cut(rows.select("*", hash_bits(F.col("doc_id")).alias("h"), F.monotonically_increasing_id().alias("row")), "shard-sizes")
    bits = base_bits(rows, limit)
    buckets = cut(directory(rows, limit, bits), "shard-directory")
    deepest = buckets.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    at_bits = min(deepest, bits)
    shallow = buckets.where(F.col("depth") <= at_bits)
    first = F.expr(f"shiftleft(prefix, {at_bits} - depth)")
    last = F.expr(f"shiftleft(prefix + 1, {at_bits} - depth) - 1")
    entries = shallow.withColumn("entry", F.explode(F.sequence(first, last)))
    placed = rows.join(small_side(entries), _prefix(at_bits) == F.col("entry"), "left").drop("entry")
    if deepest > at_bits:  # buckets below the directory: a few single texts of about the limit
        deep = buckets.where(F.col("depth") > at_bits).select(
            F.col("depth").alias("d"), F.col("prefix").alias("p"), F.col("bytes").alias("b")
        )
        found = placed.where("depth is null").drop("depth", "prefix", "bytes")
        levels = [
            found.join(small_side(deep.where(F.col("d") == n)), _prefix(n) == F.col("p"))
            for n in range(at_bits + 1, deepest + 1)
        ]
        deeper = reduce(DataFrame.unionByName, levels).withColumnsRenamed({"d": "depth", "p": "prefix", "b": "bytes"})
        placed = placed.where("depth is not null").unionByName(deeper)
    over = placed.where(F.col("bytes") > limit)
    over = over.withColumn("bin", F.pmod(F.xxhash64("row"), F.ceil(F.col("bytes") / limit).cast("long")))
    small = F.col("n_bytes") * 2 <= limit
    in_order = W.partitionBy("depth", "prefix", "bin").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(small, F.col("n_bytes"))).over(in_order), F.lit(0))
    chained = F.col("bin") * (1 << 24) + F.floor(before * 2 / limit).cast("long") + 1
    over = over.withColumn("part", F.when(small, chained).otherwise(-1 - F.col("row")))
    over = over.withColumn("bytes", F.sum("n_bytes").over(W.partitionBy("depth", "prefix", "bin", "part"))).drop("bin")
    fits = placed.where(F.col("bytes") <= limit).withColumn("part", F.lit(0).cast("long"))
    label = F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    name = F.when(F.col("part") != 0, F.concat_ws(".", label, F.col("part").cast("string"))).otherwise(label)
    return fits.unionByName(over).select(
        "doc_id", "n_bytes", "depth", "prefix", "part", name.alias("shard"), F.col("bytes").alias("shard_bytes")
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Writes docs as Parquet, one folder `shard=...` and one task's file per shard.

    Rows are matched by id; ids should be unique and not null.
    """
    shards = assign_shards(docs, id_col, text_col, limit).select(F.col("doc_id").alias("__id"), "shard")
    joined = docs.join(shards, docs[id_col] == shards["__id"]).drop("__id")
    joined.repartition("shard").write.partitionBy("shard").parquet(path)

"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

The first scan keeps four numbers a row. Rows whose length, or whose prefix hash within a
length, is alone are settled there: they are neither hashed in full nor shuffled again. The
surviving (length, prefix) keys go into a bitmap of a fixed size, so the second scan hashes
whole texts of survivors where they lie, without shuffling any text. A false positive of the
bitmap costs one hash and cannot change a result, since groups are formed on all three keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut

#: Code points of the normalised text that the prefix hash covers.
PREFIX = 256
#: Slots of the survivor bitmap: 2 MB when broadcast, whatever the input.
SLOTS = 1 << 24


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def _slot(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)) + 1


#: Tests the bit of `slot` in `bits`, the 4 KB bitmap of the slot's bucket (null: not set).
_SLOT_IS_SET = """
    (shiftright(
        cast(conv(hex(substring(bits, cast(bitmap_bit_position(slot) div 8 as int) + 1, 1)), 16, 10) as int),
        cast(bitmap_bit_position(slot) % 8 as int)
    ) & 1) = 1
"""


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, sha256 (binary).

    Two texts are equal when they are identical without `[\\x20\\x09-\\x0D]`. The row with the
    most code points, then the smallest id, is kept. Null text counts as empty. A null id sorts
    after all others. Rows that repeat id and text are counted in group_size each and share
    `kept`. An empty table gives an empty result; other columns are ignored. sha256 is null
    for rows that no other row matches in length and prefix, unless digest_all is set (a
    report column then; groups never use it beyond the survivors).
    """
    norm = normalised(F.col(text_col).cast("string"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_chars"),
        norm.alias("norm"),
    )
    keyed = rows.select(
        "doc_id",
        "n_chars",
        F.length("norm").alias("n_norm"),
        F.xxhash64(F.substring("norm", 1, PREFIX)).alias("head"),
        "norm",
    )
    marks = cut(keyed.drop("norm"), "exact-marks")
    lengths = marks.groupBy("n_norm").agg(F.count("*").alias("n")).where("n > 1").select("n_norm")
    heads = (
        marks.join(lengths, "n_norm", "left_semi")
        .groupBy("n_norm", "head")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )
    bits = (
        heads.select(_slot("n_norm", "head").alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    found = (
        keyed.withColumn("slot", _slot("n_norm", "head"))
        .withColumn("bucket", F.bitmap_bucket_number("slot"))
        .join(F.broadcast(bits), "bucket", "left")  # at most SLOTS / 32768 rows of 4 KB
        .withColumn("survives", F.coalesce(F.expr(_SLOT_IS_SET), F.lit(False)))
    )
    sha = F.unhex(F.sha2("norm", 256))
    hashed = cut(
        found.select(
            "doc_id", "n_chars", "n_norm", "head", "survives",
            (sha if digest_all else F.when(F.col("survives"), sha)).alias("sha256"),
        ),
        "exact-hashed",
    )
    survivors = hashed.where("survives")
    # written, so that the join below has exchanges of its own, whose large partitions can be split
    groups = cut(
        survivors.groupBy("n_norm", "head", "sha256")
        .agg(
            F.count("*").alias("group_size"),
            # bitwise not turns the order of ids round and cannot overflow; null comes last
            F.max_by("doc_id", F.struct(F.col("n_chars"), F.bitwise_not("doc_id"))).alias("keep_id"),
        )
        .where("group_size > 1"),
        "exact-groups",
    )
    in_groups = survivors.join(groups, ["n_norm", "head", "sha256"], "left")
    alone = hashed.where("not survives").withColumns(
        {"group_size": F.lit(1).cast("long"), "keep_id": F.col("doc_id")}
    )
    return in_groups.unionByName(alone).select(
        "doc_id",
        F.when(F.coalesce("group_size", F.lit(1)) > 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.coalesce("group_size", F.lit(1)) > 1, F.col("keep_id").eqNullSafe(F.col("doc_id")))
        .otherwise(F.lit(True))
        .alias("kept"),
        "sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups does not keep; all columns stay as they are.

    Rows are matched by id, so rows that share an id go only if none of them is kept.
    """
    groups = exact_groups(docs, id_col, text_col)
    gone = groups.groupBy("doc_id").agg(F.max("kept").alias("any_kept")).where("not any_kept")
    gone = gone.select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["__gone"]), "left_anti")

"""Facet filters, totals and counts by bitmaps, one for each facet value and block of 32768 rows.

Rows are numbered as they are written. A value's bitmap of a block says which of its rows have the
value; rows without any value of a facet have a bitmap of their own. A filter is an OR over a
facet's values and an AND over facets, block by block; blocks never meet, so nothing grows with
the table but the number of blocks. All of it is the engine's own bitmap aggregates. A bitmap takes
4 KB however few rows it has, so facets should have few values beside the rows of a block.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Bits of a row's number within its block (the bitmap aggregates hold 32768) and of monotonically_increasing_id within a task.
_ROW_BITS, _TASK_BITS = 15, 33
#: Facet names of the table that mean no facet: all rows of a block.
_ALL = ""


@dataclass(frozen=True)
class Choice:
    """Values chosen per facet. In any_of rows without a value pass, in only they fail."""

    any_of: dict[str, list[str]] = field(default_factory=dict)
    only: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if set(self.any_of) & set(self.only):
            raise ValueError("a facet is chosen once")

    @property
    def facets(self) -> list[str]:
        return [*self.any_of, *self.only]


class FacetBitmaps:
    """Rows and the bitmaps of some facets, in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows = spark.read.parquet(f"{self.path}/rows")
        self.bitmaps = spark.read.parquet(f"{self.path}/bitmaps")

    @classmethod
    def build(cls, items: DataFrame, facets: dict[str, Column], path: str) -> FacetBitmaps:
        """Writes items (all columns) and the bitmaps of facets: columns of one value or an array, cast to text.

        Null, an empty array and an array of nulls alone count as no value; a value that an array
        repeats counts once.
        """
        spark, taken = items.sparkSession, {"__block", "__row"} & set(items.columns)
        if taken or _ALL in facets:
            raise ValueError(f"columns {sorted(taken)} are taken" if taken else "a facet has a name")
        id_ = F.monotonically_increasing_id()
        row = id_.bitwiseAND((1 << _ROW_BITS) - 1).cast("int")
        items.select("*", F.shiftright(id_, _ROW_BITS).alias("__block"), row.alias("__row")).write.parquet(f"{path}/rows")
        written = spark.read.parquet(f"{path}/rows")
        entries = [F.struct(F.lit(_ALL).alias("facet"), F.lit(None).cast("array<string>").alias("values"))]
        for name, column in facets.items():
            many = isinstance(written.select(column.alias("c")).schema["c"].dataType, ArrayType)
            held = F.array_distinct(F.filter((column if many else F.array(column)).cast("array<string>"), lambda v: v.isNotNull()))
            entries.append(F.struct(F.lit(name).alias("facet"), F.when(F.size(held) > 0, held).alias("values")))
        each = written.select("__block", "__row", F.inline(F.array(*entries)))
        single = each.select("__block", "__row", "facet", F.explode_outer("values").alias("value"))
        made = single.groupBy("facet", "value", "__block").agg(F.bitmap_construct_agg("__row").alias("bits"))
        made.repartitionByRange("facet", "value", "__block").sortWithinPartitions("facet", "value", "__block").write.parquet(f"{path}/bitmaps")
        return cls(spark, path)

    def _chosen(self, choice: Choice) -> DataFrame:
        """facet, block and bits that pass it, for each chosen facet and for all rows."""
        hit = F.col("facet") == _ALL
        for facets, without in ((choice.any_of, True), (choice.only, False)):
            for name, values in facets.items():
                passes = F.col("value").isin([str(v) for v in values]) if values else F.lit(False)
                hit = hit | ((F.col("facet") == name) & ((passes | F.col("value").isNull()) if without else passes))
        return self.bitmaps.where(hit).groupBy("facet", "__block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def passing(self, choice: Choice) -> DataFrame:
        """block and the bits of the rows that pass all chosen facets; blocks without any are left out."""
        both = self._chosen(choice).groupBy("__block").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"))
        return both.where(F.col("n") == len(choice.facets) + 1).where(F.bitmap_count("bits") > 0).drop("n")

    def totals(self, choice: Choice) -> DataFrame:
        """total (of the choice) and pool_total, without reading a row."""
        passed = self.passing(choice).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("total"))
        pool = self.bitmaps.where(F.col("facet") == _ALL).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("pool_total"))
        return passed.join(pool)  # one row each

    def select(self, choice: Choice) -> DataFrame:
        """The rows that pass."""
        byte = F.conv(F.hex(F.substring("bits", F.shiftright("__row", 3) + 1, F.lit(1))), 16, 10).cast("int")
        joined = self.rows.join(self.passing(choice), "__block")
        bit = F.call_function("getbit", byte, F.col("__row").bitwiseAND(7))
        return joined.where(bit == 1).drop("bits", "__block", "__row")

    def counts(self, choice: Choice, facets: list[str]) -> DataFrame:
        """facet, value and n: rows of each value under the choices of all other facets.

        Rows without a value count under null; values with no row are left out. The bitmaps that
        each facet is counted under are made in one pass over those of the choice.
        """
        chosen = self._chosen(choice)
        under = chosen.select(F.explode(F.array(*map(F.lit, facets))).alias("of"), "*").where(F.col("of") != F.col("facet"))
        needed = F.lit(len(choice.facets) + 1) - F.col("of").isin(choice.facets or [_ALL]).cast("int")
        base = under.groupBy("of", "__block").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("base")).where(F.col("n") == needed)
        own = self.bitmaps.where(F.col("facet").isin(facets))
        met = own.join(base.select(F.col("of").alias("facet"), "__block", "base"), ["facet", "__block"])
        pairs = met.select("facet", "value", "__block", F.explode(F.array("bits", "base")).alias("bits"))
        both = pairs.groupBy("facet", "value", "__block").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
        return both.groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n > 0")

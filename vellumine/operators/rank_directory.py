"""Global positions and deep pages without a global window.

Rows are range-partitioned by the order and sorted within each part. The directory has each
part's number of rows and the number before it, so a row's position is known from its place in
its part, and a page from anywhere reads only the parts that hold its positions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import Files

#: The low bits of monotonically_increasing_id: the row within its partition.
_PLACE = (1 << 33) - 1


class RankDirectory:
    """Rows written in an order, found by position (from 1)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        written = StructType.fromJson(json.loads(Files(spark, path).read("schema.json")))
        self._rows = spark.read.schema(StructType([*written, StructField("__part", IntegerType())])).parquet(f"{self.path}/rows")
        self.columns = [c for c in self._rows.columns if c not in ("__part", "__place")]
        #: Rows of each part and before it: a row a part, so the driver may hold them.
        self.counts = {r["__part"]: r["n"] for r in self._rows.groupBy("__part").agg(F.count("*").alias("n")).collect()}
        self.before: dict[int, int] = {}
        self.total = 0
        for part in sorted(self.counts):
            self.before[part] = self.total
            self.total += self.counts[part]

    @classmethod
    def build(cls, rows: DataFrame, order: list[Column], path: str, parts: int | None = None) -> RankDirectory:
        """Writes rows to path in `parts` parts (as many as shuffle partitions unless given).

        order must tell all rows apart for positions to be the same in every build; rows that tie
        stand together in some order. Rows of one value of the whole order can't be parted.
        """
        n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        names = {"__part", "__place"} & set(rows.columns)
        if names:
            raise ValueError(f"columns {sorted(names)} are taken")
        dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        id_ = F.monotonically_increasing_id()
        placed = dealt.select("*", F.shiftright(id_, 33).cast("int").alias("__part"), id_.bitwiseAND(_PLACE).alias("__place"))
        placed.write.partitionBy("__part").parquet(f"{path}/rows")
        schema = placed.drop("__part").schema.json()
        Files(rows.sparkSession, path).publish("schema.json", schema)
        return cls(rows.sparkSession, path)

    def _in_parts(self, parts: list[int]) -> DataFrame:
        before = F.create_map(*[F.lit(x) for p in parts or [-1] for x in (p, self.before.get(p, 0))])
        own = self._rows.where(F.col("__part").isin(parts or [-1]))
        return own.select(*self.columns, (before[F.col("__part")] + F.col("__place") + 1).cast("long").alias("position"))

    def positions(self) -> DataFrame:
        """All rows with their `position`."""
        return self._in_parts(sorted(self.counts))

    def parts_of(self, first: int, last: int) -> list[int]:
        """The parts that hold positions first to last."""
        return [p for p, n in self.before.items() if n < last and n + self.counts[p] >= first]

    def between(self, first: int, last: int) -> DataFrame:
        """The rows at positions first to last, in order; only parts that hold some are read."""
        return self._in_parts(self.parts_of(first, last)).where(F.col("position").between(first, last)).orderBy("position")

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number` (from 1) of `size` rows."""
        if number < 1 or size < 1:
            raise ValueError("pages and sizes count from 1")
        return self.between((number - 1) * size + 1, number * size)

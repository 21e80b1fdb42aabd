"""Row numbers in the order of files: the place of each row in its own file, without a global sort.

A file that is split gives several runs of rows, one a split; rows before a split are counted, and
each row's place in its split is known from the order in which its task reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns added for the time of numbering.
_FILE, _START, _ID = "__file", "__start", "__id"


def numbered(scan: DataFrame, file: str = "file", number: str = "row_number") -> DataFrame:
    """scan, a DataFrame read from files and nothing else done to it, with each row's file and its number there from 1.

    The table of splits has a row a split. It is computed by a scan of its own, which reads no
    column of the rows where the format allows it.
    """
    taken = {file, number, _FILE, _START, _ID} & set(scan.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are taken")
    meta = [F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_START)]
    rows = scan.select("*", *meta, F.monotonically_increasing_id().alias(_ID))
    splits = rows.groupBy(_FILE, _START).agg(F.min(_ID).alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(_FILE).orderBy(_START)) - F.col("__n")
    offset = splits.select(_FILE, _START, (before - F.col("__first") + 1).alias("__offset"))
    joined = rows.join(offset, [_FILE, _START])
    return joined.select(*scan.columns, F.col(_FILE).alias(file), (F.col(_ID) + F.col("__offset")).alias(number))

"""Readers of pages as table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from .payloads import READERS


@udtf
class EmbeddedValues:
    """embedded_values(TABLE(pages), kind => 'MOKA'): what each page embeds, with the page's other columns.

    The table has a column `html`, and `kind` too unless all pages are of the kind given. Each
    row of the result is a row of the table without `html`, with `ordinal` and `value`. Pages of
    an unknown kind, of none and without html yield nothing; names that the result would hold
    twice are refused, as is an unknown kind.
    """

    def __init__(self) -> None:
        self.kept: list[str] | None = None

    @staticmethod
    def analyze(pages: AnalyzeArgument, kind: AnalyzeArgument = None) -> AnalyzeResult:
        if not pages.isTable:
            raise ValueError("the first argument is a table of pages")
        names = pages.dataType.fieldNames()
        if "html" not in names or not (kind or "kind" in names):
            raise ValueError("the table needs columns html and, if no kind is given, kind")
        if kind is not None and kind.value not in READERS:
            raise ValueError(f"kind is one of {sorted(READERS)}")
        if {"ordinal", "value"} & set(names):
            raise ValueError("the table may not have columns ordinal or value")
        schema = StructType([f for f in pages.dataType.fields if f.name != "html"])
        return AnalyzeResult(schema=schema.add("ordinal", IntegerType()).add("value", StringType()))

    def eval(self, pages: Row, kind: str | None = None) -> Iterator[tuple]:
        find = READERS.get(kind or pages["kind"])
        if find is None or pages["html"] is None:
            return
        if self.kept is None:
            self.kept = [n for n in pages.__fields__ if n != "html"]
        own = tuple(pages[n] for n in self.kept)
        for ordinal, value in enumerate(find(pages["html"])):
            yield (*own, ordinal, value)


def register(spark: SparkSession) -> None:
    """Makes the table functions callable from SQL."""
    spark.udtf.register("embedded_values", EmbeddedValues)

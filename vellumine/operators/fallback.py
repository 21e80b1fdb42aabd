"""Job rows made from the titles in a table's own cells, where a page gave none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact
from ..functions.titles import safe_titles


def table_jobs(rows: DataFrame, cell: str, company: str, record: Column, row_number: Column, url: Column, reasons: Column) -> DataFrame:
    """One row per safe title of a cell: the columns of rows, title, source_job_id, job_url, source_ref and metadata.

    Rows without a company, or whose cell isn't a list of safe titles, yield nothing. The id is
    made of the record (or where it is null the row's number) and the title without case and
    white space, so titles that differ in these only stay one job's. job_url is null unless it is
    a web address. metadata is JSON with the reasons, each once.
    """
    known = rows.where(F.trim(company) != "")
    titles = safe_titles(F.col(cell), F.col(company))
    each = known.select("*", F.explode(titles).alias("title"))
    source = F.coalesce(F.concat(F.lit("record:"), record.cast("string")), F.concat(F.lit("row:"), row_number.cast("string")))
    ref = F.coalesce(F.concat(F.lit("record:"), record.cast("string")), F.concat(F.lit("table-row:"), row_number.cast("string")))
    key = F.left(F.sha2(compact(F.col("title")), 256), F.lit(16))
    facts = F.struct(
        F.lit("TABLE_FALLBACK").alias("collection_mode"), F.array_distinct(reasons).alias("quality_reasons"), url.alias("fallback_source_url"),
        row_number.alias("table_row_number"), F.col(cell).alias("table_job_summary"), F.col("title").alias("table_job_title"),
    )
    return each.select(
        "*", F.concat(F.lit("table-fallback:"), source, F.lit(":"), key).alias("source_job_id"),
        F.when(url.rlike("^https?://"), url).alias("job_url"), ref.alias("source_ref"), F.to_json(facts).alias("metadata"),
    )

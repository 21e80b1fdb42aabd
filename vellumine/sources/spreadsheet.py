"""Positional spreadsheets (CSV, XLSX or in-memory values) as typed rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, links, parsed_date, split_tags, years
from .scan_order import numbered

#: The columns of the sheet by position.
COLUMNS = (
    "updated_at", "company_name", "company_nature", "industry", "job_directions", "locations", "deadline_at",
    "graduation", "education", "batch", "announcement_source", "announcement_url", "apply_url",
    "major_requirement", "has_written_test",
)
#: What a cell holds when it means nothing.
NOTHING = ("/",)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw text columns of all rows with file and row_number (from 1, in the file's order), byte order marks taken off.

    A row of several lines counts once.
    """
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    raw = spark.read.csv(path, schema=schema, header=False, multiLine=True, quote='"', escape='"')
    return numbered(raw).withColumn("updated_at", F.regexp_replace("updated_at", "^﻿", ""))


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Raw text columns of the rows below the heading of each workbook under path.

    Adds file, row_number and apply_hyperlink (the target behind the apply_url cell). sheet:
    its name; None takes the one that was open last. A workbook is read by one task, which
    streams its rows; many workbooks are spread over tasks.
    """
    schema = f"file string, row_number int, {', '.join(f'{c} string' for c in COLUMNS)}, apply_hyperlink string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = pa.schema([(n, pa.int32() if n == "row_number" else pa.string()) for n in names])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1)):
                held: list[dict] = []
                for row in _sheet_rows(content.as_py(), sheet):
                    held.append({"file": file.as_py(), **row})
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held = []
                yield pa.RecordBatch.from_pylist(held, kinds)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, schema)


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _texts(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter() if _local(t) == "t")


def _targets(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relationship targets of a part by id."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in book.namelist():
        return {}
    return {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read(rels))}


def _sheet_part(book: zipfile.ZipFile, sheet: str | None) -> str:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = [e for e in root.iter() if _local(e) == "sheet"]
    active = next((int(e.get("activeTab", 0)) for e in root.iter() if _local(e) == "workbookView"), 0)
    chosen = sheets[active] if sheet is None else next((e for e in sheets if e.get("name") == sheet), None)
    if chosen is None:
        raise ValueError(f"no sheet {sheet!r} in the workbook")
    rid = next(v for k, v in chosen.attrib.items() if k.endswith("}id"))
    target = _targets(book, "xl/workbook.xml")[rid]
    return target[1:] if target.startswith("/") else f"xl/{target}"


def _column(reference: str) -> int:
    number = 0
    for letter in filter(str.isalpha, reference):
        number = number * 26 + ord(letter) - 64
    return number - 1


def _cell_text(cell: ElementTree.Element, shared: list[str], column: str) -> str | None:
    formula, value = (next((e.text for e in cell if _local(e) == n), None) for n in ("f", "v"))
    kind = cell.get("t")
    if formula:
        return f"={formula}"
    if kind == "inlineStr":
        return _texts(cell)
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if column.endswith("_at") and kind in (None, "n"):  # a date is the number of days since 1899-12-30
        return (datetime(1899, 12, 30) + timedelta(days=float(value))).strftime("%Y-%m-%d")
    return value


def _sheet_rows(content: bytes, sheet: str | None) -> Iterator[dict[str, object]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_texts(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if _local(e) == "si"]
        part = _sheet_part(book, sheet)
        targets = _targets(book, part)
        behind = {}  # hyperlinks stand after all rows
        for _, e in ElementTree.iterparse(book.open(part)):
            if _local(e) == "hyperlink":
                rid = next((v for k, v in e.attrib.items() if k.endswith("}id")), None)
                behind[e.get("ref", "").partition(":")[0]] = targets.get(rid)
            elif _local(e) == "row":
                e.clear()
        apply, number = COLUMNS.index("apply_url"), 0
        for _, e in ElementTree.iterparse(book.open(part)):
            if _local(e) != "row":
                continue
            number = int(e.get("r", number + 1))
            row: dict[str, object] = {"row_number": number, "apply_hyperlink": behind.get(f"{chr(65 + apply)}{number}")}
            for at, cell in enumerate(c for c in e if _local(c) == "c"):
                at = _column(cell.get("r")) if cell.get("r") else at
                if at < len(COLUMNS):
                    row[COLUMNS[at]] = _cell_text(cell, shared, COLUMNS[at])
            e.clear()
            if number > 1:
                yield row


def from_values(spark: SparkSession, values: list[tuple]) -> DataFrame:
    width = len(COLUMNS)
    rows = [tuple(None if v is None else str(v) for v in (*r, *[None] * width)[:width]) for r in values]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS))


def typed(raw: DataFrame) -> DataFrame:
    """Typed rows; rows without a company or any link (headings, instructions) go.

    A column apply_hyperlink, if raw has it, adds its target to the links of apply_url.
    """
    behind = [F.col("apply_hyperlink")] if "apply_hyperlink" in raw.columns else []
    cell = {c: blank_to_null(F.col(c), *NOTHING) for c in COLUMNS}
    formats = ("yyyy-MM-dd", "yyyy/MM/dd")
    rows = raw.select(
        parsed_date(cell["updated_at"], *formats).alias("updated_at"),
        *[cell[c].alias(c) for c in ("company_name", "company_nature", "industry", "job_directions")],
        split_tags(cell["locations"]).alias("locations"),
        parsed_date(cell["deadline_at"], *formats).alias("deadline_at"),
        years(cell["graduation"]).alias("graduation_years"),
        *[cell[c].alias(c) for c in ("education", "batch", "announcement_source")],
        F.get(links(cell["announcement_url"]), 0).alias("announcement_url"),
        links(F.concat_ws(" ", cell["apply_url"], *behind)).alias("apply_links"),
        *[cell[c].alias(c) for c in ("major_requirement", "has_written_test")],
    )
    return rows.where(F.col("company_name").isNotNull() & (F.size("apply_links") > 0))

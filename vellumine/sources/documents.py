"""Text of DOCX, TXT and Markdown files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: What a file's main part may unpack to.
MOST_BYTES = 64 << 20


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file, one a line, in document order; table cells are paragraphs too."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if z.getinfo("word/document.xml").file_size > MOST_BYTES:
            raise ValueError("too large")
        xml = z.read("word/document.xml")
    if b"<!DOCTYPE" in xml:
        raise ValueError("a document type is not allowed")
    lines = []
    for p in ElementTree.fromstring(xml).iter(f"{_W}p"):
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
        lines.append("".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in p.iter()))
    return "\n".join(x for x in lines if x.strip())


def plain_text(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("gb18030")


def document_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text and problem (null if read) of every .docx, .txt and .md file below a folder."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple[str, str | None, str | None]] = []
            for name, content in zip(f["path"], f["content"]):
                read = docx_text if name.lower().endswith(".docx") else plain_text
                try:
                    rows.append((name, read(bytes(content)), None))
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((name, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "text", "problem"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,txt,md}")
    return files.load(path).select("path", "content").mapInPandas(each, "path string, text string, problem string")

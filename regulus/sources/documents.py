"""Reading documents, and writing what was made of them.

PDF text comes from the files' text layer where the optional ``pypdf`` is
installed; everything else is Spark's own readers and writers.
"""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regulus.operators.golden import RECORD

def pdf_pages(content: bytes | None) -> list[str]:
    """The text of each page, empty where it has none; no pages for a file that can't be read."""
    try:
        from pypdf import PdfReader

        return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content or b"")).pages]
    except Exception:  # whatever is wrong with a file, the others are read
        return []


def pdf(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text, page_count)`` of the PDF files below a path; pages that have a text are joined by a blank line, all are counted."""
    return pdf_texts(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path))


def pdf_texts(files: DataFrame) -> DataFrame:
    """``files(path, content)`` -> ``(path, text, page_count)``."""

    def read(batches):
        for b in batches:
            pages = [pdf_pages(c) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "text": ["\n\n".join(filter(None, p)) for p in pages], "page_count": [len(p) for p in pages]})

    return files.select("path", "content").mapInPandas(read, "path string, text string, page_count int")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of text files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def golden_tables(spark: SparkSession, path: str) -> DataFrame:
    """``(table_id, table_title, n, rank)`` of golden table files."""
    row = "struct<`임용인원수`:int,`서열명부순위`:int>"
    raw = spark.read.schema(f"tables array<struct<table_id:string,table_title:string,rows:array<{row}>>>").json(path, multiLine=True)
    t = raw.select(F.explode("tables").alias("t")).select("t.table_id", "t.table_title", F.explode("t.rows").alias("r"))
    return t.select("table_id", "table_title", F.col("r.`임용인원수`").alias("n"), F.col("r.`서열명부순위`").alias("rank"))


def golden_files(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Golden records as :func:`write_golden` writes them, a row for each file, typed; other schemas may be given."""
    return spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True)


def write_apart(rows: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """A folder ``key=value`` below a path for each document, which holds its text, whole, in a file."""
    rows.select(F.col(key), F.col(text).alias("value")).write.partitionBy(key).text(path)


def write_markdown(rows: DataFrame, path: str, text: str = "text") -> None:
    """One line-terminated text for each row, those of many documents to a file."""
    rows.select(F.col(text).alias("value")).write.text(path)


def write_chunks(rows: DataFrame, path: str, key: str | None = None) -> None:
    """JSON lines with all fields, nulls too; below a folder for each document where a key is given."""
    out = rows.write.option("ignoreNullFields", "false")
    (out.partitionBy(key) if key else out).json(path)


def write_golden(records: DataFrame, path: str, key: str = "doc_id") -> None:
    """A JSON file for each golden record of :func:`regulus.operators.golden.records`, in a folder of its own."""
    fields = [c for c in records.columns if c != key]
    write_apart(records.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("text")), path, key)

"""The document operators on a stream of arriving files.

Each operator works on documents one by one, so a micro-batch is a table like
any other: within ``foreachBatch`` windows by document are allowed, and a batch
that is run again writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regulus.operators import structure
from regulus.sources import documents


def arriving(spark: SparkSession, path: str, schema: str = "doc_id long, title string, text string", files: int = 100) -> DataFrame:
    """Parquet files of documents as they arrive, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def arriving_texts(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """``(path, text)`` of text files below a folder as they arrive, each whole."""
    raw = spark.readStream.option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def arriving_pdfs(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """``(path, text, page_count)`` of PDF files below a folder as they arrive."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return documents.pdf_texts(raw.option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(path))


def run(docs: DataFrame, out: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = structure.articles, **trigger) -> StreamingQuery:
    """Writes what ``make`` makes of each batch to a folder of its own below ``out``."""

    def each(batch: DataFrame, n: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

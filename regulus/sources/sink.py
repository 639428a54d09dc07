"""A file for each document, written by tasks and put in place as a whole.

A data source for ``df.write``: each task writes its documents into a folder of
its own, and nothing below the path counts until the job commits. Committing
moves one folder for each task, however many documents there are, and then puts
a small file in place that names them; readers go by these files alone. A job
that fails takes its folders away; one whose driver dies leaves a folder that no
reader looks into.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "document_files"
WRITING, PART, LOG = "_writing-", "part-", "_committed"
#: Bytes of a file name that come from a key; longer ones are cut and told apart by a number.
LONGEST = 180
#: Bytes of text that a reader hands over at once, about.
BATCH = 8 << 20


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and where the path is in it."""
    system, root = arrow_fs.FileSystem.from_uri(path)
    return system, root.rstrip("/")


def file_name(key: object) -> str:
    """The key, percent-encoded; of a long key the beginning."""
    key = "" if key is None else str(key)[:LONGEST]
    while len(name := quote(key, safe="").replace("~", "%7E")) > LONGEST:
        key = key[:-1]
    return name


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.key, self.text = options["path"], options.get("key", "doc_id"), options.get("text", "text")
        self.suffix, self.overwrite, self.job = options.get("suffix", ".md"), overwrite, uuid.uuid4().hex
        system, root = opened(self.path)
        system.create_dir(f"{root}/{WRITING}{self.job}", recursive=True)  # by the driver, so that a task that outlives an abort has nowhere to write

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Runs in a task; another attempt of it writes elsewhere."""
        system, root = opened(self.path)
        folder, seen = uuid.uuid4().hex, Counter()
        where = f"{root}/{WRITING}{self.job}/{folder}"
        system.create_dir(where, recursive=False)
        for b in batches:
            for key, text in zip(b.column(self.key).to_pylist(), b.column(self.text).cast(pa.binary())):
                name = file_name(key)
                seen[name] += 1
                again = f"~{seen[name] - 1}" if seen[name] > 1 else ""
                with system.open_output_stream(f"{where}/{name}{again}{self.suffix}") as f:
                    f.write(text.as_buffer() if text.is_valid else b"")
        return Written(folder, seen.total())

    def commit(self, messages: list[Written | None]) -> None:
        """Runs in the driver, once all tasks are done: a move for each task, then the file that makes them count."""
        system, root = opened(self.path)
        told = [m for m in messages if m and m.files]
        before = log_names(system, root)
        parts = []
        for i, m in enumerate(told):
            parts.append(f"{PART}{self.job}-{i:05d}")
            system.move(f"{root}/{WRITING}{self.job}/{m.folder}", f"{root}/{parts[-1]}")
        system.create_dir(f"{root}/{LOG}", recursive=True)
        entry = {"parts": parts, "files": sum(m.files for m in told), "instead": before if self.overwrite else []}
        with system.open_output_stream(f"{root}/{LOG}/.{self.job}") as f:
            f.write(json.dumps(entry).encode())
        system.move(f"{root}/{LOG}/.{self.job}", f"{root}/{LOG}/{self.job}.json")
        gone(system, f"{root}/{WRITING}{self.job}")
        if self.overwrite:
            swept(system, root, before, parts)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        gone(system, f"{root}/{WRITING}{self.job}")


def log_names(system: arrow_fs.FileSystem, root: str) -> list[str]:
    found = system.get_file_info(arrow_fs.FileSelector(f"{root}/{LOG}", allow_not_found=True))
    return sorted(x.base_name for x in found if x.base_name.endswith(".json") and not x.base_name.startswith("."))


def gone(system: arrow_fs.FileSystem, path: str) -> None:
    if system.get_file_info(path).type == arrow_fs.FileType.Directory:
        system.delete_dir(path)


def swept(system: arrow_fs.FileSystem, root: str, old: list[str], keep: list[str]) -> None:
    """Removes commits that were overwritten and their folders."""
    for name in old:
        with system.open_input_stream(f"{root}/{LOG}/{name}") as f:
            parts = json.loads(f.read())["parts"]
        for p in set(parts) - set(keep):
            gone(system, f"{root}/{p}")
        system.delete_file(f"{root}/{LOG}/{name}")


@dataclass
class Part(InputPartition):
    folder: str


class Reader(DataSourceReader):
    """A partition for each committed folder, whose files tasks list and read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", ".md")

    def partitions(self) -> list[Part]:
        system, root = opened(self.path)
        entries = {}
        for name in log_names(system, root):
            with system.open_input_stream(f"{root}/{LOG}/{name}") as f:
                entries[name] = json.loads(f.read())
        instead = {n for e in entries.values() for n in e["instead"]}
        return [Part(p) for name, e in entries.items() if name not in instead for p in e["parts"]] or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        found = system.get_file_info(arrow_fs.FileSelector(f"{root}/{part.folder}")) if part.folder else []
        keys, texts, size = [], [], 0
        for x in sorted((x for x in found if x.base_name.endswith(self.suffix)), key=lambda x: x.base_name):
            with system.open_input_stream(x.path) as f:
                texts.append(f.read().decode())
            keys.append(unquote(x.base_name.removesuffix(self.suffix).partition("~")[0]))
            size += x.size
            if size >= BATCH:
                yield batch(keys, texts)
                keys, texts, size = [], [], 0
        yield batch(keys, texts)


def batch(keys: list[str], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.string())], names=["key", "text"])


class DocumentFiles(DataSource):
    """Options: ``path`` (a URI that driver and executors share), ``key``, ``text``, ``suffix``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key string, text string"

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        options = dict(self.options)
        for c in (options.get("key", "doc_id"), options.get("text", "text")):
            if c not in schema.fieldNames():
                raise ValueError(f"no column {c!r} to write from")
        return Writer(options, overwrite)


def located(path: str) -> str:
    return path if "://" in path else f"file://{path}"


def write(rows: DataFrame, path: str, key: str = "doc_id", text: str = "text", suffix: str = ".md", mode: str = "append") -> None:
    """A file ``<key><suffix>`` for each row below a path, all of them or none.

    Keys are percent-encoded. Rows that share a key, and those without one, get
    files of their own; a null text is an empty file. ``mode`` is ``append`` or
    ``overwrite``; an overwriting takes effect at once, with its commit.
    """
    rows.sparkSession.dataSource.register(DocumentFiles)
    picked = rows.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    picked.write.format(FORMAT).mode(mode).option("path", located(path)).option("key", "key").option("text", "text").option("suffix", suffix).save()


def read(spark: SparkSession, path: str, suffix: str = ".md") -> DataFrame:
    """``(key, text)`` of the committed files with a suffix, empty ones too."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format(FORMAT).option("path", located(path)).option("suffix", suffix).load()


def write_summary(rows: DataFrame, path: str, name: str = "summary") -> None:
    """The rows of a small table, as one JSON file that takes the place of an earlier one."""
    one = rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)), {"ignoreNullFields": "false"}).alias("text"))
    write(one.withColumn("key", F.lit(name)), path, "key", "text", ".json", "overwrite")

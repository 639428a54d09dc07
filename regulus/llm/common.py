"""Helpers that every operator of the subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructType

#: A word is a run of anything but the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names, or, in local mode only, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder: computed once, and not again when an executor is lost."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of :func:`scratch` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def few(batches: Iterable, rows: int = 256) -> Iterator:
    """Arrow batches, which Spark bounds by bytes, some rows at a time: what is made of a row may be larger than it."""
    for b in batches:
        for k in range(0, max(1, len(b)), rows):
            yield b.slice(k, rows)


def whole_text(column: str | Column) -> Column:
    """The text, or the empty one for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def identity(text: Column) -> Column:
    """128 bits that stand for a text where rows meet by it."""
    return F.unhex(F.md5(text))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


#: Tables of keys are broadcast up to so many rows, and bytes of text or digests in all of them.
BROADCAST_KEYS, BROADCAST_BYTES = 1_000_000, 16 << 20


def leaves(kind: DataType, c: Column) -> list[Column]:
    """The texts and byte strings of a column, inside structs as well."""
    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in leaves(f.dataType, c.getField(f.name))]
    return [c] if isinstance(kind, (StringType, BinaryType)) else []


def is_small(keys: DataFrame, most: int = BROADCAST_KEYS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table, which should be written out, may be broadcast: by its rows, and by the bytes of what has no fixed size."""
    of = sum((F.coalesce(F.octet_length(x), F.lit(0)) for f in keys.schema.fields for x in leaves(f.dataType, F.col(f"`{f.name}`"))), F.lit(0))
    n, size = keys.agg(F.count(F.lit(1)), F.sum(of.cast("long"))).first()
    return n <= most and (size or 0) <= most_bytes


def small(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A table of keys, written out and counted: to be broadcast if it is small, else joined by a shuffle."""
    keys = cut(keys)
    return F.broadcast(keys) if is_small(keys, most) else keys


def held(c: Column) -> Column:
    """The column, computed where it stands.

    A filter is otherwise moved below the projections that made its column,
    which writes their expressions out once for each use, in nested ones
    without end. It is not moved below an expression that names the partition.
    """
    return F.when(F.spark_partition_id() >= 0, c)

"""A store of texts by key that is filled as keys are asked for.

Every commit is a folder of Parquet files and a small file that names it, put in
place by one rename to a name that no other commit has. So writers need no lock
and cannot overwrite one another, whatever the file system. A commit also names
those that were there when it began: if of any two commits one knew the other,
no key can be there twice and reading is a plain union; only where two writers
worked at once does reading pick one text of a key.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds for which folders stay after a compaction, for readers that have begun.
GRACE = 3600.0


@dataclass(frozen=True)
class Commit:
    """``folder`` holds the entries, or is empty; ``knew`` are the names of earlier commits, ``instead`` those that it takes the place of."""

    name: str
    folder: str
    at: float
    knew: tuple[str, ...] = field(default=())
    instead: tuple[str, ...] = field(default=())


class TextStore:
    """``(key, text)`` below a path; columns of other names and types with a ``schema`` whose first column is the key."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "cache_key string, text string"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key = spark.createDataFrame([], schema).columns[0]

    def at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def files(self):
        return self.at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[Commit]:
        """The commits that count: those that no other takes the place of."""
        fs, log = self.files(), self.at("log")
        if not fs.exists(log):
            return []
        found = [x.getPath() for x in fs.listStatus(log)]
        texts = self.spark.read.text([p.toString() for p in found if p.getName().endswith(".json")], wholetext=True).collect() if found else []  # one small file for each commit since the last compaction
        all_ = [Commit(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(r[0]).items()}) for r in texts]
        gone = {n for c in all_ for n in c.instead}
        return sorted((c for c in all_ if c.name not in gone), key=lambda c: (len(c.knew), c.name))

    def read(self, commits: list[Commit] | None = None) -> DataFrame:
        """All entries, each key once."""
        commits = self.commits() if commits is None else commits
        folders = [c.folder for c in commits if c.folder]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])
        apart = all(a.name in b.knew or b.name in a.knew for i, a in enumerate(commits) for b in commits[:i])
        if apart:
            return rows
        place = {f: i for i, f in enumerate(folders)}
        order = F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        rest = [c for c in rows.columns if c != self.key]
        return rows.select(self.key, F.struct(*rest).alias("row"), order.alias("n")).groupBy(self.key).agg(F.min_by("row", "n").alias("row")).select(self.key, "row.*")

    def publish(self, folder: str, knew: list[Commit], instead: list[Commit] = ()) -> Commit:
        """Makes a folder count, all at once."""
        one = Commit(f"{len(knew):08d}-{uuid.uuid4().hex}", folder, time.time(), tuple(c.name for c in knew), tuple(c.name for c in instead))
        fs = self.files()
        fs.mkdirs(self.at("log"))
        begun, done = self.at("log", f".{one.name}"), self.at("log", f"{one.name}.json")
        out = fs.create(begun, True)
        try:
            out.write(bytearray(json.dumps(one.__dict__).encode()))
        finally:
            out.close()
        if not fs.rename(begun, done):
            raise OSError(f"can't put {done} in place")
        return one

    def write(self, rows: DataFrame) -> tuple[str, int]:
        """A folder with the rows, and how many there are; none is left for no rows."""
        folder = uuid.uuid4().hex
        where = f"{self.path}/data/{folder}"
        rows.write.parquet(where)
        n = self.spark.read.schema(self.schema).parquet(where).count()  # from the files' footers
        if not n:
            self.files().delete(self.at("data", folder), True)
        return folder, n

    def fill(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> int:
        """Adds what ``make`` makes of the rows of ``wanted`` whose key is not there yet; the number of new entries.

        ``make`` gets one row for each missing key, the least of those that share
        it, and returns the store's columns. Rows without a key are left out.
        Nothing is written if no key is missing, and nothing counts if a task or
        the driver fails.
        """
        known = self.commits()
        rest = [c for c in wanted.columns if c != self.key]
        open_ = wanted.where(F.col(self.key).isNotNull()).join(self.read(known).select(self.key), self.key, "left_anti")
        once = open_.groupBy(self.key).agg(F.min(F.struct(*[F.col(c) for c in rest])).alias("row")).select(self.key, "row.*") if rest else open_.distinct()
        columns = self.spark.createDataFrame([], self.schema).columns
        folder, n = self.write(make(once).select(*columns))
        if n:
            self.publish(folder, known)
        return n

    def rewritten(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``wanted`` with the store's other columns, made where they were missing."""
        self.fill(wanted, make)
        return wanted.join(self.read(), self.key, "left")

    def statistics(self) -> DataFrame:
        """One row: entries, and the bytes of their texts."""
        text = self.spark.createDataFrame([], self.schema).columns[1]
        return self.read().agg(F.count(F.lit(1)).alias("total_cached"), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)).cast("long").alias("cache_size_bytes"))

    def compact(self) -> None:
        """One folder in place of all that are there now; what is added meanwhile stays beside it."""
        known = self.commits()
        if len(known) > 1:
            folder, n = self.write(self.read(known))
            self.publish(folder if n else "", known, known)

    def clear(self) -> None:
        """No entries, until more are added."""
        if known := self.commits():
            self.publish("", known, known)

    def vacuum(self, grace: float = GRACE) -> None:
        """Deletes folders that no commit names and whose last change is older than the grace time, and the commits that were replaced before it."""
        fs, live = self.files(), self.commits()
        folders, old = {c.folder for c in live}, time.time() - grace
        replaced = {n: c for c in live for n in c.instead if c.at < old}
        if fs.exists(self.at("data")):
            for x in fs.listStatus(self.at("data")):
                if x.getPath().getName() not in folders and x.getModificationTime() / 1000 < old:
                    fs.delete(x.getPath(), True)
        for name in replaced:
            fs.delete(self.at("log", f"{name}.json"), False)

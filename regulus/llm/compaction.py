"""Shards that arrivals append, and size-tiered compaction of them.

Arrivals become runs: folders of small immutable Parquet files. Runs of similar
size form a tier; when a tier has enough of them they are merged into one run
of files of a target size. What the store holds is what its newest manifest
lists: a JSON file per version, which names runs and not files, so it has a
few lines for each tier however large the store is; Spark lists the files of a
run in parallel. A manifest is renamed into place once complete, and the rename
fails if the version exists. That needs a file system whose rename is atomic,
as HDFS has; an object store needs a conditional put in the place of
:meth:`Store.publish`. A lost job leaves folders that no manifest lists, which
:meth:`Store.vacuum` removes. The driver handles names and sizes only.

A byte is written again once for each tier it passes, that is a logarithm of
the store's size over that of an arrival.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes to a merged file; runs that make a tier; runs of one merge at most; how far sizes of a tier may be from their mean; below this size all are similar.
TARGET, LEAST_RUNS, MOST_RUNS, SPREAD, SMALL = 128 << 20, 4, 32, 0.5, 8 << 20
ATTEMPTS = 10
#: Seconds for which what a manifest listed stays when it is no longer the newest, for its readers.
GRACE = 86_400.0
#: Open files of a task that writes an arrival for each value of a column.
WRITERS = 64


@dataclass(frozen=True)
class Run:
    """A folder, its files' number and bytes, and how often what it holds was merged."""

    name: str
    files: int
    bytes: int
    level: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: str | None = None
    runs: tuple[Run, ...] = field(default=())

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def parse(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], d["schema"], tuple(Run(r["name"], r["files"], r["bytes"], r["level"]) for r in d["runs"]))


class Conflict(Exception):
    """Another writer has committed what this one would replace."""


class Store:
    def __init__(self, spark: SparkSession, root: str, codec: str = "zstd"):
        self.spark, self.root, self.codec = spark, root.rstrip("/"), codec
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> dict[str, int]:
        """Files of a folder and their bytes."""
        at = self.path(folder)
        return {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def versions(self) -> list[str]:
        return sorted(x for x in self.names("manifests") if x.endswith(".json") and not x.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest one, or that of a version."""
        kept = self.versions()
        if version is not None:
            kept = [x for x in kept if x == f"{version:012d}.json"]
        if not kept:
            if version:
                raise ValueError(f"there is no version {version}")
            return Manifest()
        stream = self.fs.open(self.path(f"manifests/{kept[-1]}"))
        try:
            return Manifest.parse(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, new: Manifest) -> bool:
        """Puts a manifest in its place; false if its version is there already."""
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        draft = self.path(f"manifests/.draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(new.text().encode()))
        stream.close()
        try:
            files.rename(draft, self.path(f"manifests/{new.version:012d}.json"), options)
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def commit(self, change: Callable[[Manifest], Manifest]) -> Manifest:
        """Puts a version after the newest one. If another writer was faster, the change is worked out anew."""
        for _ in range(ATTEMPTS):
            old = self.manifest()
            new = change(old)
            new = Manifest(old.version + 1, new.schema, new.runs)
            if self.publish(new):
                return new
        raise Conflict(f"{ATTEMPTS} other commits came first")

    def run(self, folder: str, level: int) -> Run:
        found = {k: v for k, v in self.names(folder).items() if k.endswith(".parquet")}
        return Run(folder, len(found), sum(found.values()), level)

    def append(self, rows: DataFrame, arrival: Column | None = None) -> Manifest:
        """Adds rows, as one run or as one for each value of ``arrival``, in one commit."""
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
        base = f"data/{uuid.uuid4().hex}"
        if arrival is None:
            rows.write.option("compression", self.codec).parquet(f"{self.root}/{base}")
            made = [self.run(base, 0)]
        else:
            by = "arrival"
            while by.lower() in {c.lower() for c in rows.columns}:
                by += "_"
            name = "spark.sql.maxConcurrentOutputFileWriters"
            before = self.spark.conf.get(name)
            self.spark.conf.set(name, str(WRITERS))
            try:
                rows.withColumn(by, arrival).write.option("compression", self.codec).partitionBy(by).parquet(f"{self.root}/{base}")
            finally:
                self.spark.conf.set(name, before)
            made = [self.run(f"{base}/{x}", 0) for x in sorted(self.names(base)) if x.startswith(f"{by}=")]
        made = [r for r in made if r.files]

        def change(old: Manifest) -> Manifest:
            if old.schema is not None and T.StructType.fromJson(json.loads(old.schema)) != schema:
                raise ValueError("the rows have another schema than the store")
            return Manifest(0, schema.json(), (*old.runs, *made))

        return self.commit(change)

    def tiers(self, runs: tuple[Run, ...]) -> list[list[Run]]:
        """Runs of similar size, from small to large."""
        found: list[list[Run]] = []
        for r in sorted(runs, key=lambda r: r.bytes):
            if found:
                mean = sum(x.bytes for x in found[-1]) / len(found[-1])
                if r.bytes <= max(SMALL, mean * (1 + SPREAD)):
                    found[-1].append(r)
                    continue
            found.append([r])
        return found

    def compact(self, target: int = TARGET, least_runs: int = LEAST_RUNS, most_runs: int = MOST_RUNS) -> Manifest:
        """Merges tiers of at least ``least_runs`` runs until there is none."""
        while True:
            now = self.manifest()
            tier = next((t[:most_runs] for t in self.tiers(now.runs) if len(t) >= least_runs), None)
            if tier is None:
                return now
            size = sum(r.bytes for r in tier)
            files = max(1, -(-size // target))
            folder = f"data/{uuid.uuid4().hex}"
            # a task reads some shards and writes one file: nothing is shuffled
            self.rows(now, tier).coalesce(files).write.option("compression", self.codec).parquet(f"{self.root}/{folder}")
            merged = self.run(folder, 1 + max(r.level for r in tier))
            gone = {r.name for r in tier}

            def change(old: Manifest, gone=gone, merged=merged) -> Manifest:
                if not gone <= {r.name for r in old.runs}:
                    raise Conflict("another compaction has merged these runs")
                return Manifest(0, old.schema, (*[r for r in old.runs if r.name not in gone], merged))

            self.commit(change)

    def rows(self, manifest: Manifest, runs: list[Run] | tuple[Run, ...]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema)) if manifest.schema else T.StructType([])
        paths = [f"{self.root}/{r.name}" for r in runs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """What the store holds, or held at a version whose files are still there."""
        m = self.manifest(version)
        return self.rows(m, m.runs)

    def vacuum(self, grace: float = GRACE) -> None:
        """Removes what no reader or writer of the last ``grace`` seconds can need.

        That is every folder that is as old and that neither the newest manifest
        lists nor one that was the newest within that time, and the manifests
        before these. With no grace, no reader or writer may be at work.
        """
        until = time.time() - grace
        written = {s.getPath().getName(): s.getModificationTime() / 1000 for s in self.fs.listStatus(self.path("manifests"))} if self.fs.exists(self.path("manifests")) else {}
        names = self.versions()
        # a manifest was the newest until the next one came
        kept = [x for x, later in zip(names, [*names[1:], None]) if later is None or grace > 0 and written[later] >= until]
        live = {r.name for x in kept for r in self.manifest(int(x.removesuffix(".json"))).runs}
        old = lambda folder: grace <= 0 or self.fs.getFileStatus(self.path(folder)).getModificationTime() / 1000 < until
        for top in self.names("data"):
            below = self.names(f"data/{top}")
            parts = [f"data/{top}/{x}" for x in below if "=" in x] or [f"data/{top}"]
            dead = [p for p in parts if p not in live and old(p)]
            for p in [f"data/{top}"] if len(dead) == len(parts) else dead:
                self.fs.delete(self.path(p), True)
        for x in names:
            if x not in kept:
                self.fs.delete(self.path(f"manifests/{x}"), False)


def compacted(rows: DataFrame, root: str, arrivals: int, key: Column, target: int = TARGET) -> DataFrame:
    """Appends rows in arrivals by a hash of ``key``, compacts, removes what was replaced, and reads the newest version.

    Rows come back as they were, with all columns, nulls, repeats and empty or
    very long texts. An empty table gives an empty store.
    """
    store = Store(rows.sparkSession, root)
    store.append(rows, F.pmod(F.xxhash64(key), F.lit(arrivals)).cast("int"))
    store.compact(target)
    store.vacuum(grace=0)  # nothing else knows the store yet
    return store.read()

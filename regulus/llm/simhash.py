"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are cut into blocks. Two of them that differ in at
most ``distance`` bits agree on at least ``blocks - distance`` whole blocks, so
every choice of that many blocks is a table, and close pairs share a bucket in
one of the tables. Rows meet by bucket, and the Hamming distance of those that
met is verified. Of a bucket only a spanning forest of its links is kept, so a
group of near copies yields as many links as it has members, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulus.llm.common import cut, few, is_small, small
from regulus.llm.components import components
from regulus.llm.similar import SHINGLE as FIVE
from regulus.llm.similar import digest, join_similar, min_hashes, shingle_set

#: Bits that may differ; words to a shingle; seed of the hash.
DISTANCE, SHINGLE, SEED = 4, 4, 42
#: A bucket of more fingerprints than this is not compared in one task but by midpoints.
CROWD = 16_384
#: Blocks for up to so many fingerprints: longer keys for more rows keep buckets short.
BLOCKS = ((1 << 26, 6), (1 << 31, 7), (1 << 63, 8))


def hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text, some at a time."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    run = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = list(zip(starts, ends[shingle - 1 :])) if len(words) >= shingle else [(0, len(run))]
    for k in range(0, len(spans), 1 << 16):
        yield np.fromiter((xxh64_intdigest(run[a:b], seed) for a, b in spans[k : k + (1 << 16)]), np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is one if it is set in over half of the hashes; zero for no words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes(text, shingle, seed):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = np.packbits(2 * ones > n, bitorder="little") if n else np.zeros(8, np.uint8)
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED, similar: bool = False) -> DataFrame:
    """``(key, fp)`` for each row, the fingerprint as a signed long; if asked, also ``name`` and ``blocks`` of its set of five-word shingles."""

    def each(batches):
        for b in few(batches):
            texts = [t.as_py() for t in b.column(1)]
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, len(b))
            columns, names = [b.column(0), pa.array(fps.view(np.int64))], ["key", "fp"]
            if similar:
                marks = [(digest(s), min_hashes(s)) for s in (shingle_set(hashes(t, FIVE)) for t in texts)]
                columns += [pa.array([m[0] for m in marks], pa.binary()), pa.array([m[1] for m in marks], pa.list_(pa.int64()))]
                names += ["name", "blocks"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(keep).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(each, f"key {rows.schema['key'].dataType.simpleString()}, fp long" + (", name binary, blocks array<long>" if similar else ""))


def tables(blocks: int, distance: int) -> list[int]:
    """The bit mask of each table."""
    if blocks <= distance:
        raise ValueError("there must be more blocks than bits that may differ")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(blocks)]
    return [sum(some) for some in combinations(masks, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one bucket."""
    left, links = fps.view(np.uint64), []
    while len(left):
        seed, left = left[:1], left[1:]
        front = [seed[0]]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                links += [(at, x) for x in found]
                front += list(found)
                left = left[~near]
    return links


def bucket_links(rows: DataFrame, distance: int, crowd: int = CROWD) -> DataFrame:
    """``rows(t, k, fp)``, of a bucket together and in order -> ``(a, b)``: links, or ``(a, null)`` for members of a crowd."""

    def each(batches):
        held: list[np.ndarray] = []
        n, name, over = 0, None, False

        def done() -> list[tuple[int, int | None]]:
            return [] if over or n < 2 else [(int(a.view(np.int64)), int(b.view(np.int64))) for a, b in forest(np.concatenate(held), distance)]

        for b in batches:
            t, k, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            out: list[tuple[int, int | None]] = []
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(t)]])
            # buckets of two within the batch, all at once
            two = (stops - starts == 2) & (starts > 0) & (stops < len(t))
            x, y = fp[starts[two]], fp[starts[two] + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= distance
            out += list(zip(x[near].tolist(), y[near].tolist()))
            rest = np.flatnonzero(~two & ((stops - starts > 1) | (starts == 0) | (stops == len(t))))
            for i in rest:
                s, e = starts[i], stops[i]
                if (t[s], k[s]) != name:
                    out += done()
                    held, n, name, over = [], 0, (t[s], k[s]), False
                n += e - s
                if over:
                    out += [(v, None) for v in fp[s:e].tolist()]
                elif n > crowd:
                    over = True
                    out += [(v, None) for part in [*held, fp[s:e]] for v in part.tolist()]
                    held = []
                else:
                    held.append(fp[s:e].copy())
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])
        last = done()
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in last], pa.int64()), pa.array([p[1] for p in last], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(each, "a long, b long")


def midpoint_links(crowd: DataFrame, distance: int) -> DataFrame:
    """Links of ``crowd(fp)`` whose count grows with the rows only.

    Two fingerprints that differ in at most ``distance`` bits have a midpoint
    within half of that of one, and within the rest of it of the other. All that
    lie within half of it of one midpoint are linked or share it, and so is what
    lies within the rest with any of them, so a star to the least of the former
    stands for their pairs.
    """
    half, rest = distance // 2, distance - distance // 2
    flips = [F.struct(F.lit(signed(sum(1 << b for b in some))).alias("x"), F.lit(n <= half).alias("near")) for n in range(rest + 1) for some in combinations(range(64), n)]
    moved = crowd.select("fp", F.explode(F.array(*flips)).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f.x")).alias("mid"), "f.near")
    least = moved.groupBy("mid").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("a is not null and low < high").select("mid", "a")
    return moved.join(least, "mid").where("a <> fp").select("a", F.col("fp").alias("b"))


def links(distinct: DataFrame, distance: int = DISTANCE, crowd: int = CROWD, blocks: int | None = None) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``: links that connect whatever is within the distance."""
    n = distinct.count()
    blocks = max(blocks or next(b for most, b in BLOCKS if n <= most), distance + 2)
    spark = distinct.sparkSession
    keys = [F.struct(F.lit(i).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(tables(blocks, distance))]
    placed = distinct.select("fp", F.inline(F.array(*keys))).select("t", "k", "fp")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(keys) // 2_000_000)
    found = cut(bucket_links(placed.repartition(parts, "t", "k").sortWithinPartitions("t", "k", "fp"), distance, crowd).distinct())
    near = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    dense = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if dense.isEmpty():
        return near.distinct()
    return near.union(midpoint_links(dense, distance)).distinct()


def grouped(prints: DataFrame, distance: int, crowd: int) -> DataFrame:
    """``prints(key, fp, ...)`` with ``head``: the least key that links of fingerprints reach."""
    reps = cut(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(reps.select("fp"), distance, crowd))
    linked = reps.join(roots, reps["fp"] == roots["node"], "inner").select("fp", "root", "least")
    heads = linked.groupBy("root").agg(F.min("least").alias("head"))
    found = linked.join(heads, "root").select("fp", "head").union(reps.where("n > 1").join(roots.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("least").alias("head")))
    return prints.join(cut(found), "fp", "left").withColumn("head", F.coalesce("head", "key"))


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED, crowd: int = CROWD, similarity: float | None = None) -> DataFrame:
    """One row for each input row: id, ``fingerprint`` and ``component_id``, the smallest id that links reach.

    Texts are compared whole, with A-Z in lower case. A null text and one
    without words have fingerprint zero, which links like any other. Copies
    share a fingerprint and are met once. A null id is never the smallest, so
    it gets the component of its neighbours, or null if there is none; rows
    that repeat come back as often. Other columns aren't looked at. An empty
    table gives an empty result. With a ``similarity``, texts of so large a
    five-word similarity link as well; rows without an id make no such links.
    """
    prints = cut(fingerprints(docs, text, id_column, shingle, seed, similarity is not None))
    out = grouped(prints, distance, crowd)
    if similarity is not None:
        out = cut(out)
        moved = join_similar(docs, out, text, id_column, similarity).where("was <> head").withColumnRenamed("head", "to")
        out = out.join(moved, out["head"] == moved["was"], "left").withColumn("head", F.coalesce("to", "head"))
    return out.select(F.col("key").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("head").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", id_column: str = "doc_id", **how) -> DataFrame:
    """Of each component one row stays, that with the smallest id; columns as they came.

    Of rows that repeat, id and text alike, one stays. Rows without an id come
    after all others, in the order of a digest of their texts. Null and empty
    texts have fingerprint zero, so one of them stays. Of very long texts all is
    compared; an empty table gives an empty one.
    """
    key = F.col(id_column)
    if not docs.where(key.isNull()).isEmpty():
        nothing = key.isNull()
        key = F.struct(nothing.alias("without"), F.coalesce(key, F.lit(0).cast(docs.schema[id_column].dataType)).alias("id"), F.when(nothing, F.md5(F.coalesce(F.col(text), F.lit("")))).otherwise(F.lit("")).alias("text"))
    named = docs.select(key.alias("_key"), F.col(text).alias("_text"))
    found = near_duplicates(named, "_text", "_key", **how)
    # of each key whether it goes and how often it is there, written out once for the few that matter
    per = found.groupBy("_key").agg((F.max("component_id") != F.col("_key")).alias("goes"), F.count(F.lit(1)).alias("n"))
    told = cut(per.where("goes or n > 1"))
    gone = F.broadcast(told) if is_small(told) else told
    row = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = row.join(gone.where("goes").select(F.col("_key").alias("_gone")), F.col("_key") == F.col("_gone"), "left_anti")
    again = told.where("not goes").select("_key")
    if not again.isEmpty():
        again = small(again)
        one = kept.join(again, "_key", "left_semi").groupBy("_key", F.col("_row").getField(text).alias("_text")).agg(F.first("_row").alias("_row"))
        kept = kept.join(again, "_key", "left_anti").unionByName(one.select("_key", "_row"))
    return kept.select("_row.*")

"""Links between texts that share most of their word shingles.

Two texts of five-word similarity 0.8 differ in 4 to 14 bits of a fingerprint,
which no choice of whole blocks finds at a bearable number of tables. For such
pairs the blocks are cut from min-hashes instead: a block of six agrees with
probability 0.8 ** 6, so of twenty blocks at least one does with probability
0.997 at the threshold, and more above it. Those that share a block are compared
by their whole sets of shingles, however many share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regulus.llm.common import cut, few, small
from regulus.llm.components import components

#: Similarity that links; words to a shingle; blocks; min-hashes to a block; seed.
SIMILARITY, SHINGLE, BLOCKS, ROWS, SEED = 0.8, 5, 20, 6, 42
#: The first round, which only saves work, compares a text with so many of those before it in its bucket, and walks longer buckets in parts; the second compares whatever the first left apart.
STEPS, PART = (1, 2, 3), 10_000


def shingle_set(parts: Iterator[np.ndarray]) -> np.ndarray:
    held = list(parts)
    return np.unique(np.concatenate(held)) if held else np.empty(0, np.uint64)


def digest(grams: np.ndarray) -> bytes:
    """Names a set of shingles."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(grams.tobytes())


def min_hashes(grams: np.ndarray, blocks: int = BLOCKS, rows: int = ROWS, seed: int = SEED) -> list[int]:
    """One signed long for each block; none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(grams):
        return []
    draw = np.random.default_rng(seed)
    flip, times = draw.integers(0, 1 << 63, (2, blocks * rows), dtype=np.uint64)
    times = times * np.uint64(2) + np.uint64(1)
    least = np.full(blocks * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), 4096):
        np.minimum(least, ((grams[k : k + 4096, None] ^ flip) * times).min(axis=0), out=least)
    return np.array([xxh64_intdigest(b.tobytes()) for b in least.reshape(blocks, rows)], np.uint64).view(np.int64).tolist()


def grams_of(docs: DataFrame, text: str, shingle: int, seed: int) -> DataFrame:
    """``(name, grams)``: each set of shingles once, in order."""
    from regulus.llm.simhash import hashes


    def each(batches):
        for b in few(batches):
            sets = [shingle_set(hashes(t.as_py(), shingle, seed)) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["name", "grams"])

    return docs.select(F.col(text).alias("text")).mapInArrow(each, "name binary, grams array<long>").groupBy("name").agg(F.first("grams").alias("grams"))


def met(buckets: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """``buckets(t, k, part, first, me)`` -> pairs ``(a, b, ha, hb)`` of neighbours in a bucket, in an order drawn for each block."""
    order = Window.partitionBy("t", "k", "part").orderBy(F.xxhash64("t", "me.name"), "me.name")
    others = [F.coalesce(F.lag("me", s).over(order), F.when(F.lit(s == 1), F.col("first"))) for s in steps]
    pairs = buckets.select(F.col("me").alias("x"), F.array(*others).alias("ys")).select("x", F.explode("ys").alias("y")).where("y is not null and x.head <> y.head")
    x, y = F.least("x", "y"), F.greatest("x", "y")
    return pairs.select(x["name"].alias("a"), y["name"].alias("b"), x["head"].alias("ha"), y["head"].alias("hb")).distinct()


def sets_of(docs: DataFrame, texts: DataFrame, names: DataFrame, text: str, id_column: str, shingle: int, seed: int) -> DataFrame:
    """``(name, grams)`` of the texts that are named."""
    keys = small(texts.join(names, "name", "left_semi").select(F.col("key").alias("_key")).distinct())
    return cut(grams_of(docs.join(keys, docs[id_column] == keys["_key"], "left_semi"), text, shingle, seed))


def alike(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: the heads of those pairs whose whole sets have the similarity."""
    sides = pairs.join(grams.select(F.col("name").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("name").alias("b"), F.col("grams").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    return sides.where(both >= similarity * (F.size("ga") + F.size("gb") - both)).select(F.col("ha").alias("a"), F.col("hb").alias("b")).distinct()


def mixed(texts: DataFrame) -> DataFrame:
    """``(name)``: the texts that share a bucket with a text of another head."""
    placed = texts.select("name", "head", F.posexplode("blocks").alias("t", "k"))
    full = placed.groupBy("t", "k").agg(F.min("head").alias("low"), F.max("head").alias("high")).where("low < high").select("t", "k")
    return placed.join(full, ["t", "k"], "left_semi").select("name").distinct()


def candidates(sets: DataFrame, similarity: float) -> DataFrame:
    """``sets(name, head, grams)`` -> ``(a, b, ha, hb)``: all pairs of two heads that may have the similarity.

    Sets are put in one order: first the shingles that a single head has, then
    the others, rarest first. Two sets of the similarity have a shingle in
    common among the first ``size - similarity * size + 1`` of each, and where
    the first such one stands, enough must be left of both. Nothing is dropped
    that could have the similarity.
    """
    each = sets.select("name", "head", F.explode("grams").alias("g"))
    spread = each.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("head").alias("low"), F.max("head").alias("high")).where("low < high").select("g", "n")
    shared = each.join(spread, "g").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("shared"))
    sized = sets.select("name", "head", F.size("grams").alias("size")).join(shared, "name").withColumn("own", F.col("size") - F.size("shared"))
    # a little more than the bound, for the sake of rounding
    prefix = F.col("size") - F.ceil(similarity * F.col("size") - 1e-6).cast("int") + 1
    first = sized.select("name", "head", "size", "own", F.posexplode(F.slice("shared", 1, F.greatest(prefix - F.col("own"), F.lit(0)))).alias("i", "x"))
    keys = cut(first.select("name", "head", "size", (F.col("size") - F.col("own") - F.col("i")).alias("left"), F.col("x.g").alias("g")))
    x, y = keys.alias("x"), keys.alias("y")
    enough = F.least("x.left", "y.left") >= similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-6
    pairs = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.name") < F.col("y.name")) & (F.col("x.head") != F.col("y.head")) & enough)
    return pairs.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), F.col("x.head").alias("ha"), F.col("y.head").alias("hb")).distinct()


def join_similar(docs: DataFrame, marks: DataFrame, text: str, id_column: str, similarity: float = SIMILARITY, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``marks(key, head, name, blocks)`` of the rows of docs -> ``(was, head)``: the least head that each linked head reaches.

    Rows of equal sets of shingles join; others join where they share a block
    and their sets have the similarity. First each text meets a few neighbours
    in its buckets, which joins most of what belongs together at a cost that
    grows with the rows. Whatever then still shares a bucket with a text of
    another head is compared by :func:`candidates`, so that no link depends on
    an order or on the size of a bucket. Rows without an id, and texts without
    words, take no part. An empty table gives none.
    """
    marks = marks.where("key is not null and head is not null and size(blocks) > 0")
    texts = cut(marks.groupBy("name").agg(F.min("head").alias("head"), F.first("blocks").alias("blocks"), F.min("key").alias("key")))
    before = F.lag("head").over(Window.partitionBy("name").orderBy("head"))
    torn = marks.select("name", "head").distinct().select(before.alias("a"), F.col("head").alias("b")).where("a is not null")
    placed = texts.select(F.struct("name", "head").alias("me"), F.posexplode("blocks").alias("t", "k"))
    full = placed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("me").alias("first"), F.min("me.head").alias("low"), F.max("me.head").alias("high")).where("low < high")
    part = F.pmod(F.xxhash64("k", "me.name"), F.ceil(F.col("n") / PART).cast("long"))
    pairs = cut(met(placed.join(full, ["t", "k"]).select("t", "k", part.alias("part"), "first", "me"), STEPS))
    ends = pairs.select(F.col("a").alias("name")).union(pairs.select(F.col("b").alias("name")))
    near = alike(pairs, sets_of(docs, texts, ends, text, id_column, shingle, seed), similarity)
    roots = components(near.union(torn))
    # what the neighbours left apart
    now = cut(texts.join(roots, texts["head"] == roots["node"], "left").select("name", F.coalesce("root", "head").alias("head"), "blocks", "key"))
    grams = sets_of(docs, now, mixed(now), text, id_column, shingle, seed)
    more = None
    if not grams.isEmpty():
        more = cut(alike(candidates(grams.join(now.select("name", "head"), "name"), similarity), grams, similarity))
    if more is not None and not more.isEmpty():
        later = components(more).select(F.col("node").alias("old"), F.col("root").alias("new"))
        fresh = later.join(roots, later["old"] == roots["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
        roots = cut(roots.join(later, roots["root"] == later["old"], "left").select("node", F.coalesce("new", "root").alias("root")).union(fresh))
    return roots.join(roots.groupBy("root").agg(F.min("node").alias("head")), "root").select(F.col("node").alias("was"), "head")

"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from regulus.llm.common import cut

#: Links that a task contracts at once; so many, some megabytes, are the most that one task finishes.
PIECE = 1 << 18
#: Nodes that are the same in Python just when they are in Spark.
PLAIN = (IntegerType(), LongType(), StringType())


def joined(a: list, b: list) -> dict:
    """One node of each component for each node of the links between ``a`` and ``b``."""
    to = {x: x for x in a} | {x: x for x in b}

    def root(x):
        while (y := to[x]) != x:
            to[x] = x = to[y]
        return x

    for x, y in zip(a, b):
        to[root(x)] = root(y)
    return {x: root(x) for x in to}


def contracted(links: DataFrame, piece: int) -> DataFrame:
    """``links(a, b)`` -> ``(a, b)``: each task sends the nodes of its links, a bounded number at once, to one node of what they join."""
    kind = links.schema["a"].dataType.simpleString()

    def each(batches):
        a, b = [], []

        def told():
            found = joined(a, b)
            return pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field(0).type) for x in (found.keys(), found.values())], names=["a", "b"])

        for batch in batches:
            for s in range(0, len(batch), piece):
                some = batch.slice(s, piece)
                a += some.column(0).to_pylist()
                b += some.column(1).to_pylist()
                if len(a) >= piece:
                    yield told()
                    a, b = [], []
        if a:
            yield told()

    return links.mapInArrow(each, f"a {kind}, b {kind}")


def components(links: DataFrame, piece: int = PIECE) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)``, one row for each node that has a link.

    Tasks first contract what their own links join, a piece of them at once. If
    all links that are left are one piece, that is all; otherwise a round sends
    every node to the least of itself and its neighbours, in an order drawn
    afresh for the round, and carries the links over to where their ends went.
    The image of a connected graph is connected, so when no link is left
    between two different nodes each component has met in one root. The order
    being random, long chains shrink by a constant factor a round. All sides
    are joined by key; hubs are met by partial aggregation and by splitting
    skewed joins. Nodes of other types than whole numbers and texts go through
    the rounds alone. Nulls at an end are no link; repeated links, links both
    ways and loops change nothing.
    """
    plain = links.schema["a"].dataType in PLAIN

    def written(left: DataFrame) -> tuple[DataFrame, bool, bool]:
        """The links as they are after the tasks' own work; whether each node has met its root; whether none is left between two nodes."""
        left = cut(left)
        if not plain:
            return left, False, left.where("a <> b").isEmpty()
        n = left.count()
        return cut(contracted(left.coalesce(max(1, -(-n // piece))), piece)), n <= piece, n == 0

    ends, met, none = written(links.where("a is not null and b is not null").select("a", "b").distinct())
    if met:
        return ends.select(F.col("a").alias("node"), F.col("b").alias("root"))
    open_links, maps, turn = ends.where("a <> b"), [], 0
    while not (met or none):
        turn += 1
        both = open_links.union(open_links.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("n"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("at"), F.least(rank("a"), F.col("m"))["n"].alias("to"))
        maps.append(cut(best))
        left, right = maps[-1].select(F.col("at").alias("a"), F.col("to").alias("na")), maps[-1].select(F.col("at").alias("b"), F.col("to").alias("nb"))
        moved, met, none = written(open_links.join(left, "a").join(right, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
        open_links = moved.where("a <> b")
        if met and not none:
            maps.append(moved.select(F.col("a").alias("at"), F.col("b").alias("to")))
    roots = ends.select(F.col("a").alias("node")).union(ends.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node"))
    for best in maps:
        roots = roots.join(best, roots["root"] == best["at"], "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(roots)

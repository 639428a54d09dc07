"""The last known row of one table before each row of another, and windows over keys of any size.

Both tables are one table, sorted once by key and time, in which every row
carries on what was last known. A key with very many rows is cut at bounds
drawn from its own rows; what was last known at the end of a part is carried
into the next ones from a table of parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with more rows than this is cut into parts of about so many.
HEAVY = 1_000_000
#: Rows of a key from which its bounds are drawn, for each part; keys whose bounds are sent to all tasks.
DRAWN, MOST_KEYS = 50, 10_000
#: Sums over a whole table meet in at most about so many cells of equal width.
CELLS = 1 << 14


def parted(rows: DataFrame, keys: Sequence[str], order: str, heavy: int = HEAVY, name: str = "_b") -> DataFrame | None:
    """The rows with the number of their part, a range of ``order``; none if no key is heavy.

    Bounds are values of ``order``, of any type that can be sorted, from a sample
    of the key's own rows, so equal places are in one part. A null place is
    before all others.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy)
    told = [tuple(r) for r in sizes.limit(MOST_KEYS + 1).collect()]
    if not told:
        return None
    few = len(told) <= MOST_KEYS
    sizes = rows.sparkSession.createDataFrame(told, sizes.schema) if few else sizes
    hint = F.broadcast if few else (lambda df: df)
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    here = lambda df: [df[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    parts = F.ceil(F.col("_n") / heavy).cast("int")
    share = F.least(F.lit(1.0), DRAWN * parts / F.col("_n"))
    sample = rows.select(*keys, order).join(hint(sizes.select(*own, "_n")), here(rows)).where(F.col(order).isNotNull() & (F.pmod(F.xxhash64(order, F.lit(11)), F.lit(1 << 20)) < share * (1 << 20)))
    drawn = sample.groupBy(*[f"_k{i}" for i in range(len(keys))], "_n").agg(F.array_sort(F.collect_set(order)).alias("_s"))  # some dozen values for each part
    step = lambda i: F.get("_s", F.floor(F.size("_s") * i / parts).cast("int"))
    bounds = drawn.select(*[f"_k{i}" for i in range(len(keys))], F.array_distinct(F.transform(F.sequence(F.lit(1), parts - 1), step)).alias("_bounds"))
    at = F.coalesce(F.size(F.filter("_bounds", lambda x: x < F.col(order))), F.lit(0))
    joined = rows.join(hint(bounds), here(rows), "left")
    return joined.withColumn(name, F.when(F.col("_bounds").isNull(), 0).otherwise(at).cast("int")).drop("_bounds", *[f"_k{i}" for i in range(len(keys))])


def last_known(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str, place: str, heavy: int = HEAVY) -> DataFrame:
    """Adds ``out``: the last ``value`` that is not null at or before each row, in the order of its key."""
    keys = list(keys)
    cut = parted(rows, keys, place, heavy)
    if cut is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumn(out, F.last(value, ignorenulls=True).over(w))
    ends = cut.where(F.col(value).isNotNull()).groupBy(*keys, "_b").agg(F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v")))["v"].alias("_end"))
    every = cut.select(*keys, "_b").distinct()
    told = every.join(ends, [every[k].eqNullSafe(ends[k]) for k in [*keys, "_b"]], "left").select(*[every[k] for k in [*keys, "_b"]], "_end")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = told.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.last("_end", ignorenulls=True).over(before).alias("_in")).where("_in is not null")
    on = [inside[k].eqNullSafe(carried[f"_k{i}"]) for i, k in enumerate(keys)] + [inside["_b"] == carried["_kb"]]
    return inside.join(carried, on, "left").withColumn(out, F.coalesce(out, "_in")).select(*rows.columns, out)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, tie: Sequence[str] = (), strict: bool = False, heavy: int = HEAVY) -> DataFrame:
    """Each row of ``left`` with the struct ``last`` of the row of ``right`` that has its keys and the greatest ``right_at`` not after ``left_at``.

    With ``strict`` it must be before. Of equal times the row with the greatest
    ``tie`` counts, and of rows that agree in that, the greatest as a whole. Null
    keys agree with null keys; a null time on the left has no last row, and one
    on the right is never last. Left rows that repeat come back as often;
    ``last`` is null where there is none.
    """
    keys = list(keys)
    fields = [c for c in right.columns if c not in keys]
    first = [right_at, *tie]
    seen = F.struct(*[F.col(c) for c in [*first, *[c for c in fields if c not in first]]])
    mine = left.select(*[F.col(k) for k in keys], F.col(left_at).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(seen.alias("s")).schema["s"].dataType).alias("_seen"), F.lit(0 if strict else 1).alias("_side"))
    theirs = right.where(F.col(right_at).isNotNull()).select(*[F.col(k) for k in keys], F.col(right_at).alias("_t"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), seen.alias("_seen"), F.lit(1 if strict else 0).alias("_side"))
    # at one time, rows of the right are in the order of what they hold
    known = last_known(theirs.unionByName(mine), keys, [F.col("_t"), F.col("_side"), F.col("_seen")], "_seen", "_last", "_t", heavy)
    got = known.where("_row is not null")
    return got.select("_row.*", F.when(F.col("_t").isNotNull(), F.col("_last")).alias("last"))


def so_far(rows: DataFrame, at: str, values: Sequence[str], first: int, last: int, heavy: int = HEAVY) -> DataFrame:
    """Each row with its ``values`` summed over all rows whose ``at`` is not after its own.

    ``at`` is a whole number from ``first`` to ``last``. Rows are summed within
    cells of equal width, those of very many rows cut into parts; the sums of
    what stands before a cell come from a table of cells, which is as small
    however many rows there are.
    """
    bits = ((last - first) // CELLS).bit_length()
    placed = rows.withColumn("_cell", F.shiftright(F.col(at) - F.lit(first).cast("long"), bits))
    cut = parted(placed, ["_cell"], at, heavy)
    cut = placed.withColumn("_b", F.lit(0)) if cut is None else cut
    before = Window.orderBy("_cell", "_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut.groupBy("_cell", "_b").agg(*[F.sum(v).alias(v) for v in values])
    carried = cells.select(F.col("_cell").alias("_kc"), F.col("_b").alias("_kb"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_in_{v}") for v in values])
    w = Window.partitionBy("_cell", "_b").orderBy(at)  # with all rows of the same place
    inside = cut.withColumns({v: F.sum(v).over(w) for v in values})
    joined = inside.join(F.broadcast(carried), (F.col("_cell") == F.col("_kc")) & (F.col("_b") == F.col("_kb")))
    return joined.withColumns({v: F.col(v) + F.col(f"_in_{v}") for v in values}).select(*rows.columns)


def reach(rows: DataFrame, key: str, start: str, end: str, out: str, heavy: int = HEAVY) -> DataFrame:
    """Adds ``out``: the greatest ``end`` of the key's rows before each one, in the order of their ``start``; null for the first."""
    cut = parted(rows, [key], start, heavy)
    order = Window.partitionBy(key, *([] if cut is None else ["_b"])).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    if cut is None:
        return rows.withColumn(out, F.max(end).over(order))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(key, "_b").agg(F.max(end).alias("_e")).select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.max("_e").over(before).alias("_in"))
    inside = cut.withColumn(out, F.max(end).over(order)).join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return inside.withColumn(out, F.greatest(out, "_in")).select(*rows.columns, out)

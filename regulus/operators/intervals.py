"""Joins of rows whose intervals overlap, without comparing all with all.

Every interval has a level, the power of two that its length is below, so it
touches at most two cells of that level's grid. Two intervals meet in the cells
of the coarser of their levels: each row goes to the cells of its own level and
to those of the coarser levels that the other side has, of which there are some
dozens at most, however long an interval is. Of two rows that share two cells
only the first counts, so no pair comes twice. Cells that hold very many rows
are dealt out to several tasks.

Where pairs are only counted, none is made: a moment lies in as many intervals
as began before it and have not ended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.operators.asof import HEAVY, reach, so_far

#: Levels are this many powers of two apart; a cell with more rows of a side is split.
STEP, CROWD = 2, 100_000


def level(start: Column, end: Column) -> Column:
    """The least multiple of :data:`STEP` so that two to its power is more than the length."""
    bits = F.when(end == start, 0).otherwise(F.length(F.bin(end - start)))
    return (F.ceil(bits / STEP) * STEP).cast("int")


def levels(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select("_level").distinct().collect())  # at most some dozens


def placed(rows: DataFrame, others: Sequence[int], side: str) -> DataFrame:
    """A row for each cell: ``_at`` its level, ``_first`` and ``_cell`` the first one of the row there and this one, ``_home`` whether the level is the row's own."""
    above = F.array(*[F.lit(k) for k in others]) if others else F.array().cast("array<int>")
    at = F.concat(F.array("_level"), F.filter(above, lambda k: k > F.col("_level")))
    cell = lambda c, k: F.call_function("shiftright", F.col(c), k)
    cells = F.flatten(F.transform(at, lambda k: F.transform(F.sequence(cell("_start", k), cell("_end", k)), lambda n: F.struct(k.alias("_at"), n.alias("_cell"), cell("_start", k).alias(f"_first_{side}"), (k == F.col("_level")).alias(f"_home_{side}")))))
    return rows.select("*", F.inline(cells)).drop("_level").withColumnsRenamed({"_start": f"_start_{side}", "_end": f"_end_{side}"})


def crowded(left: DataFrame, right: DataFrame, where: list[str], crowd: int) -> DataFrame:
    """``where`` and how many parts each side's rows are dealt out to, for the cells of which one side has more than ``crowd`` rows."""
    count = lambda df, c: df.groupBy(*where).agg(F.count(F.lit(1)).alias(c))
    parts = lambda c: F.ceil(F.col(c) / crowd).cast("int")
    both = count(left, "l").join(count(right, "r"), where)
    return both.where((F.col("l") > crowd) | (F.col("r") > crowd)).select(*where, parts("l").alias("_parts_l"), parts("r").alias("_parts_r"))


def dealt(rows: DataFrame, cells: DataFrame, where: list[str], mine: str, other: str) -> DataFrame:
    """Each row in one part of its own side, drawn at random, and in all of the other's."""
    joined = rows.join(cells, where, "left")
    own = F.coalesce(F.floor(F.rand(7) * F.col(f"_parts_{mine}")), F.lit(0)).cast("int")
    every = F.sequence(F.lit(0), F.coalesce(F.col(f"_parts_{other}"), F.lit(1)) - 1)
    return joined.withColumn(f"_part_{mine}", own).withColumn(f"_part_{other}", F.explode(every)).drop("_parts_l", "_parts_r")


def overlapping(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: Sequence[str] = (), crowd: int = CROWD) -> DataFrame:
    """All pairs of a row of either side whose closed intervals have a point in common, and whose ``keys`` are equal.

    Bounds are whole numbers (of a moment: its microseconds); names other than
    keys must differ between the sides. Rows with a null key or bound, or that
    end before they start, meet none; rows that repeat meet each. The order in
    which rows come back is not fixed. An empty side gives no pairs.
    """
    spark = left.sparkSession

    def made(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        start, end = (F.col(c).cast("long") for c in span)
        return df.where(end >= start).select("*", start.alias("_start"), end.alias("_end"), level(start, end).alias("_level"))

    left, right = made(left, left_span), made(right, right_span)
    of_left, of_right = levels(left), levels(right)
    where = [*keys, "_at", "_cell"]
    a, b = placed(left, of_right, "l"), placed(right, of_left, "r")
    cells = crowded(a, b, where, crowd)
    told = [tuple(r) for r in cells.limit(MOST_CELLS + 1).collect()]
    if told:
        cells = F.broadcast(spark.createDataFrame(told, cells.schema)) if len(told) <= MOST_CELLS else cells
        a, b = dealt(a, cells, where, "l", "r"), dealt(b, cells, where, "r", "l")
        where += ["_part_l", "_part_r"]
    meet = (F.col("_home_l") | F.col("_home_r")) & (F.col("_cell") == F.greatest("_first_l", "_first_r")) & (F.col("_start_l") <= F.col("_end_r")) & (F.col("_start_r") <= F.col("_end_l"))
    pairs = a.join(b, where).where(meet)
    return pairs.drop(*[c for c in pairs.columns if c in ("_at", "_cell", "_part_l", "_part_r") or c in {f"_{n}_{s}" for n in ("start", "end", "first", "home") for s in "lr"}])


#: So many split cells are sent to all tasks; where there are more, they are joined by a shuffle.
MOST_CELLS = 10_000


def covered(points: DataFrame, at: str, spans: DataFrame, span: tuple[str, str], who: str, counts: tuple[str, str], heavy: int = HEAVY) -> DataFrame:
    """The rows of ``points`` with two ``counts``: in how many closed spans ``at`` lies, and how many different ``who`` these have.

    Bounds are whole numbers, as in :func:`overlapping`; spans with a null bound,
    or that end before they start, hold no point, and a null ``who`` is not
    counted. Points in no span, or without ``at``, are left out. A span counts
    for its ``who`` only from where the earlier ones of the same have ended, so
    nothing is as large as the pairs.
    """
    start, end = (F.col(c).cast("long") for c in span)
    made = spans.where(end >= start).select(start.alias("_s"), end.alias("_e"), F.col(who).alias("_who"))
    first, last = made.agg(F.min("_s"), F.max("_e")).first()
    t = F.col(at).cast("long")
    mine = points.where(t.between(F.lit(first).cast("long"), F.lit(last).cast("long"))).select(t.alias("_t"), F.struct(*points.columns).alias("_row"), *[F.lit(0).cast("long").alias(c) for c in ("_n", "_k")])
    if first is None:
        return mine.select("_row.*", F.col("_n").alias(counts[0]), F.col("_k").alias(counts[1]))
    step = lambda t, n, k: F.struct(t.alias("_t"), F.lit(n).cast("long").alias("_n"), k.cast("long").alias("_k"))
    fresh = F.greatest(F.col("_s"), F.col("_r") + 1)
    new, whole = fresh <= F.col("_e"), fresh == F.col("_s")
    named = reach(made.where("_who is not null"), "_who", "_s", "_e", "_r", heavy)
    steps = named.select(F.inline(F.filter(F.array(step(F.col("_s"), 1, new & whole), step(fresh, 0, new & ~whole), step(F.col("_e") + 1, -1, -new.cast("int"))), lambda x: (x["_n"] != 0) | (x["_k"] != 0))))
    nobody = made.where("_who is null").select(F.inline(F.array(step(F.col("_s"), 1, F.lit(0)), step(F.col("_e") + 1, -1, F.lit(0)))))
    rows = mine.unionByName(steps.unionByName(nobody), allowMissingColumns=True)
    got = so_far(rows, "_t", ["_n", "_k"], first, last + 1, heavy).where("_row is not null and _n > 0")
    return got.select("_row.*", F.col("_n").alias(counts[0]), F.col("_k").alias(counts[1]))

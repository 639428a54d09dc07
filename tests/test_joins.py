"""Interval joins, as-of joins and windows over heavy keys, against loops."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from regulus.operators import annex, asof, intervals


def spans(rng, n, longest):
    out = []
    for i in range(n):
        a = rng.randrange(-500, 500)
        out.append((i, rng.choice(["x", "y", None]), a, a + rng.choice([0, 1, 3, 8, rng.randrange(longest), -2])))
    return [*out, (n, "x", None, 5), (n + 1, "x", 5, None), out[0]]


@pytest.mark.parametrize("crowd", [intervals.CROWD, 3])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_overlaps_equal_loops(spark, crowd, keys):
    rng = random.Random(8)
    left, right = spans(rng, 60, 900), spans(rng, 50, 40)
    a = spark.createDataFrame(left, "i long, k string, s long, e long")
    b = spark.createDataFrame(right, "j long, k2 string, s2 long, e2 long")
    if keys:
        b = b.withColumnRenamed("k2", "k")
    got = intervals.overlapping(a, b, ("s", "e"), ("s2", "e2"), keys, crowd)
    assert got.columns == [*dict.fromkeys(["i", "k", "s", "e", "j", *([] if keys else ["k2"]), "s2", "e2"])] or set(got.columns) == {"i", "k", "s", "e", "j", "s2", "e2", *([] if keys else ["k2"])}
    fits = lambda x, y: None not in (x[2], x[3], y[2], y[3]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3] and (not keys or x[1] is not None and x[1] == y[1])
    want = collections.Counter((x[0], y[0]) for x in left for y in right if fits(x, y))
    assert collections.Counter((r.i, r.j) for r in got.collect()) == want and want
    assert intervals.overlapping(a.limit(0), b, ("s", "e"), ("s2", "e2"), keys).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cells_of_a_long_interval_are_few(spark):
    one = spark.createDataFrame([(0, 0, 1 << 50)], "i long, _start long, _end long").withColumn("_level", intervals.level(F.col("_start"), F.col("_end")))
    assert intervals.placed(one, [0, 2, 4, 52, 54, 60], "l").count() <= 6


@pytest.mark.parametrize("heavy", [asof.HEAVY, 10])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of_equals_loops(spark, heavy, strict):
    rng = random.Random(3)
    left = [(i, rng.choice(["hot", "hot", "hot", "b", None, "left only"]), rng.choice([None, *range(40)])) for i in range(150)]
    right = [(rng.choice(["hot", "hot", "b", None, "right only"]), rng.choice([None, *range(40)]), n, f"v{n}" if n % 5 else None) for n in range(120)]
    right += right[:5]
    a, b = spark.createDataFrame(left, "i long, k string, t long"), spark.createDataFrame(right, "k string, at long, n long, v string")
    got = {r.i: r["last"] and (r["last"].at, r["last"].n, r["last"].v) for r in asof.as_of(a, b, ["k"], "t", "at", ["n"], strict, heavy).collect()}
    want = {}
    for i, k, t in left:
        before = [r[1:] for r in right if r[0] == k and r[1] is not None and t is not None and (r[1] < t or r[1] == t and not strict)]
        want[i] = max(before, key=lambda r: r[:2], default=None)
    assert got == want
    assert asof.as_of(a.limit(0), b, ["k"], "t", "at").count() == 0
    assert all(r["last"] is None for r in asof.as_of(a, b.limit(0), ["k"], "t", "at").collect())


def test_parts_of_a_heavy_key_hold_about_as_many_rows(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 16_000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("k"), F.concat(F.lit("t"), F.lpad((F.col("id") * 7 % 16_001).cast("string"), 6, "0")).alias("t"))
    assert asof.parted(rows, ["k"], "t", 20_000) is None
    parts = {(r.k, r._b): r["count"] for r in asof.parted(rows, ["k"], "t", 1000).groupBy("k", "_b").count().collect()}
    hot = [n for (k, _), n in parts.items() if k == "hot"]
    assert 14 <= len(hot) <= 17 and max(hot) < 2000 and {b for k, b in parts if k != "hot"} == {0}


def test_heavy_keys_with_places_of_text(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 4 else "cold", f"{i:05d}", rng.choice("ABC")) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at string, v string")
    is_open = F.col("v") == "C"
    whole, cut = (sorted(map(tuple, annex.propagate(df, ["k"], "at", "v", is_open, "out", heavy=h).collect())) for h in (None, 30))
    assert whole == cut


@pytest.mark.parametrize("heavy", [asof.HEAVY, 10])
def test_covered_equals_loops(spark, heavy):
    rng = random.Random(5)
    points = [(i, rng.choice([None, *range(-600, 1500, 7)])) for i in range(200)]
    right = [(*x, f"w{x[0]}") for x in [*spans(rng, 150, 300), *[(200 + i, "hot", 100 + i // 9, 104 + i // 9 * 2) for i in range(90)]]]
    a, b = spark.createDataFrame([*points, points[0]], "i long, t long"), spark.createDataFrame(right, "j long, k string, s long, e long, w string")
    got = collections.Counter((r.i, r.n, r.whos) for r in intervals.covered(a, "t", b, ("s", "e"), "k", ("n", "whos"), heavy).collect())
    want = collections.Counter()
    for i, t in [*points, points[0]]:
        meet = [x[1] for x in right if None not in (t, x[2], x[3]) and x[2] <= t <= x[3]]
        want[i, len(meet), len({*meet} - {None})] += bool(meet)
    assert got == +want and len({w for _, n, w in got}) > 2
    assert intervals.covered(a.limit(0), "t", b, ("s", "e"), "k", ("n", "whos")).count() == 0
    assert intervals.covered(a, "t", b.limit(0), ("s", "e"), "k", ("n", "whos")).collect() == []


def test_sums_so_far_over_few_and_many_cells(spark):
    rng = random.Random(6)
    for last in (0, 5, 1 << 40):
        rows = [(i, rng.randrange(-3, last + 1), rng.randrange(-4, 9)) for i in range(80)]
        got = {r.i: r.v for r in asof.so_far(spark.createDataFrame(rows, "i long, t long, v long"), "t", ["v"], -3, last, 10).collect()}
        assert got == {i: sum(v for _, u, v in rows if u <= t) for i, t, _ in rows}

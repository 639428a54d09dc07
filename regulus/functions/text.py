"""Column functions on whole texts that Spark has no single function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text processing means it: Unicode's, and the four separators of ASCII.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def unlines(c: Column) -> Column:
    return F.array_join(c, "\n")


def drop_lines(c: Column, pattern: str) -> Column:
    """Without the lines whose stripped form matches."""
    return unlines(F.filter(lines(c), lambda x: ~strip(x).rlike(pattern)))


def replace_all(c: Column, *rules: tuple[str, str]) -> Column:
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often and inside whatever lambda the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def firsts(all_: Column, name: str) -> Column:
    """The structs of an array that are the first with their value of field ``name``."""
    return let(all_, lambda a: let(F.transform(a, lambda x: x[name]), lambda names: F.filter(a, lambda x, i: F.array_position(names, x[name]) == i + 1)))


#: Matches of a text are placed in runs of so many, so that the time grows with their number and not with its square.
RUN = 256
SPANS = "array<struct<start:int,end:int,hit:string>>"


def find_all(c: Column, pattern: str) -> Column:
    """``array<struct<start, end, hit>>`` of the matches, in code points, the end excluded.

    What stands between matches gives their places, so no row leaves its task.
    A pattern must not match the empty string.
    """
    between, hits = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    parts = let(hits, lambda h: F.zip_with(F.slice(between, 1, F.size(h)), h, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m"))))
    nothing = F.array().cast(SPANS)

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["b"]
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    def run(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step)

    def joined(runs: Column) -> Column:
        ends = F.aggregate(runs, F.array(F.lit(0)), lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + r["at"])))
        moved = lambda by: F.flatten(F.transform(runs, lambda r, k: F.transform(r["out"], lambda x: F.struct((x["start"] + F.get(by, k)).alias("start"), (x["end"] + F.get(by, k)).alias("end"), x["hit"].alias("hit")))))
        return let(ends, moved)

    def placed(p: Column) -> Column:
        last = F.floor((F.size(p) - 1) / RUN).cast("int")
        runs = F.transform(F.sequence(F.lit(0), last), lambda k: run(F.slice(p, k * RUN + 1, F.lit(RUN))))
        return F.when(F.size(p) == 0, nothing).when(F.size(p) <= RUN, run(p)["out"]).otherwise(let(runs, joined))

    return let(parts, placed)


def cut(c: Column, start: Column, end: Column) -> Column:
    """Code points from start to end."""
    return F.substring(c, start + 1, end - start)


def count_lines(c: Column, pattern: str) -> Column:
    return F.size(F.filter(lines(c), lambda x: x.rlike(pattern)))


def distinct_sorted(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def ratio(top: Column, bottom: Column) -> Column:
    """Zero where the bottom is."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom.cast("double"))


def contained(c: Column, words) -> Column:
    """The words that the text contains, in the order given."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def any_contained(c: Column, words) -> Column:
    return F.size(contained(c, words)) > 0

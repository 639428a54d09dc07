"""Annexes: sections, blocks of text and of table rows, and logical tables.

All of an annex is handled inside its row but for two things: the walk that
cuts lines into blocks, where each block begins where the last one ended, is a
vectorised function over arrays of lines; and labels are spread and grouped
over the chunks of one annex, which a window and an aggregation do.
"""

from __future__ import annotations

import re
from statistics import stdev

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regulus.functions import patterns as P
from regulus.functions.text import cut, distinct_sorted, find_all, let, lines, ratio, strip, unlines
from regulus.operators import clean
from regulus.operators.asof import HEAVY, parted

#: A score makes a table from the first on, a candidate from the second; a paragraph gives way to what scores the second.
TABLE, CANDIDATE, PROMOTED = 0.55, 0.50, 0.45
#: Window of lines; look-ahead of a paragraph; lines that a table may grow on either side; a shorter line is short.
WINDOW_LEAST, WINDOW_MOST, AHEAD, GROW, SHORT = 5, 8, 5, 10, 50
#: A short table chunk may be a fragment of its neighbour's table.
FRAGMENT, UNKNOWN = 50, "unknown_fragment"
LABELS = ("3급승진제외", "3급승진")

BLOCKS = "array<struct<kind:string,start:int,end:int,score:double>>"


def sections(docs: DataFrame, content: str = "annex_content", id_column: str = "doc_id") -> DataFrame:
    """One row for each annex header of the cleaned text: number, title, header text and the body's lines that aren't blank."""
    text = docs.select(id_column, clean.annex_canonical(F.coalesce(F.col(content), F.lit(""))).alias("_t")).withColumn("_h", find_all(F.col("_t"), P.ANNEX_HEADER))
    rows = text.select(id_column, "_t", "_h", F.posexplode("_h").alias("annex_index", "x"))
    whole = strip(cut(F.col("_t"), F.col("x.start"), F.coalesce(F.get("_h", F.col("annex_index") + 1)["start"], F.length("_t"))))
    rows = rows.select(id_column, "annex_index", F.regexp_extract("x.hit", P.ANNEX_HEADER, 1).alias("annex_no"), strip(F.regexp_extract("x.hit", P.ANNEX_HEADER, 2)).alias("annex_title"), whole.alias("content"))
    n = header_size(F.col("content"))
    all_lines = lines(F.col("content"))
    body = F.filter(F.slice(all_lines, n + 1, F.greatest(F.size(all_lines) - n, F.lit(0))), lambda x: strip(x) != "")
    header = unlines(F.slice(all_lines, F.lit(1), n))
    return rows.withColumns({"header": header, "related_article": strip(F.regexp_extract(header, P.ANNEX_RELATED, 1)), "amendment_date": F.regexp_extract(header, P.ANNEX_DATED, 2), "body_lines": body})


def header_size(content: Column) -> Column:
    """How many of the first four lines are the header: the mark, the related article and the date, until a line that can't be."""
    at = lambda i: strip(F.coalesce(F.get(lines(content), i), F.lit("")))
    size, over = F.lit(0), F.lit(False)
    for i in range(4):
        line = at(i)
        is_header = F.contains(line, F.lit(P.ANNEX_MARK)) if i == 0 else F.lit(False)
        if i <= 2:
            is_header = is_header | F.contains(line, F.lit("<제")) | F.contains(line, F.lit("관련>"))
        is_header = is_header | line.rlike(r"(?d)^\[.*?\d{4}\.\d{1,2}\.\d{1,2}.*?\]")
        size = F.when(~over & is_header, i + 1).otherwise(size)
        over = over | (~is_header & (line.rlike(P.HEADER_KEYWORDS) | line.rlike(P.DIGIT_LINE)))
    return size


def hints(block_lines: Column) -> Column:
    """``struct<has_header_hint, header_keywords, numbered_count, has_numbered, rank_count, has_rank>`` of a block."""
    first = F.transform(F.slice(block_lines, 1, 5), lambda x: F.replace(x, F.lit(" ")))
    words = F.array(*[F.lit(w) for w in dict.fromkeys((*P.GENERIC_HINTS, *P.PERSONNEL_HINTS))])
    found = distinct_sorted(F.filter(words, lambda w: F.exists(first, lambda x: F.contains(x, w))))
    numbered = F.size(F.filter(block_lines, lambda x: x.rlike(r"^\s*(\d+)\.\s+")))
    ranks = F.size(F.filter(block_lines, lambda x: strip(x).rlike("^[1-9]급")))
    return F.struct((F.size(found) > 0).alias("has_header_hint"), found.alias("header_keywords"), numbered.alias("numbered_count"), (numbered >= 2).alias("has_numbered"), ranks.alias("rank_count"), (ranks >= 1).alias("has_rank"))


def block_features(block_lines: Column) -> Column:
    """``struct<digit_density, short_line_ratio, column_gap_consistency, header_hint, avg_line_length>``."""
    n, chars = F.size(block_lines), F.aggregate(block_lines, F.lit(0), lambda a, x: a + F.length(x))
    digits = F.aggregate(block_lines, F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(r"\p{Nd}")))
    short = F.size(F.filter(block_lines, lambda x: F.length(strip(x)) < SHORT))
    gaps = F.flatten(F.transform(block_lines, lambda x: F.transform(find_all(x, r"(?U)\s{2,}"), lambda m: m["start"].cast("double"))))
    count = F.size(gaps)
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / count
    spread = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (count - 1))
    even = F.when(count >= 2, F.greatest(F.lit(0.0), 1 - spread / 60)).otherwise(F.lit(0.0))
    return F.struct(ratio(digits, chars).alias("digit_density"), ratio(short, n).alias("short_line_ratio"), even.alias("column_gap_consistency"), F.coalesce(F.get(block_lines, 0).rlike(P.HEADER_KEYWORDS), F.lit(False)).alias("header_hint"), ratio(chars, n).alias("avg_line_length"))


def table_score(f: Column) -> Column:
    """How much a block with these features looks like a table."""
    return 0.4 * f["digit_density"] + 0.3 * f["short_line_ratio"] + 0.2 * f["column_gap_consistency"] + F.when(f["header_hint"], 0.1).otherwise(0.0) - F.when(f["short_line_ratio"] < 0.3, 0.05).otherwise(0.0)


class Walk:
    """The walk over one annex's lines: where blocks begin depends on where the last one ended."""

    keyword, digitish, ruled = re.compile(P.HEADER_KEYWORDS), re.compile(P.DIGITISH_LINE), re.compile(P.SEPARATOR_LINE)
    numbered, rank, gap = re.compile(r"^\s*(\d+)\.\s+"), re.compile("^[1-9]급"), re.compile(r"\s{2,}")
    words = tuple(dict.fromkeys((*P.GENERIC_HINTS, *P.PERSONNEL_HINTS)))

    def __init__(self, rows: list[str]):
        self.rows, self.n = rows, len(rows)

    def listed(self, i: int) -> bool:
        return bool(self.digitish.match(self.rows[i])) or bool(self.ruled.match(self.rows[i].strip()))

    def short(self, i: int) -> bool:
        return len(self.rows[i].strip()) < SHORT

    def features(self, a: int, b: int) -> tuple[float, float, float, bool]:
        part = self.rows[a:b]
        if not part:
            return 0.0, 0.0, 0.0, False
        chars = sum(map(len, part))
        gaps = [m.start() for x in part for m in self.gap.finditer(x)]
        even = max(0.0, 1 - stdev(gaps) / 60) if len(gaps) >= 2 else 0.0
        return sum(c.isdecimal() for x in part for c in x) / max(1, chars), sum(len(x.strip()) < SHORT for x in part) / len(part), even, bool(self.keyword.search(part[0]))

    @staticmethod
    def score(f: tuple[float, float, float, bool]) -> float:
        return 0.4 * f[0] + 0.3 * f[1] + 0.2 * f[2] + 0.1 * f[3] - 0.05 * (f[1] < 0.3)

    def blocks(self) -> list[list]:
        """``[kind, start, end, score]``, the end excluded."""
        found, i = [], 0
        width = min(WINDOW_MOST, max(WINDOW_LEAST, self.n // 3))
        while i < self.n:
            f = self.features(i, i + width)
            s = self.score(f)
            end = min(i + width, self.n)
            if s >= CANDIDATE and (s >= TABLE or f[0] >= 0.25 or f[1] > 0.8 or f[3]):
                while end < self.n and (self.listed(end) or self.short(end)):
                    end += 1
                start = i
                if s >= TABLE:
                    while start > max(0, i - GROW) and self.listed(start - 1):
                        start -= 1
                    most = min(self.n, end + GROW)
                    while end < most and (self.listed(end) or self.short(end)):
                        end += 1
                found.append(["table_rows" if s >= TABLE else "table_candidate", start, end, s])
            else:
                end = i + 1
                while end < self.n and self.score(self.features(end, end + AHEAD)) < CANDIDATE:
                    end += 1
                found.append(["paragraph", i, end, self.score(self.features(i, end))])
            i = end
        return self.refined(self.apart(found))

    @staticmethod
    def apart(found: list[list]) -> list[list]:
        """Tables that overlap or touch become one; of a paragraph, what a table took goes."""
        out: list[list] = []
        for kind, a, b, s in sorted(found, key=lambda x: (x[1], x[2])):
            if out and kind == out[-1][0] == "table_rows" and a <= out[-1][2]:
                out[-1][2], out[-1][3] = max(b, out[-1][2]), max(s, out[-1][3])
            elif out and a < out[-1][2]:
                if kind == "table_rows" and out[-1][0] != "table_rows":
                    out[-1][2] = a
                    if out[-1][1] >= a:
                        out.pop()
                    out.append([kind, a, b, s])
                elif b > out[-1][2]:
                    out.append([kind, out[-1][2], b, s])
            else:
                out.append([kind, a, b, s])
        return out

    def promoted(self, kind: str, a: int, b: int, s: float) -> str:
        """A block whose text reads like a table is one."""
        if kind == "table_rows":
            return kind
        part = self.rows[a:b]
        head = [x.replace(" ", "") for x in part[:5]]
        if not any(w in x for w in self.words for x in head):
            return kind
        if sum(bool(self.numbered.match(x)) for x in part) >= 2 or s >= PROMOTED or any(self.rank.match(x.strip()) for x in part):
            return "table_rows"
        return kind

    def refined(self, found: list[list]) -> list[list]:
        if len(found) == 1:
            kind, a, b, _ = found[0]
            s = self.score(self.features(a, b))
            return [[self.promoted(kind, a, b, s), a, b, s]]
        out, i = [], 0
        while i < len(found):
            kind, a, b, s = found[i]
            f = self.features(a, b)
            if kind == "paragraph" and f[0] > 0.35 and f[1] > 0.6:
                kind = "table_candidate"
            kind = self.promoted(kind, a, b, s)
            after = found[i + 1] if i + 1 < len(found) else None
            if kind == "table_candidate" and after and after[0] in ("table_candidate", "table_rows") and after[1] == b:
                s = self.score(self.features(a, after[2])) if after[0] == "table_candidate" else after[3]
                out.append(["table_rows", a, after[2], s])
                i += 2
                continue
            out.append(["paragraph" if kind == "table_candidate" else kind, a, b, s])
            i += 1
        return out


def blocks(body_lines: Column) -> Column:
    """``array<struct<kind, start, end, score>>`` of an annex's lines, in order, the end excluded."""

    @F.pandas_udf(BLOCKS)
    def walk(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: [{"kind": k, "start": a, "end": b, "score": round(s, 6)} for k, a, b, s in Walk([] if x is None else list(x)).blocks()])

    return walk(body_lines)


def boundaries(block_lines: Column) -> Column:
    """Places inside a table where another begins: a header that repeats, and what follows a note; sorted."""
    places = F.transform(block_lines, lambda x, i: F.struct(i.alias("i"), F.exists(F.array(*[F.lit(w) for w in P.BOUNDARY_WORDS]), lambda w: F.contains(F.replace(x, F.lit(" ")), w)).alias("head"), x.rlike(P.NOTE_LIKE).alias("note")))
    heads = F.transform(F.filter(places, lambda x: x["head"]), lambda x: x["i"])
    notes = F.transform(F.filter(places, lambda x: x["note"]), lambda x: x["i"] + 1)
    both = F.concat(F.slice(heads, 2, F.greatest(F.size(heads) - 1, F.lit(0))), notes)
    return distinct_sorted(F.filter(both, lambda i: (i > 0) & (i < F.size(block_lines))))


def chunks(annex_sections: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The chunks of each annex in order: its header, then its blocks, tables split at their boundaries, and the note that ends the last one."""
    placed = annex_sections.withColumn("_blocks", blocks(F.col("body_lines")))
    body = F.col("body_lines")

    def split(b: Column) -> Column:
        def parts(part: Column) -> Column:
            cuts = F.concat(F.array(F.lit(0)), F.when(b["kind"] == "table_rows", boundaries(part)).otherwise(F.array().cast("array<int>")), F.array(F.size(part)))
            return let(cuts, lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda at, i: F.struct(b["kind"].alias("kind"), F.slice(part, at + 1, F.get(c, i + 1) - at).alias("l"))))

        return let(F.slice(body, b["start"] + 1, b["end"] - b["start"]), parts)

    refined = placed.withColumn("_parts", F.filter(F.flatten(F.transform("_blocks", split)), lambda x: F.size(x["l"]) > 0))
    parts = F.col("_parts")
    last = F.get(parts, F.size(parts) - 1)
    starred = F.transform(F.filter(F.transform(last["l"], lambda x, i: F.struct(i.alias("i"), strip(x).rlike(P.NOTE_LINE).alias("n"))), lambda x: x["n"]), lambda x: x["i"])
    refined = refined.withColumn("_note", F.when(F.size(starred) > 0, F.get(starred, 0)))
    note = F.col("_note")
    made = lambda kind, ls: F.struct(kind.alias("section_type"), strip(unlines(ls)).alias("content"))
    before = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: made(x["kind"], x["l"]))
    end = F.when(F.size(parts) == 0, F.array().cast("array<struct<section_type:string,content:string>>")).when(note.isNull(), F.array(made(last["kind"], last["l"]))).otherwise(F.array(made(last["kind"], F.slice(last["l"], F.lit(1), note)), made(F.lit("note"), F.slice(last["l"], note + 1, F.size(last["l"]) - note))))
    every = F.filter(F.concat(F.array(F.struct(F.lit("header").alias("section_type"), strip(F.col("header")).alias("content"))), before, end), lambda x: x["content"] != "")
    out = refined.select(id_column, "annex_index", "annex_no", F.posexplode(every).alias("chunk_order", "c"))
    return out.select(id_column, "annex_index", "annex_no", "chunk_order", "c.section_type", "c.content", F.length("c.content").alias("char_count"))


def label(section_type: Column, content: Column, char_count: Column) -> Column:
    """Which logical table a chunk says it belongs to; a short table chunk that doesn't say may be a fragment."""
    bare = F.regexp_replace(content, "[ \n]", "")
    return F.when(F.contains(bare, F.lit(LABELS[0])), LABELS[0]).when(F.contains(bare, F.lit(LABELS[1])) & ~F.contains(bare, F.lit("제외")), LABELS[1]).when((section_type == "table_rows") & (char_count < FRAGMENT), UNKNOWN)


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Rows of both sides agree on the names, nulls among them."""
    found = F.lit(True)
    for n in names:
        found = found & left[n].eqNullSafe(right[n])
    return found


def propagate(rows: DataFrame, key: list[str], order: str, value: str, is_open: Column, out: str, heavy: int | None = HEAVY) -> DataFrame:
    """Adds ``out``: the value, or where the row is open the nearest one before it that is not, else the nearest after, else its own.

    Rows of a key meet in one window. A key of more than ``heavy`` rows is cut
    into ranges of ``order`` (:func:`regulus.operators.asof.parted`): windows are
    as long as a range, and what stands before and after it is carried in from a
    table of ranges. Other keys are left as they are.
    """
    known = F.when(~is_open, F.col(value))
    placed = parted(rows, key, order, heavy) if heavy else None
    if placed is None:
        w = Window.partitionBy(*key).orderBy(order)
        before, after = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        return rows.withColumn(out, F.when(is_open, F.coalesce(before, after, F.col(value))).otherwise(F.col(value)))
    ends = placed.where(known.isNotNull()).groupBy(*key, "_b").agg(F.max(F.struct(order, value))[value].alias("_last"), F.min(F.struct(order, value))[value].alias("_first"))
    every = placed.select(*key, "_b").distinct()
    told = every.join(ends, same(every, ends, [*key, "_b"]), "left").select(*[every[k] for k in [*key, "_b"]], "_last", "_first")
    ws = Window.partitionBy(*key).orderBy("_b")
    carried = told.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_b").alias("_kb"), F.last("_last", ignorenulls=True).over(ws.rowsBetween(Window.unboundedPreceding, -1)).alias("_in"), F.first("_first", ignorenulls=True).over(ws.rowsBetween(1, Window.unboundedFollowing)).alias("_out"))
    w = Window.partitionBy(*key, "_b").orderBy(order)
    before, after = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    local = placed.withColumns({"_before": before, "_after": after, "_known": known})
    on = F.col("_b") == F.col("_kb")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(carried, on)
    filled = F.when(is_open, F.coalesce("_before", "_in", "_after", "_out", F.col(value))).otherwise(F.col(value))
    return joined.withColumn(out, filled).select(*rows.columns, out) if out not in rows.columns else joined.withColumn(out, filled).select(*rows.columns)


def regroup(annex_chunks: DataFrame, id_column: str = "doc_id", strict_parity: bool = False) -> DataFrame:
    """Table chunks of one logical table become one chunk, at the place of the first.

    Table chunks without a label stay as they are; ``strict_parity`` drops
    them if there is any logical table, and leaves everything if there is none.
    """
    key = [id_column, "annex_index"]
    is_table = F.col("section_type") == "table_rows"
    labelled = annex_chunks.withColumn("_own", label(F.col("section_type"), F.col("content"), F.col("char_count")))
    tables = propagate(labelled.where(is_table), key, "chunk_order", "_own", F.coalesce(F.col("_own") == UNKNOWN, F.lit(False)), "table_label", heavy=None)  # a document's chunks are few
    tables = tables.withColumn("table_label", F.when(F.col("table_label") != UNKNOWN, F.col("table_label"))).drop("_own")
    group = F.coalesce("table_label", F.concat(F.lit("#"), F.col("chunk_order")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_order", "content"))), lambda x: x["content"]), "\n")
    merged = tables.withColumn("_g", group).groupBy(*key, "annex_no", "_g", "table_label").agg(joined.alias("content"), F.sum("char_count").cast("int").alias("char_count"), F.min("chunk_order").alias("_at"), F.count(F.lit(1)).cast("int").alias("merged_count"))
    merged = merged.select(*key, "annex_no", F.col("_at").alias("chunk_order"), F.lit("table_rows").alias("section_type"), "content", "char_count", "table_label", "merged_count")
    if strict_parity:
        any_label = F.max(F.col("table_label").isNotNull()).over(Window.partitionBy(*key))
        merged = merged.withColumn("_any", any_label).where(F.col("table_label").isNotNull() | ~F.col("_any")).drop("_any")
    others = annex_chunks.where(~is_table).withColumns({"table_label": F.lit(None).cast("string"), "merged_count": F.lit(1)})
    return others.select(merged.columns).unionByName(merged)


def merge_intervals(rows: DataFrame, key: str, start: str, end: str, score: str, heavy: int | None = HEAVY) -> DataFrame:
    """Intervals of a key that overlap or touch become one, with the largest score: ``key, start, end, score, merged``.

    A key of more than ``heavy`` rows is cut into ranges of ``start``, as
    :func:`propagate` does: the reach and the number of runs so far are carried
    into a range from a table of ranges.
    """
    placed = parted(rows, [key], start, heavy) if heavy else None
    if placed is None:
        w = Window.partitionBy(key).orderBy(start, end)
        reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        runs = rows.withColumn("_apart", F.when(F.col(start) <= reach + 1, 0).otherwise(1)).withColumn("_run", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ws = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        ends = placed.groupBy(key, "_b").agg(F.max(end).alias("_e")).select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.max("_e").over(ws).alias("_in"))
        w = Window.partitionBy(key, "_b").orderBy(start, end)
        on = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb"))
        reach = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_in"))
        local = placed.join(ends, on).withColumn("_apart", F.when(F.col(start) <= reach + 1, 0).otherwise(1)).drop("_k", "_kb")
        # counted in the same order as above, as equal intervals may stand in another one after a join
        local = local.withColumn("_so_far", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        before = local.groupBy(key, "_b").agg(F.sum("_apart").alias("_n")).select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(ws), F.lit(0)).alias("_runs"))
        runs = local.join(before, on).withColumn("_run", F.col("_runs") + F.col("_so_far"))
    return runs.groupBy(key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.max(score).alias(score), F.count(F.lit(1)).alias("merged")).drop("_run")


def with_fallback(annex_chunks: DataFrame, annexes: DataFrame, valid: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Chunks of annexes that ``valid(id, is_valid)`` passes; the whole annex as one chunk where it doesn't, or where there are none."""
    good = valid.where("is_valid").select(id_column)
    kept = annex_chunks.join(good, id_column, "left_semi").select(id_column, F.row_number().over(Window.partitionBy(id_column).orderBy("annex_index", "chunk_order")).alias("annex_order"), "section_type", "content", F.lit(False).alias("is_fallback"))
    whole = annexes.join(good, id_column, "left_anti").select(id_column, F.lit(1).alias("annex_order"), F.lit("whole").alias("section_type"), F.col("annex_content").alias("content"), F.lit(True).alias("is_fallback"))
    return kept.unionByName(whole)

"""Chunks for retrieval: by meaning, by line, by length, and from parsed documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regulus.functions import patterns as P
from regulus.functions.text import cut, distinct_sorted, find_all, let, lines, strip
from regulus.operators import clean, tables

#: Characters: a chunk has so many at least; one with fewer than a fragment joins the one before; what a chunk by length aims at.
LEAST, FRAGMENT, TARGET = 100, 200, 512
#: Strict headers from which loose ones are not looked for; characters around a header that are looked at.
ENOUGH, CONTEXT = 5, 50

BOUNDARY = "array<struct<pos:int,rank:int,kind:string,matched:string,title:string>>"


def boundaries(text: Column) -> Column:
    """``array<struct<pos, rank, kind, matched, title>>`` in order: preamble, articles, chapters; loose articles only where strict ones are few."""
    def of(pattern: str, kind: str, rank: int, all_: bool = True) -> Column:
        found = find_all(text, pattern)
        found = found if all_ else F.slice(found, 1, 1)

        def one(x: Column) -> Column:
            matched = strip(F.regexp_extract(x["hit"], pattern, 1))
            near = F.substring(text, x["start"] + 1, F.lit(CONTEXT))
            title = F.when(F.lit(kind == "article"), F.regexp_extract(F.substring(near, F.instr(near, matched) + F.length(matched), F.lit(CONTEXT)), r"^\s*\(([^)]+)\)", 1)).otherwise(F.lit(""))
            return F.struct(x["start"].alias("pos"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (F.lit("기본정신") if kind == "basic" else matched).alias("matched"), F.when(title == "", F.lit(None)).otherwise(title).alias("title"))

        return F.transform(found, one).cast(BOUNDARY)

    def articles(strict: Column) -> Column:
        def all_(named: Column) -> Column:
            loose = F.filter(of(P.LOOSE, "article_loose", 2), lambda x: ~F.array_contains(named, x["matched"]) & ~inline_reference(text, x["pos"], x["matched"]))
            return F.concat(strict, F.when(F.size(named) < ENOUGH, loose).otherwise(F.array().cast(BOUNDARY)))

        return let(F.array_distinct(F.transform(strict, lambda x: x["matched"])), all_)

    return F.array_sort(F.concat(of(P.PREAMBLE, "basic", 0, all_=False), let(of(P.STRICT, "article", 1), articles), of(P.CHAPTER_LINE, "chapter", 3)))


def inline_reference(text: Column, pos: Column, matched: Column) -> Column:
    """A header that is only mentioned: references stand near it, or a letter right before it."""
    start = F.greatest(pos - CONTEXT, F.lit(0))
    near = cut(text, start, F.least(pos + F.length(matched) + CONTEXT, F.length(text)))
    return near.rlike(P.INLINE_REFERENCE) | ((pos > 0) & F.substring(text, pos, F.lit(1)).rlike(P.HANGUL))


def pieces(docs: DataFrame, text: str = "text", id_column: str = "doc_id", least: int = LEAST) -> DataFrame:
    """One row for each boundary whose piece, up to the next one, has ``least`` characters; what is before the first one goes."""
    t = clean.line_breaks(F.coalesce(F.col(text), F.lit("")))
    b = docs.select(id_column, t.alias("_t")).withColumn("_b", boundaries(F.col("_t")))
    content = lambda x, i: strip(cut(F.col("_t"), x["pos"], F.coalesce(F.get("_b", i + 1)["pos"], F.length("_t"))))
    rows = F.filter(F.transform("_b", lambda x, i: F.struct(x["kind"].alias("kind"), x["matched"].alias("boundary"), x["title"].alias("title"), x["pos"].alias("pos"), content(x, i).alias("content"))), lambda x: F.length(x["content"]) >= least)
    out = b.select(id_column, F.posexplode(rows).alias("i", "c"))
    return out.select(id_column, (F.col("i") + 1).alias("chunk_index"), F.col("c.kind").alias("type"), "c.boundary", "c.title", "c.pos", "c.content", F.length("c.content").alias("char_count"))


def merge_fragments(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_index", content: str = "content", least: int = FRAGMENT) -> DataFrame:
    """A chunk shorter than ``least`` joins the last one before it that stays; a short first one stays.

    Chunks of a document meet by its key; runs are numbered by a running sum.
    The columns of a run are those of its first chunk.
    """
    w = Window.partitionBy(key).orderBy(order)
    starts = (F.length(content) >= least) | (F.row_number().over(w) == 1)
    runs = chunks.withColumn("_run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in chunks.columns if c not in (key, order, content, "char_count")]
    merged = runs.groupBy(key, "_run").agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c")))), lambda x: x["c"]), "\n\n").alias(content))
    return merged.drop("_run").withColumn("char_count", F.length(content))


def headers(text: Column) -> Column:
    """The distinct strict and loose headers that begin a line or follow a space or bracket, sorted."""
    loose = F.filter(find_all(text, P.LOOSE), lambda x: (x["start"] == 0) | F.substring(text, x["start"], F.lit(1)).rlike(r"[\n ⟨<\[]"))
    return distinct_sorted(F.concat(F.transform(F.regexp_extract_all(text, F.lit(P.STRICT), F.lit(1)), strip), F.transform(loose, lambda x: strip(F.regexp_extract(x["hit"], P.LOOSE, 1)))))


def by_length(docs: DataFrame, text: str = "text", id_column: str = "doc_id", target: int = TARGET, least: int = LEAST) -> DataFrame:
    """Chunks of about ``target`` characters that end at a paragraph, a line or a sentence if there is one to end at.

    Where a chunk ends depends on where the last one did, so a vectorised
    function walks each text; texts are independent, and nothing is shuffled.
    """
    rows = docs.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("_t"))

    def ends(t: str):
        at = 0
        while at < len(t):
            end = min(at + target, len(t))
            if end < len(t):
                for mark in ("\n\n", "\n", ". ", "。"):
                    if (last := t.rfind(mark, at, end)) > at:
                        end = last + len(mark)
                        break
            yield at, end
            at = end

    def walk(batches):
        for b in batches:
            out = []
            for key, t in zip(b.iloc[:, 0], b["_t"]):
                kept = [c for a, e in ends(t) if len(c := t[a:e].strip()) >= least]
                out += [(key, i, c, len(c)) for i, c in enumerate(kept, 1)]
            yield pd.DataFrame(out, columns=[id_column, "chunk_index", "content", "char_count"])

    return rows.mapInPandas(walk, f"`{id_column}` {rows.schema[0].dataType.simpleString()}, chunk_index int, content string, char_count int")


def semantic(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Chunks by boundaries with fragments merged; texts that have none are cut by length."""
    found = merge_fragments(pieces(docs, text, id_column), id_column)
    rest = docs.join(found.select(id_column).distinct(), id_column, "left_anti")
    lengths = by_length(rest.withColumn("_clean", clean.line_breaks(F.coalesce(F.col(text), F.lit("")))), "_clean", id_column)
    lengths = lengths.withColumns({"type": F.lit("fallback"), "boundary": F.lit("length-based"), "title": F.lit(None).cast("string"), "pos": F.lit(None).cast("int")})
    return found.unionByName(lengths)


def loose_share(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The share of chunks at loose headers, and whether it is so high that the text should be looked at."""
    share = F.avg((F.col("type") == "article_loose").cast("int"))
    return chunks.groupBy(key).agg(share.alias("loose_ratio"), (share > 0.3).alias("loose_ratio_high"))


def line_header(line: Column) -> Column:
    """``struct<no, title>`` of a line that is an article header, or null."""
    s = strip(line)

    def of(p: str, titled: bool) -> Column:
        again = F.regexp_extract(s, p, 2)
        no = F.concat(F.lit("제"), F.regexp_extract(s, p, 1), F.lit("조"), F.when(again != "", F.concat(F.lit("의"), again)).otherwise(F.lit("")))
        return F.when(s.rlike(p), F.struct(no.alias("no"), (F.regexp_extract(s, p, 3) if titled else F.lit("")).alias("title")))

    return F.coalesce(*[of(p, i < 2) for i, p in enumerate(P.LINE_HEADERS)])


def by_line(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """A chunk begins at each article header and at each special section; articles carry their number and title.

    What follows a special section belongs to it up to the next header. What
    comes before the first header is a chunk without a number.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    line = F.transform(lines(t), lambda x: F.struct(x.alias("l"), line_header(x).alias("h"), F.get(F.filter(F.array(*[F.lit(s) for s in P.SPECIAL_SECTIONS]), lambda s: F.contains(strip(x), s)), 0).alias("s")))
    rows = docs.select(id_column, F.posexplode(line).alias("p", "x"))
    w = Window.partitionBy(id_column).orderBy("p")
    starts = F.col("x.s").isNotNull() | F.col("x.h").isNotNull() | (F.col("p") == 0)
    runs = rows.withColumn("_run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.min_by("x", "p")
    out = runs.groupBy(id_column, "_run").agg(head.alias("x"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "x.l"))), lambda y: y["l"]), "\n").alias("c"))
    special, header = F.col("x.s"), F.when(F.col("x.s").isNull(), F.col("x.h"))
    return out.select(id_column, F.col("_run").cast("int").alias("chunk_index"), special.alias("section_type"), header["no"].alias("article_no"), F.when(header["title"] != "", header["title"]).alias("article_title"), strip(F.col("c")).alias("content"), F.length(strip(F.col("c"))).alias("char_count"))



def parsed_chunks(rows: DataFrame, annex: Column | None = None, preamble: str | None = None) -> Column:
    """``array<struct<type, content, article_number, article_title, chapter_number>>`` in reading order, of a row of :func:`regulus.operators.structure.wide`.

    Title, amendments, preamble, then articles with each chapter before its
    first article, then the chunks of ``annex``, an array of (type, content); by
    default that of the whole annex.
    """
    none = F.lit(None).cast("string")
    kind = "array<struct<type:string,content:string,article_number:string,article_title:string,chapter_number:string>>"

    def made(type_: str | Column, content: Column, number: Column = none, title: Column = none, chapter: Column = none) -> Column:
        type_ = F.lit(type_) if isinstance(type_, str) else type_
        return F.struct(type_.alias("type"), content.alias("content"), number.alias("article_number"), title.alias("article_title"), chapter.alias("chapter_number"))

    some = lambda when, *these: F.when(when, F.array(*these).cast(kind)).otherwise(F.array().cast(kind))
    articles = F.col("articles")
    history = F.array_join(F.transform("amendments", lambda x: F.concat_ws(" ", x["kind"], x["date"])), "\n")

    def of(numbers: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            number = a["chapter_number"]
            heads = F.when((number != "") & (F.array_position(numbers, number) == i + 1), F.slice(F.filter("chapters", lambda c: c["number"] == number), 1, 1))
            before = F.coalesce(F.transform(heads, lambda c: made("chapter", F.concat_ws(" ", c["number"], c["title"]), chapter=c["number"])).cast(kind), F.array().cast(kind))
            return F.concat(before, F.array(made("article", F.concat(a["number"], F.lit("("), a["title"], F.lit(")\n"), a["clean_body"]), a["number"], a["title"], number)).cast(kind))

        return F.flatten(F.transform(articles, one))

    whole = some(F.col("annex_content") != "", made("annex_whole", F.col("annex_content")))
    parts = [
        some(F.coalesce("title", F.lit("")) != "", made("title", F.col("title"))),
        some(F.size("amendments") > 0, made("amendment_history", history)),
        *([some(F.col(preamble) != "", made("basic_spirit", F.col(preamble)))] if preamble else []),
        let(F.transform(articles, lambda a: a["chapter_number"]), of),
        whole if annex is None else F.transform(annex, lambda x: made(x["type"], x["content"])).cast(kind),
    ]
    return F.concat(*parts)


def exploded(rows: DataFrame, chunks: str = "chunks", key: str = "doc_id") -> DataFrame:
    """A row for each chunk of an array of chunks, with ``chunk_pos``, its place from 0, and ``char_count``."""
    out = rows.select(key, F.posexplode(chunks).alias("chunk_pos", "c")).select(key, "chunk_pos", "c.*")
    return out.withColumn("char_count", F.length("content"))


def table_rows(content: Column) -> Column:
    """``array<struct<type, content>>``: a chunk for each row that is parsed in a table's text; none if there are none."""
    return F.transform(tables.extracted(content), lambda r: F.struct(F.lit("table_row").alias("type"), F.concat(r["n"].cast("string"), F.lit("명 → "), r["rank"].cast("string"), F.lit("번까지")).alias("content")))


def annex_parts(annex_chunks: DataFrame, key: str = "doc_id", rows: bool = True) -> DataFrame:
    """``(key, annex_parts)`` of ``annex_chunks(key, annex_order, section_type, content, is_fallback)``: the chunks of a document's annex in order, tables as one chunk for each parsed row where ``rows`` is asked for and there are any."""
    kind = F.when(F.col("is_fallback"), F.lit("annex")).otherwise(F.concat(F.lit("annex_"), F.col("section_type")))
    whole = F.array(F.struct(kind.alias("type"), F.col("content").alias("content")))
    made = F.when(kind == "annex_table_rows", table_rows(F.col("content"))) if rows else F.lit(None).cast("array<struct<type:string,content:string>>")
    parts = annex_chunks.select(key, "annex_order", F.when(F.size(made) > 0, made).otherwise(whole).alias("parts"))
    ordered = F.array_sort(F.collect_list(F.struct("annex_order", "parts")))
    return parts.groupBy(key).agg(F.flatten(F.transform(ordered, lambda x: x["parts"])).alias("annex_parts"))


def type_counts(chunks: DataFrame, key: str | None = None) -> DataFrame:
    kind = F.coalesce("type", F.lit("unknown")).alias("type")
    return chunks.groupBy(*([key] if key else []), kind).agg(F.count(F.lit(1)).alias("chunks"))


def type_totals(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Chunks and their characters by type and by each choice of the columns ``by``, in one pass: with all subtotals.

    ``grouping`` has a bit for each column, the type's the lowest, set where a
    row is about all of its values, so a null value is told apart from a total.
    """
    kind = chunks.select(*by, F.coalesce("type", F.lit("unknown")).alias("type"), F.length("content").cast("long").alias("n"))
    return kind.cube(*by, "type").agg(F.grouping_id().cast("long").alias("grouping"), F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("chars"))

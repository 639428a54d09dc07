"""Chapters, articles, amendments and annexes of regulation texts.

A document is parsed inside its row: matches and their places are arrays, the
chapter of an article is the last one that starts before it, and child tables
come from exploding the arrays. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.functions import patterns as P
from regulus.functions.text import cut, distinct_sorted, find_all, firsts, let, strip
from regulus.operators import clean


def article_array(text: Column) -> Column:
    """``array<struct<number, title, start, body_start, body_end, body, chapter>>`` in order of place.

    The first occurrence of a number is the article, later ones are references
    inside bodies. The last body stops at the first annex.
    """
    hits = F.transform(find_all(text, P.ARTICLE), lambda x: F.struct(F.regexp_extract(x["hit"], P.ARTICLE, 1).alias("number"), F.regexp_extract(x["hit"], P.ARTICLE, 2).alias("title"), x["start"].alias("start"), x["end"].alias("end")))

    def bodies(known: Column) -> Column:
        found, chapters = known["found"], known["chapters"]

        def end_of(x: Column, i: Column) -> Column:
            rest = F.substring(text, x["end"] + 1, F.length(text))
            mark = F.instr(rest, P.ANNEX_MARK)
            return F.coalesce(F.get(found, i + 1)["start"], F.when(mark > 0, x["end"] + mark - 1).otherwise(F.length(text)))

        def chapter_of(x: Column) -> Column:
            return let(F.filter(chapters, lambda c: c["start"] < x["start"]), lambda before: F.coalesce(F.get(before, F.size(before) - 1)["name"], F.lit("")))

        def one(x: Column, i: Column) -> Column:
            return let(end_of(x, i), lambda end: F.struct(x["number"].alias("number"), x["title"].alias("title"), x["start"].alias("start"), x["end"].alias("body_start"), end.alias("body_end"), strip(cut(text, x["end"], end)).alias("body"), chapter_of(x).alias("chapter")))

        return F.transform(found, one)

    return let(F.struct(firsts(hits, "number").alias("found"), chapter_array(text).alias("chapters")), bodies)


def chapter_array(text: Column) -> Column:
    """``array<struct<start, number, title, name>>``; a heading's title may stand on the next line."""
    def one(x: Column) -> Column:
        number, title = F.regexp_extract(x["hit"], P.CHAPTER, 1), strip(F.regexp_extract(x["hit"], P.CHAPTER, 2))
        name = F.concat(number, F.when(title != "", F.concat(F.lit(" "), title)).otherwise(F.lit("")))
        return F.struct(x["start"].alias("start"), F.regexp_replace(number, r"\s", "").alias("number"), title.alias("title"), name.alias("name"))

    return F.transform(find_all(text, P.CHAPTER), one)


def articles(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row for each article: place, title, chapter, body and cleaned body, dates of amendment, whether it is deleted."""
    rows = docs.select(id_column, F.posexplode(article_array(F.coalesce(F.col(text), F.lit("")))).alias("section_order", "a"))
    body = F.col("a.body")
    return rows.select(
        id_column,
        "section_order",
        F.col("a.number").alias("article_number"),
        F.col("a.title").alias("article_title"),
        F.col("a.chapter").alias("chapter"),
        number_of(F.col("a.chapter")).alias("chapter_number"),
        body.alias("body"),
        clean.article_body(body).alias("clean_body"),
        distinct_sorted(F.regexp_extract_all(body, F.lit(P.AMENDED), F.lit(1))).alias("amended_dates"),
        body.rlike(P.DELETED).alias("is_deleted"),
        F.col("a.start").alias("start_pos"),
        F.col("a.body_end").alias("end_pos"),
    )


def chapters(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row for each chapter number, at its first heading."""
    found = chapter_array(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(id_column, F.posexplode(firsts(found, "number")).alias("section_order", "c"))
    return rows.select(id_column, "section_order", F.col("c.number").alias("chapter_number"), F.col("c.title").alias("chapter_title"), F.col("c.start").alias("start_pos"))


def clause_array(body: Column) -> Column:
    """``array<struct<clause_no, start, items>>``: the clauses of a body, each with the numbers of its items."""
    clauses = F.transform(find_all(body, P.CLAUSE), lambda x: F.struct(F.regexp_extract(x["hit"], P.CLAUSE, 1).alias("clause_no"), x["start"].alias("start")))
    items = F.transform(find_all(body, P.ITEM), lambda x: F.struct(F.regexp_extract(x["hit"], P.ITEM, 1).alias("item_no"), x["start"].alias("start")))

    def nested(known: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            until = F.coalesce(F.get(known["clauses"], i + 1)["start"], F.length(body))
            inside = F.filter(known["items"], lambda x: (x["start"] >= c["start"]) & (x["start"] < until))
            return F.struct(c["clause_no"].alias("clause_no"), c["start"].alias("start"), F.transform(inside, lambda x: x["item_no"]).alias("items"))

        return F.transform(known["clauses"], one)

    return let(F.struct(clauses.alias("clauses"), items.alias("items")), nested)


def tree(article_rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Articles with their clauses and items as nested nodes, each naming its parents, and flags of empty and bleeding bodies."""
    made = F.transform(clause_array(F.col("body")), lambda c: F.struct(F.lit("clause").alias("level"), c["clause_no"].alias("clause_no"), F.col("article_number").alias("parent_article_no"), F.transform(c["items"], lambda i: F.struct(F.lit("item").alias("level"), i.alias("item_no"), F.col("article_number").alias("parent_article_no"), c["clause_no"].alias("parent_clause_no"))).alias("children")))
    empty = F.col("clean_body") == ""
    bleeds = F.col("body").rlike(r"(?m)^제\d+조(?:의\d+)?\s*[\(\[]") | F.col("clean_body").rlike(r"(?m)^제\s*\d+\s*장\s")
    return article_rows.withColumns({"children": made, "has_empty_content": empty, "has_cross_bleed": bleeds})


def amendment_array(t: Column, strict_parity: bool = False) -> Column:
    """``array<struct<y, m, d, i, kind, date>>``: the amendments of a text, latest first."""
    each = P.AMENDMENTS if strict_parity else (P.AMENDMENTS[0], P.AMENDMENTS[1], P.AMENDMENTS[3], P.BARE_AMENDMENT)
    hits = F.concat(*[F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, P.KIND_AND_DATE, 1).alias("kind"), F.regexp_replace(F.regexp_extract(x, P.KIND_AND_DATE, 2), r"\.+$", "").alias("date"))) for p in each])
    known = (lambda a, x: F.exists(a, lambda h: F.contains(F.concat(h["kind"], F.lit(" "), h["date"]), x["date"]))) if strict_parity else (lambda a, x: F.exists(a, lambda h: h["date"] == x["date"]))
    once = F.aggregate(hits, F.array().cast("array<struct<kind:string,date:string>>"), lambda a, x: F.when(known(a, x), a).otherwise(F.concat(a, F.array(x))))
    part = lambda x, k: F.split(x["date"], r"\.")[k].cast("int")
    return F.array_sort(F.transform(once, lambda x, i: F.struct((-part(x, 0)).alias("y"), (-part(x, 1)).alias("m"), (-part(x, 2)).alias("d"), i.alias("i"), x["kind"].alias("kind"), x["date"].alias("date"))))


def amendments(docs: DataFrame, text: str = "text", id_column: str = "doc_id", strict_parity: bool = False) -> DataFrame:
    """One row for each amendment, latest first: ``amendment_order``, ``kind``, ``amendment_date``.

    By default a date is whole and each is listed once; the first pattern that
    has it names the kind, bare dates coming last. ``strict_parity`` lets a bare
    date lose its last digit before a closing bracket and drops dates that
    stand inside others.
    """
    ranked = amendment_array(F.coalesce(F.col(text), F.lit("")), strict_parity)
    return docs.select(id_column, F.posexplode(ranked).alias("amendment_order", "a")).select(id_column, "amendment_order", F.col("a.kind").alias("kind"), F.col("a.date").alias("amendment_date"))


def annex_text(t: Column) -> Column:
    """What a text holds from its first annex mark on; empty without one."""
    return strip(F.regexp_extract(t, r"(\[별표\s*\d+\][\s\S]+)", 1))


def number_of(chapter: Column) -> Column:
    """The number of a chapter, without white space, from its name."""
    return F.regexp_replace(F.regexp_extract(chapter, r"^(제\s*\d+\s*장)", 1), r"\s", "")


def wide(docs: DataFrame, text: str = "text", title: str = "title", id_column: str = "doc_id") -> DataFrame:
    """One row for each document with all that its rendering needs, parsed once.

    ``title``, ``amendments`` (kind, date), ``articles`` (number, title,
    chapter_number, clean_body), ``chapters`` (number, title; each number at its
    first heading) and ``annex_content`` (empty without one).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    one = lambda a: F.struct(a["number"].alias("number"), a["title"].alias("title"), number_of(a["chapter"]).alias("chapter_number"), clean.article_body(a["body"]).alias("clean_body"))
    return docs.select(
        id_column,
        F.col(title).alias("title"),
        F.transform(amendment_array(t), lambda x: F.struct(x["kind"].alias("kind"), x["date"].alias("date"))).alias("amendments"),
        F.transform(article_array(t), one).alias("articles"),
        F.transform(firsts(chapter_array(t), "number"), lambda c: F.struct(c["number"].alias("number"), c["title"].alias("title"))).alias("chapters"),
        annex_text(t).alias("annex_content"),
    )


def annex(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``annex_content`` from the first annex mark to the end, with number, title and related article of the first header."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(id_column, annex_text(t).alias("annex_content")).where("annex_content <> ''")
    c = F.col("annex_content")
    return found.withColumns({"annex_no": F.regexp_extract(c, P.ANNEX_HEADER, 1), "annex_title": strip(F.regexp_extract(c, P.ANNEX_HEADER, 2)), "related_article": strip(F.regexp_extract(c, P.ANNEX_RELATED, 1))})


def parsed(docs: DataFrame, text: str = "text", title: str = "title", id_column: str = "doc_id") -> DataFrame:
    """One wide row for each document, with its chapters, articles, amendments and annex nested."""
    t = F.coalesce(F.col(text), F.lit(""))
    kind = F.when(t.rlike(r"제\d+조"), "legal").when(t.rlike(r"\[별표"), "annex_only").otherwise("unknown")
    base = docs.withColumn("document_kind", kind)
    nested = base.withColumns({"articles": F.when(kind == "legal", article_array(t)).otherwise(F.array().cast("array<struct<number:string,title:string,start:int,body_start:int,body_end:int,body:string,chapter:string>>")), "basic_spirit": F.when(kind == "unknown", F.substring(t, 1, 500)).otherwise(F.lit(""))})
    return nested.withColumns({"total_articles": F.size("articles"), "total_chapters": F.when(kind == "legal", F.size(F.array_distinct(F.transform(chapter_array(t), lambda x: x["number"])))).otherwise(0)})

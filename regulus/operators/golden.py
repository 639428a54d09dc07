"""Golden files: what a parsed document looked like when it was right, and what has changed since."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulus.functions.text import lines, ratio, strip
from regulus.operators import clean

#: Shares that must agree: of the structure, of headers, of contents.
STRUCTURE, HEADER, CONTENT = 1.0, 0.95, 0.90
#: Means that a benchmark must stay below: seconds, and megabytes (fixed values).
LIMITS = {"parse_sec": 5.0, "golden_create_sec": 2.0, "golden_compare_sec": 1.0, "total_sec": 10.0, "memory_mb": 500.0}
CLAUSE_STARTS = ("①", "②", "③", "1.", "2.", "3.")


def article_structure(articles: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each article whether it has clauses, how many lines begin one, and its length."""
    starts = lambda x: F.exists(F.array(*[F.lit(s) for s in CLAUSE_STARTS]), lambda s: F.startswith(strip(x), s))
    body = F.col("body")
    return articles.select(key, "section_order", "article_number", "article_title", "chapter_number", (F.contains(body, F.lit("①")) | F.contains(body, F.lit("1."))).alias("has_clauses"), F.size(F.filter(lines(body), starts)).alias("clause_count"), F.length(body).alias("content_length"))


def chapter_structure(chapters: DataFrame, articles: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each chapter how many articles it has."""
    n = articles.groupBy(key, "chapter_number").agg(F.count(F.lit(1)).alias("article_count"))
    return chapters.join(n, [key, "chapter_number"], "left").select(key, "section_order", "chapter_number", "chapter_title", F.coalesce("article_count", F.lit(0)).cast("long").alias("article_count"))


def content(articles: DataFrame, title: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each document its normalised text, the length before that, and the checksum."""
    one = F.concat("article_number", F.lit("("), "article_title", F.lit(")\n"), "body", F.lit("\n"))
    bodies = articles.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_order", one.alias("c")))), lambda x: x["c"]), "").alias("c"))
    full = title.select(key, "title").join(bodies, key, "left").select(key, F.concat(F.coalesce("title", F.lit("")), F.coalesce("c", F.lit(""))).alias("full"))
    return full.select(key, clean.golden(F.col("full")).alias("normalized_text"), F.length("full").alias("total_char_count")).withColumn("checksum", clean.checksum(F.col("normalized_text")))


def diff(golden: DataFrame, current: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, section_order, article_number, article_title, body)`` on both sides -> one row for each document.

    Structure: article numbers in the same places. Headers: numbers with their
    titles, of all that either side has. Content: bodies equal once normalised.
    """
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(key, "article_number", F.col("section_order").alias(f"at_{s}"), F.col("article_title").alias(f"title_{s}"), F.md5(F.encode(clean.golden(F.col("body")), "UTF-8")).alias(f"body_{s}"))

    both = side(golden, "g").join(side(current, "c"), [key, "article_number"], "full_outer")
    same = lambda c: F.sum(F.coalesce((F.col(f"{c}_g") == F.col(f"{c}_c")).cast("int"), F.lit(0)))
    n = F.count(F.lit(1))
    out = both.groupBy(key).agg(n.alias("articles"), F.sum(F.col("at_c").isNull().cast("int")).cast("long").alias("missing"), F.sum(F.col("at_g").isNull().cast("int")).cast("long").alias("added"), ratio(same("at"), n).alias("structure_score"), ratio(same("title"), n).alias("header_score"), ratio(same("body"), n).alias("content_score"))
    return out.withColumns({"overall_score": (F.col("structure_score") + F.col("header_score") + F.col("content_score")) / 3, "overall_pass": (F.col("structure_score") >= STRUCTURE) & (F.col("header_score") >= HEADER) & (F.col("content_score") >= CONTENT)})


def benchmark_summary(results: DataFrame) -> DataFrame:
    """One row for ``results`` with the columns of ``LIMITS``, one row for each document: their count, rounded means (zero for none), and whether all means are below their limits."""
    mean = {c: F.coalesce(F.avg(c), F.lit(0.0)) for c in LIMITS}
    digits = {c: 2 if c == "memory_mb" else 3 for c in LIMITS}
    below = [mean[c] < most for c, most in LIMITS.items()]
    passed = below[0]
    for x in below[1:]:
        passed = passed & x
    return results.agg(F.count(F.lit(1)).alias("total_documents"), *[F.round(m, digits[c]).alias(c) for c, m in mean.items()], passed.alias("all_pass"))


def records(rows: DataFrame, key: str = "doc_id", parser_version: str = "1", schema_version: str = "1.0", verified: tuple[str, str] = ("", ""), preamble: str | None = None) -> DataFrame:
    """``(key, metadata, structure, headers, content)``: a golden record for each row of :func:`regulus.operators.structure.wide`, of the types of ``RECORD``."""
    lit, articles = F.lit, F.col("articles")
    spirit = F.col(preamble) if preamble else lit("")
    starts = lambda x: F.exists(F.array(*[lit(s) for s in CLAUSE_STARTS]), lambda s: F.startswith(strip(x), s))
    head = lambda a: F.concat(a["number"], lit("("), a["title"], lit(")"))
    chapter = lambda c, i: F.struct(c["number"].alias("chapter_number"), c["title"].alias("chapter_title"), F.size(F.filter(articles, lambda a: a["chapter_number"] == c["number"])).alias("article_count"), i.alias("section_order"))
    article = lambda a, i: F.struct(
        a["number"].alias("article_number"), a["title"].alias("article_title"), F.nullif(a["chapter_number"], lit("")).alias("chapter_number"), (F.contains(a["clean_body"], lit("①")) | F.contains(a["clean_body"], lit("1."))).alias("has_clauses"),
        F.size(F.filter(lines(a["clean_body"]), starts)).alias("clause_count"), F.length(a["clean_body"]).alias("content_length"), i.alias("section_order"),
    )
    full = F.concat(F.coalesce("title", lit("")), F.array_join(F.transform(articles, lambda a: F.concat(head(a), lit("\n"), a["clean_body"], lit("\n"))), ""))
    told = rows.withColumns({"_full": full, "_normal": clean.golden(full)})
    return told.select(
        key,
        F.struct(lit(parser_version).alias("parser_version"), lit(schema_version).alias("schema_version"), F.coalesce("title", lit("")).alias("document_title"), lit("standard").alias("document_type"), lit(verified[0]).alias("golden_verified_date"), lit(verified[1]).alias("golden_verified_by"), F.col(key).cast("string").alias("source_file"), lit(0).alias("page_count"), lit(None).cast("string").alias("notes")).alias("metadata"),
        F.struct(F.size("chapters").alias("total_chapters"), F.size(articles).alias("total_articles"), (F.coalesce("title", lit("")) != "").alias("has_title"), (F.size("amendments") > 0).alias("has_amendment_history"), (spirit != "").alias("has_basic_spirit"), F.transform("chapters", chapter).alias("chapters"), F.transform(articles, article).alias("articles")).alias("structure"),
        F.struct(F.col("title"), F.size("amendments").alias("amendment_history_count"), F.nullif(F.substring(spirit, 1, 50), lit("")).alias("basic_spirit_excerpt"), F.transform("chapters", lambda c: F.concat_ws(" ", c["number"], c["title"])).alias("chapter_headers"), F.transform(articles, head).alias("article_headers")).alias("headers"),
        F.struct(F.col("_normal").alias("normalized_text"), F.map_from_entries(F.transform(articles, lambda a: F.struct(a["number"], clean.golden(a["clean_body"])))).alias("article_bodies"), F.length("_full").alias("total_char_count"), clean.checksum(F.col("_normal")).alias("checksum")).alias("content"),
    )


#: The types of a golden record, as its file holds it.
RECORD = (
    "metadata struct<parser_version:string,schema_version:string,document_title:string,document_type:string,golden_verified_date:string,golden_verified_by:string,source_file:string,page_count:int,notes:string>, "
    "structure struct<total_chapters:int,total_articles:int,has_title:boolean,has_amendment_history:boolean,has_basic_spirit:boolean,chapters:array<struct<chapter_number:string,chapter_title:string,article_count:int,section_order:int>>,articles:array<struct<article_number:string,article_title:string,chapter_number:string,has_clauses:boolean,clause_count:int,content_length:int,section_order:int>>>, "
    "headers struct<title:string,amendment_history_count:int,basic_spirit_excerpt:string,chapter_headers:array<string>,article_headers:array<string>>, "
    "content struct<normalized_text:string,article_bodies:map<string,string>,total_char_count:int,checksum:string>"
)

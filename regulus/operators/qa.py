"""Checks of what came out against what went in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.functions import patterns as P
from regulus.functions.text import contained, distinct_sorted, ratio, strip

#: Least share of headers that match, least share of characters, characters from which a text without articles is an annex.
MATCH, COVERAGE, ANNEX_CHARS = 0.95, 0.90, 500
#: Targets of the tree: layers kept at least, articles that bleed and that are empty at most.
LAYERS, BLEEDS, EMPTY = 0.95, 0.0, 0.0
#: Characters that an annex may lose.
LOSS = 0.03


def headers(text: Column) -> Column:
    """The distinct article headers of a text, without white space, sorted."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"\($", ""), r"(?U)\s+", "")
    both = F.concat(F.regexp_extract_all(text, F.lit(P.GATE_STRICT), F.lit(0)), F.regexp_extract_all(text, F.lit(P.GATE_LOOSE), F.lit(0)))
    return distinct_sorted(F.transform(both, bare))


def gate(docs: DataFrame, source: str, processed: str, least_match: Column | float = MATCH, least_coverage: float = COVERAGE) -> DataFrame:
    """Adds the comparison of the headers of two texts of a row, flags, and whether they pass."""
    a, b = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(processed), F.lit(""))
    least = F.lit(least_match) if isinstance(least_match, float) else least_match
    base = docs.withColumns({"source_articles": headers(a), "processed_articles": headers(b), "source_chars": F.length(strip(a)), "processed_chars": F.length(strip(b))})
    got, want = F.col("processed_articles"), F.col("source_articles")
    base = base.withColumns({"matched": F.array_sort(F.array_intersect(want, got)), "missing": F.array_sort(F.array_except(want, got)), "extra": F.array_sort(F.array_except(got, want))})
    base = base.withColumns({"match_rate": ratio(F.size("matched"), F.size(want)), "text_coverage": ratio(F.col("processed_chars"), F.col("source_chars")), "is_annex_mode": (F.size(want) == 0) & (F.col("source_chars") > ANNEX_CHARS)})
    annex = F.filter(F.array(F.when(F.col("text_coverage") < least_coverage, "low_coverage")), lambda x: x.isNotNull())
    legal = F.filter(F.array(F.when(F.col("match_rate") < least, "low_match_rate"), F.when(F.size("missing") > 0, "processed_missing_articles"), F.when(F.size("extra") > 0, "processed_extra_articles")), lambda x: x.isNotNull())
    base = base.withColumn("qa_flags", F.when(F.col("is_annex_mode"), annex).otherwise(legal))
    return base.withColumn("is_pass", F.when(F.col("is_annex_mode"), F.col("text_coverage") >= least_coverage).otherwise((F.col("match_rate") >= least) & (F.size("qa_flags") == 0)))


def loss(chunks: DataFrame, whole: DataFrame, key: str = "doc_id", chars: str = "char_count", total: str = "total_chars") -> DataFrame:
    """For each document of ``whole(key, total)``: what its chunks lack of it. Chunks that overlap don't lose."""
    kept = chunks.groupBy(key).agg(F.sum(chars).alias("kept_chars"), F.count(F.lit(1)).alias("chunk_count"))
    both = whole.select(key, total).join(kept, key, "left").withColumns({"kept_chars": F.coalesce("kept_chars", F.lit(0)).cast("long"), "chunk_count": F.coalesce("chunk_count", F.lit(0)).cast("long")})
    return both.withColumn("loss_rate", ratio(F.greatest(F.col(total) - F.col("kept_chars"), F.lit(0)), F.col(total))).withColumn("is_valid", F.col("loss_rate") <= LOSS)


def validated(chunks: DataFrame, whole: DataFrame, key: str = "doc_id", kind: str = "section_type", chars: str = "char_count", total: str = "total_chars") -> DataFrame:
    """:func:`loss` with the reason, the count of chunks by type, and whether there is a header and some content."""
    types = chunks.groupBy(key, kind).count().groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "count")))).alias("type_counts"))
    out = loss(chunks, whole, key, chars, total).join(types, key, "left")
    names = F.coalesce(F.map_keys("type_counts"), F.array().cast("array<string>"))
    return out.withColumns({"has_header": F.array_contains(names, "header"), "has_content": F.exists(names, lambda x: x != "header"), "reason": F.when(F.col("is_valid"), "ok").otherwise("loss")})


def hierarchy(nodes: DataFrame, key: str = "doc_id", strict_parity: bool = False) -> DataFrame:
    """Of the nodes of :func:`regulus.operators.structure.tree`: layers kept, rates of bleeding and empty articles, errors, and whether targets are met.

    The layers that are expected are those whose marks stand in the bodies.
    ``strict_parity`` expects those that the tree has, so that all are kept
    wherever there is an article.
    """
    clauses = F.col("children")
    wrong_clause = F.transform(F.filter(clauses, lambda c: ~c["parent_article_no"].eqNullSafe(F.col("article_number"))), lambda c: F.concat(F.lit("Clause "), c["clause_no"], F.lit(" has wrong parent: "), c["parent_article_no"], F.lit(" != "), F.col("article_number")))
    items = F.flatten(F.transform(clauses, lambda c: F.transform(c["children"], lambda i: F.struct(c["clause_no"].alias("c"), i.alias("i")))))
    wrong_article = F.transform(F.filter(items, lambda x: ~x["i"]["parent_article_no"].eqNullSafe(F.col("article_number"))), lambda x: F.concat(F.lit("Item "), x["i"]["item_no"], F.lit(" has wrong article parent")))
    wrong_parent = F.transform(F.filter(items, lambda x: ~x["i"]["parent_clause_no"].eqNullSafe(x["c"])), lambda x: F.concat(F.lit("Item "), x["i"]["item_no"], F.lit(" has wrong clause parent")))
    rows = nodes.withColumns({"_errors": F.concat(wrong_clause, wrong_article, wrong_parent), "_clauses": F.size(clauses), "_items": F.size(items), "_marks": F.regexp_count("body", F.lit(P.CLAUSE)), "_numbers": F.regexp_count("body", F.lit(P.ITEM))})
    per = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("articles"),
        F.sum("_clauses").cast("long").alias("clauses"),
        F.sum("_items").cast("long").alias("items"),
        F.max(F.col("_marks") > 0).alias("expects_clauses"),
        F.max((F.col("_numbers") > 0) & (F.col("_marks") > 0)).alias("expects_items"),
        F.avg(F.col("has_cross_bleed").cast("int")).alias("cross_bleed_rate"),
        F.avg(F.col("has_empty_content").cast("int")).alias("empty_article_rate"),
        F.array_sort(F.flatten(F.collect_list("_errors"))).alias("integrity_errors"),
    )
    expected = 1 + F.col("expects_clauses").cast("int") + F.col("expects_items").cast("int")
    found = 1 + (F.col("expects_clauses") & (F.col("clauses") > 0)).cast("int") + (F.col("expects_items") & (F.col("items") > 0)).cast("int")
    out = per.withColumn("hierarchy_preservation", F.lit(1.0) if strict_parity else found / expected)
    return out.withColumn("dod_pass", (F.col("hierarchy_preservation") >= LAYERS) & (F.col("cross_bleed_rate") <= BLEEDS) & (F.col("empty_article_rate") <= EMPTY))


def pass_rate(metrics: DataFrame, passed: str = "dod_pass") -> DataFrame:
    """One row: documents, those that pass, and their share."""
    return metrics.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col(passed).cast("int")).cast("long").alias("passed"), F.avg(F.col(passed).cast("int")).alias("pass_rate"))


def rewrite_check(pairs: DataFrame, original: str, rewritten: str, number: str, title: str) -> DataFrame:
    """Adds four checks of a rewritten article, their warnings, whether it is valid, and the text to keep."""
    a, b = F.coalesce(F.col(original), F.lit("")), F.coalesce(F.col(rewritten), F.lit(""))
    head = F.concat(F.col(number), F.lit("("), F.col(title), F.lit(")"))
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    lost, new = F.array_sort(F.array_except(numbers(a), numbers(b))), F.array_sort(F.array_except(numbers(b), numbers(a)))
    terms = F.array_except(contained(a, P.LEGAL_TERMS), contained(b, P.LEGAL_TERMS))
    clauses = lambda c: F.regexp_count(c, F.lit(P.CLAUSE_MARKS))
    out = pairs.withColumns({"header_preserved": F.contains(b, head), "numbers_intact": (F.size(lost) == 0) & (F.size(new) == 0), "legal_terms_intact": F.size(terms) == 0, "structure_preserved": clauses(a) == clauses(b)})
    warn = F.array(
        F.when(~F.col("header_preserved"), F.concat(F.lit("header missing: "), head)),
        F.when(F.size(lost) > 0, F.concat(F.lit("numbers missing: "), F.array_join(lost, ","))),
        F.when(F.size(new) > 0, F.concat(F.lit("numbers added: "), F.array_join(new, ","))),
        F.when(F.size(terms) > 0, F.concat(F.lit("terms missing: "), F.array_join(terms, ","))),
        F.when(~F.col("structure_preserved"), F.concat(F.lit("clauses: "), clauses(a).cast("string"), F.lit(" -> "), clauses(b).cast("string"))),
    )
    valid = F.col("header_preserved") & F.col("numbers_intact") & F.col("legal_terms_intact") & F.col("structure_preserved")
    return out.withColumns({"warnings": F.filter(warn, lambda x: x.isNotNull()), "is_valid": valid}).withColumn("accepted_text", F.when(F.col("is_valid"), b).otherwise(a))


def cache_key(document: Column, number: Column, version: Column) -> Column:
    return F.md5(F.encode(F.concat_ws("_", document.cast("string"), number, version), "UTF-8"))


def cache_stats(rewritten: DataFrame, key: str = "cache_key", text: str = "text") -> DataFrame:
    """One row: distinct keys, and the bytes of one text for each, the least of those that share a key."""
    one = rewritten.groupBy(key).agg(F.min(F.coalesce(text, F.lit(""))).alias("t"))
    return one.agg(F.count(F.lit(1)).alias("total_cached"), F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0)).cast("long").alias("cache_size_bytes"))

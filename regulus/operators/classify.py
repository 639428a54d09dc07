"""What kind of document a text is: features, type, profile, and ratios of its tokens and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regulus.functions import patterns as P
from regulus.functions.text import any_contained, contained, count_lines, lines, ratio, strip

#: Thresholds of the type decision; characters that the digit density looks at; a line of fewer characters is short.
PAGE_TEXT, DIGITS, TABLE, SHORT_LINES, SAMPLE, SHORT = 300, 0.10, 0.50, 0.70, 1000, 50
#: ``isdigit`` holds for decimal digits and for circled and raised ones.
DIGIT = r"[\p{Nd}①-⑨⓵-⓽❶-❾²³¹⁰⁴-⁹₀-₉]"

#: id, mode, least share of headers that must match, further articles allowed, and strategy of each profile (fixed values).
PROFILES = (
    ("law_hr", "law_kor_hr_v1", "law", 0.95, True, {"source_of_truth": "pdf_text", "vlm_role": "table_only", "chunk_unit": "article", "preserve_structure": "true"}),
    ("law_generic", "law_kor_generic_v1", "law", 0.95, True, {"source_of_truth": "pdf_text", "chunk_unit": "article", "preserve_structure": "true"}),
    ("law_terms", "law_kor_terms_v1", "law", 0.90, False, {"source_of_truth": "pdf_text", "chunk_unit": "article"}),
    ("vlm_general", "vlm_general_v1", "vlm", 0.80, True, {"source_of_truth": "vlm", "vlm_role": "primary", "chunk_unit": "semantic"}),
)


def route(text: Column) -> Column:
    """``legal``, ``annex_only`` or ``unknown``."""
    return F.when(text.rlike(r"제\d+조"), "legal").when(text.rlike(r"\[별표"), "annex_only").otherwise("unknown")


def features(docs: DataFrame, text: str = "text", page_count: str | None = None, table_score: str | None = None) -> DataFrame:
    """Adds the features that the type is decided on. Without a page count, blank lines count pages."""
    t = F.coalesce(F.col(text), F.lit(""))
    pages = F.col(page_count).cast("int") if page_count else F.size(F.split(t, "\n\n", -1))
    sample = F.substring(t, 1, SAMPLE)
    full = F.filter(lines(t), lambda x: strip(x) != "")
    return docs.withColumns({
        "char_count": F.length(t).cast("long"),
        "pages": pages,
        "text_per_page": F.length(t) / F.greatest(pages, F.lit(1)),
        "has_articles": t.rlike(P.HAS_ARTICLES),
        "has_annex": t.rlike(P.HAS_ANNEX),
        "has_form": t.rlike(P.HAS_FORM),
        "digit_density": ratio(F.regexp_count(sample, F.lit(DIGIT)), F.length(sample)),
        "short_line_ratio": ratio(F.size(F.filter(full, lambda x: F.length(strip(x)) < SHORT)), F.size(full)),
        "table_score": F.col(table_score).cast("double") if table_score else F.lit(0.0),
    })


def decided(featured: DataFrame) -> DataFrame:
    """Adds ``doc_type``, ``confidence``, ``stats_reason`` and ``mode``; the first rule that holds decides."""
    form = F.col("has_form") & F.col("has_annex")
    law = F.col("has_articles") & F.col("has_annex") & ~F.col("has_form")
    digits = F.round("digit_density", 3) >= DIGITS
    tabular = (F.col("table_score") >= TABLE) & (F.round("short_line_ratio", 2) >= SHORT_LINES)
    rules = ((form, "form", 0.9), (law, "law_annex", 0.9), (F.col("text_per_page") < PAGE_TEXT, "image_heavy", 0.8), (digits | tabular, "stats_chart", 0.7))
    kind, sure = F, F
    for when, name, score in rules:
        kind, sure = kind.when(when, name), sure.when(when, score)
    kind, sure = kind.otherwise("general"), sure.otherwise(0.5)
    why = F.concat_ws(" OR ", F.when(digits, F.format_string("숫자 밀도 %.1f%%", F.bround(100 * F.col("digit_density"), 1))), F.when(tabular, F.format_string("표 구조 (score=%.2f, short_line=%.0f%%)", F.bround("table_score", 2), F.bround(100 * F.col("short_line_ratio"), 0))))
    out = featured.withColumns({"doc_type": kind, "confidence": sure, "stats_reason": F.when(why == "", "기준 미달").otherwise(why)})
    return out.withColumn("mode", F.when(F.col("doc_type").isin("law_annex", "form"), "LawMode").otherwise("VLM"))


def profile(file_name: Column, text: Column) -> Column:
    """The key of a document's profile: its name decides before its text does."""
    name = F.lower(F.coalesce(file_name, F.lit("")))
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(any_contained(name, ("인사", "hr", "규정", "규칙")), "law_hr")
        .when(any_contained(name, ("약관", "terms")), "law_terms")
        .when(any_contained(t, ("기본정신", "기 본 정 신")), "law_hr")
        .when(F.regexp_count(t, F.lit(r"제\d+조")) > 5, "law_generic")
        .otherwise("vlm_general")
    )


def profiles(spark: SparkSession) -> DataFrame:
    """The profiles as a table of four rows."""
    return spark.createDataFrame(list(PROFILES), "profile string, profile_id string, profile_mode string, least_match double, more_articles boolean, strategy map<string,string>")


def with_profile(docs: DataFrame, key: str = "profile") -> DataFrame:
    """Adds the columns of the profile named in ``key``; an unknown name gets the first one."""
    known = [p[0] for p in PROFILES]
    named = docs.withColumn("_profile", F.when(F.col(key).isin(*known), F.col(key)).otherwise(known[0]))
    return named.join(F.broadcast(profiles(docs.sparkSession).withColumnRenamed("profile", "_profile")), "_profile").drop("_profile")


def revision_page(page_no: Column, text: Column) -> Column:
    return (page_no == 1) & any_contained(text, P.REVISION_WORDS) & (F.regexp_count(text, F.lit(P.FULL_DATE)) >= 3)


def bus_words(text: Column) -> Column:
    """The words of bus timetables that a text contains, in the order of the list."""
    return contained(F.coalesce(text, F.lit("")), P.BUS_WORDS)


def article_token_ratio(text: Column) -> Column:
    """Article, clause and item marks over all tokens, one at most."""
    marks = sum((F.regexp_count(text, F.lit(p)) for p in P.ARTICLE_TOKENS), F.lit(0))
    tokens = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))
    return F.least(F.lit(1.0), ratio(marks, tokens))


def numbered_density(text: Column) -> Column:
    """The share of lines that begin with a number of some kind."""
    return F.when(text == "", F.lit(0.0)).otherwise(ratio(count_lines(text, P.NUMBERED_LINE), F.size(lines(text))))

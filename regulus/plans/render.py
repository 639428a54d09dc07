"""Documents as text again: Markdown for engines, Markdown for reviewers, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.operators import clean


def assembled(rows: DataFrame, key: str, order: list[str], line: str = "line", out: str = "text", glue: str = "\n") -> DataFrame:
    """One text for each key from its rows in order; they are as many as one document has."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, line)))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[line]), glue).alias(out))


def none() -> Column:
    return F.array().cast("array<string>")


def engine_md(rows: DataFrame, key: str = "doc_id", preamble: str | None = None) -> DataFrame:
    """``(key, text)`` of the rows of :func:`regulus.operators.structure.wide`: title, amendments, preamble, articles with a heading where the chapter changes, and the annex.

    A document is rendered inside its row. ``preamble`` names a column.
    """
    lit, articles, chapters = F.lit, F.col("articles"), F.col("chapters")
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else lit(p) for p in parts])

    def article(a: Column, i: Column) -> Column:
        # once a chapter has begun each article has one, so the article before tells whether it changes
        changes = (a["chapter_number"] != "") & ((i == 0) | (F.coalesce(F.get(articles, i - 1)["chapter_number"], lit("")) != a["chapter_number"]))
        heads = F.filter(chapters, lambda c: c["number"] == a["chapter_number"])
        head = F.when(changes, F.flatten(F.transform(F.slice(heads, 1, 1), lambda c: F.array(line("## ", F.concat_ws(" ", c["number"], c["title"])), lit(""))))).otherwise(none())
        return F.concat(head, F.array(line("### ", a["number"], "(", a["title"], ")"), lit(""), a["clean_body"], lit("")))

    parts = [
        F.array(line("# ", F.col("title")), lit("")),
        F.when(F.size("amendments") > 0, F.concat(F.array(lit("## 개정이력"), lit("")), F.transform("amendments", lambda x: line("- ", x["kind"], " ", x["date"])), F.array(lit("")))).otherwise(none()),
        *([F.when(F.col(preamble) != "", F.array(lit("## 기본정신"), lit(""), F.col(preamble), lit(""))).otherwise(none())] if preamble else []),
        F.flatten(F.transform(articles, article)),
        F.when(F.col("annex_content") != "", F.array(lit("## 별표"), lit(""), clean.annex_markdown(F.col("annex_content")), lit(""))).otherwise(none()),
    ]
    return rows.select(key, F.array_join(F.concat(*parts), "\n").alias("text"))


def qa_summary(rows: DataFrame) -> Column:
    """The summary of one document from columns of its totals and its gate: matched of all headers, flags, verdict."""
    flags = F.when(F.size("qa_flags") > 0, F.array_join("qa_flags", ", ")).otherwise("없음")
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    n = lambda c: F.format_number(F.col(c).cast("bigint"), 0)
    rule = F.lit("=" * 60)
    return F.concat_ws(
        "\n",
        rule,
        line("문서명: ", F.col("title")),
        rule,
        F.lit(""),
        F.lit("[처리 결과]"),
        line("- PDF 텍스트: ", n("source_chars"), "자"),
        line("- 처리 텍스트: ", n("processed_chars"), "자"),
        line("- 총 장: ", F.col("total_chapters").cast("string"), "개"),
        line("- 총 조문: ", F.col("total_articles").cast("string"), "개"),
        line("- 개정이력: ", F.col("total_amendments").cast("string"), "건"),
        line("- 청크: ", F.col("total_chunks").cast("string"), "개"),
        F.lit(""),
        F.lit("[QA 결과]"),
        line("- 조문 헤더 매칭률: ", F.round(F.col("match_rate") * 100).cast("int").cast("string"), "% (", F.size("matched").cast("string"), "/", F.size("source_articles").cast("string"), ")"),
        line("- 이상 징후: ", flags),
        line("- 판정: ", F.when(F.col("is_pass"), "✅ PASS").otherwise("⚠️ WARNING")),
    )


def review_md(rows: DataFrame, key: str = "doc_id", chunks: str = "chunks", title: str = "title", summary: str | None = None) -> DataFrame:
    """``(key, text)``: the summary in a fence, the title, and each chunk of an array of chunks by the rule of its type."""
    def shown(c: Column) -> Column:
        kind, content = c["type"], c["content"]
        header = F.concat(F.lit("### "), c["article_number"], F.lit("("), c["article_title"], F.lit(")"))
        lines = (
            F.when(kind == "chapter", F.array(F.concat(F.lit("## "), content)))
            .when((kind == "article") & (F.coalesce(c["article_number"], F.lit("")) != ""), F.array(header, content))
            .when(kind == "annex_paragraph", F.array(F.lit(""), content, F.lit("")))
            .when(F.contains(kind, F.lit("header")), F.array(F.concat(F.lit("## "), F.get(F.split(content, "\n"), 0))))
            .when(kind == "table_row", F.array(F.concat(F.lit("- "), content)))
            .otherwise(F.array(content))
        )
        return F.concat(lines, F.array(F.lit("")))

    head = F.when(F.col(title) != "", F.array(F.concat(F.lit("# "), F.col(title)), F.lit(""))).otherwise(none())
    fence = F.array(F.lit("```"), F.col(summary), F.lit("```"), F.lit(""), F.lit("---"), F.lit("")) if summary else none()
    body = F.flatten(F.transform(F.filter(chunks, lambda c: c["type"] != "title"), shown))
    return rows.select(key, F.array_join(F.concat(fence, head, body), "\n").alias("text"))


#: What the prompts of a version are made of; a section's text is a parameter of :func:`prompt`.
VERSIONS = {
    "0.3": {
        "task": "Transcribe this page of a Korean regulation as Markdown, word for word, without summary or comment.",
        "must": "Keep every article number and title, the amendment history, and the preamble (기본정신) if there is one.",
        "statute": "Headings: # document, ## chapter, ### 제N조(title).",
        "tables": "Write tables as Markdown tables.",
        "no_tables": "Write tables as lists of lines.",
    },
    "0.4": {
        "task": "Transcribe this page of a Korean regulation as Markdown. Leave out nothing and add nothing: no summary, no comment, no heading of your own.",
        "must": "Keep article numbers and titles, clause marks, amendment dates, deletions and the preamble (기본정신) as they are printed; leave out page numbers and running titles.",
        "statute": "Headings: # document, ## chapter, ### 제N조(title). Clauses (①) and items (1.) begin lines of their own.",
        "tables": "Write tables as Markdown tables, a row to each line.",
        "no_tables": "Write each row of a table as a line of a list.",
    },
}
SECTIONS = VERSIONS["0.3"]


def prompt(doc_type: Column, allow_tables: Column, sections: dict[str, str] = SECTIONS) -> Column:
    """The prompt for a page: which sections it has follows from the kind of document and whether tables may stay."""
    s = {k: F.lit(v) for k, v in sections.items()}
    return F.concat_ws("\n", s["task"], s["must"], F.when(doc_type == "statute", s["statute"]), F.when(allow_tables, s["tables"]).otherwise(s["no_tables"]))

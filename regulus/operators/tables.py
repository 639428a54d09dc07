"""Annex tables: regions, rows, completion by rule, and answers to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regulus.functions import patterns as P
from regulus.functions.text import let

#: Rows that a complete table has; up to so many appointees the rule is five places each, three beyond.
ROWS, STEEP = 75, 5
PROMOTION, OTHERS = "annex_1_3급승진", "annex_1_3급승진제외"
TITLES = {OTHERS: "3급승진제외", PROMOTION: "3급승진"}
#: What each table begins with, the first pattern that is found (fixed values).
HEADERS = {
    OTHERS: (r"(?i)승진\s*후보자\s*범위\s*\(?3급\s*승진\s*제외\)?", r"(?i)3급\s*승진\s*제외", r"(?i)3급승진제외"),
    PROMOTION: (r"(?i)승진\s*후보자\s*범위\s*\(?3급\s*승진\)?(?!\s*제외)", r"(?i)3급\s*승진(?!\s*제외)", r"(?i)3급승진(?!제외)"),
}
NEXT_ANNEX = r"\[별표\s*2\]"


def five_fold(n: Column) -> Column:
    return F.when(n <= STEEP, 5 * n).otherwise(25 + 3 * (n - STEEP))


def generated(spark: SparkSession) -> DataFrame:
    """Both tables from their rules: ``table_id``, ``n`` and ``rank``."""
    n = spark.range(1, ROWS + 1).select(F.col("id").cast("int").alias("n"))
    both = n.select("n", F.explode(F.array(F.struct(F.lit(OTHERS).alias("table_id"), five_fold(F.col("n")).cast("int").alias("rank")), F.struct(F.lit(PROMOTION).alias("table_id"), (2 * F.col("n")).cast("int").alias("rank")))).alias("t"))
    return both.select("t.table_id", "n", "t.rank")


def extracted(region: Column) -> Column:
    """``array<struct<n, rank>>`` by the row pattern that has most rows; of equal ones, the earlier.

    Each pattern goes through the region once for the numbers, and the best one
    once more for the ranks.
    """
    cells = lambda r, p, k: F.regexp_extract_all(r, F.lit(p), F.lit(k))

    def best(r: Column, found: Column) -> Column:
        sizes = F.transform(found, lambda x: F.size(x))
        pair = lambda n, rank: F.struct(n.cast("int").alias("n"), rank.cast("int").alias("rank"))

        def read(at: Column) -> Column:
            ranks = F.when(at == 1, cells(r, P.TABLE_ROWS[0], 2))
            for i, p in enumerate(P.TABLE_ROWS[1:], 2):
                ranks = ranks.when(at == i, cells(r, p, 2))
            return F.zip_with(F.get(found, at.cast("int") - 1), ranks, pair)

        return let(let(sizes, lambda n: F.array_position(n, F.array_max(n))), read)

    return let(region, lambda r: F.when(r.isNotNull(), let(F.array(*[cells(r, p, 1) for p in P.TABLE_ROWS]), lambda found: best(r, found))))


def after(text: Column, pattern: str) -> Column:
    """What follows the first match, or null."""
    return F.get(F.split(text, pattern, 2), 1)


def region(text: Column, table_id: str) -> Column:
    """What follows a table's header, up to the other table's, else to the second annex, else to the end; null without a header."""
    rest = F.coalesce(*[after(text, p) for p in HEADERS[table_id]])
    if table_id == PROMOTION:
        return rest
    place = lambda r, p: let(F.regexp_instr(r, F.lit(p)), lambda i: F.when(i > 0, i))
    end = lambda r: F.coalesce(*[place(r, p) for p in (*HEADERS[PROMOTION], NEXT_ANNEX)], F.length(r) + 1)
    return let(rest, lambda r: F.substring(r, F.lit(1), end(r) - 1))


def rows(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, ``table_id``, ``n`` and ``rank``: what the first row pattern that fits best finds in each text."""
    return docs.select(*keep, F.explode(extracted(F.coalesce(F.col(text), F.lit("")))).alias("r")).select(*keep, "r.n", "r.rank")


def told(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """For each text and table a row: ``is_generated`` and the ``rows`` of :func:`completed`."""
    t = F.coalesce(F.col(text), F.lit(""))
    per = docs.select(id_column, F.explode(F.array(*[F.struct(F.lit(k).alias("table_id"), F.coalesce(extracted(region(t, k)), F.array().cast("array<struct<n:int,rank:int>>")).alias("rows")) for k in HEADERS])).alias("x"))
    numbers = F.sequence(F.lit(1), F.lit(ROWS))
    rule = F.transform(numbers, lambda n: F.struct(n.alias("n"), F.when(F.col("x.table_id") == OTHERS, five_fold(n)).otherwise(2 * n).cast("int").alias("rank")))
    short = F.size("x.rows") < ROWS
    return per.select(id_column, "x.table_id", short.alias("is_generated"), F.when(short, rule).otherwise(F.col("x.rows")).alias("rows"))


def completed(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Both tables of each text: its own rows where it has all of them, else those of the rule, which ``is_generated`` tells."""
    return told(docs, text, id_column).select(id_column, "table_id", "is_generated", F.explode("rows").alias("r")).select(id_column, "table_id", "is_generated", "r.n", "r.rank")


def totals(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """For each text and table a row: ``is_generated``, ``n_rows`` and the sum ``ranks`` of its completed rows, worked out where the text is."""
    plus = lambda a, r: F.coalesce(a + r["rank"], a, r["rank"].cast("long"))
    return told(docs, text, id_column).select(id_column, "table_id", "is_generated", F.size("rows").cast("long").alias("n_rows"), F.aggregate("rows", F.lit(None).cast("long"), plus).alias("ranks"))


def statistics(table_rows: DataFrame) -> DataFrame:
    """``table_id``, ``documents`` and ``rows`` of ``completed`` tables."""
    per = table_rows.groupBy("doc_id", "table_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("table_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("rows"))


def answers(questions: DataFrame, table: DataFrame, question: str = "question", strict_parity: bool = False) -> DataFrame:
    """Adds ``table_id``, ``n``, ``rank`` and ``answer``: the last number asked for, in the table that the words name.

    Without such a row, or without a number, the answer is null.
    """
    q = F.coalesce(F.col(question), F.lit(""))
    said = q if strict_parity else F.replace(q, F.lit("삼급"), F.lit("3급"))
    third, promotion, but = F.contains(said, F.lit("3급")), F.contains(said, F.lit("승진")), F.contains(said, F.lit("제외"))
    numbers = F.regexp_extract_all(q, F.lit(r"\d+"), F.lit(0))
    asked = questions.withColumns({"table_id": F.when(third & promotion & ~but, PROMOTION).otherwise(OTHERS), "n": F.get(numbers, F.size(numbers) - 1).cast("int")})
    first = table.groupBy("table_id", "n").agg(F.min("rank").alias("rank"))
    title = F.when(F.col("table_id") == PROMOTION, TITLES[PROMOTION]).otherwise(TITLES[OTHERS])
    return asked.join(first, ["table_id", "n"], "left").withColumn("answer", F.when(F.col("rank").isNotNull(), F.format_string("%s에서 %d명 임용 시 서열명부순위 %d번까지", title, F.col("n"), F.col("rank"))))

"""A corpus of regulation-like documents made from relational tables.

One document for each customer: an article for each order, chapters by order
priority, amendments, page furniture and annexes by arithmetic on keys. It
stands in for scanned regulations wherever only relational tables are at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regulus.plans.render import assembled

#: The lines of all documents, in the SQL that engines share; {numbers} makes the integers 1 to m of a row.
LINES = """
WITH ordered AS (
  SELECT o_custkey AS k, o_orderkey AS ok, CAST(substring(o_orderpriority, 1, 1) AS INT) AS ch, substring(o_orderpriority, 3) AS pr,
         row_number() OVER (PARTITION BY o_custkey ORDER BY substring(o_orderpriority, 1, 1), o_orderkey) AS r
  FROM {orders}),
annexed AS (SELECT c_custkey AS k, n FROM {numbers})
SELECT c_custkey AS doc_id, 0 AS a, 0 AS b, 0 AS c, concat(c_name, ' 인사규정') AS line FROM {customer}
UNION ALL SELECT c_custkey, 1, 0, 0, CASE c_custkey % 3
    WHEN 0 THEN concat('[제정 ', 1990 + c_custkey % 20, '.', 1 + c_custkey % 12, '.', 1 + c_custkey % 28, ']')
    WHEN 1 THEN concat('(일부개정 ', 1995 + c_custkey % 20, '.', 1 + c_custkey % 12, '.', 1 + c_custkey % 28, '.)')
    ELSE concat('<전부개정 ', 1985 + c_custkey % 20, '.', 1 + c_custkey % 12, '.', 1 + c_custkey % 28, '>') END FROM {customer}
UNION ALL SELECT c_custkey, 2, 0, 0, concat('개정 ', 2000 + c_custkey % 15, '.', 1 + c_custkey % 9, '.', 1 + c_custkey % 27, ' 시행') FROM {customer} WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 3, 0, 0, concat('인사규정 402-', 1 + c_custkey % 9) FROM {customer} WHERE c_custkey % 2 = 1
UNION ALL SELECT c_custkey, 4, 0, 0, '기본정신' FROM {customer} WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 4, 1, 0, concat('이 규정은 ', c_mktsegment, ' 업무의 공정한  처리를 위하여 직원의 임용과 승진, 징계에 관한 사항을 정하고 조직의 발전에 이바지함을 그 정신으로 삼으며 모든 직원은 이를 성실하게 지켜야 한다.') FROM {customer} WHERE c_custkey % 4 = 0
UNION ALL SELECT DISTINCT k, 10, ch, 0, concat('제', ch, '장 총칙 ', ch) FROM ordered
UNION ALL SELECT k, 10, ch, 10 * r, concat('제', r, '조(', pr, ' 처리) 주문 ', ok, ' 건은 제1조(목적)에 따라 처리하고, 그 결과를  지체 없이 보고한다.',
    CASE WHEN ok % 5 = 0 THEN concat(' [개정 ', 2001 + ok % 9, '.0', 1 + ok % 9, '.1', ok % 10, ']') ELSE '' END,
    CASE WHEN ok % 11 = 0 THEN ' <삭제 2010.05.06>' ELSE '' END) FROM ordered
UNION ALL SELECT k, 10, ch, 10 * r + 1, concat('① 항목 ', ok % 97, '번을 제', 1 + ok % 7, '조제', 1 + ok % 3, '항에 따라 정한다.') FROM ordered WHERE ok % 2 = 0
UNION ALL SELECT k, 10, ch, 10 * r + 2, concat('1. 세부 ', ok % 13, ' 승진') FROM ordered WHERE ok % 4 = 0
UNION ALL SELECT k, 10, ch, 10 * r + 3, '② 그 밖의 사항' FROM ordered WHERE ok % 6 = 0
UNION ALL SELECT k, 10, ch, 10 * r + 4, concat('Page ', r) FROM ordered WHERE ok % 7 = 0
UNION ALL SELECT k, 10, ch, 10 * r + 5, '-----' FROM ordered WHERE ok % 9 = 0
UNION ALL SELECT c_custkey, 90, 0, 0, '[별표1] 승진후보자범위' FROM {customer} WHERE c_custkey % 3 <> 2
UNION ALL SELECT c_custkey, 90, 0, 1, '<제20조제2항관련>' FROM {customer} WHERE c_custkey % 3 <> 2
UNION ALL SELECT c_custkey, 90, 0, 2, '' FROM {customer} WHERE c_custkey % 3 <> 2
UNION ALL SELECT c_custkey, 90, 0, 3, concat('임용하고자하는인원수에대한승진후보자범위', CASE c_custkey % 4 WHEN 0 THEN '(3급승진제외)' WHEN 1 THEN '(3급승진)' ELSE '' END) FROM {customer} WHERE c_custkey % 3 <> 2
UNION ALL SELECT k, 90, 1, n, concat(n, ' ', 5 * n, '번까지 □') FROM annexed WHERE k % 3 <> 2
UNION ALL SELECT c_custkey, 90, 2, 0, '*임용하고자하는인원수가5명까지는서열명부순위의5배수' FROM {customer} WHERE c_custkey % 3 <> 2
UNION ALL SELECT c_custkey, 91, 0, 0, '[별표2] 응시자격' FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 91, 0, 1, '직급    응시자격    비고' FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 91, 0, 2, '1급 학위 소지자' FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 91, 0, 3, '1. 박사 학위' FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 91, 0, 4, '2. 석사 학위' FROM {customer} WHERE c_custkey % 3 = 0
"""
SPARK_NUMBERS = "(SELECT c_custkey, explode(sequence(1, 4 + CAST(c_custkey % 5 AS INT))) AS n FROM {customer})"
DUCKDB_NUMBERS = "(SELECT c_custkey, unnest(range(1, 5 + c_custkey % 5)) AS n FROM customer)"

#: The documents in SQL for another engine, as common table expressions ``line`` and ``docs``.
DUCKDB = "line AS (" + LINES.replace("{numbers}", DUCKDB_NUMBERS).replace("{customer}", "customer").replace("{orders}", "orders") + "), docs AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY a, b, c) AS text FROM line GROUP BY doc_id)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, title, text)``."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = spark.sql(LINES.replace("{numbers}", SPARK_NUMBERS), customer=customer, orders=orders)
    rows = rows.select("doc_id", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("c").cast("int").alias("c"), "line")
    return assembled(rows, "doc_id", ["a", "b", "c"]).withColumn("title", F.get(F.split("text", "\n"), 0))

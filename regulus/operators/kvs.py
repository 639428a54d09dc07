"""Key-value pairs: one value for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.functions.text import strip
from regulus.operators import clean


def normalized(rows: DataFrame, group: list[str], key: str = "key", value: str = "value", order: str = "pos") -> DataFrame:
    """``group``, ``key`` and ``value``: values in one form, of each key the longest, of equal ones the first.

    Rows with an empty key, an empty or blank value or a mere colon are left out.
    """
    full = rows.where((F.col(key) != "") & (strip(F.col(value)) != "") & (F.col(value) != ":"))
    even = full.withColumn("_v", clean.kvs_value(F.col(value)))
    best = F.max(F.struct(F.length("_v").alias("n"), (-F.col(order)).alias("o"), F.col("_v").alias("v")))
    return even.groupBy(*group, key).agg(best.alias("b")).select(*group, key, F.col("b.v").alias(value))


def parsed(raw: Column) -> Column:
    """``struct<layout, pairs>`` of JSON of any layout: pairs as a list of objects with ``key`` and ``value``, or as one object.

    The layout is ``list``, ``map``, ``other`` for JSON that is neither, ``broken``
    for what is no JSON (an object that has a key twice among it), and null for
    null. Elements of a list that are no objects give no pair.
    """
    v = F.try_parse_json(raw)
    pair = "array<struct<key:string,value:string>>"
    as_list, as_map = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
    listed = F.transform(as_list, lambda x: F.struct(F.try_variant_get(x, "$.key", "string").alias("key"), F.try_variant_get(x, "$.value", "string").alias("value")))
    mapped = F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value")))
    layout = F.when(raw.isNull(), None).when(v.isNull(), "broken").when(as_list.isNotNull(), "list").when(as_map.isNotNull(), "map").otherwise("other")
    return F.struct(layout.alias("layout"), F.coalesce(listed, mapped, F.array().cast(pair)).alias("pairs"))


def read(rows: DataFrame, keep: list[str], raw: str) -> DataFrame:
    """``keep``, ``layout``, ``broken``, ``pos``, ``key`` and ``value``: a row for each pair, and one without a pair for JSON that has none.

    Text that is no JSON is kept in ``broken``. Keys and values are texts;
    numbers become texts, and what is null or nested is null.
    """
    told = rows.select(*keep, F.col(raw).alias("_raw"), parsed(F.col(raw)).alias("_p"))
    out = told.select(*keep, F.col("_p.layout").alias("layout"), F.when(F.col("_p.layout") == "broken", F.col("_raw")).alias("broken"), F.posexplode_outer("_p.pairs").alias("pos", "_x"))
    return out.select(*keep, "layout", "broken", "pos", "_x.key", "_x.value")


def normalized_json(rows: DataFrame, keep: list[str], raw: str) -> DataFrame:
    """:func:`normalized` pairs of JSON texts, ``keep`` naming a text."""
    return normalized(read(rows, keep, raw).where("key is not null and value is not null"), keep)

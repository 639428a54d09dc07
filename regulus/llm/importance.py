"""Importance resampling towards a target distribution, by hashed n-grams.

A table of positions has one row for each word of each text. ``lead()`` within
a document puts the words that follow beside each word, so the runs of every
order that begin there are concatenations within a row; each is hashed to a
bucket. Buckets are counted over both tables, the log-ratio of their shares is
a bucket's gain, and the gains are joined to the positions and summed up by
document. Documents are drawn without replacement by adding Gumbel noise that
depends on their ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regulus.llm.common import cut, removed, scratch, whole_text

#: Longest run of words; buckets of the hash; smoothing is one for each bucket.
ORDER, BUCKETS = 3, 10_000
#: Documents of at least so many words take part in the draw, of which this many hundredths are drawn; seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII without digits and small letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, and nothing else; ASCII texts take the quicker way to the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def positions(docs: DataFrame, keep: list[Column], order: int = ORDER) -> DataFrame:
    """``keep``, ``row`` and the buckets ``b1 ... b<order>`` of the runs that begin at each word; one row of nulls for a text without words.

    ``docs`` has the column ``text``. Texts are dealt out by row before they are
    taken apart, so the window needs no shuffle of words.
    """
    names = [docs.select(c).columns[0] for c in keep]
    rows = docs.select(*keep, F.col("text"), F.monotonically_increasing_id().alias("row")).repartition("row")
    words = F.filter(F.split(lowered(whole_text("text")), GAP), lambda w: w != "")
    placed = rows.select(*names, "row", F.posexplode_outer(words).alias("pos", "w1"))
    at = Window.partitionBy("row").orderBy("pos")
    placed = placed.withColumns({f"w{k}": F.lead("w1", k - 1).over(at) for k in range(2, order + 1)})
    run = lambda k: F.concat_ws(" ", *[f"w{i}" for i in range(1, k + 1)])
    bucket = lambda k: F.when(F.col(f"w{k}").isNotNull(), F.crc32(run(k)) % BUCKETS).cast("int")
    return placed.select(*names, "row", *[bucket(k).alias(f"b{k}") for k in range(1, order + 1)])


def bucket_counts(placed: DataFrame, order: int = ORDER) -> DataFrame:
    """``(bucket, n)``: how many features fall into each bucket, at most :data:`BUCKETS` rows."""
    each = placed.select(F.explode(F.array(*[f"b{k}" for k in range(1, order + 1)])).alias("bucket"))
    return each.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(bucket, gain)`` of every bucket, from the counts of both tables: thousandths of the log-ratio of smoothed shares."""
    spark = source.sparkSession
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(source.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"])
    both = cut(both)
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t").cast("double") + 1) * float(all_s + BUCKETS)) / ((F.col("s").cast("double") + 1) * float(all_t + BUCKETS))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(id_column: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, drawn by the id; null ids share that of an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, least_features: int, percent: int) -> DataFrame:
    """``scored(id, n_features, weight, score)`` with ``rank``: 1, 2, 3 ... for the best of those that have enough features, null for all others.

    Rows are sorted by range, each range is counted, and a row's rank is its
    place in its range after all ranges before. No range holds all rows.
    """
    spark = scored.sparkSession
    takes_part = F.col("n_features") >= least_features
    in_order = scored.where(takes_part).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    mine = cut(in_order.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = sorted((r["part"], r["n"]) for r in mine.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each range
    total = sum(n for _, n in sizes)
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    ranges = spark.createDataFrame(starts, "part int, before long")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = mine.join(F.broadcast(ranges), "part").withColumn("rank", F.when(place <= percent * total // 100, place))
    return ranked.select(*scored.columns, "rank").unionByName(scored.where(~takes_part).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", id_column: str = "doc_id", target_text: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_features``, ``weight``, ``score`` and ``rank`` in the draw, null if it is not drawn.

    Null and empty texts, and texts without words, have no features and weight
    zero. Rows that repeat come back as often, each with features of its own;
    ties go to the smaller id, and null ids come last among them. Texts are
    taken whole however long they are. Other columns are not looked at. Without
    a target all gains rest on smoothing alone; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    path = scratch(spark, "positions")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    positions(rows, [F.col("id")]).write.parquet(path)
    placed = spark.read.parquet(path)
    wanted = bucket_counts(positions(target.select(F.col(target_text).alias("text")), []))
    told = cut(gains(bucket_counts(placed), wanted))
    for k in range(1, ORDER + 1):
        of_order = told.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}"))
        placed = placed.join(F.broadcast(of_order), f"b{k}", "left")  # at most BUCKETS rows
    n_features = sum((F.count(f"b{k}") for k in range(1, ORDER + 1)), F.lit(0))
    weight = sum((F.coalesce(F.sum(f"g{k}"), F.lit(0)) for k in range(1, ORDER + 1)), F.lit(0))
    weighed = placed.groupBy("row").agg(F.first("id").alias("id"), n_features.cast("long").alias("n_features"), weight.cast("long").alias("weight"))
    scored = cut(weighed.select("id", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score")))
    removed(spark, path)
    least = sum(max(0, least_words - k) for k in range(ORDER))
    return drawn(scored, least, percent).withColumnRenamed("id", id_column)

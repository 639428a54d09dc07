"""Two versions of documents, article by article: what stayed, moved, was renumbered, changed, is missing or is new.

The articles of both versions of a document meet in one place, once, and stay
there: every step after that is a window, a group or an array of that document,
so nothing more is shuffled. Articles are paired by rules from the strictest to
the loosest; of those that a rule cannot tell apart, the first of one version
goes with the first of the other. The longest run of pairs that stand in one
order in both versions is what kept its place, and the other pairs have moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regulus.functions.text import let, ratio
from regulus.operators import clean
from regulus.operators.golden import CONTENT, HEADER, STRUCTURE

#: What two articles must share to be one article in two versions, first rule first.
RULES = (("number", "digest"), ("digest",), ("number", "title"), ("title",), ("number",))


def common_prefix(a: Column, b: Column) -> Column:
    """The length of the longest common beginning, by bisection; of at most 2 ** 30 code points."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    most = F.least(F.length(a), F.length(b))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= most) & (F.substring(a, F.lit(1), n + s) == F.substring(b, F.lit(1), n + s)), n + s).otherwise(n))


def edit_similarity(a: Column, b: Column) -> Column:
    """One less the share of code points that an edit of the longer text must touch; one for two empty texts.

    What both texts begin and end with needs no edit, so only what lies between
    is compared, which leaves the distance as it is.
    """
    def middle(x: Column, ends: Column) -> Column:
        return F.substring(x, ends["head"] + 1, F.length(x) - ends["head"] - ends["tail"])

    def between(head: Column) -> Column:
        rest = lambda x: F.reverse(F.substring(x, head + 1, F.length(x)))
        ends = F.struct(head.alias("head"), common_prefix(rest(a), rest(b)).alias("tail"))
        return let(ends, lambda e: F.levenshtein(middle(a, e), middle(b, e)))

    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(1 - let(common_prefix(a, b), between) / longest)


def rising(places: Column) -> Column:
    """The longest rising run of an array of distinct numbers, as an array of its indices.

    Each number's run is one longer than the longest that ends lower before it.
    Read from the end, the run takes of each length the last number that still
    fits. The work grows with the square of the array.
    """
    nothing = F.array().cast("array<int>")
    longest = F.aggregate(F.transform(places, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), nothing, lambda done, x: F.concat(done, F.array(1 + F.coalesce(F.array_max(F.transform(done, lambda n, j: F.when(F.get(places, j) < x["p"], n).otherwise(0))), F.lit(0)))))

    def back(lengths: Column) -> Column:
        n = F.size(lengths)
        last_first = F.transform(places, lambda _, i: F.struct(F.get(places, n - 1 - i).alias("p"), F.get(lengths, n - 1 - i).alias("n"), (n - 1 - i).alias("i")))
        start = F.struct(F.lit(None).cast("long").alias("p"), (F.coalesce(F.array_max(lengths), F.lit(0)) + 1).alias("n"), nothing.alias("run"))
        taken = lambda s, x: F.struct(x["p"].cast("long").alias("p"), x["n"].alias("n"), F.concat(F.array(x["i"]), s["run"]).alias("run"))
        return F.aggregate(last_first, start, lambda s, x: F.when((x["n"] == s["n"] - 1) & (s["p"].isNull() | (x["p"] < s["p"])), taken(s, x)).otherwise(s), lambda s: s["run"])

    return let(longest, back)


def versions(golden: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Both versions in one table, dealt out by document."""
    def side(df: DataFrame, now: bool) -> DataFrame:
        body = clean.golden(F.coalesce("body", F.lit("")))
        rows = df.select(F.col(key).alias("key"), F.lit(now).alias("now"), F.col("section_order").cast("long").alias("at"), F.coalesce("article_number", F.lit("")).alias("number"), F.coalesce("article_title", F.lit("")).alias("title"), body.alias("text"))
        return rows.withColumn("digest", F.unhex(F.md5(F.encode("text", "UTF-8"))))

    return side(golden, False).unionByName(side(current, True)).repartition("key")


def paired(both: DataFrame) -> DataFrame:
    """``both`` with ``mate``: the place of the same article in the other version, null if it has none."""
    rows = both.withColumn("mate", F.lit(None).cast("long"))
    for rule in RULES:
        free = F.col("mate").isNull()
        alike = [F.col("key"), free, *map(F.col, rule)]
        nth = F.row_number().over(Window.partitionBy(*alike, "now").orderBy("at"))
        rows = rows.withColumn("nth", nth)
        met = Window.partitionBy(*alike, "nth")
        other = F.when(F.col("now"), F.max(F.when(~F.col("now"), F.col("at"))).over(met)).otherwise(F.max(F.when(F.col("now"), F.col("at"))).over(met))
        rows = rows.withColumn("mate", F.coalesce("mate", F.when(free, other))).drop("nth")
    return rows


def aligned(golden: DataFrame, current: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, section_order, article_number, article_title, body)`` of two versions -> one row for each article of either.

    ``status`` is ``missing`` or ``added`` where one version lacks the article,
    else ``same``, or what changed of it: ``body``, ``title``, ``number``, joined
    by ``+``. ``in_place`` tells whether a pair belongs to the longest run that
    kept its order. ``similarity`` compares normalised bodies, and is zero for an
    article without a pair. Places must be distinct within a version; null
    numbers, titles and bodies count as empty, and a null key is a document.
    An empty version makes all articles missing or added.
    """
    side = lambda c, now: F.max(F.when(F.col("now") == now, F.col(c))).alias(f"{c}_{'now' if now else 'then'}")
    then_at = F.when(F.col("now"), F.col("mate")).otherwise(F.col("at"))
    now_at = F.when(F.col("now"), F.col("at")).otherwise(F.col("mate"))
    pairs = paired(versions(golden, current, key)).groupBy("key", then_at.alias("at_then"), now_at.alias("at_now")).agg(*[side(c, now) for c in ("number", "title", "text") for now in (False, True)])
    both = F.col("at_then").isNotNull() & F.col("at_now").isNotNull()
    changed = F.concat_ws("+", *[F.when(F.col(f"{c}_then") != F.col(f"{c}_now"), n) for c, n in (("text", "body"), ("title", "title"), ("number", "number"))])
    status = F.when(F.col("at_now").isNull(), "missing").when(F.col("at_then").isNull(), "added").when(changed == "", "same").otherwise(changed)
    told = pairs.select("key", "at_then", "at_now", "number_then", "number_now", "title_then", "title_now", status.alias("status"), F.when(both, edit_similarity(F.col("text_then"), F.col("text_now"))).otherwise(0.0).alias("similarity"))
    row = F.struct(*[c for c in told.columns if c != "key"])
    grouped = told.groupBy("key").agg(F.array_sort(F.collect_list(F.when(both, row))).alias("pairs"), F.collect_list(F.when(~both, row)).alias("alone"))
    kept = let(rising(F.transform("pairs", lambda p: p["at_now"])), lambda run: F.transform("pairs", lambda p, i: p.withField("in_place", F.array_contains(run, i))))
    alone = F.transform("alone", lambda p: p.withField("in_place", F.lit(False)))
    return grouped.select("key", F.inline(F.concat(kept, alone))).withColumnRenamed("key", key)


def report(articles: DataFrame, key: str = "doc_id", structure: float = STRUCTURE, header: float = HEADER, content: float = CONTENT) -> DataFrame:
    """Rows of :func:`aligned` -> one row for each document: counts of what happened, three scores, and whether all reach their thresholds.

    Structure: pairs that kept their order, of all articles.
    Headers: pairs with number and title as before. Content: the mean similarity
    of bodies, zero for missing and added articles.
    """
    count = lambda c: F.sum(c.cast("long"))
    is_pair = ~F.col("status").isin("missing", "added")
    same = lambda c: is_pair & (F.col(f"{c}_then") == F.col(f"{c}_now"))
    n = F.count(F.lit(1))
    told = articles.groupBy(key).agg(
        n.alias("articles"), count(F.col("status") == "missing").alias("missing"), count(F.col("status") == "added").alias("added"), count(is_pair & ~F.col("in_place")).alias("moved"), count(is_pair & ~same("number")).alias("renumbered"), count(is_pair & ~same("title")).alias("retitled"), count(is_pair & (F.col("similarity") < 1)).alias("edited"),
        ratio(count(F.col("in_place")), n).alias("structure_score"), ratio(count(same("number") & same("title")), n).alias("header_score"), F.avg("similarity").alias("content_score"),
    )
    passed = (F.col("structure_score") >= structure) & (F.col("header_score") >= header) & (F.col("content_score") >= content)
    return told.withColumns({"overall_score": (F.col("structure_score") + F.col("header_score") + F.col("content_score")) / 3, "overall_pass": passed})

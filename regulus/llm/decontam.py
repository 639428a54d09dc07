"""Benchmark decontamination by templates.

Numbers, names and units of a text become typed placeholders, so that a
question asked again with other values has the same template. A second template
leaves names as they are, in lower case, so that copies in other letter case
are met, too. Windows of template words of the benchmark and of the documents
are joined by hash; where enough of an item's windows lie in a document, the
values behind the aligned placeholders are compared: one value of the item must
stand for one value of the document throughout. Items with too few windows that
say something, such as sums, titles and short questions, are searched for word
for word.

Everything is a DataFrame expression; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.llm.common import cut, identity, small, whole_text

#: Words to a window; share of an item's windows a document must hold; share of aligned slots that must be consistent.
WINDOW, COVERAGE, CONSISTENCY = 8, 0.5, 0.75
#: Items with fewer template words than this can't be told from chance by their template, and items with fewer windows hang on one word: they are searched for word for word.
SHORTEST, FEWEST = 4, 2
#: The benchmark's window hashes are broadcast up to this many rows (16 bytes each), and its windows with what they belong to up to so many (64 bytes each); beyond them the joins shuffle.
BROADCAST_ROWS, BROADCAST_WINDOWS = 2_000_000, 400_000

#: Units of measure, as written after a number (fixed values).
UNITS = (
    "mm cm m km ft in inch inches foot feet yard yards mile miles mg g kg lb lbs oz ton tons gram grams pound pounds ml l liter liters litre litres "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "c f k celsius fahrenheit kelvin w kw kwh v volt volts watt watts j joule joules n newton newtons pa hz khz mhz ghz "
    "usd eur gbp dollar dollars cent cents euro euros percent pct degree degrees meter meters metre metres kilometer kilometers kilometre kilometres kilogram kilograms"
).split()

#: Capitalised words that are no names, wherever they stand (fixed values).
FUNCTION_WORDS = (
    "the a an this that these those and or but if when while because as than so then there here what which who whom whose why how where "
    "i he she it we you they him her his its our your their my me us them is are was were be been being am do does did has have had will would can could shall should may might must "
    "of in on at by for from to with without about into over under after before between during through against each every some any no not all both many much more most few suppose given let"
).split()

#: ASCII but letters, digits and the placeholder sign, general punctuation and no-break space separate words.
GAP = r"[\x00\x02-\x2F\x3A-\x60\x7B-\x7F «» -⁯　]+"
NUMBER, NAME, UNIT = "\x01d", "\x01n", "\x01u"


def plain(text: Column) -> Column:
    """The text with the marks inside numbers dropped, and numbers set apart from letters that follow."""
    t = F.translate(text, "\x01", " ")
    has_digit = t.rlike("[0-9]")
    inside = F.regexp_replace(t, r"(?<=[0-9])[.,](?=[0-9])", "")
    return F.when(has_digit, F.regexp_replace(inside, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", " ")).otherwise(t)


def typed(text: Column) -> Column:
    """A placeholder for each unit after a number and for each number, in a text in lower case."""
    units = F.regexp_replace(text, r"(?<![0-9a-z])([0-9]++[ \n]?)(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![a-z0-9])", f"$1 {UNIT}")
    return F.when(text.rlike("[0-9]"), F.regexp_replace(units, r"(?<![a-z0-9\x01])[0-9]++(?![a-z])", NUMBER)).otherwise(text)


def named(plain_text: Column) -> Column:
    """The text in lower case, with a placeholder for each capitalised word that isn't a function word.

    What stands before a capitalised word makes no difference, so a text has
    the same template at the beginning of a sentence and inside one.
    """
    known = "|".join(dict.fromkeys(w.capitalize() for w in FUNCTION_WORDS if len(w) > 1))
    return F.lower(F.regexp_replace(plain_text, rf"(?=[A-Z])(?<![0-9A-Za-z])(?!(?:{known})(?![A-Za-z]))[A-Z][a-z]++(?![A-Za-z])", NAME))


def words(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def hashed(some: Column, sign: int = 1) -> Column:
    """A hash of each word; the sign tells templates (1) from words as written (-1)."""
    return F.transform(some, lambda w: F.xxhash64(F.lit(sign), w))


def windowed(rows: DataFrame, hashes: str, n: int, out: str) -> DataFrame:
    """Adds ``out``, the hashes of the windows of ``n`` words, from the hashes of ``m`` words.

    A window is hashed from two shorter ones, that overlap where ``n`` is no
    power of two, so a text costs three steps a word for windows of eight.
    """
    w, long, shifts = F.col(hashes), 1, []
    while 2 * long <= n:
        shifts.append(long)
        long *= 2
    if long < n:
        shifts.append(n - long)
    for i, k in enumerate(shifts):  # columns, as each is used twice
        rows = rows.withColumn(f"{out}_{i}", F.zip_with(w, F.slice(w, k + 1, F.col("m")), lambda a, b: F.xxhash64(a, b)))
        w = F.col(f"{out}_{i}")
    return rows.withColumn(out, F.slice(w, F.lit(1), F.greatest(F.col("m") - n + 1, F.lit(0)))).drop(*[f"{out}_{i}" for i in range(len(shifts))])


def placed_windows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows(hs, m, n, ...)`` with ``ipos`` and ``h``: a row for each window of ``n`` words."""
    parts = [windowed(rows.where(F.col("n") == n), "hs", n, "w").select(*rows.columns, F.posexplode("w").alias("ipos", "h")) for n in lengths]
    return reduce(DataFrame.union, parts)


def lengths_of(rows: DataFrame) -> list[int]:
    """The different ``n``, at most as many as a window has words; one for none."""
    return sorted(r["n"] for r in rows.select("n").distinct().collect()) or [1]


def bare(window: Column) -> Column:
    """The window is mostly placeholders, so it says nothing."""
    return 2 * F.size(F.filter(window, lambda w: w.startswith("\x01"))) > F.size(window)


def items(benchmark: DataFrame, text: str, id_column: str, window: int) -> DataFrame:
    """``(item_id, raw, tpl, n)``: both templates of each item, once if they are the same, and the words to a window."""
    t = benchmark.select(F.col(id_column).alias("item_id"), plain(whole_text(text)).alias("p")).where("item_id is not null")
    t = t.select("item_id", F.lower("p").alias("low"), named(F.col("p")).alias("named"))
    t = t.select("item_id", words(F.col("low")).alias("raw"), F.explode(F.array(words(typed(F.col("named"))), words(typed(F.col("low"))))).alias("tpl")).where(F.size("tpl") > 0)
    return t.dropDuplicates(["item_id", "tpl", "raw"]).withColumn("n", F.least(F.lit(window), F.size("tpl")))


def literal(every: DataFrame, totals: DataFrame, window: int) -> DataFrame:
    """``(item_id, variant, ipos, n, h, raw)``: windows of the words as written, of items none of whose templates has enough."""
    keyed = every.select("item_id", "raw", F.xxhash64("raw").alias("r"), F.xxhash64("tpl").alias("variant"))
    told = keyed.join(totals.where(F.col("item_windows") >= FEWEST), ["item_id", "variant"], "left_semi").select("item_id", "r").distinct()
    rest = keyed.join(told, ["item_id", "r"], "left_anti").select("item_id", "raw", "r", F.least(F.lit(window), F.size("raw")).alias("n")).dropDuplicates(["item_id", "raw"])
    rest = cut(rest.select("item_id", F.col("r").alias("variant"), "raw", "n", F.size("raw").alias("m"), hashed(F.col("raw"), -1).alias("hs")))
    return placed_windows(rest, lengths_of(rest)).select("item_id", "variant", "ipos", "n", "h", "raw")


def word_for_word(hits: DataFrame, exact: DataFrame, said: DataFrame) -> DataFrame:
    """The items of ``exact`` whose windows all stand in a text, one after the other; what they say is compared as well."""
    totals = exact.groupBy("item_id", "variant").agg(F.countDistinct("ipos").alias("item_windows"), F.first("raw").alias("raw"))
    met = hits.join(exact.drop("raw"), "h").groupBy("text_key", "item_id", "variant", (F.col("dpos") - F.col("ipos")).alias("shift")).agg(F.countDistinct("ipos").alias("hit_windows"))
    whole = met.join(totals, ["item_id", "variant"]).where("hit_windows = item_windows").join(said, "text_key")
    whole = whole.where(F.slice("draw", F.col("shift") + 1, F.size("raw")) == F.col("raw"))
    return whole.select("text_key", "item_id", "item_windows", "hit_windows", F.lit(1.0).alias("coverage"), F.lit(0).cast("long").alias("slots"), F.lit(1.0).alias("slot_consistency"))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """``(text_key, item_id, item_windows, hit_windows, coverage, slots, slot_consistency)``: the items that a text holds.

    ``text_key`` is a digest of 128 bits of a document's text, so that copies,
    repeated rows and rows without an id are all met by what they say. Texts
    are searched whole, however long. Null and empty texts hold nothing; null
    item ids are left out, and so are items without words. Windows that are
    mostly placeholders say nothing; items of fewer than ``SHORTEST`` template
    words, or of fewer than ``FEWEST`` windows that say something, are met word
    for word. Letter case makes no difference. Of rows that share an item id,
    of an item's templates and of equal shares the best is returned, by
    coverage, consistency and windows, so ties give the same row. Other columns
    are not looked at. Empty tables give an empty result.
    """
    every = cut(items(benchmark, item_text, item_id, window))
    bench = every.where(F.size("tpl") >= SHORTEST)
    lengths = lengths_of(bench)
    some = bench.select("item_id", F.xxhash64("tpl").alias("variant"), "tpl", "n", F.size("tpl").alias("m"), hashed(F.col("tpl")).alias("hs"))
    placed = placed_windows(some, lengths).where(~bare(F.slice("tpl", F.col("ipos") + 1, F.col("n"))))
    placed = cut(placed.select("item_id", "variant", "ipos", "n", "h"))
    totals = placed.groupBy("item_id", "variant").agg(F.countDistinct("ipos").alias("item_windows"))
    exact = cut(literal(every, totals, window))
    as_written = sorted(r["n"] for r in exact.select("n").distinct().collect())
    known = cut(placed.select("h").union(exact.select("h")).distinct())
    rows = docs.select(whole_text(text).alias("t"))
    rows = rows.select(identity(F.col("t")).alias("text_key"), plain(F.col("t")).alias("p"))
    rows = rows.select("text_key", F.lower("p").alias("low"), named(F.col("p")).alias("named"))  # columns, as each is used more than once
    rows = rows.select("text_key", hashed(words(typed(F.col("named")))).alias("h1"), hashed(words(typed(F.col("low")))).alias("h2"), *[hashed(words(F.col("low")), -1).alias("h0")] * bool(as_written))
    rows = rows.withColumn("m", F.size("h1"))  # all three have a hash for each word
    kinds = [(h, n) for h in ("h1", "h2") for n in lengths] + [("h0", n) for n in as_written]
    for i, (h, n) in enumerate(kinds):
        rows = windowed(rows, h, n, f"w{i}")
    seen = rows.select("text_key", "m", F.posexplode(F.concat(*[F.col(f"w{i}") for i in range(len(kinds))])).alias("pos", "h"))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    found = seen.join(known, "h", "left_semi")
    # the place of a window among those of its kind
    at, before = F.when(F.lit(False), 0), F.lit(0)
    for _, n in kinds:
        after = before + F.greatest(F.col("m") - n + 1, F.lit(0))
        at, before = at.when(F.col("pos") < after, F.col("pos") - before), after
    hits = cut(found.select("text_key", at.alias("dpos"), "h").distinct())
    few = F.broadcast(placed) if placed.count() <= BROADCAST_WINDOWS else placed
    met = hits.join(few, "h").select("text_key", "item_id", "variant", "ipos", "dpos", "n")
    share = met.groupBy("text_key", "item_id", "variant").agg(F.countDistinct("ipos").alias("hit_windows")).join(totals, ["item_id", "variant"])
    share = share.withColumn("coverage", F.col("hit_windows") / F.col("item_windows")).where(F.col("coverage") >= coverage)
    share = cut(share)
    # the values behind the aligned placeholders
    asked = share.select("text_key")
    if as_written:
        asked = asked.union(hits.join(exact.select("h"), "h", "left_semi").select("text_key"))
    keys = small(asked.distinct())
    texts = docs.select(whole_text(text).alias("t")).select("t", identity(F.col("t")).alias("text_key")).join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("t").alias("t"))
    said = texts.select("text_key", words(F.lower(plain(F.col("t")))).alias("draw"))
    pairs = met.join(share.select("text_key", "item_id", "variant"), ["text_key", "item_id", "variant"])
    both = pairs.join(bench.select("item_id", F.xxhash64("tpl").alias("variant"), "raw", "tpl"), ["item_id", "variant"])
    slots = both.select("text_key", "item_id", "variant", "ipos", "dpos", F.explode(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.get("tpl", F.col("ipos") + j).startswith("\x01"))).alias("j"), "raw")
    slots = slots.select("text_key", "item_id", "variant", (F.col("dpos") - F.col("ipos")).alias("shift"), (F.col("dpos") + F.col("j")).alias("d"), F.get("raw", F.col("ipos") + F.col("j")).alias("ival")).distinct()
    valued = slots.join(said, "text_key").select("text_key", "item_id", "variant", "shift", "d", "ival", F.get("draw", F.col("d")).alias("dval"))
    by_value = valued.groupBy("text_key", "item_id", "variant", "shift", "ival", "dval").agg(F.count(F.lit(1)).alias("c"))
    by_slot = by_value.groupBy("text_key", "item_id", "variant", "shift", "ival").agg(F.max("c").alias("agree"), F.sum("c").alias("c"))
    agreed = by_slot.groupBy("text_key", "item_id", "variant").agg(F.sum("c").alias("slots"), (F.sum("agree") / F.sum("c")).alias("slot_consistency"))
    judged = share.join(agreed, ["text_key", "item_id", "variant"], "left").select("text_key", "item_id", "item_windows", "hit_windows", "coverage", F.coalesce("slots", F.lit(0)).cast("long").alias("slots"), F.coalesce("slot_consistency", F.lit(1.0)).alias("slot_consistency"))
    judged = judged.where(F.col("slot_consistency") >= consistency)
    if as_written:
        judged = judged.unionByName(word_for_word(hits, exact, said))
    best = judged.groupBy("text_key", "item_id").agg(F.max(F.struct("coverage", "slot_consistency", "hit_windows", "item_windows", "slots")).alias("b"))
    return cut(best.select("text_key", "item_id", "b.item_windows", "b.hit_windows", "b.coverage", "b.slots", "b.slot_consistency"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id", **how) -> DataFrame:
    """One row for each document and benchmark item it holds; clean documents have none.

    Rows that repeat have theirs each, null ids stay null, and of the columns
    of docs only the id comes back. See :func:`contamination` for odd texts.
    """
    found = contamination(docs, benchmark, text, id_column, **how)
    keyed = docs.select(F.col(id_column).alias(id_column), identity(whole_text(text)).alias("text_key"))
    some = keyed.join(small(found.select("text_key").distinct()), "text_key", "left_semi")
    return some.join(found, "text_key").drop("text_key")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id", **how) -> DataFrame:
    """The rows that hold no benchmark item, as often and with all the columns they came with, whatever their names.

    See :func:`contamination` for odd texts; rows of null or empty texts stay.
    """
    gone = small(contamination(docs, benchmark, text, id_column, **how).select(F.col("text_key").alias("_gone")).distinct())
    return docs.join(gone, identity(whole_text(docs[text])) == gone["_gone"], "left_anti")

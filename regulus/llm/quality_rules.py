"""Quality rules: a table of thresholds compiled into one Spark projection.

The statistics are Spark expressions over the whole text; each rule of the
table names a ratio of two of them and the range that passes. Compiling the
table yields one boolean column, so adding a rule is adding a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.llm.common import WORD_GAP, held, whole_text, words_of

#: Frequent short words of the corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in is that it for was on with as by at from this be are or an a he "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par pas au sur avec "
    "el y los se las del con no una su al lo como más"
).split()
#: Languages whose stop words are known; texts of others pass the rule on stop words.
STOP_LANGUAGES = ("en", "de", "fr", "es")
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``least <= top / bottom <= most``; a rule with a zero bottom passes."""

    name: str
    top: str
    bottom: str
    least: float | None = None
    most: float | None = None


#: The base of the contract comes first; the others are the method's verdict.
BASE = (Rule("too_short", "n_words", "one", least=50), Rule("repeats_itself", "n_repeat_words", "n_words", most=0.5))
RULES = (
    Rule("symbols", "n_symbols", "n_words", most=0.3),
    Rule("capitals", "n_capital_words", "n_words", most=0.5),
    Rule("exclaims", "n_exclaimed", "n_words", most=0.3),
    Rule("stop_words", "n_stop_words", "n_words", least=0.02),
    Rule("word_length_low", "word_chars", "n_words", least=2.0),
    Rule("word_length_high", "word_chars", "n_words", most=12.0),
    Rule("same_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("same_word_runs", "n_runs", "n_words", most=0.25),
)
#: Up to so many repeated windows are looked up one by one; beyond it, positions are sorted.
FEW = 48


def passes(rule: Rule) -> Column:
    top, bottom = F.col(rule.top).cast("double"), F.col(rule.bottom).cast("double")
    found = F.lit(True)
    if rule.least is not None:
        found = found & (top >= rule.least * bottom)
    if rule.most is not None:
        found = found & (top <= rule.most * bottom)
    return (F.col(rule.bottom) == 0) | found


def stops_known(docs: DataFrame, text: Column) -> Column:
    """The text's language, by the column ``lang`` or else by its script, is one whose stop words are known."""
    letters, latin = F.length(F.regexp_replace(text, r"\P{L}+", "")), F.length(F.regexp_replace(text, r"\P{IsLatin}+", ""))
    by_script = 2 * latin >= letters
    if dict(docs.dtypes).get("lang") != "string":
        return by_script
    lang = F.regexp_extract(F.lower("lang"), r"^\s*([a-z]+)", 1)
    return F.when(lang.isNull() | (lang == ""), by_script).otherwise(lang.isin(*STOP_LANGUAGES))


def statistics(docs: DataFrame, text: str = "text", keep: Sequence[Column] = ()) -> DataFrame:
    """The columns of ``keep`` and the counts of each whole text, by projections alone."""
    t = F.col("_t")
    base = docs.select(*keep, stops_known(docs, whole_text(text)).alias("stops_known"), whole_text(text).alias("_t"))
    lists = base.withColumns({"_w": words_of(t), "_l": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    w, at = F.col("_w"), lambda i: F.get(F.col("_w"), i)
    grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.coalesce(F.xxhash64(at(i), at(i + 1), at(i + 2)), F.lit(0).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    lists = lists.withColumn("_h", grams)
    h, s = F.col("_h"), F.col("_s")
    n = F.size(h)
    lists = lists.withColumn("_s", F.when(F.size(F.array_distinct(h)) < n, F.sort_array(h)).otherwise(F.array().cast("array<bigint>")))
    twice = F.array_distinct(F.filter(F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), s, lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))
    lists = lists.withColumn("_d", F.when(F.size(s) > 1, twice).otherwise(F.array().cast("array<bigint>")))
    d = F.col("_d")
    few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
    # many: positions in the order of their window's hash, of which those with an equal neighbour stay
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    lists = lists.withColumn("_p", F.when((F.size(d) > FEW), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    p = F.col("_p")
    same = lambda i, j: F.coalesce(F.get(p, i)["h"] == F.get(p, j)["h"], F.lit(False))
    many = F.sort_array(F.filter(F.transform(p, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])), lambda i: i.isNotNull()))
    lists = lists.withColumn("_r", F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) <= FEW, few).otherwise(many))
    r = F.col("_r")
    gaps = F.zip_with(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), r, lambda b, a: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.when(F.size(r) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda a, x: a + x))
    long = lambda c: c.cast("long")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return lists.select(
        *[F.col(c) for c in base.columns if c != "_t"],
        long(F.size(w)).alias("n_words"),
        long(F.length(F.regexp_replace(t, WORD_GAP, ""))).alias("word_chars"),
        long(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        held(long(covered)).alias("n_repeat_words"),
        long(F.size("_l")).alias("n_lines"),
        long(count(r"(?<![^\x20\x09-\x0D])\p{Lu}{2}")).alias("n_capital_words"),
        long(count(r"!!")).alias("n_exclaimed"),
        long(F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))).alias("n_stop_words"),
        long(count(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?=[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D]))")).alias("n_runs"),
        long(F.size(F.array_distinct(F.transform(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))))))).alias("n_distinct_words"),
        F.lit(1).cast("long").alias("one"),
    )


def judge(counted: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to the statistics."""
    all_of = lambda some: [passes(r) for r in some] or [F.lit(True)]
    ok = all_of(base)[0]
    for x in all_of(base)[1:]:
        ok = ok & x
    kept = ok
    for r in rules:
        kept = kept & (passes(r) | ~F.col("stops_known") if r.top == "n_stop_words" else passes(r))
    return counted.withColumns({"base_failed": ~ok, "kept": kept})


def quality(docs: DataFrame, text: str = "text", id_column: str = "doc_id", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row for each input row: its id, the statistics and the verdict.

    A null text counts as empty: no words, rejected by the base. Repeated rows
    are judged each; of other columns only a string ``lang`` is looked at. A null
    id stays null. An empty table gives an empty result.
    """
    counted = statistics(docs, text, [F.col(id_column).alias(id_column)])
    return judge(counted, rules).drop("one", "n_distinct_words", "stops_known")


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that every rule passes, with the columns they came with.

    Null and empty texts go; rows that repeat stay or go alike; very long texts
    are judged whole; an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return judge(statistics(docs, text, [row]), rules).where("kept").select("_row.*")

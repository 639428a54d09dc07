"""Personal data: fixed patterns find seeds, the words around seeds find more.

Seed entities are what the base patterns match. Their neighbouring words are
lexical patterns; patterns and the tokens they stand beside form a bipartite
graph whose scores are computed in rounds: a pattern is as good as the share of
its tokens that are known to be of a kind, a token as good as its patterns say.
Candidates are tokens, and runs of numbers with the spaces and brackets inside
them, without a base match; those that reach the threshold, and have the signs
and about the digits of that kind, become spans too.

Everything is a DataFrame expression; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regulus.functions.text import find_all
from regulus.llm.common import cut, identity, whole_text

KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns, with runs taken whole so that no text makes them go back over it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token that might be an identifier: a run without white space that has a digit or an at sign.
TOKEN = r"(?<!\S)(?=\S*[0-9@])\S++"
#: A run of numbers, with the sign after it where it goes on otherwise: single spaces, dots, dashes, slashes and brackets may stand inside.
NUMBERS = r"(?<![\p{L}\p{N}@_])\+?(?:\([0-9]++\)|[0-9])(?:\)?[\x20./-]?\(?[0-9])*+[\p{L}\p{N}@_]?"
#: What a candidate of a kind may look like, and how many digits it may have.
GATES = {"email": (r"^\S+@\S+$", 0, 99), "ip": (r"^[0-9A-Fa-f]*(?:[.:]+[0-9A-Fa-f]+){2,}$", 1, 32), "card": (r"^[0-9][0-9\x20./-]+$", 12, 19), "phone": (r"^[+(]?[0-9][0-9\x20()./-]+$", 6, 15)}
#: What is cut from the ends of such a token.
EDGE = r"^[^\p{L}\p{N}+]++|[^\p{L}\p{N}]++$"

#: Rounds over the graph; tokens a pattern must have met; what a pattern and what a token must reach.
ROUNDS, SUPPORT, PATTERN_SCORE, TOKEN_SCORE = 3, 4, 0.8, 0.9
#: What a token that may be of a kind counts for before it is known, and what is added to a pattern's tokens.
DOUBT, PRIOR = 0.1, 0.5
#: Characters looked at on each side for a neighbouring word.
REACH = 64
#: Spans found by patterns are broadcast to the texts up to so many spans (under 100 bytes each); beyond it the join shuffles.
BROADCAST_SPANS = 200_000

SPAN = "struct<kind:string,s:int,e:int,m:string>"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def of_kind(spans: str | Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def found(text: Column, pattern: str, kind: str) -> Column:
    """``array<SPAN>`` of the leftmost matches."""
    return F.transform(find_all(text, pattern), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("s"), x["end"].alias("e"), x["hit"].alias("m")))


def luhn(digits: Column) -> Column:
    """The sum of a Luhn check is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """``array<SPAN>`` of the base, by kind as listed, then by start."""
    digit = text.rlike("[0-9]")
    guards = {"email": text.contains("@"), "ip": digit & text.rlike(r"[0-9]\.[0-9]"), "card": digit, "phone": text.contains("+")}

    def checked(kind: str) -> Column:
        return F.filter(found(text, PATTERNS[kind], kind), lambda x: valid(kind, x["m"]))

    return F.concat(*[F.when(guards[k], checked(k)).otherwise(none()) for k in KINDS])


def digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def may_be(m: Column) -> Column:
    """The kinds whose gate lets a candidate through."""
    kinds = [F.when(m.rlike(p) & digits(m).between(least, most), F.lit(k)) for k, (p, least, most) in GATES.items()]
    return F.filter(F.array(*kinds), lambda k: k.isNotNull())


def beside(text: Column, s: Column, e: Column) -> Column:
    """The lexical patterns of a place: the word before, the two before, the word after, and both sides."""
    before = F.lower(F.substring(text, F.greatest(s - REACH, F.lit(0)) + 1, F.least(s, F.lit(REACH))))
    after = F.lower(F.substring(text, e + 1, F.lit(REACH)))
    one, two, then = F.regexp_extract(before, r"(\S+)\s+$", 1), F.regexp_extract(before, r"(\S+\s+\S+)\s+$", 1), F.regexp_extract(after, r"^\S*\s+(\S+)", 1)
    mask = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    made = F.array(
        F.when(one != "", F.concat(F.lit("<"), mask(one))),
        F.when(two != "", F.concat(F.lit("<<"), mask(two))),
        F.when(then != "", F.concat(F.lit(">"), mask(then))),
        F.when((one != "") & (then != ""), F.concat(F.lit("<>"), mask(one), F.lit(" "), mask(then))),
    )
    return F.filter(made, lambda x: x.isNotNull())


def places(texts: DataFrame) -> DataFrame:
    """``texts(text_key, t)`` -> ``(text_key, kind, s, e, m, patterns)``: seeds with their kind, candidates with null."""
    t = F.col("t")
    some = texts.where(t.rlike("[0-9@]")).withColumn("base", base_spans(t))
    apart = lambda x, spans: ~F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    runs = F.filter(found(t, NUMBERS, ""), lambda x: x["m"].rlike("[0-9]$") & (digits(x["m"]) >= 4) & apart(x, "base"))
    some = some.withColumn("runs", F.transform(runs, lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))))
    tokens = F.filter(found(t, TOKEN, ""), lambda x: apart(x, "base") & apart(x, "runs"))
    lead = lambda m: F.length(m) - F.length(F.regexp_replace(m, r"^[^\p{L}\p{N}+]++", ""))
    trimmed = F.transform(tokens, lambda x: F.struct(F.lit(None).cast("string").alias("kind"), (x["s"] + lead(x["m"])).alias("s"), (x["s"] + lead(x["m"]) + F.length(F.regexp_replace(x["m"], EDGE, ""))).alias("e"), F.regexp_replace(x["m"], EDGE, "").alias("m")))
    likely = F.filter(trimmed, lambda x: (digits(x["m"]) >= 4) | x["m"].contains("@"))
    rows = some.select("text_key", "t", F.explode(F.concat("base", "runs", likely)).alias("x"))
    return rows.select("text_key", "x.kind", "x.s", "x.e", "x.m", beside(t, F.col("x.s"), F.col("x.e")).alias("patterns"))


@dataclass(frozen=True)
class Graph:
    """``edges(p, i)`` of patterns and tokens, ``degree(p, n)`` of the patterns with support, ``known(i, kind, score)`` seeds and ``open(i, kind)``, the kinds that a candidate's gate lets through."""

    edges: DataFrame
    degree: DataFrame
    known: DataFrame
    open: DataFrame


def value(m: str) -> Column:
    """What tokens are told apart by."""
    return identity(F.lower(m))


def graph(seen: DataFrame, support: int = SUPPORT) -> Graph:
    """``places`` -> the graph of its patterns and tokens, without patterns of too little support."""
    every = seen.select(F.explode("patterns").alias("p"), value("m").alias("i")).select(identity(F.col("p")).alias("p"), "i").distinct()
    degree = cut(every.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support))
    known = cut(seen.where("kind is not null").select(value("m").alias("i"), "kind", F.lit(1.0).alias("score")).distinct())
    candidates = seen.where("kind is null").select(value("m").alias("i"), F.explode(may_be(F.col("m"))).alias("kind")).distinct()
    return Graph(cut(every.join(degree, "p").select("p", "i", "n")), degree, known, cut(candidates.join(known.select("i"), "i", "left_anti")))


def confident(g: Graph, scores: DataFrame, support: int, pattern_score: float) -> DataFrame:
    """``(p, kind, conf)``: of a pattern's tokens, the share that is of a kind.

    Tokens known to be of another kind and those that cannot be of this one
    count against it. A token that may be of the kind says little until it is
    known, or a pattern could only ever find what is rare beside it.
    """
    per = g.edges.join(scores, "i").groupBy("p", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("met"), F.first("n").alias("n"))
    per = per.withColumn("told", F.sum("met").over(Window.partitionBy("p"))).where(F.col("met") >= support)  # a pattern has a row for each kind at most
    unsure = g.edges.join(g.open.join(scores.select("i"), "i", "left_anti"), "i").groupBy("p", "kind").agg(F.count(F.lit(1)).alias("u"))
    u = F.coalesce("u", F.lit(0))
    against = F.col("told") + DOUBT * u + F.greatest(F.col("n") - F.col("told") - u, F.lit(0)) + PRIOR
    return per.join(unsure, ["p", "kind"], "left").select("p", "kind", (F.col("mass") / against).alias("conf")).where(F.col("conf") >= pattern_score)


def bootstrap(seen: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, pattern_score: float = PATTERN_SCORE, token_score: float = TOKEN_SCORE) -> DataFrame | None:
    """``places`` -> ``(text_key, kind, s, e)`` of the tokens that patterns of high confidence discover; None if they reach no token.

    A round scores patterns by their tokens, then open tokens by their patterns.
    It is the last one if no pattern is good enough or none has an open token.
    """
    g = graph(seen, support)
    scores, reached = g.known, None
    for _ in range(rounds if not g.open.isEmpty() else 0):
        good = cut(confident(g, scores, support, pattern_score))
        found = None
        if not good.isEmpty():
            told = g.edges.join(good, "p").groupBy("i", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score"))
            found = cut(told.join(g.open, ["i", "kind"]).select("i", "kind", "score"))
        if found is None or found.isEmpty():
            break
        reached, scores = found, g.known.union(found)
    if reached is None:
        return None
    best = reached.where(F.col("score") >= token_score).groupBy("i").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))
    others = seen.where("kind is null").select("text_key", "s", "e", value("m").alias("i"))
    return others.join(best, "i").select("text_key", "kind", "s", "e").distinct()


def discovered(docs: DataFrame, text: str = "text", **how) -> DataFrame | None:
    """``(text_key, more)``: the spans that patterns add to a text, in the order of the list of kinds, then by start; None if there are none."""
    texts = docs.select(whole_text(text).alias("t")).withColumn("text_key", identity(F.col("t")))
    new = bootstrap(cut(places(texts)), **how)
    if new is None:
        return None
    span = F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("o"), "s", "e", "kind")
    return cut(new.groupBy("text_key").agg(F.sort_array(F.collect_set(span)).alias("l")).select("text_key", F.transform("l", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).alias("more")))


def report(docs: DataFrame, text: str = "text", support: int = SUPPORT) -> DataFrame:
    """For each kind: seeds, open candidates its gate lets through, patterns of enough support that have a seed, and the best confidence of one."""
    texts = docs.select(whole_text(text).alias("t")).withColumn("text_key", identity(F.col("t")))
    g = graph(cut(places(texts)), support)
    kinds = docs.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    n = lambda df, name: df.groupBy("kind").agg(F.count(F.lit(1)).alias(name))
    scored = confident(g, g.known, 1, 0.0).groupBy("kind").agg(F.count(F.lit(1)).alias("patterns"), F.max("conf").alias("best"))
    return kinds.join(n(g.known, "seeds"), "kind", "left").join(n(g.open, "candidates"), "kind", "left").join(scored, "kind", "left").fillna(0)


def with_spans(docs: DataFrame, text: str, keep: list[Column], **how) -> DataFrame:
    """``keep``, the text ``_t``, its base spans ``_b`` and all its spans ``_a`` (kind, s, e)."""
    more = discovered(docs, text, **how)
    rows = docs.select(*keep, whole_text(text).alias("_t"))
    rows = rows.withColumn("_b", F.when(F.col("_t").rlike("[0-9@]"), base_spans(F.col("_t"))).otherwise(none()))
    thin = F.transform("_b", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    if more is None:
        return rows.withColumn("_a", thin)
    if (more.agg(F.sum(F.size("more"))).first()[0] or 0) <= BROADCAST_SPANS:
        more = F.broadcast(more)
    joined = rows.join(more, identity(F.col("_t")) == more["text_key"], "left")
    extra = F.coalesce("more", F.array().cast("array<struct<kind:string,s:int,e:int>>"))
    ordered = F.concat(*[F.sort_array(F.concat(of_kind(thin, k), of_kind(extra, k))) for k in KINDS])
    return joined.withColumn("_a", F.when(F.col("more").isNull(), thin).otherwise(ordered)).drop("more", "text_key")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame, text: str = "text", id_column: str = "doc_id", **how) -> DataFrame:
    """One row for each input row: counts and digest of the base spans, and all spans as text.

    Places count code points, the end excluded. A null text counts as empty and
    has no spans; repeated rows come back as often, null ids stay null; other
    columns are not looked at; an empty table gives an empty result.
    """
    rows = with_spans(docs, text, [F.col(id_column).alias("_id")], **how)
    count = lambda k: F.size(of_kind("_b", k)).cast("long").alias(f"n_{k}")
    return rows.select(F.col("_id").alias(id_column), *[count(k) for k in KINDS], F.sha2(F.encode(written(F.col("_b")), "UTF-8"), 256).alias("base_sha256"), written(F.col("_a")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with a sign of its kind for each span; of spans that overlap the first names the whole."""
    def step(a: Column, x: Column) -> Column:
        inside = x["s"] < a["at"]
        piece = F.array(F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(inside, a["out"]).otherwise(F.concat(a["out"], piece)).alias("out"))

    by_place = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("o"), x["e"].alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(by_place, start, step, lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.length(text)))), ""))


def redact(docs: DataFrame, text: str = "text", length_column: str | None = "n_chars", **how) -> DataFrame:
    """All rows and columns as they came, but with spans masked, and ``length_column`` counted anew, in texts that have some.

    Null texts stay null, rows that repeat come back as often, very long texts
    are masked whole, and an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = with_spans(docs, text, [row], **how)
    has = F.size("_a") > 0
    rows = rows.withColumn("_m", F.when(has, masked(F.col("_t"), F.col("_a"))))
    out = []
    for c in docs.columns:
        old = F.col("_row").getField(c)
        new = F.col("_m") if c == text else F.length("_m").cast(docs.schema[c].dataType) if c == length_column else old
        out.append(F.when(has, new).otherwise(old).alias(c))
    return rows.select(*out)

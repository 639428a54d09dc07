"""Scores of whole texts by a recurrent language model over all words of a corpus.

Every word that the training documents hold is counted. The most frequent ones
are symbols of their own; the others, and words never seen, fall into classes by
how often they were counted and by how they end. :mod:`regulus.llm.gated` gives
the probability of the next symbol, and within a class of rare words each has
its share of the class's count, so that all words together have probability one.
A word that was counted once would have been unknown without the document that
holds it; while the network learns, each word is therefore classed by its count
less one, which teaches it how often words are new.

Counts grow with the corpus and are joined to texts by a shuffle, except for a
bounded number of the most frequent words, which every task holds: what is
shuffled is the rare words of each text, once each. Tasks learn on their own
share of the texts from common weights, which are averaged after each round.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5
from itertools import repeat
from math import log, log10
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regulus.llm.common import cut, few, scratch, whole_text
from regulus.llm.gated import Moments, Network, Shape, untrained

#: Documents whose crc32 of the id leaves this remainder are held out.
FOLDS, HELD_OUT = 7, 2
#: Ends a text and is counted as a token; no word holds white space.
END = b"\n"
#: Words that every task holds, at most; those that are symbols; groups of rare words by how they end.
HEAD, OWN, GROUPS = 1 << 18, 512, 4
#: Words of more bytes stand for themselves by a digest.
LONGEST = 32
#: The training documents are dealt out to so many rounds, after each of which weights are averaged.
ROUNDS = 4
#: Counts from which on each band of rare words begins: none, one, two and three, then by factors of four.
BANDS = np.array([0, 1, 2, *(4**k for k in range(1, 31))], np.int64)
#: Symbols that one task holds at once, about; summed weights that meet in one task.
CHUNK, FAN = 4_000_000, 8
#: Set in a symbol whose word falls into the band below once one occurrence is taken away.
EDGE = 1 << 14


def words_of(column: pa.Array) -> Iterator[list[bytes]]:
    """The words of each text, between ASCII white space, with A-Z in lower case; the end is not among them."""
    return (t.lower().split() for t in column.cast(pa.binary()).to_pylist())


def key(word: bytes) -> bytes:
    """What stands for a word: itself, or 18 bytes if it is long."""
    return word if len(word) <= LONGEST else END + md5(word).digest() + word[-2:]


def ending(word: bytes) -> int:
    return crc32(word[-2:]) % GROUPS


def band(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, counts, "right") - 1


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def word_counts(texts: DataFrame, most: int = 400_000) -> DataFrame:
    """``(word, n)`` over ``texts(text)``: each task counts what it reads, ``most`` different words at a time."""

    def each(batches):
        def told(c: Counter[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], names=["word", "n"])

        counted: Counter[bytes] = Counter()
        for b in few(batches):
            for words in words_of(b.column(0)):
                counted.update(words)
            counted[END] += len(b)
            if len(counted) > most:
                yield told(short(counted))
                counted.clear()
        yield told(short(counted))

    def short(c: Counter[bytes]) -> Counter[bytes]:
        for w in [w for w in c if len(w) > LONGEST]:
            c[key(w)] += c.pop(w)
        return c

    return texts.mapInArrow(each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows of the counts: ``totals[band, group]`` sums those of rare words, ``seen`` as if each were counted once less."""

    head: list[bytes]
    counts: np.ndarray
    own: int
    totals: np.ndarray
    seen: np.ndarray
    tokens: int
    distinct: int
    bands: int

    @property
    def shape(self) -> Shape:
        return Shape(self.own, self.bands * GROUPS)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-one share of words counted so often."""
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))

    def rare(self, counts: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of rare words, flagged at the edge of their band, and log10 of the share in their class."""
        b = band(counts)
        edge = (counts > 0) & (counts == BANDS[b])
        share = np.where(counts > 0, counts / np.maximum(self.totals[b, groups], 1), 1.0)
        return (self.own + b * GROUPS + groups) | np.where(edge, EDGE, 0), np.log10(share)

    def of_head(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, share and base of each word of the head."""
        symbols, shares = self.rare(self.counts, np.array([ending(w) for w in self.head], np.int64))
        symbols[: self.own], shares[: self.own] = np.arange(self.own), 0.0
        return symbols, shares, self.base(self.counts)


def often(n: Column) -> Column:
    """Which of at most some hundred steps a count falls into."""
    return F.floor(8 * F.log2(n)).cast("int")


def vocabulary(counts: DataFrame, head: int, own: int) -> tuple[Vocabulary, int]:
    """The vocabulary, and the step of counts from which on words are in its head."""
    steps = counts.groupBy(often(F.col("n")).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("step")).collect()  # some hundred rows
    least, room = (steps[0]["step"] + 1 if steps else 0), head
    for r in steps:
        if (room := room - r["words"]) < 0:
            break
        least = r["step"]
    top = counts.where(often(F.col("n")) >= least).select("word", "n").toArrow()  # at most HEAD words of at most LONGEST bytes
    found = sorted(zip(top.column(0).to_pylist(), top.column(1).to_pylist()), key=lambda x: (-x[1], x[0]))
    words, n = [w for w, _ in found], np.array([c for _, c in found], np.int64)
    own = min(own, len(words))
    group = (F.crc32(F.substring("word", -2, 2)) % GROUPS).cast("int")
    within = sum((F.when(F.col("n") >= int(b), 1).otherwise(0) for b in BANDS[1:]), F.lit(0)).alias("band")
    at_edge = F.sum(F.when(F.col("n").isin(BANDS.tolist()), F.col("n")).otherwise(0)).alias("edge")
    totals, seen = np.zeros((len(BANDS), GROUPS), np.int64), np.zeros((len(BANDS), GROUPS), np.int64)
    for r in counts.groupBy(within, group.alias("group")).agg(F.sum("n").alias("n"), at_edge).collect():  # at most a row for each band and group
        totals[r["band"], r["group"]] = r["n"]
        seen[r["band"], r["group"]] += r["n"] - r["edge"]
        seen[r["band"] - 1, r["group"]] += r["edge"]
    for w, c, b in zip(words[:own], n[:own].tolist(), band(n[:own]).tolist()):
        totals[b, ending(w)] -= c
        seen[b - (c in BANDS), ending(w)] -= c
    bands = int(np.flatnonzero(totals.sum(axis=1)).max(initial=0)) + 1
    return Vocabulary(words, n, own, totals, seen[:bands], sum(r["tokens"] for r in steps), sum(r["words"] for r in steps), bands), least


def packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The values between each two starts, as one binary entry."""
    ends = starts * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def coded(rows: DataFrame, known: Vocabulary) -> DataFrame:
    """``rows(row, id, held, text)`` with the places of its words in the head, ``-1 - j`` for the j-th other word, and these words."""
    words = known.head
    kind = rows.schema["id"].dataType.simpleString()

    def each(batches):
        places = {w: i for i, w in enumerate(words)}
        for b in few(batches):
            codes, others = [], []
            for found in words_of(b.column(3)):
                found.append(END)
                at = np.fromiter(map(places.get, found, repeat(-1)), np.int32, len(found))
                mine: dict[bytes, int] = {}
                for i in np.flatnonzero(at < 0).tolist():
                    w = key(found[i])
                    at[i] = places[w] if w in places else mine.setdefault(w, -1 - len(mine))
                codes.append(at)
                others.append(list(mine))
            starts = np.cumsum([0, *map(len, codes)])
            codes = np.concatenate(codes) if codes else np.empty(0, np.int32)
            groups = [bytes(map(ending, ws)) for ws in others]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], packed(codes, starts), pa.array(others, pa.list_(pa.binary())), pa.array(groups, pa.binary())], names=["row", "id", "held", "codes", "others", "groups"])

    return rows.select("row", "id", "held", "text").mapInArrow(each, f"row long, id {kind}, held boolean, codes binary, others array<binary>, groups binary")


def symbols(rows: DataFrame, known: Vocabulary) -> DataFrame:
    """``rows(id, held, codes, groups, found)`` -> the symbols of each text and what its score has beside them; ``found`` has the places and counts of other words that are known."""
    kind = rows.schema["id"].dataType.simpleString()

    def each(batches):
        of_head = known.of_head()
        for b in few(batches):
            codes, groups, found = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)
            at = np.frombuffer(b"".join(codes), np.int32)
            sizes = np.array([len(c) // 4 for c in codes], np.int64)
            starts = np.cumsum([0, *sizes])
            # the other words of all texts one after the other, and how often each was counted
            other = np.frombuffer(b"".join(groups), np.uint8).astype(np.int64)
            begins = np.cumsum([0, *map(len, groups)])
            n, told = np.zeros(len(other), np.int64), found.flatten()
            of = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
            n[begins[of] + told.field(0).to_numpy()] = told.field(1).to_numpy()
            symbol, share, base = (x[np.maximum(at, 0)] if len(x) else np.zeros(len(at), x.dtype) for x in of_head)
            rare = np.flatnonzero(at < 0)
            which = begins[np.searchsorted(starts, rare, "right") - 1] - 1 - at[rare]
            symbol[rare], share[rare] = (x[which] for x in known.rare(n, other))
            base[rare] = known.base(n)[which]
            unknown = np.zeros(len(at), np.int64)
            unknown[rare] = n[which] == 0
            sums = lambda x: np.add.reduceat(x, starts[:-1]) if len(b) else x  # noqa: E731  each text has an end
            made = [packed(symbol.astype(np.int16), starts), pa.array(sums(share), pa.float64()), pa.array(sums(base), pa.float64()), pa.array(sizes, pa.int64()), pa.array(sizes - sums(unknown), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["id", "held", "symbols", "share", "base", "n_tokens", "n_known"])

    return rows.select("id", "held", "codes", "groups", "found").mapInArrow(each, f"id {kind}, held boolean, symbols binary, share double, base double, n_tokens long, n_known long")


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches together until they hold :data:`CHUNK` symbols, and the symbols of their texts."""
    held, texts, n = [], [], 0
    for b in few(batches):
        held.append(b)
        for s in b.column(column):
            texts.append(np.frombuffer(s.as_py(), np.int16))
            n += len(texts[-1])
        if n >= CHUNK:
            yield held, texts
            held, texts, n = [], [], 0
    if held:
        yield held, texts


def without_one(text: np.ndarray) -> np.ndarray:
    """The symbols as if each word were counted once less."""
    return np.where(text & EDGE, (text & (EDGE - 1)) - GROUPS, text).astype(np.int16)


def averaged(parts: DataFrame) -> np.ndarray | None:
    """``parts(n, weights)``: the mean of the weights, by how many symbols they learnt from; some meet in each task."""

    def merge(batches):
        n, total = 0, None
        for b in batches:
            for r in b.to_pylist():
                w = np.frombuffer(r["weights"], np.float64)
                n, total = n + r["n"], w if total is None else total + w
        held = [] if total is None else [total.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([n] * len(held), pa.int64()), pa.array(held, pa.binary())], names=["n", "weights"])

    level = cut(parts)
    left = level.count()
    while left > 1:
        level = cut(level.repartition(-(-left // FAN)).mapInArrow(merge, "n long, weights binary"))
        left = level.count()
    last = level.first()  # the weights of one network
    return np.frombuffer(last["weights"], np.float64) / last["n"] if last else None


def learned(rows: DataFrame, shape: Shape, flat: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after some rounds over ``rows(draw, symbols)``, each over texts of its own: tasks learn apart and their weights are averaged."""
    for k in range(rounds):
        begin = flat

        def each(batches, begin=begin):
            weights, n = begin.copy(), 0
            moments = Moments(len(weights))
            for _, texts in chunks(batches, 0):
                n += Network(shape, weights).learn([without_one(t) for t in texts], moments)
            held = [(weights.astype(np.float64) * n).tobytes()] if n else []
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(held), pa.int64()), pa.array(held, pa.binary())], names=["n", "weights"])

        mean = averaged(rows.where(F.col("draw") == k).select("symbols").mapInArrow(each, "n long, weights binary"))
        flat = flat if mean is None else mean.astype(np.float32)
    return flat


def scored(rows: DataFrame, shape: Shape, flat: np.ndarray, known: Vocabulary) -> DataFrame:
    """``rows(id, held, symbols, share, base, n_tokens, n_known)`` -> the contract's columns."""
    kind = rows.schema["id"].dataType.simpleString()
    total = known.tokens

    def each(batches):
        network = Network(shape, flat)
        for held, texts in chunks(batches, 2):
            logs = network.score([t & (EDGE - 1) for t in texts]) / log(10)
            at = 0
            for b in held:
                mine = logs[at : at + len(b)] + b.column(3).to_numpy()
                at += len(b)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(5), b.column(6), pa.array([total] * len(b), pa.int64()), b.column(4), pa.array(mine, pa.float64())], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    columns = ["id", "held", "symbols", "share", "base", "n_tokens", "n_known"]
    return rows.select(*columns).mapInArrow(each, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def stored(spark: SparkSession, df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    paths.append(scratch(spark, name))
    df.write.parquet(paths[-1])
    return spark.read.schema(df.schema).parquet(paths[-1])


def prepared(docs: DataFrame, text: str, id_column: str, head: int, own: int, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, Vocabulary]:
    """Every row's symbols, and the vocabulary of those that are not held out."""
    rows = docs.select(F.col(id_column).alias("id"), held_out(F.col(id_column)).alias("held"), whole_text(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    counts = keep(word_counts(rows.where("not held").select("text")), "counts")
    known, least = vocabulary(counts, head, own)
    codes = keep(coded(rows, known), "codes")
    others = codes.select("row", F.posexplode("others").alias("at", "word"))
    met = others.join(counts.where(often(F.col("n")) < least), "word").groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    return keep(symbols(codes.drop("others").join(met, "row", "left"), known), "symbols"), known


def score(docs: DataFrame, text: str = "text", id_column: str = "doc_id", head: int = HEAD, own: int = OWN, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``score`` is log10 of the whole text's probability, however long it is; the
    network's state is carried on to its end. Null and empty texts are the end
    alone. A null id counts as an empty one when documents are held out, and
    stays null; rows that repeat are counted and come back as often. Other
    columns are not looked at. With all documents held out nothing is known and
    each word has the probability of an unknown one; an empty table gives an
    empty result.
    """
    spark, paths = docs.sparkSession, []
    rows, known = prepared(docs, text, id_column, head, own, lambda df, name: stored(spark, df, name, paths))
    flat = untrained(known.shape, np.concatenate([known.counts[: known.own], known.seen.reshape(-1)]))
    teach = rows.where("not held").withColumn("draw", F.pmod(F.xxhash64("symbols"), F.lit(rounds)))
    flat = learned(teach, known.shape, flat, rounds)
    return scored(rows, known.shape, flat, known).withColumnRenamed("id", id_column)

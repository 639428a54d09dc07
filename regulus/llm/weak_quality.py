"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Their votes
are counted by pattern, of which there are at most three to the power of the
labellers, and expectation-maximisation over the counts estimates how often
each labeller errs. The posterior of a pattern is the soft label of the
documents that have it. A linear scorer over hashed words and word shapes
learns the soft labels of a bounded sample and scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from math import exp
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.llm.common import few, whole_text
from regulus.llm.quality_rules import statistics

#: Documents that the scorer learns from, at most, and the features of all of them together; places of the hash.
TRAIN_ROWS, TRAIN_FEATURES, PLACES = 8_000, 16_000_000, 1 << 15
#: Rounds of expectation-maximisation and of gradient descent; step and decay of the latter.
EM_ROUNDS, FIT_ROUNDS, STEP, DECAY = 60, 120, 4.0, 1e-4
#: What depends on a vocabulary says nothing about texts of fewer words.
ENOUGH = 20
#: Documents that score so much are kept.
KEEP = 0.5


@dataclass(frozen=True)
class Labeller:
    """Votes on ``top / bottom``: bad from ``bad`` on (``high``) or down from it, good on the other side of ``good`` if it has one."""

    top: str
    bottom: str
    bad: float
    high: bool = True
    good: float | None = None


#: Most know one symptom and say nothing where it is absent.
LABELLERS = (
    Labeller("n_symbols", "n_words", 0.3),
    Labeller("n_capital_words", "n_words", 0.5),
    Labeller("n_exclaimed", "n_words", 0.3),
    Labeller("n_stop_words", "some_words", 0.03, high=False, good=0.1),
    Labeller("n_distinct_words", "root_words", 2.0, high=False),
    Labeller("n_dup_lines", "n_lines", 0.6),
    Labeller("n_runs", "n_words", 0.2),
)


def vote(one: Labeller) -> Column:
    """2 for good, 0 for bad, 1 for none."""
    ratio = F.when(F.col(one.bottom) > 0, F.col(one.top) / F.col(one.bottom))
    said = F.when(ratio >= one.bad if one.high else ratio <= one.bad, 0)
    if one.good is not None:
        said = said.when(ratio <= one.good if one.high else ratio >= one.good, 2)
    return said.otherwise(1)


def votes(docs: DataFrame, text: str, keep: Sequence[Column], labellers: Sequence[Labeller] = LABELLERS) -> DataFrame:
    """``keep`` and ``pattern``, the votes as a number in base three."""
    n = F.col("n_words")
    counted = statistics(docs, text, keep).withColumns({"root_words": F.when(n >= ENOUGH, F.sqrt(n)), "some_words": F.when(n >= ENOUGH, n)})
    pattern = sum((vote(x) * 3**i for i, x in enumerate(labellers)), F.lit(0)).cast("int")
    kept = [c for c in counted.columns[: len(keep)]]
    return counted.select(*kept, pattern.alias("pattern"))


def digits(patterns: np.ndarray, labellers: int) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(labellers)) % 3


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The posterior of good for each pattern, and ``p[labeller, class, vote]``.

    It starts from the majority; a labeller is taken to be right more often
    than not. Half a count is added everywhere, so nothing is ever certain.
    """
    seen = digits(patterns, labellers)
    good = 1 + (seen == 2).sum(1) - 2.0 * (seen == 0).sum(1)
    post = 1 / (1 + np.exp(-good))
    p = np.full((labellers, 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        for v in range(3):
            p[:, :, v] = 0.5 + np.einsum("cn,nl->lc", weight, (seen == v).astype(float))
        p /= p.sum(2, keepdims=True)
        prior = (weight.sum(1) + 0.5) / (weight.sum() + 1)
        log = np.log(prior)[:, None] + sum(np.log(p[k][:, seen[:, k]]) for k in range(labellers))
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
    return post, p


GAPS = ((re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[0-9]+"), "0"))


def shape(word: str) -> str:
    for runs, sign in GAPS:
        word = runs.sub(sign, word)
    return word[:12]


def repeats(text: str, words: list[str], counted: Counter[str]) -> dict[str, float]:
    """How much of a text repeats: words after themselves, lines, and words at all."""
    n, lines = len(words), [x for x in text.split("\n") if x and not x.isspace()]
    return {"runs": sum(map(str.__eq__, words, words[1:])) / n, "lines": 1 - len(set(lines)) / max(1, len(lines)), "few": max(0.0, 1 - len(counted) / (4 * n**0.5)) if n >= ENOUGH else 0.0}


class Hasher:
    """A text's hashed features: places and values, of words, of shapes and of how much repeats."""

    def __init__(self, places: int, cached: int = 400_000):
        self.places, self.cached, self.known = places, cached, {}

    def of(self, word: str) -> tuple[int, str]:
        if (got := self.known.get(word)) is None:
            if len(self.known) >= self.cached:
                self.known.clear()
            got = self.known[word] = (self.place("w:" + word.lower()), shape(word))
        return got

    def place(self, name: str) -> int:
        return crc32(name.encode("utf-8", "surrogatepass")) % self.places

    def __call__(self, text: str) -> tuple[list[int], list[float]]:
        words = text.split()
        n = len(words)
        if not n:
            return [], []
        at: list[int] = []
        value: list[float] = []
        shapes: Counter[str] = Counter()
        counted = Counter(words)
        for w, c in counted.items():
            i, s = self.of(w)
            at.append(i)
            value.append((c / n) ** 0.5)
            shapes[s] += c
        for s, c in shapes.items():
            at.append(self.place("s:" + s))
            value.append(2 * (c / n) ** 0.5)
        for name, x in repeats(text, words, counted).items():
            at.append(self.place("r:" + name))
            value.append(3 * x)
        return at, value


class Scorer(dict):
    """The scorer's sum for a text: what :class:`Hasher` would give, weighed, with a word's weight and shape looked up once."""

    def __init__(self, w: np.ndarray, bias: float, cached: int = 400_000):
        super().__init__()
        self.w, self.bias, self.cached = w, bias, cached
        self.hasher = Hasher(len(w), 1)
        self.shapes: dict[str, float] = {}

    def __missing__(self, word: str) -> tuple[float, str]:
        if len(self) >= self.cached:
            self.clear()
        got = self[word] = (float(self.w[self.hasher.place("w:" + word.lower())]), shape(word))
        return got

    def named(self, name: str) -> float:
        if name not in self.shapes:
            self.shapes[name] = float(self.w[self.hasher.place(name)])
        return self.shapes[name]

    def __call__(self, text: str) -> float | None:
        words = text.split()
        n = len(words)
        if not n:
            return None
        counted = Counter(words)
        z, shapes = 0.0, {}
        for w, c in counted.items():
            weight, s = self[w]
            z += weight if c == 1 else weight * c**0.5
            shapes[s] = shapes.get(s, 0) + c
        z += sum(2 * self.named("s:" + s) * c**0.5 for s, c in shapes.items())
        return self.bias + z / n**0.5 + sum(3 * x * self.named("r:" + name) for name, x in repeats(text, words, counted).items())


def fit(rows: Sequence[tuple[list[int], list[float]]], soft: np.ndarray, places: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by gradient descent with momentum."""
    w, bias, dw, db = np.zeros(places), 0.0, np.zeros(places), 0.0
    n = len(rows)
    if not n:
        return w, bias
    sizes = np.array([len(a) for a, _ in rows])
    row = np.repeat(np.arange(n), sizes)
    at = np.concatenate([np.asarray(a, np.int64) for a, _ in rows])
    value = np.concatenate([np.asarray(v, float) for _, v in rows])
    heavy = np.array([1 - soft.mean(), soft.mean()]).clip(0.02)  # both classes weigh the same
    each = np.where(soft >= 0.5, 0.5 / heavy[1], 0.5 / heavy[0])
    each /= each.sum()
    for _ in range(FIT_ROUNDS):
        z = np.bincount(row, value * w[at], n) + bias
        off = (1 / (1 + np.exp(-z.clip(-30, 30))) - soft) * each
        dw = 0.9 * dw + np.bincount(at, value * off[row], places) + DECAY * w
        db = 0.9 * db + off.sum()
        w, bias = w - STEP * dw, bias - STEP * db
    return w, bias


def features(sample: DataFrame, places: int) -> DataFrame:
    """``sample(h, soft, text)`` -> ``(h, soft, at, value)``: the hashed features of each text, at most one for each place."""

    def each(batches):
        hasher = Hasher(places)
        for b in few(batches):
            made = []
            for t in b.column(2):
                at, value = hasher(t.as_py())
                if len(at) > places:  # features of a place are added up, as the scorer does
                    sums = np.bincount(at, value, places)
                    at = np.flatnonzero(sums)
                    value = sums[at]
                made.append((np.asarray(at, np.int32), np.asarray(value, float)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in made], pa.list_(pa.int32())), pa.array([x[1] for x in made], pa.list_(pa.float64()))], names=["h", "soft", "at", "value"])

    return sample.select("h", "soft", "text").mapInArrow(each, "h long, soft double, at array<int>, value array<double>")


def learn(sample: DataFrame, places: int, most: int, most_features: int = TRAIN_FEATURES) -> tuple[np.ndarray, float]:
    """``sample(h, soft, text)`` -> weights and bias, in one task over the rows of least ``h``: at most ``most`` of them, and at most ``most_features`` features."""

    def each(batches):
        rows, soft, room = [], [], most_features
        for b in batches:
            for p, at, value in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
                if len(rows) < most and room > 0:
                    rows.append((at.values.to_numpy(), value.values.to_numpy()))
                    soft.append(p)
                    room -= len(rows[-1][0])
        w, bias = fit(rows, np.array(soft), places)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()]), pa.array([float(bias)])], names=["w", "bias"])

    got = features(sample, places).repartition(1).sortWithinPartitions("h", "soft", F.size("at")).mapInArrow(each, "w binary, bias double").first()
    return (np.frombuffer(got["w"], "<f8"), got["bias"]) if got else (np.zeros(places), 0.0)


def classify(docs: DataFrame, text: str = "text", id_column: str = "doc_id", labellers: Sequence[Labeller] = LABELLERS, train_rows: int = TRAIN_ROWS, places: int = PLACES, keep: float = KEEP) -> DataFrame:
    """``doc_id``, ``score`` (of good, 0 to 1) and ``kept`` for each input row.

    The vote patterns are counted over all documents. The scorer learns from
    at most ``train_rows`` of them, chosen by a hash of id and text, so the
    same table gives the same model; texts become features where they are read,
    and only these meet in one task. A text without words, or a null one,
    scores zero. Rows that repeat come back as often, null ids stay null,
    other columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.col(id_column), F.col(text))
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text).alias("text"), h.alias("h"))
    counted = votes(rows, "text", [], labellers).groupBy("pattern").count().collect()  # at most 3 ** labellers rows
    patterns, counts = np.array([r[0] for r in counted], int), np.array([r[1] for r in counted], float)
    model = np.zeros(places), 0.0
    if counts.sum():
        post, _ = expectation_maximisation(patterns, counts, len(labellers))
        soft = F.element_at(F.create_map(*[F.lit(x) for kv in zip(patterns.tolist(), post.tolist()) for x in kv]), F.col("pattern"))
        share = min(1.0, 1.2 * train_rows / counts.sum())
        chosen = rows.where(F.pmod(F.col("h"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        sample = votes(chosen, "text", [F.col("h"), F.col("text")], labellers).withColumn("soft", soft)
        model = learn(sample, places, train_rows)
    w, bias = model

    def each(batches):
        scorer = Scorer(w, bias)
        for b in few(batches):
            sums = [scorer(t.as_py()) for t in b.column(1)]
            scores = [0.0 if z is None else 1 / (1 + exp(-min(30.0, max(-30.0, z)))) for z in sums]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([s >= keep for s in scores], pa.bool_())], names=["id", "score", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(each, f"id {kind}, score double, kept boolean").withColumnRenamed("id", id_column)

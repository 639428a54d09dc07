"""Language-model scoring, importance resampling and whitening against versions without Spark."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from regulus.llm import gated, importance, language_model, whitening
from tests.llm.test_operators import documents, empty

ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# 12: importance resampling


def buckets(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(rows, target):
    """The contract, line by line."""
    docs = [(i, *buckets(t)) for i, t in rows]
    s, t = collections.Counter(b for d in docs for b in d[2]), collections.Counter(b for x in target for b in buckets(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, n, bs in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, bs))
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return collections.Counter((*r[:4], ranks.get(id(r))) for r in out)


def test_importance(spark, sf):
    rng = random.Random(12)
    made = [(100 + i, " ".join(rng.choice("Tea tea-cup é ÉTÉ x1 naïve 東京 ① the of".split()) for _ in range(rng.randrange(60)))) for i in range(150)]
    odd, target = documents(spark, made), spark.createDataFrame([("tea of the cup",), (None,), ("",)], "text string")
    given = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    for docs, wanted in ((odd, target), (odd, target.limit(0)), given):
        got = importance.resample(docs, wanted)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert collections.Counter(map(tuple, got.collect())) == resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in wanted.collect()])
    assert importance.resample(empty(spark), target).count() == 0


def test_ranks_go_on_from_range_to_range(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 7 > 0, 100).otherwise(3).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), (F.col("id") % 50).alias("score"))
    got = {r["id"]: r["rank"] for r in importance.drawn(rows, 57, 40).collect()}
    able = sorted((i for i in range(5000) if i % 7), key=lambda i: (-(i % 50), i))
    want = {i: k + 1 for k, i in enumerate(able[: 40 * len(able) // 100])}
    assert got == {i: want.get(i) for i in range(5000)}


# 13: whitening


def vectors(spark):
    rng = np.random.default_rng(13)
    mixed = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6)) * 0.2
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    rows += rows[:3] * 40 + [(None, rows[0][1])]
    bad = [(900, None), (901, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (904, [1.0, 2.0]), (905, [])]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<double>, x string, n int")


def brute(rows):
    x = {tuple(math.floor(256 * c) for c in v) for _, v in rows}
    fit = np.array(sorted(x), float)
    cov = np.cov(fit.T, bias=True)
    e, v = np.linalg.eigh(cov)
    return len(x), [sum(c) for c in zip(*sorted(x))], e[::-1], v[:, ::-1]


def held_to_brute(got, rows):
    n, sums, e, v = brute(rows)
    d = len(sums)
    by_row = collections.defaultdict(list)
    for r in got:
        by_row[r.vec_id].append(r)
    assert collections.Counter(r.vec_id for r in got) == {i: min(4, d) * c for i, c in collections.Counter(i for i, _ in rows).items()}
    signs = {}
    for i, vector in rows:
        x = [math.floor(256 * c) for c in vector]
        for r in by_row[i]:
            k = r.component - 1
            assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums))
            assert r.explained == pytest.approx(e[k] / e.sum(), rel=1e-9) and 0 <= r.identity_error < 1e-9
            want = (np.array(x) - np.array(sums) / n) @ v[:, k] / math.sqrt(e[k])
            if abs(want) > 1e-6:
                assert signs.setdefault(k, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-7, abs=1e-7)


def test_whitening(spark, sf):
    rows, df = vectors(spark)
    got = whitening.whiten(df.repartition(9))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held_to_brute(got.collect(), rows)
    given = spark.read.parquet(f"{sf}/embeddings.parquet")
    held_to_brute(whitening.whiten(given).collect(), [(r.vec_id, r.embedding) for r in given.collect()])
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 900 and vec_id < 904")).count() == 0


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained == 0 and r.n == 1 and r.deviation == 0 for r in got)
    line = spark.createDataFrame([(i, [0.5 * i, 0.25]) for i in range(5)], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(line).collect()}
    assert got[0, 1].explained == pytest.approx(1) and got[0, 2].whitened is None and sum(got[i, 1].whitened ** 2 for i in range(5)) / 5 == pytest.approx(1)


def test_summaries_merge_without_loss():
    rng = np.random.default_rng(7)
    x = (rng.standard_normal((700, 9)) @ rng.standard_normal((9, 9)) * 1e5).astype(np.int64)
    x[0] = 1 << 40  # far from all others
    cuts = [0, 1, 2, 5, 300, 700]
    parts = [whitening.Summary.of(x[a:b]) for a, b in zip(cuts, cuts[1:])]
    a, b, c, d, e = parts
    for whole in (a + b + c + d + e, (e + d) + ((c + b) + a)):
        value, _ = whole.eigen()
        want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2 / 700
        assert whole.n == 700 and whole.sums() == [int(s) for s in x.astype(object).sum(axis=0)] and value == pytest.approx(want, rel=1e-9)
        spread = whole.vectors.T @ (whole.values[:, None] ** 2 * whole.vectors) / 700
        assert np.abs(spread - np.cov(x.T.astype(float), bias=True)).max() <= 1e-9 * np.abs(spread).max()


def test_deviations_beyond_a_long():
    assert whitening.deviations(np.array([[1 << 40, 0]]), 1000, [5, 5]) == [None]
    assert whitening.deviations(np.array([[1 << 20, 3]]), 1000, [5, 5]) == [(1000 * (1 << 20) - 5) ** 2 + 2995**2]


# 11: language model


def test_gradients():
    rng = np.random.default_rng(0)
    shape = gated.Shape(70, 5, 6)
    flat = gated.untrained(shape, rng.integers(1, 100, shape.start)).astype(float)
    dealt = gated.Lanes([rng.integers(0, shape.start, n).astype(np.int16) for n in (7, 3, 12, 1)], 2, shape.start)
    at, there = next(dealt.windows(40))
    inputs = dealt.inputs[at]
    keep, none = (inputs != shape.start).astype(float), np.zeros((at.shape[1], 6))
    targets = dealt.targets[at[there]].astype(int)

    def loss(w):
        net = gated.Network(shape, w)
        return -net.output(net.forward(inputs, keep, none)["after"][there], targets)[0].sum()

    change = np.zeros(shape.size)
    net, grads = gated.Network(shape, flat), shape.split(change)
    run = net.forward(inputs, keep, none)
    d = np.zeros(run["after"].shape)
    d[there] = net.output(run["after"][there], targets, grads)[1]
    net.backward(run, keep, inputs, d, grads)
    for i in rng.choice(shape.size, 80, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert change[i] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=2e-2, abs=2e-2)


def plainly(shape, flat, text):
    """Log-probability of one text, a symbol at a time and without lanes or windows."""
    w, h, h_size = shape.split(flat.astype(float)), np.zeros(shape.state), shape.state
    total, before = 0.0, shape.start
    for s in text:
        x, u = w["inputs"][before], h @ w["again"]
        z, r = (1 / (1 + np.exp(-(x[k * h_size : (k + 1) * h_size] + u[k * h_size : (k + 1) * h_size]))) for k in (0, 1))
        n = np.tanh(x[2 * h_size :] + r * u[2 * h_size :])
        h = z * h + (1 - z) * n
        logits = h @ w["to_class"] + w["class_bias"]
        k = s // gated.PER_CLASS if s < shape.own else s - shape.own + shape.word_classes
        total += logits[k] - np.log(np.exp(logits).sum())
        if s < shape.own:
            mine = slice(k * gated.PER_CLASS, min((k + 1) * gated.PER_CLASS, shape.own))
            logits = w["to_word"][mine] @ h + w["word_bias"][mine]
            total += logits[s - mine.start] - np.log(np.exp(logits).sum())
        before = s
    return total


def test_state_is_carried_over_windows():
    rng = np.random.default_rng(1)
    shape = gated.Shape(40, 7, 8)
    flat = gated.untrained(shape, rng.integers(1, 100, shape.start))
    texts = [rng.integers(0, shape.start, n).astype(np.int16) for n in (1, 200, 33, 32, 31, 5, 5, 64)]
    moments = gated.Moments(shape.size)
    net = gated.Network(shape, flat)
    before = net.score(texts).sum()
    for _ in range(30):
        net.learn(texts, moments, 4)
    assert net.score(texts).sum() > before
    for lanes, steps in ((3, 32), (8, 7), (1, 1)):
        assert net.score(texts, lanes, steps) == pytest.approx([plainly(shape, flat, t) for t in texts], rel=1e-4)
    assert len(net.score([])) == 0


def tokens(t):
    return [*ASCII_WORD.findall(lowered(t)), "\n"]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


@pytest.mark.parametrize("head", [1 << 18, 40])
def test_language_model_counts(spark, sf, head):
    rng = random.Random(3)
    made = [(i, " ".join(rng.choice(["The", "the", "of\x1cx", "é", f"w{rng.randrange(300)}", "-" * 70 + str(rng.randrange(3))]) for _ in range(rng.randrange(90)))) for i in range(20, 80)]
    for docs in (documents(spark, made), spark.read.parquet(f"{sf}/documents.parquet").withColumn("row", F.lit(1))):
        got = language_model.score(docs, head=head, rounds=1)
        assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        rows = [(r.doc_id, tokens(r.text)) for r in docs.select("doc_id", "text").collect()]
        count = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
        n, v = sum(count.values()), len(count)
        want = collections.Counter((i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in rows)
        got = got.collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
        beside = [r for r in got if r.held_out and r.n_tokens > 20]
        assert sum(r.score for r in beside) > sum(r.base_score for r in beside)


def test_language_model_learns_order_and_sums_to_one(spark, tmp_path):
    rng = random.Random(5)
    follow = {"a": "b", "b": "c", "c": "a"}
    texts = []
    for i in range(700):
        w = [rng.choice("abc")]
        while len(w) < 40:
            w.append(follow.get(w[-1], "a") if rng.random() < 0.9 else rng.choice(["a", "b", "c", f"r{rng.randrange(2000)}"]))
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    score = lambda rounds: {r.doc_id: r for r in language_model.score(docs, rounds=rounds, own=8).collect() if r.held_out}
    plain, taught = score(0), score(2)
    gain = sum(taught[i].score - plain[i].score for i in taught) / sum(r.n_tokens for r in taught.values())
    assert gain > 0.05  # log10 a token
    # after a text's first words, all that may follow has probability one: each known word, and an unknown one of each ending
    count = collections.Counter(w for i, t in texts if not held(i) for w in tokens(t) if w != "\n")
    news = {language_model.ending(w.encode()): w for w in (f"zz{k}" for k in range(200))}
    probes = [(10_000 + k, x) for k, x in enumerate(["a b", *(f"a b {w}" for w in [*count, *news.values()])])]
    ids = [j for j in range(100_000, 400_000) if held(j)]
    asked = docs.union(spark.createDataFrame([(ids[k], t) for k, (_, t) in enumerate(probes)], "doc_id long, text string"))
    paths = []
    rows, known = language_model.prepared(asked, "text", "doc_id", 1 << 18, 8, lambda df, name: language_model.stored(spark, df, name, paths))
    flat = gated.untrained(known.shape, np.concatenate([known.counts[: known.own], known.seen.reshape(-1)]))
    net = gated.Network(known.shape, flat)
    found = {r["id"]: (np.frombuffer(r["symbols"], np.int16) & (language_model.EDGE - 1), r["share"]) for r in rows.where(F.col("id") >= 100_000).collect()}
    assert len(news) == language_model.GROUPS
    log10 = lambda i, n: net.score([found[ids[i]][0][:n]])[0] / math.log(10) + found[ids[i]][1]
    start = log10(0, 2)
    whole = sum(10 ** (log10(k, 3) - start) for k in range(1, len(probes))) + 10 ** (log10(0, 3) - start)
    assert whole == pytest.approx(1, rel=1e-4)


def test_language_model_odd_tables(spark):
    assert language_model.score(empty(spark)).count() == 0
    alone = spark.createDataFrame([(i, "some words") for i in range(100) if held(i)], "doc_id long, text string")
    got = language_model.score(alone).collect()
    assert got and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in got)

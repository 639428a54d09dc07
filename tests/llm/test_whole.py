"""Whole queries against brute-force versions: the classifier, and the pipeline from documents to sequences."""

import collections
import itertools
import math
import re
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from regulus.llm import packing, quality_rules, weak_quality
from tests.llm.test_operators import WORD, alike, base_spans, counted, documents, grouped, prints


def statistics(t):
    """All that rules and labellers look at, worked out word by word."""
    t = t or ""
    words = WORD.findall(t)
    n_words, chars, symbols, dup_lines, repeat = counted(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    upper = lambda w: len(w) > 1 and all(re.match(r"[^\W\d_]", c) and c.isupper() for c in w[:2])
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat, "n_lines": len(lines), "one": 1,
        "n_capital_words": sum(map(upper, words)), "n_exclaimed": t.count("!!"), "n_stop_words": sum(w.lower() in quality_rules.STOP_WORDS for w in words),
        "n_runs": sum(a == b for a, b in itertools.pairwise(words)), "n_distinct_words": len({w.rstrip(".,;:!?").lower() for w in words}),
        "root_words": math.sqrt(n_words) if n_words >= weak_quality.ENOUGH else None, "some_words": n_words if n_words >= weak_quality.ENOUGH else None,
    }


def good(s, lang):
    for r in (*quality_rules.BASE, *quality_rules.RULES):
        top, bottom = s[r.top], s[r.bottom]
        known = lang in quality_rules.STOP_LANGUAGES
        if bottom and not ((r.least is None or top >= r.least * bottom) and (r.most is None or top <= r.most * bottom)) and (known or r.top != "n_stop_words"):
            return False
    return True


def voted(s):
    """The votes of the labellers as a number in base three."""
    votes = []
    for x in weak_quality.LABELLERS:
        ratio = s[x.top] / s[x.bottom] if s[x.bottom] else None
        bad = ratio is not None and (ratio >= x.bad if x.high else ratio <= x.bad)
        fine = ratio is not None and x.good is not None and (ratio <= x.good if x.high else ratio >= x.good)
        votes.append(0 if bad else 2 if fine else 1)
    return sum(v * 3**i for i, v in enumerate(votes))


def posterior(patterns):
    """Posterior of good for each pattern, by loops over patterns, labellers and votes."""
    n = len(weak_quality.LABELLERS)
    counts = collections.Counter(patterns)
    votes = {p: [p // 3**i % 3 for i in range(n)] for p in counts}
    post = {p: 1 / (1 + math.exp(-(1 + sum(v == 2 for v in vs) - 2 * sum(v == 0 for v in vs)))) for p, vs in votes.items()}
    for _ in range(weak_quality.EM_ROUNDS):
        weight = {p: (c * (1 - post[p]), c * post[p]) for p, c in counts.items()}
        share = [[[0.5 + sum(weight[p][k] for p in counts if votes[p][i] == v) for v in range(3)] for k in range(2)] for i in range(n)]
        share = [[[x / sum(row) for x in row] for row in both] for both in share]
        total = [sum(w[k] for w in weight.values()) for k in range(2)]
        prior = [(t + 0.5) / (sum(total) + 1) for t in total]
        for p, vs in votes.items():
            log = [math.log(prior[k]) + sum(math.log(share[i][k][v]) for i, v in enumerate(vs)) for k in range(2)]
            post[p] = 1 / (1 + math.exp(min(30, max(-30, log[0] - log[1]))))
    return post


def test_classifier_against_brute_force(spark, sf):
    docs = documents(spark).unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    patterns = [voted(statistics(t)) for _, t in rows]
    post = posterior(patterns)
    hasher = weak_quality.Hasher(weak_quality.PLACES)
    x = np.zeros((len(rows), weak_quality.PLACES))
    for k, (_, t) in enumerate(rows):
        for at, value in zip(*hasher(t)):
            x[k, at] += value
    soft = np.array([post[p] for p in patterns])
    heavy = np.array([1 - soft.mean(), soft.mean()]).clip(0.02)
    each = np.where(soft >= 0.5, 0.5 / heavy[1], 0.5 / heavy[0])
    each /= each.sum()
    w, bias, dw, db = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    for _ in range(weak_quality.FIT_ROUNDS):
        off = (1 / (1 + np.exp(-(x @ w + bias).clip(-30, 30))) - soft) * each
        dw, db = 0.9 * dw + x.T @ off + weak_quality.DECAY * w, 0.9 * db + off.sum()
        w, bias = w - weak_quality.STEP * dw, bias - weak_quality.STEP * db
    want = collections.Counter((i, round(0.0 if not t.split() else 1 / (1 + math.exp(-(x[k] @ w + bias))), 5)) for k, (i, t) in enumerate(rows))
    got = collections.Counter((r.doc_id, round(r.score, 5)) for r in weak_quality.classify(docs).collect())
    assert sum((got - want).values()) <= 2  # the fifth digit may round the other way


def test_features_of_a_text_are_bounded(spark):
    rows = spark.createDataFrame([(1, 0.5, " ".join(f"w{i}" for i in range(3000))), (2, 0.5, "a b")], "h long, soft double, text string")
    got = {r.h: r for r in weak_quality.features(rows, 64).collect()}
    assert len(got[1]["at"]) <= 64 and got[2]["at"]
    at, value = weak_quality.Hasher(64)(rows.where("h = 1").first().text)
    assert np.allclose(sum(got[1]["value"]), sum(value))
    w, _ = weak_quality.learn(rows, 64, 10, 1)
    assert w.shape == (64,)


def masked(t):
    """The text with a sign for each base span; of spans that overlap, the first, longest one names the whole."""
    spans = sorted((int(a), -int(b), kind) for kind, a, b in (x.split(":") for x in base_spans(t)))
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [t[at:a], f"<{kind.upper()}>"]
        at = max(at, -b)
    return "".join(out) + t[at:]


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.withColumn("fp", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r.doc_id: r for r in docs.collect() if good(statistics(r.text), r.lang)}
    close = grouped([(i, prints(r.text)) for i, r in rows.items()], 4)
    groups = alike([(i, r.text) for i, r in rows.items()], links=close.items())
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {i: r.text for i, r in rows.items() if groups[i] == i and not any(x in norm(r.text) for x in items)}
    assert 0 < len(left) < len(rows) < docs.count()
    tok = Tokenizer.from_file(packing.vocabulary())
    want = collections.Counter()
    for i, t in left.items():
        ids = [*tok.encode(masked(t), add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(i, k // 2048, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 2048 for b in bins.values())
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


def test_stages_keep_odd_rows_from_crashing(spark, tmp_path):
    odd = documents(spark).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text")})
    for name, df in (("odd", odd), ("empty", odd.limit(0))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        stages = dict(corpus_pipeline.STAGES)
        for stage in ("quality_rules", "simhash", "decontamination", "personal_data"):
            out = stages[stage](spark, spark.read.parquet(str(tmp_path / name / "documents.parquet")), str(tmp_path / name))
            assert out.columns == df.columns and out.count() <= df.count()
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() >= 0

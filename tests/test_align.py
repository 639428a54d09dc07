"""Alignment of two versions against a version with loops, and what it makes of renumbered documents."""

import random

import pytest
from pyspark.sql import functions as F

from regulus.operators import align

ROW = "doc_id long, section_order int, article_number string, article_title string, body string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pairs_of(then, now):
    """Places that belong together, rule by rule."""
    fields = {"number": 1, "title": 2, "digest": 3}
    then, now, found = sorted(then), sorted(now), []
    for rule in align.RULES:
        name = lambda r: tuple(r[fields[f]] for f in rule)
        for r in list(then):
            mate = next((x for x in now if name(x) == name(r)), None)
            if mate:
                found.append((r[0], mate[0]))
                then.remove(r)
                now.remove(mate)
    return sorted(found)


def longest_rising(xs):
    best = [1] * len(xs)
    for i, x in enumerate(xs):
        best[i] += max((best[j] for j in range(i) if xs[j] < x), default=0)
    run, n, last = [], max(best, default=0) + 1, None
    for i in range(len(xs) - 1, -1, -1):
        if best[i] == n - 1 and (last is None or xs[i] < last):
            run, n, last = [i, *run], best[i], xs[i]
    return run


def test_alignment_equals_loops(spark):
    rng = random.Random(4)
    sides = {False: {}, True: {}}
    for d in range(40):
        base = [(k, f"제{k}조", rng.choice(["목적", "정의", f"t{k}"]), rng.choice(["삭제", f"본문 {k} 은 다음과 같다 {rng.randrange(9)}"])) for k in range(rng.randrange(9))]
        other = [x for x in base if rng.random() > 0.15]
        rng.shuffle(other) if rng.random() < 0.4 else None
        other = [(i, f"제{i}조" if d % 2 else x[1], x[2] if rng.random() > 0.1 else "새 제목", x[3] if rng.random() > 0.3 else x[3].replace("은", "이") + "요") for i, x in enumerate(other)]
        other += [(90 + i, f"제{90 + i}조", "부칙", f"새로 둔다 {i}") for i in range(rng.randrange(2))]
        sides[False][d], sides[True][d] = base, other
    rows = {now: spark.createDataFrame([(d, *r) for d, rs in docs.items() for r in rs], ROW) for now, docs in sides.items()}
    got = {}
    for r in align.aligned(rows[False], rows[True]).collect():
        got.setdefault(r.doc_id, set()).add((r.at_then, r.at_now, r.in_place, round(r.similarity, 9)))
    for d in sides[False]:
        then, now = ({r[0]: r for r in sides[s][d]} for s in (False, True))
        pairs = pairs_of(then.values(), now.values())
        kept = set(longest_rising([c for _, c in pairs]))
        want = set()
        for i, (g, c) in enumerate(pairs):
            a, b = then[g][3], now[c][3]
            want.add((g, c, i in kept, round(1 - distance(a, b) / max(len(a), len(b), 1), 9)))
        want |= {(g, None, False, 0.0) for g in then if g not in {p[0] for p in pairs}} | {(None, c, False, 0.0) for c in now if c not in {p[1] for p in pairs}}
        assert got.get(d, set()) == want


def test_one_new_article_in_front_leaves_the_others_in_place(spark):
    then = spark.createDataFrame([(1, i, f"제{i + 1}조", f"t{i}", f"본문 {i}, 이것은 내용이다") for i in range(30)], ROW)
    now = spark.createDataFrame([(1, 0, "제1조", "신설", "새 조문이다")] + [(1, i + 1, f"제{i + 2}조", f"t{i}", f"본문 {i}, 이것은 내용이다" + (" 끝" if i == 7 else "")) for i in range(30)], ROW)
    got = align.report(align.aligned(then, now)).first()
    assert (got.articles, got.added, got.missing, got.moved, got.renumbered, got.edited) == (31, 1, 0, 0, 30, 1)
    assert got.structure_score == pytest.approx(30 / 31) and 0.95 < got.content_score < 30 / 31
    same = align.report(align.aligned(then, then)).first()
    assert same.overall_pass and same.overall_score == 1
    assert {r.status for r in align.aligned(then, then.limit(0)).collect()} == {"missing"} and align.aligned(then.limit(0), then.limit(0)).count() == 0


def test_an_alignment_shuffles_once(spark):
    then = spark.createDataFrame([(1, 0, "제1조", None, None)], ROW)
    plan = align.aligned(then, then)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert align.aligned(then, then).first().status == "same"


def test_edit_similarity_of_long_texts(spark):
    a = "가나다라 " * 20_000
    rows = spark.createDataFrame([(a + "x" + a, a + "yz" + a), ("", ""), ("abc", ""), ("abab", "ab")], "a string, b string")
    got = [r[0] for r in rows.select(align.edit_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1 - 2 / 200_002, 1, 0, 0.5])

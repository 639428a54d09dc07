"""Each operator against a brute-force version, a round trip or held-out labels, with odd rows throughout."""

import base64
import collections
import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regulus.llm import chat, compaction, components, decontam, html_text, packing, pii, quality_rules, queries, similar, simhash, warc, weak_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, "a null id and some more words to read"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "same text here again"), (5, "same text here again"), (6, "same text here again"), (7, "ünï 🙂 x\x00y " * 9000)]


def documents(spark, rows=()):
    df = spark.createDataFrame([*ODD, *rows], "doc_id long, text string")
    clash = {c: F.lit("x") for c in ("_t", "_w", "fp", "key", "n_words", "_row", "piece", "spans", "h", "score", "a", "b", "n")}
    return df.withColumns(clash)


def empty(spark):
    return documents(spark).limit(0)


# 5: quality rules


def counted(t):
    t = t or ""
    words = WORD.findall(t)
    grams = collections.defaultdict(list)
    for i in range(len(words) - 2):
        grams[tuple(words[i : i + 3])].append(i)
    again = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_quality_statistics(spark, sf):
    rng = random.Random(1)
    made = [(100 + i, "".join(rng.choice(["the ", "of ", "a&b ", "\n", "xyz ", " ", "\x1cq "]) for _ in range(rng.randrange(900)))) for i in range(60)]
    for df in (documents(spark, made), spark.read.parquet(f"{sf}/documents.parquet")):
        got = quality_rules.quality(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            c = counted(r.text)
            want[(r.doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
        assert collections.Counter(map(tuple, got)) == want
    assert quality_rules.quality(empty(spark)).count() == 0


def test_quality_keeps_columns_and_good_documents(spark, sf):
    docs = documents(spark)
    assert quality_rules.keep_good(docs).columns == docs.columns
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert kept == {r.doc_id for r in quality_rules.quality(docs).where("kept").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    passed = {r.doc_id for r in quality_rules.quality(docs).where("not base_failed").collect()}
    assert all((d in kept) == bool(q) for d, q in labels.items() if d in passed)


def test_stop_words_count_only_where_they_are_known(spark):
    rng = random.Random(13)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(80))
    rows = [(1, text("абвгдежз"), None), (2, text("абвгдежз"), "ru"), (3, text("bcdfghkm"), "en"), (4, text("bcdfghkm"), "pl"), (5, text("bcdfghkm"), None), (6, text("bcdfghkm"), "de-AT"), (7, text("가나다라마바"), "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == {1, 2, 4, 7}
    assert {r.doc_id for r in quality_rules.quality(docs.drop("lang")).where("kept").collect()} == {1, 2, 7}


# 8: near duplicates


def prints(text):
    from xxhash import xxh64_intdigest

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def grouped(rows, distance):
    """id -> smallest id reachable, by union of all pairs."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if (a ^ b).bit_count() <= distance:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("crowd", [1 << 14, 8])
def test_near_duplicates(spark, crowd):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(400)]
        for k in range(20 if g == 0 else 5):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(400)] = rng.choice(words)
            rows.append((1000 + 100 * g + k, " ".join(copy)))
    docs = documents(spark, rows)
    got = simhash.near_duplicates(docs, crowd=crowd).collect()
    assert len(got) == docs.count()
    known = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    want = grouped(list({i: prints(t) for i, t in known}.items()), 4)
    texts = dict(known)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints(texts[r.doc_id]):016x}", want[r.doc_id])
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(docs, crowd=crowd)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert set(ids) - {None} == set(want.values()) and max(ids.values()) == 1 and simhash.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("distance", [3])
def test_odd_distances_in_a_crowd(spark, distance):
    rng = random.Random(21)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for k in range(1, 7):
            g = f
            for b in rng.sample(range(64), k):
                g ^= 1 << b
            fps.add(g)
    signed = [(simhash.signed(f),) for f in fps]
    want = grouped([(a, a % (1 << 64)) for (a,) in signed], distance)
    for crowd in (4, 1 << 14):
        got = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), distance, crowd)).collect()
        heads = collections.defaultdict(set)
        for r in got:
            heads[r.root].add(r.node)
        parts = collections.defaultdict(set)
        for a, h in want.items():
            parts[h].add(a)
        assert sorted(map(sorted, heads.values())) == sorted(sorted(x) for x in parts.values() if len(x) > 1)


def test_one_row_of_each_group_stays(spark):
    text = "some words that stand here for a while and are read again later on by others"
    docs = spark.createDataFrame([(3, text), (3, text), (1, text), (1, text), (None, text), (None, "quite another text of some words"), (None, "quite another text of some words"), (7, "and a third one without any copy at all"), (8, None), (9, "")], "doc_id long, text string")
    for how in ({}, {"similarity": 0.8}):
        kept = collections.Counter((r.doc_id, r.text) for r in simhash.keep_one(docs, **how).collect())
        assert kept == collections.Counter([(1, text), (None, "quite another text of some words"), (7, "and a third one without any copy at all"), (8, None)] + ([] if not how else []))


def alike(rows, similarity=0.8, links=()):
    """id -> smallest id reachable by five-word similarity, or by further links, over all pairs."""
    ids = sorted({i for i, _ in rows})
    words = [(i, WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows]
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for i, w in words if w]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if len(a & b) >= similarity * len(a | b)]
    for i, j in [*near, *links]:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("part,steps", [(10_000, (1, 2, 3)), (3, (1,))])
def test_similar_texts_join(spark, part, steps, monkeypatch):
    """Whatever the first round compares, the links are those of all pairs."""
    monkeypatch.setattr(similar, "PART", part)
    monkeypatch.setattr(similar, "STEPS", steps)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = []
    for g in range(8):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(30 if g == 0 else 5):
            copy = list(base)
            for _ in range(rng.randrange(8)):
                copy[rng.randrange(300)] = rng.choice(words)
            rows.append((1000 + 100 * g + k, " ".join(copy)))
        rows.append((1090 + 100 * g, " ".join(base[:200])))
    docs = documents(spark, [*rows, (2000, rows[0][1] + " " + rows[0][1]), (2001, rows[0][1])])
    known = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    by_print = grouped(list({i: prints(t) for i, t in known}.items()), 4)
    want = alike(known, links=by_print.items())
    got = simhash.near_duplicates(docs, similarity=0.8).collect()
    assert len(got) == docs.count()
    found = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert found == want
    assert len(set(want.values())) < len(set(by_print.values()))
    kept = simhash.keep_one(docs, similarity=0.8)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == set(want.values())
    assert simhash.near_duplicates(empty(spark), similarity=0.8).count() == 0


def test_similar_pairs_in_a_crowd_join(spark):
    """24 pairs at 0.82 among 500 texts that share most of their words, at 0.75: no link depends on who is next to whom."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(261)]
    rows, pairs = [], {}
    for i in range(500):
        own = [f"w{rng.randrange(10**9)}" for _ in range(39)]
        rows.append((i, " ".join(passage + own)))
        if i < 24:
            rows.append((1000 + i, " ".join(passage + own[:10] + [f"w{rng.randrange(10**9)}" for _ in range(29)])))
            pairs[1000 + i] = i
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = simhash.fingerprints(docs, similar=True).withColumn("head", F.col("key"))
    got = {r.was: r.head for r in similar.join_similar(docs, marks, "text", "doc_id").collect()}
    assert {a: b for a, b in got.items() if a != b} == pairs


def test_all_pairs_share_a_table():
    rng = random.Random(3)
    for blocks in (6, 7, 8):
        masks = simhash.tables(blocks, 4)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), 4):
                b ^= 1 << k
            assert any(a & m == b & m for m in masks)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (None, 3), (7, None), (6001, 6000), (6000, 6001)]
    rng.shuffle(pairs)
    got = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    groups = collections.defaultdict(set)
    for r in got:
        groups[r.root].add(r.node)
    assert sorted(map(len, groups.values())) == [1, 2, 201, 400]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("piece", [components.PIECE, 40])
@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_components_within_tasks_and_across_them(spark, piece, kind):
    rng = random.Random(14)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(400)] + [(2000 + i, 2001 + i) for i in range(150)] + [(4000, 4000)]
    want = {frozenset(g) for g in grouped_by(pairs)}
    links = spark.createDataFrame(pairs, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind)).repartition(3)
    groups = collections.defaultdict(set)
    got = components.components(links, piece).collect()
    for r in got:
        groups[r.root].add(int(float(r.node)))
    assert {frozenset(g) for g in groups.values()} == want and len(got) == sum(map(len, want))


def grouped_by(pairs):
    at = {}
    for a, b in pairs:
        one = at.get(a, {a}) | at.get(b, {b})
        at |= {x: one for x in one}
    return at.values()


def test_components_of_few_links_take_few_jobs(spark):
    """A chain of 500 links: the driver keeps plans, tasks and threads of each job, which filled its memory."""
    links = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    spark.sparkContext.setJobGroup("components", "")
    try:
        assert components.components(links).select("root").distinct().count() == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 12


# 2: decontamination

QUESTION = "Alice has 5 apples and gives 5 to her friend Carol, who walks 3 km home with Carol every day before lunch."


def test_decontamination(spark):
    again = "Then Bob has 7 apples and gives 7 to her friend Dora, who walks 9 km home with Dora every day before lunch. End"
    wrong = again.replace("gives 7", "gives 8").replace("with Dora", "with Emil")
    docs = documents(spark, [(10, "x y z. " + QUESTION + " w"), (11, again), (12, wrong), (13, QUESTION.upper()), (14, "Alice has 5 apples. Nothing else is here to see today."), (15, QUESTION.lower()), (16, QUESTION.title()), (17, "x " * 60_000 + QUESTION + " y" * 60_000), (18, again.lower())])
    bench = spark.createDataFrame([(0, QUESTION), (1, None), (2, ""), (3, "too short"), (4, "1 2 3 4 5 6 7 8 9 10"), (None, QUESTION)], "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, 0) for k in (10, 11, 13, 15, 16, 17)}
    exact = next(r for r in got if r.doc_id == 10)
    assert exact.coverage >= 0.9 and exact.slot_consistency == 1.0 and exact.slots > 0
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({r.doc_id for r in got})
    clash = docs.withColumns({"_gone": F.lit(1), "text_key": F.lit("x"), "item_id": F.lit(0)})
    assert decontam.keep_clean(clash, bench).columns == clash.columns
    assert decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_whole_items(spark, sf):
    """Every item that stands in a text word for word is found, and nothing else is."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    norm = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in norm(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert want and got == want


def test_items_without_a_telling_template_are_found_word_for_word(spark):
    sums, title, digits = "Compute 12 + 34 * 56 - 78.", "Who wrote The Old Man And The Sea?", "1 2 3 4 5 6 7 8 9 10"
    bench = spark.createDataFrame([(0, sums), (1, title), (2, "too short"), (3, digits), (4, "...")], "item_id long, text string")
    docs = documents(spark, [(10, f"first this. {sums} and more"), (11, f"so: {title} It was he."), (12, "this is too short, really"), (13, f"0 {digits} 11"), (14, "Compute 12 + 34 * 56 - 79."), (15, "1 2 3 4 5 6 7 8 9. Then 3 4 5 6 7 8 9 10"), (16, "short, too")])
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(10, 0), (11, 1), (12, 2), (13, 3)}


def test_templates_do_not_depend_on_what_stands_before(spark):
    asked = "Tom has 12 apples and buys 7 more pears. Tom gives 5 of them to a friend. How many pears are left?"
    again = "Ann has 31 apples and buys 9 more pears. Ann gives 4 of them to a friend. How many pears are left?"
    short = "How many legs has a spider?"
    bench = spark.createDataFrame([(0, asked), (1, short)], "item_id long, text string")
    docs = documents(spark, [(10, again), (11, f"Question: {short} Answer"), (12, f"they asked {short}"), (13, again.replace("Ann gives", "Eve gives").replace("pears are", "plums are")), (14, f"So: {again}")])
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got - {(13, 0)} == {(10, 0), (11, 1), (12, 1), (14, 0)}


# 10: personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(d) <= 19 and luhn) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base(spark, sf):
    rng = random.Random(5)
    bits = ["a@b.c", "_", "@", ".", "-", " ", "1.2.3.4", "999.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (017) 555-7713", "é🙂", "x", "7", "\n", "0" * 30, "%", "001.02.3.255"]
    made = [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(200)]
    for df in (documents(spark, [*made, (99, "a" * 200_000), (98, "1 " * 6_000), (97, "1." * 6_000)]), spark.read.parquet(f"{sf}/documents.parquet")):
        want = collections.Counter((r.doc_id, hashlib.sha256(",".join(base_spans(r.text)).encode()).hexdigest()) for r in df.collect())
        rows = pii.personal_data(df).collect()
        assert collections.Counter((r.doc_id, r.base_sha256) for r in rows) == want
    assert pii.personal_data(empty(spark)).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    cards = [c for c in (str(4000056655665500 + i) for i in range(200)) if luhn(c)][:12]
    seeds = [(100 + i, f"words here card: {c} thanks and bye") for i, c in enumerate(cards)]
    docs = documents(spark, [*seeds, (200, "other words card: 1234567812345678 thanks"), (201, "the year 1234567812345678901 is not one")])
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert got[200] == "card:18:34" and got[201] == ""
    back = {r.doc_id: r for r in pii.redact(docs.withColumn("n_chars", F.length("text"))).collect()}
    assert back[200].text == "other words card: <CARD> thanks" and back[200].n_chars == len(back[200].text)
    assert back[201].text.endswith("is not one") and back[1].text is None
    assert pii.redact(docs).columns == docs.columns


def test_patterns_discover_other_notations(spark):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    cards = [c for c in (str(4000056655665500 + i) for i in range(400)) if luhn(c)][:30]
    seeds = [(100 + i, f"words here card: {c} thanks and bye") for i, c in enumerate(cards)] + [(150 + i, f"words here phone: +1 (017) 555-77{10 + i} please and bye") for i in range(30)]
    phones, dotted = ["030-1234567", "(030) 123 4567"], "4111.1111.1111.1111"
    unseen = [(200 + i, f"other words phone: {p} please") for i, p in enumerate(phones)] + [(210, f"other words card: {dotted} thanks")]
    docs = documents(spark, [*seeds, *unseen, (220, "other words phone: 12345 please"), (221, "the date 2020-12-31 and 030-7654321 stand elsewhere"), (222, "1 " * 6_000 + "1x")])
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert [got[200 + i] for i in range(2)] == [f"phone:19:{19 + len(p)}" for p in phones]
    assert got[210] == f"card:18:{18 + len(dotted)}" and got[220] == got[221] == got[222] == ""
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()}[201] == "other words phone: <PHONE> please"


def test_a_slot_of_many_unknown_numbers(spark):
    """Five numbers behind a word that stands before twelve phones are phones; those behind another word, or in a mixed slot, are not."""
    seeds = [(100 + i, f"x{i} phone: +49 30 55{i:02d} 7712 y{i}") for i in range(12)]
    unseen = [(200 + i, f"x{i} phone: 030-55{i}771{i} y") for i in range(5)]
    other = [(300 + i, f"x{i} order no: 030-66{i}881{i} y") for i in range(5)]
    mixed = [(400 + i, f"x{i} ref: +49 40 66{i:02d} 8813 y") for i in range(6)] + [(420 + i, f"x{i} ref: 7{i}8a9{i}5b6 y") for i in range(6)] + [(440, "x ref: 040-1239876 y")]
    docs = documents(spark, seeds + unseen + other + mixed)
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert all(got[200 + i].startswith("phone:") for i in range(5)) and not any(got[300 + i] for i in range(5))
    assert got[440] == "" and not any(got[420 + i] for i in range(6))


def places_of(t):
    """Seeds and candidates of a text with the words around them, worked out one by one."""
    import regex

    base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(t))]
    free = lambda a, b, spans: all(e <= a or b <= s for *_, s, e in spans)
    digits = lambda m: len(re.sub("[^0-9]", "", m))
    runs = [(None, *m.span()) for m in regex.finditer(r"(?<![\p{L}\p{N}@_])\+?(?:\([0-9]+\)|[0-9])(?:\)?[ ./-]?\(?[0-9])*+[\p{L}\p{N}@_]?", t) if regex.search("[0-9]$", m[0]) and digits(m[0]) >= 4 and free(*m.span(), base)]
    found = base + runs
    for m in regex.finditer(r"\S+", t):
        if re.search("[0-9@]", m[0]) and free(*m.span(), base + runs):
            lead = len(m[0]) - len(regex.sub(r"^[^\p{L}\p{N}+]+", "", m[0]))
            inner = regex.sub(r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "", m[0])
            if digits(inner) >= 4 or "@" in inner:
                found.append((None, m.start() + lead, m.start() + lead + len(inner)))
    for kind, a, b in found:
        before, after, mask = t[max(0, a - 64) : a].lower(), t[b : b + 64].lower(), lambda c: re.sub("[0-9]+", "0", c)
        one, two, then = (re.search(p, x) for p, x in ((r"(\S+)\s+$", before), (r"(\S+\s+\S+)\s+$", before), (r"^\S*\s+(\S+)", after)))
        around = ["<" + mask(one[1]) if one else "", "<<" + mask(two[1]) if two else "", ">" + mask(then[1]) if then else "", f"<>{mask(one[1])} {mask(then[1])}" if one and then else ""]
        yield kind, a, b, t[a:b], [x for x in around if x]


def bootstrapped(texts, rounds, support, pattern_score, token_score):
    """(text, kind, start, end) of what patterns discover, by dictionaries."""
    seen = [(t, *x) for t in texts for x in places_of(t)]
    edges = collections.defaultdict(set)
    for *_, m, around in seen:
        for p in around:
            edges[p].add(m.lower())
    known = collections.defaultdict(set)
    for _, kind, _, _, m, _ in seen:
        if kind:
            known[m.lower()].add(kind)
    gate = lambda m, k: re.search(pii.GATES[k][0], m) and pii.GATES[k][1] <= len(re.sub("[^0-9]", "", m)) <= pii.GATES[k][2]
    still = {(m.lower(), k) for _, kind, _, _, m, _ in seen if not kind for k in pii.KINDS if gate(m, k) and m.lower() not in known}
    fixed = {(i, k): 1.0 for i, kinds in known.items() for k in kinds}
    reached, scores = {}, fixed
    for _ in range(rounds):
        good = {}
        for p, tokens in edges.items():
            for k in pii.KINDS:
                mass = [scores[i, k] for i in tokens if (i, k) in scores]
                told = sum((i, x) in scores for i in tokens for x in pii.KINDS)
                unsure = sum((i, k) in still and not any((i, x) in scores for x in pii.KINDS) for i in tokens)
                conf = sum(mass) / (told + pii.DOUBT * unsure + max(0, len(tokens) - told - unsure) + pii.PRIOR)
                if len(tokens) >= support and len(mass) >= support and conf >= pattern_score:
                    good[p, k] = conf
        doubt = collections.defaultdict(lambda: 1.0)
        for (p, k), conf in good.items():
            for i in edges[p]:
                if (i, k) in still:
                    doubt[i, k] *= 1 - conf
        if not doubt:
            break
        reached = {x: 1 - d for x, d in doubt.items()}
        scores = fixed | reached
    best = {}
    for (i, k), score in reached.items():
        if score >= token_score:
            best[i] = max(best.get(i, (0.0, "")), (score, k))
    return {(t, best[m.lower()][1], a, b) for t, kind, a, b, m, _ in seen if not kind and m.lower() in best}


@pytest.mark.parametrize("how", [(3, 4, 0.8, 0.9), (3, 2, 0.3, 0.5), (1, 1, 0.1, 0.1)])
def test_pattern_graph_against_dictionaries(spark, how):
    rng = random.Random(17)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    number = lambda: str(rng.randrange(10**15, 10**16))
    made, hidden = [], set()
    for k in range(120):
        card = next(c for c in iter(number, None) if luhn(c) != (k % 12 == 0))
        phone, word = f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", rng.choice(["ab", "cd", "ef"])
        made += [f"{word} {k} card: {card} thanks {word}", f"{word} call {phone} please", f"{word} {rng.randrange(10**6)} {word} {number()} x"]
        made += [f"{word} call {rng.randrange(100, 999)}-{rng.randrange(10**6, 10**7)} please"] * (k % 12 == 0)
        hidden |= set() if luhn(card) else {card}
    texts = list(dict.fromkeys(made)) + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '[0-9@]'").collect()]
    df = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string").withColumn("text_key", F.col("t"))
    found = pii.bootstrap(pii.cut(pii.places(df)), *how)
    got = {tuple(r) for r in found.collect()} if found is not None else set()
    assert got == bootstrapped(list(dict.fromkeys(texts)), *how)
    if how[0] == 3 and how[1] == 4:
        cards = {t[a:b] for t, k, a, b in got if k == "card"}
        assert cards == hidden and len(hidden) == 10  # all cards of the marked slot that no check digit tells, and no other number
        assert sum(k == "phone" for _, k, *_ in got) == 10


def test_masking_overlaps(spark):
    df = spark.createDataFrame([("a@1.2.3.4 b",)], "t string").withColumn("s", pii.base_spans(F.col("t")))
    assert df.select(pii.masked(F.col("t"), F.col("s")).alias("m")).first().m == "<EMAIL> b"


# 9: packing


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    more = [(20, "<|startoftext|>Ünïcode don't İstanbul ½ x² ﬁ é　日本 1a2 ''s !'t\x1c a\x85b\xa0c"), (21, "a b " * 5000)]
    for df in (documents(spark, more), spark.read.parquet(f"{sf}/documents.parquet")):
        rows = packing.pack(df, with_ids=True).collect()
        got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows)
        want = collections.Counter()
        for r in df.collect():
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
            for k in range(0, len(ids), 2048):
                part = struct.pack(f"<{len(ids[k : k + 2048])}I", *ids[k : k + 2048])
                want[(r.doc_id, k // 2048, k, len(part) // 4, zlib.crc32(part), part)] += 1
        assert got == want
        bins = collections.defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048
        assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1
        assert packing.sequences(spark.createDataFrame(rows)).count() == len(bins)
    assert packing.pack(empty(spark)).count() == 0


def test_packing_leaves_no_words_in_the_workers(spark, sf):
    packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).count()
    path = packing.vocabulary()

    def held(batches):
        assert list(batches)
        caches = packing.encoder(path)
        n = sum(len(c) + len(c.older) for c in (caches.runs, caches.parts))
        yield pa.RecordBatch.from_pydict({"id": [n]})

    assert spark.range(0, 8, 1, 8).mapInArrow(held, "id long").agg(F.max("id")).first()[0] == 0


def test_open_bins_are_bounded():
    rng = random.Random(6)
    bins = packing.OpenBins(100, 5)
    used = collections.Counter()
    for _ in range(3000):
        n = rng.randrange(1, 101)
        at, offset = bins.place(n)
        assert used[at] == offset and offset + n <= 100 and bins.open <= 5
        used[at] += n


@pytest.mark.parametrize("per_task", [packing.PER_TASK, 4_000])
def test_half_filled_bins_wait_for_short_pieces(spark, per_task):
    """Pairs that fill a sequence each: the longer halves alone are far more than 4,096 bins."""
    n = 12_000
    halves = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") < n, 1025 + F.col("id") % 900).otherwise(1023 - F.col("id") % n % 900).alias("length"), F.col("id").alias("ids_crc32"))
    rows = packing.place(halves, per_task=per_task).collect()
    used = collections.Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert len(rows) == 2 * n and max(used.values()) <= 2048
    assert len(used) <= 1.03 * n


# 3: WARC


def held_pages(pages):
    """What the contract says of each page."""
    same = collections.defaultdict(list)
    for r in pages.collect():
        same[(r.html or "").encode()].append(r.page_id)
    want = collections.Counter()
    for body, ids in same.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        most = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, len(body), digest, "response" if i == most else "revisit", None if i == most else most)] += 1
    return want


def test_warc_round_trip(spark, sf):
    odd = [(-1, "u", None), (-2, "u", ""), (-3, "a b\r\n", "x\r\n\r\nWARC/1.1\r\nfoo: 1\r\n\r\n"), (-4, None, "é🙂" * 90000), (-5, "u", "é🙂" * 90000), (-6, "z", "\r\n\r\nWARC/1.1\r\n" * 5), (-7, "q", "é🙂" * 90000), (-7, "q", "é🙂" * 90000), (None, "q", "new"), (None, "q", "x\r\n\r\n"), (-9, "q", "x\r\n\r\n"), (-9, "q", "x\r\n\r\n")]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    pages = pages.union(spark.createDataFrame(odd, pages.schema)).withColumns({"rid": F.lit(1), "data": F.lit("x")})
    assert collections.Counter(map(tuple, warc.archived(pages).collect())) == held_pages(pages)
    assert warc.archived(pages.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [16, 65_536])
def test_payloads_that_look_like_archives(spark, chunk):
    version, size = "WARC/1.1\r\n", 65_536
    bodies = [version, version + "abc", "\r\n" + version, "\r\n\r\n" + version, "WARC/1.1", "x\r\n\r\nWARC/1.1", "WARC/1.", "WARC", "\r\n\r\n", "\r\n\r", version * 40, "WARWARC/1.1/1.1\r\n", version + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"]
    if chunk == size:
        edges = [size - k for k in (0, 1, 4, 8, 9, 10, 12, 14)] + [2 * size]
        bodies += ["a" * n + version + "abc" for n in edges] + ["a" * n + "\r\n\r\n" + version for n in edges] + ["a" * size + version]
    pages = spark.createDataFrame([(i, f"http://x/{version}/WARC/1.1", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    assert collections.Counter(map(tuple, warc.archived(pages, chunk=chunk).collect())) == held_pages(pages)


def test_long_payloads_take_linear_time(spark):
    """As many bytes in one record as in many: about the same time, and never four times for twice as many."""
    import time

    took = []
    for n in (4 << 20, 32 << 20):
        pages = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.concat(F.lit("abcdefg"), F.col("id").cast("string")), F.lit(n)).alias("html"))
        began = time.time()
        row = warc.archived(pages).collect()
        took.append(time.time() - began)
        assert row[0].payload_bytes == 8 * n and row[0].record_type == "response"
        assert row[0].payload_digest == base64.b32encode(hashlib.sha1(b"abcdefg0" * n).digest()).decode()
    assert took[1] < 16 * took[0]  # eight times the bytes; the square would be 64 times


def test_broken_archives_are_errors(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc" * 20), (2, "u", "abc" * 20), (3, "u", "z")], "page_id long, url string, html string")
    chunks = warc.chunk_table(pages.withColumn("rid", F.col("page_id").cast("string")), "html", ["rid"], 16).select("rid", "chunk_no", "last", "data", F.col("bytes").alias("total"), F.col("digest").alias("told"))
    assert warc.digests(chunks, ["rid"]).count() == 3
    for bad in (chunks.where("chunk_no <> 1"), chunks.where("chunk_no = 0 or not last"), chunks.withColumn("told", F.reverse("told"))):
        with pytest.raises(Exception, match="lacks|has|digest"):
            warc.digests(bad, ["rid"]).collect()
    good = str(tmp_path / "good")
    warc.write(pages, good, chunk=16)
    text = spark.read.text(good, lineSep="\x00").collect()
    raw = "".join(r.value for r in text)
    for k, bad in enumerate((raw.replace("abcabc", "abdabc", 1), raw.replace("bcabca\r\n", "bcabc\r\n", 1), raw.replace("sha1:", "sha1:A", 1))):
        assert bad != raw
        spark.createDataFrame([(bad,)], "value string").coalesce(1).write.text(str(tmp_path / f"bad{k}"), lineSep="\r\n")
        with pytest.raises(Exception):
            warc.digests(warc.read(spark, str(tmp_path / f"bad{k}")).where("record_type <> 'revisit'"), ["rid"]).collect()


# 4: chat


def test_conversations(spark, sf):
    got = {r.conv_id: r for r in queries.op4_chat(spark, sf).collect()}
    want = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        want[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    want[-1] = [(0, "user", queries.HOSTILE), (1, "assistant", queries.HOSTILE)]
    assert set(got) == set(want)
    for k, rows in want.items():
        rows.sort()
        whole, learned = "".join(f"{a}\n{b}\n" for _, a, b in rows), "".join(b for _, a, b in rows if a == "assistant")
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_layouts_become_turns(spark):
    records = ['{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"do","input":"","output":"done"}', '{"instruction":"do","input":"x","output":"done"}', '{"prompt":"p","response":"r"}', '{"data":{"question":"q","answer":"a"}}', "[]", "no json", None, '{"other":1}']
    df = spark.createDataFrame(list(enumerate(records)), "i int, payload string")
    rows = chat.canonical(df, "payload", ["i"]).collect()
    said = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.i, r.part or 0)):
        said[r.i].append((r.role, r.text))
    assert said[0] == [("user", "hi"), ("assistant", "yo")] and said[1] == [("user", "q"), ("assistant", "a")]
    assert said[2] == [("user", "do"), ("assistant", "done")] and said[3] == [("user", "do"), ("user", "x"), ("assistant", "done")]
    assert said[5] == [("user", "q"), ("assistant", "a")] and all(said[k] == [(None, None)] for k in (6, 7, 8, 9))
    assert len({r.fingerprint for r in rows if r.i in (2, 3)}) == 1


def test_records_that_cannot_be_read_are_counted(spark):
    deep = "[" * 100_000 + "]" * 100_000
    records = ['{"messages":[]}', '{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]},{"role":"assistant","content":null}]}', '{"instruction":"do","output":null}', '{"role":"user","text":"\\ud800x"}', deep, '{"text":' + deep + "}", '{"role":"user"}', '{"text":"t"}', '{"other":1}', None, '{"messages":{"role":"user"}}', '{"role":"user","text":"' + "é" * 300_000 + '"}']
    df = spark.createDataFrame([(i, 0, p) for i, p in enumerate(records)], "conv_id long, turn long, payload string")
    said = collections.defaultdict(list)
    for r in sorted(chat.canonical(df, "payload", ["conv_id"]).collect(), key=lambda r: (r.conv_id, r.part or 0)):
        said[r.conv_id].append((r.role, r.text))
    assert said[1] == [("user", "ab"), ("assistant", "")] and said[2] == [("user", "do"), ("assistant", "")] and said[3] == [("user", "\ufffdx")]
    assert said[6] == [("user", "")] and said[7] == [("", "t")] and said[11] == [("user", "é" * 300_000)]
    got = {r.conv_id: (r.n_turns, r.n_unread) for r in chat.conversations(df.withColumn("text", F.lit(1))).collect()}
    assert got == {0: (0, 0), 1: (2, 0), 2: (2, 0), 3: (1, 0), 4: (0, 1), 5: (0, 1), 6: (1, 0), 7: (1, 0), 8: (0, 1), 9: (0, 1), 10: (0, 1), 11: (1, 0)}
    assert chat.conversations(df.limit(0)).count() == 0


def test_query_records_have_several_layouts(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame([(-5, k, r, t) for k, (r, t) in enumerate([("human", "x"), ("gpt", None), ("bot", "z"), (None, None), ("user", None)])], rows.schema))
    made = chat.canonical(chat.of_rows(rows), "payload", ["conv_id", "turn"])
    assert made.select("layout").distinct().count() == 5 and made.select("fingerprint").distinct().count() == 8
    want = collections.Counter((r.conv_id, r.turn, r.role or "", r.text or "") for r in rows.collect())
    assert collections.Counter((r.conv_id, r.turn, r.role, r.text) for r in made.collect()) == want


def test_template_is_reversible(spark):
    texts = ["\\<|\\\\|>\n\x00é🙂\r", "<|im_end|>\n<|im_start|>x\n", "", "\\", "<", "<|", "a\\|b" * 5000]
    rows = spark.createDataFrame([(r, t) for r in ("assistant", "a\nb<|im_end|>\\", "") for t in texts], "role string, text string")
    back = chat.read_back(chat.rendered(rows.withColumns({"r0": F.col("role"), "t0": F.col("text")}))).collect()
    assert all((r.role, r.text) == (r.r0, r.t0) for r in back)
    assert all(r.learned == (r.t0 if r.r0 == "assistant" else None) for r in back)
    assert all(r.formatted.count("<|") == 2 for r in back)


# 6: HTML


def test_main_text(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(x for x in want if x)
    odd = spark.createDataFrame([(1, "u", None), (1, "u", ""), (None, None, "<p>a<p title='>x")], pages.select("page_id", "url", "html").schema).withColumn("text", F.lit(1))
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract(odd).collect()] == [(1, "", 0), (1, "", 0), (None, "a\nx", 3)]


def test_main_text_without_article():
    long = "the article of the day is in the house " * 8
    page = f"<html><head><title>t</title></head><body><div class='cookie-notice'>We use cookies</div><header><h1>Site</h1></header><div id=x><h1>Title</h1><p>{long}</p><p>Short.</p><p>{long}</p><form>Sign up</form><div class=comments><p>{long}</p></div></div><aside>{long}</aside><ul><li><a href=x>Home</a></li></ul></body>"
    assert html_text.main_text(page).split("\n") == ["Title", long.strip(), "Short.", long.strip()]
    assert html_text.main_text("<article><header><h1>T</h1></header><p>x&nbsp;y<br>z</p><script>var a='</p>'</script><!-- c --><div class='social share'>S</div></article>") == "T\nx y z"
    assert html_text.main_text("plain &lt;text&gt; \n b") == "plain <text> b"


def test_main_text_under_telling_names():
    long = "the article of the day is in the house " * 8
    for tag in ("<article class='post comments-open'>", "<main class=has-sidebar>", "<article id=social-policy>", "<div role=main class=sidebar>", "<div class='content with-sidebar'>", "<div class='no-comments page'>", "<div id=header-and-banner>"):
        name = tag[1:].split(" ")[0]
        page = f"<html><body><div class=cookie-notice>We use cookies</div>{tag}<p>{long}</p><p>{long}</p></{name}><div class=comments><p>{long}</p></div></body></html>"
        assert html_text.main_text(page) == f"{long.strip()}\n{long.strip()}", tag
    for start in ("<html><head><title>t</title><script>a='<p>x</p>'</script><meta name=x>", "<body><svg><path d=x>", "<body><object data=x>", "<body><iframe src=x>", "<body><svg><path d=x><p></p><svg></svg>"):
        assert html_text.main_text(f"{start}<p>{long}</p>") == long.strip(), start


PROSE = "the article of the day is in the house " * 8
DULL = "Umsatz Gewinn Quartal Bilanz Aktie Kurs " * 8  # long, without a stop word


def labels_of(page):
    """Each block's text, and which pass decided what."""
    found = html_text.weighed(html_text.blocks(page))
    html_text.first_pass(found)
    first = [b.label for b in found]
    html_text.second_pass(found)
    return [(b.text, "open" if x is None else "first", b.label) for b, x in zip(found, first)]


def test_densities_decide_without_a_main_element():
    links = "".join(f"<li><a href=x>Section number {k} of the site</a></li>" for k in range(9))
    page = f"<body><div><a href=/>Home</a> <a href=/b>Blog</a></div><div><h2>Title</h2><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p><ul>{links}</ul><p>No.</p></div><div>Read also</div><p><a href=z>{PROSE}</a></p></body>"
    got = labels_of(page)
    told = {t: (by, label) for t, by, label in got}
    assert told["Home Blog"] == ("first", False) and told[PROSE.strip()][0] == "first"
    assert told["Title"] == ("open", True) and told["Yes."] == ("open", True)
    assert told["No."] == ("open", False) and told["Read also"] == ("open", False)
    assert all(told[f"Section number {k} of the site"] == ("first", False) for k in range(9))
    assert [(t, label) for t, _, label in got if t == PROSE.strip()] == [(PROSE.strip(), True), (PROSE.strip(), True), (PROSE.strip(), False)]


def test_links_inside_an_article():
    menu = "".join(f"<li><a href=#s{k}>Part {k}</a></li>" for k in range(5))
    page = f"<nav>x</nav><article><h1><a href=x>Title with a link</a></h1><ul>{menu}</ul><p>{PROSE}</p><p><a href=y>The whole report</a></p><p>{DULL}</p><p><a href=1>{PROSE}</a></p><p>End.</p></article><p>{PROSE}</p>"
    assert html_text.main_text(page).split("\n") == ["Title with a link", PROSE.strip(), "The whole report", DULL.strip(), PROSE.strip(), "End."]


def test_main_elements_without_the_text_are_not_believed():
    card = "<article><h3>News</h3><p>Short teaser.</p></article>"
    page = f"<body>{card}<div><p>{PROSE}</p><p>{PROSE}</p></div></body>"
    assert PROSE.strip() in html_text.main_text(page).split("\n")


@pytest.mark.parametrize("name", ["related-work", "share-prices", "social-history", "reply-from-minister", "ad-hoc-analysis", "widget-theory", "notice-period"])
def test_names_inside_an_article_say_nothing_by_one_word(name):
    page = f"<article><p>{PROSE}</p><div class='{name}'><p>Short.</p><p>{PROSE}</p></div><p>{PROSE}</p></article>"
    assert html_text.main_text(page).split("\n") == [PROSE.strip(), "Short.", PROSE.strip(), PROSE.strip()]


@pytest.mark.parametrize("name", ["ad", "ads-box", "comments", "comment-list", "cookie-notice", "sidebar", "related links"])
def test_names_inside_an_article_count_if_they_say_nothing_else(name):
    page = f"<article><p>{PROSE}</p><div class='{name}'><p>Buy now.</p></div><p>{PROSE}</p></article>"
    assert html_text.main_text(page) == f"{PROSE.strip()}\n{PROSE.strip()}"
    assert html_text.main_text(f"<p>{PROSE}</p><div class='{name}'><p>Buy now.</p></div><p>{PROSE}</p>") == f"{PROSE.strip()}\n{PROSE.strip()}"


def test_deep_nesting_takes_linear_time():
    import time

    began = time.time()
    for page in ("<div>" * 20_000 + "</p>" * 20_000, "<div>" * 10_000 + "</p></li>" * 10_000, "<svg><p>" * 20_000 + "</svg>", "<aside>" + "<main>" * 20_000, "<noscript>" * 20_000 + "<p>x", "<a '" * 20_000, f"<p>{PROSE}</p>" * 3_000):
        html_text.main_text(page)
    assert time.time() - began < 20  # one of these took 31 s alone when it was quadratic


# 1: weak labels


def test_classifier_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.kept for r in weak_quality.classify(docs).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == docs.count()
    assert np.mean([got[r.doc_id] == bool(r.quality) for r in labels]) >= 0.97


def test_classifier_odd_rows(spark):
    rows = {r.doc_id: r for r in weak_quality.classify(documents(spark)).collect()}
    assert rows[1].score == 0.0 and not rows[2].kept and not rows[3].kept and len(rows) == 8
    assert weak_quality.classify(empty(spark)).count() == 0


def test_expectation_maximisation_finds_the_good_labeller():
    rng = np.random.default_rng(7)
    truth = rng.random(5000) < 0.7
    right = np.array([0.95, 0.9, 0.6])
    said = np.where(rng.random((5000, 3)) < right, truth[:, None], ~truth[:, None])
    patterns, counts = np.unique((np.where(said, 2, 0) * 3 ** np.arange(3)).sum(1), return_counts=True)
    post, p = weak_quality.expectation_maximisation(patterns, counts.astype(float), 3)
    accuracy = (p[:, 0, 0] + p[:, 1, 2]) / 2
    assert np.allclose(accuracy, right, atol=0.08)


def test_scorer_equals_hashed_features():
    rng = np.random.default_rng(8)
    w = rng.normal(size=1 << 10)
    for text in ("", "a b a", "The the THE x1 \n\n the the", "w " * 100):
        at, value = weak_quality.Hasher(1 << 10)(text)
        got = weak_quality.Scorer(w, 0.5)(text)
        assert got is None if not at else np.isclose(got, np.dot(w[at], value) + 0.5)


# 7: compaction


def test_compaction(spark, tmp_path):
    docs = documents(spark).withColumn("arrival", F.lit(None).cast("string"))
    out = compaction.compacted(docs, str(tmp_path / "a"), 8, F.col("text"), target=1000)
    assert out.exceptAll(docs).count() == 0 and docs.exceptAll(out).count() == 0 and out.columns == docs.columns
    assert compaction.compacted(docs.limit(0), str(tmp_path / "b"), 8, F.col("text")).count() == 0


def test_manifests(spark, tmp_path):
    store = compaction.Store(spark, str(tmp_path))
    rows = documents(spark)
    for k in range(5):
        assert store.append(rows).version == k + 1
    assert store.read(2).count() == 2 * rows.count()
    now = store.compact()
    assert now.version == 6 and len(now.runs) == 1 and now.runs[0].level == 1
    assert store.read().count() == 5 * rows.count() == store.read(5).count()
    lost = rows.write.parquet(f"{tmp_path}/data/lost")
    store.vacuum()  # within the grace all versions stay readable, and what a writer may still commit stays
    assert lost is None and store.read(5).count() == 5 * rows.count() and "lost" in store.names("data")
    store.vacuum(grace=0)
    assert store.read().count() == 5 * rows.count() and "lost" not in store.names("data") and store.versions() == [f"{6:012d}.json"]
    assert len(now.text()) < 1000 + len(now.schema) * 2 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    with pytest.raises(ValueError):
        store.append(rows.drop("a"))
    with pytest.raises(ValueError):
        store.manifest(99)


def test_a_slower_writer_works_its_change_out_anew(spark, tmp_path):
    store, seen = compaction.Store(spark, str(tmp_path)), []

    def change(old):
        if not seen:
            seen.append(old.version)
            store.append(documents(spark))  # another writer commits meanwhile
        else:
            seen.append(old.version)
        return old

    assert store.commit(change).version == 2 and seen == [0, 1]

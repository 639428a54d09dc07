"""Operators on small texts with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from regulus.operators import annex, chunking, classify, clean, golden, kvs, qa, structure, tables

LAW = """제1장 총칙
제1조(목적) 본문
제2조 (범위) 제1조(목적)에 따라
제2장 채용
제3조의2[특례] a [개정 2003.3.29] (신설 및 개정 2004.5.17) <개정2005.1.1.>
[별표1] x
"""
ANNEX = """[별표1] 승진후보자범위
<제20조제2항관련>

임용하고자하는인원수에대한승진후보자범위

1 5번까지
2 10번까지
3 15번까지

*임용하고자하는인원수가5명까지는서열명부순위의5배수
"""


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def one(spark, text, f):
    return docs(spark, text).select(f(F.col("text")).alias("x")).first()["x"]


def test_articles(spark):
    rows = structure.articles(docs(spark, LAW, None, "")).orderBy("section_order").collect()
    assert [(r.article_number, r.article_title, r.chapter) for r in rows] == [("제1조", "목적", "제1장 총칙"), ("제2조", "범위", "제1장 총칙"), ("제3조의2", "특례", "제2장 채용")]
    assert rows[0].body == "본문"
    assert rows[1].clean_body == "제1조(목적)에 따라"
    assert rows[2].body == "a [개정 2003.3.29] (신설 및 개정 2004.5.17) <개정2005.1.1.>"


@pytest.mark.parametrize("parity, want", [(False, ["2005.1.1", "2004.5.17", "2003.3.29"]), (True, ["2005.1.1", "2004.5.1", "2003.3.29"])])
def test_amendments(spark, parity, want):
    rows = structure.amendments(docs(spark, LAW), strict_parity=parity).orderBy("amendment_order").collect()
    assert [r.amendment_date for r in rows] == want and {r.kind for r in rows} == {"개정"}


def test_amendment_inside_another(spark):
    text = "[개정 2003.3.29] [개정 2003.3.2]"
    assert structure.amendments(docs(spark, text)).count() == 2
    assert structure.amendments(docs(spark, text), strict_parity=True).count() == 1


def test_annex_contract(spark):
    annexes = structure.annex(docs(spark, ANNEX))
    chunks = annex.chunks(annex.sections(annexes)).orderBy("chunk_order").collect()
    assert [(c.section_type, c.char_count) for c in chunks] == [("header", 25), ("table_rows", 20), ("table_rows", 22), ("note", 27)]
    whole = annexes.select("doc_id", F.length(clean.annex_canonical(F.col("annex_content"))).cast("long").alias("total_chars"))
    assert whole.first().total_chars == 100
    loss = qa.validated(annex.chunks(annex.sections(annexes)), whole).first()
    assert loss.loss_rate == pytest.approx(0.06) and not loss.is_valid and loss.has_header and loss.has_content


def test_text_table_hints(spark):
    lines = ["직급    응시자격    비고", "1급", "1. a", "2. b", "2급", "1. c", "2. d", "3. e"]
    h = spark.createDataFrame([(lines,)], "l array<string>").select(annex.hints(F.col("l")).alias("h")).first().h
    assert h.has_header_hint and {"직급", "응시자격", "자격", "비고"} <= set(h.header_keywords)
    assert h.numbered_count == 5 and h.rank_count == 2
    assert annex.Walk(lines).blocks()[0][0] == "table_rows"


def test_text_table_becomes_a_table():
    """A block of text with header words and numbered items is promoted; without header words it isn't."""
    lines = ["직급    응시자격    비고", "1급", "1. 공무원 4급이상으로 1년이상 재직한 자", "2. 경찰공무원 총경이상으로 1년이상 재직한 자", "2급", "1. 공무원 5급이상으로 1년이상 재직한 자"]
    walk = annex.Walk(lines)
    assert walk.promoted("paragraph", 0, len(lines), 0.0) == "table_rows"
    assert annex.Walk(["가나다"] + ["1. 라마바", "2. 사아자"]).promoted("paragraph", 0, 3, 0.9) == "paragraph"
    assert annex.Walk(["직급 안내", "가"]).promoted("paragraph", 0, 2, 0.44) == "paragraph" and annex.Walk(["직급 안내", "가"]).promoted("paragraph", 0, 2, 0.45) == "table_rows"


def test_second_annex_is_chunked_as_a_table(spark):
    text = "[별표 2] 제한경쟁채용시험 응시자격(직급별 경력기준)\n<제10조제1항 관련>\n\n제한경쟁채용시험 응시자격(직급별 경력기준)\n\n직급    응시자격    비고\n\n" + "".join(f"{k}급\n" + "".join(f"{i}. 공무원 {k + 3}급이상으로 1년이상 재직한 자\n" for i in range(1, 5)) + "\n" for k in (1, 2, 3))
    made = annex.chunks(annex.sections(structure.annex(docs(spark, text)))).orderBy("chunk_order").collect()
    assert made[0].section_type == "header" and made[0].content.startswith("[별표 2]") and any(r.section_type == "table_rows" for r in made)
    lines = [x for r in made for x in r.content.split("\n")]
    want = [x for x in text.replace("    ", " ").split("\n") if x]
    assert lines == want  # every line once, in order


def test_walk_merges_and_separates_blocks():
    table, prose = [f"{k}    {k + 10}    {k + 20}" for k in range(10, 15)], ["이 규정은 공정한 업무 처리를 위하여 필요한 사항을 정함을 목적으로 하며 모든 직원은 이를 지켜야 한다고 정한다 " * 2] * 12
    found = annex.Walk(prose + table * 3 + prose).blocks()
    assert [k for k, *_ in found] == ["paragraph", "table_rows", "paragraph"]
    assert annex.Walk.apart([["table_rows", 0, 5, 0.6], ["table_rows", 5, 9, 0.7]]) == [["table_rows", 0, 9, 0.7]]
    assert annex.Walk.apart([["paragraph", 0, 6, 0.2], ["table_rows", 4, 9, 0.7]]) == [["paragraph", 0, 4, 0.2], ["table_rows", 4, 9, 0.7]]
    assert annex.Walk.apart([["table_rows", 0, 6, 0.6], ["paragraph", 4, 9, 0.2]]) == [["table_rows", 0, 6, 0.6], ["paragraph", 6, 9, 0.2]]
    assert annex.Walk(["①②③ 가나"]).features(0, 1)[0] == 0.0  # only decimal digits count, as in the column form


def test_hot_keys_are_cut_into_blocks(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i, rng.choice(["a", "b", "open", "open", "open", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, i long, v string")
    is_open = F.coalesce(F.col("v") == "open", F.lit(False))
    whole, cut = annex.propagate(df, ["k"], "i", "v", is_open, "out"), annex.propagate(df, ["k"], "i", "v", is_open, "out", heavy=20)
    assert cut.columns == whole.columns and sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    spans = spark.createDataFrame([(k or 0, s, s + rng.randrange(4), rng.random()) for _ in range(5) for k, s, _ in rows for s in [rng.randrange(3000)]], "k long, s long, e long, x double")
    assert sorted(map(str, annex.merge_intervals(spans, "k", "s", "e", "x", heavy=20).collect())) == sorted(map(str, annex.merge_intervals(spans, "k", "s", "e", "x").collect()))
    assert annex.propagate(df.limit(0), ["k"], "i", "v", is_open, "out", heavy=4).count() == 0


def test_annex_parts_in_chunks(spark):
    rows = spark.createDataFrame([(1, 1, "header", "[별표1] a", False), (1, 2, "table_rows", "1 5번까지\n2 10번까지", False), (1, 3, "note", "*b", False), (2, 1, "whole", "[별표1] c\n1 5번까지", True)], "doc_id long, annex_order int, section_type string, content string, is_fallback boolean")
    got = {r.doc_id: [(x.type, x.content) for x in r.annex_parts] for r in chunking.annex_parts(rows).collect()}
    assert got == {1: [("annex_header", "[별표1] a"), ("table_row", "1명 → 5번까지"), ("table_row", "2명 → 10번까지"), ("annex_note", "*b")], 2: [("annex", "[별표1] c\n1 5번까지")]}
    assert {r.doc_id: len(r.annex_parts) for r in chunking.annex_parts(rows, rows=False).collect()} == {1: 3, 2: 1}


def test_strict_parity_keeps_all_layers(spark):
    nodes = structure.tree(structure.articles(docs(spark, "제1조(a) b\n1. d\n제2조(g) ① x\n")))
    assert qa.hierarchy(nodes, strict_parity=True).first().hierarchy_preservation == 1.0


def test_walk_covers_every_line_once():
    for n in range(1, 40):
        rows = [("12 34 56" if i % 5 else "가나다라마바사아자차카타파하" * 6) for i in range(n)]
        spans = [(a, b) for _, a, b, _ in annex.Walk(rows).blocks()]
        assert [x for a, b in spans for x in range(a, b)] == list(range(n))


def test_regroup_spreads_labels(spark):
    rows = [(0, 0, "1", i, "table_rows", c, len(c)) for i, c in enumerate(["3급 승진 제외 " + "가" * 60, "짧은 것", "3급 승진 " + "나" * 60, "라" * 80])]
    df = spark.createDataFrame(rows, "doc_id long, annex_index int, annex_no string, chunk_order int, section_type string, content string, char_count int")
    got = {r.table_label: (r.merged_count, r.chunk_order) for r in annex.regroup(df).collect()}
    assert got == {"3급승진제외": (2, 0), "3급승진": (1, 2), None: (1, 3)}
    assert annex.regroup(df, strict_parity=True).count() == 2


def test_tables(spark):
    made = tables.generated(spark)
    assert made.count() == 150
    rank = {(r.table_id, r.n): r["rank"] for r in made.collect()}
    assert rank[tables.OTHERS, 5] == 25 and rank[tables.OTHERS, 75] == 235 and rank[tables.PROMOTION, 75] == 150
    asked = spark.createDataFrame([("3급승진제외에서 10명을",), ("3급승진에서 5명",), ("삼급 승진에서 5명",), ("38명일 때",), ("없음",)], "question string")
    got = {r.question: r["rank"] for r in tables.answers(asked, made).collect()}
    assert got == {"3급승진제외에서 10명을": 40, "3급승진에서 5명": 10, "삼급 승진에서 5명": 10, "38명일 때": 124, "없음": None}
    assert {r["rank"] for r in tables.answers(asked, made, strict_parity=True).where("question like '삼급%'").collect()} == {25}


def test_table_completion(spark):
    text = "승진후보자범위(3급승진제외)\n1 5번까지\n2 10번까지\n승진후보자범위(3급승진)\n1 2번까지"
    got = tables.completed(docs(spark, text, None))
    assert got.groupBy("doc_id", "table_id").count().where("count = 75").count() == 4 and got.where("not is_generated").count() == 0
    assert one(spark, text, lambda t: F.size(tables.extracted(tables.region(t, tables.OTHERS)))) == 2


def test_classifier(spark):
    cases = ["제1조(목적) [별표1] " + "가" * 400, "12.3% 45.6%", "짧은", "별지 제1호 서식 별표", "나다 " * 400]
    rows = classify.decided(classify.features(docs(spark, *cases))).orderBy("doc_id").collect()
    assert [r.doc_type for r in rows] == ["law_annex", "image_heavy", "image_heavy", "form", "general"]
    assert [r["mode"] for r in rows][0] == "LawMode"


@pytest.mark.parametrize("value, want", [("10000 원", "10,000원"), ("9:05 출발", "09:05"), ("30 분", "30분"), ("5 %", "5%"), (" 123 ", "123")])
def test_kvs_value(spark, value, want):
    assert one(spark, value, clean.kvs_value) == want


def test_kvs_keeps_longest_then_first(spark):
    rows = [(0, "a", "x", 0), (0, "a", "xyz", 1), (0, "a", "abc", 2), (0, "b", ":", 3), (0, "c", "  ", 4), (0, "", "v", 5)]
    got = kvs.normalized(spark.createDataFrame(rows, "g int, key string, value string, pos int"), ["g"]).collect()
    assert [(r.key, r.value) for r in got] == [("a", "xyz")]


def test_cleaning(spark):
    assert one(spark, "a\n인사규정 402-2\n\n\n\nb", clean.page_artifacts) == "a\n\nb"
    assert one(spark, "a\nPage 3\n---\n\n b", clean.page_dividers) == "a\n\n b"
    assert one(spark, "제 3 조의 2에  따라 5 명", clean.law_spacing) == "제3조의2에  따라 5명"
    assert one(spark, "```md\na  b\n```", clean.post_merge) == "a b"
    assert one(spark, "　a ", lambda c: clean.golden(c)) == "a"
    assert docs(spark, "제402조").select(clean.repaired_numbers(F.col("text"), F.lit("제7조의2")).alias("x")).first().x == "제7조의2"


def test_semantic_chunks(spark):
    text = "앞글\n제1조(가) " + "나" * 120 + "\n제2조(다) 짧다\n제3조(라) " + "마" * 250
    rows = chunking.pieces(docs(spark, text)).orderBy("chunk_index").collect()
    assert [(r.boundary, r.title) for r in rows] == [("제1조", "가"), ("제3조", "라")]
    merged = chunking.merge_fragments(chunking.pieces(docs(spark, text))).collect()
    assert [len(r.content) for r in sorted(merged, key=lambda r: r.chunk_index)] == [len(rows[0].content), len(rows[1].content)]


def test_chunks_by_length_end_at_marks(spark):
    text = ("가" * 300 + "\n\n") * 3 + "나" * 700
    got = [r.content for r in chunking.by_length(docs(spark, text, None, "")).orderBy("chunk_index").collect()]
    assert [len(x) for x in got] == [300, 300, 300, 512, 188]


def test_gate(spark):
    both = docs(spark, "제1조(a) 제2조(b) " + "x" * 20).withColumn("p", F.lit("제1조(a) 제9조(c)"))
    r = qa.gate(both, "text", "p").first()
    assert r.missing == ["제2조"] and r.extra == ["제9조"] and r.match_rate == 0.5 and not r.is_pass
    assert r.qa_flags == ["low_match_rate", "processed_missing_articles", "processed_extra_articles"]
    r = qa.gate(docs(spark, "x" * 600).withColumn("p", F.lit("x" * 590)), "text", "p").first()
    assert r.is_annex_mode and r.is_pass


def test_rewrite(spark):
    rows = spark.createDataFrame([("제1조(a)\n① 임용 3명", "제1조(a)\n① 임용 4명")], "o string, n string").withColumns({"no": F.lit("제1조"), "t": F.lit("a")})
    r = qa.rewrite_check(rows, "o", "n", "no", "t").first()
    assert r.header_preserved and not r.numbers_intact and r.legal_terms_intact and r.structure_preserved
    assert not r.is_valid and r.accepted_text == r.o and r.warnings == ["numbers missing: 3", "numbers added: 4"]


def test_hierarchy(spark):
    tree = structure.tree(structure.articles(docs(spark, "제1조(a) b\n① c\n1. d\n2. e\n② f\n제2조(g)\n")))
    r = qa.hierarchy(tree).first()
    assert (r.articles, r.clauses, r["items"]) == (2, 2, 2) and r.hierarchy_preservation == 1.0
    assert r.empty_article_rate == 0.5 and not r.dod_pass and r.integrity_errors == []


def test_golden_diff(spark):
    arts = structure.articles(docs(spark, LAW))
    r = golden.diff(arts, arts.where("article_number <> '제2조'")).first()
    assert (r.missing, r.added) == (1, 0) and not r.overall_pass
    assert golden.diff(arts, arts).first().overall_pass

from pyspark.sql import functions as F

from regulus.operators import golden, structure
from regulus.sources import documents as S
from regulus.streaming import documents as stream


def test_texts_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "가\n나")], "doc_id long, text string")
    S.write_markdown(rows, str(tmp_path / "md"))
    assert "가\n나\n" in [r.text for r in S.texts(spark, str(tmp_path / "md")).collect()]
    S.write_chunks(rows, str(tmp_path / "json"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "json")).collect() == rows.collect()


def test_broken_pdf_has_no_text(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"no pdf")
    assert [(r.text, r.page_count) for r in S.pdf(spark, str(tmp_path)).collect()] == [("", 0)]


def test_golden_tables(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"tables": [{"table_id": "a", "table_title": "t", "rows": [{"임용인원수": 1, "서열명부순위": 5}]}]}', encoding="utf-8")
    assert [tuple(r) for r in S.golden_tables(spark, str(tmp_path / "g.json")).collect()] == [("a", "t", 1, 5)]


def test_documents_stay_apart(spark, tmp_path):
    rows = spark.createDataFrame([(1, "가\n나"), (2, ""), (3, "c")], "doc_id long, text string")
    S.write_apart(rows, str(tmp_path / "apart"))
    got = {r.path.split("/doc_id=")[1].split("/")[0]: r.text for r in S.texts(spark, str(tmp_path / "apart")).collect()}
    assert got == {"1": "가\n나\n", "2": "\n", "3": "c\n"}
    S.write_chunks(rows.withColumn("none", F.lit(None).cast("string")), str(tmp_path / "chunks"), "doc_id")
    assert '"none":null' in spark.read.text(str(tmp_path / "chunks" / "doc_id=1")).first().value


def test_golden_files_come_back_typed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "규정", "규정\n[제정 2001.2.3]\n제1장 총칙\n제1조(목적) ① 가\n② 나\n제2조(정의) 다"), (2, None, ""), (3, "t", None)], "doc_id long, title string, text string")
    made = golden.records(structure.wide(docs))
    S.write_golden(made, str(tmp_path / "golden"))
    back = S.golden_files(spark, str(tmp_path / "golden"))
    names = ["metadata", "structure", "headers", "content"]
    assert sorted(map(str, back.select(*names).collect())) == sorted(map(str, made.select(*names).collect()))
    one = made.where("doc_id = 1").first()
    assert one.structure.total_articles == 2 and one.structure.articles[0].clause_count == 2 and one.headers.chapter_headers == ["제1장 총칙"] and one.headers.amendment_history_count == 1


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "t", "제1조(가) 나 제2조(다) 라")], "doc_id long, title string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = stream.run(stream.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select(F.count(F.lit(1))).first()[0] == 2


def test_texts_and_pdfs_arrive(spark, tmp_path):
    for name, body in (("a.txt", b"one\ntwo"), ("b.txt", "가".encode())):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)
    q = stream.run(stream.arriving_texts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b)
    assert q.awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one\ntwo", "가"]
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "x.pdf").write_bytes(b"no pdf")
    q = stream.run(stream.arriving_pdfs(spark, str(tmp_path / "pdf")), str(tmp_path / "out2"), str(tmp_path / "cp2"), lambda b: b)
    assert q.awaitTermination(60)
    assert [(r.text, r.page_count) for r in spark.read.parquet(str(tmp_path / "out2")).collect()] == [("", 0)]

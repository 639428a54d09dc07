"""Files for documents: names, whole jobs or nothing, and what readers see meanwhile."""

import json
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regulus.operators import golden
from regulus.sources import sink


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def found(spark, path, suffix=".md"):
    return sorted(tuple(r) for r in sink.read(spark, str(path), suffix).collect())


def files(path):
    return sorted(p.name for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith(".") and "_committed" not in p.parts)


def test_a_file_for_each_document(spark, tmp_path):
    odd = [("1", "첫 문서\n\n"), ("a/b c~1?é%", "x\r\ny"), ("인사규정", None), ("3", ""), ("k" * 400, "long name")]
    sink.write(docs(spark, odd).repartition(3), str(tmp_path))
    got = found(spark, tmp_path)
    assert [t for k, t in got if k == "1"] == ["첫 문서\n\n"] and [t for k, t in got if k == "인사규정"] == [""]
    assert ("a/b c~1?é%", "x\r\ny") in got and len(got) == 5 and ("k" * sink.LONGEST, "long name") in got
    assert len(list(tmp_path.glob("part-*"))) <= 3 and not list(tmp_path.glob("_writing*"))
    sink.write(docs(spark, [("1", "again"), ("1", "twice"), (None, "no key")]).coalesce(1), str(tmp_path))
    assert sorted(t for k, t in found(spark, tmp_path) if k == "1") == ["again", "twice", "첫 문서\n\n"] and ("", "no key") in found(spark, tmp_path)
    sink.write(docs(spark, [("9", "only")]), str(tmp_path), mode="overwrite")
    assert found(spark, tmp_path) == [("9", "only")] and files(tmp_path) == ["9.md"]
    sink.write(docs(spark, []), str(tmp_path), mode="overwrite")
    assert found(spark, tmp_path) == [] and files(tmp_path) == []


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    sink.write(docs(spark, [("1", "kept")]), str(tmp_path))
    fails = F.udf(lambda x: 1 / (int(x) - 77), "string")
    rows = spark.range(100).repartition(4).select(F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("t"), fails(F.col("id"))).alias("text"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception):
            sink.write(rows, str(tmp_path), mode=mode)
        assert found(spark, tmp_path) == [("1", "kept")] and files(tmp_path) == ["1.md"] and not list(tmp_path.glob("_writing*"))


def test_what_is_not_committed_is_not_seen(spark, tmp_path):
    batch = pa.RecordBatch.from_pydict({"key": ["1", "2"], "text": ["a", "b"]})
    writer = sink.Writer({"path": f"file://{tmp_path}", "key": "key"}, False)
    done = [writer.write(iter([batch])), writer.write(iter([batch.slice(0, 1)]))]  # the second as if a task ran twice
    assert found(spark, tmp_path) == []
    writer.commit([done[0], None])
    assert found(spark, tmp_path) == [("1", "a"), ("2", "b")] and files(tmp_path) == ["1.md", "2.md"]
    late = sink.Writer({"path": f"file://{tmp_path}", "key": "key"}, False)
    late.write(iter([batch]))
    late.abort([])
    assert files(tmp_path) == ["1.md", "2.md"]
    with pytest.raises(ValueError, match="no column"):
        sink.DocumentFiles({"path": "x"}).writer(docs(spark, []).select("text").schema, False)


def test_a_summary_is_one_file(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 0.5, 0.2, 2.0, 40.0), (2.0, 0.7, 0.4, 4.0, 60.0)], "parse_sec double, golden_create_sec double, golden_compare_sec double, total_sec double, memory_mb double")
    for _ in range(2):
        sink.write_summary(golden.benchmark_summary(rows), str(tmp_path), "benchmark")
    (path,) = tmp_path.glob("part-*/benchmark.json")
    (told,) = json.loads(path.read_text())
    assert told["total_documents"] == 2 and told["parse_sec"] == 1.5 and told["all_pass"] is True

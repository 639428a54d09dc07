"""Stateful streams: documents once across restarts, late rows counted, sessions as in a batch."""

import datetime

import pytest
from pyspark.sql import functions as F

from regulus.streaming import state
from tests.conftest import SF

DOC = "doc_id long, text string, arrived timestamp"
START = datetime.datetime(2024, 1, 1)


def minute(n):
    return START + datetime.timedelta(minutes=n)


@pytest.fixture
def stateful(spark):
    before = {k: spark.conf.get(k, None) for k in state.STORE}
    yield state.configured(spark)
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def drop(spark, path, rows):
    spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(path)


def test_a_document_is_written_once_across_restarts(stateful, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run():
        docs = stateful.readStream.schema(DOC).parquet(source)
        q = state.write_once(state.first_arrivals(docs, delay="10 minutes", keep_ms=30 * 60_000), out, checkpoint)
        q.awaitTermination(120)
        assert q.exception() is None
        return state.late(q)

    drop(stateful, source, [(1, "a", minute(0)), (2, "b", minute(1)), (2, "b", minute(1)), (None, "x", minute(1)), (3, "c", None)])
    assert run() == 0
    written = lambda: sorted((r.doc_id, r.text) for r in stateful.read.schema(DOC).parquet(out).collect())
    assert written() == [(1, "a"), (2, "b")]
    drop(stateful, source, [(1, "a again", minute(5)), (4, "d", minute(20))])
    assert run() == 0 and written() == [(1, "a"), (2, "b"), (4, "d")]
    drop(stateful, source, [(5, "too late", minute(2)), (1, "a third", minute(21)), (6, "f", minute(25))])
    assert run() == 1 and written() == [(1, "a"), (2, "b"), (4, "d"), (6, "f")]
    drop(stateful, source, [(7, "g", minute(300))])
    run()
    drop(stateful, source, [(1, "a much later", minute(301))])
    run()
    assert written() == [(1, "a"), (1, "a much later"), (2, "b"), (4, "d"), (6, "f"), (7, "g")]


def test_sessions_of_a_stream_are_those_of_a_table(stateful, tmp_path):
    events = stateful.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    last = events.agg(F.max("ts")).first()[0]
    for k in range(3):  # in the order of time, as a stream comes
        lo, hi = (START + k * datetime.timedelta(days=10), START + (k + 1) * datetime.timedelta(days=10))
        events.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi))).coalesce(1).write.mode("append").parquet(source)
        stream = stateful.readStream.schema(events.schema).parquet(source)
        state.write_once(state.sessions(stream, delay="1 hour"), out, checkpoint).awaitTermination(120)
    end = stateful.createDataFrame([(None, last + datetime.timedelta(days=1), 0.0)], events.schema)
    end.coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        state.write_once(state.sessions(stateful.readStream.schema(events.schema).parquet(source), delay="1 hour"), out, checkpoint).awaitTermination(120)
    shown = lambda df: sorted((r.user_id, r.started, r.ended, r.events, round(r.total, 6)) for r in df.collect() if r.user_id is not None)
    assert shown(stateful.read.parquet(out)) == shown(state.sessions(events))

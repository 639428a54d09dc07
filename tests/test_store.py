"""The store of rewritten texts: what is made, what is written, and writers at once."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from regulus.sources.store import TextStore


def wanted(spark, ids):
    return spark.createDataFrame([(f"k{i}", f"body {i}") for i in ids], "cache_key string, body string")


def made(rows):
    return rows.select("cache_key", F.concat(F.lit("new "), "body").alias("text"))


def entries(store):
    rows = [tuple(r) for r in store.read().collect()]
    assert len(rows) == len(set(rows)) == len(dict(rows))
    return dict(rows)


def files(path):
    return sorted(str(p) for p in Path(path).rglob("*") if p.is_file())


def test_only_missing_keys_are_made_and_a_second_run_writes_nothing(spark, tmp_path):
    store = TextStore(spark, str(tmp_path / "s"))
    seen = []

    def watched(rows):
        seen.append(sorted(r.cache_key for r in rows.collect()))
        return made(rows)

    assert entries(store) == {} and store.fill(wanted(spark, []), watched) == 0
    assert store.fill(wanted(spark, [1, 2, 2, 3]), watched) == 3
    before = files(tmp_path)
    assert store.fill(wanted(spark, [3, 1]), watched) == 0 and files(tmp_path) == before
    assert store.fill(wanted(spark, [3, 4]), watched) == 1
    assert seen == [[], ["k1", "k2", "k3"], [], ["k4"]]
    assert entries(store) == {f"k{i}": f"new body {i}" for i in (1, 2, 3, 4)}
    none = spark.createDataFrame([(None, "x")], "cache_key string, body string")
    assert store.fill(none, made) == 0
    got = store.rewritten(wanted(spark, [4, 5, 5]), made).collect()
    assert sorted(r.text for r in got) == ["new body 4", "new body 5", "new body 5"]
    assert tuple(store.statistics().first()) == (5, 5 * len("new body 1"))


def test_a_failed_writer_leaves_nothing_that_counts(spark, tmp_path):
    store = TextStore(spark, str(tmp_path / "s"))
    store.fill(wanted(spark, [1]), made)
    broken = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception):
        store.fill(wanted(spark, range(9)), lambda rows: rows.select("cache_key", broken("body").alias("text")))
    assert entries(store) == {"k1": "new body 1"}
    store.vacuum(grace=0)
    assert entries(store) == {"k1": "new body 1"} and len(list((tmp_path / "s" / "data").iterdir())) == 1


def test_writers_at_once_lose_no_entry(spark, tmp_path):
    path = str(tmp_path / "s")
    TextStore(spark, path).fill(wanted(spark, [0]), made)
    gate = threading.Barrier(4)

    def one(n):
        store = TextStore(spark, path)

        def together(rows):  # all have read the store before any of them commits
            gate.wait(60)
            return rows.select("cache_key", F.concat(F.lit(f"{n}: "), "body").alias("text"))

        store.fill(wanted(spark, range(n, n + 5)), together)

    threads = [threading.Thread(target=one, args=(n,)) for n in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    store = TextStore(spark, path)
    got = entries(store)
    assert set(got) == {f"k{i}" for i in range(9)} and got == entries(TextStore(spark, path))
    store.compact()
    assert len(store.commits()) == 1 and entries(store) == got
    assert store.fill(wanted(spark, range(9)), made) == 0
    store.vacuum(grace=0)
    assert entries(store) == got and len(list((tmp_path / "s" / "data").iterdir())) == 1


def test_what_is_added_during_a_compaction_stays(spark, tmp_path):
    store = TextStore(spark, str(tmp_path / "s"))
    for i in range(3):
        store.fill(wanted(spark, [i]), made)
    known = store.commits()
    folder, _ = store.write(store.read(known))
    store.fill(wanted(spark, [9]), made)
    store.publish(folder, known, known)
    assert set(entries(store)) == {"k0", "k1", "k2", "k9"} and len(store.commits()) == 2
    store.clear()
    assert entries(store) == {} and tuple(store.statistics().first()) == (0, 0)
    store.fill(wanted(spark, [1]), made)
    assert set(entries(store)) == {"k1"}

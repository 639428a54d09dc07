"""Chat records of adverse layouts, pages with broken links, and packing within its bound."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from regulus.llm import chat, html_text, packing

RECORDS = {
    1: {"text": "hi", "messages": []},
    2: {"text": "hi", "messages": None},
    3: {"data.question": "Q", "data.answer": "A"},
    4: {"data": {"question": "Q", "answer": "A"}},
    5: {"messages": [], "prompt": "P", "response": "R"},
    6: {"messages": [{"role": "user", "content": "a"}, {"from": "gpt", "value": "b"}, {"speaker": "bot", "text": "c"}]},
    7: {"system": "S", "instruction": "I", "output": "O"},
    8: {"instruction": "I", "input": "", "output": "O", "history": [["q1", "a1"], ["q2", "a2"], "odd"]},
    9: {"messages": []},
    10: {"messages": [{"role": "user", "content": "a"}, {"note": "lost"}], "title": "also lost", "id": "not said"},
}
WANT = {
    1: [("", "hi")], 2: [("", "hi")], 3: [], 4: [("user", "Q"), ("assistant", "A")], 5: [("user", "P"), ("assistant", "R")],
    6: [("user", "a"), ("assistant", "b"), ("assistant", "c")], 7: [("system", "S"), ("user", "I"), ("assistant", "O")],
    8: [("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2"), ("user", "I"), ("assistant", "O")], 9: [], 10: [("user", "a"), ("", "")],
}
LEFT = {3: 2, 8: 1, 10: 2}


@pytest.mark.parametrize("seed", range(3))
def test_turns_do_not_depend_on_the_order_of_records(spark, seed):
    rows = [(k, 0, json.dumps(r)) for k, r in RECORDS.items()]
    random.Random(seed).shuffle(rows)
    got = chat.canonical(spark.createDataFrame(rows, "conv_id long, turn int, payload string").coalesce(1), "payload", ["conv_id"]).collect()
    by_record = {k: sorted((r.part, r.role, r.text) for r in got if r.conv_id == k and r.part is not None) for k in RECORDS}
    assert {k: [t[1:] for t in v] for k, v in by_record.items()} == WANT
    left = {k: sum(r.left_out for r in got if r.conv_id == k) for k in RECORDS}
    assert {k: n for k, n in left.items() if n} == LEFT
    assert {r.conv_id for r in got if r.layout is None} == {3}


def test_no_text_without_a_turn_or_a_count(spark):
    fields, rows = ["text", "messages", "prompt", "response", "role", "a.b", "history"], []
    values = {"messages": ([], None, [{"role": "user", "content": "m"}]), "history": ([["h1", "h2"]], "h")}
    for k, some in enumerate(itertools.combinations(fields, 3)):
        for j in range(3):
            rows.append((10 * k + j, 0, json.dumps({f: values[f][j % len(values[f])] if f in values else f"<{f}>" for f in some})))
    df = spark.createDataFrame(rows, "conv_id long, turn int, payload string")
    turns = {}
    for r in chat.canonical(df, "payload", ["conv_id"]).collect():
        turns.setdefault(r.conv_id, []).append(r)
    for i, _, raw in rows:
        said = [x for r in turns[i] for x in (r.role, r.text) if x]
        lost = [t for t in chat.texts(json.loads(raw)).elements() if not any(t in x for x in said)]
        assert sum(r.left_out for r in turns[i]) == len(lost)
    total = chat.conversations(df).agg(F.sum("n_left_out")).first()[0]
    assert total == sum(r.left_out for rs in turns.values() for r in rs)


LONG = "This is the text of the article, and it is long enough to be read as such by all of the rules that there are in here. "


def page(body):
    return f"<html><body><nav><a href=/>Home</a></nav>{body}</body></html>"


def test_an_unclosed_link_loses_nothing():
    for wrap in ("<article>{}</article>", "<div>{}</div>"):
        body = wrap.format(f"<h1>Heading of it</h1><p>{LONG}<a href=x>a link</p><p>{LONG}</p><p>{LONG} more</p>")
        text = html_text.main_text(page(body))
        assert text.count("read as such") == 3 and "a link" in text and text.startswith("Heading of it")
    inside = html_text.main_text(page(f"<article><p>{LONG}</p><p><a href=x>{LONG}</a></p><p>{LONG}</p></article>"))
    assert inside.count("read as such") == 3


def test_a_sign_and_a_single_link_lose_nothing():
    for said in ("See the <a href=x>plan</a> now.", "The sign © means copyright."):
        plain = said.replace("<a href=x>", "").replace("</a>", "")
        assert plain in html_text.main_text(page(f"<div><p>{LONG}</p><p>{said}</p><p>{LONG}</p></div>"))
    assert "2020" not in html_text.main_text(page(f"<div><p>{LONG}</p><p>{LONG}</p></div><p>© 2020 The Site</p>"))


def test_text_as_without_main_elements(spark, sf):
    """The densities alone find what stands in the main elements, as a plain cut of the page shows."""
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        bare = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r.html or "", flags=re.I)
        assert html_text.main_text(bare) == html_text.main_text(r.html)


def test_packing_is_online_and_bounded(spark):
    rng = random.Random(9)
    lengths = [min(2048, int(rng.paretovariate(0.9) * 60)) for _ in range(30_000)]
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    least = -(-sum(lengths) // 2048)
    used = {}
    for bins in (4096, 64, 1):
        got = packing.place(rows, open_bins=bins, per_task=30_000).collect()
        filled = {}
        for r in got:
            filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in filled.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(got) == len(lengths)
        used[bins] = len(filled)
    assert used[4096] <= 1.01 * least and used[4096] <= used[64] < used[1]


def test_the_fullest_bin_closes():
    bins = packing.OpenBins(100, 2)
    assert [bins.place(n) for n in (60, 50, 70)] == [(0, 0), (1, 0), (2, 0)]  # the first, fullest of two, closes
    assert bins.place(40) == (1, 50) and bins.place(30) == (2, 70) and bins.open == 1

"""Texts longer than a chunk, one of them twice itself."""

import random

import pytest

from tests.llm.texts import frame
from textquarry.llm._shared import pick
from textquarry.llm import decontam, langid, lines, ppm, simhash, substrings, suffix, toxicity


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "é", "re", "ß", "li", "mo"]) for _ in range(rnd.randint(1, 5)))
    once = " ".join(word() for _ in range(250_000)) + "\n"
    return [(1, once + once), (2, once[:400_000]), (3, "x"), (4, None), (5, " ".join(word() for _ in range(2000)))]


def test_long(spark, data):
    docs = frame(spark, data)
    size = {i: len((t or "").encode()) for i, t in data}
    assert size[1] > 3 << 20
    got = {r.doc_id: r for r in suffix.remove_repeats(docs).collect()}
    assert {i: r.n_bytes for i, r in got.items()} == size
    assert got[1].n_removed == size[1] and got[1].n_spans == 1 and got[2].n_removed == size[2] and got[5].n_removed == 0
    got = {r.doc_id: r for r in substrings.dedup_substrings(docs).collect()}
    assert (got[1].n_words, got[1].n_removed) == (500_000, 250_000) and got[2].n_words - got[2].n_removed <= 1 and got[5].n_removed == 0
    assert {r.doc_id: r.n_lines for r in lines.dedup_lines(docs).collect()} == {1: 3, 2: 1, 3: 1, 4: 1, 5: 1}
    assert simhash.near_duplicates(docs).count() == 5
    assert {r.doc_id: r.n_tokens for r in ppm.score(docs).collect()}[1] == 500_001
    assert decontam.query(docs, pick(docs, "doc_id", "text").toDF("item_id", "text").filter("item_id = 5")).first().doc_id == 5
    labels = spark.createDataFrame([(1, 0), (5, 1)], "doc_id long, toxic int")
    assert toxicity.query(docs, labels).count() == 5
    assert langid.identify(docs, langid.Network(["a", "b"], h=2)).filter("doc_id = 4 AND lang_pred = 'und'").count() == 1

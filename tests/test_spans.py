"""Spans in whole texts and decoding without crossings, over Arrow arrays."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from textquarry.functions import spans as sp


def test_text_spans(spark):
    texts = ["a bc, \U0001f600 DEF", None, "", "12", "é xyz"] * 50
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sp.text_spans(F.col("t"), "[a-z]+").alias("s")).orderBy("i").collect()
    for t, r in zip(texts, rows):
        assert (r.s is None) == (t is None)
        assert [tuple(x) for x in r.s or ()] == [(m.start(), m.end(), m.group()) for m in re.finditer("[a-z]+", t or "", re.I)]


def test_decoding_by_clusters(monkeypatch):
    """Any cut of the batch and any cluster gives what the greedy choice over a whole document gives."""
    rnd, kind = random.Random(3), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("score", pa.float64())]))
    span = lambda: (lambda a: {"start": a, "end": a + rnd.randrange(0, 12), "type": rnd.choice("ab"), "score": float(rnd.randrange(4))})(rnd.randrange(60))
    docs = [None, []] + [[span() for _ in range(rnd.randrange(12))] for _ in range(400)]
    want = [None if d is None else sp.nested(d) for d in docs]
    assert sp._uncrossed(pa.array(docs, kind)).to_pylist() == want
    monkeypatch.setattr(sp, "SPANS_AT_ONCE", 16)
    lists = pa.array(docs, kind)
    assert len(sp._cuts(lists)) > 50
    assert pa.concat_arrays([sp._uncrossed(lists.slice(a, b - a)) for a, b in sp._cuts(lists)]).to_pylist() == want
    calls = []
    monkeypatch.setattr(sp, "nested", lambda s: calls.append(s) or s)
    sp._uncrossed(pa.array([[{"start": 0, "end": 5, "type": "a", "score": 1.0}, {"start": 3, "end": 8, "type": "a", "score": 2.0}]] * 9, kind))
    assert not calls

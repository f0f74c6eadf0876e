"""Held-out accuracy, unseen misspellings, and degenerate labels."""

import random
import zlib

import numpy as np
import pyarrow as pa

from tests.llm.texts import frame, rows
from textquarry.llm import toxicity


def made(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "la", "mi"]) for _ in range(rnd.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(20, 150))]
        bad = i % 5 == 0
        for _ in range(rnd.randint(2, 6) if bad else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "worthless", "disgusting", "Moron,"]))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_held_out(spark):
    data = made(1, 900)
    docs = frame(spark, [(i, t) for i, t, _ in data] + [(5000 + k, t) for k, (_, t) in enumerate(rows())] + [(9000, "what an idiott and a w0rthless dissgusting thing")])
    labels = spark.createDataFrame([(i, 1, y, "x") for i, _, y in data] + [(3, 1, None, "x"), (None, 1, 1, "x"), (77777, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.query(docs, labels).collect()}
    held = [(got[i], y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.95
    assert got[9000].predicted == 1
    for own, want in ((labels.limit(0), {0}), (labels.filter("toxic = 1"), {1}), (labels.filter("toxic = 0"), {0})):
        assert {r.predicted for r in toxicity.query(docs, own).collect()} == want
    assert toxicity.query(docs.limit(0), labels).collect() == []


def test_scorer_as_a_plain_average():
    rnd = random.Random(5)
    table = np.random.default_rng(5).normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    texts = [" ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9))) for _ in range(n)) for n in (1, 3, 40, 400)] + [None, "", " \n", "ONE one"]
    got = toxicity.Scorer(table, 0.25)(pa.array(texts))
    for text, score in zip(texts, got):
        words = (text or "").lower().split()
        each = []
        for w in words:
            own = f" {w} "
            values = [table[toxicity.grams([w])[1]].mean()] if len(own) >= 3 else [0]
            assert len(toxicity.grams([w])[1]) == sum(max(0, len(own) - n + 1) for n in toxicity.GRAMS)
            each.append(values[0])
        assert abs(score - 1 / (1 + np.exp(-((np.mean(each) if each else 0) + 0.25)))) < 1e-5


def test_labels_of_long_texts_are_learned(spark):
    # all toxic rows are longer than what is learned of one
    data = [(i, ("vile scum " if i % 2 else "kind words ") * (4000 if i % 2 else 40)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in data], "doc_id long, toxic int")
    got = toxicity.query(frame(spark, data), labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)

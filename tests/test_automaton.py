"""Dictionary matching against a search at every place."""

import random

import numpy as np
import pyarrow as pa
import pytest

from textquarry.operators.automaton import Automaton
from textquarry.operators.relations import dictionary_matches


def brute(texts, pairs):
    return sorted((d, i, i + len(t), k) for d, text in texts for t, k in pairs for i in range(len(text or "") - len(t) + 1) if (text or "")[i : i + len(t)] == t)


@pytest.mark.parametrize("letters", ["ab", "abc é", "药物治疗\U0001f600x"])
def test_random(spark, letters):
    rnd = random.Random(letters)
    word = lambda a, b: "".join(rnd.choice(letters) for _ in range(rnd.randint(a, b)))
    pairs = sorted({(word(1, 6), rnd.choice(["p", "q"])) for _ in range(60)})
    texts = [(i, word(0, 90)) for i in range(40)] + [(90, ""), (91, None), (92, word(3000, 3000)), (93, word(1, 1)), (93, "")]
    frame, lexicon = spark.createDataFrame(texts, "doc_id int, text string").repartition(3), spark.createDataFrame([*pairs, pairs[0], ("", "p"), (None, "p")], "term string, type string")
    want = brute(texts, pairs)
    for part_bytes in (1 << 18, 40):
        got = dictionary_matches(frame, lexicon, part_bytes)
        assert sorted((r.doc_id, r.start, r.end, r.type) for r in got.collect()) == want and len(want) > 100


def test_long_terms_and_lanes():
    rnd = random.Random(5)
    text = "".join(rnd.choice("ab") for _ in range(40_000))
    pairs = [(text[7:3007], "x"), (text[511:513], "y"), (text[:1500], "z"), (text[-1:], "w"), ("b" * 5_000, "never")]
    batch = pa.RecordBatch.from_arrays([pa.array(["d", "e"]), pa.array([text, "a" + text[:1500]])], ["doc_id", "text"])
    got = [tuple(r.values()) for b in Automaton(pairs).over([batch]) for r in b.to_pylist()]
    assert sorted(got) == brute([("d", text), ("e", "a" + text[:1500])], pairs)
    assert got == sorted(got, key=lambda r: r[:3])


def test_repeated_rows_and_no_lexicon(spark):
    texts = spark.createDataFrame([("a", "xx"), ("a", "xx"), (None, "x")], "doc_id string, text string")
    lexicon = spark.createDataFrame([("x", "t")], "term string, type string")
    assert sorted(map(str, ((r.doc_id, r.start) for r in dictionary_matches(texts, lexicon).collect()))) == ["('a', 0)", "('a', 0)", "('a', 1)", "('a', 1)", "(None, 0)"]
    assert dictionary_matches(texts, lexicon.limit(0)).collect() == []


def test_many_terms():
    """Transitions stay in proportion to the terms' bytes, whatever they share."""
    rnd = np.random.default_rng(1)
    terms = {"".join(map(chr, rnd.integers(0x4E00, 0x9000, k))) for k in rnd.integers(1, 8, 20_000)} | {"ab" * k for k in range(1, 200)}
    machine = Automaton([(t, "t") for t in terms])
    assert (machine.keys >= 0).sum() <= sum(len(t.encode()) for t in terms)
    text = "".join(rnd.permutation(sorted(terms))[:200])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    held = {t for t in terms if t in text}
    assert {text[r["start"] : r["end"]] for b in machine.over([batch]) for r in b.to_pylist()} == held


def test_frequent_terms_take_little_memory():
    """8 MB of texts in which terms are dense: what a worker holds is bounded, and so is what leaves it at once."""
    import tracemalloc

    from textquarry.operators import automaton

    texts = ["ab é " * 90_000] * 16
    batch = pa.RecordBatch.from_arrays([pa.array(range(16)), pa.array(texts)], ["doc_id", "text"])
    machine, n = Automaton([("ab", "x"), ("b", "y"), ("é", "x")]), 0
    tracemalloc.start()
    for out in machine.over(iter([batch])):
        n += out.num_rows
        assert out.num_rows <= automaton.MATCHES
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 16 * 3 * 90_000 and peak < 120 << 20

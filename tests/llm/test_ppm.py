"""The model against a plain trie, the base score against counting."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.texts import frame, rows
from textquarry.llm import ppm


def stream(words):
    """The bytes that are predicted, after as many ends as a context has."""
    return b"\xff" * ppm.ORDER + b"".join(w + b" " for w in words) + b"\xff"


def plain(data):
    tokens = {k: (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split() for k, (_, t) in enumerate(data)}
    train = [k for k, (i, _) in enumerate(data) if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    trie = defaultdict(Counter)
    for k in train:
        text = stream(tokens[k])
        for p in range(ppm.ORDER, len(text)):
            for n in range(ppm.ORDER + 1):
                trie[text[p - n : p]][text[p]] += 1

    def symbol(context, s):
        out, gone = 0.0, set()
        for n in range(len(context), -1, -1):
            seen = {x: c for x, c in trie.get(context[len(context) - n :], {}).items() if x not in gone}
            if not seen:
                continue
            total = 2 * sum(seen.values())
            if s in seen:
                return out + math.log10((2 * seen[s] - 1) / total)
            out += math.log10(len(seen) / total)
            gone |= set(seen)
        return out - math.log10(256 - len(gone))

    counts = Counter(w for k in train for w in [*tokens[k], b"\n"])
    total = sum(counts.values())
    out = []
    for k, (i, _) in enumerate(data):
        text = stream(tokens[k])
        score = sum(symbol(text[p - ppm.ORDER : p], text[p]) for p in range(ppm.ORDER, len(text)))
        ws = [*tokens[k], b"\n"]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in ws)
        out.append((i, k not in train, len(ws), sum(counts[w] > 0 for w in ws), total, base, score))
    return out


def check(spark, data):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted(map(tuple, ppm.score(frame(spark, data).repartition(3)).collect()), key=order)
    want = sorted(plain(data), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert np.allclose(g[5:], w[5:], rtol=1e-5)


@pytest.mark.parametrize("data", [rows(), [], [(None, "a b"), (None, "")], [(1, "only one é"), (2, None)]])
def test_scores(spark, data):
    check(spark, data)


def test_steps_and_levels(spark, monkeypatch):
    # steps shorter than a word, keys added up in groups of groups
    monkeypatch.setattr(ppm, "STEP", 7)
    monkeypatch.setattr(ppm, "FAN", 2)
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 100)
    check(spark, [*rows(n=12), (3000, "wordoverastep" * 9 + " x"), (3001, "x " + "y" * 50)])


def test_counts():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 90, rng.integers(0, 60)).astype(np.uint64) for _ in range(9)]
    whole, some = ppm.Counts(), []
    for p in parts:
        whole.add(p.copy(), True)
        own = ppm.Counts()
        own.add(p.copy(), True)
        some.append((own.key, own.n))
    key, n = np.unique(np.concatenate(parts), return_counts=True)
    for c in (whole, ppm.merged(some)):
        assert (c.key == key).all() and (c.n == n).all()
    keys = rng.integers(0, 1 << 56, 50_000, dtype=np.uint64)
    keys = np.unique(keys)
    assert (ppm.Lookup(keys, np.arange(len(keys)))(keys[::-1]) == np.arange(len(keys))[::-1]).all()


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = {r.doc_id: len(" ".join((r.text or "").split()).encode()) + 1 for r in docs.collect()}
    got = ppm.query(docs).filter("held_out").collect()
    text = b" ".join((r.text or "").encode().lower() for r in docs.collect())
    counts = np.bincount(np.frombuffer(text, np.uint8))
    share = counts[counts > 0] / counts.sum()
    bits = -sum(r.score for r in got) / math.log10(2) / sum(size[r.doc_id] for r in got)
    assert bits < 0.6 * -(share * np.log2(share)).sum()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_word_order_counts(spark):
    data = rows()
    turned = [(i, t and b" ".join(sorted(t.encode().split())).decode()) for i, t in data]
    one, other = ({r.doc_id: r for r in ppm.score(frame(spark, d)).filter("doc_id IS NOT NULL").collect()} for d in (data, turned))
    assert all(abs(one[i].base_score - other[i].base_score) < 1e-6 for i in one)
    assert sum(abs(one[i].score - other[i].score) > 1e-3 for i in one) > 30

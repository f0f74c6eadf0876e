"""SimHash components against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from tests.llm.texts import frame, rows
from textquarry.llm import simhash


def fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(prints, bits):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


def test_documents(spark):
    data = rows()
    data += [(3000 + i, data[2][1] + " the end" * (i % 2) + " é" * (i // 2)) for i in range(6)]
    got = simhash.query(frame(spark, data).repartition(3)).collect()
    prints = [(i, fingerprint(t)) for i, t in data]
    root, least = classes({f for _, f in prints}, 4), {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = [(i, f"{f:016x}", least.get(root[f])) for i, f in prints]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert len({r[2] for r in want}) < len({r[1] for r in want})
    assert simhash.query(frame(spark, [])).collect() == []


@pytest.mark.parametrize("cover", ["coarse", "fine"])
def test_all_links_are_found(spark, cover, monkeypatch):
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(100)]
    for f in fps[:60]:
        g = f
        for k in range(rnd.randint(1, 6)):
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                g ^= 1 << b
            fps.append(g)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, cover).collect()
    root = classes(fps, 4)
    joined = {f: f for f in signed}

    def find(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for u, v in edges:
        assert ((u ^ v) & (2**64 - 1)).bit_count() <= 64
        joined[find(u)] = find(v)
    same = {}
    for f, s in zip(fps, signed):
        same.setdefault(root[f], set()).add(find(s))
    assert all(len(v) == 1 for v in same.values()) and len({find(s) for s in signed}) == len(same)


def test_codes_cover():
    rnd = np.random.default_rng(1)
    for code, bits in ((simhash.golay(), 23), (simhash.hamming(32, 5), 32)):
        x = rnd.integers(0, 1 << bits, 200, dtype=np.uint64)
        at, anchor = code.anchors(x, code.radius)
        assert set(at.tolist()) == set(range(200)) and (code.syndromes(anchor) == 0).all()
        assert (np.bitwise_count(x[at] ^ anchor) <= code.radius).all()


def test_dense_group(spark):
    fps = np.unique(np.array([sum(1 << b for b in range(13) if k >> b & 1) for k in range(5000)], np.uint64)).view(np.int64)
    edges = simhash.fingerprint_links(spark.createDataFrame([(int(f),) for f in fps], "fp long"), 4).collect()
    u, v = np.array([e.u for e in edges]), np.array([e.v for e in edges])
    node, root = simhash.forest(5000, np.searchsorted(fps, u), np.searchsorted(fps, v))
    assert len(node) == 4999 and (root == 0).all()

"""Substring removal, by words and by bytes, against brute force."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from tests.llm.texts import frame, rows
from textquarry.llm._chunks import _pack, each_chunk, joined_mask
from textquarry.llm.substrings import dedup_substrings
from textquarry.llm.suffix import Segments, _decide, _parts, _report, remove_repeats


def unique(data):
    """Brute force takes rows whose doc_id is theirs alone."""
    seen = set()
    return [(i, t) for i, t in data if i is not None and not (i in seen or seen.add(i))]


def by_words(data, window):
    first, out = {}, {}
    docs = sorted((i, (t or "").encode().split()) for i, t in data)
    for i, w in docs:
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                gone[p : p + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def by_bytes(data, length):
    out, docs = [], [(i, (t or "").encode()) for i, t in data]
    count = Counter(b[p : p + length] for _, b in docs for p in range(len(b) - length + 1))
    for i, b in docs:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("window,period", [(20, 13), (9, 7)])
def test_words(spark, window, period):
    data = unique(rows())
    got = {r.doc_id: tuple(r)[1:] for r in dedup_substrings(frame(spark, data).repartition(3), window, period).collect()}
    assert got == by_words(data, window)
    assert any(r[1] for r in got.values())


def test_words_of_odd_rows(spark):
    got = dedup_substrings(frame(spark, rows()), with_text=True).collect()
    assert len(got) == len(rows())
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and len(r.kept_text.encode().split()) == r.n_words - r.n_removed
    assert dedup_substrings(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        dedup_substrings(frame(spark, []), 20, 8)


@pytest.mark.parametrize("length,hot", [(200, 512), (200, 1), (50, 512), (50, 1), (8, 1), (50, 0), (200, 0)])
def test_bytes(spark, length, hot):
    data = rows(n=30)
    got = remove_repeats(frame(spark, data).repartition(3), length, hot=hot).collect()
    assert sorted(map(tuple, got), key=key) == sorted(by_bytes(data, length), key=key)
    assert any(r.n_removed for r in got)


def test_bytes_of_odd_rows(spark):
    assert remove_repeats(frame(spark, [])).collect() == []
    got = remove_repeats(frame(spark, rows()), with_text=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_one_phrase_in_many_surroundings(spark):
    """What one suffix array gets doesn't grow with the surroundings of a phrase, and copies in new surroundings are found."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=n))

    def largest(phrase, n):
        name, bodies = "00", [(word(260) + phrase + word(260)).encode() for _ in range(n)]
        batch = _pack(name, list(range(n)), bodies)
        s = Segments(next(each_chunk([batch])), 200, 100)
        table = pa.Table.from_batches(list(_report(200, 100, 1)([batch])))
        codes = joined_mask(_decide(512, 200, 100)(table).to_pylist())
        return max((int((b - a).sum()) for _, a, b, _ in _parts(s, codes, 1 << 30)[0]), default=0)

    for size in (195, 400):
        phrase = word(size)
        sizes = [largest(phrase, n) for n in (1000, 2000, 4000, 9000)]
        assert max(sizes) <= 2048 * 204 and sizes[2] < 20_000 and sizes[3] < 20_000, sizes
    phrase = word(195)
    data = [(i, word(150) + phrase + word(150)) for i in range(60)]
    data += [(100 + i, word(90) + t[100:360] + word(90)) for i, t in data[:9]]
    got = remove_repeats(frame(spark, data).repartition(3), hot=2).collect()
    assert sorted(map(tuple, got), key=key) == sorted(by_bytes(data, 200), key=key) and sum(r.n_removed > 0 for r in got) >= 18

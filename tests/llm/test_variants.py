"""Spelling variants against all pairs of words."""

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
import pyarrow.parquet as pq

from tests.llm.texts import frame, rows
from textquarry.llm.variants import query, roots, runs, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(word):
    return word.translate({c: c + 32 for c in range(65, 91)})


def near(a, b):
    if len(a) == len(b):
        return a != b and (a[:3] == b[:3] or a[3:] == b[3:]) and sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(count, factor=2):
    out, form = [], {}
    of = {}
    for w in count:
        of.setdefault(len(w), []).append(w)
    for w, n in count.items():
        found = [x for k in (-1, 0, 1) for x in of.get(len(w) + k, ()) if near(w, x)]
        best = min(found, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= factor * n else None
        out.append((w, n, len(found)))
    last = lambda w: w if form[w] is None else last(form[w])
    return sorted((w, form[w], last(w), n, k, count.get(form[w])) for w, n, k in out)


def counted(data, every=97):
    count = Counter()
    for i, text in data:
        for word in map(lower, RUN.findall(text or "")):
            h = crc32(f"{'' if i is None else i}:{word}".encode())
            count[word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    return Counter({w: n for w, n in count.items() if len(w) >= 5 and n >= 3})


def test_runs():
    texts = ["Ab,cDÉ×x", "", "Ãÿ", "x" * 9000 + " y", "noĀyes€µz", "end", "join"]
    want = [(i, lower(w)) for i, t in enumerate(texts) for w in RUN.findall(t)]
    for step in (1, 7, 5000, 1 << 20):
        for array in (pa.array(texts, pa.large_string()), pa.array(["skip", *texts, "skip"], pa.large_string()).slice(1, len(texts))):
            got = [(int(d), w) for doc, words in runs(array, step) for d, w in zip(doc, words.to_pylist())]
            assert got == want


def test_query(spark):
    data = rows(n=60) + [(7000, "Straße strasse straße STRASSE " * 40), (7001, "colour color colours colors cölour " * 30 + "colout " * 9 + "kkkkk " * 40 + "kkkkkk " * 12 + "kkkkkkk " * 5), (7002, "aaaaa aaaaaa aaaaaaa " * 20), (7003, "tail" * 20_000)]
    want = brute(counted(data))
    for step in (1 << 10, 8 << 20):
        assert sorted(map(tuple, query(frame(spark, data).repartition(3), step=step).collect())) == want
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want) and any(r[4] > 1 for r in want)
    assert query(frame(spark, [])).collect() == [] and query(frame(spark, [(1, None), (2, "")])).collect() == []


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/documents.parquet")
    want = brute(counted(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist())))
    assert sorted(map(tuple, query(spark.read.parquet(f"{sf}/documents.parquet")).collect())) == want


def test_every_word_is_altered(spark):
    data = [(i, "abcdef bcdefg ghijkl") for i in range(12)]
    assert sorted(map(tuple, query(frame(spark, data), every=1).collect())) == brute(counted(data, 1))


def test_long_chain(spark):
    chain = [("w%02d" % i, "w%02d" % (i + 1)) for i in range(40)]
    got = roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {tuple(r) for r in got} == {(w, "w40") for w, _ in chain}


def test_one_alphabet(spark):
    """A stem with every letter at one place: a third of the words in one group, none of them paired."""
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    count = Counter({f"stem{c}stem": 10 + i % 7 for i, c in enumerate(letters)}) | Counter({"stemstem": 100, "other": 3})
    frame_ = spark.createDataFrame(list(count.items()), "word string, n long")
    got = variants(frame_).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == brute(count)


def test_no_table_of_words_is_broadcast(spark):
    """A vocabulary grows with the corpus; compressed it looks small enough to be gathered on the driver."""
    found = query(frame(spark, [(i, f"abcdef abcdeg abcdefg bcdefg word{chr(97 + i)}x") for i in range(9)]), 2, 1)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()

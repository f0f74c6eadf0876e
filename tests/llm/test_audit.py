"""The filter audit against documents that are walked through all orders one by one."""

import re
from collections import defaultdict
from itertools import permutations

import duckdb

from tests.llm.texts import rows
from textquarry.llm import audit

SCHEMA = "doc_id long, Source string, source string, text string, part string"


def walked(data, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails, out = [], defaultdict(lambda: defaultdict(int))
    for i, source, text in data:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        f["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in data)
        fails.append((source or "", {k for k in f if f[k]}, i in good, i in toxic))
    shapley = defaultdict(int)
    for order in map("".join, permutations("ABCDE")):
        for part, f, g, t in fails:
            gone = False
            for step, k in enumerate(order, 1):
                row = out[part, order, step]
                row["kept"] += not gone and k not in f
                row["removed"] += not gone and k in f
                row["redundant"] += gone and k in f
                row["unique_fails"] += f == {k}
                row["good_lost"] += not gone and k in f and g
                row["toxic_lost"] += not gone and k in f and t
                shapley[part, k] += not gone and k in f
                gone |= k in f
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((*key, *(int(row[n]) for n in names), shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items())


def test_audit(spark):
    parts = ["a", "b", "", None]
    data = [(i, parts[k % 4], t) for k, (i, t) in enumerate(rows(n=30))]
    data += [(3000 + k, "a", t) for k, t in enumerate(["LOUD " * 60, "a#b", "x" * 40_000, "one two " * 40_000, "Ab c" * 70, data[5][2], data[5][2]])]
    labels = [(i, k % 3 % 2, k % 5 // 4) for k, (i, _, _) in enumerate(data) if k % 4] + [(None, 1, 1), (3, None, 1), (6, 1, None), (6, 0, 0), (9, None, None)]
    docs = spark.createDataFrame([(i, "no", s, t, "no") for i, s, t in data], SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    last = {}
    for i, q, t in labels:
        if i is not None:
            a, b = last.get(i, (0, 0))
            last[i] = (max(a, q or 0), max(b, t or 0))
    want = walked(data, [(i, q, t) for i, (q, t) in last.items()])
    assert sorted(map(tuple, audit.query(docs, marks).collect())) == want and len(want) == 3 * 600
    assert all(any(r[c] for r in want) for c in range(3, 10))
    assert audit.query(docs.limit(0), marks).collect() == [] and audit.query(docs, marks.limit(0)).count() == 1800


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(audit.ORACLE_SQL)
    names = [d[0] for d in found.description]
    got = audit.query(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())


def test_transform(spark):
    masks = [("p", k % 2, k % 3 // 2, k * k % 32) for k in range(200)]
    cells = audit.cells(audit.parities(spark.createDataFrame(masks, "part string, good int, toxic int, mask int"))).first()
    for m in range(32):
        own = [x for x in masks if x[3] == m]
        assert (cells.n[m], cells.good[m], cells.toxic[m]) == (len(own), sum(x[1] for x in own), sum(x[2] for x in own))

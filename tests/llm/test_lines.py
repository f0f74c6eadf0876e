"""Line deduplication against brute force."""

import hashlib
import time

from tests.llm.texts import frame, rows
from textquarry.llm.lines import dedup_lines, query


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def test_lines(spark):
    long = "This Line is Long enough to Count, É and all, so it may go"
    data = [(i, "\n".join([f"own {i} " * 9, f" {long}\r", "short", long.upper() if i % 2 else long])) for i in range(9)]
    data += [(i, t) for i, t in rows(n=6) if i != 1000] + [(50, "x" * 45 + "\n" + "x" * 45)] + [(51 + i, "x" * 45) for i in range(3)]
    data += [(70 + i, "\xa0" + "y" * 39) for i in range(5)] + [(90 + i, "\x1f" + "z" * 38) for i in range(6)]
    found = {}
    for i, t in data:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                found.setdefault(key(line), set()).add(i)
    found = {k: max(v) for k, v in found.items() if len(v) >= 5}
    want = []
    for i, t in data:
        ls = (t or "").split("\n")
        kept = [x for x in ls if key(x) not in found or found[key(x)] == i]
        want.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    got = sorted(map(tuple, query(frame(spark, data).repartition(3)).collect()), key=order)
    assert got == sorted(want, key=order) and any(r[2] for r in got)
    assert dedup_lines(frame(spark, [])).collect() == []
    plan = query(frame(spark, data))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_lost_lines(spark):
    """Six copies of some thousands of lines lose them in time in proportion."""
    seconds = {}
    for n in (2_000, 2_000, 32_000):
        text = "\n".join(f"line {i} that is long enough to count as one of them" for i in range(n))
        began = time.perf_counter()
        got = query(frame(spark, [(i, text) for i in range(6)])).collect()
        seconds[n] = time.perf_counter() - began
        assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in got) == [(i, n, n if i < 5 else 0) for i in range(6)]
    assert seconds[32_000] < 16 * seconds[2_000]

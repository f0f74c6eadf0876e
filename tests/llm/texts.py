"""Small texts with copies, shared passages, ties, empty and odd rows."""

import random

SCHEMA = "doc_id long, Text string, text string, chunk string, score double"


def rows(seed=7, n=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "é", "re", "ß"]) for _ in range(rnd.randint(1, 4)))
    passage = lambda k: " ".join(word() for _ in range(k))
    shared, common = passage(60), passage(25)
    out = []
    for i in range(n):
        parts = [passage(rnd.randint(0, 90))]
        if i % 3 == 0:
            parts.append(shared)
        if i % 2 == 0:
            parts.append(common)
        parts.append(passage(rnd.randint(0, 40)))
        out.append((i * 3, rnd.choice([" ", "\n", "\t "]).join(parts)))
    out += [(1000 + k, out[2][1]) for k in range(5)] + [(2000, "the a " * 300), (2001, ""), (2002, None), (2003, "x"), (2004, " \n "), (2005, "  \U0001f600 " * 80)]
    out += [(out[4][0], out[4][1]), (None, out[6][1]), (None, None)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, "other", t, "c", 0.5) for i, t in data], SCHEMA)

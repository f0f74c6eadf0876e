"""The network's gradients against differences, and held-out accuracy."""

import numpy as np

from textquarry.llm import langid


def test_gradients():
    net = langid.Network(["a", "b", "c"], h=3)
    for d in (net.ahead, net.back):
        d.p = {k: v.astype(np.float64) for k, v in d.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = net.gradients(x, y)
    for p, g in zip(net.parameters(), grads):
        places = [tuple(int(rng.integers(0, n)) for n in p.shape) for _ in range(3)]
        if p.shape[0] == 256:
            places = [(int(x[t, 0]), int(rng.integers(0, p.shape[1]))) for t in (0, 3, 6)]
        for at in places:
            old, eps = p[at], 1e-2
            p[at] = old + eps
            up = net.gradients(x, y)[0]
            p[at] = old - eps
            down = net.gradients(x, y)[0]
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-3 + 0.05 * abs(g[at])


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "12 %% 3", "en", "s", 0), (None, "the of and to", None, "s", 0), (-5, "é", "fr", "s", 1)], docs.schema)
    docs = docs.unionAll(odd)
    got = [r.asDict() for r in langid.query(docs).collect()]
    assert len(got) == docs.count()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] >= 0]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {-1, -2, -3}
    assert langid.identify(docs, None).filter("lang_pred <> 'und'").count() == 0
    assert langid.query(docs.limit(0)).collect() == []


def test_many_languages(spark):
    # more labels than any cap that was there before; null labels and texts without letters teach nothing
    docs = spark.createDataFrame([(i, f"word{i % 300} of its own " * 3, f"l{i % 300:03d}") for i in range(1500)] + [(9000, "12", "none"), (9001, "abc", None), (9002, None, "none")], "doc_id long, text string, lang string")
    net = langid.fit(docs, per_label=3, steps=3)
    assert net.languages == [f"l{i:03d}" for i in range(300)] and net.ahead.h == 48
    assert langid.fit(docs.filter("lang = 'l001'")) == "l001" and langid.fit(docs.filter("lang = 'none'")) is None


def test_predict_as_a_plain_loop():
    rnd = np.random.default_rng(4)
    net = langid.Network(["a", "b", "c"], h=3)
    texts = ["".join(chr(rnd.choice([97, 98, 233, 32, 0x4E2D])) for _ in range(n)) for n in (1, 63, 64, 65, 500)] + ["", None, "12 %", "é"]

    def unit(d, x):
        state, out = np.zeros(d.h), []
        sigmoid = lambda v: 1 / (1 + np.exp(-v))
        for byte in x:
            a, u = d.p["E"][byte].astype(float), state @ d.p["U"].astype(float)
            z, r = sigmoid(a[: d.h] + u[: d.h]), sigmoid(a[d.h : 2 * d.h] + u[d.h : 2 * d.h])
            n = np.tanh(a[2 * d.h :] + r * (u[2 * d.h :] + d.p["c"]))
            state = n + z * (state - n)
            out.append(state)
        return out

    for text, (lang, score) in zip(texts, langid.predict(net, texts)):
        if not text or not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0)
            continue
        raw, total = text.encode(), np.zeros(3)
        for lo in range(0, len(raw), langid.SPAN):
            part = raw[lo : lo + langid.SPAN] + b"\0" * max(0, lo + langid.SPAN - len(raw))
            ahead, back = unit(net.ahead, part), unit(net.back, part[::-1])[::-1]
            for k in range(min(langid.SPAN, len(raw) - lo)):
                p = np.exp(np.concatenate([ahead[k], back[k]]) @ net.out["W"] + net.out["b"])
                total += p / p.sum()
        assert lang == net.languages[int(total.argmax())] and abs(score - total.max() / len(raw)) < 1e-4


def test_clashing_columns_repeats_and_long_texts(spark):
    long = "the of and to in is " * 30_000
    rows = [(1, long, "en", "x"), (1, long, "en", "x"), (3, "el la de que y los " * 9, "es", "y"), (4, None, "es", "z"), (5, long, "en", "q")] + [(10 + i, "le la des que est un " * 20, "fr", "w") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Text string")
    got = langid.query(docs).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (1, 5)} == {"en"}

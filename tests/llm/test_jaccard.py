"""Near copies by five-word Jaccard against brute force over all pairs."""

import random

import corpus_pipeline as cp
from textquarry.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(texts, similar=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= similar * len(a | sets[j]) > 0:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def split_by(values):
    out = {}
    for i, v in enumerate(values):
        out.setdefault(v, set()).add(i)
    return sorted(map(sorted, out.values()))


def varied(seed=3):
    rnd = random.Random(seed)
    words = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    texts = [None, "", " \n", "one two", "one  Two", "three"]
    for k in range(60):  # single words changed: five shingles each
        base = words(rnd.randint(60, 300))
        texts.append(" ".join(base))
        for _ in range(2):
            other = list(base)
            for at in rnd.sample(range(len(other)), rnd.randint(1, max(1, len(other) // 30))):
                other[at] = "changed"
            texts.append("\t".join(other))
    return texts


def test_groups(spark):
    texts = varied()
    got = jaccard.near_copies(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)).collect()
    want = split_by(groups(texts))
    assert split_by([r.group for r in sorted(got, key=lambda r: r.doc_id)]) == want and len(want) < len(texts) - 40


def test_large_keys(spark, monkeypatch):
    # many variants of one text, some of them too far from all others, meet at the same keys
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "MORE", 2)
    rnd, texts = random.Random(4), []
    base = [f"b{k}" for k in range(200)]
    for k in range(60):
        far = k % 3 == 0
        texts.append(" ".join(base[: 120 if far else 195] + [f"x{rnd.randrange(10**6)}" for _ in range(60 if far else 8)]))
    got = jaccard.near_copies(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()
    want = split_by(groups(texts))
    assert split_by([r.group for r in sorted(got, key=lambda r: r.doc_id)]) == want and len(want) == 21


def test_stage_drops_near_copies(spark):
    # Jaccard 0.81 to 0.9; their SimHashes of four words differ in more than 4 bits
    base = [f"n{k * 7919 % 1000}" for k in range(200)]
    near = [*base[:50], "x", *base[51:120], "y", *base[121:170], "z", *base[171:]]
    far = [w if k % 5 else f"far{k}" for k, w in enumerate(base)]
    docs = spark.createDataFrame([(3, " ".join(base), "en", "s", 0), (5, " ".join(near), "en", "s", 0), (4, " ".join(far), "en", "s", 0)], SCHEMA)
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()) == [3, 4]


def test_one_row_of_each_group(spark):
    # one doc_id with texts of two groups; a group without doc_ids
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    data = [(1, a), (2, a + " end"), (1, b), (3, b + " end"), (None, c), (None, c + " end"), (None, c), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)
    got = [(r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (None, "")], key=str)


def test_one_key_of_many(spark):
    """20 000 different nodes of one key: no row holds many of them, the first round makes few pairs, and all pairs are reached."""
    from pyspark.sql import functions as F

    n = 20_000
    members = spark.range(n).select(F.lit(5).cast("long").alias("key"), (F.col("id") * 7 - 3).alias("node"), F.lit(100).cast("long").alias("size"), (F.col("id") * 7 - 3).alias("group"))
    apart = jaccard._apart(members)
    assert (apart.first().n, apart.first().most) == (n, 1)
    for pivots in (jaccard.PIVOTS, 4000):
        rows = jaccard._dealt(members, apart, pivots)
        held = rows.select(F.size(F.filter("nodes", lambda r: ~r["pivot"])).alias("n"), F.size(F.filter("nodes", lambda r: r["pivot"])).alias("p"))
        most = held.agg(F.max("n"), F.max("p"), F.sum(F.col("n") * F.col("p"))).first()
        assert most[0] < 1.2 * jaccard.BLOCK and most[1] < 1.2 * jaccard.BLOCK and most[2] < 1.2 * (pivots + 10) * n
    few = members.filter("node < 2000").withColumn("group", F.pmod("node", F.lit(2)))
    got = jaccard._dealt(few, jaccard._apart(few), 10**6).mapInArrow(jaccard._meet, "u long, v long").distinct()
    nodes = [r.node for r in few.collect()]
    assert got.count() == sum(a % 2 != b % 2 for a in nodes for b in nodes if a > b)


def test_simhash_links_first(spark, monkeypatch):
    """Copies that SimHash links leave no pair to the minima; equal fingerprints of unlike sets are no link."""
    long = [f"n{k * 7919 % 3001}" for k in range(3000)]
    near = [" ".join([*long[:at], "x", *long[at + 1 :]]) for at in range(100, 700, 100)]
    # the more frequent part decides all bits, whatever the rest holds
    unlike = [" ".join(["a b c d e f g"] * 50 + [f"{t}{k}" for k in range(20)]) for t in "xy"]
    texts = [" ".join(long), *near, *unlike]
    fp = jaccard.prints(jaccard.pa.array(texts)).tolist()
    assert all((a ^ fp[0]).bit_count() <= 4 for a in fp[1:7]) and fp[7] == fp[8]
    made, dealt = [], jaccard._dealt

    def seen(members, apart, pivots):
        out = dealt(members, apart, pivots)
        made.append(out.mapInArrow(jaccard._meet, "u long, v long").count())
        return out

    monkeypatch.setattr(jaccard, "_dealt", seen)
    got = jaccard.near_copies(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()
    want = split_by(groups(texts))
    assert split_by([r.group for r in sorted(got, key=lambda r: r.doc_id)]) == want == [list(range(7)), [7], [8]] and sum(made) == 0


def test_pairs_of_a_family_are_few(spark, monkeypatch):
    """300 variants of one text that stay below 0.8 of each other, and pairs of them above it: pairs made are few, links all there."""
    rnd, texts, made, dealt = random.Random(5), [], [], jaccard._dealt
    base = [f"b{k}" for k in range(100)]
    for _ in range(150):
        own = list(base)
        for at in rnd.sample(range(100), 3):
            own[at] = f"x{rnd.randrange(10**6)}"
        texts += [" ".join(own), " ".join([*own, "end"])]

    def seen(members, apart, pivots):
        out = dealt(members, apart, pivots)
        made.append(out.mapInArrow(jaccard._meet, "u long, v long").count())
        return out

    monkeypatch.setattr(jaccard, "_dealt", seen)
    got = jaccard.near_copies(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()
    want = split_by(groups(texts))
    assert split_by([r.group for r in sorted(got, key=lambda r: r.doc_id)]) == want and len(want) > 100 and sum(made) < 20 * len(texts)


def test_parities_bound_from_below():
    rnd = jaccard.np.random.default_rng(6)
    for n in (1, 30, 400, 5000):
        a = jaccard.np.unique(rnd.integers(0, 1 << 64, n, dtype=jaccard.np.uint64))
        b = jaccard.np.unique(jaccard.np.concatenate([a[n // 9 :], rnd.integers(0, 1 << 64, n // 10, dtype=jaccard.np.uint64)]))
        x, y = jaccard.parities([a, b]).view(jaccard.np.uint64)
        differ = len(jaccard.np.setxor1d(a, b))
        assert int(jaccard.np.bitwise_count(x ^ y).sum()) <= differ
        met = list(jaccard.meetings(jaccard.np.array([1, 2]), jaccard.np.array([len(a), len(b)]), jaccard.np.array([1, 2]), jaccard.np.array([True, False]), jaccard.np.stack([x, y])))
        assert sum(map(len, met)) == 1 or differ > (len(a) + len(b)) / 9

"""Planted benchmark questions, re-parameterised ones, and texts that only share a template."""

import random

from tests.llm.texts import frame, rows
from textquarry.llm import decontam
from textquarry.llm.decontam import canonical, consistent, query

ITEM = "A train leaves the old town at 12 km per hour and after 30 minutes meets Anna who walks 12 km with Bernard before Anna turns back home for 30 minutes of rest."


def test_canonical():
    assert [canonical(w)[1] for w in ("12", "3.5kg,", "Seven", "km", "Anna,", "USA", "Été.", "don't", "--")] == ["<number>", "<number>", "<number>", "<unit>", "<name>", "usa", "<name>", "don't", "--"]
    assert consistent([]) == 1 and consistent([("1", "2"), ("1", "2"), ("3", "4")]) == 1 and consistent([("1", "2"), ("1", "3")]) == 0.5


def test_leaks(spark):
    rnd = random.Random(2)
    noise = lambda n: " ".join(rnd.choice(["ro", "lan", "ti", "be"]) + str(rnd.choice("xyz")) for _ in range(n))
    changed = ITEM.replace("12", "45").replace("30", "8").replace("Anna", "Maria").replace("Bernard", "Karl")
    mixed = "A train leaves the old town at 1 km per hour and after 2 minutes meets Otto who walks 3 km with Karl before Paul turns back home for 4 minutes of rest."
    data = [(1, noise(200)), (2, noise(50) + " " + ITEM + " " + noise(3000)), (3, noise(40) + ". " + changed.upper().lower().replace("maria", "Maria").replace("karl", "Karl") + noise(5))]
    data += [(4, noise(30) + " " + mixed), (5, ITEM[:60] + noise(20)), (6, None), (7, ""), (None, ITEM), (2, "x " + ITEM), (8, "short one"), (9, "a short one only"), (10, ITEM + " " + ITEM)]
    bench = spark.createDataFrame([(0, ITEM, "x"), (0, ITEM, "y"), (1, None, "x"), (2, "", "x"), (3, "short one", "x"), (None, noise(12), "z")], "item_id long, text string, doc_id string")
    got = query(frame(spark, data).repartition(3), bench).collect()
    found = sorted(((r.doc_id or -1), r.item_id) for r in got)
    assert found == [(-1, 0), (2, 0), (2, 0), (3, 0), (8, 3), (9, 3), (10, 0)]
    assert all(0.8 <= r.n_windows / r.n_item_windows <= 1 and r.slot_share >= 0.8 for r in got)
    assert next(r for r in got if r.doc_id == 2 and r.word > 1).word == 50
    assert query(frame(spark, []), bench).collect() == [] and query(frame(spark, data), bench.limit(0)).collect() == []


def test_shuffled_join_agrees(spark, monkeypatch):
    docs, bench = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    whole = sorted(map(tuple, query(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 0)
    assert sorted(map(tuple, query(docs, bench).collect())) == whole
    # brute force: items that stand in the texts as they are, but for white space
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    literal = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if " ".join(r.text.split()) in t}
    assert literal <= {r[:2] for r in whole} and len(whole) <= len(literal) + 3


def test_odd_texts(spark):
    bench = spark.createDataFrame([(1, "nothing like it in the texts at all")], "item_id long, text string")
    assert query(frame(spark, rows()), bench).collect() == []


LIST = "Compute the sums of the following pairs of numbers: 3 + 5 , 17 + 29 , 11 + 13 , 41 + 2 , 8 + 19 , 23 + 31 ."


def test_items_that_repeat_a_window(spark):
    split = LIST.replace("11 + 13", "11 + 13 , 50 + 60")  # a pair put in
    changed = LIST
    for old, new in zip((" 3 ", " 5 ", "17", "29", "11", "13", "41", " 2 ", " 8 ", "19", "23", "31"), (" 61 ", " 62 ", "63", "64", "65", "66", "67", " 68 ", " 69 ", "70", "71", "72")):
        changed = changed.replace(old, new, 1)
    same = LIST[: LIST.index("3 +")] + " , ".join(["7 + 7"] * 6) + " ."  # one value for all: no replacement one for one
    data = [(1, LIST), (2, "some words before it. " + LIST + " and after"), (3, split), (4, changed), (5, same), (6, LIST + " " + LIST)]
    got = query(frame(spark, data), spark.createDataFrame([(0, LIST)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 6]
    assert all(r.slot_share >= 0.8 for r in got) and next(r for r in got if r.doc_id == 1).slot_share == 1


TOM = "Tom has 12 apples and 4 pears. Tom gives 3 apples to his sister. Tom then buys 5 more at the market. How many apples does Tom have now?"
TWO = "Tom has 9 red apples. Max has 4 green pears. Max eats two of them. Tom ran off. Max sat down."


def test_names_that_open_sentences(spark):
    data = [(1, TOM), (2, TOM.replace("Tom", "Max")), (3, "so then " + TOM.replace("Tom", "Anna").replace("12", "7")), (4, "it says: " + TOM.lower().replace("tom", "Max"))]
    data += [(5, TOM.replace("Tom", "Max", 1).replace("Tom then", "Otto then")), (6, TWO.replace("Tom", "Eva").replace("Max", "Lea")), (7, "Joe has 9 red apples. " * 8), (8, TWO.replace("Tom", "Eva").replace("Max", "Eva"))]
    bench = spark.createDataFrame([(0, TOM), (1, TWO)], "item_id long, text string")
    got = query(frame(spark, data), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 0), (2, 0), (3, 0), (4, 0), (6, 1)]
    assert all(r.n_windows <= r.n_item_windows for r in got)


MIXED = "A train leaves the old town at 1 km per hour and after 2 minutes meets Otto who walks 3 km with Karl before Paul turns back home for 4 minutes of rest."


def test_copies_beside_mixed_ones_and_in_other_casing(spark):
    cut = " ".join(ITEM.split()[:-3])
    data = [(1, cut), (2, MIXED + " " + cut), (3, cut + " " + MIXED), (4, MIXED), (5, MIXED + " " + MIXED), (6, ITEM.lower()), (7, ITEM.upper()), (8, ITEM.title()), (9, MIXED + " " + cut + " " + MIXED)]
    got = query(frame(spark, data), spark.createDataFrame([(0, ITEM)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 6, 7, 8, 9]
    assert {r.doc_id: r.word for r in got}[2] == len(MIXED.split())


def readings(words, every):
    """The tokens of a text: as they are compared first, and in all other ways to read its names."""
    tokens, opens, start = [canonical(w) for w in words], [], True
    for w, (kind, _, _) in zip(words, tokens):
        opens.append(start and kind == decontam.NAME)
        start = w.rstrip(decontam.CLOSING)[-1:] in decontam.STOPS
    names = [kind == decontam.NAME for kind, _, _ in tokens]
    as_read = lambda by_value: [v if b else t for (_, t, v), b in zip(tokens, by_value)]
    ways = [opens, [False] * len(words), names]
    if every:
        turn = [sum(opens[: i + 1]) % 2 for i in range(len(words))]
        ways += [[o and t == k for o, t in zip(opens, turn)] for k in (0, 1)]
    return tokens, opens, [as_read(w) for w in ways]


def holds(text, item, window=5, similar=0.8):
    """Whether any span of the text is a consistent copy of the item, over all pairs of places."""
    doc, own = text.split(), item.split()
    n = min(window, len(own))
    (dt, do, dr), (it, io, ir) = readings(doc, False), readings(own, True)
    total = {tuple(ir[0][k : k + n]) for k in range(len(own) - n + 1)}
    hits = []
    for q in range(len(doc) - n + 1):
        for k in range(len(own) - n + 1):
            if {tuple(r[q : q + n]) for r in dr} & {tuple(r[k : k + n]) for r in ir}:
                hits.append((q, k))
    places = sorted({q for q, _ in hits})
    on = [{q - k for q, k in hits if q == p} for p in places]
    turns = [i for i in range(1, len(places)) if not on[i] & on[i - 1]]
    reach = len(own) * 3 // 2 + window
    for j in [*turns, len(places)]:
        b = places[j - 1] if places else 0
        near = [p for p in places if 0 <= b - p <= reach]
        for a in [*near[:1], *(places[i] for i in turns if i < j and places[i] in near)]:
            span = [(q, k) for q, k in hits if a <= q <= b]
            if min(len({tuple(ir[0][k : k + n]) for _, k in span}), len({tuple(dr[2][q : q + n]) for q, _ in span})) < similar * len(total):
                continue
            support = {}
            for q, k in span:
                support[q - k] = support.get(q - k, 0) + 1
            for way in (0, 1):
                chosen = {}
                for q, k in span:
                    slots = [d for d in range(n) if it[k + d][0] == dt[q + d][0] != decontam.PLAIN]
                    equal = sum(it[k + d][2] == dt[q + d][2] for d in slots)
                    rank = (support[q - k], equal) if way == 0 else (equal, support[q - k])
                    for d in slots:
                        if q + d not in chosen or rank > chosen[q + d][0]:
                            chosen[q + d] = rank, k + d
                pairs = [(it[k][2], dt[q][2], io[k] and do[q]) for q, (_, k) in chosen.items()]
                sure = {v for x, y, o in pairs if not o or x != y for v in (x, y)}
                if consistent([(x, y) for x, y, o in pairs if not o or x != y or x in sure]) >= similar:
                    return True
    return False


def test_brute_force(spark):
    rnd = random.Random(11)
    plain, names = ["walks", "red", "over", "hill", "gives", "them", "back", "then", "sees"], ["Anna", "Karl", "Otto", "Eva"]

    def passage(n):
        out = [rnd.choice(plain) if rnd.random() < 0.6 else rnd.choice([*names, "3", "12", "7", "km", "kg"]) for _ in range(n)]
        return [w + "." if rnd.random() < 0.1 else w for w in out]

    def changed(words, p):
        to = dict(zip(names, rnd.sample(names, 4))) | {"3": "40", "12": "41", "7": "42"}
        out = []
        for w in words:
            end = "." if w.endswith(".") else ""
            core = w.rstrip(".")
            core = to.get(core, core) if p < 1 else rnd.choice([*to]) if core in to else core
            out.append(core + end)
        return out

    items = [" ".join(passage(rnd.randint(3, 24))) for _ in range(8)]
    data = []
    for i in range(160):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            words = rnd.choice(items).split()
            words = changed(words, rnd.choice([0, 1])) if rnd.random() < 0.7 else words
            lo, hi = rnd.choice([(0, len(words)), (0, max(1, len(words) - 3)), (2, len(words))])
            parts += words[lo:hi] + passage(rnd.choice([0, 0, 2, 9]))
        text = " ".join(parts)
        data.append((i, rnd.choice([text, text, text.lower(), text.upper()])))
    got = query(frame(spark, data).repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    want = {(i, k) for i, t in data for k, item in enumerate(items) if holds(t, item)}
    assert len(want) > 60 and found == want


def test_copies_among_more_of_the_same(spark):
    """Literal and re-parameterised copies with more values of the same template before, after and on both sides."""
    rnd = random.Random(11)
    pairs = lambda n: " , ".join(f"{rnd.randrange(100)} + {rnd.randrange(100)}" for _ in range(n))
    numbers = lambda n: " , ".join(str(rnd.randrange(5000)) for _ in range(n))
    sums = "Compute 3 + 5 , 17 + 29 , 11 + 13 , 41 + 2 , 8 + 19 , 23 + 31 , 7 + 44"
    series = "Continue the sequence : " + " , ".join(str(2**k) for k in range(1, 11))
    plain = numbers(20)
    items, more = [sums, series, plain], [pairs, numbers, numbers]
    changed = ["Compute " + pairs(7), "Continue the sequence : " + " , ".join(str(3000 + 7 * k) for k in range(10))]
    data, want = [], set()
    for k, (item, noise) in enumerate(zip(items, more)):
        for text in (item, changed[k] if k < 2 else item):
            for form in (f"{text} , {noise(60)}", f"{noise(60)} , {text}", f"{noise(60)} , {text} , {noise(60)}", f"so it is {text} and that is all"):
                want.add((len(data), k))
                data.append((len(data), form))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in query(frame(spark, data), bench).collect()}
    assert want <= got


def test_long_lists_in_bounded_time():
    """A page of numbers against a long list: no consistent copy, many windows alike."""
    import time

    import pyarrow as pa

    rnd = random.Random(12)
    numbers = lambda n: " , ".join(str(rnd.randrange(50)) for _ in range(n))
    index = decontam.Index([(0, "List all of these : " + numbers(60))], 5)
    began = time.perf_counter()
    decontam.found_in(pa.array(["List all of these : " + numbers(400)]), index, decontam.Words(), 5, 0.8)
    assert time.perf_counter() - began < 20

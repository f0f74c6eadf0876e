"""Benchmark decontamination by template canonicalisation.

Words become canonical tokens: numbers, units and names turn into typed placeholders, all else is lower-cased
and loses punctuation at its ends. Windows of ``WINDOW`` canonical tokens are hashed and joined with those of
the benchmark. A document is reported for an item if some span of it holds at least ``SIMILAR`` of the
item's different windows close together, and if the values that fill the item's placeholders are replaced consistently: one
value by one value in at least ``SIMILAR`` of the slots, either way. Every span is judged, and the consistent one
with most windows is reported. Where equal windows recur in an item, each
place of the document is held against one of them: that on the commonest diagonal, or that with most equal values.
So a question whose numbers or names were
changed throughout is caught, and one that shares a template but mixes up its slots is not. A capitalised word is
also read by its value, so that a copy in other casing is found as well.

A benchmark of at most ``BLOCK_WINDOWS`` windows goes to the executors whole, so what is broadcast is bounded, and is
held against all documents without a shuffle. Beyond that, windows meet in a shuffled join: a document that holds
``SIMILAR`` of an item's windows holds one of any ``1 - SIMILAR`` of them and one more, so each item is looked for
by that many of its rarest windows, and the documents found are judged as above.

Contract: null and empty texts hold nothing; an item of fewer words than a window is one window of its own
length; an item without words is never found. Repeated rows of documents are reported each; repeated items
once. Null ids are kept. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm._shared import pick, tidy, written
from textquarry.llm._words import split_words
from textquarry.llm.substrings import MULT, rolling

WINDOW, SIMILAR = 5, 0.8
BLOCK_WINDOWS = 1 << 20
CACHE_WORDS = 1 << 19
PLAIN, NUMBER, UNIT, NAME = range(4)

NUMBERS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split())
UNITS = set("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent mph kmh kph degree degrees".split())
NUMBER_LIKE = re.compile(r"[$€£]?[-+]?\d[\d.,:/]*(?:[a-z%°]{1,4})?")
STOPS, CLOSING = ".!?:", "\"')]»”"
EDGES = re.compile(r"^\W+|[^\w%]+$")


def canonical(word: str) -> tuple[int, str, str]:
    """(kind, canonical token, value) of a word inside a sentence."""
    plain = word.rstrip(".,;:!?")
    if plain.isalpha() and plain.islower() and plain not in NUMBERS and plain not in UNITS:  # most words
        return PLAIN, plain, plain
    bare = EDGES.sub("", word) or word
    low = bare.lower()
    if NUMBER_LIKE.fullmatch(low) or low in NUMBERS:
        return NUMBER, "<number>", low
    if low in UNITS:
        return UNIT, "<unit>", low
    if bare[:1].isupper() and bare[1:].islower():
        return NAME, "<name>", low
    return PLAIN, low, low


class Words(dict):
    """Raw word → its number; for each number the value, kind, hashes inside a sentence and at its start, and whether it ends one."""

    TYPES = (np.uint8, np.uint64, np.uint64, bool)

    def __init__(self):
        super().__init__()
        self.raw, self.new = [], []
        self.columns = [np.zeros(0, t) for t in self.TYPES]

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace")
        kind, token, value = canonical(word)
        inside = xxhash.xxh64_intdigest(token)
        self.raw.append(value)
        self.new.append((kind, inside, xxhash.xxh64_intdigest(value) if kind == NAME else inside, word.rstrip(CLOSING)[-1:] in STOPS))
        n = len(self)
        self[raw] = n
        return n

    def arrays(self) -> list[np.ndarray]:
        if self.new:
            self.columns = [np.concatenate([c, np.array(x, t)]) for c, x, t in zip(self.columns, zip(*self.new), self.TYPES)]
            self.new = []
        return self.columns


class Text:
    """Canonical tokens of some texts, one after another."""

    def __init__(self, texts: pa.Array, words: Words):
        index, self.count, distinct = split_words(texts)
        self.begin = np.cumsum(self.count) - self.count
        ids = np.fromiter(map(words.__getitem__, distinct), np.int64, len(distinct))[index]
        kind, inside, start, ends = words.arrays()
        first = np.zeros(len(ids), bool)
        if len(ids):
            first[1:] = ends[ids[:-1]]
            first[self.begin[self.count > 0]] = True
        self.kind, self.ids = kind[ids], ids
        self.opens = first & (self.kind == NAME)  # a name, or a word that only opens a sentence
        self.word, self.hash = start[ids], inside[ids]
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.left = self.count[self.doc] - (np.arange(len(ids)) - self.begin[self.doc])

    def windows(self, n: int, mixed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, place, plain, literal) of the windows of n tokens.

        plain is the hash with words that open sentences by value, literal that with all names by value. A window with
        names comes once for each way to read it: plain, literal, and all as names. mixed: also with every other opening word as a name.
        """
        at = np.flatnonzero(self.left[: max(0, len(self.ids) - n + 1)] >= n)
        plain = self.read(self.opens, n)[at]
        if not len(at):
            return plain, at, plain, plain
        names = self.kind == NAME
        held = np.cumsum(np.append(0, names))
        some = np.flatnonzero(held[at + n] > held[at])  # windows with names
        literal = plain.copy()
        literal[some] = self.read(names, n)[at[some]]
        readings = [np.zeros(len(names), bool)]
        if mixed:
            turn = np.cumsum(self.opens) % 2
            readings += [self.opens & (turn == k) for k in (0, 1)]
        out, before = [(plain, at, plain, literal)], [plain[some]]
        for h in (literal[some], *(self.read(by_value, n)[at[some]] for by_value in readings)):
            new = np.logical_and.reduce([h != x for x in before])
            before.append(h)
            out.append((h[new], at[some][new], plain[some][new], literal[some][new]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def read(self, by_value: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all windows of n tokens, the marked ones by value."""
        return rolling(np.where(by_value, self.word, self.hash), n, MULT[0]) ^ np.uint64(n)

    def own_windows(self, window: int):
        """n and (hash, place, plain) of the windows by which texts are looked for: of shorter texts the whole."""
        for n in range(1, window + 1):
            h, at, plain, _ = self.windows(n, mixed=True)
            own = (self.count[self.doc[at]] >= window) if n == window else (self.count[self.doc[at]] == n)
            if own.any():
                yield n, h[own], at[own], plain[own]


class Index:
    """Windows of some benchmark items, for a broadcast."""

    def __init__(self, items: list[tuple[int | None, str]], window: int):
        words = Words()
        text = Text(pa.array([t for _, t in items], pa.string()), words)
        self.ids = [i for i, _ in items]
        hashes, owners, places, plains = [], [], [], []
        self.sizes = set()
        for n, h, at, plain in text.own_windows(window):
            self.sizes.add(n)
            hashes.append(h)
            owners.append(text.doc[at])
            places.append(at - text.begin[text.doc[at]])
            plains.append(plain)
        empty = np.zeros(0, np.int64)
        none = empty.astype(np.uint64)
        h, owner, place, plain = np.concatenate([*hashes, none]), np.concatenate([*owners, empty]), np.concatenate([*places, empty]), np.concatenate([*plains, none])
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place, self.plain = h[order], owner[order], place[order], plain[order]
        self.total = [len(np.unique(plain[owner == k])) for k in range(len(items))]
        self.length = text.count
        self.kinds = [text.kind[b : b + n] for b, n in zip(text.begin, text.count)]
        self.opens = [text.opens[b : b + n] for b, n in zip(text.begin, text.count)]
        self.values = [[words.raw[k] for k in text.ids[b : b + n].tolist()] for b, n in zip(text.begin, text.count)]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hash & np.uint64((1 << 22) - 1)).astype(np.int64)] = True


def consistent(pairs: list[tuple[str, str]]) -> float:
    """The share of slots whose values are replaced one for one, the worse of both directions."""
    if not pairs:
        return 1.0
    shares = []
    for a, b in ((0, 1), (1, 0)):
        to = defaultdict(Counter)
        for p in pairs:
            to[p[a]][p[b]] += 1
        shares.append(sum(max(c.values()) for c in to.values()) / len(pairs))
    return min(shares)


def _slots(index: Index, item: int, window: int, hits: list[tuple[int, int, int, int]], text: Text, words: Words) -> list[list[tuple[str, str]]]:
    """The pairs of values of one span's slots, once for each way to give its document tokens one item token each.

    Equal windows may recur in the item. One way takes the place on the diagonal that most hits of the span are on,
    the other the place with most equal values, which finds copies with parts put in or moved. A word that opens
    a sentence on both sides and is the same is a slot only if it is a value elsewhere: few of them are names.
    """
    kinds, values = index.kinds[item], index.values[item]
    support = Counter(q - k for q, k in {(q, k) for q, k, _, _ in hits})
    width = min(window, int(index.length[item]))
    ways: list[dict[int, tuple]] = [{}, {}]  # document token → rank and item token
    for q, k, _, _ in hits:
        slots = [d for d in range(width) if kinds[k + d] == text.kind[q + d] != PLAIN]
        equal = sum(values[k + d] == words.raw[text.ids[q + d]] for d in slots)
        for chosen, rank in zip(ways, ((support[q - k], equal), (equal, support[q - k]))):
            for d in slots:
                if q + d not in chosen or rank > chosen[q + d][0]:
                    chosen[q + d] = rank, k + d
    out = []
    for chosen in ways:
        pairs = [(values[k], words.raw[text.ids[q]], index.opens[item][k] and text.opens[q]) for q, (_, k) in chosen.items()]
        sure = {v for a, b, opens in pairs if not opens or a != b for v in (a, b)}
        out.append([(a, b) for a, b, opens in pairs if not opens or a != b or a in sure])
    return out


class Slots:
    """Pairs of values with the share that is replaced one for one, kept up as pairs are added."""

    def __init__(self):
        self.n, self.counts, self.most, self.sums = 0, (Counter(), Counter()), (Counter(), Counter()), [0, 0]

    def add(self, a: str, b: str) -> None:
        self.n += 1
        for way, (x, y) in enumerate(((a, b), (b, a))):
            self.counts[way][x, y] += 1
            if self.counts[way][x, y] > self.most[way][x]:
                self.most[way][x] += 1
                self.sums[way] += 1

    def share(self) -> float:
        return min(self.sums) / self.n if self.n else 1.0


def _along(index: Index, item: int, window: int, hits: list[tuple[int, int, int, int]], text: Text, words: Words, similar: float, best: tuple) -> tuple:
    """The best of all spans that are read along one alignment: it begins at the first hit of any diagonal, each document
    place is held against the item's place on the diagonal at hand, or the nearest one, and it may end wherever the
    diagonal at hand has its last hit in reach.

    So values beside a copy don't matter, on either side, whatever windows they share with the item, and slots that are
    mixed up can't be cut off, as a diagonal is taken whole. Counts are kept up from place to place; a span's slots are
    judged whole only where it would be the best.
    """
    kinds, values, opens = index.kinds[item], index.values[item], index.opens[item]
    least, reach, width = similar * index.total[item], int(index.length[item] * 3 // 2) + window, min(window, int(index.length[item]))
    at, opened, closed = defaultdict(list), {}, {}
    for hit in hits:
        at[hit[0]].append(hit)
        opened.setdefault(hit[0] - hit[1], hit[0])
        closed[hit[0] - hit[1]] = hit[0]
    places = sorted(at)
    held, to, bounds = Counter(), 0, []  # how many of the item's windows lie in reach of each place
    for q in places:
        while to < len(places) and places[to] - q <= reach:
            held.update({h[2] for h in at[places[to]]})
            to += 1
        bounds.append(len(held))
        for h in {h[2] for h in at[q]}:
            held[h] -= 1
            if not held[h]:
                del held[h]
    for i, (q0, bound) in enumerate(zip(places, bounds)):
        for _, k0, _, _ in at[q0] if bound >= least else ():
            if bound <= best[0]:
                break
            if opened[q0 - k0] != q0:
                continue
            diagonal, plains, literals, taken = q0 - k0, set(), set(), {}
            sure, all_ = Slots(), Slots()
            for q in places[i:]:
                if q - q0 > reach:
                    break
                plains.update(h[2] for h in at[q])
                literals.update(h[3] for h in at[q])
                _, k, _, _ = min(at[q], key=lambda h: (abs(h[0] - h[1] - diagonal), h[1]))
                diagonal = q - k
                for d in range(width):
                    if q + d not in taken and kinds[k + d] != PLAIN:
                        a, b = values[k + d], words.raw[text.ids[q + d]]
                        taken[q + d] = a, b, bool(opens[k + d] and text.opens[q + d])
                        all_.add(a, b)
                        if a != b or not taken[q + d][2]:
                            sure.add(a, b)
                n_windows = min(len(plains), len(literals))
                if closed[diagonal] == q and n_windows >= least and n_windows > best[0] and max(sure.share(), all_.share()) >= similar:
                    named = {v for a, b, o in taken.values() if not o or a != b for v in (a, b)}
                    pairs = [(a, b) for a, b, o in taken.values() if not o or a != b or a in named]
                    if consistent(pairs) >= similar:
                        best = n_windows, q0, len(pairs), consistent(pairs)
    return best


def _judge(index: Index, item: int, window: int, hits: list[tuple[int, int, int, int]], text: Text, words: Words, similar: float):
    """hits: (place in the document's tokens, place in the item, the item's plain and the document's literal hash), in order.

    As a name may stand for several, a window of the document counts for one of the item's, whichever it equals.
    Spans begin and end where hits leave the diagonals of those before them, so that what stands beside a copy
    doesn't spoil it, and slots that are mixed up can't be cut off; and they begin at the first hit in reach. Where such
    a span has not all of the item, all others are looked at along one alignment each.
    """
    least, reach = similar * index.total[item], int(index.length[item] * 3 // 2) + window
    first = [i for i in range(len(hits)) if not i or hits[i][0] != hits[i - 1][0]]  # of each place
    diagonals = [{q - k for q, k, _, _ in hits[i:j]} for i, j in zip(first, [*first[1:], len(hits)])]
    breaks = [i for i, a, b in zip(first[1:], diagonals, diagonals[1:]) if not a & b]
    best, lo = (0, 0, 0, 0.0), 0
    for end in [*breaks, len(hits)]:
        while hits[end - 1][0] - hits[lo][0] > reach:
            lo += 1
        for begin in [lo, *(i for i in breaks if lo < i < end)]:
            span = hits[begin:end]
            n_windows = min(len({h[2] for h in span}), len({h[3] for h in span}))
            if n_windows < least or n_windows <= best[0]:
                break
            share, n = max((consistent(s), len(s)) for s in _slots(index, item, window, span, text, words))
            if share >= similar:
                best = (n_windows, span[0][0], n, share)
                break
    if best[0] < index.total[item]:
        best = _along(index, item, window, hits, text, words, similar, best)
    return best if best[0] else None


FOUND = "array<struct<item_id: long, n_windows: long, n_item_windows: long, word: long, n_slots: long, slot_share: double>>"
FOUND_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("n_windows", pa.int64()), ("n_item_windows", pa.int64()), ("word", pa.int64()), ("n_slots", pa.int64()), ("slot_share", pa.float64())]))


def found_in(docs: pa.Array, index: Index, words: Words, window: int, similar: float) -> list[list[dict]]:
    """For each text what it holds of the index."""
    text = Text(docs, words)
    hits = defaultdict(list)
    for n in sorted(index.sizes):
        h, at, _, literal = text.windows(n)
        maybe = np.flatnonzero(index.filter[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        h, at, literal = h[maybe], at[maybe], literal[maybe]
        a, b = np.searchsorted(index.hash, h), np.searchsorted(index.hash, h, "right")
        for i in np.flatnonzero(b > a).tolist():
            for k in range(a[i], b[i]):
                hits[int(text.doc[at[i]]), int(index.owner[k])].append((int(at[i]), int(index.place[k]), int(index.plain[k]), int(literal[i])))
    found = defaultdict(list)
    for (doc, item), own in hits.items():
        if len({h for _, _, h, _ in own}) >= similar * index.total[item]:
            best = _judge(index, item, window, sorted(set(own)), text, words, similar)
            if best:
                found[doc].append({"item_id": index.ids[item], "n_windows": best[0], "n_item_windows": index.total[item], "word": best[1] - int(text.begin[doc]), "n_slots": best[2], "slot_share": best[3]})
    return [found.get(k, []) for k in range(len(docs))]


def _find(shared, window: int, similar: float, column: int):
    def run(batches):
        index, words = shared.value, Words()
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 512):
                if len(words) > CACHE_WORDS:
                    words = Words()
                out += found_in(batch.column(column).slice(lo, 512), index, words, window, similar)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, FOUND_TYPE)], [*batch.schema.names, "leaks_"])

    return run


def _own(window: int):
    """(item_id, text) → the hashes of the items' windows, and how many different ones an item has."""

    def run(batches):
        for batch in batches:
            words = Words()
            for lo in range(0, batch.num_rows, 512):
                text = Text(batch.column(1).slice(lo, 512), words)
                for n, h, at, plain in text.own_windows(window):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + text.doc[at])), batch.column(1).take(pa.array(lo + text.doc[at])), pa.array(h.view(np.int64)), pa.array(plain.view(np.int64)), pa.array(np.full(len(h), n), pa.int32())], ["item_id", "item", "h", "plain", "size"])

    return run


def _asked(sizes: list[int]):
    """(t1, t2, text) → the different window hashes of each text."""

    def run(batches):
        for batch in batches:
            words = Words()
            for lo in range(0, batch.num_rows, 512):
                if len(words) > CACHE_WORDS:
                    words = Words()
                part = batch.slice(lo, 512)
                text = Text(part.column(2), words)
                for n in sizes:
                    h, at, _, _ = text.windows(n)
                    if len(h):
                        pairs = np.unique(np.stack([text.doc[at].astype(np.uint64), h], 1), axis=0)
                        of = pa.array(pairs[:, 0].astype(np.int64))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))], ["t1", "t2", "h"])

    return run


def _judged(window: int, similar: float):
    """(t1, t2, text, items) → what each text holds of its own items."""

    def run(batches):
        for batch in batches:
            words, out = Words(), []
            for text, items in zip(batch.column(2), batch.column(3)):
                index = Index(sorted(((r["item_id"], r["item"]) for r in items.as_py()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), window)
                out += found_in(pa.array([text.as_py()], pa.string()), index, words, window, similar)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, FOUND_TYPE)], ["t1", "t2", "leaks_"])

    return run


def _joined(docs: DataFrame, items: DataFrame, window: int, similar: float) -> DataFrame:
    """leaks by a shuffled join of windows; texts are told apart by 128 bits of hash."""
    own = written(items.mapInArrow(tidy(_own(window)), "item_id long, item string, h long, plain long, size int"), "windows")
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())
    one = ["item_id", "item"]
    common = own.groupBy("h").agg(F.count("*").alias("n_items"))
    rare = own.join(common, "h").groupBy(*one, "plain").agg(F.max("n_items").alias("n_items"))
    total = own.groupBy(*one).agg(F.count_distinct("plain").alias("total"))
    order = Window.partitionBy(*one).orderBy("n_items", "plain")
    rare = rare.withColumn("rank", F.row_number().over(order)).join(total.select(*(F.col(c).alias(f"{c}_") for c in one), "total"), F.col("item_id").eqNullSafe(F.col("item_id_")) & (F.col("item") == F.col("item_")))
    rare = rare.filter(F.col("rank") <= F.col("total") - F.ceil(F.col("total") * similar) + 1).select(F.col("item_id").alias("i"), F.col("item").alias("t"), F.col("plain").alias("p"))
    keys = own.join(rare, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item") == F.col("t")) & (F.col("plain") == F.col("p"))).select("h", *one).distinct()
    texts = docs.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2"), "text").filter("text IS NOT NULL")
    asked = texts.mapInArrow(tidy(_asked(sizes)), "t1 long, t2 long, h long")
    pairs = written(asked.join(keys, "h").select("t1", "t2", *one).distinct(), "pairs")
    pairs = pairs.groupBy("t1", "t2").agg(F.collect_list(F.struct(*one)).alias("items"))
    met = texts.join(pairs, ["t1", "t2"]).groupBy("t1", "t2").agg(F.min("text").alias("text"), F.min("items").alias("items"))
    found = met.mapInArrow(tidy(_judged(window, similar)), f"t1 long, t2 long, leaks_ {FOUND}").filter(F.size("leaks_") > 0)
    found = found.select(F.col("t1").alias("f1_"), F.col("t2").alias("f2_"), "leaks_")
    names = docs.columns
    docs = docs.join(found, (F.xxhash64("text") == F.col("f1_")) & (F.xxhash64(F.lit("text"), "text") == F.col("f2_")), "left")
    return docs.select(*names, F.coalesce("leaks_", F.array().cast(FOUND)).alias("leaks_"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similar: float = SIMILAR) -> DataFrame:
    """docs with a column leaks_: an array of the items found in each text, empty for clean ones. Needs a column text."""
    items = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")) + 1)).first()[0] or 0
    if not words:
        return docs.withColumn("leaks_", F.array().cast(FOUND))
    if words > BLOCK_WINDOWS:
        return _joined(docs, items, window, similar)
    index = Index(sorted(((r.item_id, r.text) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), window)  # BLOCK_WINDOWS words at most
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return docs.mapInArrow(tidy(_find(shared, window, similar, docs.columns.index("text"))), f"{fields}, leaks_ {FOUND}")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = leaks(pick(docs, "doc_id", "text"), benchmark)
    return found.filter(F.size("leaks_") > 0).select("doc_id", F.inline("leaks_"))

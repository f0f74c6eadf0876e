"""Language-model scoring by prediction by partial matching, learned from the whole corpus.

A text is its words (A-Z lower-cased), each closed by a space, and an end. Every byte is predicted from the
``ORDER`` bytes before it, whatever words they belong to (before a text there are ends alone), by a trie of
contexts: from the longest context that the training texts hold down to none, with escape estimation (method D:
a context with n bytes of u kinds escapes with u / 2n) and exclusion of the symbols that longer contexts would
have predicted. A document's score is the sum of log10 of its bytes' probabilities.

A byte and its context are one key of 64 bits, the nearest byte first, so that sorted keys are a trie. Chunks of
documents count their different keys and send them to routes, dealt out by the ``NEAR`` nearest bytes of the
context; a route holds all longer contexts that end so, and what shorter ones count is a table of at most 2**24
sums that all routes get. Where there are more than ``FAN`` chunks, groups of chunks add up their keys before they
meet, level by level, so that no task gets more than ``FAN`` senders, however frequent a context is. Answers go
back the same way. Words are counted alike, told apart by 64 bits of hash.

Contract: null texts are empty: one end. A null doc_id counts as held out. Without training texts every byte
costs 1/256 and the base score is the model's over N = V = 0. Repeated rows count each. A byte 255, which only
broken UTF-8 has, counts as 254.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm._chunks import Chunk, chunks, each_chunk
from textquarry.llm._sample import remainder
from textquarry.llm._shared import partitions, pick, tidy, written
from textquarry.llm.substrings import MULT, _mix

#: Bytes of a context; 7 and the predicted byte would fill 64 bits. Those that deal contexts out.
ORDER, NEAR = 6, 3
#: UTF-8 has no byte 255: it ends each text, and stands before it.
SPACE, END = 32, 255
#: Raw bytes of a chunk, bytes that are handled at once, raw bytes for each route, and routes at most.
CHUNK_BYTES, STEP, ROUTE_BYTES, MOST_ROUTES = 14 << 20, 1 << 20, 64 << 20, 8192
#: Senders whose keys meet in one task.
FAN = 256
WORDS, GRAMS, LOW = range(3)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = SPACE


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unzip(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x, max_output_size=max(1, zstandard.frame_content_size(x))), kind)


def is_held_out(doc_id: int | None, n: int = 10) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n == 0


class Counts:
    """Different keys, sorted, with their counts; keys may count 0."""

    def __init__(self):
        self.key, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, key: np.ndarray, counted: bool) -> None:
        """Keys as they come; they are sorted in place."""
        if not len(key):
            return
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        self.merge(key[first], n if counted else np.zeros(len(n), np.int64))

    def merge(self, key: np.ndarray, n: np.ndarray) -> None:
        """Different sorted keys and their counts."""
        if not len(self.key):
            self.key, self.n = key, n.astype(np.int64)
            return
        at = np.searchsorted(self.key, key)
        known = self.key[np.minimum(at, len(self.key) - 1)] == key
        self.n[at[known]] += n[known]  # each key comes once
        new = ~known
        place = at[new] + np.arange(int(new.sum()))
        size = len(self.key) + len(place)
        old = np.ones(size, bool)
        old[place] = False
        both, counts = np.empty(size, np.uint64), np.empty(size, np.int64)
        both[place], counts[place], both[old], counts[old] = key[new], n[new], self.key, self.n
        self.key, self.n = both, counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> Counts:
    """All parts added up, always two of like size."""
    made = []
    for key, n in parts:
        one = Counts()
        one.merge(key, n)
        made.append(one)
    while len(made) > 1:
        for a, b in zip(made[::2], made[1::2]):
            a.merge(b.key, b.n)
        made = made[::2]
    return made[0] if made else Counts()


class Stream:
    """The bytes of a chunk's texts as they are predicted: words closed by spaces, and ORDER ends before and after each text."""

    def __init__(self, chunk: Chunk):
        pad = b" " + bytes([END]) * ORDER
        text = _LOWER[np.frombuffer(b"".join([pad[1:], *(body.replace(b"\xff", b"\xfe") + pad for body in chunk.docs())]), np.uint8)]
        keep = text != SPACE
        keep[1:] |= keep[:-1] & (text[:-1] != END)  # the first space after a word
        ends = np.cumsum(chunk.lens + len(pad))
        #: Where the first end after each text is, which is predicted as well.
        self.ends = ends - np.searchsorted(np.flatnonzero(~keep), ends)
        self.text = text[keep]
        self.held = np.array([is_held_out(chunk.doc_id(i)) for i in range(len(chunk))], bool)

    def steps(self) -> Iterator[Step]:
        lo = ORDER
        while lo < len(self.text):
            hi = min(lo + STEP, len(self.text))
            if hi < len(self.text):
                closed = self.closed(self.text[lo:hi])
                # a word of more than a step ends with the first space after it
                hi = lo + int(closed[-1]) + 1 if len(closed) else next((at + int(found[0]) + 1 for at in range(hi, len(self.text), STEP) if len(found := self.closed(self.text[at : at + STEP]))), len(self.text))
            yield Step(self, lo, hi)
            lo = hi

    @staticmethod
    def closed(x: np.ndarray) -> np.ndarray:
        return np.flatnonzero((x == SPACE) | (x == END))


class Step:
    """A range of the stream that cuts no word: the key and the document of each predicted byte, and of each word."""

    def __init__(self, stream: Stream, lo: int, hi: int):
        x = stream.text[lo:hi]
        first, last = np.searchsorted(stream.ends, (lo, hi))
        end = np.zeros(hi - lo, bool)
        end[stream.ends[first:last] - lo] = True
        doc = first + np.cumsum(end) - end
        use = (x != END) | end
        wide = stream.text[lo - ORDER : hi].astype(np.uint64)
        key = wide[ORDER:].copy()
        for k in range(1, ORDER + 1):  # nearest byte << 48 | ... | farthest << 8 | byte
            key |= wide[ORDER - k : len(wide) - k] << np.uint64(8 * (ORDER + 1 - k))
        self.key, self.doc = key[use], doc[use]
        space = np.flatnonzero(x == SPACE)
        self.word, self.word_doc = np.zeros(0, np.uint64), doc[space]
        if len(space):
            up, down = _powers(len(x))
            stops = Stream.closed(x)
            begin = np.concatenate([[0], stops + 1])[np.searchsorted(stops, space)]
            with np.errstate(over="ignore"):
                sums = np.zeros(len(x) + 1, np.uint64)
                np.cumsum((wide[ORDER:] + np.uint64(1)) * down, out=sums[1:])
                self.word = _mix((sums[space] - sums[begin]) * up[space])


_POWERS = [np.zeros(0, np.uint64)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        one = int(MULT[0])
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(m)))) for m in (one, pow(one, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _routes(key: np.ndarray, kind: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(route, places of its keys)."""
    part = key >> np.uint64(8 * (ORDER + 1 - NEAR)) if kind == GRAMS else key
    with np.errstate(over="ignore"):
        route = (_mix(part + np.uint64(1)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(route, kind="stable")
    first = np.flatnonzero(np.diff(route[order], prepend=-1))
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
        yield int(route[order[i]]), order[i:j]


SENT = "kind int, route int, sender string, keys binary, counts binary"
SENT_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary())


def _rows(rows: list[tuple], names: list[str], types: tuple) -> dict:
    return {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types))}


def _counted(chunk: Chunk) -> tuple[Stream, Counts, Counts]:
    """The different words and keys of a chunk, with their counts in its training texts."""
    stream, grams, words = Stream(chunk), Counts(), Counts()
    for step in stream.steps():
        for count, key, doc in ((grams, step.key, step.doc), (words, step.word, step.word_doc)):
            held = stream.held[doc]
            count.add(key[~held], True)
            count.add(key[held], False)
    return stream, words, grams


def _send(n_routes: int):
    def run(batches):
        for chunk in each_chunk(batches):
            _, words, grams = _counted(chunk)
            rows = [(kind, r, chunk.name, _zip(c.key[at]), _zip(c.n[at])) for kind, c in ((WORDS, words), (GRAMS, grams)) for r, at in _routes(c.key, kind, n_routes)]
            low = Counts()
            seen = grams.n > 0
            short = grams.key[seen] >> np.uint64(8 * (ORDER + 2 - NEAR)) << np.uint64(8) | grams.key[seen] & np.uint64(255)
            order = np.argsort(short)
            first = np.flatnonzero(np.diff(short[order], prepend=np.uint64(1 << 63)))
            low.merge(short[order][first], np.add.reduceat(grams.n[seen][order], first) if len(first) else first)
            rows.append((LOW, 0, chunk.name, _zip(low.key), _zip(low.n)))
            yield pa.RecordBatch.from_pydict(_rows(rows, ["kind", "route", "sender", "keys", "counts"], SENT_TYPES))

    return run


def _low(batches):
    for batch in batches:
        for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(_unzip(k, np.uint64).astype(np.int32)), pa.array(_unzip(w, np.int64))], ["low", "n"])


class Level:
    """The contexts of one length: their bytes with counts, sums and kinds."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        """gram: context << 8 | byte, each once and sorted."""
        self.gram, self.n = gram, n
        context = gram >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(gram) else np.zeros(0, np.int64)
        self.context, self.kinds = context[first], np.diff(np.append(first, len(gram)))
        self.total = np.add.reduceat(n, first) if len(first) else n

    def shorter(self) -> Level:
        """The contexts without their farthest bytes."""
        gram = self.gram >> np.uint64(16) << np.uint64(8) | self.gram & np.uint64(255)
        order = np.argsort(gram, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(gram[order]) > 0])) if len(gram) else np.zeros(0, np.int64)
        return Level(gram[order][first], np.add.reduceat(self.n[order], first) if len(first) else self.n)

    def sums_in(self, other: Level) -> np.ndarray:
        """For each context what its bytes count in the shorter context."""
        at = np.searchsorted(other.gram, self.gram >> np.uint64(16) << np.uint64(8) | self.gram & np.uint64(255))
        return np.bincount(np.repeat(np.arange(len(self.kinds)), self.kinds), other.n[at], len(self.kinds))


def low_levels(low: np.ndarray, n: np.ndarray) -> list[Level]:
    """The levels of the contexts of NEAR - 1 bytes and less."""
    levels = [Level(low, n)]
    while len(levels) < NEAR:
        levels.append(levels[-1].shorter())
    return levels


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in a sorted table; -1 where it isn't there."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def log10(key: np.ndarray, weight: np.ndarray, low: list[Level]) -> np.ndarray:
    """log10 of the probability of each key's byte in its context. key: sorted; weight: how often they occur in training."""
    seen = weight > 0
    levels = [Level(key[seen], weight[seen].astype(np.float64))]
    while len(levels) <= ORDER - NEAR:
        levels.append(levels[-1].shorter())
    levels += low
    out, open_ = np.zeros(len(key)), np.arange(len(key))
    out_n, out_kinds = np.zeros(len(key)), np.zeros(len(key), np.int64)  # counts here of what is excluded, and its kinds
    symbol = key & np.uint64(255)
    for k, level in zip(range(ORDER, -1, -1), levels):
        context = key[open_] >> np.uint64(8 * (ORDER + 1 - k))
        at = _find(level.context, context)
        there = at >= 0
        use, at, context = open_[there], at[there], context[there]
        hit = _find(level.gram, context << np.uint64(8) | symbol[use])
        code = hit >= 0
        rest_n, rest = level.total[at] - out_n[use], level.kinds[at] - out_kinds[use]
        out[use[code]] += np.log10((2 * level.n[hit[code]] - 1) / (2 * rest_n[code]))
        escape = ~code & (rest > 0)
        out[use[escape]] += np.log10(rest[escape] / (2 * rest_n[escape]))
        # the next shorter context excludes this one's symbols
        left = use[~code]
        out_kinds[left] = level.kinds[at[~code]]
        if k:
            out_n[left] = level.sums_in(levels[ORDER - k + 1])[at[~code]]
        coded = np.zeros(len(key), bool)
        coded[use[code]] = True
        open_ = open_[~coded[open_]]
    out[open_] -= np.log10(256 - out_kinds[open_])
    return out


ANSWER = "kind int, route int, sender string, answers binary"
ANSWER_NAMES, ANSWER_TYPES = ["kind", "route", "sender", "answers"], (pa.int32(), pa.int32(), pa.string(), pa.binary())


def _pack(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the first bytes of all before their second ones, which is easier to compress."""
    return _zip(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T))


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(_unzip(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _read(table: pa.Table) -> tuple[list[dict], list[np.ndarray], Counts]:
    rows = sorted(table.to_pylist(), key=lambda r: r["sender"])
    keys = [_unzip(r["keys"], np.uint64) for r in rows]
    return rows, keys, merged([(k, _unzip(r["counts"], np.int64)) for k, r in zip(keys, rows)])


def _add_up(table: pa.Table) -> pa.Table:
    rows, _, sums = _read(table)
    return pa.table(_rows([(rows[0]["kind"], rows[0]["route"], rows[0]["parent"], _zip(sums.key), _zip(sums.n))], ["kind", "route", "sender", "keys", "counts"], SENT_TYPES))


def _answer(shared):
    """For each sender the answers in the order of its keys: logarithms as float32, or the words' counts."""

    def run(table: pa.Table) -> pa.Table:
        rows, keys, sums = _read(table)
        words = rows[0]["kind"] == WORDS
        found = sums.n if words else log10(sums.key, sums.n, shared.value).astype(np.float32)
        out = [(r["kind"], r["route"], r["sender"], _pack(found[np.searchsorted(sums.key, k)])) for r, k in zip(rows, keys)]
        totals = [(int(sums.n.sum()), int((sums.n > 0).sum())) if words else (0, 0)] + [(0, 0)] * (len(rows) - 1)
        return pa.table(_rows(out, ANSWER_NAMES, ANSWER_TYPES) | {"tokens": pa.array([t for t, _ in totals], pa.int64()), "kinds": pa.array([k for _, k in totals], pa.int64())})

    return run


def _hand_down(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: what the senders of one group sent; right: the group's keys and answers."""
    above = right.to_pylist()[0]
    key, found = _unzip(above["keys"], np.uint64), _unpack(above["answers"], np.int64 if above["kind"] == WORDS else np.float32)
    out = [(r["kind"], r["route"], r["sender"], _pack(found[np.searchsorted(key, _unzip(r["keys"], np.uint64))])) for r in left.to_pylist()]
    return pa.table(_rows(out, ANSWER_NAMES, ANSWER_TYPES))


def _levels(sent: DataFrame, senders: int) -> list[DataFrame]:
    """sent with a column parent, and above it the sums of groups, until a route has FAN senders at most."""
    levels = []
    while senders > FAN:
        senders = -(-senders // FAN)
        levels.append(sent.withColumn("parent", F.pmod(F.xxhash64("sender"), F.lit(senders)).cast("string")))
        sent = written(levels[-1].groupBy("kind", "route", "parent").applyInArrow(_add_up, SENT), "sums", "uncompressed")
    return [*levels, sent]


def _down(levels: list[DataFrame], answers: DataFrame) -> DataFrame:
    for below, above in zip(levels[-2::-1], levels[:0:-1]):
        answers = answers.join(above.select("kind", "route", "sender", "keys"), ["kind", "route", "sender"])
        answers = below.groupBy("kind", "route", "parent").cogroup(answers.groupBy("kind", "route", "sender")).applyInArrow(_hand_down, ANSWER)
    return answers


class Lookup:
    """Key → answer by tables of places: a key that another one displaced is looked for in the next table."""

    def __init__(self, key: np.ndarray, answer: np.ndarray):
        self.key, self.answer, self.tables = key, answer, []
        rest = np.arange(len(key), dtype=np.int32)
        while len(rest):
            bits = max(4, int(len(rest) * 2 - 1).bit_length())
            slot = np.zeros(1 << bits, np.int32)
            h = self.hash(key[rest], len(self.tables), bits)
            slot[h] = rest
            self.tables.append((bits, slot))
            rest = rest[slot[h] != rest]

    @staticmethod
    def hash(key: np.ndarray, turn: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (key ^ (key >> np.uint64(29 + turn))) * (MULT[turn % 2] + np.uint64(2 * turn))
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """All of them must be there."""
        at = np.zeros(len(key), np.int32)
        rest = None
        for turn, (bits, slot) in enumerate(self.tables):
            own = key if rest is None else key[rest]
            found = slot[self.hash(own, turn, bits)]
            if rest is None:
                at = found
                rest = np.flatnonzero(self.key[found] != own)
            else:
                at[rest] = found
                rest = rest[self.key[found] != own]
            if not len(rest):
                break
        return self.answer[at]


def _score(tokens: int, kinds: int, train_docs: int, n_routes: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        for chunk in each_chunk([left]):
            s, *counted = _counted(chunk)
            tables = []
            for kind, own, c in ((WORDS, np.int64, counted[0]), (GRAMS, np.float32, counted[1])):
                answers, found = {r["route"]: r["answers"] for r in rows if r["kind"] == kind}, np.zeros(len(c.key), own)
                for r, at in _routes(c.key, kind, n_routes):
                    found[at] = _unpack(answers[r], own)
                tables.append(Lookup(c.key, found))
            words, grams = tables
            del rows, counted
            n, total = len(chunk), tokens + 0.1 * (kinds + 1)
            size, known, base, logs = np.ones(n, np.int64), np.full(n, int(train_docs > 0)), np.full(n, np.log10((train_docs + 0.1) / total)), np.zeros(n)
            for step in s.steps():
                logs += np.bincount(step.doc, grams(step.key), n)
                if len(step.word):
                    count = words(step.word)
                    size += np.bincount(step.word_doc, minlength=n)
                    known += np.bincount(step.word_doc[count > 0], minlength=n)
                    base += np.bincount(step.word_doc, np.log10((count + 0.1) / total), n)
            return pa.table({
                "doc_id": chunk.id_column(), "held_out": pa.array(s.held), "n_tokens": pa.array(size), "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(n, tokens), pa.int64()), "base_score": pa.array(base), "score": pa.array(logs),
            })
        raise ValueError("an answer without its chunk")

    return run


def score(docs: DataFrame) -> DataFrame:
    """Score all texts by a model of those whose crc32(doc_id) mod 10 is not 0.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed counts of single words) and
    score (the model's log10 probability of the text).
    """
    spark = docs.sparkSession
    table = chunks(docs, "chunks", CHUNK_BYTES)
    size, senders = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    n = min(MOST_ROUTES, max(partitions(spark), size // ROUTE_BYTES + 1))
    sent = written(table.mapInArrow(tidy(_send(n)), SENT), "sent", "uncompressed")
    train_docs = pick(docs, "doc_id").filter(remainder(F.col("doc_id").cast("long"), 10) != 0).count()

    low = sent.filter(F.col("kind") == LOW).select("keys", "counts").mapInArrow(_low, "low int, n long").groupBy("low").agg(F.sum("n").alias("n"))
    low = low.toArrow().sort_by("low")  # a row for each three bytes that follow each other: 2**24 at most, far fewer in any text
    shared = spark.sparkContext.broadcast(low_levels(np.asarray(low["low"]).astype(np.uint64), np.asarray(low["n"]).astype(np.float64)))

    levels = _levels(sent.filter(F.col("kind") != LOW), senders)
    ask = lambda kind: levels[-1].filter(F.col("kind") == kind).groupBy("kind", "route").applyInArrow(_answer(shared), ANSWER + ", tokens long, kinds long")
    words = written(ask(WORDS), "words", "uncompressed")
    tokens, kinds = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    tokens, kinds = tokens + train_docs, kinds + int(train_docs > 0)
    answers = _down(levels, words.select(*ANSWER_NAMES).unionAll(ask(GRAMS).select(*ANSWER_NAMES)))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return table.groupBy("chunk").cogroup(answers.groupBy("sender")).applyInArrow(_score(tokens, kinds, train_docs, n), schema)


def query(docs: DataFrame) -> DataFrame:
    return score(docs)

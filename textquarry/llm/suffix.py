"""Exact substring removal with suffix arrays built by two-stage sorting.

Two stages in the suffix array: only the suffixes that are smaller than their successors are sorted
directly; all others are induced by one scan over the buckets of first bytes. Adjacent common prefixes
of at least ``length`` bytes then mark the windows that occur more than once.

To spread this over a cluster, text is dealt out by content. The windows of ``length`` bytes that share
their smallest ``gram``-byte hash (leftmost of ties) form a segment, and equal windows share that gram,
their anchor. So the segments of one anchor can be sorted apart from all others:

1. each chunk reports (anchor, segment) hashes; a segment whose anchor is unique in the corpus ends here,
   and all windows of a segment that occurs twice as a whole are known to be repeated;
2. anchors with several different segments send each different segment once to a suffix array;
3. an anchor with more than ``hot`` different segments (a common phrase in ever new surroundings) would
   gather too much in one task. Its windows are parted by where the anchor lies in them, in ``CLASSES`` ways; the
   windows of a class share a larger gram around the anchor, and these grams deal the parts of segments out to
   suffix arrays of their own. These grams can be one phrase again, so the classes are narrower for anchors with more
   segments (``LEVELS``), down to single windows. A chunk sends equal parts once. So whatever a bucket
   gets for one gram is bounded by the segments of the level, or is equal windows of different chunks.

Contract: null text is empty; texts shorter than ``length`` lose nothing; null doc_ids and repeated rows
are kept as rows of their own; a repeated row is a repeated text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm._chunks import Chunk, chunks, cut, each_chunk, joined_mask
from textquarry.llm._shared import partitions, written
from textquarry.llm.substrings import MULT, _mix, rolling

#: Ends each segment in a suffix array; UTF-8 has no such byte.
END = 0xFF
#: Keys and bytes that one bucket is to hold, and buckets that a task sorts, whatever their compressed size.
BUCKET_KEYS, BUCKET_BYTES, TASK_BUCKETS = 1 << 20, 1 << 19, 4
#: Ways to part the windows of a frequent anchor.
CLASSES = 8
#: Anchors with more than so many times ``hot`` segments: classes as above, of four places, of one place.
LEVELS = (1, 2, 4)
#: Odd codes: all windows of the segment are repeated. From HOT on two codes for each level.
UNIQUE, REPEATED, SEND, SEND_REPEATED, HOT = range(5)


def class_edges(level: int, length: int, gram: int) -> np.ndarray:
    """Where the classes of a level begin, and the end of the last, among the places of an anchor in a window."""
    places = length - gram + 1
    n = min(places, (CLASSES, -(-places // 4), places)[level])
    return np.arange(n + 1) * places // n


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last one is not."""
    ends = np.flatnonzero(text[1:] != text[:-1])
    rises = np.append(text[ends] < text[ends + 1], False)
    return np.repeat(rises, np.diff(np.concatenate([[-1], ends, [len(text) - 1]])))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    raw, small = text.tobytes(), smaller_than_next(text)
    direct: list[np.ndarray] = []
    chosen = np.flatnonzero(small)
    chosen = chosen[np.argsort(text[chosen], kind="stable")]
    bounds = np.searchsorted(text[chosen], np.arange(257))
    for c in range(256):  # sorted by first byte, so that few keys are in memory at once
        own = chosen[bounds[c] : bounds[c + 1]]
        direct.append(np.array(sorted(own.tolist(), key=lambda i: raw[i : i + depth]), np.int64))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))
    out = []

    def scan(now: np.ndarray, c: int) -> None:
        out.append(now)
        before = now[now > 0] - 1
        before = before[~small[before]]
        first = text[before]
        if len(same := before[first == c]):
            induced[c].append(same)
        other = before[first != c]
        other = other[np.argsort(text[other], kind="stable")]
        first = text[other]
        at = np.flatnonzero(np.diff(first.astype(np.int64), prepend=-1))
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(other)]):
            induced[first[i]].append(other[i:j])

    for c in range(256):
        k = 0
        while k < len(induced[c]):  # these may induce others in this bucket
            scan(induced[c][k], c)
            k += 1
        scan(direct[c], c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix and the one before it in ``order``, as far as ``depth``."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(), shape=(len(padded) - 8, 8), strides=(1, 1))
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for done in range(0, depth, 8):
        differ = words[order[alive] + done] != words[order[alive - 1] + done]
        any_ = differ.any(axis=1)
        out[alive] = done + np.where(any_, differ.argmax(axis=1), 8)
        alive = alive[~any_]
        if not len(alive):
            break
    return np.minimum(out, depth)


def repeated_windows(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows of ``length`` bytes at ``starts`` occur at another start."""
    valid = np.zeros(len(text) + 1, bool)
    valid[starts] = True
    order = suffix_array(text, length)
    order = order[valid[order]]
    again = common_prefixes(text, order, length) >= length
    found = again.copy()
    found[:-1] |= again[1:]
    out = np.zeros(len(text) + 1, bool)
    out[order[found]] = True
    return out[starts]


class Segments:
    """The segments of a chunk: ``a``, ``b`` (end), where their anchors are and the anchors' hashes."""

    def __init__(self, chunk: Chunk, length: int, gram: int):
        self.chunk, self.length, self.gram = chunk, length, gram
        self.text = np.frombuffer(chunk.body, np.uint8)
        n, span = len(self.text), length - gram + 1
        self.a = self.b = self.place = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if n >= length:
            with np.errstate(over="ignore"):
                h = rolling(self.text.astype(np.uint64) + np.uint64(1), gram, MULT[0])
            low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while width * 2 <= span:
                low, width = np.minimum(low[: len(low) - width], low[width:]), width * 2
            if span > width:
                low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
            inside = np.zeros(n + 1, np.int64)
            long = chunk.lens >= length
            np.add.at(inside, chunk.starts[long], 1)
            np.add.at(inside, chunk.ends[long] - length + 1, -1)
            starts = np.flatnonzero(np.cumsum(inside[:n]) > 0)
            if len(starts):
                anchor = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                new = np.ones(len(starts), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(starts)) - 1
                self.place = anchor[first]
                with np.errstate(over="ignore"):
                    self.a, self.b, self.anchor = starts[first], starts[last] + length, _mix(h[anchor[first]])  # as these are small ones, mixed anew
        body = chunk.body
        whole = [xxhash.xxh3_128_intdigest(body[i:j]) for i, j in zip(self.a.tolist(), self.b.tolist())]
        self.seg = np.array([w >> 64 for w in whole], np.uint64)
        self.check = np.array([w & 0xFFFFFFFF for w in whole], np.uint32)
        order = np.lexsort((self.check, self.seg, self.anchor))
        x, y, z = self.anchor[order], self.seg[order], self.check[order]
        new = np.ones(len(order), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
        #: Sorted, each sort of segment once: its first place, whether there are more, and for each segment its number.
        self.one = order[new]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.twice = np.bincount(self.number, minlength=len(self.one)) > 1

    def windows(self, which: np.ndarray) -> np.ndarray:
        """The window starts of some segments, in order."""
        n = self.b[which] - self.a[which] - self.length + 1
        return np.repeat(self.a[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _report(length: int, gram: int, n_buckets: int):
    def run(batches):
        for chunk in each_chunk(batches):
            s = Segments(chunk, length, gram)
            x, y, z = s.anchor[s.one], s.seg[s.one], s.check[s.one]
            for b, i, j in cut(x, n_buckets):
                row = [b, chunk.name, x[i:j].tobytes(), y[i:j].tobytes(), z[i:j].tobytes(), np.packbits(s.twice[i:j]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), *[pa.binary()] * 4))], ["bucket", "chunk", "anchors", "segs", "checks", "twice"])

    return run


def _decide(hot: int, length: int, gram: int):
    sizes = [int((length - 1 + np.diff(class_edges(level, length, gram))).sum()) for level in range(len(LEVELS))]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        lens = [len(r["anchors"]) // 8 for r in rows]
        anchor, seg = (np.concatenate([np.frombuffer(r[k], np.uint64) for r in rows]) for k in ("anchors", "segs"))
        check = np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in rows])
        twice = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=n) for r, n in zip(rows, lens)]).astype(bool)
        order = np.lexsort((check, seg, anchor))  # stable: equal segments keep the chunks' order
        anchor, seg, check, twice = anchor[order], seg[order], check[order], twice[order]
        new_anchor, new = np.ones(len(order), bool), np.ones(len(order), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new[1:] = new_anchor[1:] | (seg[1:] != seg[:-1]) | (check[1:] != check[:-1])
        number = np.cumsum(new) - 1
        again = (np.bincount(number) > 1) | np.bincount(number, weights=twice).astype(bool)
        sorts = np.bincount(np.cumsum(new_anchor) - 1, weights=new)[np.cumsum(new_anchor) - 1]
        again = again[number]
        code = np.where(again, REPEATED, UNIQUE).astype(np.uint8)
        code[(sorts > 1) & ~again] = SEND
        code[(sorts > 1) & again & new] = SEND_REPEATED
        for level, times in enumerate(LEVELS):
            code[(sorts > hot * times) & ~again] = HOT + 2 * level
            code[(sorts > hot * times) & again & new] = HOT + 2 * level + 1
        back = np.empty(len(order), np.uint8)
        back[order] = code
        masks = np.split(back, np.cumsum(lens)[:-1])
        sent = [int((m >> 1 == SEND >> 1).sum()) for m in masks]
        parted = [sum(size * int((m >> 1 == (HOT >> 1) + level).sum()) for level, size in enumerate(sizes)) for m in masks]
        return pa.table({"bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "chunk": [r["chunk"] for r in rows], "mask": pa.array([m.tobytes() for m in masks], pa.binary()), "sent": pa.array(sent, pa.int64()), "parted": pa.array(parted, pa.int64())})

    return run


def _sent(s: Segments, codes: np.ndarray, n_buckets: int):
    """(bucket, numbers of the segments sent) in the order of their anchors."""
    which = np.flatnonzero((codes == SEND) | (codes == SEND_REPEATED))
    for b, i, j in cut(s.anchor[s.one][which], n_buckets):
        yield b, which[i:j]


def _parts(s: Segments, codes: np.ndarray, n_buckets: int) -> tuple[list[tuple], np.ndarray]:
    """The parts of segments with frequent anchors, dealt out by larger grams, and the starts of windows found repeated here.

    Parts: (bucket, begins, ends, which await an answer).
    """
    found, again = [], [np.zeros(0, np.int64)]
    for level in range(len(LEVELS)):
        which = np.flatnonzero(codes >> 1 == (HOT >> 1) + level)
        if not len(which):
            continue
        one = s.one[which]
        edges = class_edges(level, s.length, s.gram)
        for c, (near, far) in enumerate(zip(edges.tolist(), (edges[1:] - 1).tolist())):  # the anchor lies so far from a window's begin
            lo, hi = np.maximum(s.a[one], s.place[one] - far), np.minimum(s.b[one] - s.length, s.place[one] - near)
            some = lo <= hi
            x, y = s.place[one][some] - near, s.place[one][some] - far + s.length  # what all windows of the class hold
            route = np.fromiter((xxhash.xxh3_64_intdigest(s.chunk.body[i:j], c) for i, j in zip(x.tolist(), y.tolist())), np.uint64, len(x))
            lo, hi, asked = lo[some], hi[some] + s.length, codes[which][some] % 2 == 0
            order = np.argsort(route, kind="stable")
            route, lo, hi, asked = route[order], lo[order], hi[order], asked[order]
            bodies = [s.chunk.body[i:j] for i, j in zip(lo.tolist(), hi.tolist())]
            first: dict[bytes, int] = {}
            kind = np.fromiter((first.setdefault(x, k) for k, x in enumerate(bodies)), np.int64, len(bodies))
            more = np.bincount(kind, minlength=len(kind))[kind] > 1
            count = (hi - lo - s.length + 1)[more]
            again.append(np.repeat(lo[more] - np.cumsum(count) + count, count) + np.arange(int(count.sum())))
            one_each = kind == np.arange(len(kind))  # a part is sent once, and needs no answer if it is here twice
            route, lo, hi, asked = (v[one_each] for v in (route, lo, hi, asked & ~more))
            found.append((route, lo, hi, asked))
    if not found:
        return [], again[0]
    route, lo, hi, asked = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(route, kind="stable")
    dealt = [(b, order[i:j]) for b, i, j in cut(route[order], n_buckets)]
    return [(b, lo[own], hi[own], asked[own]) for b, own in dealt], np.concatenate(again)


def _row(kind: int, bucket: int, chunk: Chunk, a: np.ndarray, b: np.ndarray, asked: np.ndarray, length: int) -> tuple:
    body = b"".join(chunk.body[i:j] for i, j in zip(a.tolist(), b.tolist()))
    return kind, bucket, chunk.name, zstandard.ZstdCompressor(level=1).compress(body), (b - a).astype(np.uint16 if length < 30000 else np.uint32).tobytes(), asked.astype(np.uint8).tobytes()


def _send(length: int, gram: int, n_send: int, n_parted: int):
    def run(left: pa.Table, right: pa.Table):
        rows = []
        for chunk in each_chunk([left]):
            s = Segments(chunk, length, gram)
            codes = joined_mask(right.to_pylist())
            for b, which in _sent(s, codes, n_send):
                one = s.one[which]
                rows.append(_row(1, b, chunk, s.a[one], s.b[one], codes[which] == SEND, length))
            rows += [_row(2, bucket, chunk, a, b, asked, length) for bucket, a, b, asked in _parts(s, codes, n_parted)[0]]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 3))], ["kind", "bucket", "chunk", "x", "y", "z"])

    return run


def _sort(rows: list[dict], length: int) -> list[bytes]:
    """For each row the windows of the segments that await an answer, as bytes 0 or 1."""
    texts, lens, asked = [], [], []
    for r in rows:
        n = np.frombuffer(r["y"], np.uint16 if length < 30000 else np.uint32).astype(np.int64)
        body = zstandard.ZstdDecompressor().decompress(r["x"], max_output_size=max(1, int(n.sum())))
        ends = np.cumsum(n)
        texts += [body[i:j] for i, j in zip((ends - n).tolist(), ends.tolist())]
        lens.append(n)
        asked.append(np.frombuffer(r["z"], np.uint8).astype(bool))
    n = np.concatenate(lens)
    text = np.frombuffer(b"".join(t + bytes([END]) for t in texts), np.uint8)
    begin, count = np.cumsum(n + 1) - n - 1, n - length + 1
    starts = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    found = repeated_windows(text, starts, length)
    wanted = np.repeat(np.concatenate(asked), count)
    sizes = [int(c[a].sum()) for c, a in zip(np.split(count, np.cumsum([len(x) for x in lens])[:-1]), asked)]
    return [x.astype(np.uint8).tobytes() for x in np.split(found[wanted], np.cumsum(sizes)[:-1])]


def _answer(length: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        masks = _sort(rows, length)
        return pa.table({"kind": pa.array([r["kind"] for r in rows], pa.int32()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "chunk": [r["chunk"] for r in rows], "mask": pa.array(masks, pa.binary())})

    return run


def _remove(length: int, gram: int, n_send: int, n_parted: int, with_text: bool):
    def run(left: pa.Table, right: pa.Table):
        rows = right.to_pylist()
        codes, answers, parted = ([r for r in rows if r["kind"] == k] for k in range(3))
        for chunk in each_chunk([left]):
            s = Segments(chunk, length, gram)
            code = joined_mask(codes)
            number = s.number
            whole = np.flatnonzero((code % 2 == 1)[number] | s.twice[number]) if len(code) else number
            found = []
            # the sent ones, of which each sort occurs once here
            for r, (_, which) in zip(sorted(answers, key=lambda r: r["bucket"]), _sent(s, code, n_send)):
                starts = s.windows(s.one[which[code[which] == SEND]])
                found.append(starts[np.frombuffer(r["mask"], np.uint8).astype(bool)])
            parts, again = _parts(s, code, n_parted)
            found.append(again)
            for r, (_, a, b, asked) in zip(sorted(parted, key=lambda r: r["bucket"]), parts):
                count = (b - a - length + 1)[asked]
                starts = np.repeat(a[asked] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                found.append(starts[np.frombuffer(r["mask"], np.uint8).astype(bool)])
            step = np.zeros(len(s.text) + 1, np.int64)
            np.add.at(step, s.a[whole], 1)
            np.add.at(step, s.b[whole], -1)
            for at in found:
                np.add.at(step, at, 1)
                np.add.at(step, at + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            removed, spans, shas, texts = [], [], [], []
            for i, j in zip(chunk.starts.tolist(), chunk.ends.tolist()):
                g = gone[i:j]
                removed.append(int(g.sum()))
                spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if removed[-1] else 0)
                kept = s.text[i:j][~g].tobytes() if removed[-1] else chunk.body[i:j]
                shas.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept)
            out = {"doc_id": chunk.id_column(), "n_bytes": pa.array(chunk.lens, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
            return pa.table(out | ({"kept": pa.array(texts, pa.binary())} if with_text else {}))
        raise ValueError("an answer without its chunk")

    return run


def remove_repeats(docs: DataFrame, length: int = 200, gram: int | None = None, hot: int = 512, with_text: bool = False) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes (a cut can
    fall inside a character). ``gram`` is the size of the anchors, half of ``length`` unless given.
    """
    gram = gram or max(1, length // 2)
    if not 1 <= gram <= length:
        raise ValueError("gram must lie between 1 and length")
    table = chunks(docs, "chunks")
    size = table.agg(F.sum("n_bytes")).first()[0] or 0
    least = partitions(docs.sparkSession)
    n = max(least, size * 2 // (length - gram + 2) // BUCKET_KEYS + 1)
    report = table.mapInArrow(_report(length, gram, n), "bucket int, chunk string, anchors binary, segs binary, checks binary, twice binary")
    codes = written(report.groupBy("bucket").applyInArrow(_decide(hot, length, gram), "bucket int, chunk string, mask binary, sent long, parted long"), "codes")
    sent, parted = (x or 0 for x in codes.agg(F.sum("sent"), F.sum("parted")).first())
    n_send = max(least, sent * (2 * length - gram) // BUCKET_BYTES + 1)
    n_parted = max(least, parted // BUCKET_BYTES + 1)
    asked = table.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(_send(length, gram, n_send, n_parted), "kind int, bucket int, chunk string, x binary, y binary, z binary")
    dealt = asked.repartition(max(least, (n_send + (n_parted if parted else 0)) // TASK_BUCKETS + 1), "kind", "bucket")
    answers = dealt.groupBy("kind", "bucket").applyInArrow(_answer(length), "kind int, bucket int, chunk string, mask binary")
    marks = codes.select(F.lit(0).alias("kind"), "bucket", "chunk", "mask").unionAll(answers)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return table.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_remove(length, gram, n_send, n_parted, with_text), schema)

"""Substring deduplication by difference-cover anchors.

A passage of ``window`` words that occurs twice is found by hashing shorter windows at the positions
of a difference cover only: for the perfect difference set D of period v any two positions i, j have a
shift d < v with i + d and j + d both in D modulo v. So two equal passages of ``window`` words share an
anchor of ``window - v + 1`` words at aligned positions. Anchors that occur once in the corpus end there;
around each repeated anchor the match is extended to whole windows, which are compared as such.

Contract: null text has no words; a null doc_id comes after all others; of rows with one doc_id the order
is that of the chunks they were packed in; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm._chunks import Chunk, chunks, cut, each_chunk, joined_mask
from textquarry.llm._shared import partitions, written
from textquarry.llm._words import split_words

#: Perfect difference sets: period and members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Anchors that one bucket is to hold.
BUCKET_KEYS = 1 << 21


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@np.errstate(over="ignore")
def rolling(x: np.ndarray, n: int, mult: np.uint64) -> np.ndarray:
    """Polynomial hash of each ``n`` consecutive values, built from powers of two."""
    if len(x) < n:
        return np.zeros(0, np.uint64)
    out, have, power, width, mult_width = None, 0, x, 1, mult
    while True:
        if n & width:
            if out is None:
                out, out_mult = power, mult_width
            else:
                m = len(x) - (have + width) + 1
                out, out_mult = out[:m] + out_mult * power[have : have + m], out_mult * mult_width
            have += width
        if have == n:
            return _mix(out[: len(x) - n + 1])
        power = power[: len(power) - width] + mult_width * power[width:]
        mult_width, width = mult_width * mult_width, width * 2


class Scan:
    """The words of a chunk as hashes, and where its windows lie."""

    def __init__(self, chunk: Chunk, window: int, period: int):
        with np.errstate(over="ignore"):
            self.chunk, self.window, self.period, self.width = chunk, window, period, window - period + 1
            index, self.counts, words = split_words(chunk.texts())
            h = [xxhash.xxh3_128_intdigest(w) for w in words]
            self.hi = np.array([x >> 64 for x in h], np.uint64)[index]
            self.lo = np.array([x & 0xFFFFFFFFFFFFFFFF for x in h], np.uint64)[index]
            self.begin = np.cumsum(self.counts) - self.counts
            self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
            self.pos = np.arange(len(index)) - self.begin[self.doc]
            self.left = self.counts[self.doc] - self.pos
            h = rolling(self.hi, self.width, MULT[0])
            n = len(h)
            cover = np.isin(np.arange(period), COVERS[period])
            self.anchor_at = np.flatnonzero(cover[self.pos[:n] % period] & (self.left[:n] >= self.width) & (self.counts[self.doc[:n]] >= window))
            self.keys, self.inverse, count = np.unique(h[self.anchor_at], return_inverse=True, return_counts=True)
            self.twice = count > 1

    def candidates(self, repeated: np.ndarray) -> None:
        """Extend: the windows that hold a repeated anchor; the first here of each sort of them, sorted by hash."""
        with np.errstate(over="ignore"):
            hit = np.zeros(len(self.pos) + 1, np.int64)
            hit[self.anchor_at[repeated[self.inverse].astype(bool)] + 1] = 1
            seen = np.cumsum(hit)
            starts = np.flatnonzero(self.left >= self.window)
            starts = starts[seen[starts + self.period] > seen[starts]]
            a, b = rolling(self.hi, self.window, MULT[0])[starts], rolling(self.lo, self.window, MULT[1])[starts]
        order = np.lexsort((starts, b, a)) if len(starts) else np.zeros(0, np.int64)
        a, b, starts = a[order], b[order], starts[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.first, self.hash, self.check = starts[new], a[new], (b[new] >> np.uint64(32)).astype(np.uint32)
        self.later = starts[~new]


def _anchors(window: int, period: int, n_buckets: int):
    def run(batches):
        for chunk in each_chunk(batches):
            scan = Scan(chunk, window, period)
            rows = [(b, chunk.name, scan.keys[i:j].tobytes(), np.packbits(scan.twice[i:j]).tobytes()) for b, i, j in cut(scan.keys, n_buckets)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["bucket", "chunk", "keys", "twice"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """A byte for each key of each chunk: 1 if it occurs again anywhere."""
    keys = [np.frombuffer(k.as_py(), np.uint64) for k in table["keys"]]
    twice = [np.unpackbits(np.frombuffer(t.as_py(), np.uint8), count=len(k)) for t, k in zip(table["twice"], keys)]
    _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    again = (count > 1)[inverse] | np.concatenate(twice).astype(bool)
    masks = [m.astype(np.uint8).tobytes() for m in np.split(again, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "mask": pa.array(masks, pa.binary())})


def _windows(window: int, period: int, n_buckets: int):
    def run(left: pa.Table, right: pa.Table):
        rows = []
        for chunk in each_chunk([left]):
            scan = Scan(chunk, window, period)
            scan.candidates(joined_mask(right.to_pylist()))
            doc = scan.doc[scan.first]
            for b, i, j in cut(scan.hash, n_buckets):
                docs, at = np.unique(doc[i:j], return_inverse=True)
                rows.append((b, chunk.name, scan.hash[i:j].tobytes(), scan.check[i:j].tobytes(), chunk.ids[docs].tobytes(), chunk.nulls[docs].astype(np.uint8).tobytes(), at.astype(np.uint16 if len(docs) < 65536 else np.uint32).tobytes()))
        names, types = ["bucket", "chunk", "keys", "checks", "docs", "nulls", "at"], [pa.int32(), pa.string(), *[pa.binary()] * 5]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return run


def _earlier(table: pa.Table) -> pa.Table:
    """A byte for each window of each chunk: 1 if an equal one starts in an earlier document."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    key, check = np.concatenate(keys), np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in rows])
    at = [np.frombuffer(r["at"], np.uint16 if len(r["docs"]) // 8 < 65536 else np.uint32) for r in rows]
    doc = np.concatenate([np.frombuffer(r["docs"], np.int64)[a] for r, a in zip(rows, at)])
    null = np.concatenate([np.frombuffer(r["nulls"], np.uint8)[a] for r, a in zip(rows, at)])
    order = np.lexsort((doc, null, check, key))  # stable: equal documents keep the chunks' order
    key, check = key[order], check[order]
    later = np.zeros(len(key), np.uint8)
    later[order[1:]] = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
    masks = [m.tobytes() for m in np.split(later, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table({"bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "chunk": [r["chunk"] for r in rows], "mask": pa.array(masks, pa.binary())})


def _results(window: int, period: int, with_text: bool):
    def run(left: pa.Table, right: pa.Table):
        marks = right.to_pylist()
        for chunk in each_chunk([left]):
            scan = Scan(chunk, window, period)
            scan.candidates(joined_mask([r for r in marks if r["kind"] == 0]))
            later = np.concatenate([scan.later, scan.first[joined_mask([r for r in marks if r["kind"] == 1]).astype(bool)]])
            step = np.zeros(len(scan.pos) + 1, np.int64)
            np.add.at(step, later, 1)
            np.add.at(step, later + window, -1)
            gone = np.cumsum(step[:-1]) > 0
            removed, shas, texts = [], [], []
            for body, a, n in zip(chunk.docs(), scan.begin.tolist(), scan.counts.tolist()):
                words, out = body.split(), gone[a : a + n]
                removed.append(int(out.sum()))
                kept = b" ".join(words if not removed[-1] else [w for w, g in zip(words, out.tolist()) if not g])
                shas.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "replace"))
            out = {"doc_id": chunk.id_column(), "n_words": pa.array(scan.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
            return pa.table(out | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))
        raise ValueError("a mark without its chunk")

    return run


def dedup_substrings(docs: DataFrame, window: int = 20, period: int = 13, with_text: bool = False) -> DataFrame:
    """Remove each word that a window of ``window`` words covers which also starts earlier.

    Returns doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text. ``period`` is the
    period of the difference cover; anchors have ``window - period + 1`` words.
    """
    if period not in COVERS or not 1 <= window - period + 1:
        raise ValueError(f"period must be one of {sorted(COVERS)} and at most the window")
    table = chunks(docs, "chunks")
    size = table.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(partitions(docs.sparkSession), size // 16 // BUCKET_KEYS + 1)
    anchors = table.mapInArrow(_anchors(window, period, n), "bucket int, chunk string, keys binary, twice binary")
    repeated = written(anchors.groupBy("bucket").applyInArrow(_repeated, "bucket int, chunk string, mask binary"), "anchors")
    windows = table.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_windows(window, period, n), "bucket int, chunk string, keys binary, checks binary, docs binary, nulls binary, at binary")
    later = windows.groupBy("bucket").applyInArrow(_earlier, "bucket int, chunk string, mask binary")
    marks = repeated.select("chunk", F.lit(0).alias("kind"), "bucket", "mask").unionAll(later.select("chunk", F.lit(1).alias("kind"), "bucket", "mask"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return table.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_results(window, period, with_text), schema)

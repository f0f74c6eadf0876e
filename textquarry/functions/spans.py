"""Spans: structs of start and end (exclusive) in code points, found and compared without Python."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textquarry.functions.text import given_back


def regex_spans(text: Column, pattern: str, base: Column | int = 0) -> Column:
    """All matches of a Java pattern that never matches nothing: array<struct<start, end, text>>.

    The gaps between matches and the matches are two arrays; a match starts where the lengths of all gaps and
    matches before it end. Positions functions of regular expressions count UTF-16 units, this counts code points.
    """
    pattern = "(?iU)" + pattern
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    base = F.lit(base) if isinstance(base, int) else base.cast("int")
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def add(state, pair):
        start = state["at"] + F.length(pair["gap"])
        span = F.struct(start.alias("start"), (start + F.length(pair["hit"])).alias("end"), pair["hit"].alias("text"))
        return F.struct((start + F.length(pair["hit"])).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    return F.when(text.isNotNull(), F.aggregate(pairs, F.struct(base.alias("at"), empty.alias("out")), add, lambda s: s["out"]))


def text_spans(text: Column, pattern: str) -> Column:
    """All matches in long texts: array<struct<start, end, text>>.

    ``regex_spans`` copies what it has found for each further match, which is cheapest inside sentences; over whole
    documents with thousands of matches this takes time in proportion, in Python over Arrow batches: about a megabyte of text at once, and
    the spans of a batch as columns.
    """

    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])

    def found(texts: pa.Array) -> pa.Array:
        find, ends, a, b, hits = re.compile(pattern, re.I).finditer, [0], [], [], []
        for t in texts.to_pylist():
            for m in find(t or ""):
                a.append(m.start())
                b.append(m.end())
                hits.append(m.group())
            ends.append(len(a))
        spans = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(hits, pa.string())], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans, mask=pa.array(np.asarray(texts.is_null())))

    @arrow_udf("array<struct<start:int,end:int,text:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from given_back(batches, found)

    return run(text)


def occurrences(text: Column, term: Column) -> Column:
    """Starts of all occurrences of a non-empty term, overlapping ones too: array<int>."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - F.length(term), F.lit(0)))
    found = F.filter(starts, lambda i: F.substring(text, i + 1, F.length(term)) == term)
    return F.when(F.length(term) == 0, F.array().cast("array<int>")).when(F.contains(text, term), found).otherwise(F.array().cast("array<int>"))


def count_of(text: Column, term: Column) -> Column:
    """Occurrences that don't overlap, from the left."""
    return F.when(F.length(term) == 0, F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int"))


def first_at(text: Column, term: Column) -> Column:
    """Start of the first occurrence, -1 if there is none."""
    return F.position(term, text) - 1


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    return (outer_start <= start) & (start < end) & (end <= outer_end)


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(a, c) < F.least(b, d)


def crosses(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two spans overlap without one holding the other."""
    return ((a < c) & (c < b) & (b < d)) | ((c < a) & (a < d) & (d < b))


def substring_of(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start.cast("int") + 1, (end - start).cast("int"))


SCORED = "array<struct<start:int,end:int,type:string,score:double>>"


def nested(spans: list[dict]) -> list[dict]:
    """Greedy choice by score: a span goes if it crosses one that was chosen. Chosen ones that begin, or end, inside it are looked up by bisection."""
    starts, ends, kept = [], [], []
    for s in sorted(spans, key=lambda s: (-s["score"], s["start"], s["end"], s["type"])):
        a, b = s["start"], s["end"]
        begun = starts[bisect_right(starts, (a, math.inf)) : bisect_left(starts, (b, -math.inf))]
        ended = ends[bisect_right(ends, (a, math.inf)) : bisect_left(ends, (b, -math.inf))]
        if any(end > b for _, end in begun) or any(start < a for _, start in ended):
            continue
        insort(starts, (a, b))
        insort(ends, (b, a))
        kept.append(s)
    return sorted(kept, key=lambda s: (s["start"], s["end"], s["type"], s["score"]))


def without_crossings(spans: Column, kind: str = SCORED) -> Column:
    """Spans of a document (``kind``, by default ``SCORED``) but those that cross better ones. Nested, equal and adjacent ones stay.

    The result is sorted by start, end, type. It runs over Arrow batches: as an aggregate over arrays it would copy what it has for each span.
    """

    @arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            cuts = _cuts(lists)
            yield pa.concat_arrays([_uncrossed(lists.slice(lo, hi - lo)) for lo, hi in cuts]) if cuts else lists

    return run(spans)


#: Spans of documents that are decoded at once.
SPANS_AT_ONCE = 1 << 16


def _cuts(lists: pa.Array) -> list[tuple[int, int]]:
    """(from, to) of runs of lists that hold about ``SPANS_AT_ONCE`` spans together."""
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    at = np.flatnonzero(np.diff(np.cumsum(size) // SPANS_AT_ONCE, prepend=-1)).tolist()
    return list(zip(at, [*at[1:], len(lists)]))


def _uncrossed(lists: pa.Array) -> pa.Array:
    """Spans that touch no other are kept as they are, of pairs the better one if they cross; only larger clusters take ``nested``."""
    row, flat = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0))), lists.flatten()
    start, end, score = (np.asarray(flat.field(c)) for c in ("start", "end", "score"))
    order = np.asarray(pc.sort_indices(pa.table({"row": pa.array(row), **{c: flat.field(c) for c in ("start", "end", "type", "score")}}), [(c, "ascending") for c in ("row", "start", "end", "type", "score")])).astype(np.int64)
    row, start, end, score = row[order], start[order].astype(np.int64), end[order].astype(np.int64), score[order]
    keep = np.ones(len(order), bool)
    if len(order):
        # a cluster begins where a span starts at or after all ends before it in its document
        width = int(max(end.max(), start.max()) - min(start.min(), 0)) + 1
        low = int(min(start.min(), 0))
        reach = np.maximum.accumulate(row * width + np.maximum(end, start) - low)
        first = np.ones(len(order), bool)
        first[1:] = row[1:] * width + start[1:] - low >= reach[:-1]
        begin = np.flatnonzero(first)
        size = np.diff([*begin, len(order)])
        a = begin[size == 2]
        b = a + 1
        cross = (start[a] < start[b]) & (start[b] < end[a]) & (end[a] < end[b])
        better = score[a] >= score[b]  # of equal scores the one that starts first
        keep[b[cross & better]] = False
        keep[a[cross & ~better]] = False
        for lo, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
            spans = [{"start": int(start[k]), "end": int(end[k]), "type": "", "score": float(score[k]), "at": k} for k in range(lo, lo + n)]
            keep[lo : lo + n] = False
            keep[[s["at"] for s in nested(spans)]] = True
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(lists)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), flat.take(pa.array(order[keep])), mask=pa.array(np.asarray(lists.is_null())))


def token_windows(offsets: Column, length: int, stride: int) -> Column:
    """Windows of ``length`` tokens that overlap by ``stride``: array<struct<start, end>> of characters.

    offsets: array<struct<start, end>>; tokens without characters are left out.
    """
    if not 0 <= stride < length:
        raise ValueError("the stride must be smaller than the length")
    real = F.filter(offsets, lambda t: t["end"] > t["start"])
    n, step = F.size(real), length - stride
    last = F.greatest(F.ceil((n - length) / F.lit(step)), F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(real, k * step + 1, F.lit(length)))
    spans = F.transform(pieces, lambda w: F.struct(F.element_at(w, 1)["start"].alias("start"), F.element_at(w, -1)["end"].alias("end")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def character_tokens(text: Column) -> Column:
    """The default tokenizer: each character that is no white space is a token. One pass cuts the characters, as substrings begin at the text's start."""
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    placed = F.transform(characters, lambda c, i: F.struct(i.alias("start"), (i + 1).alias("end"), c.alias("c")))
    real = F.filter(placed, lambda t: ~t["c"].rlike(r"^(?U)\s?$"))
    return F.transform(real, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))


def token_of(offsets: Column, start: Column, end: Column) -> Column:
    """Tokens at which a span starts and ends, null where it isn't aligned: struct<first, last>, from 0."""
    first = F.array_position(F.transform(offsets, lambda t: F.when(t["end"] > t["start"], t["start"])), start) - 1
    last = F.array_position(F.transform(offsets, lambda t: F.when(t["end"] > t["start"], t["end"])), end) - 1
    return F.when((first >= 0) & (last >= first), F.struct(first.alias("first"), last.alias("last")))

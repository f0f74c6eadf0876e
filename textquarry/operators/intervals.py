"""Joins of spans by position: holding, overlap, and the first that holds.

Spans are half-open. Nothing is compared all against all within a document. A span of a length up to 2^k touches two
bins of width 2^k at most, so each span lies in the bins of its own level; spans of the other side look in at the levels
that it has. An equi-join on (document, level, bin) finds each pair once, in linear time plus the pairs
themselves, and a document with very many spans is dealt out by its bins. Overlap has no levels below ``WIDE``: nearly all
spans lie in one bin then, are shuffled once as compressed columns, and pairs are found along each bin's sorted starts. The first span that holds another needs no
pairs at all: only spans that reach further than all before them can be first, and of these the next end decides, which
is one sorted pass. Empty spans and spans with nulls meet nothing; a null key equals no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

Span = tuple[str, str]
SPAN: Span = ("start", "end")


def level(length: Column) -> Column:
    """The least k with 2^k >= length."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))


def _packed(rows: DataFrame, key: str, span: Span) -> DataFrame:
    a, b = (F.col(c).cast("long") for c in span)
    rows = rows.select(F.col(key).alias("k"), a.alias("a"), b.alias("b"), F.struct(*rows.columns).alias("row"))
    return rows.filter("k IS NOT NULL AND a < b").withColumn("level", level(F.col("b") - F.col("a")))


def _bins(a: Column, b: Column, lvl: Column) -> Column:
    return F.sequence(F.call_function("shiftright", a, lvl), F.call_function("shiftright", b - 1, lvl))


def _native(rows: DataFrame) -> DataFrame:
    """Each span in the bins of its own level, two at most."""
    return rows.withColumn("bin", F.explode(_bins(F.col("a"), F.col("b"), F.col("level"))))


def _visiting(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Each span in the bin that it starts in, at the levels of the other side from its own on."""
    levels = others.groupBy("k").agg(F.collect_set("level").alias("levels"))
    rows = rows.join(levels, "k").withColumn("at", F.explode(F.filter("levels", lambda x: x >= F.col("level")))).drop("levels", "level").withColumnRenamed("at", "level")
    return rows.withColumn("bin", F.call_function("shiftright", F.col("a"), F.col("level")))


def _met(left: DataFrame, right: DataFrame, holds: Column) -> DataFrame:
    left, right = left.alias("l"), right.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("k", "level", "bin")]
    return left.join(right, [*same, holds]).select(F.col("l.row").alias("left"), F.col("r.row").alias("right"))


def holding(outer: DataFrame, inner: DataFrame, key: str = "doc_id", outer_span: Span = SPAN, inner_span: Span = SPAN) -> DataFrame:
    """(left, right): each span of ``outer`` with each span of ``inner`` that lies within it, as structs of their rows."""
    o, i = _packed(outer, key, outer_span), _packed(inner, key, inner_span)
    return _met(_native(o), _visiting(i, o), (F.col("l.a") <= F.col("r.a")) & (F.col("r.b") <= F.col("l.b")))


#: The least level of overlap: bins of 65 536 positions.
WIDE = 16
#: Rows of a partition of overlap, about, and of what is packed at once; bytes of the latter; pairs that leave a worker at once.
ROWS, BYTES, PAIRS = 1 << 19, 1 << 25, 1 << 15


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for one partition as one compressed table, with steps and lengths for starts and ends."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        to = table.column("to").to_numpy()
        order = np.argsort(to, kind="stable")
        rows, to = table.drop_columns("to").take(pa.array(order)).combine_chunks().to_batches(), to[order]
        del table
        cuts = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(to)]):
            part = rows[0].slice(lo, hi - lo)
            start, end = (part.column(c).to_numpy() for c in "ab")
            part = part.set_column(0, "a", pa.array(np.diff(start, prepend=0))).set_column(1, "b", pa.array(end - start))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([to[lo]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["to", "rows"])

    held, n, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held, n, size = [*held, batch], n + batch.num_rows, size + batch.nbytes
        if n >= ROWS or size >= BYTES:
            yield from packed(held)
            held, n, size = [], 0, 0
    if held:
        yield from packed(held)
    pa.default_memory_pool().release_unused()


def _sweep(both: bool, rising: bool):
    """Pairs of a partition's rows. both: one table is both sides."""

    def pairs(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        starts = [np.cumsum(t.column("a").to_numpy()) for t in tables]
        table = pa.concat_tables(tables).combine_chunks()
        tables.clear()
        a, length, level, bin_, side, own = (table.column(c).to_numpy() for c in ("a", "b", "level", "bin", "side", "own"))
        a = np.concatenate(starts)
        b, lefts = a + length, table.column("l").chunk(0)
        rights = lefts if both else table.column("r").chunk(0)
        names = pc.dictionary_encode(table.column("k").chunk(0)).indices.to_numpy().astype(np.int64)
        bins, bin_at = np.unique(bin_, return_inverse=True)
        _, group = np.unique((names * 64 + level) * len(bins) + bin_at, return_inverse=True)
        order = np.lexsort((a, group))
        del table, starts, names, bin_at, length
        a, b, level, bin_, side, own, group = (x[order] for x in (a, b, level, bin_, side, own, group))
        # places in the order of (group, start), starts by their ranks
        values = np.unique(a)
        width = len(values) + 1
        place = group * width + np.searchsorted(values, a)
        here = np.arange(len(a))
        until = np.searchsorted(place, group * width + np.searchsorted(values, b))
        # a pair counts in the bin where its later start lies
        since = np.maximum(here + 1, np.searchsorted(place, group * width + np.searchsorted(values, bin_ << level)))
        del here, place, group, values
        found = []
        for s in (0,) if both or rising else (0, 1):
            for native in (True, False):  # one of a pair is at its own level
                mine = np.flatnonzero((side == s) & (own == native))
                theirs = np.flatnonzero(((side != s) | both) & (own | native))
                lo, hi = (np.searchsorted(theirs, x[mine]) for x in (since, until))
                found.append((s, mine, theirs, lo, np.maximum(hi - lo, 0)))
        order = pa.array(order)

        def shown(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            if rising:
                own_order = a[i] < a[j]
                i, j = i[own_order], j[own_order]
            if len(i):
                yield pa.RecordBatch.from_arrays([x.take(order.take(pa.array(k))) for x, k in ((lefts, i), (rights, j))], ["left", "right"])

        for s, mine, theirs, lo, n in found:
            ends = np.cumsum(n)
            for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                k = np.arange(at, min(at + PAIRS, int(ends[-1])))
                m = np.searchsorted(ends, k, side="right")
                i, j = mine[m], theirs[lo[m] + k - (ends[m] - n[m])]
                if s == 0:
                    yield from shown(i, j)
                if s == 1 or (both and not rising):
                    yield from shown(j, i)
        if both and not rising:  # each span overlaps itself
            alone = np.flatnonzero(own & (a >> level == bin_))
            for at in range(0, len(alone), PAIRS):
                yield from shown(alone[at : at + PAIRS], alone[at : at + PAIRS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for batch in batches for x in batch.column("rows")]
        if tables:
            yield from pairs(tables)
        pa.default_memory_pool().release_unused()

    return run


def overlapping(left: DataFrame, right: DataFrame, key: str = "doc_id", left_span: Span = SPAN, right_span: Span = SPAN, rising: bool = False) -> DataFrame:
    """(left, right): all pairs that have a position in common, as structs of their rows. rising: those whose left span starts first.

    The longer span's level decides where a pair meets, and the bin of its later start is the one that counts. A query asks
    first how many spans there are and at which levels; a table that is both sides is read and sent once.
    """
    both = left is right and left_span == right_span
    sides = [_packed(x, key, span).withColumn("level", F.greatest("level", F.lit(WIDE))) for x, span in ((left, left_span), (right, right_span))]
    asked = [x.agg(F.count("*").alias("n"), F.collect_set("level").alias("levels")).first() for x in (sides[:1] if both else sides)]
    if both:
        asked *= 2
    n = max(left.sparkSession.sparkContext.defaultParallelism, -(-sum(q.n for q in (asked[:1] if both else asked)) // ROWS))

    shapes = [x.schema["row"].dataType for x in sides]
    places = "lr"[: 1 if both else 2]

    def sent(side: int) -> DataFrame:
        higher = [F.lit(x) for x in sorted(asked[1 - side].levels) if x > WIDE]
        above = F.filter(F.array(*higher), lambda x: x > F.col("level")) if higher else F.array().cast("array<int>")
        rows = sides[side].withColumn("own", F.col("level")).withColumn("level", F.explode(F.concat(F.array("level"), above)))
        own = [(F.col("row") if p == places[side] else F.lit(None).cast(shapes["lr".index(p)])).alias(p) for p in places]
        return _native(rows).select("a", "b", "k", "level", "bin", F.lit(side).alias("side"), (F.col("own") == F.col("level")).alias("own"), *own)

    rows = sent(0) if both else sent(0).unionAll(sent(1))
    rows = rows.withColumn("to", F.pmod(F.xxhash64("k", "level", "bin"), F.lit(n)).cast("int"))
    dealt = rows.mapInArrow(_pack, "to int, rows binary").repartitionById(n, F.col("to"))
    return dealt.mapInArrow(_sweep(both, rising), StructType([StructField("left", shapes[0]), StructField("right", shapes[1])]))


def first_holding(inner: DataFrame, outer: DataFrame, key: str = "doc_id", inner_span: Span = SPAN, outer_span: Span = SPAN, name: str = "held_by") -> DataFrame:
    """``inner`` with the first span of ``outer`` that it lies within (by start, end, then all columns), a struct or null.

    A span that doesn't reach further than those before it is never first. Of the others ends rise with starts, so the
    next end at or after a span's own is the only candidate.
    """
    kind = dict(inner.dtypes)[key]
    names = outer.columns
    o = outer.select(F.col(key).alias("k"), *(F.col(c).cast("long").alias(n) for c, n in zip(outer_span, "ab")), F.struct(*outer_span, *(c for c in names if c not in outer_span)).alias("row"))
    before = Window.partitionBy("k").orderBy("a", "b", "row").rowsBetween(Window.unboundedPreceding, -1)
    o = o.filter("k IS NOT NULL AND a < b").withColumn("reach", F.max("b").over(before)).filter("reach IS NULL OR b > reach")
    empty = F.lit(None).cast(inner.select(F.struct(*inner.columns).alias("x")).schema["x"].dataType)
    shape = o.schema["row"].dataType
    i = inner.select(F.col(key).alias("k"), *(F.col(c).cast("long").alias(n) for c, n in zip(inner_span, "ab")), F.lit(None).cast(shape).alias("row"), F.struct(*inner.columns).alias("own"))
    both = o.select(F.col("k").cast(kind).alias("k"), "a", "b", "row", empty.alias("own")).unionAll(i)
    onward = Window.partitionBy("k").orderBy(F.desc("b"), F.col("own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("next", F.last("row", ignorenulls=True).over(onward)).filter("own IS NOT NULL")
    held = (F.col("k").isNotNull()) & (F.col("a") < F.col("b")) & (F.col(f"next.{outer_span[0]}") <= F.col("a"))
    return both.select("own.*", F.when(held, F.struct(*(F.col(f"next.{c}").alias(c) for c in names))).alias(name))

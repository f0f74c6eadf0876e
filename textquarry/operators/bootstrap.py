"""Paired bootstrap by hashed resampling: the same draws for any partitioning.

Each replicate draws as many rows of a class as it has, with replacement. How often a row is drawn is settled in one of
two ways:

- ``slots``: every slot of a class gets a hashed row number. Any SQL engine can repeat it, but a draw is a row of a shuffle, in
  ``draws``, or a byte or two of one, in ``slot_sums``: sorted numbers, as steps;
- ``split``: rows are numbered by hash; a class of n rows has n draws, which are parted between the halves of its numbers by
  a binomial draw, again and again, down to blocks of ``LEAF`` rows, and within a block by a multinomial draw. The generator
  of a node is seeded by (seed, class, node), so each task walks down to its own rows without asking the others, all
  replicates at once. Only sums are shuffled. Draws are those of numpy's generator and may differ between its versions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.stats import f1
from textquarry.operators.metrics import macro_f1
from textquarry.operators.ranking import hash_rank
from textquarry.session import spread


def draw(replicate: Column, slot: Column, size: Column, seed: int) -> Column:
    """The row number, from 0, that a slot of a replicate draws out of ``size``: 48 bits of a hash, modulo size."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), slot.cast("string")), 256)
    return F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("long"), size)


def draws(rows: DataFrame, id_: str, replicates: int, seed: int, group: list[str] | None = None) -> DataFrame:
    """(id, group, replicate, times): how often each row is drawn, rows that aren't are left out."""
    by = group or []
    base = rows.select(id_, *by)
    if not by:
        base = base.withColumn("_g", F.lit(0))
    keys = by or ["_g"]
    ranked = hash_rank(base, keys, F.sha2(F.col(id_).cast("string"), 256), id_).withColumn("_slot", F.col("rank") - 1)
    at = F.concat_ws(":", *keys, "_slot") if by else F.col("_slot").cast("string")
    # ranks are small rows, which adaptive execution puts into a few tasks; each of them makes as many rows as there are replicates
    slots = spread(ranked.select(*keys, "group_size", at.alias("_s"))).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = slots.select(*keys, "replicate", draw(F.col("replicate"), F.col("_s"), F.col("group_size"), seed).alias("_d"))
    # rows meet by the number they draw: counting them and joining the number's row take this one shuffle
    drawn = drawn.repartition(*keys, "_d").groupBy(*keys, "replicate", "_d").agg(F.count("*").alias("times"))
    numbered = ranked.select(id_, *keys, F.col("_slot").alias("_d"))
    return drawn.join(numbered, [*keys, "_d"]).select(id_, *by, "replicate", "times")


#: Rows of a class that share one multinomial draw.
LEAF = 64


def split_times(numbers: np.ndarray, size: int, replicates: int, key: tuple[int, ...]) -> np.ndarray:
    """How often the rows with these sorted numbers (from 0) are drawn, out of ``size``: a row for each, a column for each replicate."""
    out = np.zeros((len(numbers), replicates), np.int64)
    nodes = [(0, size, 0, len(numbers), np.full(replicates, size, np.int64))] if len(numbers) else []
    while nodes:
        lo, hi, i, j, left = nodes.pop()
        generator = np.random.default_rng([*key, lo, hi])
        if hi - lo <= LEAF:
            out[i:j] = generator.multinomial(left, np.full(hi - lo, 1 / (hi - lo)))[:, numbers[i:j] - lo].T
            continue
        mid = (lo + hi) // 2
        first, k = generator.binomial(left, (mid - lo) / (hi - lo)), i + int(np.searchsorted(numbers[i:j], mid))
        nodes += [n for n in ((lo, mid, i, k, first), (mid, hi, k, j, left - first)) if n[2] < n[3]]
    return out


def _sums(replicates: int, seed: int):
    def run(batches):
        for batch in batches:
            group, number, size = (np.array(batch.column(k).to_pylist(), object if k == 0 else np.int64) for k in range(3))
            times = np.zeros((batch.num_rows, replicates), np.int64)
            for g in set(group.tolist()):
                own = np.flatnonzero(group == g)
                own = own[np.argsort(number[own])]
                times[own] = split_times(number[own], int(size[own[0]]), replicates, (seed, zlib.crc32(g.encode())))
            lists = batch.column(3)
            cells = lists.flatten().dictionary_encode()
            code, names = cells.indices.to_numpy(zero_copy_only=False), cells.dictionary.to_pylist()
            amount = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            row = pa.compute.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            for c, name in enumerate(names):
                own = code == c
                sums = amount[own] @ times[row[own]]
                yield pa.RecordBatch.from_arrays([pa.array([name] * replicates), pa.array(np.arange(replicates), pa.int32()), pa.array(sums, pa.int64())], ["cell", "replicate", "total"])

    return run


def split_sums(rows: DataFrame, id_: str, cells: Column, amounts: Column, replicates: int, seed: int, group: list[str] | None = None) -> DataFrame:
    """(cell, replicate, total): amounts times how often their rows are drawn, for rows with lists of cells (names) and amounts (long).

    ``id_`` tells the rows of a group apart and must not be null in more than one of them. An empty table has no sums.
    """
    kept = rows.select(F.to_json(F.array(*(group or [F.lit(0)]))).alias("g"), F.col(id_).cast("string").alias("i"), cells.alias("c"), amounts.cast("array<bigint>").alias("a"))
    ranked = hash_rank(kept, ["g"], F.sha2(F.coalesce("i", F.lit("")), 256), "i")
    found = ranked.select("g", F.col("rank") - 1, "group_size", "c", "a").mapInArrow(_sums(replicates, seed), "cell string, replicate int, total long")
    return found.groupBy("cell", "replicate").agg(F.sum("total").alias("total"))


#: Draws of a block of rows in all replicates; slots that are made at once; draws of a task.
BLOCK, SLOTS, TASK = 1 << 22, 1 << 16, 1 << 24


def _steps(size: int, width: int):
    """(replicate, number) → for each block of ``width`` numbers and replicate its draws, sorted, as steps from the block's start."""

    def packed(replicate: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        key = np.sort(replicate.astype(np.int64) * size + number)
        replicate, number = np.divmod(key, size)
        block = number // width
        cuts = np.flatnonzero((np.diff(replicate, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        steps = np.diff(number, prepend=0)
        steps[cuts] = number[cuts] - block[cuts] * width
        kinds = [np.min_scalar_type(x) for x in np.maximum.reduceat(steps, cuts)]
        found = [steps[lo:hi].astype(k).tobytes() for lo, hi, k in zip(cuts.tolist(), [*cuts[1:].tolist(), len(steps)], kinds)]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array(replicate[cuts], pa.int32()), pa.array([k.itemsize for k in kinds], pa.int32()), pa.array(found, pa.binary())], ["block", "replicate", "bytes", "steps"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in range(2)))
            n += batch.num_rows
            if n >= BLOCK:
                yield packed(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield packed(*map(np.concatenate, zip(*held)))

    return run


def _drawn_sums(columns: list[str], replicates: int):
    """Amounts of a block's rows times how often they are drawn, for each replicate."""

    def run(rows: pa.Table, draws: pa.Table) -> pa.Table:
        amounts = np.zeros((1 + max(rows.column("place").to_pylist(), default=-1), len(columns)), np.int64)
        amounts[rows.column("place").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in columns], axis=1)
        totals = np.zeros((replicates, len(columns)), np.int64)
        for replicate, size, steps in zip(*(draws.column(c).to_pylist() for c in ("replicate", "bytes", "steps"))):
            places = np.cumsum(np.frombuffer(steps, f"u{size}"), dtype=np.int64)
            totals[replicate] += np.bincount(places, minlength=len(amounts)) @ amounts
        return pa.table([pa.array(np.arange(replicates), pa.int32()), *(pa.array(x) for x in totals.T)], ["replicate", *columns])

    return run


def slot_sums(rows: DataFrame, columns: list[str], size: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, columns): sums over the rows that ``draws`` would draw. rows: a number from 0 to ``size`` and amounts (long)."""
    spark = rows.sparkSession
    width, chunks = max(1, BLOCK // replicates), max(1, -(-size // SLOTS))
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-size * replicates // TASK))
    lo = F.col("id") % chunks * SLOTS
    units = spark.range(0, chunks * replicates, 1, tasks) if size else spark.range(0)
    slots = units.select(F.floor(F.col("id") / chunks).cast("int").alias("replicate"), F.explode(F.sequence(lo, F.least(lo + SLOTS, F.lit(size)) - 1)).alias("slot"))
    drawn = slots.select("replicate", draw(F.col("replicate"), F.col("slot"), F.lit(size), seed).alias("number"))
    drawn = drawn.mapInArrow(_steps(size, width), "block long, replicate int, bytes int, steps binary").repartition(tasks, "block")
    rows = rows.select(F.expr(f"number div {width}").alias("block"), (F.col("number") % width).cast("int").alias("place"), *columns).repartition(tasks, "block")
    shape = ", ".join(["replicate int", *(f"{c} long" for c in columns)])
    sums = rows.groupBy("block").cogroup(drawn.groupBy("block")).applyInArrow(_drawn_sums(columns, replicates), shape)
    return sums.groupBy("replicate").agg(*(F.sum(c).alias(c) for c in columns))


def interval(deltas: DataFrame, observed: DataFrame, column: str = "delta") -> DataFrame:
    """observed, lower, upper (95 %, linear between ranks), replicates."""
    ci = deltas.agg(F.percentile(column, F.lit(0.025)).alias("lower"), F.percentile(column, F.lit(0.975)).alias("upper"), F.count("*").alias("replicates"))
    return observed.crossJoin(ci)  # two single rows


def _known(method: str) -> bool:
    if method not in ("split", "slots"):
        raise ValueError("methods are split and slots")
    return method == "split"


def paired_documents(counts: DataFrame, replicates: int = 600, seed: int = 31415, key: str = "doc_id", method: str = "split") -> DataFrame:
    """Micro F1 of a candidate minus a reference, over documents. counts: (key, correct_r, predicted_r, gold_r, correct_c, ...)."""
    columns = [f"{c}_{s}" for s in "rc" for c in ("correct", "predicted", "gold")]
    delta = lambda: f1(F.col("correct_c"), F.col("predicted_c"), F.col("gold_c")) - f1(F.col("correct_r"), F.col("predicted_r"), F.col("gold_r"))
    observed = counts.agg(*(F.sum(c).alias(c) for c in columns)).select(delta().alias("observed"))
    if _known(method):
        totals = split_sums(counts, key, F.array(*map(F.lit, columns)), F.array(*columns), replicates, seed)
        sums = totals.groupBy("replicate").agg(*(F.sum(F.when(F.col("cell") == c, F.col("total"))).alias(c) for c in columns))
        return interval(sums.select(delta().alias("delta")), observed)
    # numbered once, and read for their count, for the rows and for what was observed; a null key has a slot and no row
    amounts = [F.when(F.col(key).isNotNull(), F.coalesce(c, F.lit(0)).cast("long")).otherwise(0).alias(c) for c in columns]
    ranked = hash_rank(counts.select(key, *columns).withColumn("_g", F.lit(0)), ["_g"], F.sha2(F.col(key).cast("string"), 256), key)
    ranked = ranked.select(key, (F.col("rank") - 1).alias("number"), *columns).persist()
    sums = slot_sums(ranked.select("number", *amounts), columns, ranked.count(), replicates, seed)
    observed = ranked.agg(*(F.sum(c).alias(c) for c in columns)).select(delta().alias("observed"))
    return interval(sums.select(delta().alias("delta")), observed)


def paired_runs(rows: DataFrame, classes: int, replicates: int = 400, seed: int = 31415, key: str = "doc_id", method: str = "split") -> DataFrame:
    """Macro F1 of a candidate minus a reference, averaged over seeds, resampled within true classes.

    rows: (key, seed, truth, reference, candidate), the same keys for every seed. Otherwise the run stops.
    """
    sizes = rows.groupBy("seed").agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).agg(F.min("n").alias("a"), F.max("n").alias("b"), F.max("d").alias("c"), F.count("*").alias("s")).first()
    if sizes.a != sizes.b or sizes.c != sizes.b or rows.select(key).distinct().count() != sizes.b:
        raise ValueError("the runs don't hold the same rows")
    long = rows.select(key, "seed", "truth", F.explode(F.array(F.struct(F.lit("r").alias("side"), F.col("reference").alias("prediction")), F.struct(F.lit("c").alias("side"), F.col("candidate").alias("prediction")))).alias("x")).select(key, "seed", "truth", "x.side", "x.prediction")

    def deltas(cells: DataFrame, *by: str) -> DataFrame:
        scores = macro_f1(cells, classes, *by, "seed", "side")
        sign = F.when(F.col("side") == "c", F.col("macro_f1")).otherwise(-F.col("macro_f1"))
        return scores.groupBy(*by).agg((F.sum(sign) / F.count_distinct("seed")).alias("delta"))

    observed = deltas(long.groupBy("seed", "side", "truth", "prediction").agg(F.count("*").alias("n"))).select(F.col("delta").alias("observed"))
    if _known(method):
        # a row of each key with its cells, as many as there are runs times two
        name = F.to_json(F.struct("seed", "side", "truth", "prediction"))
        own = long.groupBy(key, "truth").agg(F.collect_list(name).alias("_cells"))
        totals = split_sums(own, key, F.col("_cells"), F.transform("_cells", lambda _: F.lit(1)), replicates, seed, ["truth"])
        shape = ", ".join(f"{c} {long.schema[c].dataType.simpleString()}" for c in ("seed", "side", "truth", "prediction"))
        cells = totals.filter("total > 0").select("replicate", F.from_json("cell", shape).alias("x"), F.col("total").alias("n")).select("replicate", "x.*", "n")
        return interval(deltas(cells, "replicate"), observed)
    one = rows.select(key, "truth").distinct()
    sampled = draws(one, key, replicates, seed, ["truth"]).join(long.drop("truth"), key)
    cells = sampled.groupBy("replicate", "seed", "side", "truth", "prediction").agg(F.sum("times").alias("n"))
    return interval(deltas(cells, "replicate"), observed)

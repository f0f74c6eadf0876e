"""Near copies by the exact Jaccard similarity of their shingles, found by SimHash and then at bands of minima.

A text is the set of its shingles of ``SHINGLE`` words (A-Z lower-cased, white space joined; a shorter text is
one shingle), and texts with equal sets are one node. First come the links of SimHash (``simhash.fingerprint_links``):
a spanning forest of the fingerprints that differ in 4 bits or fewer, and each further node of a fingerprint beside its
first; a link holds if the whole sets are similar. Fingerprints of 64 bits miss pairs near 0.8, so ``BANDS`` keys of
``ROWS`` minima each say which nodes are compared beside that: a pair at similarity s shares no key with probability
(1 - s ** ROWS) ** BANDS, which is 1.2e-7 at 0.8 and less above. Every pair that shares a key, and whose sizes and
``BITS`` allow ``SIMILAR``, is compared by its whole sets, unless links found before have joined the two already.

``BITS`` parities tell how many shingles of a set fall into each place. Two sets have at least as many shingles that only one
of them holds as parities that differ, and at ``SIMILAR`` at most a ninth of their sizes' sum: this bound loses no link.

So a group of near copies needs few of its pairs: keys with up to ``SMALL`` nodes give all pairs at once, of larger
ones some nodes, the pivots, are held against all others, round after round, until each key's nodes are joined or
compared. Pivots are chosen by hash among the nodes outside a key's largest group. A key's nodes and its pivots are dealt
out in blocks of about ``BLOCK``, so no task gathers a key, however many texts share it; keys with the same nodes count
once. Of a key whose nodes stay apart to the end all pairs that their sizes allow are compared, in these blocks.

Contract: null and empty texts have no shingles and are one node. Shingles and sets are told apart by 64 bits
of hash. Repeated rows are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm._graph import components
from textquarry.llm._shared import tidy, written
from textquarry.llm._words import split_words
from textquarry.llm.simhash import fingerprint_links, prints
from textquarry.llm.substrings import MULT, rolling

SHINGLE, SIMILAR = 5, 0.8
ROWS, BANDS = 5, 40
#: Parities of a set, which bound from below how much two sets differ.
BITS = 512
#: Nodes of a key that are compared all with all at once, and nodes held against the others in the first round of
#: larger keys; each round has ``MORE`` times as many.
SMALL, PIVOTS, MORE = 16, 4, 8
#: Nodes, and pivots, of one key that meet in one row; pairs that a task holds.
BLOCK, PAIRS = 2048, 1 << 20
#: Shingles whose minima are taken in one step.
STEP = 1 << 16

_RANDOM = np.random.default_rng(20).integers(0, 1 << 64, (2, ROWS * BANDS), dtype=np.uint64)
XOR, ODD = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    index, count, words = split_words(texts, "ascii")
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[index]
    whole, begin, out = rolling(h, n, MULT[0]), np.cumsum(count) - count, []
    for b, k in zip(begin.tolist(), count.tolist()):
        if k >= n:
            out.append(np.unique(whole[b : b + k - n + 1]))
        else:
            out.append(rolling(h[b : b + k], k, MULT[0]) ^ np.uint64(k) if k else np.zeros(0, np.uint64))
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set; sets without shingles get none."""
    out = np.full((len(sets), ROWS * BANDS), np.uint64(2**64 - 1))
    lo = 0
    while lo < len(sets):
        hi, n = lo + 1, len(sets[lo])
        while hi < len(sets) and n + len(sets[hi]) <= STEP:
            n += len(sets[hi])
            hi += 1
        own = [k for k in range(lo, hi) if len(sets[k])]
        if own:
            flat = np.concatenate([sets[k] for k in own])
            first = np.cumsum([0, *(len(sets[k]) for k in own[:-1])])
            for p in range(ROWS * BANDS):
                x = (flat ^ XOR[p]) * ODD[p]
                out[own, p] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), first)
        lo = hi
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for r in range(ROWS):
        keys = (keys ^ out[:, r::ROWS]) * MULT[1]
        keys ^= keys >> np.uint64(29)
    return keys ^ np.arange(BANDS, dtype=np.uint64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BITS bits, as bytes, for each set: whether it has an odd number of shingles at a place."""
    out = np.zeros((len(sets), BITS // 8), np.uint8)
    for k, s in enumerate(sets):
        out[k] = np.packbits((np.bincount((s >> np.uint64(32)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(bool))
    return out


def _nodes(column: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = shingle_sets(part.column(column))
                node = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                keys = band_keys(sets).view(np.int64)
                ends = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                fp = prints(part.column(column)).view(np.int64)
                bits = pa.array([b.tobytes() for b in parities(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(node), pa.array(size), lists, pa.array(fp), bits], [*part.schema.names, "node", "size", "keys", "fp", "bits"])

    return run


def _sets(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1))], pa.binary())], ["node", "set"])


def meetings(node: np.ndarray, size: np.ndarray, group: np.ndarray, pivot: np.ndarray, bits: np.ndarray | None = None):
    """Pairs (u > v) of the pivots of one row with its other nodes of other groups that their sizes and bits allow, some at a time."""
    own, rest, us, vs, held = np.flatnonzero(pivot), np.flatnonzero(~pivot), [], [], 0
    for k in own.tolist():
        fits = rest[(group[rest] != group[k]) & (np.minimum(size[rest], size[k]) >= SIMILAR * np.maximum(size[rest], size[k]))]
        if bits is not None:
            apart = np.bitwise_count(bits[fits] ^ bits[k]).sum(axis=1, dtype=np.int64)
            fits = fits[apart <= (size[fits] + size[k]) * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-6]
        us.append(np.maximum(node[fits], node[k]))
        vs.append(np.minimum(node[fits], node[k]))
        held += len(fits)
        if held >= PAIRS or k == own[-1]:
            yield np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
            us, vs, held = [], [], 0


def _meet(batches):
    for batch in batches:
        for nodes in batch.column(0):
            fields = [nodes.values.field(k) for k in range(nodes.values.type.num_fields)]
            numbers = [f.to_numpy(zero_copy_only=False) for f in fields[:4]]
            bits = [np.frombuffer(b"".join(f.to_pylist()), np.uint64).reshape(len(f), -1) for f in fields[4:]]
            for pairs in meetings(*numbers, *bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["u", "v"])


def _apart(members: DataFrame) -> DataFrame:
    """(key, n, most, largest) of the keys of members (key, node, size, group) whose nodes are in more than one group."""
    groups = members.groupBy("key", "group").agg(F.count("*").alias("c"))
    keys = groups.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "group")).alias("top"))
    return keys.select("key", "n", F.col("top.c").alias("most"), F.col("top.group").alias("largest")).filter("n > most")


def _dealt(members: DataFrame, apart: DataFrame, pivots: int) -> DataFrame:
    """(nodes): rows of about ``BLOCK`` nodes and ``BLOCK`` pivots at most, so that each pivot of a key meets each node once."""
    rows = members.join(apart, "key").withColumn("outside", F.col("n") - F.col("most"))
    wanted = F.when(F.col("n") <= SMALL, F.col("outside")).otherwise(F.least(F.lit(pivots), F.col("outside")))
    drawn = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) < (F.lit(float(1 << 30)) * F.col("wanted") / F.col("outside"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda c: F.pmod(F.xxhash64("node", F.lit(c)), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    rows = rows.withColumn("wanted", wanted)
    fields = lambda pivot: [*("node", "size", "group"), F.lit(pivot).alias("pivot"), *(c for c in rows.columns if c == "bits")]
    held = rows.select("key", own("n").alias("a"), every("wanted").alias("b"), F.struct(*fields(False)).alias("r"))
    chosen = rows.filter((F.col("group") != F.col("largest")) & drawn).select("key", every("n").alias("a"), own("wanted").alias("b"), F.struct(*fields(True)).alias("r"))
    return held.unionAll(chosen).groupBy("key", "a", "b").agg(F.collect_list("r").alias("nodes")).select("nodes")


def _compare(similar: float):
    def run(batches):
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit[i] = both >= similar * (len(x) + len(y) - both)
            keep = pa.array(hit)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return run


def _links(rows: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose sets are at least ``similar``."""
    asked = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
    texts = rows.join(asked, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    sets = written(texts.mapInArrow(tidy(_sets), "node long, set binary"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(tidy(_compare(similar)), "u long, v long")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): pairs of nodes (node, fp) that connect those whose fingerprints differ in 4 bits or fewer: no more than nodes and forest links."""
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    end = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    linked = fingerprint_links(first.select("fp")).distinct().join(end("u"), "u").join(end("v"), "v").select("u_first", "v_first")
    same = nodes.join(first, "fp").filter("node <> first").select("node", "first")
    pairs = linked.unionAll(same).toDF("a", "b")
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """docs, of which column text is read, with a column group: equal for the rows that links of near copies join."""
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = written(docs.mapInArrow(tidy(_nodes(names.index("text"))), f"{fields}, node long, size long, keys array<long>, fp long, bits binary"), "nodes")
    nodes = rows.filter("size > 0").groupBy("node").agg(F.min("size").alias("size"), F.min("keys").alias("keys"))
    pairs = written(_simhash_pairs(rows.filter("size > 0").groupBy("node").agg(F.min("fp").alias("fp"))), "pairs")
    links = written(_links(rows, pairs, SIMILAR), "links")
    member = components(links)
    own = nodes.select(F.explode("keys").alias("key"), "node", "size")
    # keys with the same nodes, which copies give by the dozen, are one; both aggregations combine before the shuffle
    same = own.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("s"))
    keys = written(same.filter("n > 1").groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key"), "keys")
    own = written(own.join(keys, "key"), "members")
    bits = rows.groupBy(F.col("node").alias("w")).agg(F.min("bits").alias("bits"))
    pivots, most, first = PIVOTS, 1, True
    while most:
        each = own.join(member.withColumnRenamed("node", "w"), F.col("node") == F.col("w"), "left").select("key", "node", "size", F.coalesce("component", "node").alias("group"))
        each = written(each, "members")
        apart = written(_apart(each).filter(F.lit(first) | (F.col("n") > SMALL)), "apart")
        outside = F.col("n") - F.col("most")
        met, most = apart.agg(F.count("*"), F.max(F.when((F.col("n") > SMALL) & (outside > pivots), outside))).first()
        if met:
            own = each.join(apart.select("key"), "key", "left_semi").select("key", "node", "size")
            whole = each.join(bits, F.col("node") == F.col("w")).drop("w")
            new = _dealt(whole, apart, pivots).mapInArrow(_meet, "u long, v long").distinct()
            new = written(new.join(pairs, ["u", "v"], "left_anti"), "pairs")
            pairs = pairs.unionAll(new)
            if not new.isEmpty():
                links = links.unionAll(written(_links(rows, new, SIMILAR), "links"))
                member = components(links)
        pivots, first = pivots * MORE, False
    joined = rows.join(member.withColumnRenamed("node", "w"), F.col("node") == F.col("w"), "left")
    return joined.select(*names, F.coalesce("component", "node").alias("group"))

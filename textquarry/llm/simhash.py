"""Near-duplicates by SimHash, found at the anchors of covering codes.

A fingerprint is 64 bits. It is split into segments so that two fingerprints at most ``bits`` apart differ in
at most ``share`` bits in one segment. In each segment the words of a linear covering code are the anchors:
every point has an anchor within the covering radius R, so two points ``share`` apart meet at every anchor
that is within R of one of them if both are replicated to all anchors within R + share. Anchors are read off
the syndrome: the error patterns of weight R + share or less that have a point's syndrome lead to them.

At an anchor, all fingerprints are compared with each other in numpy and only a spanning forest of the links
leaves the task, so a group of near copies emits fewer links than it has members. An anchor with more than
``BLOCK`` members is split into blocks, and pairs of blocks are compared in tasks of their own.

Contract: null text has no words, and its fingerprint is zero; equal fingerprints are one node, whatever
their number; null doc_ids take part, but name no component (its id is null if all its doc_ids are). Repeated
rows are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm._graph import components
from textquarry.llm._shared import pick, tidy, written

#: Members that are compared in one step.
BLOCK = 2048
#: The generator polynomial of the binary Golay code: 23 bits, 12 of them free, covering radius 3.
GOLAY = 0b101011100011


def prints(texts: pa.Array, shingle: int = 4) -> np.ndarray:
    """The fingerprint of each text, unsigned."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        text = text.as_py() or b""
        words = (text.encode("utf-8", "replace") if isinstance(text, str) else text).lower().split()
        if not words:
            continue
        n = max(1, len(words) - shingle + 1)
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begin = np.concatenate([[0], ends[: n - 1]])
        end = ends[min(shingle, len(words)) - 1 :] - 1
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, n)
        total = np.zeros(64, np.int64)
        for k in range(0, n, 65536):
            total += np.unpackbits(h[k : k + 65536, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprint(docs: DataFrame, shingle: int = 4, drop_text: bool = False) -> DataFrame:
    """docs, of which column text is read, with a column fp: the fingerprint as a signed long."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            fp = pa.array(prints(batch.column(at), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if keep[k]), fp], [*(n for k, n in enumerate(names) if keep[k]), "fp"])

    names = docs.columns
    keep = [not (drop_text and k == at) for k in range(len(names))]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields) if keep[k])
    return docs.mapInArrow(tidy(run), f"{fields}, fp long")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp."""
    docs = pick(docs, "doc_id", "text")
    return with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")), shingle, drop_text=True)


class Code:
    """A linear covering code: its length, covering radius, and how a syndrome is found."""

    def __init__(self, columns: list[int], radius: int):
        self.n, self.radius = len(columns), radius
        self.columns = np.array(columns, np.int64)

    def syndromes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for i, c in enumerate(self.columns.tolist()):
            out ^= np.where((x >> np.uint64(i)) & np.uint64(1), c, 0)
        return out

    @lru_cache  # noqa: B019
    def patterns(self, weight: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Error patterns up to a weight, sorted by syndrome: patterns, first of each syndrome, count of each."""
        masks, found = [0], [0]
        for w in range(1, weight + 1):
            for bits in combinations(range(self.n), w):
                s = 0
                for b in bits:
                    s ^= int(self.columns[b])
                masks.append(sum(1 << b for b in bits))
                found.append(s)
        order = np.argsort(found, kind="stable")
        count = np.bincount(found, minlength=int(np.bitwise_or.reduce(self.columns)) + 1)
        return np.array(masks, np.uint64)[order], np.cumsum(count) - count, count

    def anchors(self, x: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, anchor) for every anchor within ``weight`` of each point."""
        masks, first, count = self.patterns(weight)
        s = self.syndromes(x)
        n = count[s]
        at = np.repeat(np.arange(len(x)), n)
        which = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[s][at]
        return at, x[at] ^ masks[which]


def golay() -> Code:
    columns, c = [], 1
    for _ in range(23):
        columns.append(c)
        c <<= 1
        if c >> 11:
            c ^= GOLAY
    return Code(columns, 3)


def hamming(n: int, bits: int) -> Code:
    """The Hamming code of 2**bits - 1 places; places beyond them are free."""
    return Code([*range(1, 2**bits), *[0] * (n - 2**bits + 1)], 1)


#: Name → (code, segments as (shift, bits)). Three segments leave 4 // 3 = 1 bit to the best one, two leave 2.
COVERS = {"coarse": (golay, ((0, 22), (22, 21), (43, 21))), "fine": (lambda: hamming(32, 5), ((0, 32), (32, 32)))}


def cover_for(n: int) -> str:
    """The cheaper cover for ``n`` fingerprints. coarse: 16 replicas, 4096 anchors in a segment; fine: 343 and 2**27."""
    cost = {"coarse": 16 * n + 0.01 * n * n * 5.3 * 3 / 4096, "fine": 343 * n + 0.01 * n * n * 171.5 * 2 / 2**27}
    return min(cost, key=cost.get)


def _replicate(cover: str, bits: int):
    make, segments = COVERS[cover]
    share = bits // len(segments)

    def run(batches):
        code = make()
        for batch in batches:
            every = np.asarray(batch.column(0)).view(np.uint64)
            for lo in range(0, len(every), 20_000):
                fp = every[lo : lo + 20_000]
                for k, (shift, width) in enumerate(segments):
                    x = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    at, anchor = code.anchors(x, code.radius + share)
                    yield pa.RecordBatch.from_arrays([pa.array((anchor | np.uint64(k << 40)).view(np.int64)), pa.array(fp[at].view(np.int64))], ["anchor", "fp"])

    return run


def forest(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links u-v among n nodes: (node, least node of its component)."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        rest = label[u] != label[v]
        u, v = u[rest], v[rest]
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def links(a: np.ndarray, b: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``a``, or of those between ``a`` and ``b`` and within them."""
    x = a if b is None else np.concatenate([a, b])
    us, vs = [], []
    for i in range(0, len(a), 256):
        row = a[i : i + 256, None]
        other = a[i:] if b is None else b
        u, v = np.nonzero(np.bitwise_count(row ^ other[None, :]) <= bits)
        us.append(u + i)
        vs.append(v + (i if b is None else len(a)))
        if sum(map(len, us)) > 1 << 20:  # a dense group: what is linked so far is enough
            node, root = forest(len(x), np.concatenate(us), np.concatenate(vs))
            us, vs = [node], [root]
    node, root = forest(len(x), np.concatenate(us), np.concatenate(vs))
    return x[node], x[root]


def _compare(bits: int):
    """Rows sorted by (anchor, i, j, side): the members of a pair of blocks follow each other."""

    def run(batches):
        held: list[np.ndarray] | None = None

        def found(key, fp, side):
            edges_u, edges_v = [], []
            if not len(key):
                return edges_u, edges_v
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            size = np.diff(np.append(first, len(key)))
            small = size <= 64
            # small groups: all pairs of all groups at once, by their distance in the sorted order
            where = np.repeat(np.arange(len(first)), size)
            keep = small[where] & (size[where] > 1)
            f, g = fp[keep], where[keep]
            for step in range(1, 64):
                if len(f) <= step:
                    break
                hit = np.flatnonzero((g[step:] == g[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= bits))
                edges_u.append(f[hit + step])
                edges_v.append(f[hit])
                if not (g[step:] == g[:-step]).any():
                    break
            for k in np.flatnonzero(~small).tolist():
                own, s = fp[first[k] : first[k] + size[k]], side[first[k] : first[k] + size[k]]
                i, j = key[first[k], 1], key[first[k], 2]
                u, v = links(own, None, bits) if i == j else links(own[s == 0], own[s == 1], bits)
                edges_u.append(u)
                edges_v.append(v)
            return edges_u, edges_v

        def flush(key, fp, side):
            u, v = found(key, fp, side)
            if u:
                u, v = np.concatenate(u), np.concatenate(v)
                lo, hi = np.minimum(u.view(np.int64), v.view(np.int64)), np.maximum(u.view(np.int64), v.view(np.int64))
                pairs = np.unique(np.stack([hi, lo], 1), axis=0)
                ids, inverse = np.unique(pairs, return_inverse=True)
                inverse = inverse.reshape(pairs.shape)
                node, root = forest(len(ids), inverse[:, 0], inverse[:, 1])  # of all links seen here, a forest
                return pa.RecordBatch.from_arrays([pa.array(ids[node]), pa.array(ids[root])], ["u", "v"])
            return None

        for batch in batches:
            key = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)], 1)
            fp, side = np.asarray(batch.column(3)).view(np.uint64), np.asarray(batch.column(4))
            if held is not None:
                key, fp, side = (np.concatenate([h, x]) for h, x in zip(held, (key, fp, side)))
            if len(key) < 200_000:
                held = [key, fp, side]
                continue
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            end = int(last[-1]) + 1 if len(last) else 0
            if out := flush(key[:end], fp[:end], side[:end]):
                yield out
            held = [key[end:], fp[end:], side[end:]]
        if held is not None and (out := flush(*held)):
            yield out

    return run


def fingerprint_links(distinct: DataFrame, bits: int = 4, cover: str | None = None) -> DataFrame:
    """(u, v): links that connect the fingerprints (column fp, each once) that are at most ``bits`` apart."""
    cover = cover or cover_for(distinct.count())
    if len(COVERS[cover][1]) > bits + 1:
        raise ValueError("more segments than differing bits")
    replicas = distinct.select("fp").mapInArrow(_replicate(cover, bits), "anchor long, fp long")
    large = replicas.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    large = large.select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = replicas.join(large, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = placed.select("anchor", "fp", own.alias("own"), other.alias("other"))
    pairs = pairs.select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", (F.col("own") > F.col("other")).cast("int").alias("side"))
    dealt = pairs.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "side", "fp")
    return dealt.mapInArrow(tidy(_compare(bits)), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, cover: str | None = None) -> DataFrame:
    """doc_id, fp (signed long) and component_id: the smallest doc_id that links lead to, its own included."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    member = components(fingerprint_links(distinct, bits, cover))
    names = distinct.join(member, distinct.fp == member.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    best = names.groupBy("component").agg(F.min("least").alias("component_id"))
    names = names.join(best, "component").select(F.col("fp").alias("p"), "component_id")
    return prints.join(names, prints.fp == names.p).select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

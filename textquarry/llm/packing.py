"""Packing along a space-filling curve.

A document's tokens are hashed into a vector, which a fixed projection takes to ``DIMS`` dimensions; the place
of the projection on a Hilbert curve is the document's sort key. Documents are sorted by key in ranges, and the
sorted ids are cut every ``length`` tokens, so that neighbours on the curve share sequences and no sequence but
the last is short. The rest is cut into sequences whose lengths are powers of two, which need no padding.

Only (key, doc_id, number of tokens) is sorted; the ids wait in a table and meet their global place by a join.
What the driver sees is the number of tokens of each sorted partition.

Contract: null and empty texts have the end token alone. Equal keys are in the order of doc_id (nulls first).
Repeated rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm._bpe import Encoder
from textquarry.llm._shared import partitions, pick, tidy, written

DIMS, BITS, HASHED = 4, 12, 256


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates (Skilling 2004), dims * bits <= 63."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(up, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve(ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sort key of each document; ids: those of all documents, count: how many each has."""
    doc = np.repeat(np.arange(len(count)), count)
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    bag = np.bincount(doc * HASHED + h.astype(np.int64), minlength=len(count) * HASHED).reshape(-1, HASHED).astype(np.float64)
    bag /= np.sqrt((bag**2).sum(1, keepdims=True)) + 1e-12
    at = bag @ np.random.default_rng(11).normal(0, 1, (HASHED, DIMS))
    return hilbert(np.minimum((1 / (1 + np.exp(-1.7 * at)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _tokenize(path: str, end: int):
    def run(batches):
        encoder, part, made = None, TaskContext.get().partitionId(), 0
        for batch in batches:
            encoder = encoder or Encoder(path)
            for lo in range(0, batch.num_rows, 512):
                docs = batch.slice(lo, 512)
                ids, count = encoder(docs.column(1))
                ids = np.insert(ids, np.cumsum(count), end).astype(encoder.vocab.type)
                count = count + 1
                ends = np.cumsum(count)
                zip_ = zstandard.ZstdCompressor(level=1).compress
                body = [zip_(ids[a:b].tobytes()) for a, b in zip((ends - count).tolist(), ends.tolist())]
                uid = (part << 33) + made + np.arange(len(count))
                made += len(count)
                yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(uid, pa.int64()), pa.array(curve(ids, count), pa.int64()), pa.array(count, pa.int64()), pa.array(np.full(len(count), encoder.vocab.type().itemsize), pa.int32()), pa.array(body, pa.binary())], ["doc_id", "uid", "key", "n", "width", "ids"])

    return run


def _number(batches):
    """Where each document of a sorted partition starts in it."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.asarray(batch.column(1))
        ends = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(np.full(len(n), part), pa.int64())], ["u", "at", "tokens", "part"])
        before = int(ends[-1]) if len(ends) else before


def tail(total: int, length: int) -> list[tuple[int, int]]:
    """(begin, end) of the sequences of the last, incomplete ``length`` tokens: powers of two."""
    at, rest, out = total - total % length, total % length, []
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, at + size))
        at, rest = at + size, rest - size
    return out


def _cut(total: int, length: int, with_ids: bool):
    whole, ends = total // length, tail(total, length)
    last = np.array([b for b, _ in ends] + [total], np.int64)

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
        for batch in batches:
            out = [[] for _ in names]
            for doc_id, begin, n, width, body in zip(*(batch.column(k).to_pylist() for k in range(5))):
                ids = np.frombuffer(unzip.decompress(body, max_output_size=n * width), np.uint16 if width == 2 else np.uint32).astype("<u4")
                cuts = [begin]
                while cuts[-1] < begin + n:
                    p = cuts[-1]
                    edge = (p // length + 1) * length if p < whole * length else int(last[np.searchsorted(last, p, "right")])
                    cuts.append(min(edge, begin + n))
                for a, b in zip(cuts, cuts[1:]):
                    piece = ids[a - begin : b - begin].tobytes()
                    k = a // length if a < whole * length else whole + int(np.searchsorted(last, a, "right")) - 1
                    from_ = k * length if a < whole * length else int(last[k - whole])
                    for c, v in zip(out, (doc_id, a - begin, b - a, zlib.crc32(piece), n, k, a - from_, piece)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(out)], names)

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens; ``end`` follows each document.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and, if asked for, ids: the
    piece's ids as little-endian unsigned 32-bit numbers. ``tokenizer`` is the path of a vocabulary file that
    all executors have.
    """
    docs = pick(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    spark = docs.sparkSession
    table = written(docs.mapInArrow(tidy(_tokenize(tokenizer, end)), "doc_id long, uid long, key long, n long, width int, ids binary"), "tokens", "uncompressed")
    order = table.select("key", "doc_id", "uid", "n").repartitionByRange(partitions(spark), "key", "doc_id", "uid").sortWithinPartitions("key", "doc_id", "uid")
    places = written(order.select("uid", "n").mapInArrow(_number, "u long, at long, tokens long, part long"), "places")
    sums = sorted((r.part, r.tokens) for r in places.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect())  # one row for each partition
    total, before = 0, []
    for part, tokens in sums:
        before.append((part, total))
        total += tokens
    if not total:
        return spark.createDataFrame([], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
    bases = F.broadcast(spark.createDataFrame(before, "p long, base long"))
    begin = places.join(bases, F.col("part") == F.col("p")).select("u", (F.col("at") + F.col("base")).alias("begin"))
    placed = table.join(begin, F.col("uid") == F.col("u")).select("doc_id", "begin", "n", "width", "ids")
    return placed.mapInArrow(tidy(_cut(total, length, with_ids)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))

"""Documents packed into chunks, and a distributed test of which keys occur elsewhere.

A chunk is one row that holds some megabytes of whole documents, compressed. Operators that need
several passes over the text read it from the chunk table, which is a third of the text's size.
What a chunk asks of the other chunks travels as packed arrays: for each bucket of the key space one
row with the chunk's distinct keys, and back a mask with a bit or a code for each key. So the JVM
handles thousands of rows where there are millions of keys, and a key that a third of all documents
hold is sent once by each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textquarry.llm._shared import pick, written

#: Raw bytes and documents after which a chunk is full; a longer document makes a chunk of its own.
CHUNK_BYTES = 2 << 20
CHUNK_DOCS = 16384

SCHEMA = "chunk string, n_docs long, n_bytes long, ids binary, nulls binary, lens binary, body binary"


class Chunk:
    """doc_id, sorted (nulls last), and the UTF-8 bytes of the documents of one chunk."""

    def __init__(self, row: dict):
        self.name: str = row["chunk"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], np.uint8).astype(bool)
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.body: bytes = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(self.lens.sum())))
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens

    def __len__(self) -> int:
        return len(self.ids)

    def docs(self) -> Iterator[bytes]:
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            yield self.body[a:b]

    def texts(self) -> pa.Array:
        """The documents as strings, without a copy."""
        ends = np.concatenate([[0], self.ends])
        if len(self.body) >= 1 << 31:
            return pa.Array.from_buffers(pa.large_string(), len(self), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.body)])
        return pa.Array.from_buffers(pa.string(), len(self), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self.body)])

    def doc_id(self, i: int) -> int | None:
        return None if self.nulls[i] else int(self.ids[i])

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.nulls)


def _pack(name: str, ids: list, bodies: list[bytes]) -> pa.RecordBatch:
    nulls = np.array([i is None for i in ids], bool)
    values = np.array([0 if i is None else i for i in ids], np.int64)
    order = np.lexsort((values, nulls))
    bodies = [bodies[i] for i in order]
    lens = np.array([len(b) for b in bodies], np.int64)
    row = {
        "chunk": [name], "n_docs": [len(ids)], "n_bytes": [int(lens.sum())], "ids": [values[order].tobytes()], "nulls": [nulls[order].astype(np.uint8).tobytes()],
        "lens": [lens.tobytes()], "body": [zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))],
    }
    return pa.RecordBatch.from_pydict(row, pa.schema([("chunk", pa.string()), ("n_docs", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("lens", pa.binary()), ("body", pa.binary())]))


def _make(batches, most: int):
    part, made, ids, bodies, size = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            body = body.as_py() or b""
            ids.append(doc_id)
            bodies.append(body)
            size += len(body)
            if size >= most or len(ids) >= CHUNK_DOCS:
                yield _pack(f"{part:08d}-{made:08d}", ids, bodies)
                made, ids, bodies, size = made + 1, [], [], 0
    if ids:
        yield _pack(f"{part:08d}-{made:08d}", ids, bodies)


def chunks(docs: DataFrame, name: str, most: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of ``docs`` (doc_id, text; null text counts as empty), written to the shared folder."""
    docs = pick(docs, "doc_id", "text")
    docs = docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.cast("string").cast("binary").alias("text"))
    return written(docs.mapInArrow(lambda batches: _make(batches, most), SCHEMA), name, "uncompressed")


def each_chunk(batches) -> Iterator[Chunk]:
    """The chunks of some Arrow batches or tables, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(batch.slice(i, 1).to_pylist()[0])


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit key; it rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cut(keys: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys."""
    b = buckets_of(keys, n)
    at = np.flatnonzero(np.diff(b, prepend=-1))
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(b)]):
        yield int(b[i]), i, j


def masks_by_chunk(masks: DataFrame) -> DataFrame:
    """(bucket, chunk, mask) → a row for each chunk with its masks in the order of the buckets."""
    from pyspark.sql import functions as F

    return masks.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "mask"))).alias("masks"))


def joined_mask(rows: list[dict] | None) -> np.ndarray:
    """The masks of one chunk as an array of a byte for each key."""
    rows = sorted(rows or [], key=lambda r: r["bucket"])
    return np.concatenate([np.frombuffer(r["mask"], np.uint8) for r in rows]) if rows else np.zeros(0, np.uint8)

"""Exact top-k search by inner product with a three-phase uniform threshold (TPUT, Cao and Wang 2004).

The dimensions are split into ``LISTS`` score lists; a vector's score is the sum of its scores in all lists. Rows stay
where they are: blocks of queries of bounded size are broadcast, one after another, and held against all rows.

1. A share of the rows gathers the heads of its score lists for each query and reports the best totals among them.
   The k-th best report is a safe cutoff: at least k rows reach it.
2. The cutoff c goes to all rows. A row whose total reaches c has at least c / LISTS in one list, so each task
   computes the score lists, in one product over all rows, and collects the entries that reach this uniform
   threshold in any list.
3. Only the collected entries' remaining scores are added up; those that reach (c, its vec_id) are sent, k of each
   tile at most, and ranked.

Contract: components are floor(scale * x), x as double; vectors that are null, empty or hold null or
non-finite components take no part; neither do rows with a null vec_id. Rows with a query's own vec_id are
not its candidates, repeated ones included; other repeated rows are candidates of their own, and ties
between them are in no order. Vectors of another length than the query's are not its candidates. Queries with
one vec_id but different vectors are all answered under this vec_id, as one list.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm._shared import pick, tidy, written

LISTS = 4
#: Rows and queries of a tile, whose lists are in memory at once.
ROWS, STEP = 4096, 256
#: Bytes of a block of queries, which is what a broadcast takes at most.
BLOCK_BYTES = 32 << 20
#: The share of rows that gives the cutoffs (1 / SHARE, LEAST rows at least), and how many heads of a list are gathered: HEADS * k.
SHARE, LEAST, HEADS = 32, 4096, 4


class Queries:
    """Queries of one length: ids, vectors, and cutoffs with their ids where they are known."""

    def __init__(self, rows: list):
        self.ids = np.array([r.vec_id for r in rows], np.int64)
        self.x = np.array([np.frombuffer(r.vec, np.int64) for r in rows], np.int64).reshape(len(rows), -1)
        self.most = int(np.abs(self.x).max(initial=0))
        self.cutoff, self.cutoff_id, self.known = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)

    def cut(self, cutoffs: dict[int, tuple[int, int]]) -> None:
        found = [cutoffs.get(i) for i in self.ids.tolist()]
        self.known = np.array([c is not None for c in found], bool)
        self.cutoff, self.cutoff_id = (np.array([0 if c is None else c[k] for c in found], np.int64) for k in (0, 1))


def lists(q: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """The score lists of all pairs, exact in the narrowest type."""
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * x.shape[1]
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    q, x = q.astype(kind), x.astype(kind)
    return [q[:, i] @ x[:, i].T for i in np.array_split(np.arange(x.shape[1]), min(LISTS, x.shape[1]))]


def resolved(scores: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The totals of some entries."""
    return np.sum([s[a, b] for s in scores], axis=0).astype(np.int64) if len(a) else np.zeros(0, np.int64)


def collected(scores: list[np.ndarray], queries: Queries, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """Entries that reach the uniform threshold in any list; all entries of queries without a cutoff."""
    least = np.where(queries.known[part], queries.cutoff[part] / len(scores), -np.inf)[:, None]
    reach = scores[0] >= least
    for s in scores[1:]:
        reach |= s >= least
    return np.nonzero(reach)


def heads(scores: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries among the k best of any list."""
    seen = np.zeros(scores[0].shape, bool)
    for s in scores:
        if s.shape[1] <= k:
            seen[:] = True
        else:
            np.put_along_axis(seen, np.argpartition(-s, k - 1, axis=1)[:, :k], True, axis=1)
    return np.nonzero(seen)


def tile(queries: Queries, part: slice, ids: np.ndarray, x: np.ndarray, k: int, final: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places of queries, places of rows, totals) of the k best entries of each query, and how many totals were resolved."""
    scores = lists(queries.x[part], x)
    a, b = collected(scores, queries, part) if final else heads(scores, HEADS * k)
    s, n = resolved(scores, a, b), len(a)
    a = a + part.start
    keep = queries.ids[a] != ids[b]
    if final:
        c = queries.cutoff[a]
        keep &= ~queries.known[a] | (s > c) | ((s == c) & (ids[b] <= queries.cutoff_id[a]))
    a, b, s = a[keep], b[keep], s[keep]
    order = np.lexsort((ids[b], -s, a))  # ties to the smaller id
    a, b, s = a[order], b[order], s[order]
    best = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[best], b[best], s[best], n


def _search(shared, k: int, final: bool):
    def run(batches):
        for batch in batches:
            dims, every = np.asarray(batch.column(1)), np.asarray(batch.column(0))
            for dim in np.unique(dims).tolist():
                queries = shared.value.get(dim)
                if queries is None:
                    continue
                own = np.flatnonzero(dims == dim)
                for at in np.array_split(own, -(-len(own) // ROWS)):
                    ids = every[at]
                    x = np.frombuffer(b"".join(batch.column(2).take(pa.array(at)).to_pylist()), np.int64).reshape(len(at), dim)
                    for lo in range(0, len(queries.ids), STEP):
                        a, b, s, _ = tile(queries, slice(lo, min(lo + STEP, len(queries.ids))), ids, x, k, final)
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(queries.ids[a]), pa.array(ids[b]), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def _pack(batches):
    """(vec_id, vec) → vec_id, dim, and the components as 64-bit numbers."""
    for batch in batches:
        vec = batch.column(1)
        ends, flat = np.asarray(vec.offsets), np.asarray(vec.values, np.int64)
        packed = pa.array([flat[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int32()), packed], ["vec_id", "dim", "vec"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """For each row of ``queries`` the k rows of ``vectors`` with the highest inner product of floor(scale * x).

    Both have vec_id and embedding. Returns query_id, rank, vec_id, score; ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        df = pick(df, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
        finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        whole = F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
        return df.filter("vec_id IS NOT NULL AND size(x) > 0").filter(finite).select("vec_id", whole.alias("vec")).mapInArrow(_pack, "vec_id long, dim int, vec binary")

    rows, asked = written(valid(vectors), "rows"), written(valid(queries).distinct(), "queries")
    n, size = rows.count(), asked.agg(F.coalesce(F.sum(F.octet_length("vec") + 40), F.lit(0))).first()[0]
    share = max(1, min(SHARE, n // LEAST))
    some = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0)
    blocks = size // BLOCK_BYTES + 1
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found = []
    for block in range(blocks):
        own: dict[int, list] = {}
        for r in asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect():  # about BLOCK_BYTES
            own.setdefault(r.dim, []).append(r)
        by_dim = {dim: Queries(rs) for dim, rs in own.items()}
        first = spark.sparkContext.broadcast(by_dim)
        cutoffs = ranked(some.mapInArrow(tidy(_search(first, k, False)), "query_id long, vec_id long, score long")).filter(F.col("rank") == k)
        reached = {r.query_id: (r.score, r.vec_id) for r in cutoffs.collect()}  # a row for each query of the block
        for q in by_dim.values():
            q.cut(reached)
        shared = spark.sparkContext.broadcast(by_dim)
        hits = rows.mapInArrow(tidy(_search(shared, k, True)), "query_id long, vec_id long, score long")
        if blocks == 1:
            found.append(hits)
        else:
            found.append(written(ranked(hits).drop("rank"), "hits"))
            shared.unpersist()
        first.unpersist()
    return ranked(reduce(DataFrame.unionAll, found)).select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    vectors = pick(vectors, "vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
      FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Indexed search: inverted tables of grams, so that a query reads a few postings and no texts but the likely ones.

An index is a folder of segments; each append is a segment of its own, and a record that is appended again replaces what
earlier segments say of it. ``postings`` (segment, shard, gram, block, ids) hold for each gram of one, two and three
lower-case characters the sorted numbers of the records with it, in blocks of some thousand records, so a gram that every
record has is many rows of a bounded size. ``texts`` (segment, part, id, extraction_id, record_id, text) hold the records.
Both are partitioned by what a query knows beforehand: the shards of its grams, then the parts of its candidates.

A record's number is a hash of its ids. Records that share one are candidates together and told apart by their ids, and
each candidate's text is searched itself, so neither hashes nor grams decide what is found.

Contract: null texts are records without grams and are never found. Of rows that repeat a record within one append the
greatest text holds. Terms are literal, parted by white space, and all must be there, whatever the case; terms of one and
two characters have grams of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.text import matches_terms

#: Shards of grams, parts of records, and records of a block.
SHARDS, PARTS, BLOCK = 32, 64, 4096
#: Characters of a block, at most some; (gram, record) pairs that are sorted at once, and grams that are written at once.
CHARACTERS, RUN, LISTS = 1 << 23, 1 << 20, 1 << 16
RECORD = ["extraction_id", "record_id"]
POSTINGS = "segment int, shard int, gram string, block int, ids array<long>"
TEXTS = "segment int, part int, id long, extraction_id string, record_id string, text string"


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` characters. A lookahead keeps this linear, where substrings would begin at the text's start each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def query_grams(spark: SparkSession, query: str) -> list[str]:
    """The grams that a text must have to be found: of each term those of three characters, or the whole shorter term."""
    terms = [t for t in query.split() if t]
    if not terms or len(query) > 200:
        raise ValueError("a search needs 1 to 200 characters")
    lowered = [r.t for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.lower("t").alias("t")).collect()]
    found = spark.createDataFrame([(t,) for t in lowered], "t string").select(F.explode(F.when(F.length("t") > 3, _grams(F.col("t"), 3)).otherwise(F.array("t"))).alias("g"))
    return sorted({r.g for r in found.collect()})


def _number() -> Column:
    return F.xxhash64(*RECORD)


def _shard(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SHARDS)).cast("int")


def _gram_codes(text: str) -> np.ndarray:
    """The different runs of one to three characters of a lower-cased text as numbers: 21 bits a character, one more than its code point."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    two = c[:-1] << np.uint64(21) | c[1:]
    parts = [c, two]
    if len(c) > 2:
        parts.append(two[:-1] << np.uint64(21) | c[2:])
    return np.unique(np.concatenate(parts))


def _characters(codes: np.ndarray) -> list[str]:
    """The grams that numbers stand for."""
    wide = np.stack([codes >> np.uint64(42), codes >> np.uint64(21) & np.uint64((1 << 21) - 1), codes & np.uint64((1 << 21) - 1)], 1)
    return ["".join(chr(x - 1) for x in row if x) for row in wide.tolist()]


def _runs(codes: list[np.ndarray], ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The (gram, id) pairs of some texts, sorted."""
    flat = np.concatenate(codes)
    number = np.repeat(np.array(ids, np.int64), [len(c) for c in codes])
    order = np.lexsort((number, flat))
    return flat[order], number[order]


def _inverted(batches):
    """(block, id, text lower-cased), sorted by block → (gram, block, ids sorted): one block in memory at a time, as numbers."""

    def lists(block: int, runs: list):
        flat, number = (np.concatenate([r[k] for r in runs]) for k in (0, 1))
        order = np.lexsort((number, flat))
        flat, number = flat[order], number[order]
        begin = np.flatnonzero(np.diff(flat, prepend=~flat[:1]))
        for lo in range(0, len(begin), LISTS):
            own = begin[lo : lo + LISTS]
            end = int(begin[lo + len(own)]) if lo + len(own) < len(begin) else len(flat)
            ids = pa.ListArray.from_arrays(pa.array([*(own - own[0]), end - own[0]], pa.int32()), pa.array(number[own[0] : end]))
            yield pa.RecordBatch.from_arrays([pa.array(_characters(flat[own]), pa.string()), pa.array(np.full(len(own), block, np.int32)), ids], ["gram", "block", "ids"])

    at, runs, codes, ids, held = None, [], [], [], 0
    for batch in batches:
        for block, i, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if block != at:
                if codes:
                    runs.append(_runs(codes, ids))
                if runs:
                    yield from lists(at, runs)
                at, runs, codes, ids, held = block, [], [], [], 0
            if text:
                codes.append(_gram_codes(text))
                ids.append(i)
                held += len(codes[-1])
                if held >= RUN:
                    runs.append(_runs(codes, ids))
                    codes, ids, held = [], [], 0
    if codes:
        runs.append(_runs(codes, ids))
    if runs:
        yield from lists(at, runs)


def append(records: DataFrame, path: str, segment: int) -> None:
    """Add records (extraction_id, record_id, text) as a segment; it must be new, and later segments have greater numbers.

    Blocks are ranges of the records' numbers, as many as make each some ``BLOCK`` records. A block's texts meet in one task,
    which turns them into lists as sorted numbers, so texts are shuffled and not the many times larger rows of grams.
    """
    rows = records.select(*(F.col(c).cast("string").alias(c) for c in RECORD), F.col("text").cast("string").alias("text"))
    rows = rows.groupBy(*RECORD).agg(F.max("text").alias("text")).withColumn("id", _number())
    rows.withColumn("part", F.pmod("id", F.lit(PARTS)).cast("int")).repartition(PARTS, "part").sortWithinPartitions("part", "id").write.partitionBy("part").parquet(f"{path}/texts/segment={segment}")
    kept = records.sparkSession.read.schema(TEXTS).parquet(f"{path}/texts").filter(F.col("segment") == segment)
    n, characters = kept.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-characters // CHARACTERS))
    block = F.pmod(F.shiftright("id", 8), F.lit(blocks)).cast("int")
    each = kept.filter("text IS NOT NULL").select(block.alias("block"), "id", F.lower("text").alias("text"))
    dealt = each.repartition(min(blocks, 2 * records.sparkSession.sparkContext.defaultParallelism), "block").sortWithinPartitions("block")
    lists = dealt.mapInArrow(_inverted, "gram string, block int, ids array<long>").withColumn("shard", _shard(F.col("gram")))
    lists.sortWithinPartitions("shard", "gram").select("gram", "block", "ids", "shard").write.partitionBy("shard").parquet(f"{path}/postings/segment={segment}")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id) of the records that have all grams of a query, each segment's blocks by themselves."""
    wanted = query_grams(spark, query)
    shards = sorted({r.s for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(_shard(F.col("g")).alias("s")).collect()})
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter(F.col("shard").isin(shards) & F.col("gram").isin(wanted))
    lists = rows.groupBy("segment", "block").agg(F.collect_list("ids").alias("lists")).filter(F.size("lists") == len(wanted))
    both = F.aggregate(F.slice("lists", 2, len(wanted)), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return lists.select(F.explode(both).alias("id")).distinct()


def find(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(extraction_id, record_id, text) of all records that hold every term, as the last segment has them."""
    near = candidates(spark, path, query).withColumn("part", F.pmod("id", F.lit(PARTS)).cast("int"))
    texts = spark.read.schema(TEXTS).parquet(f"{path}/texts")
    held = texts.join(near, ["part", "id"], "left_semi").groupBy(*RECORD).agg(F.max_by(F.struct("text"), "segment").alias("t"))
    return held.select(*RECORD, "t.text").filter(matches_terms(F.col("text"), query))


def search(spark: SparkSession, path: str, query: str, most: int = 50) -> DataFrame:
    """The first ``most`` of what ``find`` finds, by their ids."""
    return find(spark, path, query).orderBy(*RECORD).limit(most)


def segments(spark: SparkSession, path: str) -> list[int]:
    """The numbers of an index's segments."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/texts")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removeprefix("segment=")) for n in names if n.startswith("segment="))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write all segments as the first segment of a new index: each record once, as the last segment has it."""
    texts = spark.read.schema(TEXTS).parquet(f"{path}/texts").groupBy(*RECORD).agg(F.max_by(F.struct("text"), "segment").alias("t"))
    append(texts.select(*RECORD, "t.text"), to, 0)

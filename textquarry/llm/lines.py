"""Line deduplication with DataFrame functions alone.

Lines are exploded, their normalised keys hashed to 128 bits, and distinct documents counted for each
key in two partial aggregations, so that a line which a third of all documents hold is combined before it
is shuffled. Only (key, document, position) travels to the decisions; the texts are shuffled once, to meet
the positions that they lose.

Contract: null and empty texts are one empty line. Documents are told apart by doc_id; a null doc_id is no
document: it doesn't count, and it keeps no frequent line. Rows that repeat a doc_id with another text keep
their own lines, and count as one document. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm._shared import pick, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def _digest(x: Column) -> list[Column]:
    return [F.xxhash64(x), F.xxhash64(F.lit("line"), x)]


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Drop the lines whose key has at least ``min_chars`` code points and is found in at least ``min_docs``
    documents, but in the largest doc_id that holds it.

    Returns doc_id, n_lines (before), n_dropped, kept_text. With ``keep`` it returns these columns of docs
    instead, among them doc_id and text, which has lost its lines.
    """
    names = [n for n in keep or () if n not in ("doc_id", "text")]
    docs = pick(docs, "doc_id", "text", *names)
    docs = docs.select(*(F.col(n).alias(f"keep_{n}") for n in names), F.col("text").isNull().alias("no_text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    row = ["doc_id", "t1", "t2"]
    lines = docs.select("doc_id", *(c.alias(n) for c, n in zip(_digest(F.col("text")), ("t1", "t2"))), F.split("text", "\n").alias("every"))
    lines = lines.select(*row, F.posexplode("every").alias("pos", "line"))  # beside an explosion the text would be hashed for each line
    lines = lines.filter(F.length("line") >= min_chars).withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= min_chars)
    lines = written(lines.select(*row, "pos", *(c.alias(n) for c, n in zip(_digest(F.col("line")), ("k1", "k2")))), "lines")
    frequent = (
        lines.filter(F.col("doc_id").isNotNull())
        .groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_docs).select("k1", "k2", "keeper")
    )
    frequent = written(frequent, "frequent")  # so that the join sees its size, and can split a frequent key
    lost = lines.join(frequent, ["k1", "k2"]).filter(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("keeper")))
    lost = lost.groupBy(*row).agg(F.collect_set("pos").alias("lost"))
    # lines are a column of the join, so that they are split once and looked up by position
    docs = docs.select("*", *(c.alias(n) for c, n in zip(_digest(F.col("text")), ("t1", "t2"))), F.split("text", "\n").alias("every")).drop("text")
    same = F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.t1") == F.col("l.t1")) & (F.col("d.t2") == F.col("l.t2"))
    joined = docs.alias("d").join(lost.alias("l"), same, "left").select("d.doc_id", "d.every", "d.no_text", "l.lost", *(f"d.keep_{n}" for n in names))
    left = F.array_except(F.sequence(F.lit(0), F.size("every") - 1), "lost")  # by a hash set
    text = F.when(F.col("lost").isNull(), F.array_join("every", "\n")).otherwise(F.array_join(F.transform(left, lambda pos: F.get("every", pos)), "\n"))
    if keep:
        return joined.select(*(F.when(~F.col("no_text"), text).alias(n) if n == "text" else F.col(n if n == "doc_id" else f"keep_{n}").alias(n) for n in keep))
    return joined.select(
        "doc_id",
        F.size("every").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        text.alias("kept_text"),
    )


def query(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, pos, ls[pos] AS line,
             translate(trim(ls[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM d)),
f AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.pos, l.line, (f.k IS NOT NULL AND l.doc_id <> f.keeper) AS lost FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

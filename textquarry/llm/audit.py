"""How filters act on each other, from one pass over the documents: a Walsh-Hadamard audit.

Each filter fails a document or not, so a document is a mask of five bits. Per part and label the documents are summed
up in 32 signed parity sums, one for each subset of the filters: a document counts -1 where it fails an odd number of
the subset and 1 otherwise. The transform inverts exactly, so the 32 sums give the number of documents of each mask,
and these cells answer everything else without the documents: what each of the 120 orders keeps and removes at each
step, and the Shapley count in closed form, since a document that fails k filters is removed by each of them in 120 / k
of the orders.

Equal texts are known by SHA-256. The smallest doc_id of each text is a combined aggregation; documents look themselves
up by digest and doc_id together, so a text that a third of all documents hold is no hot key.

Contract: null texts count as empty, null parts as the empty string. A null doc_id is no smaller doc_id: it fails the
copy filter neither itself nor for others. Rows that repeat a doc_id count each; none of them is smaller than the other.
Labels that are missing or null are not 1; of repeated ones the highest holds. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm._shared import pick, written

#: The filters, and the characters that the fourth looks for.
LETTERS = "ABCDE"
MASKS, ORDERS = 32, 120
SPACE, MARKS = r"[ \t-\r]+", r"[#$%&*|]"
LABELS = ("n", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """The conditions of A to D, each true where it fails a text that isn't null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * 65,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 5,
        "D": text.rlike(MARKS),
    }


def masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, good, toxic, mask) of each document; bit i of the mask is set where filter i fails it."""
    docs = pick(docs, "doc_id", "text", part)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    bits = sum((F.when(c, 1 << LETTERS.index(k)).otherwise(0) for k, c in failures(F.col("text")).items()), F.lit(0))
    rows = written(docs.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("bits")), "failures")
    # tables of their own, so that the joins see their sizes, and don't deal documents out by the digest alone
    first = written(rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "firsts")
    labels = pick(labels, "doc_id", "quality", "toxic").filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    labels = written(labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")), "marked")
    held = rows.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left").join(labels, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    return held.select("part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), (F.col("bits") + copy).alias("mask"))


def _sign(mask: Column, subset: Column | int) -> Column:
    """-1 where the mask has an odd number of the subset's filters, else 1."""
    both = mask.bitwiseAND(subset)
    return F.lit(1) - F.bit_count(both).bitwiseAND(F.lit(1)) * 2


def parities(masks: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): the 32 signed parity sums of the documents of each part and labels."""
    sums = [F.sum(_sign(F.col("mask"), s).cast("long")).alias(f"s{s}") for s in range(MASKS)]
    return masks.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*(f"s{s}" for s in range(MASKS))).alias("sums"))


def cells(parities: DataFrame) -> DataFrame:
    """(part, n, good, toxic): for each part three arrays of 32, how many documents have each mask, and of them each label.

    The sums of labels are added up first, as the transform is linear; its inverse is itself, divided by 32.
    """
    when = {"n": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    added = parities.groupBy("part").agg(*(F.sum(F.element_at("sums", s + 1) * when[k]).alias(f"{k}{s}") for k in LABELS for s in range(MASKS)))

    def inverse(k: str) -> Column:
        sums = F.array(*(F.struct(F.lit(s).alias("s"), F.col(f"{k}{s}").alias("v")) for s in range(MASKS)))
        total = lambda m: F.aggregate(sums, F.lit(0).cast("long"), lambda a, x: a + _sign(m, x["s"]) * x["v"])
        return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: (total(m) / MASKS).cast("long")).alias(k)

    return added.select("part", *(inverse(k) for k in LABELS))


def _steps() -> Column:
    """An array of all orders' steps: the order, the step, its filter's bit and the bits before it."""
    steps = []
    for order in permutations(LETTERS):
        bits = [1 << LETTERS.index(c) for c in order]
        steps += [{"filter_order": "".join(order), "step": i + 1, "bit": b, "before": sum(bits[:i])} for i, b in enumerate(bits)]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def orders(cells: DataFrame) -> DataFrame:
    """All orders and steps of each part, from its cells."""
    at = cells.select("*", F.explode(_steps()).alias("at")).select(*cells.columns, "at.*")
    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0

    def total(of: str, holds) -> Column:
        each = F.transform(F.col(of), lambda v, m: F.when(holds(m), v).otherwise(F.lit(0)))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, v: a + v)

    removed = lambda m: fails(m) & ~earlier(m)
    share = F.transform(F.col("n"), lambda v, m: F.when(fails(m), v * (F.lit(ORDERS) / F.bit_count(m)).cast("long")).otherwise(F.lit(0)))
    return at.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.element_at("n", F.col("bit") + 1).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, v: a + v).alias("shapley"),
    )


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return orders(cells(parities(masks(docs, labels))))


#: Every order is walked document mask by document mask, and Shapley added up over the orders.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT w.doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d, coalesce(w.doc_id > least, false) AS e,
             coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
      FROM w LEFT JOIN (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic
                        FROM labels GROUP BY doc_id) l USING (doc_id)),
g AS (SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS k,
             count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
      FROM f GROUP BY part, a, b, c, d, e),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (SELECT p.v || q.v || r.v || s.v || t.v AS filter_order FROM x p, x q, x r, x s, x t
      WHERE len(list_distinct([p.v, q.v, r.v, s.v, t.v])) = 5),
y AS (SELECT filter_order, step::INT AS step, filter_order[step:step] AS own, string_split(filter_order[1:step - 1], '') AS before
      FROM o, range(1, 6) r(step)),
z AS (SELECT part, filter_order, step, own, k, n, good, toxic, fails[own] AS failing,
             len(list_filter(before, lambda b: b <> '' AND fails[b])) > 0 AS gone FROM g, y),
t AS (SELECT part, filter_order, step, own,
             sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN failing AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN failing AND k = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM z GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t
"""

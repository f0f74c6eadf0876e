"""Queries over what a model gives: token vectors, span scores, losses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textquarry.operators import losses, pointer
from textquarry.plans.evaluation import rounded
from textquarry.session import load

#: Weights that any engine can make: ((31 row + 17 column) mod 23 - 11) / 11, by halves turned for the offsets.
HIDDEN, SIZE, TYPES, WINDOW = 64, 4, 2, 25


def weights(rows: int, shift: int = 0) -> np.ndarray:
    return ((np.arange(rows)[:, None] * 31 + np.arange(HIDDEN) * 17 + shift) % 23 - 11) / 11.0


def model(ordered: bool = True) -> pointer.Pointer:
    return pointer.Pointer(weights(2 * SIZE), np.arange(2 * SIZE) / 10, weights(2 * TYPES, 5), np.arange(2 * TYPES) / 10 - 1, ordered, ordered)


def tokens(spark, sf):
    """embeddings as tokens of windows of 25."""
    v = load(spark, sf, "embeddings")
    return v.select(F.floor(F.col("vec_id") / WINDOW).alias("doc_id"), (F.col("vec_id") % WINDOW).cast("int").alias("position"), F.col("embedding").alias("vector"))


def span_scores(spark, sf):
    return rounded(pointer.spans(tokens(spark, sf), model()), "logit")


def link_scores(spark, sf):
    return rounded(pointer.spans(tokens(spark, sf), model(False), 0.5), "logit")


def span_means(spark, sf):
    """Means of the spans above a threshold: their first and last components and their sum."""
    t = tokens(spark, sf)
    found = pointer.spans(t, model()).select("doc_id", F.col("first").alias("start"), (F.col("last") + 1).alias("end")).distinct()
    means = pointer.pooled(t, found)
    total = F.aggregate("mean", F.lit(0.0), lambda a, x: a + x)
    return rounded(means.select("doc_id", "start", "end", F.col("mean")[0].alias("one"), F.col("mean")[HIDDEN - 1].alias("last"), total.alias("total")), "one", "last", "total")


def scored_lines(spark, sf):
    """Lines of orders as scores of two parts and three heads; targets are large lines."""
    line = load(spark, sf, "lineitem")
    return line.select(F.when(F.col("l_partkey") % 2 == 0, "entity").otherwise("head").alias("part"), F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("head"), (F.col("l_partkey") % 401 - 200).cast("double").alias("score"), (F.col("l_quantity") > 30).alias("target"), (F.col("l_linenumber") < 4).alias("kept"))


def pointer_losses(spark, sf):
    return rounded(losses.pointer_losses(scored_lines(spark, sf), ["part", "doc_id", "head"]), "loss")


def objectives(spark, sf):
    """The joint objective, of the mean and of the sum form, the pairs' loss and the pipeline's objective."""
    rows = scored_lines(spark, sf)
    parts, pair = losses.pointer_loss(rows), losses.pair_loss(rows)
    named = [("joint_mean", losses.joint_loss(parts)), ("joint_sum", losses.joint_loss(parts, "sum")), ("pair", pair), ("pipeline", losses.pipeline_loss(parts.filter("part = 'entity'"), pair))]
    out = None
    for name, one in named:
        one = one.select(F.lit(name).alias("objective"), "loss")
        out = one if out is None else out.unionAll(one)
    return rounded(out, "loss")


W = lambda row, shift: f"(((({row}) * 31 + (i - 1) * 17 + {shift}) % 23) - 11) / 11.0::DOUBLE"
DOT = lambda row, shift, offset: f"(list_sum(list_transform(range(1, {HIDDEN + 1}), lambda i: embedding[i]::DOUBLE * {W(row, shift)})) + {offset})"
TOKENS = f"a AS (SELECT vec_id // {WINDOW} AS d, (vec_id % {WINDOW})::INTEGER AS p, embedding, " + ", ".join(f"{DOT(r, 0, f'{r}::DOUBLE / 10')} AS z{r}" for r in range(2 * SIZE)) + ", " + ", ".join(f"{DOT(r, 5, f'({r}::DOUBLE / 10 - 1)')} AS b{r}" for r in range(2 * TYPES)) + " FROM embeddings)"
TURN = lambda base: ", ".join(f"z{base + 2 * k} * cos(p * {10000 ** (-2 * k / SIZE)!r}::DOUBLE) - z{base + 2 * k + 1} * sin(p * {10000 ** (-2 * k / SIZE)!r}::DOUBLE) AS r{base + 2 * k}, z{base + 2 * k + 1} * cos(p * {10000 ** (-2 * k / SIZE)!r}::DOUBLE) + z{base + 2 * k} * sin(p * {10000 ** (-2 * k / SIZE)!r}::DOUBLE) AS r{base + 2 * k + 1}" for k in range(SIZE // 2))
ALL = lambda name, ordered: f"s AS (SELECT x.d AS doc_id, x.p AS first, y.p AS last, t::INTEGER AS type_id, ({' + '.join(f'x.{name}{k} * y.{name}{SIZE + k}' for k in range(SIZE))}) / 2 + CASE t {' '.join(f'WHEN {t} THEN x.b{t} + y.b{TYPES + t}' for t in range(TYPES))} END AS logit FROM r x JOIN r y ON x.d = y.d{' AND x.p <= y.p' if ordered else ''}, (SELECT unnest(range({TYPES})) AS t))"
SPANS = f"WITH {TOKENS}, r AS (SELECT *, {TURN(0)}, {TURN(SIZE)} FROM a), {ALL('r', True)}"
LOSS = """WITH l AS (SELECT CASE WHEN l_partkey % 2 = 0 THEN 'entity' ELSE 'head' END AS part, l_suppkey AS doc_id, l_returnflag AS head, (l_partkey % 401 - 200)::DOUBLE AS s, l_quantity > 30 AS t, l_linenumber < 4 AS kept FROM lineitem),
g AS (SELECT part, doc_id, head, coalesce(greatest(max(s) FILTER (WHERE NOT t), 0), 0) AS nm, coalesce(greatest(max(-s) FILTER (WHERE t), 0), 0) AS pm FROM l GROUP BY ALL),
x AS (SELECT part, doc_id, head, max(nm) + ln(exp(-max(nm)) + coalesce(sum(exp(s - nm)) FILTER (WHERE NOT t), 0)) + max(pm) + ln(exp(-max(pm)) + coalesce(sum(exp(-s - pm)) FILTER (WHERE t), 0)) AS loss FROM l JOIN g USING (part, doc_id, head) GROUP BY ALL)"""
PAIR = "(SELECT sum(CASE WHEN t THEN 3 * (greatest(-s, 0) + ln(1 + exp(-abs(s)))) ELSE greatest(s, 0) + ln(1 + exp(-abs(s))) END) / greatest(count(*), 1) FROM l WHERE kept)"

QUERIES = {
    "span_scores": (span_scores, f"{SPANS} SELECT doc_id, first, last, type_id, round(logit, 6) AS logit FROM s WHERE logit > 0"),
    "link_scores": (link_scores, f"WITH {TOKENS}, r AS (SELECT * FROM a), {ALL('z', False)} SELECT doc_id, first, last, type_id, round(logit, 6) AS logit FROM s WHERE logit > 0.5"),
    "span_means": (span_means, f"{SPANS}, f AS (SELECT DISTINCT doc_id, first, last FROM s WHERE logit > 0) SELECT doc_id, first AS start, last + 1 AS end, round(avg(embedding[1]::DOUBLE), 6) AS one, round(avg(embedding[{HIDDEN}]::DOUBLE), 6) AS last, round(avg(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 6) AS total FROM f JOIN a ON d = doc_id AND p BETWEEN first AND f.last GROUP BY doc_id, f.first, f.last"),
    "pointer_losses": (pointer_losses, f"{LOSS} SELECT part, doc_id, head, round(loss, 6) AS loss FROM x"),
    "objectives": (objectives, f"{LOSS}, y AS (SELECT part, avg(loss) AS m, avg(loss) * count(DISTINCT head) AS h FROM x GROUP BY 1), o AS (SELECT 'joint_mean' AS objective, sum(m) AS loss FROM y UNION ALL SELECT 'joint_sum', sum(h) FROM y UNION ALL SELECT 'pair', {PAIR} UNION ALL SELECT 'pipeline', max(m) FILTER (WHERE part = 'entity') + 2 * {PAIR} FROM y) SELECT objective, round(loss, 6) AS loss FROM o"),
}

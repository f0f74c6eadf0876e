"""Evaluation queries: scores, calibration, bootstrap, thresholds, analyses.

Gold and predictions come from the driver's tables by fixed rules, so that any engine can rebuild them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions.stats import argmax
from textquarry.operators import analysis, bootstrap, calibration, metrics, selection, thresholds
from textquarry.session import load, parts

DIGITS = 6


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, DIGITS) + F.lit(0.0))
    return df


def order_spans(spark, sf):
    """Gold and predicted spans of orders as documents: lines with quantities over 10, and over 15 with moved ends."""
    line = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 5).alias("end"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("q"), "l_partkey")
    gold = line.filter("q > 10").select("doc_id", "start", "end", "type")
    predicted = line.filter("q > 15").select("doc_id", "start", (F.col("end") + (F.col("l_partkey") % 7 == 0).cast("int")).alias("end"), F.when(F.col("l_partkey") % 11 == 0, "N").otherwise(F.col("type")).alias("type"), F.col("q").alias("score"))
    return gold, predicted


G = "g AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber * 10 AS s, l_linenumber * 10 + 5 AS e, l_returnflag AS type FROM lineitem WHERE l_quantity > 10)"
P = "p0 AS (SELECT l_orderkey AS doc_id, l_linenumber * 10 AS s, l_linenumber * 10 + 5 + (l_partkey % 7 = 0)::INT AS e, CASE WHEN l_partkey % 11 = 0 THEN 'N' ELSE l_returnflag END AS type, l_quantity AS score FROM lineitem WHERE l_quantity > 15), p AS (SELECT DISTINCT doc_id, s, e, type FROM p0)"
M = f"{G}, {P}, m AS (SELECT doc_id, s, e, type, coalesce(ig, 0) AS ig, coalesce(ip, 0) AS ip FROM (SELECT *, 1 AS ig FROM g) FULL JOIN (SELECT *, 1 AS ip FROM p) USING (doc_id, s, e, type))"
PRF = "round(CASE WHEN predicted > 0 THEN correct / predicted::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN gold > 0 THEN correct / gold::DOUBLE ELSE 0 END, 6) AS recall, round(CASE WHEN predicted + gold > 0 THEN 2 * correct / (predicted + gold)::DOUBLE ELSE 0 END, 6) AS f1, correct, predicted, gold"
SUMS = "sum(ig * ip)::BIGINT AS correct, sum(ip)::BIGINT AS predicted, sum(ig)::BIGINT AS gold"


def prf_micro_per_type(spark, sf):
    return rounded(metrics.span_scores(*order_spans(spark, sf)), "precision", "recall", "f1")


def missing_and_extra(spark, sf):
    gold, predicted = order_spans(spark, sf)
    return metrics.differences(gold, predicted, ["doc_id", *metrics.ENTITY]).groupBy("kind", "type").agg(F.count("*").alias("n"))


def document_counts(spark, sf):
    gold, predicted = order_spans(spark, sf)
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return metrics.document_counts(gold, predicted, orders, columns=metrics.ENTITY)


def scored_vectors(spark, sf):
    """embeddings as scores of four classes, each the sum of every fourth component, and the class as truth."""
    v = load(spark, sf, "embeddings")
    own = lambda c: F.filter("embedding", lambda _, i: i % 4 == c)
    scores = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.aggregate(own(c), F.lit(0.0), lambda a, x: a + x.cast("double")) * 20)
    return v.select("vec_id", scores.alias("scores"), F.pmod("label", F.lit(4)).cast("int").alias("truth"))


def predicted_vectors(spark, sf, temperature=1.0):
    return calibration.scaled(scored_vectors(spark, sf), temperature)


V = "v AS (SELECT vec_id, list_transform(range(4), lambda c: list_sum(list_transform(range(c + 1, len(embedding) + 1, 4), lambda i: embedding[i]::DOUBLE)) * 20) AS sc, label % 4 AS truth FROM embeddings)"


def soft(t: str) -> str:
    return f"{V}, e AS (SELECT vec_id, truth, list_transform(sc, lambda x: exp((x - list_max(sc)) / {t})) AS ex FROM v), p AS (SELECT vec_id, truth, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM e), c AS (SELECT *, list_max(p) AS conf, list_position(p, list_max(p)) - 1 AS pred FROM p)"


def class_names(spark):
    return spark.createDataFrame([(i, f"c{i}") for i in range(4)], "id int, label string")


def confusion_matrix(spark, sf):
    return metrics.confusion(predicted_vectors(spark, sf))


def classification_report(spark, sf):
    return rounded(metrics.class_report(metrics.confusion(predicted_vectors(spark, sf)), class_names(spark)), "precision", "recall", "f1")


def classification_summary(spark, sf):
    return rounded(metrics.classification_summary(metrics.confusion(predicted_vectors(spark, sf)), class_names(spark)), "accuracy", "macro_f1", "weighted_f1")


def reliability_bins(spark, sf):
    return rounded(metrics.reliability(predicted_vectors(spark, sf)), "lower", "upper", "accuracy", "confidence")


def expected_calibration_error(spark, sf):
    return rounded(metrics.expected_calibration_error(metrics.reliability(predicted_vectors(spark, sf))), "ece")


def brier_nll(spark, sf):
    return rounded(metrics.brier_nll(predicted_vectors(spark, sf)), "brier_score", "nll")


def selective_prediction(spark, sf):
    rows = predicted_vectors(spark, sf)
    return rounded(calibration.selective(rows.filter("vec_id % 2 = 0"), rows.filter("vec_id % 2 = 1")), "threshold", "coverage", "accuracy")


def temperature_grid(spark, sf):
    return rounded(calibration.nll_by_temperature(scored_vectors(spark, sf), [0.5, 1.0, 2.0, 4.0, 8.0]), "nll")


def fitted_temperature(spark, sf):
    t = calibration.fit_temperature(scored_vectors(spark, sf))
    return spark.createDataFrame([(round(t, 3),)], "temperature double")


def fitted_temperature_inside(spark, sf):
    """As fitted_temperature, with two thirds of the rows predicted right, so that the best temperature lies inside its bounds."""
    rows = scored_vectors(spark, sf)
    rows = rows.withColumn("truth", F.when(F.col("vec_id") % 3 == 0, F.col("truth")).otherwise(argmax(F.col("scores"))))
    return spark.createDataFrame([(round(calibration.fit_temperature(rows), 3),)], "temperature double")


def macro_f1_by_run(spark, sf):
    rows = predicted_vectors(spark, sf).select("truth", "prediction", F.pmod("vec_id", F.lit(3)).alias("run"))
    return rounded(metrics.macro_f1(metrics.confusion(rows, "truth", "prediction", "run"), 4, "run"), "macro_f1")


def mean_confusion(spark, sf):
    cells = metrics.confusion(predicted_vectors(spark, sf))
    return rounded(metrics.mean_confusion(cells, 2), "mean_n").select("truth", "prediction", "mean_n", "main_confusion")


def bootstrap_draws(spark, sf):
    drawn = bootstrap.draws(load(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", 5, 31415)
    return drawn.select("doc_id", "replicate", "times")


def document_pairs(spark, sf):
    gold, predicted = order_spans(spark, sf)
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    one = metrics.document_counts(gold, predicted, orders, columns=metrics.ENTITY)
    two = metrics.document_counts(gold, predicted.filter("score > 20"), orders, columns=metrics.ENTITY)
    named = lambda df, s: df.select("doc_id", *(F.col(c).alias(f"{c}_{s}") for c in ("correct", "predicted", "gold")))
    return named(two, "r").join(named(one, "c"), "doc_id")


def bootstrap_documents(spark, sf):
    return rounded(bootstrap.paired_documents(document_pairs(spark, sf), 50, method="slots"), "observed", "lower", "upper")


def bootstrap_runs(spark, sf):
    rows = predicted_vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "truth", F.col("prediction").alias("candidate"), F.lit(0).alias("reference"))
    return rounded(bootstrap.paired_runs(rows.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2)))), 4, 40, method="slots"), "observed", "lower", "upper")


def bootstrap_split_totals(spark, sf):
    """Draws of each replicate and label by splitting: as many as the label has rows, and their count of drawn doc_ids."""
    rows = load(spark, sf, "labels").select("doc_id", F.col("toxic").cast("string").alias("label"))
    cells = F.array(F.concat(F.lit("rows:"), F.coalesce("label", F.lit("null"))))
    return bootstrap.split_sums(rows, "doc_id", cells, F.array(F.lit(1)), 20, 31415, ["label"])


def bootstrap_split_interval(spark, sf):
    """The observed difference of `bootstrap_documents`, and whether the interval by splitting, of 200 replicates, holds it and is narrow."""
    rows = document_pairs(spark, sf)
    n = rows.count()
    found = bootstrap.paired_documents(rows, 200)
    near = (F.col("lower") <= F.col("observed")) & (F.col("observed") <= F.col("upper")) & (F.col("upper") - F.col("lower") < 4 / n**0.5)
    return rounded(found.select("observed", "replicates", near.alias("near")), "observed")


def threshold_grid_counts(spark, sf):
    return thresholds.grid_counts(*order_spans(spark, sf), [16.0, 20.0, 30.0, 45.0])


def threshold_grid_best(spark, sf):
    return rounded(thresholds.best_threshold(*order_spans(spark, sf), [16.0, 20.0, 30.0, 45.0]), "f1")


def dinkelbach_thresholds(spark, sf):
    chosen, support = thresholds.fit_thresholds(*order_spans(spark, sf), ["A", "N", "R", "X"], [16.0, 20.0, 30.0, 45.0], 20.0)
    return spark.createDataFrame([(t, float(chosen[t]), int(support[t])) for t in sorted(chosen)], "type string, threshold double, support long")


def seed_mean_std(spark, sf):
    rows = load(spark, sf, "events").select("event_type", (F.col("user_id") % 3).alias("seed"), "value").groupBy("event_type", "seed").agg(F.avg("value").alias("v"))
    return rounded(metrics.mean_std(rows, ["event_type"], "v"), "v_mean", "v_std")


def variant_choice(spark, sf):
    rows = load(spark, sf, "events").groupBy(F.col("event_type").alias("variant"), (F.col("user_id") % 3).alias("seed")).agg(F.avg("value").alias("validation"))
    return rounded(selection.choose(rows), "mean")


def release_gates(spark, sf):
    rows = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0.5).alias("baseline_validation"), (0.5 + (F.col("s_suppkey") % 20) / 1000).alias("candidate_validation"), F.lit(0.6).alias("baseline_test"), (0.6 + (F.col("s_suppkey") % 7 - 3) / 100).alias("candidate_test"))
    return selection.release(rows).select("id", "validation_gate_passed", "holdout_audit_passed", "enabled")


def order_triples(spark, sf):
    """Triples of orders: ends are lines by number, relations by part; predictions change some ends and relations."""
    line = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 2).alias("s_start"), (F.col("l_linenumber") * 2 + 1).alias("s_end"), F.lit("A").alias("s_type"), (F.col("l_partkey") % 4).cast("int").alias("rel"), (F.col("l_linenumber") * 2 + 1).alias("o_start"), (F.col("l_linenumber") * 2 + 2).alias("o_end"), F.lit("B").alias("o_type"), F.col("l_suppkey").alias("x"))
    predicted = line.filter("x % 5 <> 0").withColumn("rel", F.when(F.col("x") % 3 == 0, (F.col("rel") + 1) % 4).otherwise(F.col("rel")))
    texts = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("0123456789abcdefghijklmnop").alias("text"))
    ents = line.filter("x % 2 = 0").select("doc_id", F.col("s_start").alias("start"), F.col("s_end").alias("end"), F.col("s_type").alias("type")).unionAll(line.select("doc_id", "o_start", "o_end", "o_type"))
    return line.drop("x"), predicted.drop("x"), texts, ents


T = """t AS (SELECT l_orderkey AS d, l_linenumber AS n, (l_partkey % 4)::INTEGER AS rel, l_suppkey AS x FROM lineitem),
q AS (SELECT d, n, CASE WHEN x % 3 = 0 THEN (rel + 1) % 4 ELSE rel END AS rel, x FROM t WHERE x % 5 <> 0)"""


def relation_scores(spark, sf):
    gold, predicted, texts, _ = order_triples(spark, sf)
    slots = spark.createDataFrame([(i, f"p{i}", "@value", f"p{i}") for i in range(5)], "id int, predicate string, slot string, label string")
    return rounded(metrics.relation_scores(metrics.surfaces(gold, texts), metrics.surfaces(predicted, texts), slots), "precision", "recall", "f1").select("id", "precision", "recall", "f1", "correct", "predicted", "gold")


def relation_summary(spark, sf):
    gold, predicted, texts, _ = order_triples(spark, sf)
    slots = spark.createDataFrame([(i, f"p{i}", "@value", f"p{i}") for i in range(5)], "id int, predicate string, slot string, label string")
    return rounded(metrics.relation_summary(metrics.surfaces(gold, texts), metrics.surfaces(predicted, texts), slots), "macro_f1", "precision", "recall", "f1")


def error_partition(spark, sf):
    gold, predicted, texts, ents = order_triples(spark, sf)
    return analysis.error_partition(gold, predicted, ents, texts, parts=parts(gold, 1 << 17))


def error_slices(spark, sf):
    gold, _, texts, _ = order_triples(spark, sf)
    train = gold.filter("doc_id % 50 = 0")
    return analysis.slices(texts, gold, train).groupBy("slice").agg(F.count("*").alias("n"))


def role_confusions_top15(spark, sf):
    gold, predicted, texts, _ = order_triples(spark, sf)
    return analysis.role_confusions(metrics.surfaces(gold, texts), metrics.surfaces(predicted, texts))


def role_errors(spark, sf):
    gold, predicted, texts, ents = order_triples(spark, sf)
    seen = ents.select("doc_id", F.substring(F.lit("0123456789abcdefghijklmnop"), F.col("start") + 1, F.col("end") - F.col("start")).alias("term"), "type")
    return analysis.role_errors(metrics.surfaces(gold, texts), metrics.surfaces(predicted, texts), seen)


def subgroup_sizes(spark, sf):
    gold, _, texts, _ = order_triples(spark, sf)
    return analysis.subgroups(texts, gold, texts, gold.filter("doc_id % 3 = 0")).groupBy("slice").agg(F.count("*").alias("n"))


def subgroup_members(spark, sf):
    """Orders in their subgroups, with spans that overlap and surfaces that the part for training lacks."""
    line = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 2).alias("s_start"), (F.col("l_linenumber") * 2 + 1 + F.col("l_suppkey") % 4).cast("int").alias("s_end"), F.lit("A").alias("s_type"), (F.col("l_partkey") % 4).cast("int").alias("rel"), (F.col("l_linenumber") * 2 + 1).alias("o_start"), (F.col("l_linenumber") * 2 + 2).alias("o_end"), F.lit("B").alias("o_type"))
    texts = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.md5(F.col("o_orderkey").cast("string")).alias("text"))
    return analysis.subgroups(texts, line, texts, line.filter("doc_id % 50 = 0")).groupBy("slice").agg(F.count("*").alias("n"))


def support_bands(spark, sf):
    gold, predicted, texts, _ = order_triples(spark, sf)
    slots = spark.createDataFrame([(i, f"p{i}", "@value", f"p{i}") for i in range(5)], "id int, predicate string, slot string, label string")
    support = gold.filter("doc_id % 100 = 0").groupBy(F.col("rel").alias("id")).agg(F.count("*").alias("n"))
    scores = metrics.relation_scores(metrics.surfaces(gold, texts), metrics.surfaces(predicted, texts), slots)
    return rounded(analysis.band_scores(scores, support), "precision", "recall", "f1")


def char_tfidf(spark, sf):
    from textquarry.operators.ml import TfIdf

    rows = load(spark, sf, "benchmark")
    features = TfIdf(2000).fit(rows)
    from pyspark.ml.functions import vector_to_array

    return features.transform(rows).select("item_id", F.size(F.filter(vector_to_array("features"), lambda x: x != 0)).alias("terms"))


CONF = f"WITH {soft('1.0')}"
REPORT = f"{CONF}, k AS (SELECT unnest(range(4))::INTEGER AS id), r AS (SELECT id, count(*) FILTER (WHERE truth = id AND pred = id)::BIGINT AS correct, count(*) FILTER (WHERE pred = id)::BIGINT AS predicted, count(*) FILTER (WHERE truth = id)::BIGINT AS gold FROM k CROSS JOIN c GROUP BY id)"
F1 = "CASE WHEN predicted + gold > 0 THEN 2 * correct / (predicted + gold)::DOUBLE ELSE 0 END"
BINS = f"{CONF}, b AS (SELECT least(floor(conf * 15), 14)::INTEGER AS bin, count(*)::BIGINT AS samples, avg((pred = truth)::INT) AS accuracy, avg(conf) AS confidence FROM c GROUP BY 1)"
GRID = f"{G}, {P}, b AS (SELECT doc_id, s, e, type, max(score) AS score FROM p0 GROUP BY ALL), th AS (SELECT unnest([16.0, 20.0, 30.0, 45.0])::DOUBLE AS threshold), gc AS (SELECT b.type, threshold, count(g.doc_id)::BIGINT AS tp, count(*)::BIGINT AS predicted FROM b JOIN th ON b.score > threshold LEFT JOIN g USING (doc_id, s, e, type) GROUP BY 1, 2)"
REL = f"WITH {T}, mm AS (SELECT d, n, rel, coalesce(ig, 0) AS ig, coalesce(ip, 0) AS ip FROM (SELECT DISTINCT d, n, rel, 1 AS ig FROM t) FULL JOIN (SELECT DISTINCT d, n, rel, 1 AS ip FROM q) USING (d, n, rel)), k AS (SELECT unnest(range(5))::INTEGER AS id), rs AS (SELECT id, coalesce(sum(ig * ip), 0)::BIGINT AS correct, coalesce(sum(ip), 0)::BIGINT AS predicted, coalesce(sum(ig), 0)::BIGINT AS gold FROM k LEFT JOIN mm ON rel = id GROUP BY id)"

P2 = "p2 AS (SELECT DISTINCT doc_id, s, e, type FROM p0 WHERE score > 20), m2 AS (SELECT doc_id, coalesce(ig, 0) AS ig, coalesce(ip, 0) AS ip FROM (SELECT *, 1 AS ig FROM g) FULL JOIN (SELECT *, 1 AS ip FROM p2) USING (doc_id, s, e, type))"
PAIRS = f"{M}, {P2}, dc AS (SELECT doc_id AS d, {SUMS} FROM m GROUP BY 1), dr AS (SELECT doc_id AS d, {SUMS} FROM m2 GROUP BY 1), k AS (SELECT o_orderkey AS d, coalesce(dr.correct, 0) AS rc, coalesce(dr.predicted, 0) + coalesce(dr.gold, 0) AS ra, coalesce(dc.correct, 0) AS cc, coalesce(dc.predicted, 0) + coalesce(dc.gold, 0) AS ca FROM orders LEFT JOIN dc ON dc.d = o_orderkey LEFT JOIN dr ON dr.d = o_orderkey), ob AS (SELECT 2 * sum(cc) / sum(ca)::DOUBLE - 2 * sum(rc) / sum(ra)::DOUBLE AS observed FROM k)"
PICK = "(('0x' || substr(sha256('31415:' || replicate || ':' || {slot}), 1, 12))::BIGINT % n)"
CI = "round(quantile_cont(delta, 0.025), 6) AS lower, round(quantile_cont(delta, 0.975), 6) AS upper, count(*)::BIGINT AS replicates"
STEPS = "".join(f", t{i} AS (SELECT {lo} AS lo, {hi} AS hi{of}), x{i} AS (SELECT k, lo + (hi - lo) * k / 100.0::DOUBLE AS lt, (hi - lo) / 100.0::DOUBLE AS w FROM t{i}, (SELECT unnest(range(101)) AS k)), y{i} AS (SELECT lt, w, avg(ln(list_sum(list_transform(sc, lambda s: exp((s - list_max(sc)) / exp(lt))))) - (sc[truth + 1] - list_max(sc)) / exp(lt)) AS nll FROM v, x{i} GROUP BY 1, 2)" for i, (lo, hi, of) in enumerate([("ln(0.1::DOUBLE)", "ln(100.0::DOUBLE)", "")] + [("greatest(arg_min(lt, nll) - max(w), ln(0.1::DOUBLE))", "least(arg_min(lt, nll) + max(w), ln(100.0::DOUBLE))", f" FROM y{i}") for i in range(3)]))
SUBGROUPS = """WITH t AS (SELECT DISTINCT l_orderkey AS d, l_linenumber * 2 AS s, l_linenumber * 2 + 1 + l_suppkey % 4 AS e, l_partkey % 4 AS rel, l_linenumber * 2 + 1 AS os, l_linenumber * 2 + 2 AS oe FROM lineitem),
en AS (SELECT d, s, e, 'A' AS ty FROM t UNION SELECT d, os, oe, 'B' FROM t), w AS (SELECT en.*, substr(md5(d::VARCHAR), (s + 1)::BIGINT, (e - s)::BIGINT) AS term FROM en), kn AS (SELECT DISTINCT term, ty, 1 AS known FROM w WHERE d % 50 = 0),
se AS (SELECT d, bool_and(known IS NOT NULL) AS seen FROM w LEFT JOIN kn USING (term, ty) GROUP BY d), sl AS (SELECT d, count(*) AS slots FROM t GROUP BY d), ne AS (SELECT DISTINCT a.d, true AS nested FROM en a JOIN en b ON a.d = b.d AND (a.s <> b.s OR a.e <> b.e) AND a.s < b.e AND b.s < a.e),
z AS (SELECT coalesce(slots = 1, false) AS one, coalesce(nested, false) AS nested, coalesce(seen, true) AS seen FROM orders LEFT JOIN sl ON sl.d = o_orderkey LEFT JOIN ne ON ne.d = o_orderkey LEFT JOIN se ON se.d = o_orderkey)
SELECT CASE WHEN one THEN 'one_gold_slot' ELSE 'multiple_gold_slots' END AS slice, count(*)::BIGINT AS n FROM z GROUP BY 1 UNION ALL SELECT CASE WHEN nested THEN 'distinct_overlapping_spans' ELSE 'non_overlapping_spans' END, count(*)::BIGINT FROM z GROUP BY 1 UNION ALL SELECT CASE WHEN seen THEN 'all_typed_surfaces_seen_in_train' ELSE 'some_typed_surface_unseen' END, count(*)::BIGINT FROM z GROUP BY 1"""

QUERIES = {
    "prf_micro_per_type": (prf_micro_per_type, f"WITH {M}, x AS (SELECT type, {SUMS} FROM m GROUP BY GROUPING SETS ((type), ())) SELECT type, {PRF} FROM x"),
    "missing_and_extra": (missing_and_extra, f"WITH {M} SELECT CASE WHEN ig = 1 THEN 'missing' ELSE 'extra' END AS kind, type, count(*)::BIGINT AS n FROM m WHERE ig <> ip GROUP BY 1, 2"),
    "document_counts": (document_counts, f"WITH {M} SELECT o_orderkey AS doc_id, coalesce(sum(ig * ip), 0)::BIGINT AS correct, coalesce(sum(ip), 0)::BIGINT AS predicted, coalesce(sum(ig), 0)::BIGINT AS gold FROM orders LEFT JOIN m ON doc_id = o_orderkey GROUP BY 1"),
    "confusion_matrix": (confusion_matrix, f"{CONF} SELECT truth, pred::INTEGER AS prediction, count(*)::BIGINT AS n FROM c GROUP BY 1, 2"),
    "classification_report": (classification_report, f"{REPORT} SELECT id, 'c' || id AS label, {PRF} FROM r"),
    "classification_summary": (classification_summary, f"{REPORT} SELECT sum(gold)::BIGINT AS samples, round(sum(correct) / sum(gold)::DOUBLE, 6) AS accuracy, round(avg({F1}), 6) AS macro_f1, round(sum({F1} * gold) / sum(gold)::DOUBLE, 6) AS weighted_f1, count(*) FILTER (WHERE gold = 0)::BIGINT AS unsupported FROM r"),
    "reliability_bins": (reliability_bins, f"{BINS} SELECT bin, round(bin / 15.0::DOUBLE, 6) AS lower, round((bin + 1) / 15.0::DOUBLE, 6) AS upper, samples, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence FROM b"),
    "expected_calibration_error": (expected_calibration_error, f"{BINS} SELECT round(sum(samples * abs(accuracy - confidence)) / sum(samples)::DOUBLE, 6) AS ece FROM b"),
    "brier_nll": (brier_nll, f"{CONF} SELECT round(avg(list_sum(list_transform(p, lambda x, i: pow(x - (i = truth + 1)::INT, 2)))), 6) AS brier_score, round(avg(-ln(least(greatest(p[truth + 1], 1e-15), 1.0))), 6) AS nll FROM c"),
    "selective_prediction": (selective_prediction, f"{CONF}, t AS (SELECT quantile_cont(conf, 0.2) AS threshold FROM c WHERE vec_id % 2 = 0) SELECT round(max(threshold), 6) AS threshold, round(avg((conf >= threshold)::INT), 6) AS coverage, count(*) FILTER (WHERE conf >= threshold)::BIGINT AS accepted, round(avg((pred = truth)::INT) FILTER (WHERE conf >= threshold), 6) AS accuracy FROM c, t WHERE vec_id % 2 = 1"),
    "temperature_grid": (temperature_grid, " UNION ALL ".join(f"(WITH {soft(str(t))} SELECT {t}::DOUBLE AS temperature, round(avg(-ln(p[truth + 1])), 6) AS nll FROM c)" for t in (0.5, 1.0, 2.0, 4.0, 8.0))),
    "fitted_temperature": (fitted_temperature, f"WITH {V}{STEPS} SELECT round(exp(arg_min(lt, nll)), 3) AS temperature FROM y3"),
    "fitted_temperature_inside": (fitted_temperature_inside, f"WITH {V.replace('v AS', 'w AS', 1)}, v AS (SELECT sc, CASE WHEN vec_id % 3 = 0 THEN truth ELSE list_position(sc, list_max(sc)) - 1 END AS truth FROM w){STEPS} SELECT round(exp(arg_min(lt, nll)), 3) AS temperature FROM y3"),
    "macro_f1_by_run": (macro_f1_by_run, f"{CONF}, k AS (SELECT unnest(range(4)) AS id), r AS (SELECT vec_id % 3 AS run, id, count(*) FILTER (WHERE truth = id AND pred = id) AS correct, count(*) FILTER (WHERE pred = id) AS predicted, count(*) FILTER (WHERE truth = id) AS gold FROM k CROSS JOIN c GROUP BY 1, 2) SELECT run, round(avg({F1}), 6) AS macro_f1 FROM r GROUP BY run"),
    "mean_confusion": (mean_confusion, f"{CONF}, x AS (SELECT truth, pred::INTEGER AS prediction, count(*) / 2.0::DOUBLE AS mean_n FROM c GROUP BY 1, 2), w AS (SELECT truth, first(prediction ORDER BY mean_n DESC, prediction) AS main_confusion FROM x WHERE truth <> prediction GROUP BY truth) SELECT truth, prediction, mean_n, main_confusion FROM x LEFT JOIN w USING (truth)"),
    "bootstrap_draws": (bootstrap_draws, """WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(doc_id::VARCHAR), doc_id) - 1 AS slot, count(*) OVER () AS n FROM labels), r AS (SELECT unnest(range(5)) AS replicate),
d AS (SELECT replicate, (('0x' || substr(sha256('31415:' || replicate || ':' || slot), 1, 12))::BIGINT % n) AS pick, count(*)::BIGINT AS times FROM i CROSS JOIN r GROUP BY 1, 2) SELECT doc_id, replicate::INTEGER AS replicate, times FROM d JOIN i ON slot = pick"""),
    "bootstrap_documents": (bootstrap_documents, f"""WITH {PAIRS}, i AS (SELECT o_orderkey AS d, row_number() OVER (ORDER BY sha256(o_orderkey::VARCHAR), o_orderkey) - 1 AS slot, count(*) OVER () AS n FROM orders), r AS (SELECT unnest(range(50)) AS replicate),
dd AS (SELECT replicate, {PICK.format(slot='slot')} AS pick, count(*) AS times FROM i CROSS JOIN r GROUP BY 1, 2), z AS (SELECT replicate, 2 * sum(times * cc) / sum(times * ca)::DOUBLE - 2 * sum(times * rc) / sum(times * ra)::DOUBLE AS delta FROM dd JOIN i ON slot = pick JOIN k USING (d) GROUP BY 1) SELECT round(max(observed), 6) AS observed, {CI} FROM z, ob"""),
    "bootstrap_split_totals": (bootstrap_split_totals, "SELECT 'rows:' || coalesce(toxic::VARCHAR, 'null') AS cell, replicate::INTEGER AS replicate, count(*)::BIGINT AS total FROM labels CROSS JOIN (SELECT unnest(range(20)) AS replicate) GROUP BY 1, 2"),
    "bootstrap_split_interval": (bootstrap_split_interval, f"WITH {PAIRS} SELECT round(observed, 6) AS observed, 200::BIGINT AS replicates, true AS near FROM ob"),
    "bootstrap_runs": (bootstrap_runs, f"""{CONF}, i AS (SELECT truth, pred, row_number() OVER (PARTITION BY truth ORDER BY sha256(vec_id::VARCHAR), vec_id) - 1 AS slot, count(*) OVER (PARTITION BY truth) AS n FROM c), r AS (SELECT unnest(range(40)) AS replicate),
dd AS (SELECT truth, replicate, {PICK.format(slot="truth || ':' || slot")} AS pick, count(*) AS times FROM i CROSS JOIN r GROUP BY ALL), s AS (SELECT replicate, i.truth, i.pred, sum(times) AS m FROM dd JOIN i ON i.truth = dd.truth AND slot = pick GROUP BY ALL UNION ALL SELECT -1, truth, pred, count(*) FROM c GROUP BY ALL), k AS (SELECT unnest(range(4)) AS id),
f AS (SELECT replicate, id, sum(m) FILTER (WHERE truth = id AND pred = id) AS hit, sum(m) FILTER (WHERE truth = id) AS tr, sum(m) FILTER (WHERE pred = id) AS pr, sum(m) AS al FROM s CROSS JOIN k GROUP BY ALL),
z AS (SELECT replicate, sum(coalesce(2 * hit, 0) / greatest(coalesce(tr, 0) + coalesce(pr, 0), 1)::DOUBLE) / 4 - sum(CASE WHEN id = 0 THEN 2 * coalesce(tr, 0) / (coalesce(tr, 0) + al)::DOUBLE ELSE 0 END) / 4 AS delta FROM f GROUP BY 1)
SELECT round((SELECT delta FROM z WHERE replicate = -1), 6) AS observed, {CI} FROM z WHERE replicate >= 0"""),
    "threshold_grid_counts": (threshold_grid_counts, f"WITH {GRID} SELECT * FROM gc"),
    "threshold_grid_best": (threshold_grid_best, f"WITH {GRID}, z AS (SELECT threshold, 2 * sum(tp) / (sum(predicted) + (SELECT count(*) FROM g))::DOUBLE AS f1 FROM gc GROUP BY 1) SELECT threshold, round(f1, 6) AS f1 FROM z ORDER BY f1 DESC, threshold LIMIT 1"),
    "dinkelbach_thresholds": (dinkelbach_thresholds, f"""WITH {GRID}, ty AS (SELECT unnest(['A', 'N', 'R', 'X']) AS type), su AS (SELECT type, count(g.doc_id) AS support FROM ty LEFT JOIN g USING (type) GROUP BY 1),
ch AS (SELECT su.type, support, th.threshold, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted FROM su CROSS JOIN th LEFT JOIN gc ON gc.type = su.type AND gc.threshold = th.threshold WHERE support >= 50 OR th.threshold = 20),
al AS (SELECT a.threshold AS a, n.threshold AS n, r.threshold AS r, x.threshold AS x, 2 * (a.tp + n.tp + r.tp + x.tp) / (a.predicted + n.predicted + r.predicted + x.predicted + a.support + n.support + r.support + x.support)::DOUBLE AS f1 FROM ch a, ch n, ch r, ch x WHERE a.type = 'A' AND n.type = 'N' AND r.type = 'R' AND x.type = 'X'),
bb AS (SELECT * FROM al ORDER BY f1 DESC LIMIT 1), o AS (SELECT unnest(['A', 'N', 'R', 'X']) AS type, unnest([a, n, r, x]) AS threshold FROM bb) SELECT type, threshold, support::BIGINT AS support FROM o JOIN su USING (type)"""),
    "seed_mean_std": (seed_mean_std, "SELECT event_type, count(*)::BIGINT AS n, round(avg(v), 6) AS v_mean, round(stddev_samp(v), 6) AS v_std FROM (SELECT event_type, user_id % 3 AS seed, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1"),
    "variant_choice": (variant_choice, "SELECT variant, round(avg(v), 6) AS mean, count(*)::BIGINT AS runs FROM (SELECT event_type AS variant, user_id % 3 AS seed, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1 ORDER BY avg(v) DESC, variant LIMIT 1"),
    "release_gates": (release_gates, "SELECT s_suppkey AS id, (0.5::DOUBLE + (s_suppkey % 20) / 1000::DOUBLE) - 0.5::DOUBLE >= 0.005::DOUBLE AS validation_gate_passed, 0.6::DOUBLE + (s_suppkey % 7 - 3) / 100::DOUBLE >= 0.6::DOUBLE AS holdout_audit_passed, ((0.5::DOUBLE + (s_suppkey % 20) / 1000::DOUBLE) - 0.5::DOUBLE >= 0.005::DOUBLE) AND (0.6::DOUBLE + (s_suppkey % 7 - 3) / 100::DOUBLE >= 0.6::DOUBLE) AS enabled FROM supplier"),
    "relation_scores": (relation_scores, f"{REL} SELECT id, {PRF} FROM rs"),
    "relation_summary": (relation_summary, f"{REL}, z AS (SELECT round(avg({F1}), 6) AS macro_f1, sum(correct)::BIGINT AS correct, sum(predicted)::BIGINT AS predicted, sum(gold)::BIGINT AS gold FROM rs) SELECT macro_f1, {PRF} FROM z"),
    "error_partition": (error_partition, f"""WITH {T}, es AS (SELECT DISTINCT d, n FROM t WHERE x % 2 = 0), mm AS (SELECT d, n, rel, coalesce(ig, 0) AS ig, coalesce(ip, 0) AS ip FROM (SELECT DISTINCT d, n, rel, 1 AS ig FROM t) FULL JOIN (SELECT DISTINCT d, n, rel, 1 AS ip FROM q) USING (d, n, rel))
SELECT count(*) FILTER (WHERE ig = 1 AND ip = 1)::BIGINT AS correct, count(*) FILTER (WHERE ig = 1 AND ip = 0 AND es.d IS NULL)::BIGINT AS missing_with_entity_error, count(*) FILTER (WHERE ig = 1 AND ip = 0 AND es.d IS NOT NULL)::BIGINT AS missing_despite_both_entities, count(*) FILTER (WHERE ig = 0 AND ip = 1)::BIGINT AS extra
FROM mm LEFT JOIN es ON es.d = mm.d AND es.n = mm.n"""),
    "error_slices": (error_slices, f"""WITH {T}, f AS (SELECT rel, count(*) AS c FROM t WHERE d % 50 = 0 GROUP BY rel), sh AS (SELECT d FROM t GROUP BY d, n HAVING count(*) > 1)
SELECT 'short_text' AS slice, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'shared_entity', count(DISTINCT d)::BIGINT FROM sh HAVING count(*) > 0
UNION ALL SELECT 'rare_relation', count(DISTINCT d)::BIGINT FROM t LEFT JOIN f USING (rel) JOIN orders ON o_orderkey = d WHERE coalesce(c, 0) < 100 HAVING count(*) > 0"""),
    "role_confusions_top15": (role_confusions_top15, f"""{REL} SELECT a.rel AS gold_rel, b.rel AS predicted_rel, count(*)::BIGINT AS n FROM mm a JOIN mm b ON a.d = b.d AND a.n = b.n AND a.ig = 1 AND a.ip = 0 AND b.ig = 0 AND b.ip = 1 GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15"""),
    "role_errors": (role_errors, f"""{REL}, es AS (SELECT DISTINCT d, n FROM t WHERE x % 2 = 0), pr AS (SELECT d, n, max(ig) AS g, max((ig = 0 AND ip = 1)::INT) AS e FROM mm GROUP BY 1, 2),
z AS (SELECT mm.*, g, e, es.d IS NOT NULL AS two FROM mm JOIN pr USING (d, n) LEFT JOIN es ON es.d = mm.d AND es.n = mm.n WHERE ig <> ip),
u AS (SELECT CASE WHEN two THEN 'missing_despite_both_typed_surfaces_detected' ELSE 'missing_with_participant_surface_or_type_absent' END AS category FROM z WHERE ig = 1
UNION ALL SELECT 'missing_with_wrong_role_on_same_typed_pair' FROM z WHERE ig = 1 AND e = 1 UNION ALL SELECT CASE WHEN g = 1 THEN 'extra_wrong_role_on_gold_typed_pair' ELSE 'extra_other_pair_or_type' END FROM z WHERE ig = 0)
SELECT category, count(*)::BIGINT AS n FROM u GROUP BY 1"""),
    "subgroup_sizes": (subgroup_sizes, f"""WITH {T}, kn AS (SELECT DISTINCT n FROM t WHERE d % 3 = 0), z AS (SELECT o_orderkey, count(DISTINCT (n, rel)) AS c, coalesce(bool_and(n IN (SELECT n FROM kn)), true) AS seen FROM orders LEFT JOIN t ON d = o_orderkey GROUP BY 1)
SELECT CASE WHEN c = 1 AND o_orderkey IN (SELECT d FROM t) THEN 'one_gold_slot' ELSE 'multiple_gold_slots' END AS slice, count(*)::BIGINT AS n FROM z GROUP BY 1 UNION ALL SELECT 'non_overlapping_spans', count(*)::BIGINT FROM z UNION ALL SELECT CASE WHEN seen THEN 'all_typed_surfaces_seen_in_train' ELSE 'some_typed_surface_unseen' END, count(*)::BIGINT FROM z GROUP BY 1"""),
    "subgroup_members": (subgroup_members, SUBGROUPS),
    "support_bands": (support_bands, f"""{REL}, sp AS (SELECT rel AS id, count(*) AS c FROM t WHERE d % 100 = 0 GROUP BY 1),
z AS (SELECT CASE WHEN coalesce(c, 0) < 50 THEN 'train_support_1_49' WHEN c < 200 THEN 'train_support_50_199' ELSE 'train_support_200_plus' END AS band, count(*)::BIGINT AS slots, sum(correct)::BIGINT AS correct, sum(predicted)::BIGINT AS predicted, sum(gold)::BIGINT AS gold FROM rs LEFT JOIN sp USING (id) GROUP BY 1) SELECT band, slots, {PRF} FROM z"""),
    "char_tfidf": (char_tfidf, None),
}

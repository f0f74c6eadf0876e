"""Scores, calibration, bootstrap, thresholds, analyses, selection."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.functions import stats
from textquarry.operators import analysis, bootstrap, calibration, metrics, selection, thresholds

TRIPLES = "doc_id int, s_start int, s_end int, s_type string, rel int, o_start int, o_end int, o_type string"
SCHEMA = [(0, "p", "@value", "p"), (1, "q", "@value", "q"), (2, "r", "@value", "r")]


def schema(spark):
    return spark.createDataFrame(SCHEMA, "id int, predicate string, slot string, label string")


def test_relations_by_surface(spark):
    texts = spark.createDataFrame([(1, "ab ab cd"), (2, "xy")], "doc_id int, text string")
    gold = spark.createDataFrame([(1, 0, 2, "A", 0, 6, 8, "B")], TRIPLES)
    pred = spark.createDataFrame([(1, 3, 5, "A", 0, 6, 8, "B"), (1, 0, 2, "A", 0, 6, 8, "B"), (2, 0, 1, "A", 1, 1, 2, "B")], TRIPLES)
    g, p = metrics.surfaces(gold, texts), metrics.surfaces(pred, texts)
    s = metrics.relation_summary(g, p, schema(spark)).first()
    assert (s.correct, s.predicted, s.gold, s.recall, s.precision) == (1, 2, 1, 1.0, 0.5) and math.isclose(s.macro_f1, 1 / 3)
    assert [(r.id, r.f1) for r in metrics.relation_scores(g, p, schema(spark)).orderBy("id").collect()] == [(0, 1.0), (1, 0.0), (2, 0.0)]
    from textquarry.operators.relations import entities

    e = {r.type: r for r in metrics.span_scores(entities(gold, "doc_id"), entities(pred.filter("doc_id = 1 AND s_start = 3"), "doc_id")).collect()}
    assert e[None].f1 == 0.5 and e["A"].f1 == 0 and e["B"].f1 == 1
    assert [(r.doc_id, r.correct, r.predicted, r.gold) for r in metrics.document_counts(g, p, texts).orderBy("doc_id").collect()] == [(1, 1, 1, 1), (2, 0, 1, 0)]
    assert [r.kind for r in metrics.differences(g, p, ["doc_id", *metrics.SURFACE]).collect()] == ["extra"]


def scores(seed, n=200, k=3):
    rnd = np.random.default_rng(seed)
    y = rnd.integers(0, k - 1, n)
    s = rnd.normal(0, 1, (n, k)) + 2 * np.eye(k)[y]
    return s, y


def test_classification(spark):
    s, y = scores(1)
    p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    labels = ["a", "b", "c"]
    rows = spark.createDataFrame([(i, labels[t], [float(v) for v in q]) for i, (t, q) in enumerate(zip(y, p))], "doc_id int, label string, p array<double>")
    found = metrics.predictions(rows, labels).cache()
    cells = metrics.confusion(found)
    names = spark.createDataFrame(list(enumerate(labels)), "id int, label string")
    m = metrics.classification_summary(cells, names).first()
    pred = p.argmax(1)
    f = [2 * ((pred == c) & (y == c)).sum() / max(1, (pred == c).sum() + (y == c).sum()) for c in range(3)]
    assert math.isclose(m.macro_f1, np.mean(f)) and math.isclose(m.accuracy, (pred == y).mean()) and m.unsupported == 1 and math.isclose(m.weighted_f1, sum(f[c] * (y == c).mean() for c in range(3)))
    assert math.isclose(metrics.macro_f1(cells, 3).first().macro_f1, np.mean(f))
    b = metrics.brier_nll(found).first()
    assert math.isclose(b.nll, -np.log(p[np.arange(len(y)), y]).mean()) and math.isclose(b.brier_score, ((p - np.eye(3)[y]) ** 2).sum(1).mean())
    bins = metrics.reliability(found)
    conf, ok = p.max(1), pred == y
    at = np.minimum((conf * 15).astype(int), 14)
    ece = sum((at == i).mean() * abs(ok[at == i].mean() - conf[at == i].mean()) for i in range(15) if (at == i).any())
    assert math.isclose(metrics.expected_calibration_error(bins).first().ece, ece) and sum(r.samples for r in bins.collect()) == 200
    one = spark.createDataFrame([(1.0, True)], "confidence double, correct boolean")
    assert metrics.reliability(one).first().bin == 14
    for bad in ([0.5, 0.6, 0.0], [1.0, 0.0], [1.5, -0.5, 0.0], [math.nan, 0.5, 0.5]):
        with pytest.raises(ValueError):
            metrics.predictions(spark.createDataFrame([(1, "a", bad)], rows.schema), labels)
    mean = {(r.truth, r.prediction): r for r in metrics.mean_confusion(cells, 2).collect()}
    assert mean[0, 0].mean_n == ((y == 0) & (pred == 0)).sum() / 2


def test_temperature(spark):
    rnd = np.random.default_rng(2)
    s, y = rnd.normal(0, 1, (300, 4)) * 6, rnd.integers(0, 4, 300)
    s[np.arange(300), y] += 5
    rows = spark.createDataFrame([([float(v) for v in q], int(t)) for q, t in zip(s, y)], "scores array<double>, truth int").cache()
    t = calibration.fit_temperature(rows)

    def nll(x):
        z = s / x
        return (np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(300), y]).mean()

    grid = np.exp(np.linspace(np.log(0.1), np.log(100), 20001))
    assert abs(t - min(grid, key=nll)) / t < 1e-3 and t > 1 and nll(t) < nll(1.0)
    before, after = calibration.scaled(rows, 1.0), calibration.scaled(rows, t)
    assert [r.prediction for r in before.collect()] == [r.prediction for r in after.collect()]
    got = calibration.selective(after, after).first()
    conf = np.array([r.confidence for r in after.collect()])
    assert math.isclose(got.threshold, np.quantile(conf, 0.2)) and math.isclose(got.coverage, (conf >= got.threshold).mean())
    assert calibration.best_temperature(calibration.nll_by_temperature(rows, [0.5, 1.0, 2.0, 50.0])).first().temperature in (1.0, 2.0, 50.0)
    kl = spark.createDataFrame([([1.0, 2.0], [0.5, -1.0])], "a array<double>, b array<double>").select(stats.symmetric_kl(stats.log_softmax(F.col("a")), stats.log_softmax(F.col("b")))).first()[0]
    lp, lq = (np.array(v) - np.log(np.exp(v).sum()) for v in ([1.0, 2.0], [0.5, -1.0]))
    assert math.isclose(kl, 0.5 * ((np.exp(lp) * (lp - lq)).sum() + (np.exp(lq) * (lq - lp)).sum()))


def test_bootstrap(spark):
    rnd = random.Random(4)
    rows = [(i, s, i % 2, rnd.choice([0, 1]), i % 2) for i in range(60) for s in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id int, seed int, truth int, reference int, candidate int")
    same = bootstrap.paired_runs(df.withColumn("candidate", F.col("reference")), 2, 30).first()
    assert (same.observed, same.lower, same.upper, same.replicates) == (0, 0, 0, 30)
    better = bootstrap.paired_runs(df, 2, 30).first()
    assert better.lower > 0 and better.lower <= better.observed <= better.upper + 1e-9 and bootstrap.paired_runs(df.repartition(5), 2, 30).first() == better
    with pytest.raises(ValueError):
        bootstrap.paired_runs(df.filter("NOT (doc_id = 3 AND seed = 2)"), 2, 5)
    counts = spark.createDataFrame([(i, 1, 2, 2, 2, 2, 2) for i in range(40)], "doc_id int, correct_r int, predicted_r int, gold_r int, correct_c int, predicted_c int, gold_c int")
    got = bootstrap.paired_documents(counts, 20).first()
    assert (got.observed, got.lower, got.upper) == (0.5, 0.5, 0.5)
    times = bootstrap.draws(counts, "doc_id", 7, 1).groupBy("replicate").agg(F.sum("times")).collect()
    assert [r[1] for r in times] == [40] * 7


def test_policies_and_thresholds(spark):
    spans = spark.createDataFrame([(1, 0, 5, "dis", 3.0), (1, 3, 8, "dis", 2.0), (1, 0, 5, "sym", 1.0), (1, 5, 9, "dis", 0.5), (1, 1, 2, "dis", 0.4), (1, 7, 9, "dru", -1.0)], "doc_id int, start int, end int, type string, score double")
    low = dict.fromkeys(("dis", "sym", "dru"), 0.0)
    nested = sorted((r.start, r.end, r.type) for r in thresholds.decode(spans, low, "nested").collect())
    assert nested == [(0, 5, "dis"), (0, 5, "sym"), (1, 2, "dis"), (5, 9, "dis")] and thresholds.decode(spans, low).count() == 5
    for bad in ({}, {"dis": math.nan}):
        with pytest.raises(ValueError):
            thresholds.decode(spans, bad)
    rnd = random.Random(9)
    pred = [(d, i, i + 1, t, round(rnd.uniform(-2, 2), 2)) for d in range(12) for i in range(10) for t in "abc"]
    gold = [p[:4] for p in pred if rnd.random() < (0.7 if p[4] > 0.2 else 0.1)]
    gf, sf = spark.createDataFrame(gold, "doc_id int, start int, end int, type string"), spark.createDataFrame(pred, spans.schema)
    grid = [-1.0, 0.0, 0.5, 1.0]
    chosen, support = thresholds.fit_thresholds(gf, sf, list("abcd"), grid, 0.0, 5)

    def f1(t):
        keep = {p[:4] for p in pred if p[4] > t.get(p[3], 9)}
        return 2 * len(keep & set(gold)) / (len(keep) + len(set(gold)))

    from itertools import product

    best = max(f1(dict(zip("abc", c))) for c in product(grid, repeat=3))
    assert math.isclose(f1(chosen), best) and chosen["d"] == 0.0 and support["d"] == 0
    one = thresholds.best_threshold(gf, sf, grid).first()
    assert math.isclose(one.f1, max(f1(dict.fromkeys("abc", t)) for t in grid)) and one.threshold == max(grid, key=lambda t: (f1(dict.fromkeys("abc", t)), -t))


def test_errors(spark):
    texts = spark.createDataFrame([(1, "ab cd ef"), (2, "x" * 200)], "doc_id int, text string")
    gold = spark.createDataFrame([(1, 0, 2, "A", 0, 3, 5, "B"), (1, 0, 2, "A", 1, 6, 8, "B"), (1, 3, 5, "A", 0, 6, 8, "B"), (2, 0, 1, "A", 2, 5, 6, "B")], TRIPLES)
    pred = spark.createDataFrame([(1, 0, 2, "A", 0, 3, 5, "B"), (1, 3, 5, "A", 1, 6, 8, "B"), (2, 0, 2, "A", 2, 5, 6, "B")], TRIPLES)
    ents = spark.createDataFrame([(1, 0, 2, "A"), (1, 3, 5, "A"), (1, 6, 8, "B"), (1, 3, 5, "B")], "doc_id int, start int, end int, type string")
    e = analysis.error_partition(gold, pred, ents, texts).first()
    assert (e.correct, e.missing_with_entity_error, e.missing_despite_both_entities, e.extra) == (1, 1, 2, 2)
    got = {(r.doc_id, r.slice) for r in analysis.slices(texts, gold, gold, rare=2).collect()}
    assert got == {(1, "short_text"), (1, "shared_entity"), (1, "rare_relation"), (2, "long_text"), (2, "rare_relation")}
    g, p = metrics.surfaces(gold, texts), metrics.surfaces(pred, texts)
    surf = spark.createDataFrame([(1, "ab", "A"), (1, "cd", "A"), (1, "ef", "B")], "doc_id int, term string, type string")
    counts = {r.category: r.n for r in analysis.role_errors(g, p, surf).collect()}
    assert counts == {"missing_despite_both_typed_surfaces_detected": 2, "missing_with_participant_surface_or_type_absent": 1, "missing_with_wrong_role_on_same_typed_pair": 1, "extra_wrong_role_on_gold_typed_pair": 1, "extra_other_pair_or_type": 1}
    assert [tuple(r) for r in analysis.role_confusions(g, p).collect()] == [(0, 1, 1)]
    groups = {(r.doc_id, r.slice) for r in analysis.subgroups(texts, gold, texts.filter("doc_id = 1"), gold.filter("doc_id = 1")).collect()}
    assert groups == {(1, "multiple_gold_slots"), (1, "non_overlapping_spans"), (1, "all_typed_surfaces_seen_in_train"), (2, "one_gold_slot"), (2, "non_overlapping_spans"), (2, "some_typed_surface_unseen")}
    members = analysis.slices(texts, gold, gold, rare=2)
    by = {r.slice: r for r in analysis.slice_scores(members, metrics.document_counts(g, p, texts)).collect()}
    assert (by["short_text"].documents, by["short_text"].correct, by["long_text"].gold) == (1, 1, 1)
    support = spark.createDataFrame([(0, 300), (1, 60)], "id int, n int")
    bands = {r.band: r.slots for r in analysis.band_scores(metrics.relation_scores(g, p, schema(spark)), support).collect()}
    assert bands == {"train_support_200_plus": 1, "train_support_50_199": 1, "train_support_1_49": 1}


def test_selection(spark):
    runs = spark.createDataFrame([("r1", "completed", "d", "l", "s", "s", 0.5), ("r2", "completed", "d", "l", "s", "s", 0.7)], "run string, status string, dataset_sha256 string, labels string, split_sha256 string, metrics_sha256 string, macro_f1 double")
    assert [r.run for r in selection.compare(runs).collect()] == ["r2", "r1"]
    for change in (("status", "failed"), ("dataset_sha256", "e"), ("metrics_sha256", "x")):
        with pytest.raises(ValueError):
            selection.compare(runs.withColumn(change[0], F.when(F.col("run") == "r1", change[1]).otherwise(F.col(change[0]))))
    with pytest.raises(ValueError):
        selection.compare(runs.limit(1))
    rows = spark.createDataFrame([("ce", 1, 0.8, 0.9), ("ce", 2, 0.8, 0.9), ("fgm", 1, 0.9, 0.1), ("fgm", 2, 0.8, 0.1)], "variant string, seed int, validation double, test double")
    assert selection.choose(rows).first().variant == "fgm"
    stats_ = {r.variant: r for r in metrics.mean_std(rows, ["variant"], "validation").collect()}
    assert math.isclose(stats_["fgm"].validation_std, np.std([0.9, 0.8], ddof=1)) and metrics.mean_std(rows.limit(1), ["variant"], "test").first().test_std is None
    gates = spark.createDataFrame([(0.5, 0.51, 0.6, 0.6), (0.5, 0.51, 0.6, 0.59), (0.5, 0.504, 0.6, 0.7)], "baseline_validation double, candidate_validation double, baseline_test double, candidate_test double")
    assert [r.enabled for r in selection.release(gates).collect()] == [True, False, False]


def test_exact_quantiles(spark, monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(calibration, "BINS", 8)  # many passes
    for values in ([rnd.random() for _ in range(300)], [0.25] * 90 + [0.5] * 10, [-1e300, 1e300, 0.0, 5e-324, 1e-323], [1.0]):
        frame = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "c double")
        for share in (0.0, 0.2, 1.0):
            at = share * (len(values) - 1)
            low, own = int(at), sorted(values)
            want = own[low] if low == at else (low + 1 - at) * own[low] + (at - low) * own[low + 1]
            assert calibration.quantile(frame, "c", share) == want
    assert calibration.quantile(frame.limit(0), "c", 0.5) is None


def test_error_partition_dealt_out(spark):
    """Triples with a null among their keys equal no other kind's, whatever the number of partitions; gold and predictions are grouped once."""
    texts = spark.createDataFrame([(1, "ab cd ef"), (2, None)], "doc_id int, text string")
    gold = spark.createDataFrame([(1, 0, 2, "A", 0, 3, 5, "B"), (1, 0, 2, "A", None, 3, 5, "B"), (2, 0, 2, "A", 0, 3, 5, "B"), (2, 1, 2, "A", 0, 3, 5, "B")], TRIPLES)
    ents = spark.createDataFrame([(1, 0, 2, "A"), (1, 0, 2, "A"), (1, 3, 5, "B")], "doc_id int, start int, end int, type string")
    for parts in (None, 11):
        e = analysis.error_partition(gold, gold, ents, texts, parts=parts).first()
        assert (e.correct, e.missing_with_entity_error, e.missing_despite_both_entities, e.extra) == (1, 1, 1, 2)

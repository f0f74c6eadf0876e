"""Queries over files: the driver's tables are written in the formats that the readers take, and read again.

Files lie below ``spark.checkpoint.dir``, which driver and executors share; where it is unset, a local master gets a
folder of its own. One small folder stays for each run of a query, until that directory is cleaned.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import text as tx
from textquarry.functions.stats import argmax, distance_bucket, log_quotients, once, symmetric_kl
from textquarry.operators import clean, ner, relations, selection
from textquarry.plans import templates
from textquarry.session import load, spread
from textquarry.sources import archives, readers, sinks


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='textquarry-')).rstrip('/')}/files/{uuid.uuid4().hex}"


def _one_file(rows: DataFrame, order: str) -> DataFrame:
    """In order, so that line numbers mean something; these are user-sized files."""
    return rows.coalesce(1).sortWithinPartitions(order)


def _files(rows: DataFrame, order: str) -> DataFrame:
    """Four files, each in order; lines are numbered in each file."""
    part = F.pmod(F.col(order), F.lit(4)).cast("int")
    return rows.withColumn("part", part).repartition(4, "part").sortWithinPartitions("part", order)


def csv_records(spark, sf):
    path = f"{scratch(spark)}/rows.csv"
    rows = _files(load(spark, sf, "customer"), "c_custkey")
    rows.select("part", F.concat(F.lit('say "'), "c_name", F.lit('",\ntwice')).alias("text"), F.col("c_mktsegment").alias("label"), F.when(F.col("c_custkey") % 3 == 0, "train").alias("split")).write.partitionBy("part").csv(path, header=True, escape='"')
    return readers.read_records(spark, path)


def jsonl_records(spark, sf):
    path, k = f"{scratch(spark)}/rows.jsonl", F.col("c_custkey") % 4
    rows = _files(load(spark, sf, "customer"), "c_custkey")
    line = F.concat(F.lit('{"text":'), F.when(k == 0, F.lit("7")).otherwise(F.concat(F.lit('"'), "c_name", F.lit('"'))), F.lit(',"label":"'), "c_mktsegment", F.when(k == 1, '","split":3}').when(k == 2, '","split":"test"}').otherwise('"}'))
    rows.select("part", line.alias("value")).write.partitionBy("part").text(path)
    return readers.read_records(spark, path)


def tsv_labels(spark, sf):
    path = f"{scratch(spark)}/rows"
    line = F.concat("c_name", F.lit("\tof\t"), (F.col("c_custkey") % 3).cast("string"))
    _files(load(spark, sf, "customer"), "c_custkey").select("part", line.alias("value")).write.partitionBy("part").text(path)
    return readers.read_tsv_labels(spark, path, ["a", "b", "c"])


def json_arrays_and_lines(spark, sf):
    path, nation = scratch(spark), load(spark, sf, "nation").select("n_name", "n_regionkey")
    nation.write.json(f"{path}/lines")
    nation.agg(F.concat(F.lit(" \n["), F.array_join(F.collect_list(F.to_json(F.struct("n_name", "n_regionkey"))), ",\n"), F.lit("]"))).write.text(f"{path}/array")  # 25 rows
    both = [readers.read_json_any(spark, f"{path}/{x}", "n_name string, n_regionkey int").withColumn("read", F.lit(x)) for x in ("lines", "array")]
    return both[0].unionAll(both[1]).groupBy("read", "n_regionkey").agg(F.count("*").alias("n"), F.min("n_name").alias("first_name"))


def file_digests(spark, sf):
    path = f"{scratch(spark)}/names"
    _one_file(load(spark, sf, "region"), "r_regionkey").select("r_name").write.text(path)
    return readers.verify_bytes(spark, f"{path}/*.txt").select("size", "sha256", "git_sha1")


def run_descriptions(spark, sf):
    path = f"{scratch(spark)}/runs"
    load(spark, sf, "nation").select(F.col("n_name").alias("run"), F.concat(F.lit('{"status":"completed","seed":'), F.col("n_nationkey").cast("string"), F.lit("}"))).write.partitionBy("run").text(path)
    return readers.read_runs(spark, f"{path}/*/*.txt", "status string, seed int").select("run", "status", "seed")


def zip_archives(spark, sf):
    """Archives of parts by brand against a manifest that leaves some out, has others wrong, and names one that isn't there."""
    rows = load(spark, sf, "part").select("p_brand", F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("member"), "p_name", "p_partkey")

    def packed(key, held):
        import io
        import zipfile

        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in zip(held.member, held.p_name):
                z.writestr(member, text)
        return pd.DataFrame({"path": [key[0]], "content": [out.getvalue()]})

    made = rows.groupBy("p_brand").applyInPandas(packed, "path string, content binary")
    size = F.octet_length("p_name") + F.when(F.col("p_partkey") % 11 == 0, 1).otherwise(0)
    manifest = rows.filter("p_partkey % 7 <> 0").select("member", size.cast("long").alias("size"), F.sha2(F.when(F.col("p_partkey") % 13 == 0, F.lit("x")).otherwise(F.col("p_name")), 256).alias("sha256"))
    manifest = manifest.unionAll(spark.range(1).select(F.lit("gone").alias("member"), F.lit(1).cast("long").alias("size"), F.lit("x").alias("sha256")))
    found = archives.listed_members(made, manifest)
    return found.select("path", "member", F.col("content").cast("string").alias("text"), "reason")


def npz_scores(spark, sf):
    """Score matrices in NPZ files, read as rows: the largest component's place and the sum of each."""
    rows = load(spark, sf, "embeddings").select((F.col("vec_id") % 8).cast("string").alias("file"), "vec_id", "embedding")

    def packed(key, held):
        import io

        import numpy as np
        import pandas as pd

        held, out = held.sort_values("vec_id"), io.BytesIO()
        np.savez_compressed(out, ids=held.vec_id.to_numpy(), scores=np.stack(held.embedding.to_numpy()))
        return pd.DataFrame({"path": [key[0]], "content": [out.getvalue()]})

    held = archives.npz_arrays(rows.groupBy("file").applyInPandas(packed, "path string, content binary"))
    ids = held.filter("name = 'ids'").select("path", "row", F.get("values", F.lit(0)).cast("long").alias("vec_id"))
    scores = held.filter("name = 'scores'").select("path", "row", argmax(F.col("values")).alias("largest"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))
    return ids.join(scores, ["path", "row"]).select("vec_id", "row", "largest", F.round(F.col("total") + 0.0, 6).alias("total"))


def _split_rows(spark, sf):
    rows = load(spark, sf, "part").select(F.concat(F.lit("item "), F.col("p_partkey").cast("string")).alias("text"), F.col("p_brand").alias("label"), F.col("p_partkey").alias("source_line"))
    return rows.withColumn("split", F.when(F.col("source_line") % 10 == 0, "test").when(F.col("source_line") % 10 == 1, "validation").otherwise("train"))


def stored_splits(spark, sf):
    """Split files as they are read again, verified against the fingerprints that writing them gave."""
    path = f"{scratch(spark)}/v1"
    prints = {r.split: r.fingerprint for r in sinks.write_splits(_split_rows(spark, sf), path).collect()}
    rows = spark.read.schema("text string, label string, source_line long, split string").json(path)
    clean.verify_dataset(rows, sorted(r.label for r in rows.select("label").distinct().collect()), prints)
    return rows.groupBy("split", "label").agg(F.count("*").alias("n"), F.sum("source_line").alias("lines"))


def stored_documents(spark, sf):
    """Documents that were added twice, each text once."""
    path = f"{scratch(spark)}/documents"
    docs = templates.parsed(load(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))).drop("doc_id")
    sinks.add_documents(spark, docs, path)
    return sinks.add_documents(spark, docs, path).select("sha256", "id", "text")


def saved_errors(spark, sf):
    """What an evaluation saved as wrong, read again."""
    path = f"{scratch(spark)}/evaluation"
    details = load(spark, sf, "part").select("p_partkey", (F.col("p_size") % 3).alias("truth"), (F.col("p_partkey") % 3).cast("int").alias("prediction")).withColumn("correct", F.col("truth") == F.col("prediction"))
    sinks.save_evaluation(details, details.agg(F.avg(F.col("correct").cast("int")).alias("accuracy")), path)
    wrong, score = spark.read.parquet(f"{path}/errors"), spark.read.parquet(f"{path}/metrics").first().accuracy
    return wrong.select("p_partkey", "truth", "prediction", F.lit(round(score, 9)).alias("accuracy"))


def stress_modes(spark, sf):
    rows = load(spark, sf, "conversations").select("text", F.col("role").alias("label"), (F.col("conv_id") * 1000 + F.col("turn")).alias("source_line")).filter("text IS NOT NULL")
    found = clean.stress_subset(rows, 20, 2027)
    digest = F.when(F.col("mode") == "char_delete_5pct", F.length("text").cast("string")).otherwise(F.sha2("text", 256))
    return found.select("label", "source_line", "mode", digest.alias("digest"), F.sha2("original_text", 256).alias("original"))


TAKEN = "d AS (SELECT * FROM (SELECT text, role AS label, conv_id * 1000 + turn AS source_line, row_number() OVER (PARTITION BY role ORDER BY sha256('2027:' || (conv_id * 1000 + turn)::VARCHAR), (conv_id * 1000 + turn)::VARCHAR) AS r FROM conversations WHERE text IS NOT NULL) WHERE r <= 20)"
MODES = {
    "clean_subset": "sha256(text)",
    "punctuation": "sha256(array_to_string(list_transform(range(0, length(text), 6), lambda i: substr(text, i + 1, 6)), '，'))",
    "char_delete_5pct": "(length(text) - CASE WHEN length(text) < 3 THEN 0 ELSE least(length(text) - 1, greatest(1, round_even(length(text) * 0.05, 0)::BIGINT)) END)::BIGINT::VARCHAR",
    "tail_truncate_30pct": "sha256(substr(text, 1, greatest(1, floor(length(text) * 0.7::DOUBLE))::BIGINT))",
}


def compared_runs(spark, sf):
    runs = load(spark, sf, "events").groupBy(F.col("event_type").alias("run")).agg(F.round(F.avg("value"), 6).alias("macro_f1"))
    for c in ("dataset_sha256", "labels", "split_sha256", "metrics_sha256"):
        runs = runs.withColumn(c, F.lit("x"))
    return selection.compare(runs.withColumn("status", F.lit("completed"))).select("run", "macro_f1")


def recomputed_report(spark, sf):
    """Stored metrics of four runs, one of them changed and one left out, against the saved predictions."""
    path = f"{scratch(spark)}/evaluation"
    details = load(spark, sf, "part").select((F.col("p_partkey") % 4).alias("run"), (F.col("p_size") % 3).alias("truth"), (F.col("p_partkey") % 3).cast("int").alias("prediction"))
    right = (F.col("truth") == F.col("prediction")).cast("int")
    one = details.groupBy("run").agg(F.count("*").cast("double").alias("samples"), F.sum(1 - right).cast("double").alias("errors"), F.avg(right).alias("accuracy"))
    stored = one.select("run", F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("samples", "errors", "accuracy")))))
    stored = stored.filter("run <> 3").withColumn("value", F.when((F.col("run") == 2) & (F.col("metric") == "errors"), F.col("value") + 1).otherwise(F.col("value")))
    sinks.save_evaluation(details.withColumn("correct", right == 1), stored, path)
    read = spark.read.parquet(f"{path}/predictions")
    return selection.recomputed(spark.read.parquet(f"{path}/metrics"), read).select("run", "metric", F.round("recomputed", 9).alias("recomputed"), "agrees")


def guards(spark, sf):
    """Checks that stop a run: which of the cases they refuse."""
    rows = _split_rows(spark, sf)
    runs = lambda *done: spark.createDataFrame([(f"r{i}", s, d, "l", "x", "x", 0.5) for i, (s, d) in enumerate(done)], "run string, status string, dataset_sha256 string, labels string, split_sha256 string, metrics_sha256 string, macro_f1 double")
    schema = lambda *names: relations.schema_frame(spark, [(n, "thing", {"@value": "brand"}) for n in names])
    ids = rows.select(F.col("source_line").alias("doc_id"))
    cases = {
        "splits_for_all": lambda: clean.check_split_policy(rows),
        "splits_for_some": lambda: clean.check_split_policy(rows.withColumn("split", F.when(F.col("source_line") % 2 == 0, F.col("split")))),
        "no_rows": lambda: clean.check_split_policy(rows.limit(0)),
        "classes": lambda: clean.check_classes(rows),
        "one_class": lambda: clean.check_classes(rows.withColumn("label", F.lit("x"))),
        "few_of_a_class": lambda: clean.check_classes(rows, 10**9),
        "no_test_split": lambda: clean.check_classes(rows.filter("split <> 'test'")),
        "a_label_not_in_train": lambda: clean.check_classes(rows.withColumn("label", F.when(F.col("split") == "test", "only").otherwise(F.col("label")))),
        "completed_runs": lambda: selection.comparable(runs(("completed", "d"), ("completed", "d"))),
        "one_run": lambda: selection.comparable(runs(("completed", "d"))),
        "a_running_run": lambda: selection.comparable(runs(("completed", "d"), ("running", "d"))),
        "two_datasets": lambda: selection.comparable(runs(("completed", "d"), ("completed", "e"))),
        "schema": lambda: relations.check_schema(schema("made", "sold")),
        "no_predicate": lambda: relations.check_schema(schema("made").limit(0)),
        "65_predicates": lambda: relations.check_schema(schema(*(f"p{i}" for i in range(65)))),
        "long_names": lambda: relations.check_schema(schema("n" * 81)),
        "aligned": lambda: ner.aligned(ids, ids),
        "a_row_missing": lambda: ner.aligned(ids, ids.filter("doc_id > 3")),
        "a_row_twice": lambda: ner.aligned(ids, ids.unionAll(ids.limit(1))),
    }
    out = []
    for name, case in cases.items():
        try:
            case()
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, refused boolean")


ALLOWED = {"splits_for_all", "classes", "completed_runs", "schema", "aligned"}
REFUSED = ("splits_for_some", "no_rows", "one_class", "few_of_a_class", "no_test_split", "a_label_not_in_train", "one_run", "a_running_run", "two_datasets", "no_predicate", "65_predicates", "long_names", "a_row_missing", "a_row_twice")


def safe_names(spark, sf):
    names = load(spark, sf, "part").select(F.explode(F.array("p_name", "p_brand", "p_type", F.concat_ws("_", "p_type", F.col("p_size").cast("string")))).alias("name"))
    return names.groupBy(tx.safe_name(F.col("name")).alias("safe")).agg(F.count("*").alias("n"))


def score_functions(spark, sf):
    """Places of the largest components, the divergence from the reversed vector, buckets of distances."""
    rows = spread(load(spark, sf, "embeddings").select("vec_id", "embedding")).withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    largest = F.when(F.size("x") > 0, F.coalesce(argmax(F.col("x")), F.lit(0)))
    divergence = once(log_quotients(F.col("x")), lambda p: symmetric_kl(p, F.reverse(p)))
    return rows.select("vec_id", largest.alias("largest"), (F.round(divergence, 6) + F.lit(0.0)).alias("divergence"), distance_bucket(F.col("vec_id") % 161 - 80, relations.DISTANCE_EDGES).alias("bucket"))


LINE = "row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey)"
QUERIES = {
    "csv_records": (csv_records, f"SELECT 'say \"' || c_name || '\",' || chr(10) || 'twice' AS text, c_mktsegment AS label, CASE WHEN c_custkey % 3 = 0 THEN 'train' END AS split, ({LINE} + 1)::BIGINT AS source_line FROM customer"),
    "jsonl_records": (jsonl_records, f"SELECT CASE WHEN c_custkey % 4 > 0 THEN c_name END AS text, c_mktsegment AS label, CASE c_custkey % 4 WHEN 1 THEN '?' WHEN 2 THEN 'test' END AS split, {LINE}::BIGINT AS source_line FROM customer"),
    "tsv_labels": (tsv_labels, f"SELECT c_name || chr(9) || 'of' AS text, ['a', 'b', 'c'][c_custkey % 3 + 1] AS label, {LINE}::BIGINT AS source_line FROM customer"),
    "json_arrays_and_lines": (json_arrays_and_lines, "SELECT read, n_regionkey, count(*)::BIGINT AS n, min(n_name) AS first_name FROM nation, (VALUES ('lines'), ('array')) v(read) GROUP BY 1, 2"),
    "file_digests": (file_digests, "SELECT strlen(t)::BIGINT AS size, sha256(t) AS sha256, sha1(encode('blob ' || strlen(t)::VARCHAR) || '\\x00'::BLOB || encode(t)) AS git_sha1 FROM (SELECT string_agg(r_name || chr(10), '' ORDER BY r_regionkey) AS t FROM region)"),
    "run_descriptions": (run_descriptions, "SELECT 'run=' || n_name AS run, 'completed' AS status, n_nationkey AS seed FROM nation"),
    "zip_archives": (zip_archives, "SELECT p_brand AS path, p_brand || '/' || p_partkey AS member, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 THEN p_name END AS text, CASE WHEN p_partkey % 7 = 0 THEN 'not_listed' WHEN p_partkey % 11 = 0 THEN 'wrong_size' WHEN p_partkey % 13 = 0 THEN 'wrong_sha256' END AS reason FROM part UNION ALL SELECT NULL, 'gone', NULL, 'missing'"),
    "npz_scores": (npz_scores, "SELECT vec_id, row_number() OVER (PARTITION BY vec_id % 8 ORDER BY vec_id) - 1 AS row, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS largest, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) + 0.0, 6) AS total FROM embeddings"),
    "stored_splits": (stored_splits, "SELECT CASE p_partkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, p_brand AS label, count(*)::BIGINT AS n, sum(p_partkey)::BIGINT AS lines FROM part GROUP BY 1, 2"),
    "stored_documents": (stored_documents, "SELECT DISTINCT sha256(p_name) AS sha256, substr(sha256('document:' || sha256(p_name)), 1, 32) AS id, p_name AS text FROM part"),
    "saved_errors": (saved_errors, "SELECT p_partkey, p_size % 3 AS truth, (p_partkey % 3)::INTEGER AS prediction, (SELECT round(avg((p_size % 3 = p_partkey % 3)::INTEGER), 9) FROM part) AS accuracy FROM part WHERE p_size % 3 <> p_partkey % 3"),
    "stress_modes": (stress_modes, f"WITH {TAKEN} " + " UNION ALL ".join(f"SELECT label, source_line, '{m}' AS mode, {x} AS digest, sha256(text) AS original FROM d" for m, x in MODES.items())),
    "compared_runs": (compared_runs, "SELECT event_type AS run, round(avg(value), 6) AS macro_f1 FROM events GROUP BY 1"),
    "recomputed_report": (recomputed_report, """WITH d AS (SELECT p_partkey % 4 AS run, (p_size % 3 <> p_partkey % 3)::INTEGER AS w FROM part), m AS (SELECT run, count(*)::DOUBLE AS samples, sum(w)::DOUBLE AS errors, 1 - avg(w) AS accuracy FROM d GROUP BY run)
SELECT run, metric, round(value, 9) AS recomputed, NOT (run = 3 OR (run = 2 AND metric = 'errors')) AS agrees FROM (SELECT run, unnest(['samples', 'errors', 'accuracy']) AS metric, unnest([samples, errors, accuracy]) AS value FROM m)"""),
    "guards": (guards, "SELECT * FROM (VALUES " + ", ".join([f"('{n}', false)" for n in sorted(ALLOWED)] + [f"('{n}', true)" for n in REFUSED]) + ") v(name, refused)"),
    "safe_names": (safe_names, "SELECT regexp_full_match(n, '[A-Za-z0-9_-]+') AS safe, count(*)::BIGINT AS n FROM (SELECT unnest([p_name, p_brand, p_type, p_type || '_' || p_size]) AS n FROM part) GROUP BY 1"),
    "score_functions": (score_functions, f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
p AS (SELECT vec_id, x, list_transform(x, lambda y: exp(y - list_max(x)) / list_sum(list_transform(x, lambda z: exp(z - list_max(x))))) AS p FROM v)
SELECT vec_id, (list_position(x, list_max(x)) - 1)::INTEGER AS largest, round(0.5 * list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - p[len(p) + 1 - i]) * (ln(p[i]) - ln(p[len(p) + 1 - i])))), 6) + 0.0 AS divergence,
len(list_filter({relations.DISTANCE_EDGES}, lambda e: e < vec_id % 161 - 80))::INTEGER AS bucket FROM p"""),
}

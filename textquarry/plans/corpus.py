"""Corpus queries: identity, duplicates, leakage, splits, samples, variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import text as tx
from textquarry.operators import clean
from textquarry.operators.ranking import hash_rank
from textquarry.session import load
from textquarry.sources import sinks
from textquarry.sources.documents import concatenated

NORMAL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
KEY = f"replace(lower({NORMAL}), 'ß', 'ss')"


def docs(spark, sf):
    """documents with their key, as labelled rows: label is the language, the line is doc_id."""
    return load(spark, sf, "documents").withColumn("key", tx.text_key("text")).withColumn("label", F.col("lang")).withColumn("source_line", F.col("doc_id"))


def normalize_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.normalize("text").alias("t")).select("doc_id", F.sha2("t", 256).alias("sha256"), F.length("t").cast("long").alias("n"))


def text_keys(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2("key", 256).alias("key"))


def dedup_keep_first(spark, sf):
    found = clean.with_facts(docs(spark, sf).withColumn("split", F.lit(None).cast("string")))
    return found.filter("source_line = first_line").select("doc_id", F.sha2("key", 256).alias("key"), "copies")


def dedup_audit(spark, sf):
    rows = docs(spark, sf).withColumn("split", F.lit(None).cast("string"))
    return clean.deduplicated(rows).rejected.select(F.col("source_line").alias("doc_id"), "reason")


def heldout_duplicate_groups(spark, sf):
    g = clean.held_out_duplicates(docs(spark, sf))
    return g.select("key", F.array_join("lines", ",").alias("doc_ids"), F.array_join("labels", ",").alias("labels"), "conflicting")


def label_conflict_quarantine(spark, sf):
    """Groups of equal texts whose rows name different sources."""
    rows = docs(spark, sf).select("doc_id", F.col("source").alias("label"), "key", F.lit(None).cast("string").alias("split"))
    facts = clean.group_facts(rows, line="doc_id")
    return facts.filter("conflict").select(F.lower(F.hex("_key")).alias("key"), "copies", F.col("first_line").alias("first_doc"))


def audit_reasons(spark, sf):
    rows = load(spark, sf, "documents").select(F.col("text"), F.col("source").alias("label"), F.when(F.col("n_chars") % 7 == 0, "dev").alias("split"))
    checked = rows.withColumn("text", tx.normalize("text")).withColumn("label", tx.normalize("label")).withColumn("reason", clean.first_reason(F.col("text"), F.col("label"), F.col("split")))
    return checked.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def leakage_exact(spark, sf):
    bench = load(spark, sf, "benchmark").select(tx.text_key("text").alias("key"))
    return clean.without_held_out(docs(spark, sf), bench, "leak").rejected.select("doc_id", "reason")


def leakage_contains(spark, sf):
    return clean.contained_passages(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


def stratified_split(spark, sf):
    rows = clean.assign_splits(docs(spark, sf).withColumn("key", F.concat_ws("-", F.sha2("key", 256), "doc_id")).withColumn("split", F.lit("")), 42)
    return rows.select("doc_id", "label", "split")


def split_manifest(spark, sf):
    """The manifest's counts by split and label, and its reasons."""
    rows = load(spark, sf, "documents").select("text", F.col("lang").alias("label"), F.lit(None).cast("string").alias("split"), F.col("doc_id").alias("source_line"))
    found = clean.prepare(rows)
    m = sinks.manifest(found.clean, found.rejected)
    counts = m.select("input_rows", F.explode("counts").alias("part", "c")).select("input_rows", "part", F.explode("c").alias("label", "n"))
    return counts.unionAll(m.select("input_rows", F.explode("reasons").alias("part", "n")).select("input_rows", "part", F.lit("").alias("label"), "n"))


def split_fingerprints(spark, sf):
    rows = clean.assign_splits(docs(spark, sf).withColumn("key", F.col("doc_id").cast("string")).withColumn("split", F.lit("")), 42)
    return sinks.fingerprint(rows.select("text", "label", "split", "doc_id"), "split")


def prepared_manifest(spark, sf):
    rows = load(spark, sf, "documents").select("text", F.col("lang").alias("label"), F.lit(None).cast("string").alias("split"), F.col("doc_id").alias("source_line"))
    found = clean.prepare(rows)
    counts = found.clean.groupBy("split").agg(F.count("*").alias("n")).unionByName(found.rejected.groupBy(F.col("reason").alias("split")).agg(F.count("*").alias("n")))
    return counts.select(F.col("split").alias("part"), "n")


def stratified_sample_k(spark, sf):
    rows = load(spark, sf, "documents").withColumn("key", F.col("doc_id").cast("string"))
    return clean.sample_per_class(rows, 25, 1729, "source").select("doc_id", "source")


def budget_slices(spark, sf):
    rows = load(spark, sf, "documents").withColumn("key", F.col("doc_id").cast("string"))
    return clean.budget_slices(rows, {"validation": 100, "test": 150}, 7).select("doc_id", "split")


def event_ranks(spark, sf):
    rows = load(spark, sf, "events").select("event_id", "event_type", F.col("event_id").cast("string").alias("key"))
    return hash_rank(rows, ["event_type"], F.sha2("key", 256), "key").select("event_id", "event_type", F.col("rank").cast("long").alias("rank"), "group_size")


def heldout_chain(spark, sf):
    rows = docs(spark, sf).select("doc_id", "key", "label")
    test, dev, train = (rows.filter(F.col("doc_id") % 5 == 0), rows.filter(F.col("doc_id") % 5 == 1), rows.filter(F.col("doc_id") % 5 > 1))
    own = clean.without_held_out(dev, test, "dev_overlaps_test")
    first = clean.without_held_out(train, test.select("key").unionAll(own.clean.select("key")), "train_overlaps_held_out")
    return own.rejected.select("doc_id", "reason").unionAll(first.rejected.select("doc_id", "reason"))


def source_offsets(spark, sf):
    rows = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    return concatenated(rows, "conv_id", "turn", "text").select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def variant(make):
    return lambda spark, sf: load(spark, sf, "documents").select("doc_id", F.sha2(make(F.col("text")), 256).alias("sha256"))


def char_delete(spark, sf):
    rows = load(spark, sf, "benchmark").select("item_id", "text", tx.thinned(F.col("text"), 2027, F.col("item_id")).alias("t"))
    return rows.select("item_id", F.length("text").cast("long").alias("n"), F.length("t").cast("long").alias("left"))


def search_terms(spark, sf):
    return load(spark, sf, "documents").filter(tx.matches_terms(F.col("text"), "THE of anT")).select("doc_id")


def language_gate(spark, sf):
    return load(spark, sf, "documents").groupBy(tx.cjk_share_ok(F.col("text")).alias("chinese")).agg(F.count("*").alias("n"))


def blob_digests(spark, sf):
    raw = F.col("text").cast("binary")
    return load(spark, sf, "benchmark").select("item_id", F.sha2("text", 256).alias("sha256"), tx.git_blob_sha1(raw).alias("git_sha1"), F.octet_length("text").cast("long").alias("n_bytes"))


def token_lengths(spark, sf):
    rows = load(spark, sf, "documents").select(F.size(F.split(F.trim("text"), r"\s+")).alias("n"))
    return clean.token_length_statistics(rows, "n", 400).select("samples", "truncated", F.col("max_length").cast("long").alias("max_length"))


SPLIT_SQL = """SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS c, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || {key}), {key}) AS r FROM documents"""
SPLIT_CASE = "CASE WHEN r <= greatest(1, floor(c * 0.2)) THEN 'test' WHEN r <= 2 * greatest(1, floor(c * 0.2)) THEN 'validation' ELSE 'train' END"
BY_ID = SPLIT_SQL.format(key="doc_id::VARCHAR")

QUERIES = {
    "normalize_text": (normalize_text, f"SELECT doc_id, sha256({NORMAL}) AS sha256, length({NORMAL})::BIGINT AS n FROM documents"),
    "text_keys": (text_keys, f"SELECT doc_id, sha256({KEY}) AS key FROM documents"),
    "dedup_keep_first": (dedup_keep_first, f"SELECT min(doc_id) AS doc_id, sha256({KEY}) AS key, count(*)::BIGINT AS copies FROM documents GROUP BY {KEY}"),
    "dedup_audit": (dedup_audit, f"""WITH d AS (SELECT doc_id, lang, {KEY} AS k FROM documents), g AS (SELECT k, min(doc_id) AS f, min(lang) <> max(lang) AS c FROM d GROUP BY k)
SELECT doc_id, CASE WHEN c THEN 'conflicting_labels' ELSE 'normalized_duplicate' END AS reason FROM d JOIN g USING (k) WHERE c OR doc_id <> f"""),
    "heldout_duplicate_groups": (heldout_duplicate_groups, f"""SELECT sha256({KEY}) AS key, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids, array_to_string(list_sort(list_distinct(list(lang))), ',') AS labels, count(DISTINCT lang) > 1 AS conflicting
FROM documents GROUP BY {KEY} HAVING count(*) > 1"""),
    "label_conflict_quarantine": (label_conflict_quarantine, f"SELECT sha256({KEY}) AS key, count(*)::BIGINT AS copies, min(doc_id) AS first_doc FROM documents GROUP BY {KEY} HAVING min(source) <> max(source)"),
    "audit_reasons": (audit_reasons, f"SELECT CASE WHEN {NORMAL} = '' THEN 'empty_text_or_label' WHEN length({NORMAL}) > 20000 THEN 'text_or_label_too_long' WHEN n_chars % 7 = 0 THEN 'unknown_split' ELSE 'accepted' END AS reason, count(*)::BIGINT AS n FROM documents GROUP BY 1"),
    "leakage_exact": (leakage_exact, f"SELECT doc_id, 'leak' AS reason FROM documents WHERE {KEY} IN (SELECT {KEY} FROM benchmark)"),
    "leakage_contains": (leakage_contains, "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"),
    "stratified_split": (stratified_split, f"SELECT doc_id, lang AS label, {SPLIT_CASE} AS split FROM ({SPLIT_SQL.format(key=f'sha256({KEY}) || chr(45) || doc_id::VARCHAR')})"),
    "split_manifest": (split_manifest, f"""WITH d AS (SELECT doc_id, lang, {KEY} AS k, length({NORMAL}) AS n FROM documents),
ok AS (SELECT * FROM d WHERE n BETWEEN 1 AND 20000), g AS (SELECT k, min(doc_id) AS f, min(lang) <> max(lang) AS c FROM ok GROUP BY k),
j AS (SELECT doc_id, lang, CASE WHEN c THEN 'conflicting_labels' WHEN doc_id <> f THEN 'normalized_duplicate' END AS reason FROM ok JOIN g USING (k)),
t AS (SELECT lang, greatest(1, floor(count(*) * 0.2))::BIGINT AS h, count(*) AS c FROM j WHERE reason IS NULL GROUP BY lang),
r AS (SELECT unnest(['test', 'validation', 'train']) AS part, lang AS label, unnest([h, h, c - 2 * h])::BIGINT AS n FROM t
UNION ALL SELECT reason, '', count(*)::BIGINT FROM j WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT CASE WHEN n = 0 THEN 'empty_text_or_label' ELSE 'text_or_label_too_long' END, '', count(*)::BIGINT FROM d WHERE n NOT BETWEEN 1 AND 20000 GROUP BY 1)
SELECT (SELECT count(*) FROM documents)::BIGINT AS input_rows, part, label, n FROM r"""),
    "split_fingerprints": (split_fingerprints, None),
    "prepared_manifest": (prepared_manifest, f"""WITH d AS (SELECT doc_id, lang, {KEY} AS k, length({NORMAL}) AS n FROM documents),
ok AS (SELECT * FROM d WHERE n BETWEEN 1 AND 20000), g AS (SELECT k, min(doc_id) AS f, min(lang) <> max(lang) AS c FROM ok GROUP BY k),
j AS (SELECT doc_id, lang, CASE WHEN c THEN 'conflicting_labels' WHEN doc_id <> f THEN 'normalized_duplicate' END AS reason FROM ok JOIN g USING (k)),
s AS (SELECT lang, count(*) AS c FROM j WHERE reason IS NULL GROUP BY lang), t AS (SELECT greatest(1, floor(c * 0.2))::BIGINT AS h, c FROM s)
SELECT 'test' AS part, sum(h)::BIGINT AS n FROM t UNION ALL SELECT 'validation', sum(h)::BIGINT FROM t UNION ALL SELECT 'train', sum(c - 2 * h)::BIGINT FROM t
UNION ALL SELECT reason, count(*)::BIGINT FROM j WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT CASE WHEN n = 0 THEN 'empty_text_or_label' ELSE 'text_or_label_too_long' END, count(*)::BIGINT FROM d WHERE n NOT BETWEEN 1 AND 20000 GROUP BY 1"""),
    "stratified_sample_k": (stratified_sample_k, "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('1729:' || doc_id::VARCHAR)) AS r FROM documents) WHERE r <= 25"),
    "budget_slices": (budget_slices, "SELECT doc_id, CASE WHEN r <= 100 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id::VARCHAR)) AS r FROM documents) WHERE r <= 250"),
    "event_ranks": (event_ranks, "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256(event_id::VARCHAR))::BIGINT AS rank, count(*) OVER (PARTITION BY event_type)::BIGINT AS group_size FROM events"),
    "heldout_chain": (heldout_chain, f"""WITH d AS (SELECT doc_id, {KEY} AS k FROM documents), t AS (SELECT * FROM d WHERE doc_id % 5 = 0), v AS (SELECT * FROM d WHERE doc_id % 5 = 1), r AS (SELECT * FROM d WHERE doc_id % 5 > 1)
SELECT doc_id, 'dev_overlaps_test' AS reason FROM v WHERE k IN (SELECT k FROM t) UNION ALL SELECT doc_id, 'train_overlaps_held_out' FROM r WHERE k IN (SELECT k FROM t) OR k IN (SELECT k FROM v)"""),
    "source_offsets": (source_offsets, """SELECT conv_id, turn, s::BIGINT AS "start", (s + length(text))::BIGINT AS "end" FROM (SELECT conv_id, turn, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations)"""),
    "typography_variant": (variant(tx.full_width), "SELECT doc_id, sha256(translate(text, ',:;()', '，：；（）')) AS sha256 FROM documents"),
    "perturb_punct6": (variant(tx.punctuated), "SELECT doc_id, sha256(array_to_string(list_transform(range(0, length(text), 6), lambda i: substr(text, i + 1, 6)), '，')) AS sha256 FROM documents"),
    "perturb_tail70": (variant(tx.truncated), "SELECT doc_id, sha256(substr(text, 1, greatest(1, floor(length(text) * 0.7::DOUBLE))::BIGINT)) AS sha256 FROM documents"),
    "perturb_char_delete": (char_delete, "SELECT item_id, length(text)::BIGINT AS n, (length(text) - CASE WHEN length(text) < 3 THEN 0 ELSE least(length(text) - 1, greatest(1, round_even(length(text) * 0.05, 0)::BIGINT)) END)::BIGINT AS left FROM benchmark"),
    "search_terms": (search_terms, "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'of') AND contains(lower(text), 'ant')"),
    "language_gate": (language_gate, "SELECT len(regexp_extract_all(text, '[一-鿿]')) >= greatest(3.0, length(text) * 0.15) AS chinese, count(*)::BIGINT AS n FROM documents GROUP BY 1"),
    "blob_digests": (blob_digests, "SELECT item_id, sha256(text) AS sha256, sha1(encode('blob ' || strlen(text)::VARCHAR) || '\\x00'::BLOB || encode(text)) AS git_sha1, strlen(text)::BIGINT AS n_bytes FROM benchmark"),
    "token_lengths": (token_lengths, r"SELECT count(*)::BIGINT AS samples, count(*) FILTER (WHERE n > 400)::BIGINT AS truncated, max(n)::BIGINT AS max_length FROM (SELECT len(regexp_split_to_array(trim(text), '\s+')) AS n FROM documents)"),
}

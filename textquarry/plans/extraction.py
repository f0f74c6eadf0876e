"""Extraction queries: spans, sentences, cues, dictionaries, candidates, concepts.

The driver's tables hold no annotations, so spans are words of their texts and triples are pairs of words.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import spans as sp
from textquarry.operators import alias, evidence, relations, thresholds
from textquarry.session import load, parts
from textquarry.sources.documents import place_blocks, sentences

CUES = {"liquid": r"\bof\b", "article": r"\bthe\b", "toxic": r"idiot|moron", "secret": r"token|key"}


def words(spark, sf, table="benchmark", key="item_id"):
    """(doc_id, start, end, type, text): words of a table's texts, typed by their length."""
    rows = load(spark, sf, table).select(F.col(key).alias("doc_id"), F.inline(sp.text_spans(F.col("text"), "[a-z]+")))
    return rows.withColumn("type", F.when(F.col("end") - F.col("start") > 6, "long").otherwise("short"))


#: Words with offsets: gaps and matches of one pattern, as the engine finds them.
WORDS = r"""
w0 AS (SELECT item_id AS doc_id, text, regexp_split_to_array(text, '[a-zA-Z]+') AS gaps, regexp_extract_all(text, '[a-zA-Z]+') AS hits FROM benchmark),
w1 AS (SELECT doc_id, i, hits[i] AS text, length(gaps[i]) AS g FROM (SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM w0)),
w AS (SELECT doc_id, text, i, (s - length(text))::INTEGER AS "start", s::INTEGER AS "end", CASE WHEN length(text) > 6 THEN 'long' ELSE 'short' END AS type
      FROM (SELECT *, sum(g + length(text)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM w1))
"""


def word_spans(spark, sf):
    return words(spark, sf).select("doc_id", "start", "end", "type", "text")


def documents_as_blocks(spark, sf, table="benchmark", key="item_id"):
    rows = load(spark, sf, table).withColumn("doc_id", F.col(key))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    blocks = F.transform(lines, lambda x: F.struct(F.trim(x).alias("text"), F.lit("body").alias("section"), F.lit("paragraph").alias("kind"), F.lit("").alias("locator")))
    rows = rows.withColumn("blocks", place_blocks(blocks))
    return rows.withColumn("text", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n"))


def sentence_counts(spark, sf):
    found = sentences(documents_as_blocks(spark, sf, "documents", "doc_id"), "doc_id")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


def cue_classification(spark, sf):
    rows = load(spark, sf, "documents").select(F.explode(evidence.categories(F.col("text"), CUES)).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def qualifier_spans(spark, sf):
    found = load(spark, sf, "documents").select("doc_id", F.explode(evidence.qualifiers(F.col("text"), 0, CUES)).alias("name", "spans"))
    return found.select("doc_id", "name", F.size("spans").cast("long").alias("n")).filter("n > 0")


def number_atoms(spark, sf):
    rows = load(spark, sf, "pages").select("page_id", F.explode(evidence.numbers(F.col("html"))).alias("x")).select("page_id", "x.normalized.*")
    return rows.groupBy("kind", "unit").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def nested_decode(spark, sf):
    s = words(spark, sf, "documents", "doc_id").filter("type = 'long'").withColumn("end", F.col("end") + F.pmod(F.col("start"), F.lit(11))).withColumn("score", F.pmod(F.hash("text"), F.lit(100)) / 10.0)
    return thresholds.decode(s.select("doc_id", "start", "end", "type", "score"), {"long": 3.0, "short": 3.0}, "nested")


def threshold_decode(spark, sf):
    s = words(spark, sf).withColumn("score", (F.pmod(F.col("start"), F.lit(10))).cast("double"))
    return thresholds.decode(s, {"long": 4.0, "short": 6.0}).select("doc_id", "start", "end", "type")


def dictionary_terms(spark, sf):
    rows = load(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("text"))
    # the surface itself is the text, so that whole documents aren't repeated for each word
    surfaces = rows.select("text", F.lit(0).alias("start"), F.length("text").alias("end"))
    return relations.dictionary(surfaces.withColumn("type", F.when(F.col("end") > 6, "long").otherwise("short")), 20)


def topk_candidates_capped(spark, sf):
    line = load(spark, sf, "lineitem")
    scores = line.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("type_id"), F.pmod("l_partkey", F.lit(90)).cast("int").alias("first"), F.pmod(F.col("l_partkey") + F.col("l_linenumber") * 20, F.lit(90)).cast("int").alias("last"), (F.col("l_quantity") - 20).alias("logit"), F.col("l_orderkey"))
    tokens = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(89))).alias("token")).withColumn("start", F.col("token") * 2).withColumn("end", F.col("start") + F.when(F.col("token") % 13 == 0, 0).otherwise(2))
    n = parts(line)
    # what is not above the threshold of 0 is never the best; dealt out before it is grouped, so no task holds more groups than its share
    best = scores.filter("logit > 0").repartition(n, "doc_id", "type_id", "first", "last").groupBy("doc_id", "type_id", "first", "last").agg(F.max("logit").alias("logit"))
    return relations.candidate_entities(best, tokens, parts=n).select("doc_id", "type_id", "first", "last", "logit", "capped")


def schema(spark):
    return relations.schema_items(relations.schema_frame(spark, [("pairs", "long", {"@value": "short", "other": "long"}), ("rhymes", "short", {"@value": "short"})]))


def schema_slots(spark, sf):
    return schema(spark).select("id", "label", "subject_type", "object_type")


def candidate_pairs_type_join(spark, sf):
    top = words(spark, sf).withColumn("score", F.col("end").cast("double"))
    pairs = relations.candidate_pairs(top, schema(spark))
    return pairs.groupBy("doc_id", "rel").agg(F.count("*").alias("n"), F.max(F.least("s_score", "o_score")).alias("best"))


def spread_negatives(spark, sf):
    pairs = load(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("doc_id"), (F.col("l_partkey") % 97 == 0).alias("positive"), "l_orderkey", "l_linenumber")
    return relations.spread_negatives(pairs, "l_orderkey", "l_linenumber").select("doc_id", "l_orderkey", "l_linenumber", "positive")


def merged_windows(spark, sf):
    e = words(spark, sf).withColumn("base", F.pmod("start", F.lit(3)) * 10).withColumn("score", F.col("end").cast("double")).withColumn("start", F.floor(F.col("start") / 10).cast("int")).withColumn("end", F.floor(F.col("end") / 10).cast("int") + 1)
    none = e.select("doc_id", "base", *(F.lit(0).alias(c) for c in ("s_start", "s_end")), F.lit("").alias("s_type"), F.lit(0).alias("rel"), *(F.lit(0).alias(c) for c in ("o_start", "o_end")), F.lit("").alias("o_type"), F.lit(0.0).alias("score")).limit(0)
    merged, _ = relations.merge_windows(e, none)
    return relations.numbered(merged).select("doc_id", "id", "start", "end", "type", "score")


def concept_ids(spark, sf):
    part = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"), F.col("p_type").alias("canonical"))
    found = alias.concepts(part.withColumn("concept_id", alias.concept_id(F.col("type"), F.col("canonical"))))
    return found.select("id", "canonical", "type", F.size("mentions").cast("long").alias("mentions"))


def relation_groups(spark, sf):
    line = load(spark, sf, "lineitem").join(load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    rows = line.select(F.col("p_brand").alias("subject_text"), F.lit("brand").alias("subject_type"), F.col("l_returnflag").alias("predicate"), F.col("l_linestatus").alias("slot"), (F.col("l_suppkey") % 5).cast("string").alias("object_text"), F.lit("n").alias("object_type"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("subject"), F.col("l_linenumber").alias("object"))
    return relations.group_relations(rows).select("subject_text", "predicate", "slot", "object_text", "confidence", F.size("mention_links").cast("long").alias("links"))


def token_windows(spark, sf):
    rows = load(spark, sf, "benchmark").select("item_id", F.inline(sp.token_windows(sp.character_tokens(F.col("text")), 60, 20)))
    return rows.select("item_id", "start", "end")


def ambiguity(spark, sf):
    first = F.regexp_extract("text", "[a-zA-Z]+", 0)
    return load(spark, sf, "benchmark").select("item_id", sp.count_of(F.col("text"), first).cast("long").alias("n"), sp.first_at(F.col("text"), first).cast("long").alias("at"), F.size(sp.occurrences(F.col("text"), first)).cast("long").alias("overlapping"))


def evidence_records(spark, sf):
    found = sentences(documents_as_blocks(spark, sf), "doc_id")
    return evidence.candidates(found).select("doc_id", "id", "category", "start", "end")


def html_articles(spark, sf):
    """Pages as documents: tags become line breaks."""
    from textquarry.sources.documents import parse_documents

    raw = load(spark, sf, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", "\n").alias("content"), F.lit("text").alias("format"), F.col("url").alias("title"), F.lit("pages").alias("source"))
    return parse_documents(raw).select("page_id", F.size("blocks").alias("blocks"), "sha256", "error")


PAIRS_SQL = f"WITH {WORDS}, t AS (SELECT * FROM w), sch AS (SELECT * FROM (VALUES (0, 'long', 'short'), (1, 'long', 'long'), (2, 'short', 'short')) v(rel, s, o))"

QUERIES = {
    "word_spans": (word_spans, f'WITH {WORDS} SELECT doc_id, "start", "end", type, text FROM w'),
    "sentence_counts": (sentence_counts, None),
    "cue_classification": (cue_classification, " UNION ALL ".join(f"SELECT '{n}' AS category, count(*)::BIGINT AS n FROM documents WHERE regexp_matches(text, '{p}', 'i') HAVING count(*) > 0" for n, p in CUES.items())),
    "qualifier_spans": (qualifier_spans, " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, len(regexp_extract_all(text, '{p}', 0, 'i'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '{p}', 'i')" for n, p in CUES.items())),
    "number_atoms": (number_atoms, None),
    "nested_decode": (nested_decode, None),
    "threshold_decode": (threshold_decode, f"WITH {WORDS} SELECT doc_id, \"start\", \"end\", type FROM w WHERE \"start\" % 10 > CASE type WHEN 'long' THEN 4 ELSE 6 END"),
    "dictionary_terms": (dictionary_terms, "SELECT t AS term, CASE WHEN length(t) > 6 THEN 'long' ELSE 'short' END AS type, count(*)::BIGINT AS support FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents) WHERE length(t) >= 2 GROUP BY t HAVING count(*) >= 20"),
    "topk_candidates_capped": (topk_candidates_capped, """WITH s AS (SELECT l_suppkey AS doc_id, l_linenumber % 3 AS type_id, (l_partkey % 90)::INTEGER AS "first", ((l_partkey + l_linenumber * 20) % 90)::INTEGER AS "last", max(l_quantity - 20) AS logit FROM lineitem GROUP BY 1, 2, 3, 4),
f AS (SELECT * FROM s WHERE logit > 0 AND "first" <= "last" AND "last" - "first" < 64 AND "first" % 13 <> 0 AND "last" % 13 <> 0)
SELECT doc_id, type_id, "first", "last", logit, c > 64 AS capped FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY logit DESC, "first", "last", type_id) AS r FROM f) WHERE r <= 64"""),
    "schema_slots": (schema_slots, "SELECT * FROM (VALUES (0, 'pairs', 'long', 'short'), (1, 'pairs / other', 'long', 'long'), (2, 'rhymes', 'short', 'short')) v(id, label, subject_type, object_type)"),
    "candidate_pairs_type_join": (candidate_pairs_type_join, f'{PAIRS_SQL} SELECT a.doc_id, rel, count(*)::BIGINT AS n, max(least(a."end", b."end"))::DOUBLE AS best FROM t a JOIN sch ON a.type = sch.s JOIN t b ON a.doc_id = b.doc_id AND b.type = sch.o GROUP BY 1, 2'),
    "spread_negatives": (spread_negatives, """WITH p AS (SELECT l_suppkey % 10 AS doc_id, l_partkey % 97 = 0 AS positive, l_orderkey, l_linenumber FROM lineitem),
c AS (SELECT *, count(*) FILTER (WHERE positive) OVER (PARTITION BY doc_id) AS np, count(*) FILTER (WHERE NOT positive) OVER (PARTITION BY doc_id) AS nn, row_number() OVER (PARTITION BY doc_id, positive ORDER BY l_orderkey, l_linenumber) - 1 AS i FROM p),
m AS (SELECT *, greatest(64, np) - np AS k FROM c)
SELECT doc_id, l_orderkey, l_linenumber, positive FROM m WHERE positive OR nn <= k OR (k > 0 AND list_contains(list_transform(range(0, k), lambda j: CASE WHEN k > 1 THEN floor(j * ((nn - 1)::DOUBLE / (k - 1)))::BIGINT ELSE 0 END), i))"""),
    "merged_windows": (merged_windows, f"""WITH {WORDS}, e AS (SELECT doc_id, ("start" // 10 + ("start" % 3) * 10)::INTEGER AS s, ("end" // 10 + 1 + ("start" % 3) * 10)::INTEGER AS e, type, "end"::DOUBLE AS score FROM w),
g AS (SELECT doc_id, s, e, type, max(score) AS score FROM e GROUP BY ALL)
SELECT doc_id, 'e' || (row_number() OVER (PARTITION BY doc_id ORDER BY s, e, type) - 1) AS id, s AS "start", e AS "end", type, score FROM g"""),
    "concept_ids": (concept_ids, "SELECT 'local:' || substr(sha256(p_brand || chr(0) || p_type), 1, 16) AS id, p_type AS canonical, p_brand AS type, count(*)::BIGINT AS mentions FROM part GROUP BY p_brand, p_type"),
    "relation_groups": (relation_groups, "SELECT p_brand AS subject_text, l_returnflag AS predicate, l_linestatus AS slot, (l_suppkey % 5)::VARCHAR AS object_text, max(l_discount) AS confidence, count(*)::BIGINT AS links FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4"),
    "token_windows": (token_windows, r"""WITH p AS (SELECT item_id, list_filter(range(0, length(text)), lambda i: NOT regexp_matches(substr(text, i + 1, 1), '\s')) AS pos FROM benchmark)
SELECT item_id, pos[k * 40 + 1]::INTEGER AS "start", (pos[least(k * 40 + 60, len(pos))] + 1)::INTEGER AS "end" FROM (SELECT item_id, pos, unnest(range(0, 1 + greatest(ceil((len(pos) - 60) / 40.0), 0)::BIGINT)) AS k FROM p WHERE len(pos) > 0)"""),
    "ambiguous_mentions": (ambiguity, "SELECT item_id, ((length(text) - length(replace(text, f, ''))) // length(f))::BIGINT AS n, (strpos(text, f) - 1)::BIGINT AS at, len(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(f)) = f))::BIGINT AS overlapping FROM (SELECT item_id, text, regexp_extract(text, '[a-zA-Z]+') AS f FROM benchmark)"),
    "evidence_records": (evidence_records, None),
    "html_articles": (html_articles, None),
}

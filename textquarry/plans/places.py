"""Queries that find places in whole documents: dictionaries, spans against spans, and the search index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from textquarry.functions import spans as sp
from textquarry.operators import index, intervals, relations
from textquarry.plans.storage import scratch
from textquarry.session import load


def lexicon(spark, sf):
    """Words of the benchmark that are frequent there, of twelve letters at most."""
    rows = load(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("text"))
    surfaces = rows.select("text", F.lit(0).alias("start"), F.length("text").alias("end"), F.when(F.length("text") > 6, "long").otherwise("short").alias("type"))
    return relations.dictionary(surfaces, 5).filter(F.length("term") <= 12)


def dictionary_matches(spark, sf):
    found = relations.dictionary_matches(load(spark, sf, "documents"), lexicon(spark, sf))
    return found.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.min("start").alias("first"))


def dictionary_parts(spark, sf):
    """The same with a lexicon that is dealt out to many automata."""
    found = relations.dictionary_matches(load(spark, sf, "documents").select("doc_id", "text"), lexicon(spark, sf), 64)
    return found.groupBy("type").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


def _words(spark, sf, pattern):
    return load(spark, sf, "documents").select("doc_id", F.inline(sp.text_spans(F.col("text"), pattern))).select("doc_id", "start", "end")


def span_overlap(spark, sf):
    """Pairs of words that overlap once three characters are added to each."""
    words = _words(spark, sf, "[a-z]+").withColumn("end", F.col("end") + 3)
    pairs = intervals.overlapping(words, words, rising=True)
    return pairs.groupBy(F.col("left.doc_id").alias("doc_id")).agg(F.count("*").alias("n"))


def span_containment(spark, sf):
    """Long words of each line, by the line's offset."""
    pairs = intervals.holding(_words(spark, sf, "[^\n]+"), _words(spark, sf, "[a-z]{7,}"))
    return pairs.groupBy(F.col("left.doc_id").alias("doc_id"), F.col("left.start").alias("start")).agg(F.count("*").alias("n"), F.max("right.end").alias("last"))


def first_holder(spark, sf):
    """The line that each long word stands in: spans that were found apart, joined by position."""
    words = intervals.first_holding(_words(spark, sf, "[a-z]{7,}"), _words(spark, sf, "[^\n]+"))
    return words.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("held_by").alias("held"), F.sum("held_by.start").alias("starts"))


def _records(spark, sf):
    return load(spark, sf, "documents").select(F.col("source").alias("extraction_id"), F.col("doc_id").cast("string").alias("record_id"), "text")


def _indexed(spark, sf):
    """An index of all documents in two segments."""
    path, rows = f"{scratch(spark)}/index", _records(spark, sf)
    for segment in (0, 1):
        index.append(rows.filter(F.pmod(F.crc32(F.col("record_id").cast("binary")), F.lit(2)) == segment), path, segment)
    return path


def indexed_search(spark, sf):
    return index.search(spark, _indexed(spark, sf), "the IDIOT", 50)


#: Searches of one, two, three and more characters, of several terms, and without a hit.
SEARCHES = ("q", "É", "ok", "the", "of the", "IDIOT", "zq9", "a e i O", "licens", "ß strasse")


def indexed_terms(spark, sf):
    path = _indexed(spark, sf)
    found = [index.find(spark, path, q).agg(F.count("*").alias("n"), F.min("record_id").alias("first")).select(F.lit(q).alias("query"), "n", "first") for q in SEARCHES]
    return reduce(lambda a, b: a.unionAll(b), found)


def updated_search(spark, sf):
    """Every third document is appended again with another text, and the index compacted."""
    path = _indexed(spark, sf)
    index.append(_records(spark, sf).filter("record_id % 3 = 0").withColumn("text", F.concat(F.lit("renewed from "), "extraction_id")), path, 2)
    to = f"{scratch(spark)}/compacted"
    index.compact(spark, path, to)
    both = [index.find(spark, p, q).groupBy("extraction_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("read"), F.lit(q).alias("query"), "extraction_id", "n") for name, p in (("segments", path), ("compacted", to)) for q in ("the", "renewed from")]
    return reduce(lambda a, b: a.unionAll(b), both)


def _contains(query, text="text"):
    return " AND ".join(f"contains(lower({text}), lower('{t}'))" for t in query.split())


#: The twelve characters from each place on, and the lexicon.
GRAMS = """
lex AS (SELECT term, CASE WHEN length(term) > 6 THEN 'long' ELSE 'short' END AS type FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS term FROM benchmark)
        WHERE length(term) BETWEEN 2 AND 12 GROUP BY 1 HAVING count(*) >= 5),
c AS (SELECT doc_id, unnest(range(0, length(text))) AS s, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''),
g AS (SELECT doc_id, s, c""" + "".join(f" || coalesce(lead(c, {k}) OVER w, '')" for k in range(1, 12)) + """ AS g FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
m AS (SELECT doc_id, s, s + n AS e, type FROM (SELECT doc_id, s, n, substr(g, 1, n) AS term FROM g, (SELECT DISTINCT length(term) AS n FROM lex) WHERE length(g) >= n) JOIN lex USING (term))
"""  # fmt: skip


def _placed(name, pattern, n):
    """Words with offsets, from the gaps between them."""
    return f"""{name}0 AS (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits FROM documents),
{name}1 AS (SELECT doc_id, i, length(gaps[i]) AS g, length(hits[i]) AS h FROM (SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM {name}0)),
{name} AS (SELECT doc_id, {n} AS keep, (s - h)::BIGINT AS s, s::BIGINT AS e FROM (SELECT *, sum(g + h) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM {name}1))"""


WORDS, LINES = _placed("w", "[a-zA-Z]+", "h > 6"), _placed("l", "[^\\n]+", "true")
HELD = f"WITH {WORDS}, {LINES}, h AS (SELECT w.doc_id, w.s, w.e, l.s AS ls, l.e AS le FROM w ASOF LEFT JOIN l ON w.doc_id = l.doc_id AND w.s >= l.s WHERE w.keep)"

QUERIES = {
    "dictionary_matches": (dictionary_matches, f"WITH {GRAMS} SELECT doc_id, type, count(*)::BIGINT AS n, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends, min(s)::INTEGER AS first FROM m GROUP BY 1, 2"),
    "dictionary_parts": (dictionary_parts, f"WITH {GRAMS} SELECT type, count(*)::BIGINT AS n, sum(s)::BIGINT AS starts FROM m GROUP BY 1"),
    "span_overlap": (span_overlap, f'WITH {WORDS}, o AS (SELECT doc_id, count(*) OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN 1 FOLLOWING AND (e - s + 2) FOLLOWING) AS n FROM w) SELECT doc_id, sum(n)::BIGINT AS n FROM o GROUP BY 1 HAVING sum(n) > 0'),
    "span_containment": (span_containment, f'{HELD} SELECT doc_id, ls::INTEGER AS "start", count(*)::BIGINT AS n, max(e)::INTEGER AS "last" FROM h WHERE e <= le GROUP BY 1, 2'),
    "first_holder": (first_holder, f"{HELD} SELECT doc_id, count(*)::BIGINT AS n, count(ls) FILTER (WHERE e <= le)::BIGINT AS held, sum(ls) FILTER (WHERE e <= le)::BIGINT AS starts FROM h GROUP BY 1"),
    "indexed_search": (indexed_search, "SELECT source AS extraction_id, doc_id::VARCHAR AS record_id, text FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'idiot') ORDER BY 1, 2 LIMIT 50"),
    "indexed_terms": (indexed_terms, " UNION ALL ".join(f"SELECT '{q}' AS query, count(*)::BIGINT AS n, min(doc_id::VARCHAR) AS first FROM documents WHERE {_contains(q)}" for q in SEARCHES)),
    "updated_search": (updated_search, "WITH d AS (SELECT source AS extraction_id, CASE WHEN doc_id % 3 = 0 THEN 'renewed from ' || source ELSE text END AS text FROM documents) " + " UNION ALL ".join(f"SELECT '{r}' AS read, '{q}' AS query, extraction_id, count(*)::BIGINT AS n FROM d WHERE {_contains(q)} GROUP BY extraction_id" for r in ("segments", "compacted") for q in ("the", "renewed from"))),
}

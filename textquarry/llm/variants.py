"""Spelling variants of a corpus's vocabulary, found without ever putting two words side by side.

Words are counted first: each Arrow batch sends its different words with their counts, so a frequent word is combined
before it is shuffled. Words are near if one inserted, deleted or replaced code point turns one into the other.

Replacements: a word of n code points belongs to n groups (position, prefix, suffix), written as the word with a
wildcard at the position. All words of a group differ there and only there, so a group's size and its top two words tell
each member how many near words it has there and which is the best: the first, or the second for the first itself. A
group has at most one word for each letter of the alphabet (some 90 here), whatever the corpus.

Insertions and deletions: a word's different deletions join the vocabulary. A word and its deletion are near; the
shorter word gets the number and the best of the longer ones, the longer word those of its deletions.

All of these are contributions (word, number, best), which one combined aggregation adds up. The form of a word is its
best near word if that is frequent enough; roots are found by pointer doubling over the written table of forms, in as
many rounds as the logarithm of the longest chain (counts at least double along a chain, so it is short).

Joins are sorted ones: a compressed table of words looks small enough to be broadcast, but is many times larger in the
driver's memory, and grows with the vocabulary.

Contract: null texts have no words; a null doc_id counts as the empty text where words are altered. Rows are read as
they are, repeated ones too. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm._shared import pick, tidy, written

#: Bytes of text that are read at once.
STEP = 8 << 20
WILD = "*"


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to A-Z, a-z, U+00C0-U+00FF: the latter are C3 and a byte that follows it."""
    low = data | 0x20
    wide = data == 0xC3
    wide[1:] |= wide[:-1]
    return ((low >= 97) & (low <= 122)) | wide


def runs(texts: pa.Array, step: int = STEP):
    """(number of the text, run) of all runs of letters, A-Z lower-cased, some megabytes at a time as two arrays.

    texts: large_string. A window ends between runs, so a very long text is read in parts.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + step, end)
        while to < end:  # on to a byte that is no letter's
            rest = np.flatnonzero(~_letters(data[to - 1 : to + 4096])[1:])
            if len(rest):
                to += int(rest[0])
                break
            to = min(to + 4096, end)
        window = data[at:to]
        letter = _letters(window)
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        opened = offsets[(offsets >= at) & (offsets < to)] - at
        first[opened] = letter[opened]
        starts = np.flatnonzero(first)
        kept = window[letter]
        kept = np.where((kept >= 65) & (kept <= 90), kept | 0x20, kept)
        bounds = np.concatenate([np.cumsum(letter)[starts] - 1, [len(kept)]]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(kept))])
        yield np.searchsorted(offsets, starts + at, side="right") - 1, words
        at = to


def thinned(word: str, h: int) -> str:
    """The word without the code point at h modulo its length."""
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def word_counts(docs: DataFrame, min_chars: int, every: int, step: int = STEP) -> DataFrame:
    """(word, n) of docs (doc_id, text): words of ``min_chars`` code points or more.

    every: where it divides the CRC-32 of ``<doc_id>:<word>``, the word loses a code point in that document (0: never).
    """
    docs = pick(docs, "doc_id", "text").filter("text IS NOT NULL")
    docs = docs.select(F.coalesce(docs.doc_id.cast("string"), F.lit("")).alias("doc_id"), docs.text.cast("string").alias("text"))

    @tidy
    def run(batches):
        for batch in batches:
            prefix = [crc32(f"{i}:".encode()) for i in batch.column(0).to_pylist()]
            for doc, words in runs(batch.column(1).cast(pa.large_string()), step):
                coded = words.dictionary_encode()
                known, code = coded.dictionary.cast(pa.large_binary()).to_pylist(), np.asarray(coded.indices).astype(np.int64)
                count, altered = np.bincount(code, minlength=len(known)), {}
                if every and known:
                    pair, times = np.unique(doc * len(known) + code, return_counts=True)
                    d, c = pair // len(known), pair % len(known)
                    h = np.array([crc32(known[j], prefix[i]) for i, j in zip(d.tolist(), c.tolist())], np.int64)
                    hit = np.flatnonzero(h % every == 0)
                    np.subtract.at(count, c[hit], times[hit])
                    for k in hit.tolist():
                        new = thinned(known[c[k]].decode(), int(h[k]))
                        altered[new] = altered.get(new, 0) + int(times[k])
                word = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array(list(altered), pa.string())])
                n = pa.array(np.concatenate([count, np.array(list(altered.values()), np.int64)]))
                keep = pc.and_(pc.greater_equal(pc.utf8_length(word), min_chars), pc.greater(n, 0))
                yield pa.RecordBatch.from_arrays([word.filter(keep), n.filter(keep)], ["word", "n"])

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _best(n: str, word: str):
    """Orders words by count, the highest first, then by code points."""
    return F.struct((-F.col(n)).alias("neg"), F.col(word).alias("word"))


def replacements(words: DataFrame) -> DataFrame:
    """(word, near, best) for each wildcard group with more than one word."""
    at = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    wild = F.concat(F.substring(F.col("word"), F.lit(1), F.col("i") - 1), F.lit(WILD), F.substr("word", F.col("i") + 1))
    groups = at.groupBy(wild.alias("wild")).agg(F.sort_array(F.collect_list(_best("n", "word"))).alias("members")).filter(F.size("members") > 1)
    groups = groups.select(F.size("members").alias("size"), F.element_at("members", 1).alias("first"), F.element_at("members", 2).alias("second"), F.explode("members.word").alias("word"))
    return groups.select("word", (F.col("size") - 1).cast("long").alias("near"), F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first")).alias("best"))


def indels(words: DataFrame) -> DataFrame:
    """(word, near, best) of words and their deletions that are words; each deletion meets one word at most."""
    at = F.sequence(F.lit(1), F.length("word"))
    cut = F.array_distinct(F.transform(at, lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substr(F.col("word"), i + 1))))
    cuts = words.select("word", "n", F.explode(cut).alias("cut"))
    shorter = words.select(F.col("word").alias("cut"), F.col("n").alias("cut_n"))
    met = cuts.join(shorter.hint("merge"), "cut")
    down = met.select("word", F.lit(1).cast("long").alias("near"), _best("cut_n", "cut").alias("best"))
    up = met.groupBy(F.col("cut")).agg(F.count("*").alias("near"), F.min(_best("n", "word")).alias("best")).withColumnRenamed("cut", "word")
    return down.unionByName(up)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last word that the forms lead to, for each word that has a form."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        then = written(now.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        now = then.select("word", "root")
        if then.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word, n), which are different and hold no ``*``."""
    near = replacements(words).unionByName(indels(words)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    found = words.join(near.hint("merge"), "word", "left").withColumn("formed", F.coalesce(-F.col("best.neg") >= F.col("n") * factor, F.lit(False)))
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("formed"), F.col("best.word")).alias("form"), F.when(F.col("formed"), -F.col("best.neg")).alias("form_n")), "forms")
    return found.join(roots(found.filter("form IS NOT NULL")).hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(docs: DataFrame, min_chars: int = 5, min_count: int = 3, every: int = 97, factor: int = 2, step: int = STEP) -> DataFrame:
    words = written(word_counts(docs, min_chars, every, step).filter(F.col("n") >= min_count), "words")
    return variants(words, factor).select("word", "form", "root", "n", "n_near", "form_n")

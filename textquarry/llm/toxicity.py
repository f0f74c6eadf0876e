"""Toxicity by subword-bag embeddings, averaged into a linear softmax and trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (the space at either end counts as a
character), a text's vector the mean of its words' vectors, and a linear softmax reads it. Vectors and softmax
are learned together by AdaGrad with a proximal step that draws unneeded vectors to zero, so a misspelling that was never seen shares the vectors of its n-grams.
Since the softmax is linear, what the executors need of the model is one number for each hashed n-gram.

Contract: texts without words (null, empty, white space) score by the softmax's bias alone; without any
labelled row every score is 0, with one label only it is that label. Rows with null or conflicting labels:
null ones are not used, of conflicting ones the higher label is. Repeated rows are scored alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm._sample import piece, remainder, sampled
from textquarry.llm._shared import pick, release, tidy
from textquarry.llm._words import split_words

BUCKETS, GRAMS, DIM = 1 << 20, (3, 4, 5, 6), 4
#: The bounded sample that is learned from: documents with label 0 and with label 1, and characters of one document (a
#: longer one is learned from a part of it).
CLEAN, TOXIC, MAX_CHARS = 6000, 3000, 20_000
#: Distinct words kept in a task's memory, and words of a batch that are hashed at once.
CACHE_WORDS, STEP = 1 << 18, 1 << 14


@np.errstate(over="ignore")
def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) for each n-gram of each word."""
    text = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = text == 32
    word = np.cumsum(space) - 1
    x = (text + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    at, bucket = [], []
    inner = np.concatenate([[0], np.cumsum(space)])
    for n in GRAMS:
        m = len(x) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for i in range(n):
            h = (h ^ x[i : i + m]) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(31)
        whole = np.flatnonzero(inner[n - 1 : n - 1 + m] == inner[1 : m + 1])  # no space but at the ends
        at.append(word[whole])
        bucket.append((h[whole] & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(at), np.concatenate(bucket)


def calibrated(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(slope, shift) that make logits fit labels best (Platt 1999), by Newton's method: the proximal step has drawn them together."""
    n = np.bincount(label, minlength=2)
    target = np.where(label == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x, beta = np.stack([logit, np.ones(len(logit))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        beta = beta - step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def train(rows: list[tuple[int, str]], epochs: int = 10, batch: int = 64, rate: float = 0.5, eps: float = 1e-6, min_docs: int = 5, shrink: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, float]:
    """(a number for each bucket, bias): the difference of the two classes' logits, linear in the n-grams."""
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    bags = []
    for lo in range(0, len(rows), 256):
        index, n, distinct = split_words(pa.array([t for _, t in rows[lo : lo + 256]], pa.string()), "utf8")
        number = np.fromiter((vocab.setdefault(w.decode(), len(vocab)) for w in distinct), np.int32, len(distinct))
        for (label, _), own in zip(rows[lo:], np.split(number[index], np.cumsum(n)[:-1])):
            ids, count = np.unique(own, return_counts=True)
            bags.append((int(label), ids, (count / max(1, count.sum())).astype(np.float32)))
    words, holders = list(vocab), np.zeros(len(vocab), np.int64)
    del vocab
    for _, ids, _ in bags:
        holders[ids] += 1
    # in steps, which bounds the memory
    steps = range(0, len(words), STEP)
    texts, known = np.zeros(BUCKETS), 0
    for lo in steps:
        at, found = grams(words[lo : lo + STEP])
        known += len(found)
        texts += np.bincount(found, holders[lo + at], BUCKETS)
    # n-grams of fewer texts keep vectors of zero: they would only learn by heart
    used = np.flatnonzero(texts >= min_docs)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    size, all_size, filled = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
    bucket = np.empty(known, np.int32)
    for lo in steps:
        part = words[lo : lo + STEP]
        at, found = grams(part)
        all_size[lo : lo + STEP] = np.bincount(at, minlength=len(part))
        keep = place[found] >= 0
        at, found = at[keep], place[found[keep]]
        size[lo : lo + STEP] = np.bincount(at, minlength=len(part))
        bucket[filled : filled + len(at)] = found[np.argsort(at, kind="stable")]
        filled += len(at)
    bucket = bucket[:filled]
    del words
    first = np.cumsum(size) - size
    v = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    # the softmax starts from clean, so that common words needn't speak for it
    w, b = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.array([1.5, -1.5], np.float32)
    sv, sw, sb = np.full((len(used), 1), eps, np.float32), 1e-4, 1e-4
    scale = np.float32(100)  # of the mean, so that a few words of a long text count
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for lo in range(0, len(bags), batch):
            if lo == 0:
                perm = rng.permutation(len(bags))
            part = [bags[i] for i in perm[lo : lo + batch]]
            y = np.array([p[0] for p in part])
            n = np.array([len(p[1]) for p in part])
            ids, weight = np.concatenate([p[1] for p in part]), np.concatenate([p[2] for p in part])
            doc = np.repeat(np.arange(len(part)), n)
            own, back = np.unique(ids, return_inverse=True)
            k = size[own]
            g = bucket[np.repeat(first[own] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))]
            word = np.repeat(np.arange(len(own)), k)
            per = (1 / np.maximum(all_size[own], 1)).astype(np.float32)
            vec = np.stack([np.bincount(word, v[g, d], len(own)) for d in range(DIM)], 1).astype(np.float32) * per[:, None]
            mean = scale * np.stack([np.bincount(doc, weight * vec[back, d], len(part)) for d in range(DIM)], 1).astype(np.float32)
            logit = mean @ w + b
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(part)
            dmean = scale * (p @ w.T)
            gw, gb = mean.T @ p, p.sum(0)
            # a word's gradient is its weighted share of those of its texts
            dword = np.stack([np.bincount(back, weight * dmean[doc, d], len(own)) for d in range(DIM)], 1) * per[:, None]
            touched, gi = np.unique(g, return_inverse=True)
            gv = np.stack([np.bincount(gi, dword[word, d], len(touched)) for d in range(DIM)], 1).astype(np.float32)
            sv[touched] += (gv**2).mean(1, keepdims=True)
            sw, sb = sw + float((gw**2).sum()), sb + float((gb**2).sum())
            by = step / np.sqrt(sv[touched])
            now = v[touched] - by * gv
            norm = np.sqrt((now**2).sum(1, keepdims=True))
            v[touched] = now * np.maximum(0, 1 - by * shrink / np.maximum(norm, 1e-12))
            w -= step * 0.1 * gw / np.float32(np.sqrt(sw))
            b -= step * 0.1 * gb / np.float32(np.sqrt(sb))
    value = v @ (w[:, 1] - w[:, 0])
    word = np.bincount(np.repeat(np.arange(len(size)), size), value[bucket], len(size)) / np.maximum(all_size, 1)
    logit = np.array([scale * (word[ids] @ weight) for _, ids, weight in bags]) + (b[1] - b[0])
    slope, shift = calibrated(logit, np.array([label for label, _, _ in bags]))
    table = np.zeros(BUCKETS, np.float32)
    table[used] = slope * scale * value
    return table, float(slope * (b[1] - b[0]) + shift)


class Scorer:
    """Scores texts, and remembers the words' numbers."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias, self.cache, self.values = table, bias, {}, np.zeros(0)

    def _learn(self, words: list[str]) -> None:
        at, bucket = grams(words)
        n = np.bincount(at, minlength=len(words))
        value = np.bincount(at, self.table[bucket], len(words)) / np.maximum(n, 1)
        self.cache.update(zip(words, range(len(self.cache), len(self.cache) + len(words))))
        self.values = np.concatenate([self.values, value])

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.values = {}, np.zeros(0)
        index, n, distinct = split_words(texts, "utf8")
        words = [w.decode("utf-8", "replace") for w in distinct]
        new = list(dict.fromkeys(w for w in words if w not in self.cache))
        for lo in range(0, len(new), STEP):
            self._learn(new[lo : lo + STEP])
        value = self.values[np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))] if words else np.zeros(0)
        total = np.bincount(np.repeat(np.arange(len(n)), n), value[index], len(n))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, clean: int = CLEAN, toxic: int = TOXIC) -> tuple[np.ndarray, float]:
    """Learn from the labelled documents (doc_id, toxic), but those with crc32(doc_id) mod 5 = 0.

    The bounded sample meets in one task, which trains; the driver gets the n-grams' numbers.
    """
    labels = pick(labels, "doc_id", "toxic").select("doc_id", F.col("toxic").cast("int").alias("label"))
    most = F.when(F.col("label") == 1, toxic).otherwise(clean)
    rows = sampled(labels.filter(remainder("doc_id", 5) != 0).filter("label IN (0, 1)"), pick(docs, "doc_id", "text"), most)
    text = piece(F.col("text"), F.col("doc_id"), MAX_CHARS)
    rows = rows.filter("text IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("label", "n", text.alias("text"))).alias("r")).select("r.*", "doc_id")

    def run(table: pa.Table) -> pa.Table:
        found = sorted(zip(table["label"].to_pylist(), table["doc_id"].to_pylist(), table["text"].to_pylist()))
        found = list(dict.fromkeys((label, text) for label, _, text in found))  # copies teach nothing
        seen, n = {label for label, _ in found}, dict(zip(table["label"].to_pylist(), table["n"].to_pylist()))
        weights, bias = train(found) if len(seen) > 1 else (np.zeros(BUCKETS, np.float32), 500.0 if seen == {1} else -500.0)
        if len(seen) > 1:  # the sample's share of either label isn't that of all labelled documents
            chosen = sum(label for label, _ in found)
            bias += float(np.log(n[1] / n[0]) - np.log(chosen / (len(found) - chosen)))
        del found, table
        release()
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary()), "bias": [bias]})

    model = rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, "weights binary, bias double").collect()
    return (np.frombuffer(model[0].weights, np.float32), model[0].bias) if model else (np.zeros(BUCKETS, np.float32), -500.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs with a column score, from 0 to 1: higher, if a text is likelier toxic. Other columns stay."""
    docs = docs.drop("score") if "score" in docs.columns else docs
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats, whatever the input
    at = docs.columns.index("text")

    def run(batches):
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(*shared.value)
            out = [scorer(batch.column(at).slice(lo, 512)) for lo in range(0, batch.num_rows, 512)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(run), f"{fields}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(pick(docs, "doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each text is read as UTF-8 bytes in segments of ``SPAN``; a gated recurrent unit runs over a segment in either
direction, and at every position a softmax over the two states labels the byte with a language. A document's
probabilities are the mean of those of all its positions. The network is trained by backpropagation through
time, in one task, on a bounded sample: ``SEGMENTS`` segments of each of ``PER_LABEL`` documents of each language,
cut where the documents are. Scoring covers every byte of every document. All languages are learned, however many;
beyond 16 the network gets more units, and beyond 8 more steps.

Contract: texts that are null or without any letter are ``und`` with score 0. With no labelled row all are
``und``, with one language only it is predicted with score 1. Of conflicting labels of one doc_id the greater
is used. Repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm._sample import remainder, sampled
from textquarry.llm._shared import pick, tidy

HIDDEN, SPAN = 10, 64
#: The bounded sample: documents of each language, segments of one document.
PER_LABEL, SEGMENTS = 400, 8
#: Segments that are scored at once.
STEP = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One gated recurrent unit. Weights: E (256, 3h) byte to gates, U (h, 3h) state to gates, c (h) bias."""

    def __init__(self, rng, h: int):
        self.h = h
        self.p = {"E": rng.normal(0, 0.3, (256, 3 * h)), "U": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)), "c": np.zeros(h)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, keep: bool = False):
        """x: (time, batch) bytes → states (time, batch, h)."""
        h, p = self.h, self.p
        out = np.empty((*x.shape, h), np.float32)
        state = np.zeros((x.shape[1], h), np.float32)
        tape = []
        for t in range(len(x)):
            a, u = p["E"][x[t]], state @ p["U"]
            g = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
            z, r = g[:, :h], g[:, h:]
            n = np.tanh(a[:, 2 * h :] + r * (u[:, 2 * h :] + p["c"]))
            new = n + z * (state - n)
            if keep:
                tape.append((state, z, r, n, u[:, 2 * h :] + p["c"]))
            state = out[t] = new
        return out, tape

    def backward(self, x: np.ndarray, tape: list, grad: np.ndarray) -> dict:
        """Through time: grad (time, batch, h) of the states → gradients of the weights."""
        h, p = self.h, self.p
        g = {k: np.zeros_like(v) for k, v in p.items()}
        carry = np.zeros((x.shape[1], h), np.float32)
        da_all = np.empty((*x.shape, 3 * h), np.float32)
        for t in range(len(x) - 1, -1, -1):
            state, z, r, n, m = tape[t]
            d = grad[t] + carry
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (state - n) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], 1)
            da_all[t] = np.concatenate([dz, dr, dn], 1)
            g["U"] += state.T @ du
            g["c"] += (dn * r).sum(0)
            carry = d * z + du @ p["U"].T
        flat = da_all.reshape(-1, 3 * h)
        for k in range(3 * h):
            g["E"][:, k] = np.bincount(x.ravel(), flat[:, k], 256)
        return g


class Network:
    def __init__(self, languages: list[str], seed: int = 3, h: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Direction(rng, h), Direction(rng, h)
        self.out = {"W": rng.normal(0, 0.3, (2 * h, len(languages))).astype(np.float32), "b": np.zeros(len(languages), np.float32)}

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.p.values(), *self.back.p.values(), *self.out.values()]

    def probabilities(self, x: np.ndarray, keep: bool = False):
        f, tape_f = self.ahead.forward(x, keep)
        b, tape_b = self.back.forward(x[::-1], keep)
        s = np.concatenate([f, b[::-1]], 2)
        p = s @ self.out["W"] + self.out["b"]
        p -= p.max(2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(2, keepdims=True)
        return p, (s, tape_f, tape_b)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss at all positions and its gradients. x: (time, batch); y: (batch,)."""
        p, (s, tape_f, tape_b) = self.probabilities(x, True)
        loss = float(-np.log(p[:, np.arange(len(y)), y] + 1e-9).mean())
        p[:, np.arange(len(y)), y] -= 1
        p /= p.shape[0] * p.shape[1]
        h = self.ahead.h
        ds = p @ self.out["W"].T
        flat = p.reshape(-1, p.shape[2])
        gf = self.ahead.backward(x, tape_f, ds[:, :, :h])
        gb = self.back.backward(x[::-1], tape_b, ds[::-1, :, h:])
        return loss, [*gf.values(), *gb.values(), s.reshape(-1, 2 * h).T @ flat, flat.sum(0)]


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments (n, SPAN) padded with zero bytes, their documents, their lengths)."""
    lens = np.array([len(t) for t in texts], np.int64)
    n = -(-lens // SPAN)
    doc = np.repeat(np.arange(len(texts)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(SPAN, lens[doc] - k * SPAN)
    padded = b"".join(t + b"\0" * (-len(t) % SPAN) for t in texts)
    return np.frombuffer(padded, np.uint8).reshape(-1, SPAN), doc, size


def units(n: int) -> int:
    """Units a direction for n languages."""
    return HIDDEN if n <= 16 else min(48, int(4 * np.sqrt(n)))


def train(pools: dict[str, np.ndarray], steps: int | None = None, batch: int = 192, rate: float = 0.02, seed: int = 3) -> Network:
    """Learn from the segments (n, SPAN) of each language by Adam, languages drawn alike."""
    languages = sorted(pools)
    net, rng = Network(languages, seed, units(len(languages))), np.random.default_rng(seed)
    steps, pools = steps or min(2000, max(500, 60 * len(languages))), [pools[name] for name in languages]
    params = net.parameters()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), batch)
        x = np.stack([pools[k][rng.integers(0, len(pools[k]))] for k in y]).T
        _, grads = net.gradients(x, y)
        size = np.sqrt(sum(float((g**2).sum()) for g in grads))
        scale, lr = min(1.0, 1.0 / (size + 1e-9)), rate * (1 - step / (steps + 1))
        for p, g, a, b in zip(params, grads, m, v):
            g = g * scale
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    raw = [(t or "").encode("utf-8", "replace") if t and has_letter(t) else b"" for t in texts]
    x, doc, size = segments(raw)
    total = np.zeros((len(texts), len(net.languages)))
    place = np.arange(SPAN)[:, None]
    for lo in range(0, len(x), STEP):
        p, _ = net.probabilities(np.ascontiguousarray(x[lo : lo + STEP].T))
        p *= (place < size[None, lo : lo + STEP])[:, :, None]
        np.add.at(total, doc[lo : lo + STEP], p.sum(0))
    out = []
    for t, r in zip(total, raw):
        k = int(t.argmax())
        out.append((net.languages[k], float(min(1.0, t[k] / len(r)))) if r else ("und", 0.0))
    return out


def cut(text: str) -> np.ndarray:
    """At most SEGMENTS segments of a text, whole ones if there are any; which ones depends on the text alone."""
    raw = text.encode("utf-8", "replace")
    x, _, size = segments([raw])
    x = x[size >= min(SPAN, size.max())]
    return x[np.random.default_rng(xxhash.xxh64_intdigest(raw)).permutation(len(x))[:SEGMENTS]]


def _cut(batches):
    for batch in batches:
        rows = [(label, cut(text)) for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text and has_letter(text)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].tobytes() for r in rows], pa.binary())], ["label", "segments"])


def fit(docs: DataFrame, per_label: int = PER_LABEL, steps: int | None = None) -> Network | str | None:
    """Learn from text and lang of the documents, but those with crc32(doc_id) mod 4 = 2. The driver gets the weights."""
    rows = pick(docs, "doc_id", "text", "lang").filter(remainder("doc_id", 4) != 2).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("label"), F.col("text").cast("string").alias("text"))
    found = sampled(rows.select("doc_id", "label"), rows.select("doc_id", "text"), per_label)
    found = found.select("label", "text").mapInArrow(tidy(_cut), "label string, segments binary").distinct()

    def run(table: pa.Table) -> pa.Table:
        pools: dict[str, list] = {}
        for label, x in sorted(zip(table["label"].to_pylist(), table["segments"].to_pylist())):
            pools.setdefault(label, []).append(np.frombuffer(x, np.uint8).reshape(-1, SPAN))
        pools = {k: np.concatenate(v) for k, v in pools.items()}
        model = train(pools, steps) if len(pools) > 1 else next(iter(pools))
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    model = found.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, "model binary").collect()
    return pickle.loads(model[0].model) if model else None


def identify(docs: DataFrame, model: Network | str | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand weights

    def run(batches):
        net = shared.value
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(lo, 256).to_pylist()
                if isinstance(net, Network):
                    out += predict(net, texts)
                else:
                    out += [(net, 1.0) if net and t and has_letter(t) else ("und", 0.0) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    found = identify(docs, fit(docs))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")

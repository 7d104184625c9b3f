"""Quality by gated attention over passages (operator 5).

A document is a bag of passages of PASSAGE words.  Each passage has FEATURES figures
(letters, capitals, digits, signs, repetition, variety, word lengths), encoded by a small
layer into h.  Gated attention weighs the passages, a = softmax(w . (tanh(V h) * sigmoid(U h))),
and the score is the logistic of the weighted sum of h.  Encoder, gates and output are
learned together from document labels alone, in numpy, on at most `bound` labelled rows.

The model has a fixed size and is broadcast.  Scoring reads every text whole, in numpy over
batches of bytes; a task holds one batch of about BATCH bytes (or one longer text).

Defined cases: a null or empty text is one passage without words; with no labelled rows
every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.common import table
from litloom.llm.training import held_out, labelled_sample
from litloom.llm.workers import over_batches

PASSAGE = 48
BATCH = 1 << 19
BOUND = 6000
HIDDEN, GATE = 24, 12
THRESHOLD = 0.7

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, 6, np.uint8)  # 6: other signs
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[128:192] = 7  # a continuation byte
_KIND[192:] = 8  # starts a letter beyond ASCII, most often
LAGS = (1, 2, 3, 4, 6, 8, 12)
FEATURES = 19


def _word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of low[start:end] for each word, whatever its place."""
    r = 0xD6E8FEB86659FD93
    inverse = pow(r, -1, 2**64)
    n = len(low)
    power = np.empty(n + 1, np.uint64)
    back = np.empty(n + 1, np.uint64)
    power[0] = back[0] = 1
    filled = 1
    while filled < n + 1:
        step = min(filled, n + 1 - filled)
        power[filled : filled + step] = power[:step] * np.uint64(pow(r, filled, 2**64))
        back[filled : filled + step] = back[:step] * np.uint64(pow(inverse, filled, 2**64))
        filled += step
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = (total[end] - total[start]) * back[start]
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text (1 at least)."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    kind = _KIND[buf]
    solid = kind != 0
    edge = np.diff(solid.view(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    begin = np.cumsum([1] + [len(t) + 1 for t in texts])[:-1]
    doc = np.searchsorted(begin, start, side="right") - 1
    per_doc = np.bincount(doc, minlength=len(texts))
    count = np.maximum(1, -(-per_doc // PASSAGE))
    base = np.r_[0, np.cumsum(count)[:-1]]
    first_word = np.r_[0, np.cumsum(per_doc)[:-1]]
    which = base[doc] + (np.arange(len(start)) - first_word[doc]) // PASSAGE
    n = int(count.sum())
    x = np.zeros((n, FEATURES), np.float32)
    if not len(start):
        return x, count
    words = np.bincount(which, minlength=n).astype(np.float64)
    one = np.maximum(words, 1)
    size = end - start
    opens = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    filled = which[opens]
    bytes_ = np.zeros((9, n))
    for k in range(9):
        bytes_[k, filled] = np.add.reduceat((kind == k).view(np.uint8), start[opens], dtype=np.int64)
    newline = np.zeros(n)
    newline[filled] = np.add.reduceat((buf == 10).view(np.uint8), start[opens], dtype=np.int64)
    letters = bytes_[1] + bytes_[2] + bytes_[8]
    total = np.maximum(bytes_[1:].sum(axis=0), 1)
    mean = np.bincount(which, size, n) / one
    h = _word_hashes(_LOWER[buf], start, end)
    again = np.zeros(len(h), bool)
    lag1 = np.zeros(len(h), bool)
    for k in LAGS:
        same = (h[k:] == h[:-k]) & (which[k:] == which[:-k]) if len(h) > k else np.zeros(0, bool)
        again[k:] |= same
        if k == 1:
            lag1[1:] = same
    order = np.lexsort((h, which))
    hs, ws = h[order], which[order]
    distinct = np.r_[True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])]
    variety = np.bincount(ws, distinct, n) / one
    last = kind[end - 1]
    columns = (
        np.log1p(words), mean, np.sqrt(np.maximum(np.bincount(which, size.astype(float) ** 2, n) / one - mean**2, 0)),
        bytes_[2] / np.maximum(letters, 1), bytes_[3] / total, bytes_[4] / one, bytes_[5] / one, bytes_[6] / total, bytes_[8] / total, bytes_[7] / total,
        newline / one, np.bincount(which, lag1, n) / one, np.bincount(which, again, n) / one, variety,
        np.bincount(which, size == 1, n) / one, np.bincount(which, size > 18, n) / one,
        np.bincount(which, kind[start] == 2, n) / one, np.bincount(which, (last == 6) | (last == 5), n) / one, letters / total,
    )
    return np.stack(columns, axis=1).astype(np.float32), count


def in_batches(texts):
    """Texts in lists of about BATCH bytes: what features are computed over at once."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= BATCH:
            yield some
            some, size = [], 0
    if some:
        yield some


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return _forward(self.p, x, count)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.forward(*passages(texts))[0]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(p, x, count):
    start = np.r_[0, np.cumsum(count)[:-1]]
    h = np.maximum(x @ p["W"] + p["b"], 0)
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, start), count))
    a /= np.repeat(np.add.reduceat(a, start), count)
    z = np.add.reduceat(a[:, None] * h, start, axis=0)
    return _sigmoid(z @ p["c"] + p["d"][0]), h, t, g, a, z


def _gradient(p, x, count, y, weight):
    s, h, t, g, a, z = _forward(p, x, count)
    start = np.r_[0, np.cumsum(count)[:-1]]
    ds = (s - y) * weight / len(y)
    dz = ds[:, None] * p["c"]
    dzr = np.repeat(dz, count, axis=0)
    da = (dzr * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, start), count))
    dq = de[:, None] * p["w"]
    dt, dg = dq * g * (1 - t * t), dq * t * g * (1 - g)
    dh = (a[:, None] * dzr + dt @ p["V"].T + dg @ p["U"].T) * (h > 0)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": np.array([ds.sum()])}


def train(texts: list[str], labels: list[int], epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Model | None:
    """Adam on batches of bags; the classes weigh alike."""
    y = np.array(labels, np.float64)
    if not len(y):
        return None
    rng = np.random.default_rng(seed)
    parts = [passages(some) for some in in_batches(t.encode(errors="replace") for t in texts)]
    x, count = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -6, 6).astype(np.float64)
    n = x.shape[1]
    p = {"W": rng.standard_normal((n, HIDDEN)) * (2 / n) ** 0.5, "b": np.zeros(HIDDEN), "V": rng.standard_normal((HIDDEN, GATE)) * HIDDEN**-0.5, "U": rng.standard_normal((HIDDEN, GATE)) * HIDDEN**-0.5, "w": rng.standard_normal(GATE) * 0.1, "c": rng.standard_normal(HIDDEN) * HIDDEN**-0.5, "d": np.zeros(1)}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    share = y.mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) if 0 < share < 1 else np.ones(len(y))
    start = np.r_[0, np.cumsum(count)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            bags = order[at : at + 128]
            rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in bags])
            grad = _gradient(p, x[rows], count[bags], y[bags], weight[bags])
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k in p:
                d = grad[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, {k: a.astype(np.float32) for k, a in p.items()})


def score_all(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            out = [model.score(some) if model else np.full(len(some), 0.5) for some in in_batches(texts)]
            score = np.concatenate(out).astype(np.float64) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(over_batches(run), "doc_id long, score double")


def op5_attention_mil_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = labelled_sample(docs, labels, "quality", ~held_out(4, 2), BOUND)
    scored = score_all(docs, train([t for t, _ in sample], [y for _, y in sample]))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_attention_mil_quality": op5_attention_mil_quality}

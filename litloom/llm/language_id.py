"""Language identification with string kernels (operator 10).

Blended-spectrum presence kernel: a text is the set of its character 1-, 2- and 3-grams
(lower-cased, anything but letters acts as a gap), and
k(x, y) = |S(x) & S(y)| / sqrt(|S(x)| |S(y)|).  Letters of all scripts count: n-grams of
the sample's commonest letters have numbers in a small table, the others are exact codes of
their code points.  `landmarks` texts of the training sample, or LANDMARKS_EACH of each
language if that is more, give a Nyström approximation; one-versus-rest kernel ridge
regression is fitted on it.  Scoring a batch is two matrix products: presence rows by the
landmarks' rows, the scaled kernel by the coefficients; with many n-grams the first is
counted from lists of the landmarks of each n-gram.

The model is fitted on at most `per_class` labelled texts of each language, those of
least hash: a sample of MOST_ROWS rows, or LEAST_EACH of each language if that is more, and
of MOST_BYTES.  No language is left out.  The model is broadcast: its size depends on these
parameters and the number of languages.  Every text is scored whole.

Defined cases: a null text, one without a letter, or one that shares no n-gram with any
landmark is `und` with score 0; with no labelled rows every text is `und`.
"""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.common import table
from litloom.llm.training import MOST_BYTES, fitting, texts_of
from litloom.llm.workers import over_batches

UND = "und"
PER_CLASS = 300
MOST_ROWS = 20_000
LEAST_EACH = 8
LANDMARKS = 192
LANDMARKS_EACH = 8
RIDGE = 1e-2
SHARPNESS = 6.0
#: Letters whose n-grams are numbered in a table; a matter of speed alone.
ALPHABET = 63
CODES = 0x110000
#: Beyond so many n-grams, or n-grams times landmarks, rows of presence are not laid out.
MOST_GRAMS, MOST_CELLS = 1 << 16, 1 << 24


@cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(CODES)), bool, CODES)


def letter_table(texts: list[str]) -> np.ndarray:
    """A small number for each of the commonest letters of the sample; 0 for anything else."""
    seen = Counter()
    for t in texts:
        seen.update(c for c in t.lower() if c.isalpha())
    lut = np.zeros(CODES, np.uint8)
    for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET]):
        lut[ord(c)] = i + 1
    return lut


def presence(text: str, lut: np.ndarray) -> np.ndarray:
    """Codes of the text's distinct 1-, 2- and 3-grams.

    Those of letters in the table: one number space of 64**3 for each length.  Those with
    another letter: less than 0, 21 bits for each code point.
    """
    cp = np.frombuffer(text.lower().encode("utf-32-le", errors="surrogatepass"), np.uint32)
    cp = np.r_[0, np.where(is_letter()[cp], cp, 0), 0].astype(np.int64)
    # A run of gaps is one gap.
    cp = cp[np.r_[True, (cp[1:] != 0) | (cp[:-1] != 0)]]
    x = lut[cp].astype(np.int32)
    two = x[:-1] * 64 + x[1:]
    three = two[:-1] * 64 + x[2:]
    rare = (x == 0) & (cp != 0)
    other = rare.any()
    if other:
        rare2 = rare[:-1] | rare[1:]
        rare3 = rare2[:-1] | rare[2:]
        # With 1 added no n-gram is the code of a shorter one.
        c = cp + 1
        c2 = c[:-1] << 21 | c[1:]
        c3 = c2[:-1] << 21 | c[2:]
        codes = -np.unique(np.concatenate([c[rare], c2[rare2], c3[rare3]]))
        x, two, three = x[~rare], two[~rare2], three[~rare3]
    seen = np.zeros(64 + 64**2 + 64**3, bool)
    seen[x] = True
    seen[64 + two] = True
    seen[64 + 64**2 + three] = True
    seen[0] = False
    return np.concatenate([codes[::-1], np.flatnonzero(seen)]) if other else np.flatnonzero(seen)


class Model:
    """marks: the landmarks' rows of presence, or (starts, landmarks) for each n-gram in turn."""

    def __init__(self, classes, lut, sets):
        self.classes, self.lut, self.coef = classes, lut, None
        grams = np.unique(np.concatenate(sets))
        self.rare = grams[grams < 0]
        self.slot = np.full(64 + 64**2 + 64**3, -1, np.int32)
        self.slot[grams[len(self.rare) :]] = np.arange(len(self.rare), len(grams))
        self.size, self.grams = len(sets), len(grams)
        self.marks_norm = np.array([max(len(p), 1) for p in sets], np.float32)
        self.dense = len(grams) <= MOST_GRAMS and len(grams) * len(sets) <= MOST_CELLS
        if self.dense:
            self.marks = np.zeros((len(sets), len(grams)), np.float32)
            for r, p in enumerate(sets):
                self.marks[r, self.slots(p)] = 1
        else:
            at = np.concatenate([self.slots(p) for p in sets])
            who = np.repeat(np.arange(len(sets), dtype=np.int32), [len(p) for p in sets])
            self.marks = np.r_[0, np.cumsum(np.bincount(at, minlength=len(grams)))], who[np.argsort(at, kind="stable")]

    def slots(self, p: np.ndarray) -> np.ndarray:
        """Places of those n-grams that a landmark has."""
        n = np.searchsorted(p, 0)
        s = self.slot[p[n:]]
        s = s[s >= 0]
        if not n or not len(self.rare):
            return s
        at = np.minimum(np.searchsorted(self.rare, p[:n]), len(self.rare) - 1)
        return np.concatenate([at[self.rare[at] == p[:n]].astype(np.int32), s])

    def kernel(self, texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), self.grams if self.dense else self.size), np.float32)
        norm = np.ones(len(texts), np.float32)
        for i, t in enumerate(texts):
            p = presence(t, self.lut)
            norm[i] = max(len(p), 1)
            s = self.slots(p)
            if self.dense:
                rows[i, s] = 1
            else:
                starts, who = self.marks
                n = starts[s + 1] - starts[s]
                at = np.repeat(starts[s] - np.cumsum(n) + n, n) + np.arange(n.sum())
                rows[i] = np.bincount(who[at], minlength=self.size)
        return (rows @ self.marks.T if self.dense else rows) / np.sqrt(norm[:, None] * self.marks_norm[None, :])

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The class number and its probability for each text; -1 and 0 if no landmark is like it."""
        k = self.kernel(texts)
        z = k @ self.coef * SHARPNESS
        e = np.exp(z - z.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        known = k.any(axis=1)
        return np.where(known, best, -1), np.where(known, p[np.arange(len(best)), best], 0).astype(np.float64)


def train(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Landmarks are taken from the classes in turn, in the sample's order."""
    if not texts:
        return None
    classes = sorted(set(labels))
    queues = {c: [] for c in classes}
    for i, y in enumerate(labels):
        queues[y].append(i)
    chosen = [i for turn in range(max(map(len, queues.values()))) for c in classes for i in queues[c][turn : turn + 1]][: max(landmarks, LANDMARKS_EACH * len(classes))]
    lut = letter_table(texts)
    model = Model(classes, lut, [presence(texts[i], lut) for i in chosen])
    values, vectors = np.linalg.eigh(model.kernel([texts[i] for i in chosen]).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    place = {c: j for j, c in enumerate(classes)}
    left, right = ridge * len(texts) * np.eye(root.shape[1]), np.zeros((root.shape[1], len(classes)))
    for at in range(0, len(texts), 512):
        mine = labels[at : at + 512]
        z = model.kernel(texts[at : at + 512]).astype(np.float64) @ root
        y = np.full((len(mine), len(classes)), -1.0)
        y[np.arange(len(mine)), [place[c] for c in mine]] = 1.0
        # Classes of few texts weigh as much as the others.
        weighed = (z * (len(labels) / (len(classes) * np.array([len(queues[c]) for c in mine])))[:, None]).T
        left += weighed @ z
        right += weighed @ y
    model.coef = (root @ np.linalg.solve(left, right)).astype(np.float32)
    return model


def sample(labelled: DataFrame, per_class: int, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> tuple[list[str], list[str]]:
    """At most per_class texts of each label, fewer if there are many labels, those of least hash of the id.

    labelled: doc_id, text, label.  With more labels than most_rows / LEAST_EACH the rows grow
    with the labels; texts that do not fit into most_bytes are passed over before they are fetched.
    """
    counts = labelled.groupBy("label").count().orderBy("label").collect()
    if not counts:
        return [], []
    per_class = min(per_class, max(LEAST_EACH, most_rows // len(counts)))
    span = 2.0**63
    share = labelled.sparkSession.createDataFrame([(r["label"], min(1.0, 1.5 * per_class / r["count"])) for r in counts], "label string, share double")
    place = F.abs(F.xxhash64("doc_id").cast("double")) / span
    rows = labelled.withColumn("place", place).join(F.broadcast(share), "label").where("place <= share")  # one row a label
    rows = rows.select("label", "place", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), F.octet_length("text").alias("size")).orderBy("place", "label", "t").limit(2 * per_class * len(counts)).collect()
    taken, picked = Counter(), []
    for r in rows:
        if taken[r["label"]] < per_class:
            taken[r["label"]] += 1
            picked.append(r)
    picked = fitting(picked, most_bytes)
    found = texts_of(labelled, [(r["h"], r["t"]) for r in picked])
    return [found[r["h"], r["t"]] for r in picked], [r["label"] for r in picked]


def fit(docs: DataFrame, training, per_class: int = PER_CLASS, landmarks: int = LANDMARKS) -> Model | None:
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", F.col("lang").cast("string").alias("label"))
    return train(*sample(rows, per_class), landmarks=landmarks)


def judge(model: Model | None, texts: list[str | None], batch_docs: int = 256) -> tuple[list[str], list[float]]:
    lang, score = [UND] * len(texts), [0.0] * len(texts)
    able = [i for i, t in enumerate(texts) if model is not None and t and any(c.isalpha() for c in t)]
    for at in range(0, len(able), batch_docs):
        part = able[at : at + batch_docs]
        for i, b, s in zip(part, *model.score([texts[i] for i in part])):
            if b >= 0:
                lang[i], score[i] = model.classes[b], float(s)
    return lang, score


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lang, score = judge(held.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(over_batches(run), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.0) -> DataFrame:
    """The rows of docs whose text has a language with a score of `least` or more, its name in lang."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    text, lang_at = columns.index("text"), [i for i, c in enumerate(columns) if c == "lang"]

    def run(batches):
        for batch in batches:
            lang, score = judge(held.value, batch.column(text).to_pylist())
            keep = pa.array([x != UND and s >= least for x, s in zip(lang, score)], pa.bool_())
            arrays = [pa.array(lang, pa.string()) if i in lang_at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names).filter(keep)

    plain = docs.toDF(*names)
    return plain.mapInArrow(over_batches(run), plain.schema).toDF(*columns)


def is_held_out(folds: int, out: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == out, F.lit(False))


def op10_string_kernel_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~is_held_out(5, 0))
    return predict(docs, model).select("doc_id", is_held_out(5, 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_string_kernel_language": op10_string_kernel_language}

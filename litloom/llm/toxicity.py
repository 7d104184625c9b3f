"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration (operator 6).

Features of a text: densities of a fixed lexicon of insults, of words and of word stems
that the training sample ties to toxic labels, of hits after undoing look-alike signs and
spaced or stretched letters; hits near a second-person word; capitals; punctuation;
obfuscation rates.  Histogram trees are boosted on the logistic loss and the raw score is
mapped to a probability by isotonic regression on a part of the sample kept back.

Lexicon, trees and calibration are fitted in numpy on at most `bound` labelled rows and have
a bounded size, so they are broadcast.  Texts are scored whole.

Defined cases: a null or empty text has no words and gets the score of such a text; with no
labelled rows every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.common import table
from litloom.llm.training import held_out, labelled_sample
from litloom.llm.workers import over_batches

BOUND = 8000
TREES, DEPTH, RATE, BINS = 120, 4, 0.12, 32
THRESHOLD = 0.7
STEM = 5
MOST_WORDS = 3000

#: Common insults, and second-person words of the corpus's languages.
INSULTS = frozenset(w.encode() for w in "idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown clowns dumb dumbass ugly fool jerk garbage imbecile filth vermin cretin bastard bitch crap shit fuck hate idiota estúpido imbécil basura asqueroso payaso dumm idiotin abschaum müll versager widerlich stupide crétin ordure minable dégoûtant nul".split())
YOU = frozenset(w.encode() for w in "you your yours yourself youre u ur du dein deine dich dir ihr euch sie tu te toi ton ta tes vous votre vos tú usted ustedes vosotros ti tus su".split())

_GAPS = b".,;:!?\"()[]{}<>|/\\\t\r\n"
_CLEAN = bytes.maketrans(bytes(range(65, 91)) + _GAPS, bytes(range(97, 123)) + b" " * len(_GAPS))
_MASKED = re.compile(rb"[a-z\x80-\xff]+[0-9@$*#!+_.-]+[a-z\x80-\xff]+(?:[0-9@$*#!+_.-]+[a-z\x80-\xff]+)*", re.I)
_SPACED = re.compile(rb"(?<![a-z\x80-\xff])(?:[a-z][ .*_-]){3,}[a-z](?![a-z\x80-\xff])", re.I)
_STRETCHED = re.compile(rb"([a-z])\1{2,}", re.I)
_SIGNS = re.compile(rb"[#$%&*@^~+=_-]{2,}")
_LOOKS = bytes.maketrans(b"013457@$!+", b"oieastasit")
NAMES = ("insults", "insult_share", "learnt", "learnt_share", "learnt_best", "stems", "stem_share", "masked_hits", "masked_share", "spaced", "spaced_hits", "stretched", "near_you", "you_share", "capitals", "shouted", "exclaimed", "asked", "stops", "signs", "log_words", "word_size", "digits")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; runs of signs, which hide a word's end, are gaps."""
    if _SIGNS.search(text):
        text = _SIGNS.sub(b" ", text)
    return text.translate(_CLEAN).split()


@dataclass
class Lexicon:
    words: dict[bytes, float]
    stems: dict[bytes, float]

    def features(self, text: bytes) -> list[float]:
        words = words_of(text)
        n = max(len(words), 1)
        size = max(len(text), 1)
        distinct = set(words)
        learnt = distinct & self.words.keys()
        insults = distinct & INSULTS
        hits = learnt | insults
        stems = {w for w in distinct if w[:STEM] in self.stems}
        places = [i for i, w in enumerate(words) if w in hits or w in stems] if hits or stems else []
        near = sum(1 for i in places if not YOU.isdisjoint(words[max(0, i - 3) : i + 4]))
        n_hits = sum(1 for i in places if words[i] in learnt)
        n_insults = sum(1 for i in places if words[i] in insults)
        n_stems = sum(1 for i in places if words[i] in stems)
        masked = _MASKED.findall(text)
        masked_hits = 0
        for m in masked:
            plain = re.sub(rb"[^a-z\x80-\xff]", b"", m.lower().translate(_LOOKS))
            bare = re.sub(rb"[^a-z\x80-\xff]", b"", m.lower())
            masked_hits += any(p in INSULTS or p in self.words for p in (plain, bare)) or b"*" in m and self._fits(m.lower())
        spaced = _SPACED.findall(text)
        spaced_hits = sum(1 for s in spaced if (p := re.sub(rb"[^a-z]", b"", s.lower())) in INSULTS or p in self.words)
        upper = len(text) - len(text.translate(None, bytes(range(65, 91))))
        lower = len(text) - len(text.translate(None, bytes(range(97, 123))))
        count = text.count
        signs = sum(map(count, (b"#", b"$", b"%", b"&", b"*", b"@", b"|", b"_", b"~", b"^")))
        return [
            n_insults, n_insults / n, n_hits, n_hits / n, max((self.words[w] for w in learnt), default=0.0), n_stems, n_stems / n,
            masked_hits, len(masked) / n, len(spaced), spaced_hits, len(_STRETCHED.findall(text)) / n, near, sum(map(words.count, YOU & distinct)) / n,
            upper / max(upper + lower, 1), float(upper > lower), count(b"!") / n, count(b"?") / n, (count(b".") + count(b",")) / n, signs / size,
            np.log1p(len(words)), sum(map(len, distinct)) / max(len(distinct), 1), sum(map(count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / size,
        ]

    def _fits(self, masked: bytes) -> bool:
        """Whether a word with starred letters can be a word of the fixed lexicon."""
        shape = re.compile(b"".join(b"." if c == 42 else re.escape(bytes([c])) for c in masked))
        return any(shape.fullmatch(w) for w in INSULTS)


def learn_lexicon(texts: list[bytes], labels: np.ndarray, least: int = 3, ratio: float = 8.0) -> Lexicon:
    """Words and stems whose documents are toxic `ratio` times as often as the others', by smoothed counts."""
    seen: list[tuple[Counter, Counter]] = [(Counter(), Counter()), (Counter(), Counter())]
    for t, y in zip(texts, labels):
        distinct = set(words_of(t))
        seen[y][0].update(distinct)
        seen[y][1].update({w[:STEM] for w in distinct if len(w) > STEM})
    n1, n0 = max(int(labels.sum()), 1), max(int((1 - labels).sum()), 1)
    out = []
    for k in (0, 1):
        weigh = {w: float(np.log(((c + 0.1) / n1) / ((seen[0][k][w] + 0.5) / n0))) for w, c in seen[1][k].items() if c >= least}
        best = sorted(weigh.items(), key=lambda x: (-x[1], x[0]))[:MOST_WORDS]
        out.append({w: v for w, v in best if v >= np.log(ratio)})
    return Lexicon(*out)


@dataclass
class Trees:
    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1)
        return self.base + sum(_walk(t, b) for t in self.trees)


def _walk(tree, b: np.ndarray) -> np.ndarray:
    """A complete tree of DEPTH levels: feature and bin of each inner node, value of each leaf."""
    feature, cut, value = tree
    node = np.zeros(len(b), np.int64)
    rows = np.arange(len(b))
    for _ in range(DEPTH):
        node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
    return value[node - (2**DEPTH - 1)]


def boost(x: np.ndarray, y: np.ndarray, l2: float = 2.0, least: float = 2.0) -> Trees:
    """Histogram gradient boosting on the logistic loss with Newton steps."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    # Rare values get cuts of their own: most counts are zero.
    cuts = [c if len(c) > 3 else np.unique(np.r_[c, np.quantile(v, np.linspace(0, 1, 9)[:-1])] if len(v := x[:, f][x[:, f] > 0]) else c) for f, c in enumerate(cuts)]
    cuts = [np.unique(np.r_[c, 1e-12]) for c in cuts]
    b = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], axis=1)
    n, m = b.shape
    width = BINS + 16
    flat = b + np.arange(m) * width
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    raw, trees = np.full(n, base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, 10**6)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            nodes = 2**level
            index = (node[:, None] * (m * width) + flat).ravel()
            gs = np.bincount(index, np.repeat(g, m), nodes * m * width).reshape(nodes, m, width).cumsum(axis=2)
            hs = np.bincount(index, np.repeat(h, m), nodes * m * width).reshape(nodes, m, width).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            at = np.arange(nodes) + nodes - 1
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            feature[at[good]], cut[at[good]] = best[good] // width, best[good] % width
            here = node + nodes - 1
            node = 2 * node + (b[np.arange(n), feature[here]] > cut[here])
        value = -RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + l2)
        trees.append((feature, cut, value))
        raw += value[node]
    return Trees(cuts, trees, base)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (raw, probability), one at the middle of each pool."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for r, v in zip(raw[order], y[order].astype(float)):
        pools.append([v, 1.0, r])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, c, t = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += c
            pools[-1][2] += t
    # Each pool's share is drawn in a little, as if it held one more document of either label.
    return np.array([t / c for _, c, t in pools]), np.array([(s + 0.01) / (c + 0.02) for s, c, _ in pools])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[bytes]) -> np.ndarray:
        raw = self.trees.raw(np.array([self.lexicon.features(t) for t in texts], np.float64))
        return np.clip(np.interp(raw, *self.knots), 0, 1)


def train(texts: list[str], labels: list[int]) -> Model | None:
    """Each part is fitted on rows of its own: lexicon and trees on four fifths, calibration on the rest.

    The words a document was used to find look surer in it than in others, so the
    lexicon for the trees' features comes from the other half of the four fifths.
    """
    y = np.array(labels, np.int64)
    if not len(y):
        return None
    raw = [t.encode(errors="replace") for t in texts]
    fold = np.arange(len(y)) % 5
    fit = np.flatnonzero(fold < 4)
    halves = [fit[fold[fit] < 2], fit[fold[fit] >= 2]]
    x, rows = [], []
    for own, other in (halves, halves[::-1]):
        lexicon = learn_lexicon([raw[i] for i in other], y[other], least=2)
        x += [lexicon.features(raw[i]) for i in own]
        rows.append(own)
    lexicon = learn_lexicon([raw[i] for i in fit], y[fit])
    rows = np.concatenate(rows)
    trees = boost(np.array(x, np.float64), y[rows])
    kept = np.flatnonzero(fold == 4) if len(y) >= 50 else np.arange(len(y))
    scores = trees.raw(np.array([lexicon.features(raw[i]) for i in kept], np.float64))
    return Model(lexicon, trees, isotonic(scores, y[kept]))


def score_all(docs: DataFrame, model: Model | None, each: int = 256) -> DataFrame:
    """doc_id, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            out = [model.score(texts[i : i + each]) if model else np.zeros(len(texts[i : i + each])) for i in range(0, len(texts), each)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(over_batches(run), "doc_id long, score double")


def op6_boosted_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = labelled_sample(docs, labels, "toxic", ~held_out(3, 1), BOUND)
    scored = score_all(docs, train([t for t, _ in sample], [y for _, y in sample]))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_boosted_toxicity": op6_boosted_toxicity}

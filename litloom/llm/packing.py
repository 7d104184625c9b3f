"""Packing without crossing documents: power-of-two decomposition (operator 2).

A document of L tokens (its ids and the closing id) is cut into pieces of the context
length, and the rest into the powers of two of its binary digits, longest first.  Every
piece is a sequence of its own, so no sequence crosses documents and none is padded;
sequences are bucketed by length and numbered bucket by bucket.

The tokenizer works word by word: it drops white space before it splits, lower-cases and
merges inside words only, so a text's ids are those of its white-space separated words
one after the other.  A task keeps the ids of the words it has seen (at most CACHE; the
rest is encoded each time) and sends only new words to the library, all of a text at once.

Numbers are given in two steps: a task counts the pieces it cuts of each length, and the
running sum of these counts over (length, task) gives each its first number.  Defined cases:
a null or empty text has the closing id alone; rows that repeat get numbers each of its own.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.common import cut, table
from litloom.llm.workers import over_batches
from litloom.operators.ranges import running_before

CONTEXT = 2048
END = 1
VOCABULARY = "word_bpe_49k.json"
CACHE = 400_000
#: White space as the tokenizer's own patterns have it.
SPACE = re.compile(r"[\t-\r\x20\x85\xa0  -     　]+")


#: str.split() also splits at these, which the tokenizer keeps.
_ODD = "\x1c\x1d\x1e\x1f"
#: What the tokenizer splits words into, and words that its normalisation leaves as they are.
UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = re.compile(r"[!-;=?-@\[-~\xa1-\xbf\xd7\xdf-\xff]+")
#: A full stop or comma that ends a longer run of signs; else one that ends a word is a piece of its own.
_RUN = re.compile(r"[.,](?<=[^\s\w].|_.)\s", re.S)


class WordIds(dict):
    """Little-endian 32-bit ids of a word."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A word of letters alone is one unit to the tokenizer; its last id, and no other, has this suffix.
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True

    def words(self, text: str) -> list[str]:
        """Words whose ids are those of the text; spellings that the tokenizer treats alike are made equal."""
        try:
            text.encode("latin-1")  # within it, lower-casing is the tokenizer's own
        except UnicodeEncodeError:
            return SPACE.split(text)
        if any(c in text for c in _ODD):
            return SPACE.split(text)
        text = text.lower()
        if not _RUN.search(text):
            text = text.replace(". ", " . ").replace(".\n", " . ").replace(", ", " , ").replace(",\n", " , ")
        return text.split()

    def encode(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new words: the plain ones in one go, as the units in each are known to end in one marked id."""
        plain, units = [], []
        for w in new:
            if w.isalpha():
                n = 1
            else:
                n = len(UNIT.findall(w))
            if n and _PLAIN.fullmatch(w):
                plain.append(w)
                units.append(n)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        found = {}
        if len(cuts) == sum(units):
            raw = ids.tobytes()
            his = (4 * cuts[np.cumsum(units) - 1]).tolist() if units else []
            for w, lo, hi in zip(plain, [0, *his[:-1]], his):
                found[w] = raw[lo:hi]
        rest = [w for w in new if w not in found]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            found[w] = np.array(e.ids, "<u4").tobytes()
        return found

    def of_all(self, texts: list[str]):
        """The ids of each text; new words of about a megabyte of text are encoded at once."""
        some, size = [], 0
        for t in texts:
            found = self.words(t)
            ids = list(map(self.get, found))
            some.append((ids, [(i, found[i]) for i, x in enumerate(ids) if x is None] if None in ids else ()))
            size += len(t)
            if size > 1 << 20:
                yield from self._some(some)
                some, size = [], 0
        yield from self._some(some)

    def _some(self, some):
        unseen = {w for _, gaps in some for _, w in gaps}
        own = self.encode(sorted(unseen)) if unseen else {}
        if len(self) < CACHE:  # the commonest words come early
            self.update(own)
        for ids, gaps in some:
            for i, w in gaps:
                ids[i] = own[w]
            yield b"".join(ids)

    def of(self, text: str) -> bytes:
        return next(self.of_all([text]))


_kept: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One store for each Python worker, kept from task to task."""
    if path not in _kept:
        _kept[path] = WordIds(path)
    return _kept[path]


def piece_lengths(n: int, context: int = CONTEXT) -> list[int]:
    """Whole contexts, then the binary digits of what is left, largest first."""
    rest = n % context
    return [context] * (n // context) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"
#: Numbers of (length, task) that are broadcast; more are joined by shuffle.
MOST_BROADCAST = 100_000


def _cut_up(path: str | None, context: int, with_ids: bool):
    def run(batches):
        ids = word_ids(path or vocabulary_path())
        end = np.array([END], "<u4").tobytes()
        part, bucket = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            cols = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth")}
            kept = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), ids.of_all(texts)):
                tokens += end
                n = len(tokens) // 4
                sizes = piece_lengths(n, context)
                starts = [0, *accumulate(sizes)][:-1]
                view = memoryview(tokens)
                parts = [view[4 * s : 4 * (s + k)] for s, k in zip(starts, sizes)]
                cols["doc_id"] += [doc_id] * len(sizes)
                cols["start"] += starts
                cols["length"] += sizes
                cols["ids_crc32"] += map(zlib.crc32, parts)
                cols["doc_tokens"] += [n] * len(sizes)
                cols["part"] += [part] * len(sizes)
                for k in sizes:
                    cols["nth"].append(bucket[k])
                    bucket[k] += 1
                if with_ids:
                    kept += [np.frombuffer(p, "<u4").astype(np.int32) for p in parts]
            arrays = [pa.array(v, pa.int64()) for v in cols.values()]
            names = list(cols)
            if with_ids:
                flat = np.concatenate(kept) if kept else np.empty(0, np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in kept])].astype(np.int32)), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pack(docs: DataFrame, context: int = CONTEXT, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) for every piece.

    vocabulary: path of the tokenizer's file, the public one by default.  Sequences are
    numbered without gaps, bucket by bucket, shorter lengths first: each task counts its pieces
    of each length, the cut pieces are kept in shared storage, and a piece's number is its own
    in its task after those of all smaller lengths and earlier tasks.  No piece is shuffled.

    A null text is empty and gives its end token alone; a null id stays null; rows that repeat
    are packed each for itself; no rows give no pieces.
    """
    if context & (context - 1):
        raise ValueError("context must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut(rows.mapInArrow(over_batches(_cut_up(vocabulary, context, with_ids)), PIECE + (", ids array<int>" if with_ids else "")))
    place = F.shiftleft(F.col("length"), 32) + F.col("part")
    counts = cut(pieces.groupBy(place.alias("__place")).agg(F.count("*").alias("__n")))
    first = running_before(counts, "__place", F.col("__n"), "__first").select("__place", "__first")
    few = counts.count() <= MOST_BROADCAST
    out = pieces.withColumn("__place", place).join(F.broadcast(first) if few else first, "__place")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("__first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))


def op2_power_of_two_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op2_power_of_two_packing": op2_power_of_two_packing}

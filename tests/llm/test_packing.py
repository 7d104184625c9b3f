import random
import zlib

import numpy as np
import pytest

from litloom.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.vocabulary_path())


def test_words_are_independent(tokenizer):
    r = random.Random(4)
    alphabet = list("abzAZ019'.,!?-_#ééΣσİß中​́\U0001f600") + [" ", "\n", "\t", " ", " ", "\x1c", "\x85", "\x0b"]
    ids = P.WordIds(P.vocabulary_path())
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["a<|endoftext|>b <|startoftext|>", "it's we'll O'Neil 's 'S", "", " ", "x\x1cy z", "́ ́a", "ΣΣ Σ"]
    for t in texts:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_and_sequences(spark, tokenizer):
    rows = [(i, " ".join(f"w{j % 91}" for j in range(n))) for i, n in enumerate([0, 1, 5, 700, 2000, 2049, 3])] + [(50, None), (51, ""), (None, "a b"), (3, "other"), (3, "other")]
    docs = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, sequence_id int").repartition(3)
    got = P.pack(docs, with_ids=True).collect()
    want = sorted(((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in rows), key=str)
    seen = {}
    for r in got:
        assert r.offset == 0 and r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 2048
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        seen.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    by_number = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by_number] == sorted(r.length for r in got)
    once = []
    for (d, n), parts in seen.items():
        starts = sorted({s for s, _ in parts})
        assert starts[0] == 0
        for copy in range(sum(s == 0 for s, _ in parts)):
            once.append((d, n))
    assert sorted(once, key=str) == sorted(((d, len(t)) for d, t in want), key=str)
    one = sorted((r.start, r.ids) for r in got if r.doc_id == 4)
    assert tuple(x for _, ids in one for x in ids) == dict(want)[4]
    assert P.pack(docs.limit(0)).count() == 0


def test_lengths():
    assert P.piece_lengths(1) == [1] and P.piece_lengths(4096 + 5) == [2048, 2048, 4, 1]

"""A training corpus from `documents`: identify, de-duplicate, clean, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
"""

from __future__ import annotations

from litloom.llm import common, language_id, minhash, mixing, packing, suffix_dedup

#: A document goes if no language is found in it or the best one's score is below this.
LEAST_LANGUAGE_SCORE = 0.4


def identify_language(spark, docs, sf_dir):
    """Documents with an identified language, its name in lang.  Learns from the training folds of docs.

    A null or letterless text goes; a null id is learnt from like any other and stays; rows that
    repeat stay each; a text of any length is read whole; no rows give no rows.
    """
    model = language_id.fit(docs, ~language_id.is_held_out(5, 0))
    return language_id.keep_identified(docs, model, LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate group: word shingles of five, similarity of 0.8 or more.

    Of repeated rows one stays, of rows without an id one for each different text.
    """
    return minhash.drop_near_duplicates(docs, words_per=5, percent=80)


def remove_repeated_passages(spark, docs, sf_dir):
    """Cuts every passage of fifty bytes or more that an earlier document has.

    A document that loses every byte is a copy and goes; a null id comes before all others.
    """
    return suffix_dedup.clean(docs)


def mix_sources(spark, docs, sf_dir):
    """Rows as often as the mix takes them; a null source is one of its own."""
    return mixing.take_mix(docs)


def pack_sequences(spark, docs, sf_dir):
    """The pieces of the packed sequences; rows that repeat are packed each for itself."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, byte-level cuts and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = common.written(stage(spark, docs, sf_dir))
        if before is not None:
            common.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""Mixing sources to target weights by pivotal dependent rounding (operator 4).

A source's target is its share of all words by weight, at most `cap` times its own words.
Each document is to be taken target / source_size times: the whole part for certain, the
fraction by rounding.  Rounding pairs a fractional document with a pool of smaller ones,
one if it is as large, and moves words between them in a random direction until the
document is taken whole or not at all; the sum of the words taken never changes and each
document drawn keeps its expectation.  Groups (a source's documents by a hash of the id) are
rounded in parallel, and what they leave is combined level by level in a tree of fan-in
`fan`; what the root leaves is settled by a draw.

The largest documents are settled first, so what is left of a group is the smallest
fractional one, and a source misses its target by less than that.  A document of more words
than the group's fractions come to is not drawn: the others take its fraction over or make
it whole, so it loses its expectation, as taking it would miss the target.  Only where the
rest is too small to bear a document's rounding can that document be left itself.

Random draws come from a hash of seed, level and group, so reruns agree whatever the
partitioning; documents of equal size are settled in the order of their ids.

Defined cases: a null text has size 0 and is neither taken nor dropped by
chance (0 words; copies as its source's rate); rows that repeat source, doc_id and size are
rounded as one unit, taken or left together; a null source is a source of its own, last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.common import NULL_ID, cut, table

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3.0
FAN = 5_000
SEED = 17
#: Moves after which a document that its pool cannot settle is left to the next level.
MOST_MOVES = 64
#: A fraction below it, or above one less it, that the pool cannot bear is given up or filled without a draw.
RARE = 0.02


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of sum(sizes) by weight; none above cap times its size, the excess reshared by weight."""
    out = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def pivotal(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds fractions, given largest first; keeps sum(p * size) but for one fraction that may be left.

    Each document in turn is settled against a pool of the next smaller ones.  It goes up
    by (1 - p) of its size with probability p, else down by p of it; the pool gives or takes
    these words, each member by its share.  A member with fraction q can bear a share of up
    to min(q / (1 - p), (1 - q) / p) of its size, so the pool is the fewest next documents
    that bear the whole size; a pool of one is the plain pivotal step.  If all that are left
    bear only a part, the document moves by that part, and again until it or they are whole.
    That can leave it with all their words; so one of more words than all fractions come to
    (or lack), or with a fraction that is RARE, is not drawn if the rest can take its fraction
    over or make it whole.  Fractions drawn keep their expectation, and what is left at the end
    is the smallest.
    """
    eps = 1e-9
    frac, sizes = p.astype(float).tolist(), size.astype(float).tolist()
    whole = lambda x: float(round(x)) if x <= eps or x >= 1 - eps else x
    for i, z in enumerate(sizes):
        frac[i] = float(rng.random() < frac[i]) if z == 0 and 0 < frac[i] < 1 else whole(frac[i])
    n = len(frac)
    free = [(x, z) for x, z in zip(frac, sizes) if 0 < x < 1]
    most = min(sum(x * z for x, z in free), sum((1 - x) * z for x, z in free))
    for i in range(n):
        for _ in range(MOST_MOVES):
            x, z = frac[i], sizes[i]
            if x in (0.0, 1.0):
                break
            pool, bears, room = [], [], 0.0
            j = i + 1
            while j < n and room < z:
                q = frac[j]
                if 0.0 < q < 1.0:
                    can = sizes[j] * min(q / (1 - x), (1 - q) / x)
                    pool.append(j)
                    bears.append(can)
                    room += can
                j += 1
            if not pool:
                break
            if room < z and (z > most or min(x, 1 - x) < RARE) and _taken_over(frac, sizes, i, pool, whole):
                break
            part = min(z, room)
            up = rng.random() < x
            move = (1 - x) * part if up else -x * part
            frac[i] = whole(x + move / z)
            for j, can in zip(pool, bears):
                frac[j] = whole(frac[j] - move * (can / room) / sizes[j])
    return np.array(frac)


def _taken_over(frac: list[float], sizes: list[float], i: int, pool: list[int], whole) -> bool:
    """Settles document i without a draw, its words spread over the pool by their room; whether that is possible."""
    x, z = frac[i], sizes[i]
    q, own = np.array([frac[j] for j in pool]), np.array([sizes[j] for j in pool])
    for up in (x > 0.5, x <= 0.5):
        move, room = ((1 - x) * z, q * own) if up else (-x * z, (1 - q) * own)
        if abs(move) <= room.sum():
            frac[i] = float(up)
            for j, y in zip(pool, (q - move * (room / room.sum()) / own).tolist()):
                frac[j] = whole(y)
            return True
    return False


def _round(level: int, seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "doc_id", "block"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(pdf["rank"].iloc[0]), int(pdf["up"].iloc[0])])
        p = pivotal(pdf["p"].to_numpy(float), pdf["weight"].to_numpy(float), rng)
        if last:
            p = np.where((p > 0) & (p < 1), rng.random(len(p)) < p, p)
        return pdf.assign(p=p)

    return run


def source_targets(docs: DataFrame, cap: float = CAP, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_sources: int = 100_000) -> list[tuple]:
    """(source, source_size, target, rank) of each source by code point, null last; the number of sources is bounded."""
    rows = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    w = [weights[i % len(weights)] for i in range(len(rows))]
    t = targets([r["size"] for r in rows], w, cap)
    return [(r["source"], int(r["size"]), float(x), i, int(r["n"])) for i, (r, x) in enumerate(zip(rows, t))]


def copies(sized: DataFrame, cap: float = CAP, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = SEED, fan: int = FAN) -> DataFrame:
    """doc_id, source, size -> one row for each different unit: doc_id, source, size, source_size, target, copies."""
    spark = sized.sparkSession
    known = source_targets(sized, cap, weights)
    schema = "source string, source_size long, target double, rank long, blocks long, rate double"
    plan = spark.createDataFrame([(s, z, t, r, max(1, -(-n // fan)), t / z if z else 0.0) for s, z, t, r, n in known], schema)
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    plan = F.broadcast(plan)  # one row a source, at most max_sources of some 60 bytes
    units = units.withColumn("src", F.col("source")).join(plan.withColumnRenamed("source", "psrc"), F.col("src").eqNullSafe(F.col("psrc"))).drop("src", "psrc")
    units = units.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole")).withColumn("weight", F.col("size") * F.col("m"))
    units = units.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("blocks")))
    most = max((-(-n // fan) for *_, n in known), default=1)
    fields = "doc_id long, source string, size long, m long, source_size long, target double, rank long, blocks long, rate double, whole long, p double, weight long, block long, up long"
    names = [f.split()[0] for f in fields.split(", ")]
    units = units.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    done = units.withColumn("up", F.col("block")).select(*names).groupBy("rank", "up").applyInPandas(_round(0, seed, most == 1), fields)
    if most > 1:
        done = cut(done)
        left = done.where("p > 0 and p < 1")
        level, width = 1, most
        while True:
            width = -(-width // fan)
            left = left.withColumn("up", F.floor(F.col("block") / F.lit(fan**level)).cast("long")).select(*names).groupBy("rank", "up").applyInPandas(_round(level, seed, width == 1), fields)
            if width == 1:
                break
            settled = left = cut(left)
            left = settled.where("p > 0 and p < 1")
            done = _settle(done, settled)
            level += 1
        done = _settle(done, left)
    return done.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def _settle(done: DataFrame, settled: DataFrame) -> DataFrame:
    """done with the fractions of the units that a later level has settled."""
    s = settled.select(F.col("rank").alias("r_"), F.col("doc_id").alias("d_"), F.col("size").alias("z_"), F.col("p").alias("p_"))
    out = done.join(s, (F.col("rank") == F.col("r_")) & (F.col("doc_id") == F.col("d_")) & (F.col("size") == F.col("z_")), "left")
    return out.withColumn("p", F.coalesce("p_", "p")).drop("r_", "d_", "z_", "p_")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    sized = cut(sizes(docs))  # both sides of the join read it, so texts are read once
    units = copies(sized, **options)
    same = F.col("s.doc_id").eqNullSafe(F.col("u.doc_id")) & F.col("s.source").eqNullSafe(F.col("u.source")) & (F.col("s.size") == F.col("u.size"))
    out = sized.alias("s").join(units.alias("u"), same)
    return out.select("s.doc_id", "s.size", "u.source_size", "u.target", (F.col("u.copies") * F.col("s.size")).alias("taken"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    own = docs.select("*", F.col("doc_id").cast("long").alias("__id"), F.col("source").cast("string").alias("__source"), word_count(F.col("text")).alias("__size"))
    units = copies(cut(sizes(docs)), **options).select(F.col("doc_id").alias("__u"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("copies").alias("__copies"))
    units = units.where("__copies > 0")
    same = F.col("__id").eqNullSafe(F.col("__u")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))
    out = own.join(units, same).withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_pivotal_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pivotal_mix": op4_pivotal_mix}

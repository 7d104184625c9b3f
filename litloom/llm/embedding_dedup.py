"""Near-duplicate vectors by Euclidean p-stable hashing (operator 3).

Normalised vectors are projected on Gaussian directions and quantised in steps of WIDTH;
`places` quantised values together are a bucket of one table.  Two unit vectors of
cosine c lie sqrt(2 - 2 c) apart and agree in one value with a known probability, so
`places` grows with the logarithm of the number of vectors (a bucket then holds MATES
strangers on average) and `tables` follows from the wanted RECALL at the very threshold;
above it recall is higher.  Every vector is hashed, and every pair of a bucket is compared
by exact cosine in double precision.

Equal vectors are merged first.  Buckets of more than BLOCK vectors are cut into blocks
that meet two by two.  Two passes spare the vectors the way: the first sends each vector's
entry of a table with a sketch of SKETCH signs of random projections only, and keeps the
entries that have a mate in their bucket whose sketch differs in few enough places (five
standard deviations beyond what the threshold makes likely); the second fetches the vectors
of these and compares them exactly.  A task counts the links of each vector and joins linked
vectors into local stars; it never sends pairs on.  A pair that meets in several tables is
counted in the first of them.

Defined cases: vectors that are null, zero, or hold null or non-finite components link
with nothing; vectors of different lengths do not link; a null vec_id names no component
that has another id.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.common import components, cut, local_roots, table, with_node
from litloom.llm.workers import over_batches, over_groups

WIDTH = 2.0
MATES = 4.0
SKETCH = 256
RECALL = 0.97
BLOCK = 2048
SEED = 5
#: Buckets of up to so many vectors are compared by shifting, larger ones by matrix products.
SMALL = 24
#: Rows of bucket entries that one group of a task holds, and heavy buckets that are broadcast.
GROUP_ROWS = 60_000
MOST_HEAVY = 100_000


def agree(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection agrees at a distance."""
    t = width / distance
    cdf = 0.5 * (1 + math.erf(-t / math.sqrt(2)))
    return 1 - 2 * cdf - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """places and tables for n vectors."""
    near, far = agree(math.sqrt(2 - 2 * threshold)), agree(math.sqrt(2))
    places = max(4, math.ceil(math.log(max(n, 2) / MATES) / -math.log(far)))
    return places, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near**places)))


@lru_cache(maxsize=8)
def _directions(dim: int, places: int, tables: int, seed: int):
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * places)), rng.random(tables * places) * WIDTH


def codes(unit: np.ndarray, places: int, tables: int, seed: int = SEED) -> np.ndarray:
    """The bucket of each unit vector in each table, as 64-bit numbers."""
    a, b = _directions(unit.shape[1], places, tables, seed)
    out = np.empty((len(unit), tables), np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(unit), 4096):
            q = np.floor((unit[at : at + 4096] @ a + b) / WIDTH).astype(np.int64).reshape(-1, tables, places).astype(np.uint64)
            h = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(unit.shape[1]), q.shape[:2]).copy()
            for k in range(places):
                h = (h ^ q[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            out[at : at + 4096] = h.view(np.int64)
    return out


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors; scaled by their largest component first, so that no square over- or underflows."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@lru_cache(maxsize=8)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED + 1, dim]).standard_normal((dim, SKETCH))


def sketches(unit: np.ndarray) -> np.ndarray:
    """On which side of SKETCH random planes each vector lies, as bits."""
    return np.packbits(unit @ _planes(unit.shape[1]) > 0, axis=1)


def most_apart(threshold: float) -> int:
    """Places in which two sketches may differ: five standard deviations above the mean at the threshold."""
    p = math.acos(threshold) / math.pi
    return math.floor(SKETCH * p + 5 * math.sqrt(SKETCH * p * (1 - p)))


def _usable(kind: str):
    """The vector as bytes, in the precision it came in, for the vectors that can link."""

    def run(batches):
        for batch in batches:
            raw = []
            for v in batch.column("embedding").to_pylist():
                ok = bool(v) and None not in v
                if ok:
                    x = np.array(v, kind)
                    ok = bool(np.isfinite(x).all() and x.any())
                raw.append(x.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "vec"])

    return run


def _by_dim(raw: list[bytes]):
    sizes = np.array([len(r) for r in raw])
    for s in np.unique(sizes):
        yield np.flatnonzero(sizes == s)


def _bucket(places: int, tables: int, kind: str, with_sketch: bool):
    """The keys of all tables, or the entries with a sketch."""

    def run(batches):
        for batch in batches:
            raw, node = batch.column("vec").to_pylist(), batch.column("node").to_numpy()
            for i in _by_dim(raw):
                unit = _units([raw[k] for k in i], kind)
                key = codes(unit, places, tables)
                if not with_sketch:
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel())], ["key"])
                    continue
                sketch = pa.array([x.tobytes() for x in sketches(unit)], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(key[:, t]), pa.array(np.full(len(i), t, np.int32)), pa.array(node[i]), sketch], ["key", "t", "node", "sketch"])

    return run


class Buckets:
    """Entries sorted into the meetings (key, i, j) of their buckets, and the places of pairs that may match."""

    def __init__(self, key, i, j, node, mine):
        self.order = np.lexsort((node, j, i, key))
        self.key, self.i, self.j, self.mine = (c[self.order] for c in (key, i, j, mine))
        new = np.r_[True, (self.key[1:] != self.key[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])] if len(key) else np.empty(0, bool)
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.r_[self.start, len(key)])
        self.number = np.cumsum(new) - 1

    def pairs(self, match, product):
        """Pairs of places by match(x, y) in small buckets and by product(x, y), a table, in large ones."""
        small = self.size[self.number] <= SMALL
        crossed = self.i != self.j
        for shift in range(1, min(SMALL, int(self.size.max(initial=1)))):
            a = np.flatnonzero((self.number[shift:] == self.number[:-shift]) & small[:-shift])
            a = a[~crossed[a] | (self.mine[a] != self.mine[a + shift])]
            if len(a):
                a = a[match(a, a + shift)]
                yield a, a + shift
        for s, n in zip(self.start[self.size > SMALL], self.size[self.size > SMALL]):
            rows = np.arange(s, s + n)
            left, right = rows[self.mine[rows] == self.i[s]], rows[self.mine[rows] == self.j[s]]
            for at in range(0, len(left), 1024):
                x, y = np.nonzero(product(left[at : at + 1024], right))
                x, y = left[at : at + 1024][x], right[y]
                if self.i[s] == self.j[s]:
                    x, y = x[y > x], y[y > x]
                yield x, y


ENTRY = ["key", "t", "i", "j", "node", "mine"]


def _sift(threshold: float):
    """Of a group of buckets: the entries that have a mate by their sketches."""
    apart = most_apart(threshold)

    def run(t: pa.Table) -> pa.Table:
        b = Buckets(*(t.column(c).to_numpy() for c in ("key", "i", "j", "node", "mine")))
        bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH // 8)[b.order]
        wide = np.ascontiguousarray(bits).view(np.uint64)
        signs = lambda x: np.unpackbits(bits[x], axis=1).astype(np.float32) * 2 - 1
        match = lambda x, y: np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1) <= apart
        product = lambda x, y: signs(x) @ signs(y).T >= SKETCH - 2 * apart
        keep = np.zeros(len(b.order), bool)
        for x, y in b.pairs(match, product):
            keep[x] = keep[y] = True
        return t.select(ENTRY).take(pa.array(b.order[keep]))

    return run


def _compare(places: int, tables: int, kind: str, threshold: float):
    """Of a group of buckets: (node, links) to sum, and (node, root) star edges."""

    def run(t: pa.Table) -> pa.Table:
        got = []
        # Buckets of vectors of one length share a key, as the length is part of it.
        keys = [t.column(c).to_numpy() for c in ("key", "i", "j", "node", "mine", "m", "t")]
        raw_all = t.column("vec").to_pylist()
        for part in _by_dim(raw_all):
            key, bi, bj, node, mine, m, tab = (k[part] for k in keys)
            buckets = Buckets(key, bi, bj, node, mine)
            order = buckets.order
            key, node, m, tab = (k[order] for k in (key, node, m, tab))
            unit = _units([raw_all[k] for k in part[order]], kind)
            match = lambda x, y, u=unit: np.einsum("ij,ij->i", u[x], u[y]) >= threshold
            product = lambda x, y, u=unit: u[x] @ u[y].T >= threshold
            hits_a, hits_b = [], []
            for x, y in buckets.pairs(match, product):
                hits_a.append(x)
                hits_b.append(y)
            if not hits_a:
                continue
            a, b = np.concatenate(hits_a), np.concatenate(hits_b)
            if not len(a):
                continue
            root = local_roots(len(key), a, b)
            in_pair = np.unique(np.r_[a, b])
            where = np.full(len(key), -1)
            where[in_pair] = np.arange(len(in_pair))
            # Earlier tables are looked up by node: a node's codes are computed once a group.
            nodes, back = np.unique(node[in_pair], return_index=True)
            code = codes(unit[in_pair[back]], places, tables)
            slot = np.searchsorted(nodes, node)
            links = np.zeros(len(nodes), np.int64)
            for at in range(0, len(a), 1 << 18):
                x, y = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
                fresh = np.ones(len(x), bool)
                ca, cb, now = slot[x], slot[y], tab[x]
                for k in range(int(now.max(initial=0))):
                    fresh &= (now <= k) | (code[ca, k] != code[cb, k])
                np.add.at(links, ca[fresh], m[y[fresh]])
                np.add.at(links, cb[fresh], m[x[fresh]])
            star = in_pair[root[in_pair] != in_pair]
            got.append((np.r_[nodes, node[star]], np.r_[links, np.zeros(len(star), np.int64)], np.r_[nodes, node[root[star]]]))
        cols = [np.concatenate([g[k] for g in got]) if got else np.empty(0, np.int64) for k in range(3)]
        return pa.table({"node": pa.array(cols[0], pa.int64()), "links": pa.array(cols[1], pa.int64()), "root": pa.array(cols[2], pa.int64())})

    return run


def _dealt(entries: DataFrame, heavy: DataFrame, n: int) -> DataFrame:
    """The n entries dealt to the meetings (i, j) of the blocks of their bucket, and these to groups g of about GROUP_ROWS."""
    few = heavy.count() <= MOST_HEAVY
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    # Each entry goes to as many meetings as its bucket has blocks.
    more = heavy.agg(F.sum(F.col("n") * (blocks - 1))).first()[0] or 0
    groups = max(8, -(-(n + more) // GROUP_ROWS))
    dealt = entries.join(F.broadcast(heavy) if few else heavy, "key", "left")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    return dealt.withColumn("g", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)).cast("int"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; vectors: vec_id, embedding array<float or double>."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    rows = rows.mapInArrow(over_batches(_usable(kind)), "vec_id long, vec binary")
    distinct = rows.where("vec is not null").groupBy("vec").agg(F.count("*").alias("m"))
    nodes = cut(with_node(distinct, "vec"))
    n = nodes.count()
    places, tables = plan(n, threshold)
    keys = nodes.select("node", "vec").mapInArrow(over_batches(_bucket(places, tables, kind, False)), "key long")
    heavy = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    entries = nodes.select("node", "vec").mapInArrow(over_batches(_bucket(places, tables, kind, True)), "key long, t int, node long, sketch binary")
    sifted = _dealt(entries, heavy, n * tables).select("g", *ENTRY, "sketch").groupBy("g").applyInArrow(over_groups(_sift(threshold)), "key long, t int, i int, j int, node long, mine int")
    sifted = cut(sifted)
    groups = max(8, -(-sifted.count() // GROUP_ROWS))
    dealt = sifted.join(nodes, "node").withColumn("g", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)).cast("int"))
    found = dealt.select("g", *ENTRY, "m", "vec").groupBy("g").applyInArrow(over_groups(_compare(places, tables, kind, threshold)), "node long, links long, root long")
    found = cut(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "root")
    per_node = nodes.select("vec", "node", "m").join(links, "node", "left").join(classes, "node", "left")
    per_node = per_node.select("vec", "node", "m", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    own = rows.join(per_node, "vec", "left").drop("vec")
    least = own.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("low"))
    out = own.join(least, "root", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    return out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("m") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op3_pstable_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = {
    "op3_pstable_embedding_dedup": """with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v where list_dot_product(e, e) > 0),
pairs as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id < b.vec_id and list_dot_product(a.e, b.e) >= 0.9),
both_ways as (select a, b from pairs union select b, a from pairs),
links as (select a, count(*) as n from both_ways group by a),
reach(n, l) as (select vec_id, vec_id from embeddings union select e.b, r.l from reach r join both_ways e on r.n = e.a),
low as (select n, min(l) as component_id from reach group by n)
select vec_id, coalesce(links.n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join low on low.n = vec_id left join links on a = vec_id""",
}

QUERIES = {"op3_pstable_embedding_dedup": op3_pstable_embedding_dedup}

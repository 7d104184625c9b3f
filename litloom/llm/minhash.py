"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join (operator 8).

A signature has SYMBOLS values of 16 bits, each a MinHash over the document's word
shingles; two sets of similarity s differ in a symbol with probability 1 - s.  Split
into CHUNKS chunks, two signatures that differ in at most RADIUS symbols differ by the
pigeonhole principle in at most ERRORS = RADIUS // CHUNKS symbols of some chunk.  So each
chunk is indexed once for every choice of ERRORS places left out, and any pair within
RADIUS shares a key: no pair under the signature-distance threshold is missed.  At
similarity 0.8 a pair differs in more than RADIUS = 15 of 32 symbols with probability
3e-4, at 0.85 with 5e-6.

Only components are wanted, so pairs are never rows:

* documents of the same set are merged first, into a node;
* the nodes of a key meet in a task, those of a large key in blocks of BUCKET with the key's
  least node in each.  The task compares signatures and sizes, and only nodes connected
  within RADIUS are joined into candidate stars; in a large key a node that nothing in its
  block is near to is joined to the least node unseen.  The stars' components are families;
* a family's documents meet in a task, a large family's in blocks of BLOCK_BYTES, each with
  the family's least document.  The task compares signatures within RADIUS and confirms pairs
  on full shingle sets unless both are connected already;
* of a family in several blocks, the documents not yet connected with its least one then visit
  its other blocks.  Documents of two blocks that both are need not meet, so a large group of
  near copies is read once and not once for each block.

The links' components are the result.

Defined cases: a null text, or one without words, has an empty set and links with
nothing; with fewer words than a shingle has, the whole sequence is the only shingle;
a null doc_id never names a component that has another id; rows that share a doc_id are
compared as different documents, each with its own component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litloom.llm.common import NULL_ID, components, cut, free, local_roots, partitions_for, table, with_node
from litloom.llm.workers import over_batches, over_groups

SYMBOLS = 32
CHUNKS = 8
RADIUS = 15
#: Bytes of text in a block of a large family, and in a group of families that meet in a task.
BLOCK_BYTES = 1 << 20
GROUP_BYTES = 2 << 20
#: Nodes of a block of a large key, entries of keys that meet in a task, and keys that are compared by shifting.
BUCKET = 2048
GROUP_ROWS = 40_000
SMALL = 12
#: Words whose hashes a task keeps; the store is emptied when it is full.
CACHE = 1 << 17

_rng = np.random.default_rng(20240607)
_MULT = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, words_per: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; words are split at ASCII white space, A-Z lower-cased."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    k = words_per if len(h) >= words_per else len(h)
    s = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        s = s * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j]
        s ^= s >> np.uint64(31)
    s = s * _MIX + np.uint64(k)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 1 << 14):
        low = np.minimum(low, (s[None, at : at + (1 << 14)] * _MULT[:, None]).min(axis=1))
    return ((low * _MIX) >> np.uint64(48)).astype(np.uint16)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: 100 * intersection >= percent * union."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sign(words_per: int):
    def run(batches):
        cache = WordHashes()
        for batch in batches:
            n, sets, sigs = [], [], []
            for t in batch.column("text").to_pylist():
                s = shingle_set(t or b"", words_per, cache)
                n.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "th", "n_shingles", "set_id", "sig"])

    return run


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """The index keys of signatures (rows): one for each chunk and each choice of places left out."""
    per, errors = SYMBOLS // CHUNKS, RADIUS // CHUNKS
    keys = []
    for c in range(CHUNKS):
        part = sigs[:, c * per : (c + 1) * per].astype(np.uint64)
        for number, kept in enumerate(combinations(range(per), per - errors)):
            k = np.full(len(sigs), c * 64 + number + 1, np.uint64)
            for place in kept:
                k = (k * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (part[:, place] + np.uint64(1))
                k ^= k >> np.uint64(29)
            keys.append(k * _MIX)
    return np.stack(keys, axis=1).view(np.int64)


def _index(batches):
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        keys = chunk_keys(sigs)
        each = keys.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), each))], ["key", "node"])


def _near(n: np.ndarray, sig: np.ndarray, x, y, percent: int) -> np.ndarray:
    """Whether places x and y may be similar, by size and by signature."""
    fits = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
    return fits & ((sig[x] != sig[y]).sum(axis=1) <= RADIUS)


def _stars(percent: int):
    """Of a group of (key, block) buckets: a link from each node to the root of those near it."""

    def run(t: pa.Table) -> pa.Table:
        key, block, node, low, split, n = (t.column(c).to_numpy() for c in ("key", "block", "node", "low", "split", "n_shingles"))
        order = np.lexsort((node, block, key))
        key, block, node, low, split, n = (c[order] for c in (key, block, node, low, split, n))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])] if len(key) else np.empty(0, bool)
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(key)])
        number = np.cumsum(new) - 1
        small = size[number] <= SMALL
        hits = [(np.empty(0, np.int64),) * 2]
        for shift in range(1, SMALL):
            x = np.flatnonzero((number[shift:] == number[:-shift]) & small[:-shift])
            x = x[_near(n, sig, x, x + shift, percent)]
            hits.append((x, x + shift))
        for s, m in zip(start[size > SMALL], size[size > SMALL]):
            for x in range(s, s + m - 1):
                y = np.arange(x + 1, s + m)
                y = y[_near(n, sig, np.full(len(y), x), y, percent)]
                hits.append((np.full(len(y), x), y))
        a, b = (np.concatenate(h) for h in zip(*hits))
        root = local_roots(len(key), a, b)
        top, linked = node[root], node[root] != node
        # The least node of a large key is in each of its blocks; the others may be near to nodes of other blocks.
        alone = split & (top != low) & ~linked & (node != low)
        top, linked = np.where(alone, low, top), linked | alone
        over = split & linked & (top != low)
        return pa.table({"a": pa.array(np.r_[top[linked], low[over]], pa.int64()), "b": pa.array(np.r_[node[linked], top[over]], pa.int64())})

    return run


def _families(words_per: int, percent: int):
    """Of a group of (family, i, j) meetings: a link from each document to the root of those found similar.

    Documents of i meet those of j.  Those of one comp are known to be connected.
    """

    def run(t: pa.Table) -> pa.Table:
        family, i, j, node, mine, n, comp = (t.column(c).to_numpy() for c in ("family", "i", "j", "node", "mine", "n_shingles", "comp"))
        order = np.lexsort((node, j, i, family))
        family, i, j, node, mine, n, comp = (c[order] for c in (family, i, j, node, mine, n, comp))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)[order]
        texts, cache = t.column("text"), WordHashes()
        new = np.r_[True, (family[1:] != family[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])] if len(node) else np.empty(0, bool)
        starts = np.flatnonzero(new)
        root = np.arange(len(node))
        sets: dict[int, np.ndarray] = {}

        def set_of(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingle_set(texts[int(order[x])].as_py(), words_per, cache)
            return sets[x]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        got = []
        for lo, hi in zip(starts, np.r_[starts[1:], len(node)]):
            sets.clear()
            rows = np.arange(lo, hi)
            known, first = np.unique(comp[lo:hi], return_index=True)
            if len(known) < hi - lo:
                root[lo:hi] = lo + first[np.searchsorted(known, comp[lo:hi])]
            left, right = rows[mine[lo:hi] == i[lo]], rows[mine[lo:hi] == j[lo]]
            for x in left:
                y = right[right > x] if i[lo] == j[lo] else right
                y = y[_near(n, sig, np.full(len(y), x), y, percent)]
                for z in y.tolist():
                    a, b = find(x), find(z)
                    if a != b and similar(set_of(x), set_of(z), percent):
                        root[max(a, b)] = min(a, b)
                        got.append((node[x], node[z]))
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    return run


def _texts_of(rows: DataFrame, named: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) for the wanted nodes, from the row of least id and text hash; repeated rows count once."""
    rep = named.join(wanted, "set_id").groupBy("node").agg(F.min(F.struct("did", "th")).alias("r"))
    rep = rep.select("node", "r.did", "r.th")
    own = rows.join(rep, ["did", "th"])
    number = F.row_number().over(Window.partitionBy("did", "th").orderBy("did"))
    return own.withColumn("number", number).where("number = 1").select("node", "text")


def _met(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate stars' input: the entries of keys that several nodes have, dealt to groups g of about GROUP_ROWS."""
    low = keys.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    low = low.select("key", "low", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks"))
    entries = cut(keys.join(low, "key"))
    total = entries.agg(F.count("*") + F.sum(F.when(F.col("node") == F.col("low"), F.col("blocks") - 1).otherwise(0))).first()[0] or 0
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    entries = entries.withColumn("block", F.explode(F.when(F.col("node") == F.col("low"), every).otherwise(own)))
    entries = entries.withColumns({"split": F.col("blocks") > 1, "g": F.pmod(F.xxhash64("key", "block"), F.lit(max(8, -(-total // GROUP_ROWS)))).cast("int")})
    return entries.join(nodes.select("node", "n_shingles", "sig"), "node").select("g", "key", "block", "node", "low", "split", "n_shingles", "sig")


#: What the meetings of families take.
MEETING = ["family", "i", "j", "node", "mine", "n_shingles", "sig", "comp", "text"]


def _grouped(meetings: DataFrame, total: int) -> DataFrame:
    return meetings.withColumn("g", F.pmod(F.xxhash64("family", "i", "j"), F.lit(partitions_for(total, GROUP_BYTES, 8))).cast("int")).select("g", *MEETING)


def _blocks(members: DataFrame) -> DataFrame:
    """members with the bytes of their family, its least node, its number of blocks, and their own block."""
    whole = members.groupBy("family").agg(F.sum("size").alias("bytes"), F.min("node").alias("low"))
    whole = whole.withColumn("blocks", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int"))
    return members.join(whole, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _at_home(members: DataFrame) -> DataFrame:
    """Each member in its family's block, the family's least in every one."""
    total = members.agg(F.sum(F.col("size") * F.when(F.col("node") == F.col("low"), F.col("blocks")).otherwise(1))).first()[0]
    own, every = F.array("block"), F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = members.withColumn("i", F.explode(F.when(F.col("node") == F.col("low"), every).otherwise(own)))
    return _grouped(dealt.withColumns({"j": F.col("i"), "mine": F.col("i"), "comp": F.col("node")}), total)


def _visits(members: DataFrame, links: DataFrame) -> DataFrame | None:
    """The members that are not connected with their family's least one, in parts of BLOCK_BYTES, with each of its other blocks."""
    large = members.where("blocks > 1").drop("text", "sig")
    if large.isEmpty():
        return None
    found = components(links.join(large.select("node"), links.a == F.col("node"), "left_semi")).withColumnRenamed("component", "comp")
    large = cut(large.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    slim = [c for c in MEETING if c not in ("text", "sig")]
    top = large.where("node = low").select("family", F.col("comp").alias("top"))
    out = large.join(top, "family").where("comp <> top").drop("top")
    parts = cut(out.groupBy("family").agg(F.sum("size").alias("out_bytes")).select("family", "out_bytes", F.ceil(F.col("out_bytes") / BLOCK_BYTES).cast("int").alias("parts")))
    if parts.isEmpty():
        return None
    total = large.join(parts, "family").agg(F.sum(F.col("size") * F.col("parts"))).first()[0] + out.join(parts, "family").agg(F.sum(F.col("size") * F.col("blocks"))).first()[0]
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    guests = out.join(parts, "family").withColumn("i", -1 - part).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("j <> block").withColumn("mine", F.col("i"))
    hosts = large.join(parts, "family").withColumn("i", F.explode(F.sequence(-F.col("parts"), F.lit(-1)))).withColumns({"j": F.col("block"), "mine": F.col("block")})
    meetings = guests.select(*slim).unionByName(hosts.select(*slim))
    return _grouped(meetings.join(members.select("node", "sig", "text"), "node"), total)


def near_duplicates(docs: DataFrame, words_per: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    return _classes(docs, words_per, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _classes(docs: DataFrame, words_per: int, percent: int) -> DataFrame:
    """near_duplicates with the text's hash th, for rows that share a doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.withColumns({"did": F.coalesce("doc_id", F.lit(NULL_ID)), "th": F.xxhash64("text")})
    # A signature for each row; persisted, as it has some 100 bytes and costs a pass over all texts.
    signed = cut(rows.select("doc_id", "th", "text").mapInArrow(over_batches(_sign(words_per)), "doc_id long, th long, n_shingles long, set_id binary, sig binary"))
    # A node is a different set.
    named = signed.where("set_id is not null").withColumn("did", F.coalesce("doc_id", F.lit(NULL_ID)))
    nodes = cut(with_node(named.groupBy("set_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "set_id"))
    keys = nodes.select("node", "sig").mapInArrow(over_batches(_index), "key long, node long")
    stars = _met(keys, nodes).groupBy("g").applyInArrow(over_groups(_stars(percent)), "a long, b long")
    families = cut(components(stars).withColumnRenamed("component", "family"))
    wanted = nodes.join(families, "node").select("node", "set_id", "n_shingles", "sig", "family")
    texts = _texts_of(rows.where("text is not null"), named, wanted.select("node", "set_id"))
    members = texts.join(wanted.drop("set_id"), "node").withColumn("size", F.octet_length("text").cast("long"))
    members = cut(_blocks(members))
    del texts, wanted, families, stars, keys  # so that their shuffles can go
    free(docs.sparkSession)
    compare = over_groups(_families(words_per, percent))
    links = cut(_at_home(members).groupBy("g").applyInArrow(compare, "a long, b long"))
    visits = _visits(members, links)
    if visits is not None:
        links = links.unionByName(visits.groupBy("g").applyInArrow(compare, "a long, b long"))
    final = nodes.select("set_id", "node").join(components(links).withColumnRenamed("component", "root"), "node", "left")
    final = final.select("set_id", F.coalesce("root", "node").alias("root"))
    roots = named.select("did", "doc_id", "th", "n_shingles", "set_id").join(final, "set_id")
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = roots.join(least, "root").select("doc_id", "th", "n_shingles", "component_id")
    alone = signed.where("set_id is null").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, words_per: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component the row of its least doc_id, of repeated rows one.

    Rows without words stay, each doc_id once for each different text.
    """
    keys = _classes(docs, words_per, percent).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.first("component_id").alias("__c"), F.max("n_shingles").alias("__n"))
    # Two different texts of one doc_id may both be least of one component: the lesser hash stays.
    lead = F.row_number().over(Window.partitionBy("__id", "__c", F.when(F.col("__n") == 0, F.col("__th"))).orderBy("__th"))
    keys = keys.withColumn("__lead", lead).where("__lead = 1 or __id is null").select("__id", "__th")
    own = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("__id"), F.xxhash64(F.col("text").cast("binary")).alias("__th"))
    own = own.join(keys.withColumn("__id", F.coalesce("__id", F.lit(NULL_ID))), ["__id", "__th"])
    number = F.row_number().over(Window.partitionBy("__id", "__th").orderBy("__id"))
    return own.withColumn("__number", number).where("__number = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_minhash_hamming(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words_per=4, percent=80)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op8_minhash_hamming": f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w),
n as (select doc_id, len(s) as n from s),
e as (select doc_id, unnest(s) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
pairs as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
both_ways as (select a, b from pairs union select b, a from pairs),
reach(v, l) as (select doc_id, doc_id from n union select e.b, r.l from reach r join both_ways e on r.v = e.a),
low as (select v, min(l) as component_id from reach group by v)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from n join low on v = doc_id""",
}

QUERIES = {"op8_minhash_hamming": op8_minhash_hamming}

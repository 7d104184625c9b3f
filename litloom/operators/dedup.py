"""Entity resolution of bibliographic records: edges, components, golden records, statistics.

Strategies only give edges (a, b, kind); components, numbering and fusion are shared.
Exact keys give star edges by a grouped minimum, so a group of n equal keys costs n rows.
Close titles meet by their rarest words, below LOOSE by blocks of like year and length; equal
titles count once, so a common title does not meet itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import ids
from litloom.functions.people import full_name
from litloom.functions.similarity import ratio_udf
from litloom.functions.text import normalize_title, strip, title_words, truthy
from litloom.operators.graph import components, cut
from litloom.operators.pairs import close_titles, close_vectors
from litloom.operators.ranges import running_before

FUZZY_THRESHOLD = 97
YEAR_GAP = 1
SEMANTIC_THRESHOLD = 0.92
#: Whose record is the base of a merged one.
PRIORITY = {"crossref": 5, "pubmed": 4, "openalex": 3, "semantic_scholar": 2, "s2": 2, "arxiv": 1}
NO_ABSTRACT = ("no abstract available", "abstract not available")
#: Words that count as common in more entries than COMMON, of which there are fewer than MOST_COMMON.
COMMON, MOST_COMMON = 200, 10_000
#: Below this threshold nearly all words of a title must be sent, so titles meet by blocks instead.
LOOSE = 90
EDGES = "a long, b long, kind string"


def prepared(docs: DataFrame) -> DataFrame:
    """idx, the matching keys and the year; docs: idx, title, year, doi, arxiv_id."""
    return docs.select("idx", "year", ids.normalize_doi(F.col("doi")).alias("doi"), ids.normalize_arxiv(F.col("arxiv_id")).alias("arxiv_id"), normalize_title(F.col("title")).alias("norm"))


def star_edges(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """Each row of a key to the least row of it."""
    named = rows.where(truthy(F.col(key)))
    low = named.groupBy(key).agg(F.min("idx").alias("a"))
    return named.join(low, key).where("idx <> a").select("a", F.col("idx").alias("b"), F.lit(kind).alias("kind"))


def exact_edges(rows: DataFrame) -> DataFrame:
    out = star_edges(rows, "doi", "doi")
    return out.unionByName(star_edges(rows, "arxiv_id", "arxiv")).unionByName(star_edges(rows, "norm", "title"))


def _rarest(titles: DataFrame, threshold: int) -> DataFrame:
    """(idx, year, len, word): of each title the words that must hold a rarest shared one.

    A pair within the threshold differs by at most D letters put in or taken out, and each
    alters two words at most (a blank parts two), so a title of n words shares max(2, n - 2 D)
    or more: the rarest of them is among its n + 1 - max(2, n - 2 D) rarest words.  Common words
    come last; they are the words of more than a share of all entries, so they are few.
    """
    entries = titles.select("idx", "year", "len", F.size("words").alias("n"), F.explode("words").alias("word"))
    total = entries.count()
    common = entries.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") > max(COMMON, total // MOST_COMMON))
    entries = entries.join(F.broadcast(common), "word", "left")  # fewer than MOST_COMMON rows
    r = (100 - threshold) / 100
    apart = F.floor(2 * r * F.col("len") / (1 - r) + 1e-9)
    kept = F.col("n") + 1 - F.greatest(F.lit(2), F.col("n") - 2 * apart)
    place = F.row_number().over(Window.partitionBy("idx").orderBy(F.coalesce("df", F.lit(0)), F.xxhash64("word"), "word"))
    return entries.withColumn("place", place).where(F.col("place") <= kept).select("idx", "year", "len", "word")


def _titles(rows: DataFrame) -> DataFrame:
    """Different titles of each year by their least records, of two words or more."""
    titles = rows.where(truthy(F.col("norm")) & F.col("year").isNotNull())
    titles = titles.groupBy("norm", "year").agg(F.min("idx").alias("idx"))
    return cut(titles.withColumns({"words": title_words(F.col("norm")), "len": F.char_length("norm")}).where(F.size("words") > 1))


def _by_rarest(titles: DataFrame, threshold: int, gap: int, symmetric: bool) -> DataFrame:
    """Candidates with their texts: titles meet on their rarest words alone (prefix filtering), which loses no pair."""
    # A meeting carries no text: a title of n words would be sent n times.
    entries = _rarest(titles, threshold)
    left = entries.select(F.col("idx").alias("ia"), F.col("len").alias("la"), "word", F.explode(F.sequence(F.col("year") - (gap if symmetric else 0), F.col("year") + gap)).alias("year_b"))
    right = entries.select(F.col("idx").alias("ib"), F.col("len").alias("lb"), "word", F.col("year").alias("year_b"))
    total = F.col("la") + F.col("lb")
    near = (F.col("ia") < F.col("ib")) & (100 * F.abs(F.col("la") - F.col("lb")) <= (100 - threshold) * total)
    pairs = left.join(right, ["word", "year_b"]).where(near).select("ia", "ib", "la", "lb").distinct()
    texts = lambda i, n, w: titles.select(F.col("idx").alias(i), F.col("norm").alias(n), F.col("words").alias(w))
    pairs = pairs.join(texts("ia", "na", "wa"), "ia").join(texts("ib", "nb", "wb"), "ib").where("na <> nb").where(F.size(F.array_intersect("wa", "wb")) > 1)
    # Indel distance is at least the edit distance, so this bound loses nothing.
    pairs = pairs.where(F.expr(f"levenshtein(na, nb, cast(floor({100 - threshold} * (la + lb) / 100) as int)) >= 0"))
    return pairs.select(F.col("ia").alias("a"), F.col("ib").alias("b"), "na", "nb")


def fuzzy_candidates(rows: DataFrame, threshold: int = FUZZY_THRESHOLD, gap: int = YEAR_GAP, symmetric: bool = True) -> DataFrame:
    """Pairs of different titles, years within the gap, that share two words or more and pass the length and edit bounds.

    Equal titles are one row here: their records are linked by star edges already.
    symmetric=False asks for the earlier record to be no younger.
    """
    titles = _titles(rows)
    return close_titles(titles, threshold, gap, symmetric, by_ratio=False) if threshold < LOOSE else _by_rarest(titles, threshold, gap, symmetric).select("a", "b")


def fuzzy_edges(rows: DataFrame, threshold: int = FUZZY_THRESHOLD, gap: int = YEAR_GAP, symmetric: bool = True) -> DataFrame:
    titles = _titles(rows)
    if threshold < LOOSE:
        return close_titles(titles, threshold, gap, symmetric, by_ratio=True).withColumn("kind", F.lit("fuzzy"))
    pairs = _by_rarest(titles, threshold, gap, symmetric)
    return pairs.where(ratio_udf("na", "nb") >= threshold - 1e-9).select("a", "b", F.lit("fuzzy").alias("kind"))


def clusters(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """docs with label (least idx reachable) and cluster_id (labels numbered in order from 0)."""
    labels = components(edges).withColumnsRenamed({"node": "idx", "component": "label"})
    out = docs.join(labels, "idx", "left").withColumn("label", F.coalesce("label", "idx"))
    return numbered(out)


def numbered(labelled: DataFrame) -> DataFrame:
    """Dense numbers of the labels: counts per range of labels, then a running number inside each range."""
    firsts = labelled.where("idx = label").select("label")
    numbers = running_before(firsts, "label", F.lit(1).cast("long"), "cluster_id")
    return labelled.join(numbers, "label")


def conservative(docs: DataFrame, threshold: int = FUZZY_THRESHOLD, gap: int = YEAR_GAP, symmetric: bool = True) -> DataFrame:
    """docs with cluster_id by identifiers, exact titles and close titles."""
    rows = cut(prepared(docs))
    return clusters(docs, exact_edges(rows).unionByName(fuzzy_edges(rows, threshold, gap, symmetric)).select("a", "b"))


def semantic_edges(vectors: DataFrame, threshold: float = SEMANTIC_THRESHOLD, block: int = 512, links: bool = False) -> DataFrame:
    """(a, b) pairs of cosine `threshold` or more; vectors: idx, embedding.  Exact, all pairs of blocks.

    links: what the pairs connect is connected, by fewer than the rows of two blocks from each two
    blocks, so large groups of close vectors do not give the square of their size.  `block`: rows of
    the smallest blocks that a table is dealt to.
    """
    vectors = cut(vectors.where(F.col("embedding").isNotNull()).select("idx", "embedding"))
    return close_vectors(vectors, vectors.count(), threshold, block, links)


def semantic(docs: DataFrame, vectors: DataFrame, threshold: float = SEMANTIC_THRESHOLD, **options) -> DataFrame:
    """Conservative clusters, then clusters whose representatives' vectors are close are joined."""
    first = cut(conservative(docs, **options))
    reps = first.where("idx = label").select("idx").join(vectors, "idx")
    links = semantic_edges(reps, threshold, links=True)
    own = first.where("idx <> label").select(F.col("label").alias("a"), F.col("idx").alias("b"))
    return clusters(first.drop("label", "cluster_id"), own.unionByName(links))


def valid_abstract(c: Column) -> Column:
    return F.coalesce((F.char_length(strip(c)) >= 20) & ~F.lower(c).isin(*NO_ABSTRACT), F.lit(False))


def provider_priority(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.lower(c)], F.lit(0))


def golden_records(clustered: DataFrame) -> DataFrame:
    """One fused record for each cluster; all by aggregates, the input order being idx.

    Base: highest priority, then citations, then first.  Abstract: the base's if valid and
    not shorter than another valid one, else the first longest valid one, else the base's.
    Identifiers: the base's, else the first there is.  Citations: the most.
    """
    rank = F.struct(-provider_priority(F.col("provider")), -F.coalesce("cited_by_count", F.lit(0)), F.col("idx"))
    base = lambda c: F.min_by(F.col(c), rank)
    first = lambda c: F.min_by(F.when(truthy(F.col(c).cast("string")), F.col(c)), F.when(truthy(F.col(c).cast("string")), F.col("idx")))
    ok = valid_abstract(F.col("abstract"))
    best = F.max_by(F.when(ok, F.col("abstract")), F.when(ok, F.struct(F.char_length("abstract"), -F.col("idx"))))
    plain = [c for c in ("title", "provider", "provider_id", "venue", "language", "authors", "query_id") if c in clustered.columns]
    known = [c for c in ("doi", "arxiv_id", "pubmed_id", "openalex_id", "s2_id") if c in clustered.columns]
    out = clustered.groupBy("cluster_id").agg(
        *[base(c).alias(c) for c in plain],
        base("abstract").alias("__own"),
        best.alias("__best"),
        *[F.coalesce(F.when(truthy(base(c)), base(c)), first(c)).alias(c) for c in known],
        F.coalesce(F.when(base("year") != 0, base("year")), F.min_by(F.when(F.col("year") != 0, F.col("year")), F.when(F.col("year") != 0, F.col("idx")))).alias("year"),
        F.max(F.coalesce("cited_by_count", F.lit(0))).alias("cited_by_count"),
        (base("url") if "url" in clustered.columns else F.lit(None).cast("string")).alias("url"),
        F.count("*").alias("size"),
    )
    own_wins = valid_abstract(F.col("__own")) & (F.char_length("__own") >= F.char_length("__best"))
    out = out.withColumn("abstract", F.when(own_wins | F.col("__best").isNull(), F.col("__own")).otherwise(F.col("__best")))
    return out.withColumn("url", ids.url_with_doi(F.col("url"), F.col("doi"))).drop("__own", "__best")


def enrich_orcids(fused: DataFrame, clustered: DataFrame) -> DataFrame:
    """Authors of the fused record without an ORCID take the one of the last member's author of that name."""
    members = clustered.select("cluster_id", "idx", F.posexplode("authors").alias("p", "other")).where(truthy(F.col("other.orcid")))
    mine = fused.select("cluster_id", F.posexplode("authors").alias("place", "author"))
    same_family = F.lower("author.family_name") == F.lower("other.family_name")
    both_given = truthy(F.col("author.given_name")) & truthy(F.col("other.given_name"))
    initial = F.lower(F.substring("author.given_name", 1, 1)) == F.lower(F.substring("other.given_name", 1, 1))
    whole = F.lower(full_name(F.col("author"))) == F.lower(full_name(F.col("other")))
    match = same_family & F.when(both_given, initial).otherwise(whole)
    found = mine.join(members, "cluster_id", "left").groupBy("cluster_id", "place").agg(
        F.first("author").alias("author"), F.max_by(F.when(match, F.col("other.orcid")), F.when(match, F.struct("idx", -F.col("p")))).alias("orcid")
    )
    author = F.struct("author.family_name", "author.given_name", F.when(truthy(F.col("author.orcid")), F.col("author.orcid")).otherwise(F.col("orcid")).alias("orcid"))
    rebuilt = found.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", author.alias("a")))), lambda x: x["a"]).alias("authors"))
    return fused.drop("authors").join(rebuilt, "cluster_id", "left")


def cluster_confidence(dois: Column, arxiv_ids: Column) -> Column:
    return F.when((F.size(dois) == 1) | ((F.size(dois) == 0) & (F.size(arxiv_ids) == 1)), F.lit(1.0)).otherwise(F.lit(0.95))


def assemble(clustered: DataFrame, members: bool = True) -> DataFrame:
    """The nested form of the clusters: members in input order, distinct identifiers in order, counts by provider.

    Identifiers and providers are counted before they are gathered, so a cluster of very many
    copies gathers its different values alone; its members are gathered only if asked for.
    """
    per = clustered.groupBy("cluster_id", "provider").agg(F.count("*").alias("n"))
    out = per.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "n")))).alias("provider_counts"), F.sum("n").alias("size"))
    for c, name in (("doi", "all_dois"), ("arxiv_id", "all_arxiv_ids")):
        own = clustered.where(truthy(F.col(c))).groupBy("cluster_id", c).agg(F.min("idx").alias("i"))
        own = own.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(c).alias("v")))), lambda x: x["v"]).alias(name))
        out = out.join(own, "cluster_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    if members:
        titles = F.transform(F.array_sort(F.collect_list(F.struct("idx", "title"))), lambda x: x["title"])
        out = out.join(clustered.groupBy("cluster_id").agg(titles.alias("members")), "cluster_id")
    return out.withColumn("confidence", cluster_confidence(F.col("all_dois"), F.col("all_arxiv_ids")))


def statistics(clustered: DataFrame) -> DataFrame:
    sizes = clustered.groupBy("cluster_id").agg(F.count("*").alias("size"))
    out = sizes.agg(
        F.sum("size").alias("total_documents"), F.count("*").alias("unique_documents"), F.count_if(F.col("size") == 1).alias("singleton_clusters"), F.avg("size").alias("avg_cluster_size"), F.max("size").alias("max_cluster_size")
    )
    out = out.withColumn("duplicates", F.col("total_documents") - F.col("unique_documents"))
    return out.withColumn("duplicate_rate", F.try_divide(F.col("duplicates"), F.col("total_documents")))


def size_histogram(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def match_types(clustered: DataFrame) -> DataFrame:
    """Of clusters with several members: what the first two agree on."""
    n = F.row_number().over(Window.partitionBy("cluster_id").orderBy("idx"))
    two = clustered.withColumn("n", n).where("n <= 2").groupBy("cluster_id").agg(*[F.max(F.when(F.col("n") == k, F.col(c))).alias(f"{c}{k}") for c in ("doi", "arxiv_id") for k in (1, 2)], F.count("*").alias("m"))
    kind = F.when(F.col("doi1") == F.col("doi2"), "exact_doi").when(F.col("arxiv_id1") == F.col("arxiv_id2"), "exact_arxiv").otherwise("fuzzy")
    return two.where("m = 2").groupBy(kind.alias("match_type")).agg(F.count("*").alias("clusters"))

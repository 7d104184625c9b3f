"""Queries of chunks, vectors and events over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.operators import dedup, structure
from litloom.operators.graph import components
from litloom.sources import normalize
from litloom.streaming import windows


def markdown_pages(spark, d):
    """Every page of the driver's table as a Markdown document: its tags dropped, its heading a header."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"<h1[^>]*>", "\n# "), r"</p>|</h1>", "\n\n"), r"<[^>]*>", "")
    return p.select(F.col("page_id").cast("string").alias("source_file"), F.lit(1).alias("page_number"), text.alias("text"))


def chunk_documents(spark, d):
    return structure.chunk_pages(markdown_pages(spark, d), 1000).select("source_file", "section", "header_level", "part", "total_parts", F.length("text").alias("chars"))


def chunk_selection(spark, d):
    """Every document is a paper with a budget of its own; its chunks are tagged in turn."""
    p = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("source_file"), F.lit(1).alias("page_number"), "text").where(F.col("text").isNotNull())
    tags = F.array(*map(F.lit, ("abstract", "methods", "results", "other")))
    part = F.col("part") + F.pmod(F.col("source_file").cast("long"), F.lit(36)).cast("int")
    chunks = structure.chunk_pages(p).select(F.col("source_file").alias("paper_id"), "id", "text", "page_number", F.array(F.element_at(tags, (part % 4 + 1).cast("int"))).alias("section_tags"), F.lit(None).cast("string").alias("section_role"), F.when(part % 9 == 0, "table").otherwise("text").alias("type"))
    return structure.select_chunks(chunks, ["abstract", "results"], 6000)


def semantic_pairs(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("idx"), "embedding")
    return dedup.semantic_edges(v, 0.92)


def semantic_clusters(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("idx"), "embedding")
    labels = components(dedup.semantic_edges(v, 0.92, links=True))
    return v.join(labels, v.idx == labels.node, "left").select("idx", F.coalesce("component", "idx").alias("component"))


def rate_window_counts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return windows.request_counts(e, "3600 seconds", "1800 seconds")


def event_props(spark, d):
    """Values of a JSON column by path."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", normalize.at(F.try_parse_json("props"), "k", "long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("low"), F.max("k").alias("high"))




QUERIES = {f.__name__: f for f in (chunk_documents, chunk_selection, semantic_pairs, semantic_clusters, rate_window_counts, event_props)}

_NAME = "trim(regexp_replace(name, '\\s+', ' ', 'g'))"
_CLASS = "case when {0} is null or {0} = 'null' then 'missing' when {0}[1] = '\"' and lower(trim(replace({0}, '\"', ''))) in ('nr', 'n/a', 'na', 'none', 'null', '') then 'nr' when {0} = '[]' then 'empty_list' when {0} = '{{}}' then 'empty_object' else 'value' end"
_COUNT = "count(*) filter (class = '{0}') as {0}"
_VECTORS = """v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings)"""
_PAIRS = "pairs as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id < b.vec_id and list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.92)"


def _chunk_sql(texts: str, limit: int) -> str:
    """CTEs that end in chunks(f, section, level, path, part, total, t); texts: a query of f and t."""
    strip = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    return f"""texts as ({texts}),
lines as (select f, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as n from texts),
headed as (select *, regexp_matches(line, '^#{{1,6}}\\s+.+$') as h from lines),
numbered as (select *, sum(h::int) over (partition by f order by n) as s from headed),
sections as (select f, s, coalesce(max({strip.format("regexp_extract(line, '^#{1,6}[ \\t]+(.+)$', 1)")}) filter (h), '') as section, coalesce(max(length(regexp_extract(line, '^(#{{1,6}})\\s', 1))) filter (h), 0)::int as level, coalesce(string_agg(line, chr(10) order by n) filter (not h), '') as body from numbered group by f, s),
blocks as (select f, s, list_filter(list_transform(regexp_split_to_array(body, '\\n\\s*\\n'), lambda b: {strip.format('b')}), lambda b: b <> '') as b from sections),
packed(f, s, i, part, t) as (select f, s, 1, 1, b[1] from blocks where len(b) > 0 union all
select p.f, p.s, i + 1, case when length(p.t) + 2 + length(b[i + 1]) <= {limit} then part else part + 1 end, case when length(p.t) + 2 + length(b[i + 1]) <= {limit} then p.t || chr(10) || chr(10) || b[i + 1] else b[i + 1] end
from packed p join blocks using (f, s) where i < len(b)),
parts as (select f, s, part, arg_max(t, i) as t from packed group by f, s, part),
chunks as (select f, section, level, part, count(*) over (partition by f, s) as total, t, s from parts join sections using (f, s))"""


_MARKDOWN = "select page_id::varchar as f, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<h1[^>]*>', chr(10) || '# ', 'g'), '</p>|</h1>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g') as t from pages"
_HEAD = "lower(trim(regexp_replace(left(t, 400), '\\s+', ' ', 'g')))"
_TAG = "(['abstract', 'methods', 'results', 'other'])[(part + f::bigint % 36) % 4 + 1]"
_CHOSEN = f"""tried as (select f, left(sha256(concat_ws('::', concat_ws('|', f, section, part::varchar), t)), 16) as id, greatest(1, length(t) // 4)::bigint as tokens, case when {_TAG} = 'abstract' or contains({_HEAD}, 'abstract') then 0
when {_TAG} = 'results' or contains({_HEAD}, 'results') or contains({_HEAD}, 'evaluation') or contains({_HEAD}, 'experiments') or contains({_HEAD}, 'performance') then 1 when (part + f::bigint % 36) % 9 = 0 then 2 end as rank from chunks),
ordered as (select *, row_number() over (partition by f order by rank, id) as n from tried where rank is not null),
walk(f, n, left_, taken) as (select f, n, 6000 - case when tokens <= 6000 then tokens else 0 end, tokens <= 6000 from ordered where n = 1 union all select o.f, o.n, left_ - case when o.tokens <= left_ then o.tokens else 0 end, o.tokens <= left_ from walk w join ordered o on o.f = w.f and o.n = w.n + 1)"""

SQL = {
    "chunk_documents": f"with recursive {_chunk_sql(_MARKDOWN, 1000)} select f as source_file, section, level as header_level, part, total::int as total_parts, length(t)::int as chars from chunks",
    "chunk_selection": f"with recursive {_chunk_sql('select doc_id::varchar as f, text as t from documents where text is not null', 4000)}, {_CHOSEN} select f as paper_id, id, (row_number() over (partition by f order by n))::int as ord, tokens from walk join ordered using (f, n) where taken",
    "semantic_pairs": f"with {_VECTORS}, {_PAIRS} select a, b from pairs",
    "semantic_clusters": f"with recursive {_VECTORS}, {_PAIRS}, both_ways as (select a, b from pairs union select b, a from pairs), reach(n, l) as (select vec_id, vec_id from v union select e.b, r.l from reach r join both_ways e on r.n = e.a) select n as idx, min(l) as component from reach group by n",
    "rate_window_counts": """select s as window_start, event_type, count(*) as requests from (select event_type, unnest([time_bucket(interval '1800 seconds', ts), time_bucket(interval '1800 seconds', ts) - interval '1800 seconds']) as s from events) group by all""",
    "event_props": "select event_type, count(k) as n, sum(k)::bigint as total, min(k) as low, max(k) as high from (select event_type, try_cast(json_extract(props, '$.k') as bigint) as k from events) group by event_type",
}

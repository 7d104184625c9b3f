"""Names, JSON facts, batches and pages over all rows of the driver's tables.

A document is a paper; its pages are the parts between empty lines, its first line a name,
its source a group.  JSON values are those of events.props.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.functions import numbers, people
from litloom.operators import stats, structure
from litloom.plans.structure import _CLASS, _COUNT, _NAME


def _documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source", "n_chars")


def _facts(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "props", F.get_json_object("props", "$.k").alias("k"))


def _papers(spark, d):
    return _documents(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("paper_id"), F.coalesce("source", F.lit("")).alias("group_id"), F.floor(F.col("n_chars") / 4).cast("long").alias("tokens"))


def parse_author_name_documents(spark, d):
    name = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return _documents(spark, d).select("doc_id", people.split_name(name).alias("a")).select("doc_id", "a.family_name", "a.given_name")


def field_coverage_events(spark, d):
    return stats.field_coverage(_facts(spark, d), ["props", "k"])


def value_classes_events(spark, d):
    return _facts(spark, d).select("event_id", numbers.classify_json(F.col("props")).alias("props"), numbers.classify_json(F.col("k")).alias("k"))


def batch_assign_documents(spark, d):
    return structure.batches(_papers(spark, d), 2, order="doc_id").select("paper_id", "group_id", "batch")


def token_plan_documents(spark, d):
    return structure.token_plan(structure.batches(_papers(spark, d), 2, order="doc_id"))


def reference_pages_documents(spark, d):
    """Pages are the parts of a text between empty lines; every fifth document has a page with a heading put between."""
    heading = F.element_at(F.array(*map(F.lit, ("## **References**", "# Works  Cited", "bibliography", "1. References", "**Reference**", "Literature Cited"))), (F.col("doc_id") % 6 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\n\nend\n "), heading, F.lit("\n\nafter"))).otherwise(F.col("text"))
    pages = _documents(spark, d).select(F.col("doc_id").cast("string").alias("source_file"), F.posexplode(F.split(text, "\n\n")).alias("page_number", "text"))
    return structure.flag_references(pages).select("source_file", "page_number", "is_references")


QUERIES = {f.__name__: f for f in (parse_author_name_documents, field_coverage_events, value_classes_events, batch_assign_documents, token_plan_documents, reference_pages_documents)}

_NAMED = "(select doc_id, split_part(coalesce(text, ''), chr(10), 1) as name from documents)"
_FACTS = "(select event_id, props, json_extract_string(props, '$.k') as k from events)"
_PAPERS = "(select doc_id, doc_id::varchar as paper_id, coalesce(source, '') as group_id, (n_chars // 4)::bigint as tokens from documents)"
_BATCHED = f"(select *, ((row_number() over (partition by group_id order by doc_id) - 1) // 2)::bigint as batch from {_PAPERS})"

_HEADING = "|".join(structure.REFERENCE_HEADINGS)

SQL = {
    "parse_author_name_documents": f"""select doc_id, case when {_NAME} = '' then 'Unknown' when contains({_NAME}, ',') then trim(split_part({_NAME}, ',', 1)) else regexp_extract({_NAME}, '(\\S*)$', 1) end as family_name,
nullif(case when contains({_NAME}, ',') then trim(substr({_NAME}, strpos({_NAME}, ',') + 1)) else regexp_extract({_NAME}, '^(.*)\\s\\S+$', 1) end, '') as given_name from {_NAMED}""",
    "field_coverage_events": f"select field, {', '.join(_COUNT.format(c) for c in ('value', 'nr', 'empty_list', 'empty_object', 'missing'))} from (select field, {_CLASS.format('v')} as class from (select 'props' as field, props as v from {_FACTS} union all select 'k', k from {_FACTS})) group by field",
    "value_classes_events": f"select event_id, {_CLASS.format('props')} as props, {_CLASS.format('k')} as k from {_FACTS}",
    "batch_assign_documents": f"select paper_id, group_id, batch from {_BATCHED}",
    "token_plan_documents": f"select group_id, count(distinct batch) as batches, count(distinct paper_id) as papers, sum(tokens)::bigint as tokens, avg(tokens) as mean_tokens from {_BATCHED} group by group_id",
    "reference_pages_documents": f"""select source_file, (page_number - 1)::int as page_number, bool_or(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(trim(l), '{_HEADING}', 'i'))) > 0) over (partition by source_file order by page_number) as is_references from (select doc_id::varchar as source_file, unnest(string_split(text, chr(10) || chr(10))) as text, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) as page_number
from (select doc_id, case when doc_id % 5 = 0 then text || chr(10) || chr(10) || 'end' || chr(10) || ' ' || (['## **References**', '# Works  Cited', 'bibliography', '1. References', '**Reference**', 'Literature Cited'])[doc_id % 6 + 1] || chr(10) || chr(10) || 'after' else text end as text from documents))""",
}

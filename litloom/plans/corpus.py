"""Queries over the bibliographic view: search, filters, resolution, statistics, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom import dsl
from litloom.functions import ids, numbers, text
from litloom.functions.dates import extract_year
from litloom.operators import dedup, extraction, filters, ranking, screening, stats
from litloom.plans.bib import ASKED, BIB, CLOSURE, NORM, documents, queries, with_
from litloom.sinks import exports
from litloom.sources import providers

SEARCH = 'title:"the" AND (abstract:tion OR venue:src1) NOT title:of'
FIELDED = "title:(thand OR und) year:2003 OR venue:src12"
GROUPS = [["\\bthe\\b", "\\bder\\b"], ["tion", "ung"]]
EXCLUDE = ["\\bstupid\\b", "apache", "idiot"]
JOURNALS = ["src1", "src3", "src7 Springer", "Journal of src9"]


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def dsl_boolean_search(spark, d):
    return documents(spark, d).where(dsl.to_column(SEARCH)).select("idx", "provider", "year")


def dsl_field_search(spark, d):
    return documents(spark, d).where(dsl.to_column(FIELDED)).select("idx", "provider", "year")


def dsl_flagship(spark, d):
    """Boolean search, exact-title clusters, their first records, the three most cited of each provider."""
    found = documents(spark, d).where(dsl.to_column("title:th OR title:en OR title:ion"))
    rows = dedup.prepared(found)
    clustered = dedup.clusters(found, dedup.star_edges(rows, "norm", "title").select("a", "b"))
    reps = clustered.where("idx = label").select("idx", "provider", "title", "cited_by_count", F.struct(-F.col("cited_by_count"), "idx").alias("order"))
    return filters.max_results(reps, 3, ("provider",), "order").drop("order")


def quality_filter(spark, d):
    return filters.quality_filter(documents(spark, d), queries(spark)).select("idx", "query_id")


def heuristic_screen(spark, d):
    return filters.heuristic_filter(documents(spark, d), exclude=EXCLUDE, groups=GROUPS).select("idx")


def heuristic_screen_reason(spark, d):
    return filters.heuristic_reasons(documents(spark, d), exclude=EXCLUDE, groups=GROUPS).select("idx", "decision", "reason")


def normalize_title(spark, d):
    return documents(spark, d).select("idx", text.normalize_title(F.col("title")).alias("norm"))


def normalize_doi(spark, d):
    raw = F.when(F.col("idx") % 4 == 0, F.concat(F.lit(" https://doi.org/"), F.upper("doi"))).when(F.col("idx") % 4 == 1, F.concat(F.lit("DOI: "), "doi")).otherwise(F.col("doi"))
    return documents(spark, d).select("idx", ids.normalize_doi(raw).alias("doi"))


def text_year(spark, d):
    raw = F.when(F.col("idx") % 3 == 0, F.concat(F.lit("published May "), (F.col("idx") % 300 + 1850).cast("string"))).otherwise((F.col("idx") % 3000).cast("string"))
    return documents(spark, d).select("idx", extract_year(raw).alias("year"))


def parse_number(spark, d):
    return documents(spark, d).select("idx", F.round(numbers.parse_number(F.concat(F.lit("about "), F.format_number("cited_by_count", 0), F.lit("."), F.col("idx").cast("string"), F.lit(" images"))), 6).alias("number"))


def extract_accuracy(spark, d):
    raw = F.concat(F.lit("accuracy of "), F.col("cited_by_count").cast("string"), F.lit(".5% on test"))
    return documents(spark, d).select("idx", numbers.extract_accuracy(raw).alias("accuracy"))


def dedup_exact_edges(spark, d):
    return dedup.exact_edges(dedup.prepared(documents(spark, d))).select("a", "b", "kind")


def dedup_exact_clusters(spark, d):
    docs = documents(spark, d)
    return dedup.clusters(docs, dedup.exact_edges(dedup.prepared(docs)).select("a", "b")).select("idx", "cluster_id")


def dedup_fuzzy_candidates(spark, d):
    return dedup.fuzzy_candidates(dedup.prepared(documents(spark, d)), 60).select("a", "b")


def dedup_fuzzy_clusters(spark, d):
    return dedup.conservative(documents(spark, d), threshold=70).select("idx", "cluster_id")


def _exact(spark, d):
    docs = documents(spark, d)
    return dedup.clusters(docs, dedup.exact_edges(dedup.prepared(docs)).select("a", "b"))


def dedup_golden_record(spark, d):
    return dedup.golden_records(_exact(spark, d)).select("cluster_id", "title", "provider", "abstract", "doi", "arxiv_id", "year", "cited_by_count", "url", "size")


def dedup_assembled(spark, d):
    return dedup.assemble(_exact(spark, d), members=False).select("cluster_id", *exports.cluster_row())


def dedup_statistics(spark, d):
    return _rounded(dedup.statistics(_exact(spark, d)), "avg_cluster_size", "duplicate_rate")


def cluster_size_histogram(spark, d):
    return dedup.size_histogram(_exact(spark, d))


def match_type_counts(spark, d):
    return dedup.match_types(_exact(spark, d))


def prisma_counts(spark, d):
    docs = documents(spark, d)
    kept = filters.quality_filter(docs, queries(spark))
    return stats.prisma_counts(docs, kept, dedup.clusters(kept, dedup.exact_edges(dedup.prepared(kept)).select("a", "b")))


def validation_profile(spark, d):
    return stats.validation_profile(documents(spark, d))


def duplicate_titles(spark, d):
    return stats.duplicate_titles(documents(spark, d))


def year_distribution(spark, d):
    return _rounded(stats.distribution(documents(spark, d), "year"), "percent")


def provider_totals(spark, d):
    return stats.with_total(documents(spark, d), "provider")


def top_venues(spark, d):
    return stats.top_values(documents(spark, d), "venue", 10)


def top_venues_by_provider(spark, d):
    return stats.top_by(documents(spark, d), "provider", "venue", 3).select("provider", "venue", "records", F.col("rank").cast("bigint").alias("rank"))


def max_results_per_group(spark, d):
    return filters.max_results(documents(spark, d), 5).select("idx", "provider", "query_id")


def distinct_by_key(spark, d):
    return filters.first_by_key(documents(spark, d), "doi").select("idx", "doi")


def export_filter(spark, d):
    return filters.export_filter(documents(spark, d), 2005, 2015, has_doi=True, has_abstract=True).select("idx")


def numeric_summary(spark, d):
    return _rounded(stats.numeric_summary(documents(spark, d).select(F.col("cited_by_count").cast("double").alias("x")), "x"), "mean", "median", "stdev")


def percent_normalize(spark, d):
    x = F.col("cited_by_count") / F.when(F.col("idx") % 2 == 0, F.lit(500.0)).otherwise(F.lit(1.0))
    return documents(spark, d).select("idx", F.round(numbers.share(x), 6).alias("share"))


def corr_pearson(spark, d):
    return _rounded(stats.pearson(documents(spark, d).select(F.col("cited_by_count").cast("double").alias("x"), F.col("year").cast("double").alias("y")), "x", "y"), "r")


def corr_spearman(spark, d):
    return _rounded(stats.spearman(documents(spark, d).select(F.col("cited_by_count").cast("double").alias("x"), F.col("year").cast("double").alias("y")), "x", "y"), "r")


def freq_topk(spark, d):
    words = documents(spark, d).select(F.explode(stats.split_values(F.col("title"), " ")).alias("word"))
    return stats.top_values(words, "word", 20)


def q1_exact_rank(spark, d):
    return ranking.rank_venues(documents(spark, d), JOURNALS, fuzzy=False).select("idx", "matched", "is_q1")


def q1_fuzzy_summary(spark, d):
    return _rounded(ranking.rank_summary(ranking.rank_venues(documents(spark, d), JOURNALS)), "percent")


def resume_anti_join(spark, d):
    docs = documents(spark, d)
    return screening.unscreened(docs, docs.where("idx % 5 = 0")).select("idx")


def merge_last_wins(spark, d):
    rows = documents(spark, d).select("title", "idx", "provider", (F.col("idx") % 3).alias("file_ord"))
    return screening.last_wins(rows, "title", "file_ord", "idx").select("title", "idx", "provider")


def screening_summary(spark, d):
    return screening.summary(filters.heuristic_reasons(documents(spark, d), exclude=EXCLUDE, groups=GROUPS))


def layered_screening(spark, d):
    docs = documents(spark, d).select("idx", "title", "abstract")
    return screening.screen(docs, screening.RuleBackend(["the"], ["idiot", "und"]), ["scope", "method"]).select("idx", "decision", "screening_confidence", "screening_reason")


def full_outer_reconcile(spark, d):
    docs = documents(spark, d)
    want = docs.where("idx % 3 <> 0").select(ids.pdf_name(F.col("doi"), F.col("arxiv_id"), F.col("title")).alias("name")).distinct()
    have = docs.where("idx % 4 <> 0").select(ids.pdf_name(F.col("doi"), F.col("arxiv_id"), F.col("title")).alias("name")).distinct()
    both = want.withColumn("w", F.lit(1)).join(have.withColumn("h", F.lit(1)), "name", "full")
    return both.groupBy(F.when(F.col("w").isNull(), "extra").when(F.col("h").isNull(), "missing").otherwise("matched").alias("status")).agg(F.count("*").alias("files"))


def missing_files_anti(spark, d):
    docs = documents(spark, d).withColumn("name", ids.pdf_name(F.col("doi"), F.col("arxiv_id"), F.col("title")))
    return docs.join(docs.where("idx % 4 <> 0").select("name").distinct(), "name", "left_anti").select("idx", "name")


def export_csv_rows(spark, d):
    return exports.csv_rows(documents(spark, d))


def export_bibtex_entry(spark, d):
    return exports.bibtex(documents(spark, d), 50).select("provider_id", "entry")


def export_ris_entry(spark, d):
    return exports.ris(documents(spark, d)).select("provider_id", "entry")


def cite_key_unique(spark, d):
    return exports.with_keys(documents(spark, d)).select("provider_id", "cite_key")


def cluster_mapping(spark, d):
    return exports.cluster_mapping(_exact(spark, d))


def screening_prompts(spark, d):
    decided = documents(spark, d).withColumn("decision", F.when(F.col("idx") % 3 == 0, "include").otherwise("exclude"))
    return extraction.screening_prompts(decided).select("idx", F.md5("prompt").alias("prompt_md5"))


def _matrix(spark, d):
    docs = documents(spark, d)
    return extraction.matrix(
        docs.select(
            F.col("provider_id").alias("source"), F.split("title", " ").alias("models_used"), F.concat(F.col("cited_by_count").cast("string"), F.lit(".25%")).alias("best_accuracy"),
            F.col("title").alias("key_contribution"), F.col("provider").alias("category"),
        )
    )


def model_frequencies(spark, d):
    return extraction.item_frequencies(_matrix(spark, d), "models_used", 20)


def accuracy_quartiles(spark, d):
    return _rounded(extraction.accuracies(_matrix(spark, d)), "q1", "median", "q3")


def synthesis_contexts(spark, d):
    return extraction.synthesis_contexts(_matrix(spark, d))


def merged_facts(spark, d):
    docs = documents(spark, d)
    facts = lambda where, tag: docs.where(where).select(F.col("provider_id").alias("paper_id"), F.create_map(F.lit("year"), F.concat(F.lit(tag), F.coalesce(F.col("year").cast("string"), F.lit("NR"))), F.lit(tag), F.lit("1")).alias("facts"))
    out = extraction.upsert(facts("idx % 2 = 0", "a"), facts("idx % 3 = 0", "b"))
    return out.select("paper_id", F.array_join(F.transform(F.map_entries("facts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("facts"))


def pdf_sources(spark, d):
    return providers.pdf_candidates(documents(spark, d)).select("idx", "pdf_url", "pdf_source")


def prisma_by_provider(spark, d):
    """The flow of each provider's records: identified, after the filter, in clusters of their own provider's first."""
    docs = documents(spark, d)
    kept = filters.quality_filter(docs, queries(spark))
    return stats.prisma_by_provider(docs, dedup.clusters(kept, dedup.exact_edges(dedup.prepared(kept)).select("a", "b")))


def relevant_venues(spark, d):
    """Leading journals among the records that screening has not excluded."""
    decided = filters.heuristic_reasons(documents(spark, d), exclude=EXCLUDE, groups=GROUPS).withColumn("decision", F.when(F.col("decision") == "pass", F.when(F.col("idx") % 2 == 0, "include").otherwise("maybe")).otherwise("exclude"))
    ranked = ranking.rank_venues(filters.decided(decided, "include", "maybe"), JOURNALS, fuzzy=False)
    return stats.top_by(ranked.withColumn("q1", F.col("is_q1").cast("string")), "q1", "venue", 5).select("q1", "venue", "records", F.col("rank").cast("bigint").alias("rank"))


QUERIES = {f.__name__: f for f in (
    prisma_by_provider, relevant_venues, cluster_mapping, screening_prompts, model_frequencies, accuracy_quartiles, synthesis_contexts, merged_facts, pdf_sources,
    dsl_flagship, dsl_boolean_search, dsl_field_search, quality_filter, heuristic_screen, heuristic_screen_reason, normalize_title, normalize_doi, text_year, parse_number, extract_accuracy,
    dedup_exact_edges, dedup_exact_clusters, dedup_fuzzy_candidates, dedup_fuzzy_clusters, dedup_golden_record, dedup_assembled, dedup_statistics, cluster_size_histogram, match_type_counts,
    prisma_counts, validation_profile, duplicate_titles, year_distribution, provider_totals, top_venues, top_venues_by_provider, max_results_per_group, distinct_by_key, export_filter,
    numeric_summary, percent_normalize, corr_pearson, corr_spearman, freq_topk, q1_exact_rank, q1_fuzzy_summary, resume_anti_join, merge_last_wins, screening_summary, layered_screening,
    full_outer_reconcile, missing_files_anti, export_csv_rows, export_bibtex_entry, export_ris_entry, cite_key_unique,
)}

_ANY = "lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(venue, ''))"
_TWO = "lower(coalesce(title, '') || ' ' || coalesce(abstract, ''))"
_T, _A, _V = ("lower(coalesce({}, ''))".format(c) for c in ("title", "abstract", "venue"))
_EXACT_EDGES = f"""keys as (select idx, doi as k, 'doi' as kind from bib where doi is not null union all select idx, arxiv_id, 'arxiv' from bib where arxiv_id is not null
union all select idx, norm, 'title' from (select idx, {NORM} as norm from bib) where norm <> ''),
stars as (select min(idx) over (partition by kind, k) as a, idx as b, kind from keys), edges as (select a, b from stars where a <> b), nodes as (select idx as n from bib)"""
_CLUSTERED = (BIB, _EXACT_EDGES, CLOSURE, "clustered as (select bib.*, label, dense_rank() over (order by label) - 1 as cluster_id from bib join labels on idx = n)")
_REASON = f"""reasons as (select idx, case when regexp_matches({_TWO}, '\\bstupid\\b', 'i') then 'Matched exclude pattern: \\bstupid\\b' when regexp_matches({_TWO}, 'apache', 'i') then 'Matched exclude pattern: apache'
when regexp_matches({_TWO}, 'idiot', 'i') then 'Matched exclude pattern: idiot' when not regexp_matches({_TWO}, '\\bthe\\b|\\bder\\b', 'i') then 'Failed include group 1'
when not regexp_matches({_TWO}, 'tion|ung', 'i') then 'Failed include group 2' end as reason from bib)"""
_KEPT = f"""kept as (select bib.* from bib left join asked using (query_id) where len(list_filter(coalesce(exclude_any, []), lambda w: contains({_ANY}, lower(w)))) = 0
and (len(coalesce(include_any, [])) = 0 or len(list_filter(include_any, lambda w: contains({_ANY}, lower(w)))) > 0))"""
_PDF = "case when doi is not null then replace(replace(doi, '/', '_'), ':', '_') when arxiv_id is not null then 'arxiv_' || arxiv_id else 'doc_' || left(sha256(title), 16) end || '.pdf'"
_FULL = "list_transform(authors, lambda a: coalesce(a.given_name || ' ', '') || a.family_name)"
_CSV = f"""coalesce(title, '') as title, coalesce(year::varchar, '') as year, array_to_string({_FULL}, '; ') as authors, len(authors)::varchar as author_count, coalesce(venue, '') as venue, coalesce(abstract, '') as abstract, provider, provider_id,
coalesce(doi, '') as doi, coalesce(arxiv_id, '') as arxiv_id, '' as pubmed_id, '' as openalex_id, '' as s2_id, coalesce(url, '') as url, coalesce(language, '') as language, coalesce(nullif(cited_by_count, 0)::varchar, '') as cited_by_count, query_id, '' as query_text, '' as retrieved_at"""
_FAMILY = "list_transform(authors, lambda a: a.family_name || coalesce(', ' || a.given_name, ''))"
_KIND = "case when regexp_matches(lower(coalesce(venue, '')), 'conference|proceedings|workshop|symposium|congress') then 'inproceedings' when regexp_matches(lower(coalesce(venue, '')), 'journal|review|magazine|transactions') then 'article' when provider = 'arxiv' then 'misc' when doi is not null then 'article' else 'misc' end"
_RIS = "case when regexp_matches(lower(coalesce(venue, '')), 'journal|review|transaction') then 'JOUR' when regexp_matches(lower(coalesce(venue, '')), 'conference|proceedings|symposium') then 'CONF' when doi is not null then 'JOUR' else 'GEN' end"
_KEYS = """keyed1 as (select *,
list_filter(list_transform(regexp_split_to_array(lower(title), '\\s+'), lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: length(w) > 2 and w not in ('a', 'an', 'the', 'on', 'in', 'at', 'of', 'for', 'to', 'and', 'or'))[1] as word from bib),
keyed2 as (select *, left(regexp_replace(case when len(authors) > 0 then authors[1].family_name else '' end, '[^a-zA-Z]', '', 'g') || coalesce(year::varchar, '') || coalesce(upper(left(word, 1)) || substr(word, 2), ''), 30) as key from keyed1),
keyed3 as (select *, case when key <> '' then key else left(regexp_replace(provider_id, '[^a-zA-Z0-9]', '', 'g'), 20) end as base_key from keyed2),
keyed4 as (select *, row_number() over (partition by base_key order by idx) as n from keyed3),
keyed5 as (select *, base_key || case when n = 1 then '' when n <= 27 then chr((n + 95)::int) else (n - 27)::varchar end as k from keyed4),
keyed6 as (select *, row_number() over (partition by k order by (n <> 1)::int, idx) as again from keyed5),
keyed as (select *, case when again = 1 then k else k || '_' || again end as cite_key from keyed6)"""


def _tex(x: str) -> str:
    # A rare mark stands for the backslash until all other signs are replaced.
    out = f"replace({x}, '\\', chr(1))"
    for a, b in (("{", "\\{"), ("}", "\\}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"replace(replace(replace({out}, '~', '\\textasciitilde{{}}'), '^', '\\textasciicircum{{}}'), chr(1), '\\textbackslash{{}}')"


_DOI_RAW = "case when idx % 4 = 0 then ' https://doi.org/' || upper(doi) when idx % 4 = 1 then 'DOI: ' || doi else doi end"
_YEAR_RAW = "case when idx % 3 = 0 then 'published May ' || (idx % 300 + 1850) else (idx % 3000)::varchar end"

_MATRIX = "matrix as (select provider_id as source, title as models, cited_by_count || '.25%' as best_accuracy, title as key_contribution, provider as category from bib)"

SQL = {
    "cluster_mapping": with_(*_CLUSTERED, recursive=True) + "select cluster_id, arg_min(title, idx) as title, count(*) as member_count, string_agg(distinct provider, ',' order by provider) as providers from clustered group by 1",
    "screening_prompts": with_(BIB) + "select idx, md5('Title: ' || coalesce(nullif(title, ''), 'NR') || chr(10) || 'Abstract: ' || coalesce(nullif(abstract, ''), 'NR')) as prompt_md5 from bib where idx % 3 = 0",
    "model_frequencies": with_(BIB, _MATRIX) + "select item, count(*) as records from (select unnest(list_filter(list_transform(string_split(array_to_string(string_split(models, ' '), ', '), ','), lambda w: lower(trim(w))), lambda w: w <> '')) as item from matrix) group by item order by records desc, item limit 20",
    "accuracy_quartiles": with_(BIB, _MATRIX) + "select count(*) as n, round(quantile_cont(v, 0.25), 6) as q1, round(median(v), 6) as median, round(quantile_cont(v, 0.75), 6) as q3 from (select try_cast(nullif(regexp_extract(best_accuracy, '(\\d{2,3}\\.?\\d*)%', 1), '') as double) as v from matrix) where v between 50 and 100 having count(*) > 5",
    "synthesis_contexts": with_(BIB, _MATRIX) + "select category, count(*) as papers, left(string_agg('- ' || source || ': ' || key_contribution, chr(10) order by source), 50000) as context from matrix group by category",
    "merged_facts": with_(BIB) + """, f as (select provider_id as paper_id, 'year' as k, 'a' || coalesce(year::varchar, 'NR') as v, 0 as o from bib where idx % 2 = 0 union all select provider_id, 'a', '1', 0 from bib where idx % 2 = 0
union all select provider_id, 'year', 'b' || coalesce(year::varchar, 'NR'), 1 from bib where idx % 3 = 0 union all select provider_id, 'b', '1', 1 from bib where idx % 3 = 0)
select paper_id, string_agg(k || '=' || v, ';' order by k) as facts from (select paper_id, k, arg_max(v, o) as v from f group by all) group by 1""",
    "pdf_sources": with_(BIB) + "select idx, case when regexp_matches(lower(url), '\\.pdf($|\\?)') then url when arxiv_id is not null then 'https://arxiv.org/pdf/' || arxiv_id || '.pdf' when doi is not null then 'https://doi.org/' || doi end as pdf_url, case when regexp_matches(lower(url), '\\.pdf($|\\?)') then 'direct' when arxiv_id is not null then 'arxiv' when doi is not null then 'doi' end as pdf_source from bib",
    "dsl_boolean_search": with_(BIB) + f"select idx, provider, year from bib where contains({_T}, 'the') and (contains({_A}, 'tion') or contains({_V}, 'src1')) and not contains({_T}, 'of')",
    "dsl_field_search": with_(BIB) + f"select idx, provider, year from bib where ((contains({_T}, 'thand') or contains({_T}, 'und')) and coalesce(year = 2003, false)) or contains({_V}, 'src12')",
    "dsl_flagship": with_(BIB) + f"""select idx, provider, title, cited_by_count from (select *, row_number() over (partition by provider order by cited_by_count desc, idx) as n from
(select *, {NORM} as norm, case when {NORM} = '' then idx else min(idx) over (partition by {NORM}) end as low from bib where contains({_T}, 'th') or contains({_T}, 'en') or contains({_T}, 'ion')) where idx = low) where n <= 3""",
    "quality_filter": with_(BIB, ASKED, _KEPT) + "select idx, query_id from kept",
    "heuristic_screen": with_(BIB, _REASON) + "select idx from reasons where reason is null",
    "heuristic_screen_reason": with_(BIB, _REASON) + "select idx, case when reason is null then 'pass' else 'exclude' end as decision, reason from reasons",
    "normalize_title": with_(BIB) + f"select idx, {NORM} as norm from bib",
    "normalize_doi": with_(BIB) + f"select idx, nullif(lower(trim(regexp_replace(regexp_replace(trim({_DOI_RAW}), '^https?://(dx\\.)?doi\\.org/', '', 'i'), '^doi:\\s*', '', 'i'))), '') as doi from bib",
    "text_year": with_(BIB) + f"select idx, case when try_cast({_YEAR_RAW} as int) is not null then case when try_cast({_YEAR_RAW} as int) between 1900 and 2100 then try_cast({_YEAR_RAW} as int) end else try_cast(nullif(regexp_extract({_YEAR_RAW}, '\\b(19|20)\\d{{2}}\\b', 0), '') as int) end as year from bib",
    "parse_number": with_(BIB) + "select idx, round((cited_by_count || '.' || idx)::double, 6) as number from bib",
    "extract_accuracy": with_(BIB) + "select idx, case when v between 50 and 100 then v end as accuracy from (select idx, try_cast(nullif(regexp_extract('accuracy of ' || cited_by_count || '.5% on test', '(\\d{2,3}\\.?\\d*)%', 1), '') as double) as v from bib)",
    "dedup_exact_edges": with_(BIB, _EXACT_EDGES) + "select a, b, kind from stars where a <> b",
    "dedup_exact_clusters": with_(*_CLUSTERED, recursive=True) + "select idx, cluster_id from clustered",
    "dedup_fuzzy_candidates": with_(BIB, f"norms as (select idx, year, {NORM} as norm from bib)", "t as (select norm, year, min(idx) as idx, list_distinct(list_filter(regexp_split_to_array(norm, '\\s+'), lambda w: w <> '')) as words from norms where norm <> '' and year is not null group by norm, year)") + """select a.idx as a, b.idx as b from t a join t b on a.idx < b.idx and abs(a.year - b.year) <= 1 and a.norm <> b.norm
where 100 * abs(length(a.norm) - length(b.norm)) <= 40 * (length(a.norm) + length(b.norm)) and len(list_intersect(a.words, b.words)) >= 2 and levenshtein(regexp_replace(a.norm, '[^\\x00-\\x7F]', '~', 'g'), regexp_replace(b.norm, '[^\\x00-\\x7F]', '~', 'g')) <= floor(40 * (length(a.norm) + length(b.norm)) / 100)""",
    "dedup_golden_record": with_(*_CLUSTERED, recursive=True) + """, ranked as (select *, row_number() over (partition by cluster_id order by case provider when 'crossref' then 5 when 'pubmed' then 4 when 'openalex' then 3 when 's2' then 2 when 'arxiv' then 1 else 0 end desc, cited_by_count desc, idx) as r,
coalesce(length(trim(abstract)) >= 20 and lower(abstract) not in ('no abstract available', 'abstract not available'), false) as ok from clustered),
bases as (select * from ranked where r = 1),
best as (select cluster_id, arg_max(abstract, struct_pack(n := length(abstract), i := -idx)) as abstract from ranked where ok group by cluster_id),
agg as (select cluster_id, arg_min(doi, idx) filter (doi is not null) as doi, arg_min(arxiv_id, idx) filter (arxiv_id is not null) as arxiv_id, arg_min(year, idx) filter (year is not null) as year, max(cited_by_count) as cited_by_count, count(*) as size from ranked group by cluster_id)
select b.cluster_id, b.title, b.provider, case when e.abstract is null or (b.ok and length(b.abstract) >= length(e.abstract)) then b.abstract else e.abstract end as abstract, coalesce(b.doi, g.doi) as doi, coalesce(b.arxiv_id, g.arxiv_id) as arxiv_id, coalesce(b.year, g.year) as year, g.cited_by_count,
case when coalesce(b.doi, g.doi) is not null and not contains(coalesce(b.url, ''), 'doi.org') then 'https://doi.org/' || coalesce(b.doi, g.doi) else b.url end as url, g.size from bases b join agg g using (cluster_id) left join best e using (cluster_id)""",
    "dedup_assembled": with_(*_CLUSTERED, recursive=True) + """, per as (select cluster_id, string_agg(provider || '(' || n || ')', '; ' order by provider) as provider_counts from (select cluster_id, provider, count(*) as n from clustered group by all) group by 1),
dois as (select cluster_id, count(*) as n, string_agg(doi, '; ' order by i) as v from (select cluster_id, doi, min(idx) as i from clustered where doi is not null group by all) group by 1),
arx as (select cluster_id, count(*) as n, string_agg(arxiv_id, '; ' order by i) as v from (select cluster_id, arxiv_id, min(idx) as i from clustered where arxiv_id is not null group by all) group by 1)
select c.cluster_id, c.size, case when coalesce(dois.n, 0) = 1 or (coalesce(dois.n, 0) = 0 and coalesce(arx.n, 0) = 1) then 1.0::double else 0.95::double end as confidence, coalesce(dois.v, '') as all_dois, coalesce(arx.v, '') as all_arxiv_ids, provider_counts
from (select cluster_id, count(*) as size from clustered group by 1) c join per using (cluster_id) left join dois using (cluster_id) left join arx using (cluster_id)""",
    "dedup_statistics": with_(*_CLUSTERED, recursive=True) + """select sum(n)::bigint as total_documents, count(*) as unique_documents, count(*) filter (n = 1) as singleton_clusters, round(avg(n), 6) as avg_cluster_size, max(n) as max_cluster_size, (sum(n) - count(*))::bigint as duplicates,
round((sum(n) - count(*)) / sum(n)::double, 6) as duplicate_rate from (select count(*) as n from clustered group by cluster_id)""",
    "cluster_size_histogram": with_(*_CLUSTERED, recursive=True) + "select size, count(*) as clusters from (select count(*) as size from clustered group by cluster_id) group by 1",
    "match_type_counts": with_(*_CLUSTERED, recursive=True) + """, two as (select *, row_number() over (partition by cluster_id order by idx) as n from clustered),
pair as (select a.doi as d1, b.doi as d2, a.arxiv_id as x1, b.arxiv_id as x2 from two a join two b on a.cluster_id = b.cluster_id and a.n = 1 and b.n = 2)
select case when d1 = d2 then 'exact_doi' when x1 = x2 then 'exact_arxiv' else 'fuzzy' end as match_type, count(*) as clusters from pair group by 1""",
    "prisma_counts": with_(BIB, ASKED, _KEPT, _EXACT_EDGES.replace("from bib", "from kept"), CLOSURE, "sizes as (select count(*) as n from labels group by label)", recursive=True) + """select (select count(*) from bib) as identified, (select count(*) from kept) as after_filter, count(*) as unique_documents, count(*) filter (n = 1) as singleton_clusters, (select count(*) from kept) - count(*) as duplicates_removed from sizes""",
    "prisma_by_provider": with_(BIB, ASKED, _KEPT, _EXACT_EDGES.replace("from bib", "from kept"), CLOSURE, recursive=True) + """select provider, count(*) as identified, count(l.n) as after_filter, count(*) filter (l.n = l.label) as unique_documents from bib left join labels l on l.n = idx group by provider""",
    "relevant_venues": with_(BIB, _REASON) + "select q1, venue, records, rank from (select (lower(venue) in ('src1', 'src3'))::varchar as q1, venue, count(*) as records, row_number() over (partition by lower(venue) in ('src1', 'src3') order by count(*) desc, venue) as rank from bib join reasons using (idx) where reason is null group by venue) where rank <= 5",
    "validation_profile": with_(BIB) + """select count(*) as total, count(doi) as with_doi, count(*) filter (abstract <> '') as with_abstract, count(arxiv_id) as with_arxiv_id, count(*) filter (venue <> '') as with_venue, count(url) as with_url, count(*) filter (len(authors) > 0) as with_authors,
count(*) filter (coalesce(title, '') = '') as missing_title, count(*) filter (year is null) as missing_year, count(*) filter (doi not like '10.%') as invalid_doi, min(year) as min_year, max(year) as max_year from bib""",
    "duplicate_titles": with_(BIB) + "select lower(trim(title)) as title, count(*) as records from bib where title <> '' group by 1 having count(*) > 1",
    "year_distribution": with_(BIB) + "select year, count(*) as records, round(count(*) * 100 / sum(count(*)) over ()::double, 6) as percent, (count(*) * 40 // max(count(*)) over ())::bigint as bar from bib where year is not null group by year",
    "provider_totals": with_(BIB) + "select provider, count(*) as records, grouping(provider)::bigint as is_total from bib group by rollup (provider)",
    "top_venues": with_(BIB) + "select venue, count(*) as records from bib group by venue order by records desc, venue limit 10",
    "top_venues_by_provider": with_(BIB) + "select * from (select provider, venue, count(*) as records, row_number() over (partition by provider order by count(*) desc, venue) as rank from bib group by provider, venue) where rank <= 3",
    "max_results_per_group": with_(BIB) + "select idx, provider, query_id from bib qualify row_number() over (partition by provider, query_id order by idx) <= 5",
    "distinct_by_key": with_(BIB) + "select idx, doi from bib qualify doi is null or row_number() over (partition by doi order by idx) = 1",
    "export_filter": with_(BIB) + "select idx from bib where year between 2005 and 2015 and doi is not null and abstract <> ''",
    "numeric_summary": with_(BIB) + "select count(*) as n, min(x) as low, max(x) as high, round(avg(x), 6) as mean, round(median(x), 6) as median, round(stddev_samp(x), 6) as stdev, count(*) filter (x <= 1) as lte_1, count(*) filter (x > 1 and x <= 100) as gt_1_le_100, count(*) filter (x > 100) as gt_100 from (select cited_by_count::double as x from bib)",
    "percent_normalize": with_(BIB) + "select idx, round(case when x <= 1 then x when x <= 100 then x / 100 end, 6) as share from (select idx, cited_by_count / case when idx % 2 = 0 then 500.0::double else 1.0::double end as x from bib)",
    "corr_pearson": with_(BIB) + "select count(*) as n, round(corr(cited_by_count::double, year::double), 6) as r from bib where year is not null",
    "corr_spearman": with_(BIB) + """select count(*) as n, round(corr(rx, ry), 6) as r from (select rank() over (order by cited_by_count) + (count(*) over (partition by cited_by_count) - 1) / 2.0::double as rx,
rank() over (order by year) + (count(*) over (partition by year) - 1) / 2.0::double as ry from bib where year is not null)""",
    "freq_topk": with_(BIB) + "select word, count(*) as records from (select unnest(list_filter(list_transform(string_split(title, ' '), lambda w: lower(trim(w))), lambda w: w <> '')) as word from bib) group by word order by records desc, word limit 20",
    "q1_exact_rank": with_(BIB) + "select idx, case when lower(venue) in ('src1', 'src3') then lower(venue) end as matched, lower(venue) in ('src1', 'src3') as is_q1 from bib",
    "q1_fuzzy_summary": with_(BIB, "j as (select unnest(['src1', 'src3', 'src7 Springer', 'Journal of src9']) as j)", "v as (select distinct venue from bib join j on list_has_all(string_split(lower(j), ' '), string_split(lower(trim(venue)), ' ')) where venue <> '')") + "select count(*) as total, count(v.venue) as q1, count(*) - count(v.venue) as other, round(count(v.venue) * 100 / count(*)::double, 6) as percent from bib left join v using (venue)",
    "resume_anti_join": with_(BIB) + "select idx from bib where not exists (select 1 from bib d where d.idx % 5 = 0 and d.doi = bib.doi) and not exists (select 1 from bib d where d.idx % 5 = 0 and d.title = bib.title)",
    "merge_last_wins": with_(BIB) + "select title, idx, provider from bib qualify row_number() over (partition by title order by idx % 3 desc, idx desc) = 1",
    "screening_summary": with_(BIB, _REASON) + "select case when reason is null then 'pass' else 'exclude' end as decision, count(*) as records from reasons group by 1",
    "layered_screening": with_(BIB) + f"""select idx, case when contains({_TWO}, 'idiot') or contains({_TWO}, 'und') then 'exclude' when contains({_TWO}, 'the') then 'include' else 'maybe' end as decision, case when contains({_TWO}, 'idiot') or contains({_TWO}, 'und') or contains({_TWO}, 'the') then 90 else 50 end as screening_confidence,
case when contains({_TWO}, 'idiot') then 'scope: idiot' when contains({_TWO}, 'und') then 'scope: und' when contains({_TWO}, 'the') then 'scope: the | method: the' else 'scope: no rule | method: no rule' end as screening_reason from bib""",
    "full_outer_reconcile": with_(BIB, f"want as (select distinct {_PDF} as name from bib where idx % 3 <> 0)", f"have as (select distinct {_PDF} as name from bib where idx % 4 <> 0)") + "select case when want.name is null then 'extra' when have.name is null then 'missing' else 'matched' end as status, count(*) as files from want full join have using (name) group by 1",
    "missing_files_anti": with_(BIB, f"named as (select idx, {_PDF} as name from bib)") + "select idx, name from named where name not in (select name from named where idx % 4 <> 0)",
    "export_csv_rows": with_(BIB) + f"select {_CSV}, '' as cluster_id from bib",
    "export_bibtex_entry": with_(BIB, _KEYS) + f"""select provider_id, '@' || {_KIND} || '{{' || cite_key || ',' || chr(10) || array_to_string(list_filter([case when title <> '' then '  title = {{' || {_tex('title')} || '}}' end,
case when len(authors) > 0 then '  author = {{' || {_tex(f"array_to_string({_FAMILY}, ' and ')")} || '}}' end, '  year = {{' || year || '}}', case when venue <> '' then case when {_KIND} = 'inproceedings' then '  booktitle' else '  journal' end || ' = {{' || {_tex('venue')} || '}}' end,
'  doi = {{' || doi || '}}', '  url = {{' || url || '}}', case when abstract <> '' then '  abstract = {{' || {_tex("case when length(abstract) > 50 then left(abstract, 47) || '...' else abstract end")} || '}}' end], lambda x: x is not null), ',' || chr(10)) || chr(10) || '}}' as entry from keyed""",
    "export_ris_entry": with_(BIB) + f"""select provider_id, array_to_string(list_filter(list_concat(['TY  - ' || {_RIS}, case when title <> '' then 'TI  - ' || title end], list_transform({_FAMILY}, lambda a: 'AU  - ' || a),
['PY  - ' || year, case when venue <> '' then case when {_RIS} = 'JOUR' then 'JO  - ' else 'T2  - ' end || venue end, case when abstract <> '' then 'AB  - ' || abstract end, 'DO  - ' || doi, 'UR  - ' || url, 'DB  - ' || provider, case when cited_by_count > 0 then 'C1  - Cited by: ' || cited_by_count end, 'ER  - ']), lambda x: x is not null), chr(10)) as entry from bib""",
    "cite_key_unique": with_(BIB, _KEYS) + "select provider_id, cite_key from keyed",
}

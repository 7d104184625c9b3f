"""Queries of the providers' normalisers, identifiers, dates, names and search runs, over all documents.

Responses are made from the bibliographic view in each provider's own form, then read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom import dsl
from litloom.functions import citations, dates, ids, people
from litloom.operators import reports, runs
from litloom.plans.bib import BIB, QUERIES_ROWS, documents, with_
from litloom.sources import normalize



def _full():
    return F.transform("authors", people.full_name)


def _let(value, f):
    """f of the value, which is computed once: inside a function of elements it would be again for each."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _raw(spark, d, **fields):
    """idx and raw: a JSON response of the fields."""
    return documents(spark, d).select("idx", F.to_json(F.struct(*[(c if not isinstance(c, str) else F.col(c)).alias(n) for n, c in fields.items()])).alias("raw"))


def _out(records):
    return records.select(
        "title", "year", "provider", "provider_id", F.col("external_ids.doi").alias("doi"), F.col("external_ids.arxiv_id").alias("arxiv_id"), F.col("external_ids.pubmed_id").alias("pubmed_id"),
        "abstract", people.listed(F.col("authors")).alias("authors"), "venue", "url", "cited_by_count",
    )


def provider_openalex(spark, d):
    """Titles come back from their inverted index as well."""
    own = F.filter(F.split("title", r"\s+"), lambda w: w != "")
    index = _let(F.array_sort(F.transform(own, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), lambda words: _let(F.filter(F.sequence(F.lit(1), F.size(words)), lambda k: (k <= F.size(words)) & ((k == 1) | (F.get(words, k - 1)["w"] != F.get(words, k - 2)["w"]))), lambda starts: F.transform(starts, lambda k, n: F.struct(F.get(words, k - 1)["w"], F.transform(F.slice(words, k, F.coalesce(F.get(starts, n + 1), F.size(words) + 1) - k), lambda x: x["i"])))))
    index = F.map_from_entries(index)
    who = F.transform(_full(), lambda n: F.struct(F.struct(n.alias("display_name")).alias("author")))
    raw = _raw(spark, d, id=F.concat(F.lit("https://openalex.org/W"), "idx"), display_name="title", publication_year="year", ids=F.struct(F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "idx").alias("pmid")), authorships=who, abstract_inverted_index=index, cited_by_count="cited_by_count", primary_location=F.struct(F.struct(F.col("venue").alias("display_name")).alias("source"), F.col("url").alias("landing_page_url")))
    return _out(normalize.openalex(raw))


def provider_crossref(spark, d):
    who = F.transform("authors", lambda a: F.struct(a["family_name"].alias("family"), a["given_name"].alias("given")))
    issued = F.struct(F.array(F.array(F.col("year"))).alias("date-parts"))
    return _out(normalize.crossref(_raw(spark, d, title=F.array("title"), DOI=F.upper("doi"), issued=issued, author=who, abstract="abstract", **{"container-title": F.array("venue"), "URL": F.col("url"), "is-referenced-by-count": F.col("cited_by_count")})))


def provider_s2(spark, d):
    who = F.transform(_full(), lambda n: F.struct(n.alias("name")))
    found = F.struct(F.col("doi").alias("DOI"), F.col("arxiv_id").alias("ArXiv"), F.col("idx").cast("string").alias("PubMed"))
    return _out(normalize.semantic_scholar(_raw(spark, d, paperId="provider_id", title="title", year="year", externalIds=found, abstract="abstract", authors=who, venue="venue", url="url", citationCount="cited_by_count")))


def provider_doaj(spark, d):
    who = F.transform("authors", lambda a: F.struct(people.family_first(a).alias("name")))
    body = F.struct(F.col("title").alias("title"), F.col("year").cast("string").alias("year"), F.array(F.struct(F.lit("DOI").alias("type"), F.col("doi").alias("id"))).alias("identifier"), F.col("abstract").alias("abstract"), who.alias("author"), F.struct(F.col("venue").alias("title")).alias("journal"), F.array(F.struct(F.lit("fulltext").alias("type"), F.col("url").alias("url"))).alias("link"))
    return _out(normalize.doaj(_raw(spark, d, id="provider_id", bibjson=body)))


def provider_core(spark, d):
    who = F.transform("authors", lambda a: F.struct(people.family_first(a).alias("name")))
    return _out(normalize.core(_raw(spark, d, id=F.col("idx"), title="title", yearPublished="year", doi=F.concat(F.lit("doi:"), "doi"), arxivId="arxiv_id", abstract="abstract", authors=who, publisher="venue", downloadUrl="url", citationCount="cited_by_count")))


def provider_ieee(spark, d):
    who = F.struct(F.transform("authors", lambda a: F.struct(people.family_first(a).alias("full_name"))).alias("authors"))
    return _out(normalize.ieee(_raw(spark, d, article_number=F.col("idx").cast("string"), title="title", publication_year=F.col("year").cast("string"), doi="doi", abstract="abstract", authors=who, publication_title="venue", html_url="url", citing_paper_count="cited_by_count")))


def provider_arxiv(spark, d):
    rows = documents(spark, d).select(
        F.concat(F.lit("http://arxiv.org/abs/2301."), F.col("idx").cast("string"), F.lit("v2")).alias("id"), F.concat(F.lit("\n  "), "title").alias("title"), F.concat("title", F.lit("\n "), "venue").alias("summary"),
        F.concat(F.col("year").cast("string"), F.lit("-03-01T00:00:00Z")).alias("published"), F.transform(_full(), lambda n: F.struct(n.alias("name"))).alias("author"), "doi", F.when(F.col("idx") % 2 == 0, F.col("language")).alias("category"),
    )
    return _out(normalize.arxiv(rows))


def provider_pubmed(spark, d):
    """Authors of odd records have no first name in front of one that has."""
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9 .,-]", "")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    who = F.array_join(F.transform("authors", lambda a: tag("Author", F.concat(tag("LastName", safe(a["family_name"])), F.when((F.col("idx") % 2 == 1) & (a["family_name"] == F.col("authors")[0]["family_name"]), "").otherwise(F.coalesce(tag("ForeName", a["given_name"]), F.lit("")))))), "")
    date = F.when(F.col("idx") % 3 == 0, tag("MedlineDate", F.concat(F.lit("Spring "), F.col("year").cast("string"), F.lit(" issue")))).otherwise(tag("Year", F.col("year").cast("string")))
    body = F.concat(tag("PMID", F.col("idx").cast("string")), F.lit("<Article><Journal>"), tag("Title", safe(F.col("venue"))), F.lit("<JournalIssue><PubDate>"), F.coalesce(date, F.lit("")), F.lit("</PubDate></JournalIssue></Journal>"), tag("ArticleTitle", safe(F.col("title"))), F.coalesce(F.concat(F.lit('<ELocationID EIdType="doi">'), "doi", F.lit("</ELocationID>")), F.lit("")), F.lit('<AuthorList CompleteYN="Y">'), who, F.lit("</AuthorList></Article>"))
    return _out(normalize.pubmed(documents(spark, d).select(F.concat(F.lit("<PubmedArticle><MedlineCitation>"), body, F.lit("</MedlineCitation></PubmedArticle>")).alias("raw"))))


def identifiers(spark, d):
    url = F.concat(F.lit("https://arxiv.org/abs/2301."), F.col("idx").cast("string"), F.lit("v3"))
    return documents(spark, d).select(
        "idx", ids.arxiv_from_url(url).alias("arxiv"), ids.openalex_id(F.concat(F.lit("https://openalex.org/W"), F.col("idx").cast("string"))).alias("openalex"), ids.pubmed_id(F.concat(F.lit("https://x.org/"), F.col("idx").cast("string"), F.lit("/"))).alias("pubmed"),
        ids.ieee_number(F.when(F.col("idx") % 2 == 0, F.col("idx").cast("string")).otherwise("x"), F.concat(F.lit("https://x.org/document/"), F.col("idx").cast("string"))).alias("ieee"), ids.url_with_doi(F.col("url"), F.col("doi")).alias("url"),
        ids.provider_id(F.col("doi"), F.lit(None).cast("string"), F.col("arxiv_id"), F.lit(""), F.col("title")).alias("provider_id"), ids.chunk_id(F.col("venue"), F.col("title")).alias("chunk"), ids.table_id(F.col("venue"), F.col("idx"), F.lit(1)).alias("table"),
    )


def loose_dates(spark, d):
    """Five spellings of a date by turns, and years of MEDLINE."""
    day = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("idx") % 4000).cast("int"))
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd'T'00:00:00", "yyyy-MM-dd'T'00:00:00'Z'", "dd/MM/yyyy"]
    raw = F.coalesce(*[F.when(F.col("idx") % 6 == k, F.date_format(day, f)) for k, f in enumerate(forms)], F.lit("soon"))
    parsed = dates.parse_date(raw)
    return documents(spark, d).select("idx", F.date_format(parsed, "yyyy-MM-dd").alias("day"), dates.medline_year(F.concat(F.lit("Winter "), F.date_format(day, "yyyy"), F.lit("-05"))).alias("medline"), dates.in_years(F.col("year"), 2005, 2012).alias("in_years"))


def author_forms(spark, d):
    """Names split at the last blank, and how records cite."""
    a = people.split_last_space(F.substring_index("title", ".", 1))
    return documents(spark, d).select("idx", a["family_name"].alias("family_name"), a["given_name"].alias("given_name"), citations.short_cite(people.listed(F.col("authors"), ", "), F.col("year"), F.col("idx")).alias("short"))


def _first_words():
    word = lambda n: F.regexp_extract("title", rf"^(?:[^a-zA-Z]*[a-zA-Z]+){{{n}}}[^a-zA-Z]*([a-zA-Z]+)", 1)
    return word(0), word(1)


def translated_queries(spark, d):
    """A query of the first two words of each title in the syntax of five providers."""
    a, b = _first_words()
    low = lambda c: ~F.lower(c).isin("", "and", "or", "not")
    rows = documents(spark, d).select("idx", a.alias("a"), b.alias("b")).where(low(F.col("a")) & low(F.col("b")))
    text = F.concat(F.lit('(title:"'), "a", F.lit('" OR abstract:'), "b", F.lit(") AND NOT author:"), "b")
    return rows.select("idx", *[dsl.translated(text, p).alias(p) for p in ("arxiv", "pubmed", "ieee", "openalex", "s2")])


def _plan(spark):
    return runs.selected(spark.createDataFrame([(q, " ".join(i) or "all", f"c{n % 2}") for n, (q, i, _) in enumerate(QUERIES_ROWS)], "query_id string, text string, category string"), providers=["openalex", "crossref", "arxiv", "pubmed", "s2", "core"], skip=["core"])


def search_plan(spark, d):
    return _plan(spark).select("query_id", "provider", "category")


def query_categories(spark, d):
    return runs.categories(_plan(spark))


def search_to_do(spark, d):
    """What is left to search if documents of odd years are the results there are."""
    todo, _ = runs.resumed(_plan(spark), documents(spark, d).where("year % 2 = 1 and cited_by_count > 450"))
    return todo.select("query_id", "provider")


def search_kept(spark, d):
    _, kept = runs.resumed(_plan(spark).where("query_id <> 'Q3'"), documents(spark, d))
    return runs.run_counts(_plan(spark), kept)


def collected_records(spark, d):
    """Of the records of one provider, query and title the first; of each query at most 40."""
    docs = documents(spark, d).withColumns({"provider_id": F.lit(None).cast("string"), "year": F.lit(None).cast("int")})
    return runs.collected(docs, 40).select("idx", "provider", "query_id")


def run_summary(spark, d):
    return runs.summary_lines(runs.run_counts(_plan(spark), documents(spark, d))).select("ord", "line")


def validation_findings(spark, d):
    odd = F.when(F.col("idx") % 12 == 0, F.concat(F.lit("x"), F.col("doi"))).otherwise(F.col("doi"))
    return reports.findings(documents(spark, d).withColumn("doi", odd))


def corpus_warnings(spark, d):
    return reports.corpus_warnings(documents(spark, d).withColumn("year", F.when(F.col("idx") == 1, 1850).when(F.col("idx") == 2, 2050).otherwise(F.col("year")))).select("level", "message")


def first_findings(spark, d):
    return reports.first_findings(reports.findings(documents(spark, d))).select("level", "message", F.col("place").cast("long").alias("place"), "all")


def corpus_counts(spark, d):
    return reports.value_counts(documents(spark, d))


def validation_report(spark, d):
    return reports.validation_report(documents(spark, d), "documents")


def share_outliers(spark, d):
    return reports.outliers(documents(spark, d).select("idx", (F.col("cited_by_count") / 4).alias("x")), "x")


def statistics_report(spark, d):
    tidy = reports.value_counts(documents(spark, d), ("provider", "language")).select(F.col("field").alias("section"), F.col("value").alias("name"), F.col("records").alias("value"))
    return reports.statistics_report(tidy)


def number_forms(spark, d):
    return documents(spark, d).select("idx", F.format_number("idx", 0).alias("number"), reports.duration(F.col("idx") * 7.1234567).alias("duration"), reports.percent(F.col("cited_by_count"), F.col("cited_by_count") + F.col("idx")).alias("percent"))


def to_recover(spark, d):
    docs = documents(spark, d).withColumns({"decision": F.when(F.col("idx") % 3 > 0, "exclude").otherwise("include"), "screening_reason": F.col("title")})
    return reports.recovered(docs, "The").select("idx")


def proxied_urls(spark, d):
    url = F.when(F.col("idx") % 5 == 0, F.concat(F.lit("https://a-b.proxy.net/"), F.col("idx").cast("string"))).otherwise(F.concat(F.lit("https://www.x.org/p?q="), F.col("idx").cast("string")))
    return documents(spark, d).select("idx", reports.proxied(url, ".proxy.net").alias("url"))


QUERIES = {f.__name__: f for f in (
    provider_openalex, provider_crossref, provider_s2, provider_doaj, provider_core, provider_ieee, provider_arxiv, provider_pubmed, identifiers, loose_dates, author_forms, translated_queries,
    search_plan, query_categories, search_to_do, search_kept, collected_records, run_summary, validation_findings, corpus_warnings, first_findings, corpus_counts, validation_report, share_outliers,
    statistics_report, number_forms, to_recover, proxied_urls,
)}

_FULL = "array_to_string(list_transform(authors, lambda a: coalesce(a.given_name || ' ', '') || a.family_name), '; ')"
_LAST = "array_to_string(list_transform(authors, lambda a: case when coalesce(a.given_name || ' ', '') || a.family_name = '' then '' else coalesce(a.given_name || ' ', '') || a.family_name end), '; ')"
_UNKNOWN = "array_to_string(list_transform(authors, lambda a: case when a.given_name is null and a.family_name = '' then 'Unknown' else trim(coalesce(a.given_name || ' ', '') || a.family_name) end), '; ')"
_SAFE = "regexp_replace(coalesce({}, ''), '[^A-Za-z0-9 .,-]', '', 'g')"
_NULLS = {c: f"null::varchar as {c}" for c in ("doi", "arxiv_id", "pubmed_id", "abstract", "venue", "url")} | {"cited_by_count": "null::int as cited_by_count"}


def _sql(provider: str, authors: str, where: str = "title <> ''", **columns: str) -> str:
    given = {"title": "title", "year": "year", "provider_id": "''", "authors": authors, **columns}
    names = ("title", "year", "provider_id", "doi", "arxiv_id", "pubmed_id", "abstract", "authors", "venue", "url", "cited_by_count")
    parts = [f"{given[c]} as {c}" if c in given else _NULLS[c] for c in names]
    return with_(BIB) + f"select '{provider}' as provider, {', '.join(parts)} from bib where {where}"


_SAME = {c: c for c in ("doi", "abstract", "venue", "url", "cited_by_count")}
_W = ["regexp_extract(title, '^(?:[^a-zA-Z]*[a-zA-Z]+){%d}[^a-zA-Z]*([a-zA-Z]+)', 1)" % n for n in (0, 1)]
_PLAN = "plan as (select query_id, provider, category from (values " + ", ".join(f"('{q}', 'c{n % 2}')" for n, (q, _, _) in enumerate(QUERIES_ROWS)) + ") q(query_id, category), (values ('openalex'), ('crossref'), ('arxiv'), ('pubmed'), ('s2')) p(provider))"
_N = "regexp_replace(({})::bigint::varchar, '(\\d)(?=(\\d{{3}})+$)', '\\1,', 'g')"
_ODD = "case when idx % 12 = 0 then 'x' || doi else doi end"
_FOUND = """found as (select 'error' as level, idx, 'Document ' || (idx + 1) || ': Missing title' as message from bib where title = '' union all select 'warning', idx, 'Document ' || (idx + 1) || ': Missing year' from bib where year is null
union all select 'warning', idx, 'Document ' || (idx + 1) || ': Invalid DOI format: ' || doi from bib where doi not like '10.%')"""
_WARNED = """warned as (select 'warning' as level, coalesce(sum(n), 0)::bigint || ' documents have duplicate titles (potential duplicates)' as message from (select count(*) as n from bib where title <> '' group by lower(trim(title)) having n > 1) having sum(n) > 0
union all select 'warning', 'Suspiciously old year detected: ' || min(year) from bib having min(year) < 1900 union all select 'warning', 'Future year detected: ' || max(year) from bib having max(year) > 2030)"""
_COUNTS = " union all ".join(f"select '{c}' as field, {c}::varchar as value, count(*) as records from bib where {c} is not null and {c}::varchar <> '' group by {c}" for c in ("provider", "year", "language"))
_SHARE = "'  ' || {name} || ': ' || {n} || ' (' || printf('%.1f', round(({v} * 100 / {t}::double)::decimal(30,12), 1)::double) || '%)'"
_COMMAS = "format('{{:,}}', {})"


def _line(name: str, v: str, t: str) -> str:
    return _SHARE.format(name=name, n=_COMMAS.format(v), v=v, t=t)


SQL = {
    "provider_openalex": _sql("openalex", _LAST, provider_id="'W' || idx", **{**_SAME, "url": "coalesce(url, 'https://openalex.org/W' || idx)"}, pubmed_id="idx::varchar") .replace("abstract as abstract", "left(array_to_string(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> ''), ' '), 5000) as abstract"),
    "provider_crossref": _sql("crossref", _FULL, **_SAME),
    "provider_s2": _sql("s2", _LAST, **_SAME, arxiv_id="arxiv_id", pubmed_id="idx::varchar"),
    "provider_doaj": _sql("doaj", _UNKNOWN, provider_id="provider_id", **{**_SAME, "cited_by_count": "null::int"}),
    "provider_core": _sql("core", _UNKNOWN, provider_id="idx::varchar", **{**_SAME, "url": "coalesce(url, 'https://core.ac.uk/works/' || idx)"}, arxiv_id="arxiv_id"),
    "provider_ieee": _sql("ieee", _UNKNOWN, provider_id="idx::varchar", **_SAME),
    "provider_arxiv": _sql("arxiv", _LAST, where="trim(title) <> ''", title="trim(regexp_replace(title, '\\s+', ' ', 'g'))", doi="doi", arxiv_id="'2301.' || idx", abstract="trim(regexp_replace(title || ' ' || venue, '\\s+', ' ', 'g'))", venue="case when idx % 2 = 0 then coalesce('arXiv (' || language || ')', 'arXiv') else 'arXiv' end", url="'http://arxiv.org/abs/2301.' || idx || 'v2'"),
    "provider_pubmed": _sql("pubmed", "array_to_string(list_transform(authors, lambda a: case when (idx % 2 = 1 and a.family_name = authors[1].family_name) or a.given_name is null then case when a.family_name = '' then 'Unknown' else a.family_name end else a.given_name || ' ' || case when a.family_name = '' then 'Unknown' else a.family_name end end), '; ')", where=f"{_SAFE.format('title')} <> ''", title=_SAFE.format("title"), provider_id="idx::varchar", doi="doi", pubmed_id="idx::varchar", venue=f"nullif({_SAFE.format('venue')}, '')", url="'https://pubmed.ncbi.nlm.nih.gov/' || idx || '/'"),
    "identifiers": with_(BIB) + """select idx, '2301.' || idx as arxiv, 'W' || idx as openalex, idx::varchar as pubmed, idx::varchar as ieee, case when doi is not null then 'https://doi.org/' || doi else url end as url, coalesce(doi, arxiv_id, left(sha256(title), 16)) as provider_id,
left(sha256(concat_ws('::', venue, title)), 16) as chunk, left(sha256(venue || ':p' || idx || ':t1'), 12) as "table" from bib""",
    "loose_dates": with_(BIB) + "select idx, case when idx % 6 <> 5 then strftime(date '2001-01-01' + (idx % 4000)::int, '%Y-%m-%d') end as day, year(date '2001-01-01' + (idx % 4000)::int)::int as medline, year is null or year between 2005 and 2012 as in_years from bib",
    "author_forms": with_(BIB) + f"""select idx, regexp_extract(n, '([^ ]*)$', 1) as family_name, nullif(regexp_extract(n, '^(.*) [^ ]*$', 1, 's'), '') as given_name, case when who = '' then '[' || idx || ']' when year is not null then trim(split_part(who, ',', 1)) || ' (' || year || ')' else trim(split_part(who, ',', 1)) end as short
from (select *, regexp_replace(split_part(title, '.', 1), '^\\s+|\\s+$', '', 'g') as n, {_FULL.replace("'; '", "', '")} as who from bib)""",
    "translated_queries": with_(BIB) + f"""select idx, '(ti:"' || a || '" OR abs:' || b || ') AND NOT au:' || b as arxiv, '("' || a || '"[Title] OR ' || b || '[Abstract]) AND NOT ' || b || '[Author]' as pubmed, '(article_title:"' || a || '" OR abstract:' || b || ') AND NOT author:' || b as ieee,
'(title:"' || a || '" OR abstract:' || b || ') AND NOT authorships.author.display_name:' || b as openalex, '(title:"' || a || '" | abstract:' || b || ') + -author:' || b as s2
from (select idx, {_W[0]} as a, {_W[1]} as b from bib) where lower(a) not in ('', 'and', 'or', 'not') and lower(b) not in ('', 'and', 'or', 'not')""",
    "search_plan": with_(_PLAN) + "select query_id, provider, category from plan",
    "query_categories": with_(_PLAN) + "select count(distinct category) as categories from plan",
    "search_to_do": with_(BIB, _PLAN) + "select query_id, provider from plan where not exists (select 1 from bib where bib.provider = plan.provider and bib.query_id = plan.query_id and year % 2 = 1 and cited_by_count > 450)",
    "search_kept": with_(BIB, _PLAN) + "select provider, query_id, coalesce(n, 0)::bigint as records from plan left join (select provider, query_id, count(*) as n from bib where query_id <> 'Q3' group by all) using (provider, query_id)",
    "collected_records": with_(BIB) + """select idx, provider, query_id from (select * from (select *, coalesce('d' || lower(doi), 't' || nullif(lower(title), '')) as name from bib) qualify name is null or row_number() over (partition by provider, query_id, name order by idx) = 1)
qualify row_number() over (partition by provider, query_id order by idx) <= 40""",
    "run_summary": with_(BIB, _PLAN, "per as (select provider, sum(coalesce(n, 0))::bigint as n from plan left join (select provider, query_id, count(*) as n from bib group by all) using (provider, query_id) group by provider)") + f"""select row_number() over (order by n desc, provider) as ord, '  ' || provider || ': ' || {_COMMAS.format('n')} || ' documents' as line from per
union all select 2147483648, 'Total: ' || {_COMMAS.format('sum(n)::bigint')} || ' documents' from per""",
    "validation_findings": with_(BIB.replace("bib as (", "bib0 as ("), f"bib as (select * exclude (doi), {_ODD} as doi from bib0)", _FOUND) + "select level, idx, message from found",
    "corpus_warnings": with_(BIB.replace("bib as (", "bib0 as ("), "bib as (select * exclude (year), case when idx = 1 then 1850 when idx = 2 then 2050 else year end as year from bib0)", _WARNED) + "select level, message from warned",
    "first_findings": with_(BIB, _FOUND) + 'select level, message, place, n as "all" from (select *, row_number() over (partition by level order by idx nulls last, message) as place, count(*) over (partition by level) as n from found) where place <= 10',
    "corpus_counts": with_(BIB) + f"select * from ({_COUNTS})",
    "validation_report": with_(BIB, _FOUND, _WARNED, "t as (select count(*) as t from bib)", f"c as ({_COUNTS})") + f"""select 1 as section, unnest([0, 1, 2, 3])::bigint as ord, unnest(['Validation Report', repeat('=', 70), 'Source: documents', 'Total documents: ' || {_COMMAS.format('t')}]) as line from t
union all select 2, o::bigint, {_line("'Documents with ' || name", 'n', 't')} from t, (select 0 as o, 'DOI' as name, count(doi) as n from bib union all select 1, 'abstract', count(*) filter (abstract <> '') from bib union all select 2, 'arXiv ID', count(arxiv_id) from bib)
union all select 3, row_number() over (order by records desc, value), {_line('value', 'records', 't')} from c, t where field = 'provider' union all select 4, row_number() over (order by value::int), {_line('value', 'records', 't')} from c, t where field = 'year'
union all select 5, case level when 'error' then 0 else 1 end, '  ' || case level when 'error' then 'Errors: ' else 'Warnings: ' end || count(*) from (select level from found union all select level from warned) group by level""",
    "share_outliers": with_(BIB) + "select idx, cited_by_count / 4::double as x from bib where cited_by_count / 4::double > 100 order by idx limit 20",
    "statistics_report": with_(BIB, f"c as (select field as section, value as name, records as value from ({_COUNTS}) where field <> 'year')") + """select section, row_number() over (partition by section order by name) as n, '| ' || name || ' | ' || value || ' |' as line from c
union all select section, unnest([-2, -1, 0])::bigint, unnest(['## ' || section, '| name | value |', '|---|---|']) from (select distinct section from c)""",
    "number_forms": with_(BIB) + f"""select idx, {_COMMAS.format('idx')} as number, case when s < 60 then printf('%.1f', s) || 's' when s < 3600 then printf('%.1f', s / 60) || 'm' else printf('%.1f', s / 3600) || 'h' end as duration,
case when cited_by_count + idx > 0 then printf('%.1f', round((cited_by_count * 100 / (cited_by_count + idx)::double)::decimal(30,12), 1)::double) || '%' else '0.0%' end as percent from (select *, idx * 7.1234567::double as s from bib)""",
    "to_recover": with_(BIB) + "select idx from bib where idx % 3 > 0 and contains(lower(title), 'the')",
    "proxied_urls": with_(BIB) + "select idx, case when idx % 5 = 0 then 'https://a-b.proxy.net/' || idx else 'https://www-x-org.proxy.net/p?q=' || idx end as url from bib",
}

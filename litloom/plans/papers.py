"""Queries of the full-text operators over all rows of the driver's tables.

Pages, tables, boxes and references are made from the columns of documents and events, in the
form that a parser gives them; every row of the table takes part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.functions import citations, numbers, people, sections
from litloom.functions.dates import medline_year
from litloom.operators import extraction, fulltext, ranking, screening, structure
from litloom.plans.bib import BIB, documents, with_
from litloom.plans.corpus import _CLUSTERED, JOURNALS, _exact
from litloom.sinks import exports


def _cited(spark, d):
    """Texts with citations by number and by author, made from each row's number."""
    n = lambda k: (F.col("idx") % k + 1).cast("string")
    text = F.concat(F.lit("As ["), n(7), F.lit("] and ["), n(5), F.lit(", "), n(11), F.lit("], but not [1-2,9]; ranges ["), n(3), F.lit("-"), (F.col("idx") % 3 + 3).cast("string"), F.lit("] (Doe et al., "), (F.col("idx") % 40 + 1990).cast("string"), F.lit(") (see Figure 1, 2020)."))
    return documents(spark, d).select("idx", (F.col("idx") % 50).cast("string").alias("source_file"), text.alias("text"))


def cited_numbers(spark, d):
    return _cited(spark, d).select("idx", F.array_join(citations.citation_numbers(F.col("text")).cast("array<string>"), ",").alias("numbers"))


def cited_authors(spark, d):
    return _cited(spark, d).select("idx", F.array_join(citations.author_date_citations(F.col("text")), "; ").alias("found"))


def _library(spark, d):
    """A list of references for each record: one over two lines, and a number that comes again."""
    n = F.col("idx").cast("string")
    text = F.concat(F.lit("before\n[1] Old, C. (1990). \"Gone\".\n[2] Author "), n, F.lit(", B. ("), (F.col("idx") % 60 + 1960).cast("string"), F.lit(').\n "T'), n, F.lit('". doi: 10.1/'), n, F.lit(".\n\n1. Another "), n, F.lit(", no bracket 2003"))
    return documents(spark, d).select(n.alias("source_file"), text.alias("text"))


def references_read(spark, d):
    return structure.reference_library(_library(spark, d)).select("source_file", "number", "authors", "title", "year", "doi")


def citations_linked(spark, d):
    """Citations by number against a library that has the even numbers."""
    cited = _cited(spark, d).withColumn("id", F.col("idx").cast("string"))
    library = cited.select("source_file").distinct().select("source_file", F.explode(F.sequence(F.lit(2), F.lit(10), F.lit(2))).alias("number"))
    library = library.select("source_file", "number", F.concat(F.lit("A"), F.col("number").cast("string")).alias("authors"), F.lit("t").alias("title"), F.lit(2001).alias("year"))
    return fulltext.citations(cited, library).select("id", "number", "short", "type")


def _tables(spark, d):
    """Tables of twenty pages a file: captions, headers and rows by turns, some going on from the page before."""
    n = F.col("idx")
    caption = F.when(n % 4 == 0, F.concat(F.lit("Table "), (n / 4).cast("long").cast("string"))).when(n % 8 == 1, F.lit("(continued)")).when(n % 8 == 6, F.concat(F.lit("Table "), n.cast("string"), F.lit(" continued")))
    kind = F.when(n % 4 < 3, (n / 4).cast("long")).otherwise(n)
    headers = F.when(n % 8 == 5, F.array().cast("array<string>")).otherwise(F.array(F.substring(F.md5(kind.cast("string")), 1, 12), F.lit("value")))
    rows = F.array(F.when(n % 8 == 2, headers).otherwise(F.array(n.cast("string"), F.lit("x"))), F.array(n.cast("string"), F.lit("y")))
    return documents(spark, d).select((n / 20).cast("long").cast("string").alias("source_file"), (n % 20 + 1).cast("int").alias("page_number"), n.cast("string").alias("table_id"), headers.alias("headers"), rows.alias("rows"), caption.alias("caption"))


def tables_continued(spark, d):
    t = structure.merge_continuations(_tables(spark, d))
    return t.select("source_file", "table_id", "page_number", "last_page", F.array_join("headers", ";").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ";")), "/").alias("rows"), "caption")


def tables_chosen(spark, d):
    """Of each page the tables from Markdown if they have more cells."""
    t = _tables(spark, d).where(F.size("headers") > 0)
    other = t.where("cast(table_id as long) % 3 < 2").withColumns({"table_id": F.concat(F.lit("m"), "table_id"), "rows": F.when(F.col("table_id").cast("long") % 3 == 0, F.concat("rows", "rows")).otherwise(F.slice("rows", 1, 1))})
    return fulltext.better_tables(t, other).select("source_file", "page_number", "table_id")


def _barred(spark, d):
    """The title's words as Markdown tables of two columns, with text between."""
    rows = lambda k: F.array_join(F.transform(F.sequence(F.lit(0), F.col("idx") % k), lambda i: F.concat(F.lit("| r"), i.cast("string"), F.lit(" |  "), F.col("idx").cast("string"), F.lit("  x |"))), "\n")
    text = F.concat(F.lit("text\n| A | B |\n|---|:-:|\n"), rows(3), F.when(F.col("idx") % 2 == 0, F.concat(F.lit("\nmore\n\n| C | D |\n"), rows(2))).otherwise("\nend"))
    return documents(spark, d).select(F.col("idx").cast("string").alias("source_file"), F.lit(1).alias("page_number"), text.alias("text"))


def tables_read(spark, d):
    t = fulltext.markdown_tables(_barred(spark, d))
    return t.select("source_file", F.array_join("headers", ";").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ";")), "/").alias("rows"))


def tables_rendered(spark, d):
    t = _tables(spark, d)
    return t.select("table_id", F.md5(structure.as_markdown(F.col("headers"), F.col("rows"))).alias("markdown_md5"), structure.table_number(F.col("caption")).alias("number"))


def tables_as_csv(spark, d):
    t = _tables(spark, d).withColumn("rows", F.transform("rows", lambda r: F.concat(r, F.array(F.concat(F.lit('say "'), "table_id", F.lit('", so'))))))
    return t.select("table_id", F.md5(structure.as_csv(F.col("headers"), F.col("rows"))).alias("csv_md5"))


def table_chunks(spark, d):
    return structure.tables_as_chunks(_tables(spark, d)).select("id", F.md5("text").alias("text_md5"), "row_count", "col_count")


def prompt_plans(spark, d):
    n = F.col("idx")
    return structure.prompt_plan(documents(spark, d).select(F.col("provider").alias("group_id"), (n / 30).cast("long").alias("batch"), (n / 3).cast("long").cast("string").alias("paper_id"), (n % 11).alias("tokens"), ((n / 30).cast("long") * 7 + 100).alias("prompt_tokens")))


def authors_mixed(spark, d):
    """Plain names and objects in one list, some with an ORCID."""
    n = F.col("idx").cast("string")
    raw = F.concat(F.lit('["Doe'), n, F.lit(', Jo", {"name": "Ann Lee'), n, F.lit('", "orcid": "'), n, F.lit('"}, {"x": 1}]'))
    a = people.parse_authors(F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>"))
    return documents(spark, d).select("idx", F.array_join(F.transform(a, lambda x: F.concat_ws("/", x["family_name"], F.coalesce(x["given_name"], F.lit("-")), F.coalesce(x["orcid"], F.lit("-")))), ";").alias("authors"))


def table_shapes(spark, d):
    """Empty columns and rows dropped, cut captions merged, sparse tables told."""
    n = F.col("idx")
    blank = lambda k: F.when(n % k == 0, "").otherwise(n.cast("string"))
    headers, rows = F.array(blank(2), F.lit("")), F.array(F.array(blank(2), blank(3)), F.array(F.lit(""), F.lit(" ")))
    h, r = structure.without_empty(headers, rows)
    merged = structure.merge_headers(F.when(n % 4 == 0, F.array(F.concat(F.lit("Table "), n.cast("string"), F.lit(".")), F.lit("Sizes"), F.lit("of maps"))).otherwise(F.array(F.lit("a"), F.lit("b"))))
    big = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.array(F.when(i <= n % 6, "x").otherwise(""), F.lit("")))
    return documents(spark, d).select("idx", F.array_join(h, ";").alias("headers"), F.array_join(F.transform(r, lambda x: F.array_join(x, ";")), "/").alias("rows"), F.array_join(merged, ";").alias("merged"), structure.is_sparse(big, F.lit(2)).alias("sparse"))


def captions_found(spark, d):
    n = F.col("idx")
    above = F.when(n % 3 == 0, F.concat(F.lit("words\n TABLE "), n.cast("string"), F.lit(": Sizes"))).when(n % 3 == 1, F.lit("text\ntable of things"))
    below = F.when(n % 2 == 0, F.concat(F.lit("Tab. "), n.cast("string"), F.lit(". Below\nTable x")))
    return documents(spark, d).select("idx", fulltext.caption(above, below).alias("caption"))


def math_told(spark, d):
    n = F.col("idx")
    text = F.element_at(F.array(F.lit("Journal of Things"), F.lit("x = y"), F.lit("α and β"), F.concat(F.lit("page "), n.cast("string")), F.lit(""), F.col("title")), (n % 6 + 1).cast("int"))
    latex = F.element_at(F.array(F.lit("\\frac{a}{b}"), F.lit("\\mathrm{A}\\mathrm{B}"), F.concat(F.lit("x + "), n.cast("string")), F.lit("plain words"), F.lit("x"), F.lit("\\alpha \\beta")), (n % 6 + 1).cast("int"))
    return documents(spark, d).select("idx", fulltext.math_text(text).alias("math"), fulltext.latex_math(latex).alias("latex"))


def page_kinds(spark, d):
    """Which texts need recognition, and which look like tables."""
    return documents(spark, d).select("idx", structure.needs_ocr(F.coalesce("abstract", F.lit(""))).alias("ocr"), structure.looks_tabular(F.concat(F.when(F.col("idx") % 9 == 0, F.lit("x\nTable 3 of\n")).otherwise(""), F.coalesce("abstract", F.lit("")))).alias("tabular"))


def images_kept(spark, d):
    n = F.col("idx")
    text = F.concat(F.lit("![a](x/p"), (n % 5).cast("string"), F.lit(".png)\nline\n![b](q"), (n % 3).cast("string"), F.lit(".png)"))
    return documents(spark, d).select(
        "idx", structure.usable_image(F.col("cited_by_count") * 100, (n % 900), F.lit(400)).alias("usable"), F.array_join(sections.image_names(text), ",").alias("names"),
        F.array_join(F.split(structure.drop_image_lines(text, F.array(F.lit("p1.png"), F.lit("q2.png"))), "\n"), ";").alias("text"),
    )


def headings_read(spark, d):
    line = F.concat(F.repeat(F.lit("#"), (F.col("idx") % 8).cast("int")), F.lit(" "), F.col("title"))
    tags = sections.section_tags(F.element_at(F.array(F.lit("2 Materials and Methods"), F.lit("Results and Discussion"), F.lit("Thanks"), F.lit("Conclusions"), F.lit("A model")), (F.col("idx") % 5 + 1).cast("int")), F.when(F.col("idx") % 3 == 0, "Paper > Introduction"))
    return documents(spark, d).select("idx", sections.header_level(line).alias("level"), sections.header_title(line).alias("title"), F.array_join(tags, ",").alias("tags"), sections.section_role(tags).alias("role"))


def _boxes(spark, d):
    """Boxes of four kinds on thirty pages a file: stamps in one place, and others far apart."""
    n = F.col("event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select(n, (n / 120).cast("long").cast("string").alias("source_file"), (n % 30 + 1).cast("int").alias("page_number"), (n % 4).alias("k"))
    x0 = F.when(F.col("k") == 0, F.lit(10.0)).otherwise((F.col("event_id") * 37 % 4000).cast("double"))
    y0 = (F.col("k") * 100 + 20).cast("double")
    return e.select("source_file", "page_number", x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), (y0 + 30).alias("y1"))


def boxes_without_stamps(spark, d):
    return structure.without_stamps(_boxes(spark, d))


def boxes_outside_images(spark, d):
    b = _boxes(spark, d)
    images = b.where("x0 > 2000").select("source_file", "page_number", (F.col("x0") + 30).alias("x0"), F.lit(0.0).alias("y0"), (F.col("x0") + 500).alias("x1"), F.lit(300.0).alias("y1"))
    return structure.outside_images(b, images)


def boxes_merged(spark, d):
    """Boxes of a cell, three near each other, and cells far apart, become one."""
    n = F.col("event_id")
    at = (n % 9 * 1000).cast("double")
    b = spark.read.parquet(f"{d}/events.parquet").select((n / 600).cast("long").cast("string").alias("source_file"), (n % 5 + 1).cast("int").alias("page_number"), (at + n % 17).alias("x0"), (at + n % 7).alias("y0"), (at + 50 + n % 13).alias("x1"), (at + 40 + n % 11).alias("y1"))
    return structure.merge_boxes(b)


def boxes_plausible(spark, d):
    return _boxes(spark, d).select("source_file", "page_number", "x0", "y0", structure.plausible_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(2500.0), F.lit(400.0)).alias("ok"))


def table_strategies(spark, d):
    n = F.col("event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select((n / 50).cast("long").cast("string").alias("source_file"), (n % 10 + 1).cast("int").alias("page_number"), F.element_at(F.array(F.lit("lines"), F.lit("text")), (n % 2 + 1).cast("int")).alias("strategy"), (n % 2).cast("int").alias("ord"), (n % 19 + 1).alias("cells"), (n % 7 % (n % 19 + 1)).alias("filled"))
    return structure.best_strategy(e).select("source_file", "page_number", "strategy")


def chunks_attached(spark, d):
    chunks = documents(spark, d).select(F.col("idx").cast("string").alias("id"), (F.col("idx") % 40).cast("string").alias("source_file"), (F.col("idx") % 7).cast("int").alias("page_number"))
    parts = documents(spark, d).where("idx % 5 = 0").select((F.col("idx") % 40).cast("string").alias("source_file"), (F.col("idx") % 7).cast("int").alias("page_number"), F.col("idx").cast("string").alias("name"))
    out = structure.attach(chunks, parts, "parts")
    return out.select("id", F.coalesce(F.size("parts"), F.lit(0)).alias("n"), F.array_join(F.transform("parts", lambda x: x["name"]), ",").alias("names"))


def paper_counts(spark, d):
    """Counts of each paper from its pages, chunks, library and tables."""
    docs = documents(spark, d).select("idx", F.col("venue").alias("source_file"))
    pages = docs.withColumn("is_references", F.col("idx") % 4 == 0)
    chunks = docs.select("source_file", F.concat(F.lit("["), (F.col("idx") % 6).cast("string"), F.lit("] ["), (F.col("idx") % 9).cast("string"), F.lit("]")).alias("text"), F.when(F.col("idx") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("images"))
    return fulltext.document_counts(pages, chunks, docs.where("idx % 5 = 0"), docs.where("idx % 7 = 0"))


def papers_unanalysed(spark, d):
    papers = documents(spark, d).select(F.col("idx").cast("string").alias("paper_id"))
    done = documents(spark, d).where("idx % 3 = 0").select(F.col("idx").cast("string").alias("paper_id"), F.when(F.col("idx") % 2 == 0, "failed").alias("error"))
    return fulltext.unanalysed(papers, done)


def _results(spark, d):
    n = F.col("idx")
    facts = F.when(n % 3 > 0, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).otherwise(F.create_map(F.lit("a"), F.lit("1")))
    return documents(spark, d).select((n / 2).cast("long").cast("string").alias("paper_id"), F.element_at(F.array(F.lit("g0"), F.lit("g1")), (n % 2 + 1).cast("int")).alias("group_id"), facts.alias("facts"), F.when(n % 10 == 0, "failed").alias("error"))


def papers_unfinished(spark, d):
    papers = documents(spark, d).select((F.col("idx") / 2).cast("long").cast("string").alias("paper_id")).distinct()
    return extraction.unfinished(papers, _results(spark, d), ["g0", "g1"])


def facts_by_group(spark, d):
    return extraction.group_coverage(_results(spark, d))


def downloads_by_status(spark, d):
    return extraction.retrieval_stats(documents(spark, d).select(F.when(F.col("idx") % 4 == 0, "failed").when(F.col("doi").isNull(), "skipped").otherwise("fetched").alias("status")))


def batched_prompts(spark, d):
    """Excerpts of each paper in order, papers of a batch in one prompt."""
    n = F.col("idx")
    rows = documents(spark, d).select(F.col("provider").alias("group_id"), (n / 20).cast("long").alias("batch"), (n / 10).cast("long").cast("string").alias("paper_id"), n.alias("ord"), F.col("title").alias("text"))
    return extraction.batch_prompts(rows).select("group_id", "batch", F.array_join("papers", ",").alias("papers"), F.md5("prompt").alias("prompt_md5"))


def recovered_decisions(spark, d):
    docs = documents(spark, d)
    first = docs.select("idx", "title", F.when(F.col("idx") % 2 == 0, "exclude").otherwise("include").alias("decision"), F.lit("first").alias("screening_reason"))
    again = docs.where("idx % 6 = 0").select("idx", F.concat(F.lit("  "), "title").alias("title"), F.lit("include").alias("decision"), F.col("idx").cast("string").alias("screening_reason"))
    return screening.with_recovery(first, again).select("idx", "decision", "screening_reason")


def tokens_and_tasks(spark, d):
    raw = F.element_at(F.array(F.lit("Object  Detection "), F.lit("classification task"), F.lit("Segmentation")), (F.col("idx") % 3 + 1).cast("int"))
    return documents(spark, d).select("idx", numbers.token_estimate(F.coalesce("abstract", F.lit(""))).alias("tokens"), numbers.task_type(raw).alias("task"), medline_year(F.concat(F.lit("x"), F.col("year").cast("string"))).alias("year"))


def clusters_nested(spark, d):
    out = exports.cluster_documents(_exact(spark, d), ["provider_id"])
    return out.select("cluster_id", "size", F.array_join(F.transform("members", lambda m: m["provider_id"]), ",").alias("members"))


def clusters_flat(spark, d):
    """All records with the columns of their cluster."""
    return exports.csv_clusters(_exact(spark, d), "all").select("provider_id", "cluster_id", "author_count", *exports.CLUSTER_COLUMNS)


def records_as_json(spark, d):
    rows = exports.json_rows(documents(spark, d).select("idx", "title", "year", "venue", "authors"))
    at = lambda p: F.get_json_object("entry", p)
    return rows.select(at("$.idx").cast("long").alias("idx"), at("$.title").alias("title"), at("$.year").cast("int").alias("year"), at("$.authors[1].family_name").alias("second"), (F.instr("entry", '"year":null') > 0).alias("null_kept"))


def q1_fuzzy_venues(spark, d):
    return ranking.rank_venues(documents(spark, d), JOURNALS).select("idx", "matched")


def q1_leading_summary(spark, d):
    """Venues against the built-in list of leading journals, made from its names by turns."""
    docs = documents(spark, d).withColumn("venue", F.element_at(F.array(F.lit("plant disease"), F.lit("Sensors (MDPI)"), F.lit("IEEE access"), F.lit("Journal of Nothing at all"), F.lit("")), (F.col("idx") % 5 + 1).cast("int")))
    return ranking.rank_venues(docs, fuzzy=False).select("idx", "matched", "is_q1")


QUERIES = {f.__name__: f for f in (
    cited_numbers, cited_authors, references_read, citations_linked, tables_continued, tables_chosen, tables_read, tables_rendered, tables_as_csv, table_chunks, prompt_plans, authors_mixed, table_shapes, captions_found, math_told, page_kinds, images_kept, headings_read,
    boxes_without_stamps, boxes_outside_images, boxes_merged, boxes_plausible, table_strategies, chunks_attached, paper_counts, papers_unanalysed, papers_unfinished, facts_by_group, downloads_by_status,
    batched_prompts, recovered_decisions, tokens_and_tasks, clusters_nested, clusters_flat, records_as_json, q1_fuzzy_venues, q1_leading_summary,
)}

_CITED = """cited as (select idx, (idx % 50)::varchar as source_file, 'As [' || (idx % 7 + 1) || '] and [' || (idx % 5 + 1) || ', ' || (idx % 11 + 1) || '], but not [1-2,9]; ranges [' || (idx % 3 + 1) || '-' || (idx % 3 + 3) || '] (Doe et al., ' || (idx % 40 + 1990) || ') (see Figure 1, 2020).' as text from bib),
brackets as (select idx, source_file, unnest(regexp_extract_all(text, '\\[(\\d+(?:[,\\-]\\s*\\d+)*)\\]', 1)) as b from cited),
single as (select idx, source_file, trim(unnest(string_split(b, ',')))::int as n from brackets where not contains(b, '-')
union select idx, source_file, unnest(range(split_part(b, '-', 1)::int, split_part(b, '-', 2)::int + 1))::int from brackets where contains(b, '-') and not contains(b, ','))"""
_LISTED = """entries as (select idx::varchar as source_file, 2 as number, 'Author ' || idx || ', B.' as authors, 'T' || idx as title, (idx % 60 + 1960)::int as year, '10.1/' || idx as doi from bib
union all select idx::varchar, 1, 'Another ' || idx || ', no bracket', null, 2003, null from bib)"""
_T = """t as (select (idx // 20)::varchar as source_file, (idx % 20 + 1)::int as page, idx::varchar as table_id, idx, case when idx % 4 = 0 then 'Table ' || (idx // 4) when idx % 8 = 1 then '(continued)' when idx % 8 = 6 then 'Table ' || idx || ' continued' end as caption,
case when idx % 8 = 5 then []::varchar[] else [left(md5((case when idx % 4 < 3 then idx // 4 else idx end)::varchar), 12), 'value'] end as headers from bib),
body as (select *, [case when idx % 8 = 2 then headers else [idx::varchar, 'x'] end, [idx::varchar, 'y']] as rows from t)"""
_ORDER = "over (partition by source_file order by page, table_id)"
_GROUPED = f"""seen as (select *, nullif(lower(regexp_extract(caption, 'Table\\s+([IVXivx]+|\\d+)', 1)), '') as own, coalesce(page = lag(page) {_ORDER} + 1, false) as nxt from body),
runs as (select *, sum((not nxt)::int) {_ORDER} as u from seen),
known as (select *, last_value(own ignore nulls) over (partition by source_file, u order by page, table_id rows between unbounded preceding and 1 preceding) as number,
last_value(case when len(headers) > 0 then headers end ignore nulls) over (partition by source_file, u order by page, table_id rows between unbounded preceding and 1 preceding) as before from runs),
told as (select *, nxt and not coalesce(own <> number, false) and (contains(lower(coalesce(caption, '')), 'continued') or (own is not null and number is not null) or (coalesce(caption, '') = '' and len(headers) > 0 and coalesce(headers = before, false))) as goes from known),
parts as (select *, sum((not goes)::int) {_ORDER} as part, case when goes and coalesce(rows[1] = before, false) then rows[2:] else rows end as kept from told)"""
_MD = "case when len(headers) > 0 then '| ' || array_to_string(headers, ' | ') || ' |' || chr(10) else '' end || '| --- | --- |' || chr(10) || array_to_string(list_transform(rows, lambda r: case when len(r) = 0 then '|  |  |' else '| ' || array_to_string(r, ' | ') || ' |' end), chr(10))"
_ROWS = "array_to_string(list_transform(rows, lambda r, i: 'Row ' || i || ': ' || array_to_string(list_transform(r, lambda c, j: coalesce(headers[j], 'Col' || j) || ': ' || c), ', ')), chr(10))"
_ROWTEXT = "array_to_string(list_transform({}, lambda r: array_to_string(r, ';')), '/')"
_BOX = """b as (select (event_id // 120)::varchar as source_file, (event_id % 30 + 1)::int as page_number, case when event_id % 4 = 0 then 10.0::double else (event_id * 37 % 4000)::double end as x0, (event_id % 4 * 100 + 20)::double as y0 from events),
boxes as (select source_file, page_number, x0, y0, x0 + 40 as x1, y0 + 30 as y1 from b)"""
_KEYED = "keyed as (select *, round_even(x0 / 10, 0) as a, round_even(y0 / 10, 0) as b, round_even(x1 / 10, 0) as c, round_even(y1 / 10, 0) as e from boxes)"
_PICK = lambda *xs: f"([{', '.join(xs)}])[idx % {len(xs)} + 1]"
_WHOLE = "coalesce(abstract, '')"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_TAGTEXT = "lower(" + _PICK("'2 Materials and Methods'", "'Results and Discussion'", "'Thanks'", "'Conclusions'", "'A model'") + " || ' ' || case when idx % 3 = 0 then 'Paper > Introduction' else '' end)"
_SECTIONS = ", ".join(f"case when regexp_matches(x, '\\b(?:{'|'.join(w)})\\b') then '{tag}' end" for tag, w in sections.SECTIONS.items())
_RESULTS = "results as (select (idx // 2)::varchar as paper_id, 'g' || (idx % 2) as group_id, case when idx % 3 > 0 then 2 else 1 end as facts, case when idx % 10 = 0 then 'failed' end as error from bib)"

SQL = {
    "cited_numbers": with_(BIB, _CITED) + "select idx, string_agg(n, ',' order by n) as numbers from (select distinct idx, n from single) group by idx",
    "cited_authors": with_(BIB, _CITED) + "select idx, array_to_string(list_transform(list_filter(regexp_extract_all(text, '\\([A-Za-z\\s.,]+?\\s*,?\\s*(?:19|20)\\d{2}\\)'), lambda x: not regexp_matches(lower(x), 'fig|table|eq|section|chapter|page')), lambda x: replace(replace(x, '(', ''), ')', '')), '; ') as found from cited",
    "references_read": with_(BIB, _LISTED) + "select * from entries",
    "citations_linked": with_(BIB, _CITED) + "select distinct idx::varchar as id, n as number, 'A' || n || ' (2001)' as short, 'exact_number' as type from single where n % 2 = 0 and n between 2 and 10",
    "tables_continued": with_(BIB, _T, _GROUPED) + f"""select source_file, arg_min(table_id, page) as table_id, min(page) as page_number, max(page) as last_page, array_to_string(coalesce(arg_min(headers, page) filter (len(headers) > 0), []), ';') as headers,
string_agg({_ROWTEXT.format('kept')}, '/' order by page) as rows, arg_min(caption, page) filter (caption is not null) as caption from parts group by source_file, part""",
    "tables_chosen": with_(BIB, _T) + """select source_file, page as page_number, case when idx % 3 = 0 then 'm' || table_id else table_id end as table_id from body where len(headers) > 0""",
    "tables_read": with_(BIB) + """select idx::varchar as source_file, h as headers, array_to_string(list_transform(range(0, k), lambda i: 'r' || i || ';' || idx || ' x'), '/') as rows from (select idx, 'A;B' as h, idx % 3 + 1 as k from bib union all select idx, 'C;D', idx % 2 + 1 from bib where idx % 2 = 0)""",
    "tables_as_csv": with_(BIB, _T) + """select table_id, md5(case when len(headers) > 0 then array_to_string(headers, ',') || chr(13) || chr(10) else '' end || array_to_string(list_transform(rows, lambda r: array_to_string(r || ['"say ""' || table_id || '"", so"'], ',') || chr(13) || chr(10)), '')) as csv_md5 from body""",
    "table_chunks": with_(BIB, _T) + f"""select 'table_' || table_id as id, md5(coalesce('Table: ' || caption, 'Table on Page ' || page) || chr(10) || case when len(headers) > 0 then 'Headers: ' || array_to_string(headers, ', ') || chr(10) else '' end || {_ROWS} || chr(10) || chr(10) || 'Markdown representation:' || chr(10) || coalesce('**' || caption || '**' || chr(10) || chr(10), '') || {_MD}) as text_md5, 2 as row_count, 2 as col_count from body""",
    "prompt_plans": with_(BIB) + "select group_id, count(*) as batches, sum(p)::bigint as prompt_tokens, sum(e)::bigint as excerpt_tokens, max(papers) as papers, (sum(p) // count(*))::bigint as mean_prompt from (select provider as group_id, idx // 30 as batch, (idx // 30) * 7 + 100 as p, sum(idx % 11) as e from bib group by provider, idx // 30) join (select provider as group_id, count(distinct idx // 3) as papers from bib group by provider) using (group_id) group by group_id",
    "authors_mixed": with_(BIB) + "select idx, 'Doe' || idx || '/Jo/-;Lee' || idx || '/Ann/' || idx || ';Unknown/-/-' as authors from bib",
    "tables_rendered": with_(BIB, _T) + f"""select table_id, md5({_MD}) as markdown_md5,
nullif(lower(regexp_extract(caption, 'Table\\s+(\\d+)', 1)), '') as number from body""",
    "table_shapes": with_(BIB) + """select idx, array_to_string(list_filter([case when idx % 2 <> 0 then idx::varchar end, case when idx % 3 <> 0 then '' end], lambda x: x is not null), ';') as headers,
array_to_string(list_filter([case when idx % 2 <> 0 then idx::varchar end, case when idx % 3 <> 0 then idx::varchar end], lambda x: x is not null), ';') as rows, case when idx % 4 = 0 then 'Sizes of maps' else 'a;b' end as merged, (24 - idx % 6) / 24::double > 0.8 as sparse from bib""",
    "captions_found": with_(BIB) + "select idx, case when idx % 3 = 0 then 'TABLE ' || idx || ': Sizes' when idx % 3 = 1 then 'table of things' when idx % 2 = 0 then 'Tab. ' || idx || '. Below' else '' end as caption from bib",
    "math_told": with_(BIB) + f"""select idx, x <> '' and regexp_matches(x, '[=<>±+\\-×*/^_]|[∑∏∫√≈≤≥]|[α-ω]|\\d') as math, case idx % 6 when 0 then false when 1 then false when 2 then true when 3 then false when 4 then false when 5 then false end as latex
from (select idx, {_PICK("'Journal of Things'", "'x = y'", "'α and β'", "'page ' || idx", "''", "title")} as x from bib)""",
    "page_kinds": with_(BIB) + f"""select idx, length({_STRIP.format(_WHOLE)}) < 200 as ocr, regexp_matches(x, '(^|\\n)\\s*[^0-9A-Za-z_]*table\\s+(\\d+|[ivx]+)', 'i') or coalesce(length(regexp_replace(x, '\\s', '', 'g')) > 100 and length(regexp_replace(x, '[^0-9]', '', 'g')) / length(regexp_replace(x, '\\s', '', 'g'))::double > 0.10, false) as tabular
from (select *, case when idx % 9 = 0 then 'x' || chr(10) || 'Table 3 of' || chr(10) else '' end || {_WHOLE} as x from bib)""",
    "images_kept": with_(BIB) + """select idx, cited_by_count * 100 >= 5120 and idx % 900 >= 200 and (idx % 900) / 400::double between 0.2 and 5 as usable, 'p' || (idx % 5) || '.png,q' || (idx % 3) || '.png' as names,
array_to_string(list_filter([case when idx % 5 <> 1 then '![a](x/p' || (idx % 5) || '.png)' end, 'line', case when idx % 3 <> 2 then '![b](q' || (idx % 3) || '.png)' end], lambda x: x is not null), ';') as text from bib""",
    "headings_read": with_(BIB) + f"""select idx, case when idx % 8 between 1 and 6 and title <> '' and regexp_matches(title, '\\S|..') then (idx % 8)::int else 0 end as level, case when idx % 8 between 1 and 6 and title <> '' then regexp_replace(title, '^\\s+', '') else '' end as title, array_to_string(tags, ',') as tags, tags[1] as role
from (select *, list_filter([{_SECTIONS}], lambda s: s is not null) as tags from (select idx, title, {_TAGTEXT} as x from bib))""",
    "boxes_without_stamps": f"with {_BOX}, {_KEYED} select source_file, page_number, x0, y0, x1, y1 from keyed where (source_file, a, b, c, e) not in (select source_file, a, b, c, e from keyed group by all having count(distinct page_number) >= 3)",
    "boxes_outside_images": f"with {_BOX} select * from boxes b where not exists (select 1 from (select source_file, page_number, x0 + 30 as ix0, 0 as iy0, x0 + 500 as ix1, 300 as iy1 from boxes where x0 > 2000) i where i.source_file = b.source_file and i.page_number = b.page_number and not (x1 < ix0 or x0 > ix1 or y1 < iy0 or y0 > iy1))",
    "boxes_merged": "select min(cell + event_id % 17) as x0, min(cell + event_id % 7) as y0, max(cell + 50 + event_id % 13) as x1, max(cell + 40 + event_id % 11) as y1, source_file, page_number from (select *, (event_id // 600)::varchar as source_file, (event_id % 5 + 1)::int as page_number, (event_id % 9 * 1000)::double as cell from events) group by source_file, page_number, cell",
    "boxes_plausible": f"with {_BOX} select source_file, page_number, x0, y0, y0 >= 32 and y1 <= 368 and x0 >= 125 and x1 <= 2375 as ok from boxes",
    "table_strategies": """select source_file, page_number, arg_max(strategy, struct_pack(s := score, o := -ord)) as strategy from (select (event_id // 50)::varchar as source_file, (event_id % 10 + 1)::int as page_number, (['lines', 'text'])[event_id % 2 + 1] as strategy, event_id % 2 as ord,
sum((event_id % 19 + 1) * ((event_id % 7 % (event_id % 19 + 1)) / (event_id % 19 + 1)::double) * ((event_id % 7 % (event_id % 19 + 1)) / (event_id % 19 + 1)::double)) as score from events group by all) group by 1, 2""",
    "chunks_attached": with_(BIB, "p as (select idx % 40 as f, idx % 7 as p, count(*) as n, string_agg(idx::varchar, ',' order by idx::varchar) as names from bib where idx % 5 = 0 group by all)") + "select idx::varchar as id, coalesce(n, 0)::int as n, names from bib left join p on f = idx % 40 and p = idx % 7",
    "paper_counts": with_(BIB, "c as (select venue, count(distinct n) as citations from (select venue, unnest([idx % 6, idx % 9]) as n from bib) group by venue)") + """select venue as source_file, count(*) filter (idx % 4 <> 0) as body_pages, count(*) filter (idx % 4 = 0) as reference_pages, count(*) as chunks, count(*) filter (idx % 3 = 0) as chunks_with_images, max(citations) as citations, count(*) filter (idx % 5 = 0) as resolved, count(*) filter (idx % 7 = 0) as tables
from bib join c using (venue) group by venue""",
    "papers_unanalysed": with_(BIB) + "select idx::varchar as paper_id from bib where not (idx % 3 = 0 and idx % 2 <> 0)",
    "papers_unfinished": with_(BIB, _RESULTS) + "select paper_id from results group by paper_id having count(distinct group_id) filter (error is null) < 2",
    "facts_by_group": with_(BIB, _RESULTS) + "select group_id, count(distinct paper_id) as papers, count(error) as errors, sum(facts)::bigint as facts from results group by group_id",
    "downloads_by_status": with_(BIB) + "select case when idx % 4 = 0 then 'failed' when doi is null then 'skipped' else 'fetched' end as status, count(*) as files from bib group by 1",
    "batched_prompts": with_(BIB, "p as (select provider as group_id, idx // 20 as batch, (idx // 10)::varchar as paper_id, '## Paper ' || (idx // 10) || chr(10) || string_agg(title, chr(10) || chr(10) order by idx) as t from bib group by provider, idx // 20, idx // 10)") + "select group_id, batch, string_agg(paper_id, ',' order by paper_id) as papers, md5(string_agg(t, chr(10) || chr(10) order by paper_id)) as prompt_md5 from p group by all",
    "recovered_decisions": with_(BIB, f"again as (select lower({_STRIP.format('title')}) as k, max(idx) as i from bib where idx % 6 = 0 group by 1)") + f"select idx, case when i is not null then 'include' when idx % 2 = 0 then 'exclude' else 'include' end as decision, coalesce(i::varchar, 'first') as screening_reason from bib left join again on lower({_STRIP.format('title')}) = k",
    "tokens_and_tasks": with_(BIB) + f"select idx, greatest(1, length({_WHOLE}) // 4)::bigint as tokens, (['detection', 'classification', 'segmentation'])[idx % 3 + 1] as task, year from bib",
    "clusters_nested": with_(*_CLUSTERED, recursive=True) + "select cluster_id, count(*) as size, string_agg(provider_id, ',' order by idx) as members from clustered group by cluster_id",
    "clusters_flat": with_(*_CLUSTERED, recursive=True) + """, per as (select cluster_id, string_agg(provider || '(' || n || ')', '; ' order by provider) as p from (select cluster_id, provider, count(*) as n from clustered group by all) group by 1),
dois as (select cluster_id, count(*) as n, string_agg(doi, '; ' order by i) as v from (select cluster_id, doi, min(idx) as i from clustered where doi is not null group by all) group by 1),
arx as (select cluster_id, count(*) as n, string_agg(arxiv_id, '; ' order by i) as v from (select cluster_id, arxiv_id, min(idx) as i from clustered where arxiv_id is not null group by all) group by 1)
select provider_id, cluster_id::varchar as cluster_id, len(authors)::varchar as author_count, (count(*) over (partition by cluster_id))::varchar as cluster_size, case when coalesce(dois.n, 0) = 1 or (coalesce(dois.n, 0) = 0 and coalesce(arx.n, 0) = 1) then '1.0' else '0.95' end as cluster_confidence,
coalesce(dois.v, '') as cluster_dois, coalesce(arx.v, '') as cluster_arxiv_ids, p as cluster_providers from clustered join per using (cluster_id) left join dois using (cluster_id) left join arx using (cluster_id)""",
    "records_as_json": with_(BIB) + "select idx, title, year, case when len(authors) > 1 then authors[2].family_name end as second, year is null as null_kept from bib",
    "q1_fuzzy_venues": with_(BIB, "j as (select unnest(['src1', 'src3', 'src7 Springer', 'Journal of src9']) as j)", "v as (select distinct venue from bib where venue <> '')", "m as (select venue, max(j) as j from v join j on list_has_all(string_split(lower(j), ' '), string_split(lower(trim(venue)), ' ')) group by venue)") + "select idx, j as matched from bib left join m using (venue)",
    "q1_leading_summary": with_(BIB) + "select idx, (['Plant Disease', 'Sensors', 'IEEE Access', null, null])[idx % 5 + 1] as matched, idx % 5 < 3 as is_q1 from bib",
}

"""One projection for each provider: saved responses to the record schema.  Records without a title go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import ids
from litloom.functions.dates import extract_year, medline_year
from litloom.functions.people import parse_authors, split_last_space, split_name

FIELDS = ("title", "year", "provider", "provider_id", "external_ids", "abstract", "authors", "venue", "url", "cited_by_count")
ABSTRACT_LIMIT = 5000


def at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def abstract_from_index(index: Column) -> Column:
    """Words by their positions: map<word, array<position>> to text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.substring(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), 1, ABSTRACT_LIMIT)


def _ids(doi=None, arxiv=None, pubmed=None, openalex=None, s2=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(*[(c if c is not None else none).alias(n) for n, c in (("doi", doi), ("arxiv_id", arxiv), ("pubmed_id", pubmed), ("openalex_id", openalex), ("s2_id", s2))])


def _record(df: DataFrame, provider: str, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    columns = {"provider": F.lit(provider), "provider_id": F.lit(""), "abstract": none, "venue": none, "url": none, "cited_by_count": F.lit(None).cast("int"), "authors": F.array().cast("array<struct<family_name:string,given_name:string,orcid:string>>"), **columns}
    out = df.select(*[columns[f].alias(f) for f in FIELDS])
    return out.where(F.coalesce(F.col("title"), F.lit("")) != "")


def _variant(df: DataFrame) -> tuple[DataFrame, Column]:
    """df with its parsed response, and that.  A generator keeps it from being parsed, and made, again for each field and the filter."""
    return df.withColumn("__v", F.explode(F.array(F.try_parse_json("raw")))), F.col("__v")


def openalex(df: DataFrame) -> DataFrame:
    """raw: one work as JSON."""
    df, v = _variant(df)
    openalex_id = ids.openalex_id(at(v, "id"))
    index = at(v, "abstract_inverted_index", "map<string,array<int>>")
    people = F.transform(at(v, "authorships", "array<struct<author:struct<display_name:string,orcid:string>>>"), lambda a: split_last_space(a["author"]["display_name"], a["author"]["orcid"]))
    return _record(
        df, "openalex", title=F.coalesce(at(v, "display_name"), at(v, "title")), year=at(v, "publication_year", "int"), provider_id=F.coalesce(openalex_id, F.lit("")),
        external_ids=_ids(doi=ids.normalize_doi(F.coalesce(at(v, "ids.doi"), at(v, "doi"))), pubmed=ids.pubmed_id(at(v, "ids.pmid")), openalex=openalex_id), abstract=abstract_from_index(index), authors=people,
        venue=at(v, "primary_location.source.display_name"), url=F.coalesce(at(v, "primary_location.landing_page_url"), at(v, "id")), cited_by_count=at(v, "cited_by_count", "int"),
    )


def crossref(df: DataFrame) -> DataFrame:
    df, v = _variant(df)
    people = F.transform(at(v, "author", "array<struct<family:string,given:string,ORCID:string>>"), lambda a: F.struct(F.coalesce(a["family"], F.lit("Unknown")).alias("family_name"), a["given"].alias("given_name"), a["ORCID"].alias("orcid")))
    return _record(
        df, "crossref", title=at(v, "title[0]"), year=at(v, "issued['date-parts'][0][0]", "int"), external_ids=_ids(doi=ids.normalize_doi(at(v, "DOI"))), abstract=at(v, "abstract"), authors=people,
        venue=F.try_variant_get(v, "$['container-title'][0]", "string"), url=at(v, "URL"), cited_by_count=F.try_variant_get(v, "$['is-referenced-by-count']", "int"),
    )


def semantic_scholar(df: DataFrame) -> DataFrame:
    df, v = _variant(df)
    people = F.transform(at(v, "authors", "array<struct<name:string>>"), lambda a: split_last_space(a["name"]))
    found = _ids(doi=ids.normalize_doi(at(v, "externalIds.DOI")), arxiv=at(v, "externalIds.ArXiv"), pubmed=at(v, "externalIds.PubMed"), s2=at(v, "paperId"))
    return _record(df, "s2", title=at(v, "title"), year=at(v, "year", "int"), external_ids=found, abstract=at(v, "abstract"), authors=people, venue=at(v, "venue"), url=at(v, "url"), cited_by_count=at(v, "citationCount", "int"))


def doaj(df: DataFrame) -> DataFrame:
    df, v = _variant(df)
    names = at(v, "bibjson.identifier", "array<struct<type:string,id:string>>")
    doi = F.try_element_at(F.filter(names, lambda x: F.lower(x["type"]) == "doi"), F.lit(1))["id"]
    link = F.try_element_at(at(v, "bibjson.link", "array<struct<type:string,url:string>>"), F.lit(1))["url"]
    people = F.transform(at(v, "bibjson.author", "array<struct<name:string,orcid_id:string>>"), lambda a: split_name(a["name"], a["orcid_id"]))
    return _record(df, "doaj", title=at(v, "bibjson.title"), year=extract_year(at(v, "bibjson.year")), provider_id=F.coalesce(at(v, "id"), F.lit("")), external_ids=_ids(doi=ids.normalize_doi(doi)), abstract=at(v, "bibjson.abstract"), authors=people, venue=at(v, "bibjson.journal.title"), url=link)


def core(df: DataFrame) -> DataFrame:
    df, v = _variant(df)
    people = F.transform(at(v, "authors", "array<struct<name:string>>"), lambda a: split_name(a["name"]))
    full = F.try_element_at(at(v, "sourceFulltextUrls", "array<string>"), F.lit(1))
    url = F.coalesce(F.nullif(at(v, "downloadUrl"), F.lit("")), F.nullif(full, F.lit("")), F.concat(F.lit("https://core.ac.uk/works/"), at(v, "id")))
    return _record(df, "core", title=at(v, "title"), year=at(v, "yearPublished", "int"), provider_id=F.coalesce(at(v, "id"), F.lit("")), external_ids=_ids(doi=ids.normalize_doi(at(v, "doi")), arxiv=at(v, "arxivId")), abstract=at(v, "abstract"), authors=people, venue=at(v, "publisher"), url=url, cited_by_count=at(v, "citationCount", "int"))


def ieee(df: DataFrame) -> DataFrame:
    df, v = _variant(df)
    people = F.transform(at(v, "authors.authors", "array<struct<full_name:string>>"), lambda a: split_name(a["full_name"]))
    return _record(df, "ieee", title=at(v, "title"), year=extract_year(at(v, "publication_year")), provider_id=F.coalesce(at(v, "article_number"), F.lit("")), external_ids=_ids(doi=ids.normalize_doi(at(v, "doi"))), abstract=at(v, "abstract"), authors=people, venue=at(v, "publication_title"), url=at(v, "html_url"), cited_by_count=at(v, "citing_paper_count", "int"))


def arxiv(df: DataFrame) -> DataFrame:
    """Rows of the XML reader with rowTag=entry: id, title, summary, published, author, doi, category."""
    arxiv_id = ids.arxiv_from_url(F.col("id"))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    people = F.transform("author", lambda a: split_last_space(a["name"]))
    venue = F.when(F.col("category").isNotNull(), F.concat(F.lit("arXiv ("), F.col("category"), F.lit(")"))).otherwise("arXiv")
    return _record(df, "arxiv", title=squeeze(F.col("title")), year=F.substring("published", 1, 4).try_cast("int"), external_ids=_ids(doi=ids.normalize_doi(F.col("doi")), arxiv=arxiv_id), abstract=squeeze(F.col("summary")), authors=people, venue=venue, url=F.col("id"))


ARXIV_ROWS = "id string, title string, summary string, published string, author array<struct<name:string>>, doi string, category string"


PUBMED_AUTHORS = "Author array<struct<LastName:string,ForeName:string,Initials:string,CollectiveName:string>>"


def pubmed(df: DataFrame) -> DataFrame:
    """raw: one PubmedArticle element as XML text."""
    x = lambda path: F.expr(f"xpath_string(raw, '{path}')")
    some = lambda path: F.expr(f"xpath(raw, '{path}')")
    text = lambda c: F.nullif(c, F.lit(""))
    year = F.coalesce(text(x("//PubDate/Year")).try_cast("int"), medline_year(x("//PubDate/MedlineDate")))
    doi = F.coalesce(text(x('//ELocationID[@EIdType="doi"]')), text(x('//ArticleIdList/ArticleId[@IdType="doi"]')))
    people = F.from_xml(F.concat(F.lit("<list>"), F.coalesce(F.nullif(F.regexp_extract("raw", r"(?s)<AuthorList[^>]*>(.*?)</AuthorList>", 1), F.lit("")), F.lit("<none/>")), F.lit("</list>")), F.lit(PUBMED_AUTHORS))["Author"]
    name = F.coalesce  # each author's own parts: a missing first name shifts nothing
    people = F.transform(F.coalesce(people, F.array().cast(PUBMED_AUTHORS.removeprefix("Author "))), lambda a: F.struct(name(F.nullif(a["LastName"], F.lit("")), a["CollectiveName"], F.lit("Unknown")).alias("family_name"), name(a["ForeName"], a["Initials"]).alias("given_name"), F.lit(None).cast("string").alias("orcid")))
    pmid = text(x("//MedlineCitation/PMID"))
    return _record(df, "pubmed", title=text(x("//ArticleTitle")), year=year, provider_id=F.coalesce(pmid, F.lit("")), external_ids=_ids(doi=ids.normalize_doi(doi), pubmed=pmid), abstract=text(F.array_join(some("//AbstractText/text()"), " ")), authors=people, venue=text(x("//Journal/Title")), url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")))


def generic(df: DataFrame, fields: dict[str, str], provider: str, author_parser: Callable[[Column], Column] = split_name, id_extractor: Callable[[Column], dict] | None = None) -> DataFrame:
    """Any JSON response by a map from record fields to paths; authors: a path to names."""
    df, v = _variant(df)
    get = lambda f, kind="string": at(v, fields[f], kind) if f in fields else F.lit(None).cast(kind)
    found = id_extractor(v) if id_extractor else {"doi": ids.normalize_doi(get("doi")), "arxiv": get("arxiv_id"), "openalex": get("openalex_id"), "s2": get("s2_id")}
    pid = ids.provider_id(*[found.get(k, F.lit(None).cast("string")) for k in ("doi", "openalex", "arxiv", "s2")], get("title"))
    people = parse_authors(get("authors", "array<variant>")) if author_parser is split_name else F.transform(get("authors", "array<string>"), author_parser)
    return _record(df, provider, title=get("title"), year=extract_year(get("year")), provider_id=pid, external_ids=_ids(**found), abstract=get("abstract"), authors=people, venue=get("venue"), url=get("url"), cited_by_count=get("cited_by_count", "int"))


NORMALIZERS = {"openalex": openalex, "crossref": crossref, "s2": semantic_scholar, "semantic_scholar": semantic_scholar, "doaj": doaj, "core": core, "ieee": ieee, "arxiv": arxiv, "pubmed": pubmed}

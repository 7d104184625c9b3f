"""The pipeline from a paper's pages to chunks with their tables, formulas and citations.

Reading PDFs, recognising text and formulas are hooks: Python functions over batches that a
caller supplies.  What follows is DataFrame work: pages are flagged, body pages are cut into
chunks, references make a library, and tables, formulas and citations are joined to chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions.citations import author_date_citations, citation_numbers, short_cite
from litloom.functions.text import strip
from litloom.operators import structure

#: Commands that tell LaTeX mathematics.
COMMANDS = ["frac", "sum", "int", "sqrt", "alpha", "beta", "gamma", "delta", "theta", "lambda", "mu", "nu", "pi", "rho", "sigma", "tau", "phi", "psi", "omega", "cdot", "times", "mathbb", "mathbf", "mathrm"]
#: How a table's caption begins.
CAPTION = r"(?i)^(Table\s+\d+[.:]\s*.+|Tab\.\s*\d+[.:]\s*.+)$"


def math_text(text: Column) -> Column:
    """Whether a box's text may be a formula: operators, signs, Greek letters, or digits."""
    signs = text.rlike(r"[=<>±+\-×*/^_]|[∑∏∫√≈≤≥]|[Ͱ-Ͽ]")
    digits = text.rlike(r"\d")
    return F.coalesce((text != "") & (signs | digits), F.lit(False))


def latex_math(latex: Column) -> Column:
    """Whether recognised LaTeX is mathematics: of 2 to 500 characters, with an operator or a digit, and not roman words alone."""
    x = strip(latex)
    digit, operator = x.rlike(r"\d"), x.rlike(r"[=<>±+\-*/^_]")
    command = x.rlike("|".join(rf"\\{c}" for c in COMMANDS))
    return F.coalesce(F.char_length(x).between(2, 500) & (digit | operator) & (command | digit | operator), F.lit(False))


def caption(above: Column, below: Column) -> Column:
    """A table's caption: a line of the text above, then below, that is one, else of each the first that begins so."""

    def of(text: Column) -> Column:
        lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
        exact = F.filter(lines, lambda x: x.rlike(CAPTION))
        loose = F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit("table")))
        return F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(loose, F.lit(1)))

    return F.coalesce(of(above), of(below), F.lit(""))


def better_tables(native: DataFrame, markdown: DataFrame) -> DataFrame:
    """Of each page the tables from Markdown if their cells are more than the native ones', else these."""
    cells = F.sum(F.size("rows") * F.size("headers"))
    keys = ["source_file", "page_number"]
    score = native.groupBy(*keys).agg(cells.alias("own")).join(markdown.groupBy(*keys).agg(cells.alias("other")), keys, "full")
    use = score.select(*keys, (F.coalesce("other", F.lit(0)) > F.coalesce("own", F.lit(0))).alias("markdown"))
    pick = lambda df, flag: df.join(use.where(F.col("markdown") == flag).select(*keys), keys, "left_semi")
    return pick(native, False).unionByName(pick(markdown, True))


def markdown_tables(pages: DataFrame) -> DataFrame:
    """The tables in the text of pages, each run of lines with bars: source_file, page_number, table_id, headers, rows."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), strip)
    # Runs of other lines become one mark, so each run of barred lines is a piece of its own.
    marked = F.array_join(F.transform(lines, lambda x: F.when(F.startswith(x, F.lit("|")), x).otherwise("\x02")), "\n")
    runs = F.filter(F.split(marked, "\x02"), lambda x: F.contains(x, F.lit("|")))
    found = pages.select("source_file", "page_number", F.posexplode(runs).alias("n", "run"))
    table = found.withColumn("t", structure.parse_markdown_table(F.trim(F.regexp_replace("run", r"^\n+|\n+$", ""))))
    table = table.where(F.size(F.coalesce("t.headers", F.array().cast("array<string>"))) > 0)
    name = F.concat_ws(":", "source_file", F.concat(F.lit("p"), F.col("page_number").cast("string")), F.concat(F.lit("t"), F.col("n").cast("string")))
    return table.select("source_file", "page_number", name.alias("table_id"), F.col("t.headers").alias("headers"), F.col("t.rows").alias("rows"), F.lit(None).cast("string").alias("caption"))


def citations(chunks: DataFrame, library: DataFrame, threshold: int = 85) -> DataFrame:
    """(id, number, authors, title, year, short, type, matched_text) of what each chunk cites: by number, else by author and year."""
    short = short_cite(F.col("authors"), F.col("year"), F.col("number"))
    exact = structure.link_numbers(chunks, library).select("id", "number", "authors", "title", "year", F.lit("exact_number").alias("type"), F.lit(None).cast("string").alias("matched_text"))
    loose = chunks.select("id", "source_file", F.explode(author_date_citations(F.col("text"))).alias("citation"))
    linked = structure.link_author_dates(loose.select("source_file", "citation"), library, threshold)
    fuzzy = loose.join(linked, ["source_file", "citation"]).groupBy("id", "source_file", "number").agg(F.min("citation").alias("matched_text"))
    fuzzy = fuzzy.join(library.select("source_file", "number", "authors", "title", "year"), ["source_file", "number"]).join(exact.select("id", "number"), ["id", "number"], "left_anti")
    fuzzy = fuzzy.select("id", "number", "authors", "title", "year", F.lit("fuzzy_match").alias("type"), "matched_text")
    return exact.unionByName(fuzzy).withColumn("short", short)


def with_citations(chunks: DataFrame, library: DataFrame, threshold: int = 85) -> DataFrame:
    """chunks with citations, a map from the reference's number to its entry."""
    entry = F.struct("authors", "title", "year", "short", "type", "matched_text")
    found = citations(chunks, library, threshold).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("number").cast("string"), entry)))).alias("citations"))
    return chunks.join(found, "id", "left")


def over_pages(pages: DataFrame, hook: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A hook over batches of pages: recognised text, tables, formulas."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield hook(pdf)

    return pages.mapInPandas(run, schema)


def with_ocr(pages: DataFrame, recognise: Callable[[str, int], str], least: int = 200) -> DataFrame:
    """pages with the recognised text where their own is short; recognise(source_file, page_number)."""
    short = structure.needs_ocr(F.coalesce("text", F.lit("")), least)

    def hook(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(text=[recognise(f, int(n)) for f, n in zip(pdf["source_file"], pdf["page_number"])])

    rest, poor = pages.where(~short), pages.where(short)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    done = over_pages(poor, hook, schema).withColumn("ocr", F.lit(True))
    return rest.withColumn("ocr", F.lit(False)).unionByName(done)


def process(pages: DataFrame, tables: DataFrame | None = None, formulas: DataFrame | None = None, limit: int = structure.CHUNK_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, library, tables) of the pages: source_file, page_number, text.

    Pages from the heading of references on make the library, the others the chunks; tables
    come from the hook or from the pages' Markdown, and are continued over pages.
    """
    flagged = structure.flag_references(pages)
    body, back = flagged.where("not is_references"), flagged.where("is_references")
    one = back.groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))
    library = structure.reference_library(one)
    chunks = with_citations(structure.chunk_pages(body, limit), library)
    own = markdown_tables(body)
    found = structure.merge_continuations(own if tables is None else better_tables(tables, own))
    chunks = structure.attach(chunks, found.select("source_file", "page_number", "table_id", "headers", "rows", "caption"), "tables")
    if formulas is not None:
        chunks = structure.attach(chunks, formulas.where(latex_math(F.col("latex"))), "formulas")
    return chunks, library, found


def document_counts(pages: DataFrame, chunks: DataFrame, library: DataFrame, tables: DataFrame) -> DataFrame:
    """Of each paper: pages of body and references, images, tables, distinct citations, references."""
    per_page = pages.groupBy("source_file").agg(F.count_if(~F.col("is_references")).alias("body_pages"), F.count_if("is_references").alias("reference_pages"))
    cited = chunks.select("source_file", F.explode(citation_numbers(F.col("text"))).alias("n")).groupBy("source_file").agg(F.countDistinct("n").alias("citations"))
    shown = chunks.groupBy("source_file").agg(F.count("*").alias("chunks"), F.count_if(F.size("images") > 0).alias("chunks_with_images"))
    known, tabled = library.groupBy("source_file").agg(F.count("*").alias("resolved")), tables.groupBy("source_file").agg(F.count("*").alias("tables"))
    out = per_page
    for part in (shown, cited, known, tabled):
        out = out.join(part, "source_file", "left")
    return out.na.fill(0)


def write(chunks: DataFrame, library: DataFrame, tables: DataFrame, pages: DataFrame, folder: str) -> None:
    """Chunks, references and tables as Parquet by paper, tables and pages as Markdown too."""
    for name, df in (("chunks", chunks), ("references", library), ("tables", tables)):
        df.write.partitionBy("source_file").parquet(f"{folder}/{name}")
    text = tables.select("source_file", F.concat_ws("\n", F.concat(F.lit("**"), "caption", F.lit("**")), structure.as_markdown(F.col("headers"), F.col("rows"))).alias("value"))
    text.write.partitionBy("source_file").text(f"{folder}/tables_markdown")
    pages.select("source_file", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source_file").text(f"{folder}/markdown")


def unanalysed(papers: DataFrame, analyses: DataFrame) -> DataFrame:
    """Papers without an analysis; a failed one counts as none."""
    return papers.join(analyses.where("error is null").select("paper_id").distinct(), "paper_id", "left_anti")


def analyse(papers: DataFrame, engine: Callable[[str], dict[str, str]], limit: int = 100_000) -> DataFrame:
    """paper_id, facts, error: an engine over each paper's text, of which it takes `limit` characters; a failure is told in its row."""

    def hook(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, t in zip(pdf["paper_id"], pdf["text"]):
            try:
                rows.append((i, list(engine((t or "")[:limit]).items()), None))
            except Exception as e:  # a paper's fault, told in its row
                rows.append((i, [], str(e)))
        return pd.DataFrame(rows, columns=["paper_id", "facts", "error"])

    out = over_pages(papers.select("paper_id", "text"), hook, "paper_id string, facts array<struct<k:string,v:string>>, error string")
    return out.withColumn("facts", F.map_from_entries("facts"))


def first_papers(papers: DataFrame, n: int) -> DataFrame:
    """The first n by path."""
    return papers.orderBy("source_file").limit(n)

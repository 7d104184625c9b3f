"""Findings and reports of corpora as rows: errors and warnings, distributions, outliers, Markdown lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions.text import strip, truthy
from litloom.operators import stats

#: Years outside these bounds are reported.
OLDEST, LATEST = 1900, 2030


def findings(docs: DataFrame) -> DataFrame:
    """(level, idx, message): each record's missing title (an error), missing year and odd DOI (warnings), in one pass."""
    at = lambda text: F.concat(F.lit("Document "), (F.col("idx") + 1).cast("string"), F.lit(": "), text)
    found = F.array_compact(
        F.array(
            F.when(~truthy(F.col("title")), F.struct(F.lit("error").alias("level"), at(F.lit("Missing title")).alias("message"))),
            F.when(F.coalesce("year", F.lit(0)) == 0, F.struct(F.lit("warning").alias("level"), at(F.lit("Missing year")).alias("message"))),
            F.when(truthy(F.col("doi")) & ~F.startswith("doi", F.lit("10.")), F.struct(F.lit("warning").alias("level"), at(F.concat(F.lit("Invalid DOI format: "), F.col("doi"))).alias("message"))),
        )
    )
    return docs.select("idx", F.explode(found).alias("f")).select("f.level", "idx", "f.message")


def corpus_warnings(docs: DataFrame) -> DataFrame:
    """(level, idx, message) of the whole corpus: repeated titles, years that are too old or to come."""
    same = stats.duplicate_titles(docs).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n"))
    years = docs.where(F.coalesce("year", F.lit(0)) != 0).agg(F.min("year").alias("low"), F.max("year").alias("high"))
    row = lambda df, there, text: df.where(there).select(F.lit("warning").alias("level"), F.lit(None).cast("long").alias("idx"), text.alias("message"))
    out = row(same, F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" documents have duplicate titles (potential duplicates)")))
    out = out.unionByName(row(years, F.col("low") < OLDEST, F.concat(F.lit("Suspiciously old year detected: "), F.col("low").cast("string"))))
    return out.unionByName(row(years, F.col("high") > LATEST, F.concat(F.lit("Future year detected: "), F.col("high").cast("string"))))


def first_findings(found: DataFrame, n: int = 10) -> DataFrame:
    """The first n of each level, and of how many."""
    order = Window.partitionBy("level").orderBy(F.col("idx").asc_nulls_last(), "message")
    counts = found.groupBy("level").agg(F.count("*").alias("all"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).join(F.broadcast(counts), "level")  # two levels


def value_counts(docs: DataFrame, columns: tuple[str, ...] = ("provider", "year", "language")) -> DataFrame:
    """(field, value, records) of several columns in one aggregate; empty values are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return docs.select(each.alias("x")).select("x.*").where(truthy(F.col("value"))).groupBy("field", "value").agg(F.count("*").alias("records"))


def share_line(name: Column, n: Column, total: Column) -> Column:
    """An indented line of a count and its share."""
    return F.concat(F.lit("  "), name, F.lit(": "), F.format_number(n, 0), F.lit(" ("), F.format_string("%.1f", n * 100 / total), F.lit("%)"))


def validation_report(docs: DataFrame, source: str = "") -> DataFrame:
    """(section, ord, line) of the report: the size of the corpus, completeness, providers by count, years in order, findings."""
    profile = stats.validation_profile(docs)
    head = profile.select(F.posexplode(F.array(F.lit("Validation Report"), F.lit("=" * 70), F.lit(f"Source: {source}"), F.concat(F.lit("Total documents: "), F.format_number("total", 0)))).alias("ord", "line"))
    parts = F.array(*[F.struct(F.lit(f"Documents with {n}").alias("name"), F.col(c).alias("n")) for n, c in (("DOI", "with_doi"), ("abstract", "with_abstract"), ("arXiv ID", "with_arxiv_id"))])
    kept = profile.where("total > 0").select("total", F.posexplode(parts).alias("ord", "x")).select("ord", share_line(F.col("x.name"), F.col("x.n"), F.col("total")).alias("line"))
    counts = value_counts(docs, ("provider", "year")).crossJoin(F.broadcast(profile.select("total")))  # one row
    line = share_line(F.col("value"), F.col("records"), F.col("total"))
    rank = lambda by: F.row_number().over(Window.partitionBy("field").orderBy(*by))
    providers = counts.where("field = 'provider'").select(rank([F.desc("records"), F.col("value")]).alias("ord"), line.alias("line"))
    years = counts.where("field = 'year'").select(rank([F.col("value").cast("int")]).alias("ord"), line.alias("line"))
    found = findings(docs).unionByName(corpus_warnings(docs))
    ends = found.groupBy("level").agg(F.count("*").alias("n")).select(F.when(F.col("level") == "error", 0).otherwise(1).alias("ord"), F.concat(F.lit("  "), F.initcap("level"), F.lit("s: "), F.col("n").cast("string")).alias("line"))
    named = [(1, head), (2, kept), (3, providers), (4, years), (5, ends)]
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("section"), F.col("ord").cast("long").alias("ord"), "line") for k, df in named])


def outliers(values: DataFrame, column: str, n: int = 20, order: str = "idx") -> DataFrame:
    """The first n values that are no share: below 0, or above 100."""
    return values.where((F.col(column) > 100) | (F.col(column) < 0)).orderBy(order).limit(n)


def statistics_report(tidy: DataFrame) -> DataFrame:
    """(ord, line): Markdown of tidy statistics (section, name, value), a table for each section."""
    order = Window.partitionBy("section").orderBy("name")
    rows = tidy.select("section", F.row_number().over(order).alias("n"), F.concat(F.lit("| "), F.col("name"), F.lit(" | "), F.col("value").cast("string"), F.lit(" |")).alias("line"))
    heads = tidy.select("section").distinct().select("section", F.posexplode(F.array(F.concat(F.lit("## "), F.col("section")), F.lit("| name | value |"), F.lit("|---|---|"))).alias("n", "line")).withColumn("n", F.col("n") - 2)
    return rows.unionByName(heads.select("section", "n", "line")).select("section", F.col("n").cast("long").alias("n"), "line")


def duration(seconds: Column) -> Column:
    """Seconds, minutes or hours with one digit."""
    say = lambda x, unit: F.concat(F.format_string("%.1f", x), F.lit(unit))
    return F.when(seconds < 60, say(seconds, "s")).when(seconds < 3600, say(seconds / 60, "m")).otherwise(say(seconds / 3600, "h"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.concat(F.format_string("%.1f", part * 100 / whole), F.lit("%"))).otherwise("0.0%")


def recovered(docs: DataFrame, word: str) -> DataFrame:
    """Records that were excluded for a reason with the word: those to screen again."""
    return docs.where((F.col("decision") == "exclude") & F.contains(F.lower(F.coalesce("screening_reason", F.lit(""))), F.lit(word.lower())))


def proxied(url: Column, suffix: str) -> Column:
    """The address by way of a proxy: the host's dots as dashes, then the suffix; one that has it stays."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    rest = F.substr(url, F.length(scheme) + F.length(host) + 1)
    return F.when(F.contains(host, F.lit(suffix.lstrip("."))) | (host == ""), url).otherwise(F.concat(scheme, F.replace(host, F.lit("."), F.lit("-")), F.lit(suffix), rest))


def trimmed_title(title: Column) -> Column:
    return F.lower(strip(title))

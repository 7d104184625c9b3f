"""Matching of venues against a list of leading journals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from litloom.functions.similarity import token_set
from litloom.functions.text import strip

#: publishers' words that are stripped from a venue.
PUBLISHERS = r"\(mdpi\)|mdpi|frontiers in|elsevier|springer|nature"
#: The leading journals.
LEADING = [
    "Frontiers in Plant Science",
    "Plant Disease",
    "IEEE Access",
    "Computers and Electronics in Agriculture",
    "Plant Pathology",
    "Plant Pathology Journal",
    "Agriculture",
    "Plants",
    "AI Open",
    "Scientific Reports",
    "Nature Communications",
    "Sensors",
    "Agronomy",
    "Phytopathology",
    "Molecular Plant Pathology",
    "Journal of Experimental Botany",
    "New Phytologist",
    "Plant Cell and Environment",
    "Journal of Cleaner Production",
    "Remote Sensing of Environment",
    "Precision Agriculture",
    "Smart Agricultural Technology",
    "Engineering in Agriculture, Environment and Food",
    "Transactions of the ASABE",
    "Biosystems Engineering",
    "Information Processing in Agriculture",
    "Artificial Intelligence in Agriculture",
    "Applied Soft Computing",
    "Knowledge-Based Systems",
    "Expert Systems with Applications",
    "Pattern Recognition",
    "Computer Vision and Image Understanding",
    "IEEE Transactions on Pattern Analysis and Machine Intelligence",
    "IEEE Transactions on Image Processing",
    "International Journal of Computer Vision",
    "Neural Networks",
    "Neurocomputing",
    "Decision Support Systems",
    "PLOS ONE",
    "Scientific Data",
    "Nature Plants",
    "The Plant Journal",
    "The Plant Cell",
    "Plant Physiology",
    "Annals of Botany",
    "Current Biology",
    "Cell",
    "Science",
    "Nature",
    "PeerJ",
    "PloS Genetics",
    "Crop Protection",
    "Postharvest Biology and Technology",
    "Trends in Plant Science",
    "Annual Review of Plant Biology",
    "Annual Review of Phytopathology",
    "European Journal of Plant Pathology",
    "Australasian Plant Pathology",
    "Canadian Journal of Plant Pathology",
    "Plant Breeding",
    "Journal of Plant Research",
    "Plant Science",
    "Plant Biology",
    "Planta",
]


def simple_venue(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(strip(c)), PUBLISHERS, ""))


def rank_venues(docs: DataFrame, journals: list[str] | None = None, threshold: int = 90, fuzzy: bool = True) -> DataFrame:
    """docs with is_q1 and matched: exact, exact without publishers' words, else the best by token-set ratio.

    Venues repeat, so the distinct ones are matched and joined back.  Only those without an
    exact match reach the Python function, against an array of the journals.
    """
    spark = docs.sparkSession
    journals = list(dict.fromkeys(LEADING if journals is None else journals))
    known = F.broadcast(spark.createDataFrame([(j.lower(), j) for j in journals], "key string, journal string").dropDuplicates(["key"]))
    venues = docs.where(F.coalesce(F.col("venue"), F.lit("")) != "").select("venue").distinct()
    low = venues.select("venue", F.lower(strip(F.col("venue"))).alias("low"), simple_venue(F.col("venue")).alias("simple"))
    exact = low.join(known.select(F.col("key").alias("low"), F.col("journal").alias("j1")), "low", "left").join(known.select(F.col("key").alias("simple"), F.col("journal").alias("j2")), "simple", "left")
    exact = exact.select("venue", "low", F.coalesce("j1", "j2").alias("matched"))
    out = exact.where("matched is not null").select("venue", "matched")
    if fuzzy:
        held = spark.sparkContext.broadcast(journals)  # a list that the caller's driver holds

        @pandas_udf("string")
        def best(low: pd.Series) -> pd.Series:
            def one(venue: str) -> str | None:
                score, name = max(((token_set(venue, j.lower()), j) for j in held.value), default=(0.0, None))
                return name if score >= threshold else None

            return low.map(one)

        rest = exact.where("matched is null").select("venue", best("low").alias("matched"))
        out = out.unionByName(rest.where("matched is not null"))
    ranked = docs.join(out, "venue", "left")
    return ranked.withColumn("is_q1", F.col("matched").isNotNull())


def rank_summary(ranked: DataFrame) -> DataFrame:
    out = ranked.agg(F.count("*").alias("total"), F.count_if("is_q1").alias("q1"))
    return out.withColumns({"other": F.col("total") - F.col("q1"), "percent": F.try_divide(F.col("q1") * 100, F.col("total"))})

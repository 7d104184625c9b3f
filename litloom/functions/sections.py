"""Section tags, images and headers of document chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a header that tell a section's role.
SECTIONS = {
    "abstract": ["abstract"],
    "introduction": ["introduction", "background", "motivation", "problem statement"],
    "methods": ["methods?", "methodology", "materials and methods", "experimental setup", "implementation", "approach", "proposed method", "model", "architecture"],
    "results": ["results?", "evaluation", "experiments?", "performance"],
    "discussion": ["discussion", "analysis", "interpretation"],
    "related_work": ["related work", "literature review", "prior work"],
    "conclusion": ["conclusions?", "concluding", "summary", "future work"],
}


def section_tags(title: Column, hierarchy: Column) -> Column:
    """Tags in the order of SECTIONS."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(hierarchy, F.lit(""))))
    return F.array_compact(F.array(*[F.when(text.rlike(rf"\b(?:{'|'.join(words)})\b"), F.lit(tag)) for tag, words in SECTIONS.items()]))


def section_role(tags: Column) -> Column:
    return F.try_element_at(tags, F.lit(1))


def image_names(text: Column) -> Column:
    paths = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), 1)
    return F.transform(paths, lambda p: F.element_at(F.split(p, "/"), -1))


def header_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s+.+$", 1))


def header_title(line: Column) -> Column:
    return F.regexp_extract(line, r"^#{1,6}\s+(.+)$", 1)

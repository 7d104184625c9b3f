"""Schemas of the bibliographic tables, and the compiler from declared extraction fields to Spark types."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

EXTERNAL_IDS = T.StructType([T.StructField(n, T.StringType()) for n in ("doi", "arxiv_id", "pubmed_id", "openalex_id", "s2_id")])
AUTHOR = T.StructType([T.StructField(n, T.StringType()) for n in ("family_name", "given_name", "orcid")])
LAYER = T.StructType([T.StructField("layer", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("decision", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("confidence", T.IntegerType())])
DOCUMENT = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("provider", T.StringType()),
        T.StructField("provider_id", T.StringType()),
        T.StructField("external_ids", EXTERNAL_IDS),
        T.StructField("abstract", T.StringType()),
        T.StructField("authors", T.ArrayType(AUTHOR)),
        T.StructField("venue", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("cited_by_count", T.IntegerType()),
        T.StructField("query_id", T.StringType()),
        T.StructField("query_text", T.StringType()),
        T.StructField("retrieved_at", T.TimestampType()),
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("decision", T.StringType()),
        T.StructField("screening_reason", T.StringType()),
        T.StructField("screening_confidence", T.IntegerType()),
        T.StructField("screening_layers", T.ArrayType(LAYER)),
    ]
)
CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("hierarchy", T.StringType()),
        T.StructField("header_level", T.IntegerType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("total_parts", T.IntegerType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("section_tags", T.ArrayType(T.StringType())),
        T.StructField("section_role", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("images", T.ArrayType(T.StringType())),
    ]
)
REFERENCE = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("raw_text", T.StringType()), T.StructField("authors", T.StringType()), T.StructField("title", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("venue", T.StringType()), T.StructField("doi", T.StringType())])


@dataclass
class Field:
    """A declared field of an extraction schema."""

    id: str
    type: str = "string"
    object_fields: dict[str, str] = field(default_factory=dict)


def spark_type(f: Field) -> T.DataType:
    """Scalars rest as strings, as a value may be the marker for "not reported"."""
    parts = T.StructType([T.StructField(n, T.StringType()) for n in f.object_fields])
    kinds = {"list of strings": T.ArrayType(T.StringType()), "list of objects": T.ArrayType(parts), "object": parts}
    return kinds.get(f.type, T.StringType())


def compile_schema(fields: list[Field | dict]) -> T.StructType:
    """StructType of declared fields; dictionaries as they come from YAML are taken too."""
    out = []
    for f in fields:
        f = f if isinstance(f, Field) else Field(f["id"], f.get("type", "string"), dict(f.get("object_fields") or {}))
        out.append(T.StructField(f.id, spark_type(f)))
    return T.StructType(out)

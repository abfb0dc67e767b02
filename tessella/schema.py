"""Record types and closed vocabularies of the corpus."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

# The vocabularies of the data model.
DOCUMENT_KINDS = ("docs", "api", "component", "json", "code", "example", "reference")
STABILITIES = ("stable", "beta", "experimental", "internal", "unknown")
LIFECYCLES = ("active", "deprecated", "removed", "historical", "unknown")
CHANNELS = ("stable", "preview", "unknown")
CHUNK_TYPES = ("document", "section", "api-overview", "api-member", "json-object", "code-block")

CHUNK_DRAFT = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("heading_path", T.ArrayType(T.StringType())),
        T.StructField("content", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("identifier", T.StringType()),
        T.StructField("symbol_kind", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("json_pointer", T.StringType()),
        T.StructField("stability", T.StringType()),
        T.StructField("lifecycle", T.StringType()),
    ]
)

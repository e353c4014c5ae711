"""Schemas of the tables passed between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def require(df: DataFrame, schema: T.StructType, what: str) -> None:
    """Refuse an input that lacks columns, before any work is done on it."""
    missing = [name for name in schema.fieldNames() if name not in df.columns]
    if missing:
        raise ValueError(f"{what} need the columns {', '.join(missing)}")


MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("repo_url", T.StringType()),
        T.StructField("commit", T.StringType()),
        T.StructField("root", T.StringType()),
    ]
)

# One row per file; `content` and `error` are filled when the file is read.
FILE_SCHEMA = T.StructType(
    [
        T.StructField("repo_url", T.StringType()),
        T.StructField("commit", T.StringType()),
        T.StructField("rel", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)

META_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("repo_url", T.StringType()),
        T.StructField("file_paths", T.ArrayType(T.StringType())),
        T.StructField("commit", T.StringType()),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("total_chunks", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("file_path", T.StringType()),
    ]
)

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

# `meta_json` keeps metadata that callers bring as a JSON object of their own.
INDEX_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("repo_url", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", VECTOR),
        T.StructField("meta", META_SCHEMA),
        T.StructField("meta_json", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

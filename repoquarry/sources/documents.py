"""Documents brought by a caller, in the shape ingestion wants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoquarry.schemas import META_SCHEMA


def as_documents(docs: DataFrame, repo_url: str | None = None) -> DataFrame:
    """(id, repo_url, content, meta, meta_json) from `content` and, where present,
    `id`, `repo_url`, `meta` and `seq`.

    `meta` may be a struct with any of the known fields, or a JSON object as text,
    which is kept whole in `meta_json` and read into the known fields it has.
    """
    if "content" not in docs.columns:
        raise ValueError("documents need a `content` column")
    empty = F.lit(None).cast(META_SCHEMA)
    meta, meta_json = empty, F.lit(None).cast("string")
    if "meta" in docs.columns:
        kind = docs.schema["meta"].dataType
        if isinstance(kind, T.StringType):
            meta, meta_json = F.from_json("meta", META_SCHEMA), F.col("meta")
        elif isinstance(kind, T.StructType):
            present = set(kind.fieldNames())
            meta = F.when(
                F.col("meta").isNotNull(),
                F.struct(
                    *[
                        (
                            F.col("meta")[f.name] if f.name in present else F.lit(None)
                        ).cast(f.dataType).alias(f.name)
                        for f in META_SCHEMA
                    ]
                ),
            )
            if present - set(META_SCHEMA.fieldNames()):
                meta_json = F.to_json("meta")
        else:
            raise ValueError(f"meta must be a struct or JSON text, not {kind.simpleString()}")
    url = F.col("repo_url") if "repo_url" in docs.columns else F.lit(None).cast("string")
    if repo_url is not None:
        url = F.lit(repo_url)
    own_id = F.col("id").cast("bigint") if "id" in docs.columns else F.lit(None).cast("bigint")
    columns = [
        own_id.alias("id"),
        url.alias("repo_url"),
        F.col("content").cast("string").alias("content"),
        meta.alias("meta"),
        meta_json.alias("meta_json"),
    ]
    if "seq" in docs.columns:
        columns.append(F.col("seq"))
    return docs.select(columns)


def one_document(
    spark: SparkSession, content: str, meta: str | None = None, doc_id: int | None = None
) -> DataFrame:
    """A single document as a table of one row; `meta` is JSON text."""
    return spark.createDataFrame(
        [(doc_id, content, meta)], "id bigint, content string, meta string"
    )

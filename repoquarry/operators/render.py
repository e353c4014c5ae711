"""Search results as Markdown, one text per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.text import or_default
from repoquarry.params import NO_RESULTS, UNKNOWN_REPO


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"**{label}:** "), value.cast("string"))


def result_text(rank: Column, repo_url: Column, meta: Column, content: Column) -> Column:
    """Fixed format of one result. Lines whose value is NULL are left out."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### Result "), rank.cast("string")),
        _line("Repository", or_default(repo_url, UNKNOWN_REPO)),
        _line("File", meta["file_path"]),
        _line("Language", meta["language"]),
        _line("Chunk", meta["chunk_index"]),
        F.lit("\n**Content:**"),
        F.lit("```"),
        F.coalesce(content, F.lit("")),
        F.lit("```"),
        F.lit(""),
    )


def render_results(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, rendered) for every query, from
    `results(query_id, rank, repo_url, meta, content)` of a top-k search."""
    text = result_text(F.col("rank"), F.col("repo_url"), F.col("meta"), F.col("content"))
    # A query has k results, so this gathers k texts per row.
    texts = (
        results.groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))).alias("found"))
        .select(
            "query_id",
            F.array_join(F.transform("found", lambda r: r["t"]), "\n").alias("rendered"),
        )
    )
    return (
        queries.select("query_id")
        .join(texts, "query_id", "left")
        .withColumn("rendered", F.coalesce("rendered", F.lit(NO_RESULTS)))
    )

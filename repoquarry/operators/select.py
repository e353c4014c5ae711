"""Choosing files: ignored paths, decisions, texts and their failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.paths import is_ignored, is_notebook, is_repo_url, language, suffix
from repoquarry.functions.text import decode_text, is_blank, notebook_text
from repoquarry.params import BINARY_SUFFIXES


def listed(files: DataFrame) -> DataFrame:
    """Drop files on ignored paths; these are not counted anywhere."""
    return files.where(~is_ignored(F.col("rel")))


def decision(rel: Column, size: Column, max_bytes: int) -> Column:
    """Whether to read a file, and why not, by name and size only."""
    reason = (
        F.when(suffix(rel).isin(*BINARY_SUFFIXES), "binary")
        .when(size > max_bytes, "too_large")
        .when(size.isNull(), "ignored")
        .otherwise("ok")
    )
    return F.struct((reason == "ok").alias("include"), reason.alias("reason"))


def decide(files: DataFrame, max_bytes: int) -> DataFrame:
    return files.withColumn("decision", decision(F.col("rel"), F.col("size"), max_bytes))


def with_texts(files: DataFrame) -> DataFrame:
    """Add `text`, `language` and `error` to read files.

    A file that could not be read, or a notebook that could not be parsed, has an
    error and no text; the others go on.
    """
    notebook = is_notebook(F.col("rel"))
    text = F.when(notebook, notebook_text(F.col("content"))).otherwise(
        decode_text(F.col("content"))
    )
    error = F.coalesce(
        F.col("error"),
        F.when(F.col("content").isNull(), "file was not read"),
        F.when(notebook & F.col("text").isNull(), "notebook could not be parsed"),
    )
    return (
        files.withColumn("text", F.when(F.col("error").isNull(), text))
        .withColumn("language", language(F.col("rel")))
        .withColumn("error", error)
        .drop("content")
    )


def file_state(reason: Column, error: Column, text: Column) -> Column:
    """What became of a listed file: skipped, failed, blank or kept. One that could not
    be listed has an error and no size."""
    unlisted = (reason == "ignored") & error.isNotNull()
    return (
        F.when((reason != "ok") & ~unlisted, "skipped")
        .when(error.isNotNull(), "failed")
        .when(is_blank(text), "blank")
        .otherwise("kept")
    )


def split_repo_urls(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest rows with a valid repository URL that is there once, and the others."""
    twice = manifest.groupBy("repo_url").count().where("count > 1").select("repo_url")
    known = manifest.join(twice.withColumn("_twice", F.lit(True)), "repo_url", "left")
    valid = F.coalesce(is_repo_url(F.col("repo_url")), F.lit(False)) & F.col("_twice").isNull()
    good, bad = known.where(valid), known.where(~valid)
    return good.select(manifest.columns), bad.select(manifest.columns)


def file_counts(states: DataFrame) -> DataFrame:
    """Counts of listed files per repository, from (repo_url, commit, reason, state)."""
    return states.groupBy("repo_url").agg(
        F.first("commit", ignorenulls=True).alias("commit"),
        F.count("*").alias("total_files"),
        (F.count_if(F.col("reason") == "ok") - F.count_if(F.col("state") == "blank")).alias(
            "processed_files"
        ),
        F.count_if(F.col("reason") == "binary").alias("skipped_binary"),
        F.count_if(F.col("reason") == "too_large").alias("skipped_large"),
        F.count_if(F.col("state") == "blank").alias("skipped_empty"),
        F.count_if(F.col("state") == "failed").alias("failed_files"),
    )

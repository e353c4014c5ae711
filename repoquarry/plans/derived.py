"""Inputs that Spark derives from the driver's tables for the registered queries."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.functions.paths import language
from repoquarry.session import scratch_path, spread

SUFFIXES = (".py", ".md", ".js", ".png", ".java", "")


_TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    return spread(rows, _TEXT_KEYS[name]) if name in _TEXT_KEYS else rows


def commit_of(source: Column) -> Column:
    return F.md5(source)


def file_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: (doc_id, lang, repo_url, commit, rel, size, text)."""
    kinds = F.array(*[F.lit(s) for s in SUFFIXES])
    suffix = F.element_at(kinds, (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id",
        "lang",
        F.col("source").alias("repo_url"),
        commit_of(F.col("source")).alias("commit"),
        F.concat("lang", F.lit("/f"), "doc_id", suffix).alias("rel"),
        F.octet_length("text").cast("bigint").alias("size"),
        "text",
    )


def repo_texts(spark: SparkSession, sf: str) -> DataFrame:
    files = file_rows(spark, sf)
    return files.select("repo_url", "rel", language(F.col("rel")).alias("language"), "text")


def files_in_table(spark: SparkSession, sf: str, suffix: str | None = None) -> DataFrame:
    """Files with their bytes, as a scan would bring them; with `suffix`, all of one
    kind."""
    files = file_rows(spark, sf)
    if suffix is not None:
        files = files.withColumn("rel", F.concat("lang", F.lit("/f"), "doc_id", F.lit(suffix)))
    return files.select(
        "repo_url",
        "commit",
        "rel",
        "size",
        F.encode("text", "utf-8").alias("content"),
        F.lit(None).cast("string").alias("error"),
    )


def nested_path(doc_id: Column, rel: Column) -> Column:
    """Paths that have, and nearly have, ignored parts."""
    heads = ["", ".git/", "a/node_modules/", "Build/", "build/", "x.egg-info/", ".env/", "a.git/"]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (doc_id % len(heads) + 1).cast("int"))
    return F.concat(head, rel)


def url_of(doc_id: Column) -> Column:
    heads = ["https://github.com/o/r", "git@github.com:o/r", "http://github.com/o/r", "ftp://x/"]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (doc_id % len(heads) + 1).cast("int"))
    return F.concat(head, doc_id)


def notebooks(docs: DataFrame) -> DataFrame:
    """A notebook per document: a code cell with a list of lines, a blank cell, and
    the text again as markdown and as a raw cell."""
    lines = F.split("text", "\n", -1)
    source = F.transform(lines, lambda x: F.concat(x, F.lit("\n")))
    code = F.to_json(F.struct(F.lit("code").alias("cell_type"), source.alias("source")))
    blank = F.lit('{"cell_type":"code","source":" \\n"}')
    mark = F.to_json(F.struct(F.lit("markdown").alias("cell_type"), F.col("text").alias("source")))
    raw = F.to_json(F.struct(F.lit("raw").alias("cell_type"), F.col("text").alias("source")))
    cells = F.concat_ws(",", code, blank, mark, raw)
    book = F.concat(F.lit('{"cells":['), cells, F.lit('],"nbformat":4,"nbformat_minor":5}'))
    return docs.select("doc_id", "lang", book.alias("json"))


def code_like(docs: DataFrame) -> DataFrame:
    """Texts with lines that open declarations between their own lines."""
    inner = F.regexp_replace("text", "\n", "\n    def f(self):\n        ")
    code = F.concat(
        F.lit("import x\n@dec\nclass A(B):\n    "),
        inner,
        F.lit("\ndef last():\n    "),
        F.substring_index("text", "\n", 1),
    )
    return docs.select("doc_id", "source", code.alias("text"))


_WRITE_ROWS = 64  # texts in Python at once


def _writer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _WRITE_ROWS):
                part = batch.slice(start, _WRITE_ROWS)
                for repo_url, rel, text in zip(*(part.column(c).to_pylist() for c in ("repo_url", "rel", "text"))):
                    path = os.path.join(root, repo_url, rel)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(path, "w", encoding="utf-8", newline="") as file:
                        file.write(text)
            yield batch.select(["repo_url", "commit"])

    return run


def write_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Write the documents as files, a folder per source, by the executors; returns
    the manifest of the snapshots."""
    root = scratch_path(spark, "snapshots").removeprefix("file://").removeprefix("file:")
    if "://" in root:
        raise RuntimeError(f"snapshots are files below a mounted folder, not in {root}")
    url = F.concat(F.lit("https://github.com/o/"), "repo_url")
    written = (
        file_rows(spark, sf)
        .select("repo_url", "commit", "rel", "text")
        .mapInArrow(_writer(root), "repo_url string, commit string")
        .distinct()
    )
    path = scratch_path(spark, "manifest")
    written.select(
        url.alias("repo_url"), "commit", F.concat(F.lit(root + "/"), "repo_url").alias("root")
    ).write.parquet(path)
    return spark.read.parquet(path)

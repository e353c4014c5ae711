"""Exact deduplication of chunks within a repository, and their numbers.

The order that decides is (first path of the language group, unit, position). A
unit is a file, or a window of a group; it brings its chunks as an array and their
digests as another. Only digests are shuffled to find the first of equal chunks:
copies collapse before the shuffle, so a chunk that makes up a third of all rows is
harmless. Texts move once, when the numbers come back to their units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.operators.numbering import running_totals
from repoquarry.session import explode_all

UNIT = ["repo_url", "label", "unit"]


def digests(chunks: Column) -> Column:
    """SHA-256 of each chunk; chunks are equal when their digests are."""
    return F.transform(chunks, lambda c: F.unhex(F.sha2(c, 256)))


def first_of_equals(units: DataFrame, groups: DataFrame) -> DataFrame:
    """Positions kept in each unit: `units(repo_url, label, unit, digests)` and
    `groups(repo_url, label, first_rel)` to `(repo_url, first_rel, label, unit, keep)`."""
    placed = units.select(*UNIT, "digests").join(
        groups.select("repo_url", "label", "first_rel"), ["repo_url", "label"]
    )
    chunks = placed.select(
        "repo_url", "first_rel", "label", "unit", explode_all(F.col("digests")).alias("pos", "digest")
    )
    winners = chunks.groupBy("repo_url", "digest").agg(
        F.min(F.struct("first_rel", "label", "unit", "pos")).alias("at")
    )
    return winners.groupBy("repo_url", "at.first_rel", "at.label", "at.unit").agg(
        F.sort_array(F.collect_list("at.pos")).alias("keep")
    )


def number_kept(kept: DataFrame) -> DataFrame:
    """Add to each unit the index of its first kept chunk in the repository, the
    repository's number of chunks, and the number of all chunks before it."""
    return running_totals(
        kept,
        ["repo_url"],
        ["first_rel", "label", "unit"],
        F.size("keep"),
        before="first_index",
        total="total_chunks",
        before_all="chunks_before",
    )


def kept_chunks(units: DataFrame, numbered: DataFrame) -> DataFrame:
    """One row per kept chunk: the unit's columns, `chunk`, `pos`, `chunk_index`,
    `total_chunks` and `ordinal`, its 0-based number among all chunks."""
    own = [c for c in units.columns if c not in ("chunks", "digests")]
    taken = F.transform(
        "keep", lambda p: F.struct(F.get("chunks", p).alias("chunk"), p.alias("pos"))
    )
    return (
        units.drop("digests")
        .join(numbered.drop("first_rel"), UNIT)
        .select(
            *own, "first_index", "chunks_before", "total_chunks", explode_all(taken).alias("nth", "c")
        )
        .select(
            *own,
            "c.chunk",
            "c.pos",
            (F.col("first_index") + F.col("nth")).alias("chunk_index"),
            "total_chunks",
            (F.col("chunks_before") + F.col("nth")).alias("ordinal"),
        )
    )


def duplicate_counts(units: DataFrame) -> DataFrame:
    """Chunks, distinct chunks and duplicates per repository."""
    each = units.select("repo_url", explode_all(F.col("digests")).alias("pos", "digest"))
    copies = each.groupBy("repo_url", "digest").count()
    return copies.groupBy("repo_url").agg(
        F.sum("count").alias("chunks"),
        F.count("*").alias("unique_chunks"),
        (F.sum("count") - F.count("*")).alias("duplicates"),
    )

"""Files of one repository and language treated as one long text.

A group may hold a third of all rows. Its text is never put together: each file is
told at which line of the group it starts, and then cut on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.operators.numbering import number_rows, running_totals
from repoquarry.params import NO_LANGUAGE
from repoquarry.session import explode_all, let

GROUP = ["repo_url", "label"]


def group_label(language: Column) -> Column:
    return F.coalesce(language, F.lit(NO_LANGUAGE))


def language_groups(texts: DataFrame) -> DataFrame:
    """Groups with their size and first path; groups are ordered by that path."""
    return (
        texts.withColumn("label", group_label(F.col("language")))
        .groupBy(*GROUP)
        .agg(F.count("*").alias("files"), F.min("rel").alias("first_rel"))
    )


def line_offsets(texts: DataFrame) -> DataFrame:
    """For every file the number of group lines before it, and the group's total."""
    lines = texts.select(
        "repo_url",
        group_label(F.col("language")).alias("label"),
        "rel",
        (F.regexp_count(F.col("text"), F.lit("\n")) + 1).alias("lines"),
    )
    return running_totals(
        lines, GROUP, ["rel"], F.col("lines"), before="first_line", total="group_lines"
    )


def _with_offsets(texts: DataFrame) -> DataFrame:
    offsets = line_offsets(texts)
    labelled = texts.select(
        "repo_url", group_label(F.col("language")).alias("label"), "rel", "text"
    )
    return labelled.join(offsets, [*GROUP, "rel"])


def group_lines(texts: DataFrame) -> DataFrame:
    """The lines of each group in order: its files joined by newlines, as rows."""
    return _with_offsets(texts).select(
        *GROUP,
        "rel",
        "first_line",
        explode_all(F.split("text", "\n", -1)).alias("pos", "line"),
    ).select(*GROUP, "rel", (F.col("first_line") + F.col("pos")).alias("line_no"), "line")


def group_line_windows(texts: DataFrame, lines: int, overlap: int) -> DataFrame:
    """Line windows over each group's text, one row per window.

    A file sends to every window it touches the lines it has in it, so a window
    gathers at most `lines` parts. `file_paths` names the files they come from.
    """
    stride = lines - overlap
    first, n, total = F.col("first_line"), F.col("lines"), F.col("group_lines")
    last_window = F.ceil(F.greatest(total - overlap, F.lit(1)) / F.lit(stride)) - 1
    low = F.greatest(F.floor((first - lines) / F.lit(stride)) + 1, F.lit(0))
    high = F.least(F.floor((first + n - 1) / F.lit(stride)), last_window)

    def part(own: Column, k: Column) -> Column:
        start = F.greatest(k * stride - first, F.lit(0)).cast("int")
        end = F.least(k * stride + lines - first, n).cast("int")
        return F.struct(
            k.alias("window"), F.array_join(F.slice(own, start + 1, end - start), "\n").alias("t")
        )

    # Every line is in some window, so there is always at least one part.
    parts = let(
        F.split("text", "\n", -1),
        lambda own: F.transform(F.sequence(low, high), lambda k: part(own, k)),
    )
    return (
        _with_offsets(texts)
        .select(*GROUP, "rel", "first_line", explode_all(parts).alias("nth", "p"))
        .groupBy(*GROUP, F.col("p.window").alias("window"))
        .agg(F.sort_array(F.collect_list(F.struct("first_line", "rel", "p.t"))).alias("parts"))
        .select(
            *GROUP,
            "window",
            F.array_join(F.transform("parts", lambda x: x["t"]), "\n").alias("chunk"),
            F.transform("parts", lambda x: x["rel"]).alias("file_paths"),
        )
    )


def path_pages(members: DataFrame, size: int) -> DataFrame:
    """The paths of every group as lists of at most `size`, in order."""
    page = F.floor(F.col("position") / size).alias("page")
    return members.groupBy(*GROUP, page).agg(F.sort_array(F.collect_list("rel")).alias("file_paths"))


def group_files(texts: DataFrame) -> DataFrame:
    """Every path of every group with its position: provenance in group scope."""
    paths = texts.select("repo_url", group_label(F.col("language")).alias("label"), "rel")
    return number_rows(paths, GROUP, ["rel"], "position", "files")

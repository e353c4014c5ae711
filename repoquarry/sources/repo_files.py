"""Scan of repository snapshots: list first, choose by name and size, then read.

The input is a manifest (repo_url, commit, root) of snapshots in storage that every
executor sees. Spark's own file sources skip names starting with a dot or an
underscore, which code has plenty of, so executors walk the folders themselves. A
large repository is listed by many tasks, a folder each, and read by many more.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.params import IGNORED_NAMES
from repoquarry.session import materialise, tasks_for

_LISTED = (
    "repo_url string, commit string, root string, rel string, size bigint, error string,"
    " folder boolean"
)
_LIST_ROWS = 10_000
_READ_ROWS = 256
_READ_BYTES = 8 << 20
_FILES_PER_TASK = 64  # at least, while there are fewer files than all slots could read
_FOLDERS_PER_TASK = 1000  # at most


def _shown(path: str) -> str:
    """A path as text; bytes that are not UTF-8 show as U+FFFD. Such a file is
    listed, and its read then fails like that of any missing file."""
    return path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _error(exc: OSError) -> str:
    return f"{type(exc).__name__}: {exc.strerror}"


def _scan(folder: str) -> Iterator[os.DirEntry | OSError]:
    """Entries of a folder one by one; the error, last, if it cannot be listed to its end."""
    try:
        with os.scandir(folder) as entries:
            yield from entries
    except OSError as exc:
        yield exc


def _entries(
    root: str, rel: str, deep: bool
) -> Iterator[tuple[str, int | None, str | None, bool]]:
    """Regular files below a folder, hidden ones included; links to folders are not
    followed. Folders whose name is ignored are not entered. Unless `deep`,
    subfolders are returned for another task instead of being entered. What cannot be
    listed is an entry with an error; the root is then shown as a dot."""
    pending = [rel]
    while pending:
        folder = pending.pop()
        for entry in _scan(os.path.join(root, folder)):
            if isinstance(entry, OSError):
                yield _shown(folder) or ".", None, _error(entry), False
                continue
            path = f"{folder}/{entry.name}" if folder else entry.name
            try:
                if entry.is_dir(follow_symlinks=False):
                    if entry.name in IGNORED_NAMES:
                        continue
                    if deep or _shown(path) != path:
                        pending.append(path)
                    else:
                        yield path, None, None, True
                    continue
                found = entry.stat()
            except FileNotFoundError:
                continue  # a link to nothing, or gone since
            except OSError as exc:
                yield _shown(path), None, _error(exc), False
                continue
            if stat.S_ISREG(found.st_mode):
                yield _shown(path), found.st_size, None, False


def _lister(deep: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                for found in batched(_entries(row.root, row.rel, deep), _LIST_ROWS):
                    rel, size, error, folder = zip(*found, strict=True)
                    yield pd.DataFrame(
                        {
                            "repo_url": row.repo_url,
                            "commit": row.commit,
                            "root": row.root,
                            "rel": pd.Series(rel, dtype=object),
                            "size": pd.Series(size, dtype="Int64"),
                            "error": pd.Series(error, dtype=object),
                            "folder": pd.Series(folder, dtype=bool),
                        }
                    )

    return run


def list_files(manifest: DataFrame, split_levels: int = 2) -> DataFrame:
    """Files of every snapshot: (repo_url, commit, root, rel, size, error). A folder, root
    or file that cannot be listed is a row with an error and no size.

    The upper `split_levels` folder levels are listed one level at a time, so that
    the folders below them become tasks of their own. Each level is written, and so
    is listed once.
    """
    spark = manifest.sparkSession
    folders = manifest.select("repo_url", "commit", "root", F.lit("").alias("rel"))
    files = manifest.sparkSession.createDataFrame([], _LISTED).drop("folder")
    for level in range(split_levels + 1):
        count = folders.count()
        if not count:
            break
        # Names are small and listing is slow: the number of tasks goes by folders.
        tasks = max(tasks_for(spark, count, 0), -(-count // _FOLDERS_PER_TASK))
        spread = folders.repartition(tasks, "root", "rel")
        found = materialise(
            spread.mapInPandas(_lister(deep=level == split_levels), _LISTED), "listing"
        )
        files = files.unionByName(found.where(~F.col("folder")).drop("folder"))
        folders = found.where("folder").select("repo_url", "commit", "root", "rel")
    return files


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # A batch holds names only; contents go out as soon as they are a few hundred files
        # or a few megabytes.
        start, contents, errors, held = 0, [], [], 0
        for n, (root, rel) in enumerate(zip(batch["root"], batch["rel"], strict=True), 1):
            try:
                with open(os.path.join(root, rel), "rb") as file:
                    contents.append(file.read())
                held += len(contents[-1])
                errors.append(None)
            except OSError as exc:
                contents.append(None)
                errors.append(_error(exc))
            if n == len(batch) or n - start >= _READ_ROWS or held >= _READ_BYTES:
                part = batch.iloc[start:n].drop(columns=["root", "error"], errors="ignore")
                yield part.assign(content=contents, error=errors)
                start, contents, errors, held = n, [], [], 0


def read_files(files: DataFrame) -> DataFrame:
    """Add `content` and `error` to listed files; a failed read is a row with an error.

    Files are spread evenly by path, so one large repository is read by all tasks.
    """
    count, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = tasks_for(files.sparkSession, count // _FILES_PER_TASK, size)
    kept = [f for f in files.schema.fields if f.name not in ("root", "error")]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    spread = files.repartition(tasks, "repo_url", "rel")
    return spread.mapInPandas(_read, f"{columns}, content binary, error string")

"""Column functions over relative paths and repository URLs."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoquarry.params import IGNORED_NAMES, LANGUAGE_OF_SUFFIX, REPO_URL_PREFIXES

_IGNORED = "(?:^|/)(?:" + "|".join(re.escape(name) for name in IGNORED_NAMES) + r")(?:/|\z)"


def suffix(path: Column) -> Column:
    """Lower-cased last suffix of the file name; '' for none and for dotfiles."""
    return F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)\z", 1))


def language(path: Column) -> Column:
    """Language of a path by its suffix, NULL when unknown."""
    pairs = [F.lit(x) for pair in LANGUAGE_OF_SUFFIX.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), suffix(path))


def is_notebook(path: Column) -> Column:
    return suffix(path) == ".ipynb"


def is_ignored(rel: Column) -> Column:
    """True if any part of the path is an ignored name, or if there is no path
    under the root at all."""
    return F.coalesce(rel.rlike(_IGNORED), F.lit(True))


def relative_to(path: Column, root: Column) -> Column:
    """Path below `root`, NULL when it lies outside."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(
        F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))
    )


def is_repo_url(url: Column) -> Column:
    return F.coalesce(
        reduce(or_, (F.startswith(url, F.lit(p)) for p in REPO_URL_PREFIXES)), F.lit(False)
    )


def repo_bucket(repo_url: Column, buckets: int) -> Column:
    """Partition column of the index. A NULL URL has a bucket of its own kind:
    the hash of NULL is the hash seed, so it stays an ordinary value."""
    return F.pmod(F.xxhash64(repo_url), F.lit(buckets)).cast("int")

"""URL rules found through the rarest literal token of each rule.

A rule is a regular expression with the literal tokens that every match has to hold. It
is posted under the one of them that the fewest URLs have. A URL looks up its own tokens
and runs only the expressions posted there. A rule without tokens is posted under the
empty token, which every URL looks up.

Defined cases: a null URL and one without `://` have an empty host and path, and match
only rules whose expression allows that. Repeated rows get equal answers. An empty table
gives an empty result. Other columns pass through, whatever their names; a column named
like one of the four results is replaced by it. Of several rules that match, the higher
`rank` wins, then the longer name, then the greater name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.llm.common import lower_ascii

RULE_SCHEMA = "name string, pattern string, verdict string, rank int, tokens array<string>"
RESULTS = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class Rule:
    """`pattern` is searched in `.host` + path; `tokens` are runs of a-z and 0-9 that
    stand between other characters, or at an end, in every string it matches."""

    name: str
    pattern: str
    verdict: str
    rank: int
    tokens: tuple[str, ...] = ()


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, all its subdomains, and the paths that start with `path`."""
    pieces = path.lower().split("/")
    whole = re.split(r"[^a-z0-9]+", "/".join(pieces[:-1]))  # the last may go on in the URL
    tokens = [t for t in (*re.split(r"[^a-z0-9]+", host), *whole) if t]
    after = re.escape(path) if path else "(?:/|$)"
    return Rule(host + path, rf"^[^/]*\.{re.escape(host)}{after}", verdict, 1, tuple(tokens))


def word_rule(*words: str, verdict: str = "block") -> Rule:
    """A rule for URLs that have these words next to each other."""
    between = r"[^A-Za-z0-9]+"
    body = between.join(re.escape(w) for w in words)
    pattern = rf"(?i)(?:^|[^A-Za-z0-9]){body}(?:[^A-Za-z0-9]|$)"
    return Rule(" ".join(words), pattern, verdict, 0, tuple(w.lower() for w in words))


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table, from one JSON literal, which the JVM reads."""
    import json

    rows = [r.__dict__ | {"tokens": list(r.tokens)} for r in rules]
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_struct(RULE_SCHEMA)}>>")
    return spark.range(1).select(F.inline(parsed))


def _struct(schema: str) -> str:
    return ", ".join(f"{p.split(' ', 1)[0]}: {p.split(' ', 1)[1]}" for p in schema.split(", "))


def _tokens(target: Column) -> Column:
    """All tokens of a URL once, with the empty one."""
    found = F.split(lower_ascii(target), "[^a-z0-9]+")
    return F.array_distinct(F.concat(found, F.array(F.lit(""))))


def token_index(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, name, pattern, verdict, rank): each rule once, under its rarest token.

    `keys` has the URLs' `_tokens`. Counts are summed in the tasks before they move.
    """
    token = F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(""))))
    posted = rules.select("name", "pattern", "verdict", "rank", token.alias("token"))
    seen = (
        keys.select(F.explode("_tokens").alias("token"))
        .join(posted.select("token").distinct(), "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = posted.join(seen, "token", "left")
    least = F.min(F.struct(F.coalesce("_n", F.lit(0)), F.col("token")))
    best = ranked.groupBy("name", "pattern", "verdict", "rank").agg(least["token"].alias("token"))
    return best.select("token", "name", "pattern", "verdict", "rank")


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, and `rule` and `verdict` of the best match, null without one.

    Equal URLs are judged once, so a URL that many rows share costs little.
    """
    whole = urls.select(F.struct("*").alias("_row"), F.col(url).cast("string").alias("_url"))
    target = F.concat(F.lit("."), host_of(F.col("_url")), path_of(F.col("_url")))
    keys = (
        whole.select("_url").distinct().withColumn("_target", target)
        .withColumn("_tokens", _tokens(F.col("_target")))
    )
    index = token_index(keys, rules)
    best = F.max(F.struct("rank", F.length("name").alias("n"), "name", "verdict")).alias("_best")
    hits = (
        keys.select("_url", "_target", F.explode("_tokens").alias("token"))
        .join(index, "token")
        .where(F.regexp_like("_target", F.col("pattern")))
        .groupBy("_url")
        .agg(best)
        .withColumnRenamed("_url", "_hit_url")
    )
    joined = whole.join(hits, F.col("_url").eqNullSafe(F.col("_hit_url")), "left")
    kept = [F.col("_row")[c].alias(c) for c in urls.columns if c.lower() not in RESULTS]
    return joined.select(
        *kept,
        host_of(F.col("_url")).alias("host"),
        path_of(F.col("_url")).alias("path"),
        F.col("_best.name").alias("rule"),
        F.col("_best.verdict").alias("verdict"),
        F.col("_best.rank").alias("_rank"),
    )

"""Token counting and the token hash of the offline embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A run of letters, digits and underscores, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# The same, never giving back characters of a token once matched.
TOKEN_ATOMIC = r"[\p{L}\p{N}_]++|[^\p{L}\p{N}_\s]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def token_bucket(token: Column, dim: int) -> Column:
    """Dimension of a token: first 32 bits of its MD5, modulo `dim`."""
    head = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(dim)).cast("int")

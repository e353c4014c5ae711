"""Placement of rows on shards through a permutation-filled lookup table.

Every shard has its own order of the slots of a prime-sized table. The shards take turns,
each claiming the first slot of its order that is still free, until all are claimed. A row
hashes to a slot, and the table, broadcast, names its shard. Shards get equal shares of
the slots (within one, or by weight), and a shard that leaves moves few other rows.

The table is a setting, not data: it has `size` entries (65,537 by default) however many
rows there are, is filled on the driver in about size * ln(size) steps, and is broadcast.

Defined cases: rows with a null key are placed by `spread` columns, so that they do not
meet on one shard; equal rows go to one shard. An empty table gives an empty result. Other
columns pass through; one named `slot` or `shard` is replaced by the result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
MAX_TABLE_SIZE = 1_000_003  # what may be broadcast: two numbers an entry


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None):
    """The shard number of each slot. A shard with weight w takes w turns a round."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE_SIZE:
        raise ValueError(f"{size} slots: a prime between the shards and {MAX_TABLE_SIZE} is needed")
    turns = weights or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("one weight of at least 1 for each shard")
    at, step = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % size)
        step.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1 if size > 2 else 1)
    owner = [-1] * size
    free = size
    while free:
        for shard, times in enumerate(turns):
            for _ in range(min(times, free)):
                while owner[at[shard]] >= 0:
                    at[shard] = (at[shard] + step[shard]) % size
                owner[at[shard]] = shard
                free -= 1
    return owner


def table_frame(spark: SparkSession, owner: list[int]) -> DataFrame:
    """(slot, shard) from one string literal, which the JVM splits."""
    entries = F.split(F.lit(",".join(map(str, owner))), ",")
    return spark.range(1).select(F.posexplode(entries).alias("slot", "shard")).select(
        F.col("slot").cast("bigint"), F.col("shard").cast("int")
    )


def slot_of(key: str, spread: list[str], size: int):
    """The slot of a row: of its key, or of its `spread` columns where that is null."""
    other = F.xxhash64(F.lit("null"), *[F.col(c) for c in spread])
    hashed = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))).otherwise(other)
    return F.pmod(hashed, F.lit(size))


def place(
    rows: DataFrame,
    key: str,
    shards: list[str],
    size: int = TABLE_SIZE,
    weights: list[int] | None = None,
    spread: tuple[str, ...] = (),
) -> DataFrame:
    """Add the `slot` and `shard` of every row; no shuffle."""
    owner = lookup_table(shards, size, weights)
    found = table_frame(rows.sparkSession, owner).select(
        F.col("slot").alias("_slot"), F.col("shard").alias("_shard")
    )
    kept = [c for c in rows.columns if c.lower() not in ("slot", "shard")]
    placed = rows.select(F.struct("*").alias("_r"), slot_of(key, list(spread), size).alias("_at"))
    joined = placed.join(F.broadcast(found), F.col("_at") == F.col("_slot"), "left")
    return joined.select(
        *[F.col("_r")[c].alias(c) for c in kept],
        F.col("_at").alias("slot"),
        F.col("_shard").alias("shard"),
    )


def write_shards(placed: DataFrame, path: str, parts: int = 1, format: str = "parquet") -> None:
    """Write a folder for each shard, each by `parts` tasks, so that a shard with many
    rows is not one task's work. Rows spread by their whole content."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in placed.columns]), F.lit(parts))
    placed.repartition("shard", salt).write.partitionBy("shard").format(format).save(path)

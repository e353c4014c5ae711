"""Approximate nearest neighbours by an index of pivot permutations.

A vector is represented by the order of its `prefix` nearest pivots. Vectors are dealt to
blocks of bounded size, and in each block every pivot has an inverted file: the vectors
that name it and at which place. A query walks the files of its own pivots and sums, for
each vector, how far the places of shared pivots lie apart; pivots that only one of the two
names count as if they were at place `prefix`. This is the footrule distance. The share of
each block that is nearest by it is measured exactly.

The pivots are the index's only sample: `pivots` vectors, those of smallest hash. All rows
are indexed. What is measured exactly is a share of the rows, `rerank`, not a number, so
recall does not fall as the table grows; a block of up to `least` rows is measured whole.

Defined cases: vectors that are null, of zero length, of another dimension than most, or
hold null or non-finite components take no part, neither as queries nor as candidates.
Rows that repeat an id are rows of their own; a query leaves out its own row alone. Ties go
to the smaller id. A table without queries gives an empty result. Other columns are not
read.

A query set meets all blocks: the work is queries x vectors / blocks of small matrix steps,
and each block hands on k rows a query. Single vectors are dealt to blocks and each query is
copied to every block; a task gathers one block, then streams the queries past it, so a block
moves once (or, where there are fewer blocks than slots, once for each slice of the queries).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.operators.search import matrix, per_group
from repoquarry.session import materialise, task_count

PIVOTS = 256
PREFIX = 64
BLOCK_ROWS = 4096
ORDER_ROWS = 4096  # vectors ordered at once
RERANK = 0.12
LEAST = 256


def usable(vector: Column, dim: int) -> Column:
    """The vector as doubles if it takes part, else null."""
    doubles = vector.cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    nonzero = F.exists(doubles, lambda x: x != 0)
    return F.when((F.size(doubles) == dim) & finite & nonzero, doubles)


def choose_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """Different vectors of smallest hash. Copies are dropped before the smallest are taken, so
    however many there are, only `count` vectors reach the driver."""
    hashed = vectors.select("_v", F.xxhash64("_v").alias("_h"))
    few = [r._h for r in hashed.select("_h").distinct().orderBy("_h").limit(count).collect()]
    kept = hashed.where(F.col("_h").isin(few)).groupBy("_h").agg(F.first("_v").alias("_v"))
    rows = dict.fromkeys(tuple(r._v) for r in sorted(kept.collect(), key=lambda r: r._h))
    return np.array(list(rows), dtype=np.float64)


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, nearest first."""
    gaps = (pivots**2).sum(1) - 2 * vectors @ pivots.T
    return np.argsort(gaps, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def _ordered(pivots: np.ndarray, prefix: int):
    """Function for mapInArrow that adds `_order` to (_id, _key, _v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ORDER_ROWS):
                part = batch.slice(start, ORDER_ROWS)
                order = orders(matrix(part.column("_v"), pivots.shape[1]), pivots, prefix)
                offsets = np.arange(len(order) + 1, dtype=np.int32) * prefix
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "_order"])

    return run


def inverted_files(order: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot the rows that name it, and the place they give it."""
    rows, places = np.divmod(np.arange(order.size), order.shape[1])
    named = order.ravel()
    by_pivot = np.argsort(named, kind="stable")
    cuts = np.searchsorted(named[by_pivot], np.arange(pivots + 1))
    return [
        (rows[by_pivot[a:b]], places[by_pivot[a:b]].astype(np.int32))
        for a, b in zip(cuts[:-1], cuts[1:])
    ]


def footrules(order: np.ndarray, files, size: int) -> np.ndarray:
    """The footrule distance of one query to all rows of a block."""
    prefix = len(order)
    # Sharing no pivot costs the sum of both sides' places to the end.
    total = np.full(size, prefix * (prefix + 1), np.int32)
    for place, pivot in enumerate(order):
        rows, places = files[pivot]
        total[rows] += np.abs(places - place) - (prefix - place) - (prefix - places)
    return total


_GROUP = ["_block", "_slice", "_asking"]
_FOUND = "_query long, query_id long, vec_id long, _key long, score double"


def _searcher(pivots: int, prefix: int, dim: int, k: int, share: float, least: int):
    """Function for mapInArrow over (_block, _slice, _asking, _id, _key, _v, _order), sorted so
    that the vectors of a block come before its queries."""

    def arrays(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        keys, ids = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "_id"))
        return keys, ids, matrix(part.column("_v"), dim), matrix(part.column("_order"), prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for batch in batches:
            for (*group, asking), part in per_group(batch, _GROUP):
                if group != current:
                    current, held, block = group, [], None
                if not asking:
                    held.append(arrays(part))
                    continue
                if block is None:
                    if not held:
                        continue  # no vector fell into this block
                    keys, ids, vectors, order = (np.concatenate(c) for c in zip(*held))
                    block, held = (keys, ids, vectors, inverted_files(order, pivots)), []
                yield _best(block, arrays(part), k, max(least, int(np.ceil(share * len(block[0])))))

    return run


def _best(block, queries, k: int, depth: int) -> pa.RecordBatch:
    """The k nearest found in a block of each query."""
    keys, ids, vectors, files = block
    out = []
    for key, own, asked, order in zip(*queries):
        near = np.arange(len(keys))
        if depth < len(keys):
            rank = footrules(order, files, len(keys))
            near = np.flatnonzero(rank <= np.partition(rank, depth - 1)[depth - 1])
        near = near[keys[near] != key]
        # The sum runs in the order of components, the same for every block.
        score = np.sqrt(((vectors[near] - asked) ** 2).sum(axis=1))
        best = np.lexsort((keys[near], ids[near], score))[:k]
        chosen = near[best]
        out.append((np.full(len(best), key), np.full(len(best), own), ids[chosen], keys[chosen], score[best]))
    names = ["_query", "query_id", "vec_id", "_key", "score"]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id",
            vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX,
            rerank: float = RERANK, block_rows: int = BLOCK_ROWS, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query."""
    spark = vectors.sparkSession
    sizes = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count()
    common = sizes.orderBy(F.desc("count"), "n").first()
    dim = common.n if common else 0
    rows = materialise(
        vectors.select(
            F.col(id).cast("bigint").alias("_id"), usable(F.col(vector), dim).alias("_v"),
            is_query.alias("_asks"), F.monotonically_increasing_id().alias("_key"),
        ).where("_v IS NOT NULL AND _id IS NOT NULL"),
        "vectors",
    )
    count, queries = rows.agg(F.count(F.lit(1)), F.coalesce(F.count_if("_asks"), F.lit(0))).first()
    if not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = choose_pivots(rows, pivots)
    prefix = min(prefix, len(chosen))
    blocks = -(-count // block_rows)
    slots = spark.sparkContext.defaultParallelism
    slices = max(1, min(-(-4 * slots // blocks), queries))
    placed = rows.select("_id", "_key", "_v").mapInArrow(
        _ordered(chosen, prefix), "_id long, _key long, _v array<double>, _order array<smallint>"
    )
    asked = rows.where("_asks").select("_id", "_key", "_v").mapInArrow(_ordered(chosen, prefix), placed.schema)
    dealt = lambda n: F.pmod(F.xxhash64("_key"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    shape = ["_block", "_slice", "_asking", "_id", "_key", "_v", "_order"]
    placed = placed.withColumn("_block", dealt(blocks)).withColumn("_slice", every(slices))
    # Another seed: the hash of the key has chosen the block of a query as a vector.
    slice_of = F.pmod(F.xxhash64(F.lit(1), "_key"), F.lit(slices))
    asked = asked.withColumn("_block", every(blocks)).withColumn("_slice", slice_of)
    met = placed.withColumn("_asking", F.lit(0)).select(shape).unionByName(asked.withColumn("_asking", F.lit(1)).select(shape))
    met = met.repartition(max(task_count(spark), min(blocks * slices, 8 * slots)), "_block", "_slice")
    met = met.sortWithinPartitions("_block", "_slice", "_asking")
    found = met.mapInArrow(_searcher(len(chosen), prefix, dim, k, rerank, least), _FOUND)
    order = Window.partitionBy("_query").orderBy("score", "vec_id", "_key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")

"""Exact top-k by cosine distance for whole tables of queries.

Queries and rows are packed into blocks by the executors, and every block of rows meets
every block of queries. A task keeps the best k of each query, with matrix products over a
block, and emits only those. No pair of query and row is ever a row of its own, and nothing
of either table passes through the driver.

How they meet: a few queries, BROADCAST_QUERY_BYTES at most, are packed into blocks that are
broadcast explicitly, and the corpus is never shuffled. More meet on a grid: queries are dealt
to blocks of a bounded size and rows to shards, each query is copied to every shard and each
row to every block (with cells, only those of its cell), and a task takes one (block, shard)
after another: it gathers the queries of the block, then streams the rows past them. Only
single queries and rows are moved and sorted, so no packed block is copied into every row it
meets. The grid is a shuffle keyed by (block, shard); Spark can broadcast neither side on an
estimate.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.session import materialise, task_count

QUERY_BLOCK_BYTES = 16 << 20
BROADCAST_QUERY_BYTES = 4 << 20  # all packed queries, sent to every task and with every packed row
SHARD_ROWS = 1 << 18  # rows of a (block, shard) at most; they are streamed
GRID_PAIRS = 1 << 33  # pairs of a (block, shard) beyond which it is split, while there are slots
_PAIR_BYTES = 32 << 20  # working set when distances are computed in full
_PARTIAL = pa.schema(
    [("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())]
)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim:
        raise ValueError(f"embeddings must all have {dim} dimensions")
    return flat.reshape(len(column), dim)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in 32 bits; a zero vector becomes NaN."""
    wide = vectors.astype(np.float64)
    norms = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (wide / norms).astype(np.float32)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distance of row pairs in 64 bits, NaN for a zero vector. Summed row by
    row, so that equal vectors get equal distances wherever they stand."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1.0 - (a * b).sum(axis=1) / norms


class _Best:
    """The best k rows so far of each query, ordered by distance, then id."""

    def __init__(self, queries: np.ndarray, k: int, max_distance: float | None) -> None:
        self.queries, self.units, self.k = queries, _unit(queries), k
        self.max_distance = max_distance
        # How far a 32-bit product can be from the true one, doubled.
        self.slack = 4 * (queries.shape[1] + 8) * np.finfo(np.float32).eps
        self.limit = np.full(len(queries), np.inf)
        self.q = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.d = np.zeros(0, np.float64)

    def add(self, ids: np.ndarray, vectors: np.ndarray, which: np.ndarray) -> None:
        """Offer rows to the queries at positions `which`."""
        units = _unit(vectors)
        step = max(1, _PAIR_BYTES // (4 * max(1, len(ids))))
        for start in range(0, len(which), step):
            self._add_block(ids, vectors, units, which[start : start + step])

    def _add_block(self, ids, vectors, units, which) -> None:
        rough = 1.0 - self.units[which] @ units.T
        np.nan_to_num(rough, copy=False, nan=np.inf)
        limit = self.limit[which]
        if len(ids) >= self.k:
            limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1])
        if self.max_distance is not None:
            limit = np.minimum(limit, self.max_distance)
        near = rough <= (limit + self.slack)[:, None]
        if near.sum() > 16 * self.k * len(which):
            near &= self._first_copies(ids, vectors)[None, :]
        qs, rows = np.nonzero(near)
        step = max(1, _PAIR_BYTES // (16 * vectors.shape[1]))
        parts = [
            _exact(self.queries[which[qs[s : s + step]]], vectors[rows[s : s + step]])
            for s in range(0, len(qs), step)
        ]
        found = np.concatenate(parts) if parts else np.zeros(0)
        if self.max_distance is not None:
            ok = found <= self.max_distance
            qs, rows, found = qs[ok], rows[ok], found[ok]
        self._keep(which[qs], ids[rows], found)

    def _first_copies(self, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Of equal vectors only the k lowest ids can be among the best k."""
        raw = np.ascontiguousarray(vectors)
        whole_rows = raw.view(np.dtype((np.void, raw.shape[1] * raw.itemsize))).ravel()
        _, group = np.unique(whole_rows, return_inverse=True)
        order = np.lexsort((ids, group))
        sorted_group = group[order]
        first = np.searchsorted(sorted_group, sorted_group, side="left")
        chosen = np.zeros(len(ids), bool)
        chosen[order[np.arange(len(ids)) - first < self.k]] = True
        return chosen

    def _keep(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        q, ids, d = (np.concatenate(p) for p in ((self.q, q), (self.id, ids), (self.d, d)))
        order = np.lexsort((ids, d, q))  # NaN sorts last
        q, ids, d = q[order], ids[order], d[order]
        same = np.zeros(len(q), bool)  # a row met twice, through two cells
        same[1:] = (q[1:] == q[:-1]) & (ids[1:] == ids[:-1])
        q, ids, d = q[~same], ids[~same], d[~same]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = rank < self.k
        self.q, self.id, self.d = q[keep], ids[keep], d[keep]
        full = rank == self.k - 1
        self.limit[q[full]] = np.nan_to_num(d[full], nan=np.inf)


_CHUNK_BYTES = 8 << 20  # vectors of one row of packed vectors
_PACKED = "ids binary, vectors binary, cells binary"
_PACKED_SCHEMA = pa.schema([(name, pa.binary()) for name in ("ids", "vectors", "cells")])


def _width(df: DataFrame) -> type:
    wide = df.schema["embedding"].dataType.elementType.typeName() == "double"
    return np.float64 if wide else np.float32


def _packer(dim: int, rows: int, width: type):
    """Function for mapInArrow from (id, embedding[, cell]) to rows of packed vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                vectors = np.ascontiguousarray(matrix(part.column(1), dim), dtype=width)
                cells = None
                if part.num_columns > 2:
                    cells = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
                packed = [[ids.tobytes()], [vectors.tobytes()], [cells]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p, pa.binary()) for p in packed], schema=_PACKED_SCHEMA
                )

    return run


def _query_packer(dim: int, width: type):
    """Function for applyInPandas from the queries of a block to one packed row. Of cells,
    every query has the same number."""

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["embedding"].map(len)
        if (lengths != dim).any():
            raise ValueError(f"embeddings must all have {dim} dimensions")
        cells = None
        if "cells" in rows:
            cells = np.array([list(c) for c in rows["cells"]], np.int64).tobytes()
        return pd.DataFrame(
            {
                "block": [key[0]],
                "q_ids": [rows["query_id"].to_numpy(np.int64).tobytes()],
                "q_vectors": [np.stack(rows["embedding"].to_list()).astype(width).tobytes()],
                "q_cells": [cells],
            }
        )

    return run


def _searcher(dim: int, k: int, max_distance: float | None, width: type, q_width: type):
    """Function for mapInArrow over (block, packed vectors, packed queries). Rows of one
    block that follow each other share their best k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, query_ids, members, current = None, None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                block, ids, vectors, cells, q_ids, q_vectors, q_cells = (
                    column[row].as_py() for column in batch.columns
                )
                if block != current:
                    if best is not None:
                        yield _partial(query_ids, best)
                    current, query_ids = block, np.frombuffer(q_ids, np.int64)
                    asked = np.frombuffer(q_vectors, q_width).reshape(-1, dim)
                    best, members = _Best(asked, k, max_distance), None
                    if q_cells is not None:
                        own = np.frombuffer(q_cells, np.int64).reshape(len(query_ids), -1)
                        members = {c: np.flatnonzero((own == c).any(axis=1)) for c in np.unique(own)}
                ids = np.frombuffer(ids, np.int64)
                vectors = np.frombuffer(vectors, width).reshape(-1, dim)
                if members is None:
                    best.add(ids, vectors, np.arange(len(query_ids)))
                    continue
                cells = np.frombuffer(cells, np.int64)
                for cell in np.unique(cells):
                    if cell in members:
                        here = cells == cell
                        best.add(ids[here], vectors[here], members[cell])
        if best is not None:
            yield _partial(query_ids, best)

    return run


def _partial(query_ids: np.ndarray, best: _Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[best.q]), pa.array(best.id), pa.array(best.d)], schema=_PARTIAL
    )


def search_blocks(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    max_distance: float | None = None,
    block_bytes: int = QUERY_BLOCK_BYTES,
    broadcast_bytes: int = BROADCAST_QUERY_BYTES,
) -> DataFrame:
    """Best k of each query in parts of the corpus, (query_id, id, distance).

    `corpus(id, embedding)` and `queries(query_id, embedding)`; with a `cell` of the rows and
    `cells` of the queries, only rows in a query's cells are compared with it. Queries are
    taken in blocks of about `block_bytes`. Every row meets every block: by an explicit
    broadcast of the packed blocks up to `broadcast_bytes`, else on the (block, shard) grid.
    """
    spark = corpus.sparkSession
    n, dim = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return spark.createDataFrame([], _FOUND)
    width, q_width = _width(corpus), _width(queries)
    if n * dim * np.dtype(q_width).itemsize > broadcast_bytes:
        return _search_grid(corpus, queries, n, dim, k, max_distance, block_bytes)
    blocks = -(-n * dim * 4 // block_bytes)
    packed = materialise(
        queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).applyInPandas(
            _query_packer(dim, q_width), "block bigint, q_ids binary, q_vectors binary, q_cells binary"
        ),
        "query-blocks",
    )
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")
    rows = corpus.mapInArrow(_packer(dim, max(1, _CHUNK_BYTES // (4 * dim)), width), _PACKED)
    met = rows.withColumn("block", F.explode(numbers)).join(F.broadcast(packed), "block")
    met = met.select("block", "ids", "vectors", "cells", "q_ids", "q_vectors", "q_cells")
    if blocks > 1:
        met = met.sortWithinPartitions("block")
    return met.mapInArrow(_searcher(dim, k, max_distance, width, q_width), _FOUND)


_FOUND = "query_id bigint, id bigint, distance double"


def per_group(part: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal values of some long columns, in order."""
    keys = np.stack([part.column(name).to_numpy(zero_copy_only=False) for name in names])
    ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), part.num_rows]
    start = 0
    for end in ends:
        if end > start:
            yield tuple(keys[:, start].tolist()), part.slice(start, end - start)
        start = end


_GRID = ["block", "shard", "cell"]


def _grid_searcher(dim: int, k: int, max_distance: float | None, width: type, q_width: type):
    """Function for mapInArrow over (block, shard, cell, is_row, id, embedding), sorted so that
    the queries of a (block, shard, cell) come before its rows."""

    def vectors_of(part: pa.RecordBatch, kind: type) -> tuple[np.ndarray, np.ndarray]:
        ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        return ids, matrix(part.column("embedding"), dim).astype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, asked, best, query_ids = None, [], None, None
        for batch in batches:
            for (*group, is_row), part in per_group(batch, [*_GRID, "is_row"]):
                if group != current:
                    if best is not None:
                        yield from _in_batches(_partial(query_ids, best))
                    current, asked, best = group, [], None
                if not is_row:
                    asked.append(vectors_of(part, q_width))
                    continue
                if best is None:
                    if not asked:
                        continue  # no query of this block
                    query_ids = np.concatenate([ids for ids, _ in asked])
                    best = _Best(np.concatenate([vectors for _, vectors in asked]), k, max_distance)
                    asked = []
                best.add(*vectors_of(part, width), np.arange(len(query_ids)))
        if best is not None:
            yield from _in_batches(_partial(query_ids, best))

    return run


def _in_batches(found: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for start in range(0, found.num_rows, rows):
        yield found.slice(start, rows)


def _search_grid(
    corpus: DataFrame, queries: DataFrame, n: int, dim: int, k: int, max_distance: float | None, block_bytes: int
) -> DataFrame:
    """`search_blocks` on the grid. The blocks and shards of a cell follow its numbers of
    queries and rows: a block is bounded in memory, a shard in rows and, so that all slots
    share a large cell, in pairs."""
    spark = corpus.sparkSession
    width, q_width = _width(corpus), _width(queries)
    block_rows = max(1, block_bytes // (dim * np.dtype(q_width).itemsize))
    celled = "cell" in corpus.columns
    if celled:
        asked = queries.select(F.col("query_id").alias("id"), "embedding", F.explode(F.array_distinct("cells")).alias("cell"))
    else:
        asked = queries.select(F.col("query_id").alias("id"), "embedding", F.lit(0).cast("bigint").alias("cell"))
        corpus = corpus.select("id", "embedding", F.lit(0).cast("bigint").alias("cell"))

    def grid(rows: Column, asking: Column, pairs: Column | int) -> tuple[Column, Column]:
        """Numbers of blocks and of shards of a cell."""
        blocks = F.ceil(asking / F.lit(block_rows))
        # Of all slots a cell gets its share by pairs, but no shards of a few rows each.
        wanted = F.least(F.ceil(rows * asking / F.lit(GRID_PAIRS)), F.lit(1 << 20))
        shared = F.ceil(rows * asking * F.lit(4 * spark.sparkContext.defaultParallelism) / pairs)
        wanted = F.greatest(wanted, F.least(shared, F.ceil(rows / F.lit(_SHARED_ROWS))))
        shards = F.greatest(F.ceil(rows / F.lit(SHARD_ROWS)), F.ceil(wanted / blocks), F.lit(1))
        return blocks.cast("bigint"), shards.cast("bigint")

    if celled:
        sizes = corpus.groupBy("cell").agg(F.count(F.lit(1)).alias("_rows"))
        sizes = sizes.join(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("_asked")), "cell")
        sizes = materialise(sizes, "cell-sizes")
        pairs = sizes.agg(F.sum(F.col("_rows").cast("double") * F.col("_asked"))).first()[0] or 1.0
        blocks, shards = grid(F.col("_rows").cast("double"), F.col("_asked").cast("double"), F.lit(pairs))
        sizes = F.broadcast(sizes.select("cell", blocks.alias("_blocks"), shards.alias("_shards")))
        corpus, asked = corpus.join(sizes, "cell"), asked.join(sizes, "cell")
        blocks, shards = F.col("_blocks"), F.col("_shards")
    else:
        rows = corpus.agg(F.count(F.lit(1))).first()[0]
        blocks, shards = grid(F.lit(float(rows)), F.lit(float(n)), F.lit(max(1.0, float(rows) * n)))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))
    own = lambda count: F.pmod(F.xxhash64("id"), count)
    columns = ["block", "shard", "cell", "is_row", "id", "embedding"]
    kind = "array<double>" if np.float64 in (width, q_width) else "array<float>"
    shape = lambda df, is_row: df.withColumn("is_row", F.lit(is_row)).withColumn("embedding", F.col("embedding").cast(kind)).select(*columns)
    asked = shape(asked.withColumn("block", own(blocks)).withColumn("shard", every(shards)), 0)
    met = shape(corpus.withColumn("shard", own(shards)).withColumn("block", every(blocks)), 1)
    met = asked.unionByName(met).repartition(2 * task_count(spark), "block", "shard", "cell")
    met = met.sortWithinPartitions("block", "shard", "cell", "is_row")
    return met.mapInArrow(_grid_searcher(dim, k, max_distance, width, q_width), _FOUND)


_SHARED_ROWS = 1 << 10  # rows a shard has at least where it is only split to fill slots


def rank_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """The best k of each query with their rank, from partial results."""
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 2,
    max_distance: float | None = None,
    keep_unembedded: bool = False,
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """The k nearest rows of `corpus(id, embedding)` for each row of
    `queries(query_id, embedding)`: (query_id, id, distance, rank).

    Equal distances are ordered by id; a zero vector has distance NaN and comes
    after all numbers. Rows without an embedding are left out, or with
    `keep_unembedded` follow last, with a NULL distance.
    """
    known = corpus.where(F.col("embedding").isNotNull()).select("id", "embedding")
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    result = search_blocks(known, asked, k, max_distance, block_bytes)
    if keep_unembedded:
        # Only the k lowest ids can be needed, for each query alike.
        missing = corpus.where(F.col("embedding").isNull()).select("id").orderBy("id").limit(k)
        last = F.array(*[F.lit(row.id) for row in missing.collect()]).cast("array<bigint>")
        rest = asked.select("query_id", F.explode(last).alias("id"), F.lit(None).cast("double").alias("distance"))
        order = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "id")
        result = result.unionByName(rest)
        return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rank_candidates(result, k)

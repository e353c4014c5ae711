"""Approximate top-k over derived tables that let a search skip most rows.

A derived table holds (id, embedding, cell, part): vectors with equal cells lie near
each other, and `part` is its partition column. A search reads the parts its queries
need, compares a row only with the queries that look into its cell, and ranks as the
exact search does. A cell may hold any share of the rows: it is never gathered, only
scanned, by as many tasks as it has splits.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repoquarry.operators.search import QUERY_BLOCK_BYTES, matrix, per_group, rank_candidates, search_blocks
from repoquarry.session import materialise, task_count
from repoquarry.sources.storage import delete_path

PARTS = 64


def _part(cell: Column) -> Column:
    return F.pmod(F.xxhash64(cell), F.lit(PARTS)).cast("int")


def _write_cells(rows: DataFrame, path: str) -> None:
    (
        rows.withColumn("part", _part(F.col("cell")))
        .hint("rebalance", "part")
        .sortWithinPartitions("part", "cell", "id")
        .write.mode("overwrite")  # of what a failed job has left
        .partitionBy("part")
        .parquet(path)
    )


def _search_cells(
    table: DataFrame, queries: DataFrame, k: int, max_distance: float | None, block_bytes: int
) -> DataFrame:
    """Search with `queries(query_id, embedding, cells)`."""
    asked = materialise(queries.select("query_id", "embedding", "cells"), "asked")
    wanted = asked.select(F.explode("cells").alias("cell")).distinct()
    wanted = materialise(wanted.withColumn("part", _part(F.col("cell"))), "wanted")
    parts = [row.part for row in wanted.select("part").distinct().collect()]  # PARTS at most
    near = table.where(F.col("part").isin(parts)).join(wanted, ["part", "cell"], "left_semi")
    found = search_blocks(near.select("id", "embedding", "cell"), asked, k, max_distance, block_bytes)
    # A row may be found in several tasks, through different cells.
    once = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return rank_candidates(once, k)


def drop_derived(spark: SparkSession, path: str) -> None:
    """Remove a derived search table; the index itself is untouched."""
    delete_path(spark, path)


# --- random projections ------------------------------------------------------


@dataclass(frozen=True)
class Planes:
    """Tables of planes through the origin: a cell is the side of each plane of a table. A
    search reads about tables / 2 ** bits of the rows, the more the more alike they are."""

    dim: int
    tables: int = 6
    bits: int = 6

    def directions(self) -> np.ndarray:
        """+1 and -1 by a rule that any engine can repeat: whether the first hexadecimal
        digit of md5('table:bit:place') is below 8."""
        names = (
            f"{t}:{b}:{i}"
            for t in range(self.tables) for b in range(self.bits) for i in range(self.dim)
        )
        low = [hashlib.md5(name.encode()).hexdigest()[0] < "8" for name in names]
        return np.where(low, 1.0, -1.0).reshape(self.tables * self.bits, self.dim)

    def cells(self):
        """Arrow UDF from a vector to its cells, one per table."""
        planes, weights = self.directions(), 1 << np.arange(self.bits)
        dim, tables, bits = self.dim, self.tables, self.bits

        @F.arrow_udf("array<bigint>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                sides = flat.reshape(-1, dim) @ planes.T >= 0
                codes = sides.reshape(-1, tables, bits) @ weights * tables + np.arange(tables)
                offsets = np.arange(len(batch) + 1, dtype=np.int32) * tables
                values = pa.array(codes.reshape(-1).astype(np.int64))
                yield pa.ListArray.from_arrays(pa.array(offsets), values)

        return run.asNondeterministic()  # so that it runs once for all cells made of it


def write_hashed(rows: DataFrame, path: str, planes: Planes) -> None:
    """Write `rows(id, embedding[, repo_bucket])` a row per table and vector."""
    known = rows.where(F.col("embedding").isNotNull())
    own = [c for c in ("id", "embedding", "repo_bucket") if c in rows.columns]
    hashed = known.select(*own, planes.cells()("embedding").alias("cells"))
    _write_cells(hashed.select(*own, F.explode("cells").alias("cell")), path)


def search_hashed(
    cells: DataFrame,
    queries: DataFrame,
    planes: Planes,
    k: int = 2,
    max_distance: float | None = None,
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """Approximate `nearest` over what `write_hashed` has written."""
    known = queries.where(F.col("embedding").isNotNull())
    asked = known.select("query_id", "embedding", planes.cells()("embedding").alias("cells"))
    return _search_cells(cells, asked, k, max_distance, block_bytes)


def build_lsh(corpus: DataFrame, path: str, tables: int = 6, bits: int = 6) -> None:
    """Write the hashed table of `corpus(id, embedding)` and its setting."""
    known = corpus.where(F.col("embedding").isNotNull())
    first = known.select(F.size("embedding").alias("dim")).first()
    setting = (first.dim if first else 1, tables, bits)
    spark = corpus.sparkSession
    spark.createDataFrame([setting], "dim int, tables int, bits int").write.parquet(f"{path}/hash")
    write_hashed(corpus, f"{path}/cells", Planes(*setting))


def search_lsh(spark: SparkSession, path: str, queries: DataFrame, *args, **options) -> DataFrame:
    """`search_hashed` over a table written by `build_lsh`."""
    planes = Planes(*spark.read.parquet(f"{path}/hash").select("dim", "tables", "bits").first())
    return search_hashed(spark.read.parquet(f"{path}/cells"), queries, planes, *args, **options)


# --- clusters ----------------------------------------------------------------


def _nearest_cells(centres: np.ndarray, n: int):
    """Arrow UDF from a vector to its `n` nearest centres, by cosine distance."""
    norms = np.linalg.norm(centres, axis=1, keepdims=True)
    units = centres / np.where(norms == 0, 1, norms)

    @F.arrow_udf("array<bigint>")
    def cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            likeness = flat.reshape(len(batch), -1) @ units.T if len(batch) else np.zeros((0, n))
            best = np.argsort(-likeness, axis=1, kind="stable")[:, :n].astype(np.int64)
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * best.shape[1]
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(best.reshape(-1)))

    return cells.asNondeterministic()  # so that it runs once for all columns made of it


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return np.array([row.centre for row in rows])


def build_clusters(
    corpus: DataFrame, path: str, cells: int = 256, seed: int = 7, centres: DataFrame | None = None
) -> None:
    """Write `corpus(id, embedding)` clustered into `cells` cells.

    The centres are fitted on all rows, unless `centres(cell, centre)` gives them; every
    row is then assigned and written.
    """
    spark = corpus.sparkSession
    known = corpus.where(F.col("embedding").isNotNull()).select("id", "embedding")
    if centres is None:
        training = known.select(
            array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
        )
        model = KMeans(k=cells, distanceMeasure="cosine", seed=seed, maxIter=10).fit(training)
        fitted = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        centres = spark.createDataFrame(fitted, "cell bigint, centre array<double>")
    centres = centres.select("cell", F.col("centre").cast("array<double>"))
    centres.coalesce(1).write.parquet(f"{path}/centres")
    assign = _nearest_cells(_centres(spark, path), 1)
    assigned = known.withColumn("cell", F.get(assign("embedding"), F.lit(0)))
    _write_cells(assigned, f"{path}/cells")
    _write_radii(spark, path)


def _write_radii(spark: SparkSession, path: str) -> None:
    """(cell, radius, rows): how far, as the chord between unit vectors, the farthest row of
    a cell lies from its centre. A zero vector has no direction: its cell gets radius NaN,
    read as infinite. One row per cell, as many as there are centres."""
    from repoquarry.functions.vector import cosine_distance

    centres = _centres(spark, path)
    placed = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell bigint, centre array<double>"
    )
    rows = spark.read.parquet(f"{path}/cells").select("cell", "embedding")
    chord = F.sqrt(F.lit(2.0) * F.greatest(F.lit(0.0), cosine_distance(F.col("embedding").cast("array<double>"), F.col("centre"))))
    radii = rows.join(F.broadcast(placed), "cell").groupBy("cell").agg(
        F.max(chord).alias("radius"), F.count(F.lit(1)).alias("rows")
    )
    radii.coalesce(1).write.parquet(f"{path}/radii")


def search_clusters(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 2,
    probes: int = 8,
    max_distance: float | None = None,
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """Approximate `nearest` that looks into the `probes` cells nearest each query;
    with all cells probed it is the exact search."""
    probe = _nearest_cells(_centres(spark, path), probes)
    known = queries.where(F.col("embedding").isNotNull())
    return _search_cells(
        spark.read.parquet(f"{path}/cells"),
        known.withColumn("cells", probe("embedding")),
        k,
        max_distance,
        block_bytes,
    )


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def _cells_to_prove(centres: np.ndarray, radii: np.ndarray, probes: int):
    """Arrow UDF from (vector, k-th distance found) to the cells beyond the `probes`
    nearest that may still hold a row within that distance: by the triangle inequality a
    row of cell c lies at a chord of at least |q - c| - radius(c) from the query, that is a
    cosine distance of at least its square over two."""
    units = _unit(centres)
    radii = np.where(np.isnan(radii), np.inf, radii)

    @F.arrow_udf("array<bigint>")
    def cells(vectors: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        limits = found.to_numpy(zero_copy_only=False)
        for vector, limit in zip(vectors.to_pylist(), limits):
            v = np.asarray(vector, np.float64)
            raw = units @ v
            order = np.argsort(-raw, kind="stable")  # as the probes were chosen
            norm = np.linalg.norm(v)
            if norm == 0 or np.isnan(limit):  # no direction: every cell
                out.append([int(c) for c in order[probes:]])
                continue
            chord = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * raw / norm))
            lower = np.maximum(0.0, chord - radii) ** 2 / 2
            out.append([int(c) for c in order[probes:] if lower[c] <= limit + 1e-9])
        return pa.array(out, pa.list_(pa.int64()))

    return cells


def search_clusters_exact(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 2,
    probes: int = 2,
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """The exact `nearest` through the cells of `build_clusters`, with a proof: the
    `probes` nearest cells give each query a k-th distance; then only the cells whose
    radius leaves a row within it are read, and the others cannot hold one.
    (query_id, id, distance, rank, cells_read)."""
    centres = _centres(spark, path)
    radii = {r.cell: r.radius for r in spark.read.parquet(f"{path}/radii").collect()}  # one per centre
    # An empty cell has radius 0 and nothing to find; NaN (a zero vector) is infinite.
    radius = np.array([radii[i] if i in radii else 0.0 for i in range(len(centres))], np.float64)
    radius = np.where(np.isnan(radius), np.inf, radius)
    known = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    first = materialise(search_clusters(spark, path, known, k, probes, block_bytes=block_bytes), "probed")
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_d"))
    limit = F.when(F.col("_n") >= k, F.col("_d")).otherwise(F.lit(float("inf")))
    asked = known.join(kth, "query_id", "left").select("query_id", "embedding", F.coalesce(limit, F.lit(float("inf"))).alias("_limit"))
    more = _cells_to_prove(centres, radius, probes)
    asked = materialise(asked.select("query_id", "embedding", more("embedding", "_limit").alias("cells")), "to-prove")
    read = asked.select("query_id", (F.size("cells") + F.lit(min(probes, len(centres)))).alias("cells_read"))
    widest = asked.agg(F.max(F.size("cells"))).first()[0] or 0
    both = first.drop("rank")
    if widest:
        # A block of queries carries as many cells for each; -1 is a cell without rows.
        padded = F.concat("cells", F.array_repeat(F.lit(-1).cast("bigint"), F.lit(widest) - F.size("cells")))
        wanting = asked.where(F.size("cells") > 0).withColumn("cells", padded)
        second = _search_cells(spark.read.parquet(f"{path}/cells"), wanting, k, None, block_bytes)
        both = both.unionByName(second.drop("rank"))
    return rank_candidates(both, k).join(read, "query_id")


# --- multi-probe hashing -----------------------------------------------------

CELL_ROWS = 8  # rows a cell of one table holds on average


def bits_for(rows: int, cell_rows: int = CELL_ROWS) -> int:
    """Planes per table, so that a cell holds about `cell_rows` rows: they follow the count."""
    return max(1, math.ceil(math.log2(max(2.0, rows / cell_rows))))


def probe_masks(distances: np.ndarray, probes: int) -> list[int]:
    """Bit masks to flip, in order of the summed distance of the flipped planes to the
    vector: the cell itself, then the next nearest cells (shift and expand on a heap)."""
    order = np.argsort(distances, kind="stable")
    z = distances[order]
    masks, heap = [0], [(float(z[0]), (0,))] if len(z) else []
    while heap and len(masks) < probes:
        score, flipped = heapq.heappop(heap)
        masks.append(sum(1 << int(order[i]) for i in flipped))
        last = flipped[-1]
        if last + 1 < len(z):
            heapq.heappush(heap, (score - float(z[last]) + float(z[last + 1]), flipped[:-1] + (last + 1,)))
            heapq.heappush(heap, (score + float(z[last + 1]), flipped + (last + 1,)))
    return masks


def probed_cells(planes: Planes, probes: int):
    """Arrow UDF from a vector to the cells to read: `probes` per table, nearest first."""
    directions, weights = planes.directions(), 1 << np.arange(planes.bits)
    dim, tables, bits = planes.dim, planes.tables, planes.bits

    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            projected = (flat.reshape(-1, dim) @ directions.T).reshape(-1, tables, bits)
            out = []
            for vector in projected:
                for t, side in enumerate(vector):
                    code = int((side >= 0) @ weights)
                    out += [(code ^ m) * tables + t for m in probe_masks(np.abs(side), probes)]
            width = len(out) // max(1, len(batch))
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * width
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, pa.int64()))

    return run.asNondeterministic()


def build_multiprobe(corpus: DataFrame, path: str, tables: int = 8, bits: int | None = None) -> None:
    """Postings (cell, id) of `corpus(id, embedding)` without vectors, and the setting: the
    number of planes follows the number of rows unless given."""
    known = corpus.where(F.col("embedding").isNotNull())
    count, dim = known.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    setting = (dim or 1, tables, bits or bits_for(count))
    spark = corpus.sparkSession
    spark.createDataFrame([setting], "dim int, tables int, bits int").write.parquet(f"{path}/hash")
    planes = Planes(*setting)
    hashed = known.select("id", planes.cells()("embedding").alias("cells"))
    _write_cells(hashed.select("id", F.explode("cells").alias("cell")), f"{path}/postings")


_SHARD_ROWS = 1 << 17  # rows of a shard at most, held by a task with their postings
_PAIRS = 1 << 19  # pairs of query and row at once, each a number
_PAIR_BYTES = 4 << 20  # of vectors, where pairs are measured
_COMPARED = "query_id bigint, id bigint, distance double, compared bigint"


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of row pairs, summed one component after another as `vector.dot` does."""
    return np.cumsum(a * b, axis=1)[:, -1]


def _spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, ... of spans of `counts`, one span after another."""
    return np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)


class _Shard:
    """The vectors of a shard by id and its postings by cell."""

    def __init__(self, rows: list, posted: list) -> None:
        ids, vectors = (np.concatenate(c) for c in zip(*rows))  # sorted by id
        self.vectors = vectors.astype(np.float64)
        self.norms = np.sqrt(_dots(self.vectors, self.vectors))
        self.ids, self.first, self.rows = np.unique(ids, return_index=True, return_counts=True)
        post_ids, cells = (np.concatenate(c) for c in zip(*posted))
        at = np.minimum(np.searchsorted(self.ids, post_ids), len(self.ids) - 1)
        known = self.ids[at] == post_ids
        order = np.argsort(cells[known], kind="stable")
        self.posted = at[known][order]
        self.cells, self.cell_first, self.cell_rows = np.unique(
            cells[known][order], return_index=True, return_counts=True
        )

    def search(self, ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        """The best k of each query, sorted by its id, among the rows posted in its cells; the first
        row of a query has the number of its candidates."""
        if not len(self.cells):
            return
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        counts = np.where(self.cells[at] == cells, self.cell_rows[at], 0)
        vectors = vectors.astype(np.float64)
        norms = np.sqrt(_dots(vectors, vectors))
        own, starts, sizes = np.unique(ids, return_index=True, return_counts=True)
        total = np.cumsum(np.add.reduceat(counts.sum(axis=1), starts))
        ends, begin = np.append(starts, len(ids)), 0
        while begin < len(own):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + _PAIRS, side="right")))
            part, n = slice(ends[begin], ends[end]), sizes[begin:end]
            each = counts[part].ravel()
            asking = np.repeat(np.repeat(np.arange(end - begin), n), cells.shape[1])
            met = self.posted[_spans(self.cell_first[at[part]].ravel(), each)]
            query, row = np.divmod(np.unique(np.repeat(asking, each) * len(self.ids) + met), len(self.ids))
            compared = np.bincount(query, minlength=end - begin)
            # An id may have several rows and a query several vectors.
            query, row = np.repeat(query, self.rows[row]), _spans(self.first[row], self.rows[row])
            vector, row = _spans(starts[begin:end][query], n[query]), np.repeat(row, n[query])
            query = np.repeat(query, n[query])
            step = max(1, _PAIR_BYTES // (16 * vectors.shape[1]))
            products = np.zeros(len(row))
            for s in range(0, len(row), step):
                pair = slice(s, s + step)
                products[pair] = _dots(vectors[vector[pair]], self.vectors[row[pair]])
            with np.errstate(invalid="ignore", divide="ignore"):  # NaN for a zero vector
                far = 1.0 - products / (norms[vector] * self.norms[row])
            found = np.repeat(self.ids, self.rows)[row]
            order = np.lexsort((found, far, query))  # NaN sorts last
            query, found, far = query[order], found[order], far[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
            best = rank < k
            shown = np.where(rank == 0, compared[query], 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[best]) for a in (own[begin:end][query], found, far, shown)],
                names=["query_id", "id", "distance", "compared"],
            )
            begin = end


def _multiprobe_searcher(dim: int, k: int):
    """Function for mapInArrow over (block, shard, kind, id, cell, embedding, cells), sorted so that
    of a (block, shard) the rows (kind 0) come first, then the postings (1), then the queries (2)."""

    def ids_of(part: pa.RecordBatch) -> np.ndarray:
        return part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, posted, shard, waiting = None, [], [], None, None
        for batch in batches:
            for (*group, kind), part in per_group(batch, ["block", "shard", "kind"]):
                if group != current:
                    if waiting:
                        yield from shard.search(*waiting, k)
                    current, rows, posted, shard, waiting = group, [], [], None, None
                if kind == 0:
                    rows.append((ids_of(part), matrix(part.column("embedding"), dim)))
                elif kind == 1:
                    posted.append((ids_of(part), part.column("cell").to_numpy(zero_copy_only=False).astype(np.int64)))
                elif shard or (rows and posted):
                    if shard is None:
                        shard, rows, posted = _Shard(rows, posted), [], []
                    cells = part.column("cells")
                    asked = ids_of(part), matrix(part.column("embedding"), dim), matrix(cells, len(cells[0]))
                    if waiting:
                        asked = tuple(np.concatenate(c) for c in zip(waiting, asked))
                    # All vectors of a query are searched together: the last may go on.
                    last = int(np.searchsorted(asked[0], asked[0][-1]))
                    if last:
                        yield from shard.search(*(a[:last] for a in asked), k)
                    waiting = tuple(a[last:] for a in asked)
        if waiting:
            yield from shard.search(*waiting, k)

    return run


def search_multiprobe(spark: SparkSession, path: str, corpus: DataFrame, queries: DataFrame, k: int = 2,
                      probes: int = 4) -> DataFrame:
    """Approximate `nearest` by the postings of `build_multiprobe`: each query reads `probes`
    cells a table, nearest first; only then are the vectors of the candidates fetched by id
    from `corpus(id, embedding)` and compared exactly. (query_id, id, distance, rank,
    compared), `compared` the candidates of the query.

    Pairs of query and candidate are never rows. Candidates' vectors and the postings read go to
    shards by id, queries with their cells to blocks; a task holds a shard, streams the queries of
    a block past it and emits the best k of each.
    """
    planes = Planes(*spark.read.parquet(f"{path}/hash").select("dim", "tables", "bits").first())
    known = queries.where(F.col("embedding").isNotNull() & F.col("query_id").isNotNull())
    asked = materialise(known.select("query_id", "embedding", probed_cells(planes, probes)("embedding").alias("cells")), "asked")
    wanted = asked.select(F.explode("cells").alias("cell")).distinct()
    wanted = materialise(wanted.withColumn("part", _part(F.col("cell"))), "wanted")
    parts = [r.part for r in wanted.select("part").distinct().collect()]  # PARTS at most
    postings = spark.read.parquet(f"{path}/postings").where(F.col("part").isin(parts) & F.col("id").isNotNull())
    postings = materialise(postings.join(wanted, ["part", "cell"], "left_semi").select("id", "cell"), "postings-read")
    vectors = corpus.where(F.col("embedding").isNotNull()).select("id", "embedding")
    vectors = vectors.join(postings.select("id").distinct(), "id", "left_semi")
    rows, n = postings.count() / planes.tables, asked.count()
    # Shards as memory asks; groups for all slots, split so that rows and queries move about as much.
    groups = 4 * spark.sparkContext.defaultParallelism
    sent = n * (planes.dim * 4 + 8 * planes.tables * probes)
    kept = rows * (planes.dim * 4 + 32 * planes.tables)
    shards = max(1, math.ceil(rows / _SHARD_ROWS), min(groups, round(math.sqrt(groups * kept / max(1, sent)))))
    blocks = math.ceil(groups / shards)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    own = lambda count: F.pmod(F.xxhash64("id"), F.lit(count))
    empty = {"cell": F.lit(None).cast("bigint"), "embedding": F.lit(None).cast("array<double>"), "cells": F.lit(None).cast("array<bigint>")}
    wide = any(df.schema["embedding"].dataType.elementType.typeName() == "double" for df in (vectors, asked))

    def shape(df: DataFrame, kind: int) -> DataFrame:
        df = df.withColumns({c: value for c, value in empty.items() if c not in df.columns})
        df = df.withColumn("embedding", F.col("embedding").cast("array<double>" if wide else "array<float>"))
        return df.withColumn("kind", F.lit(kind)).select("block", "shard", "kind", "id", "cell", "embedding", "cells")

    dealt = lambda df: df.withColumn("shard", own(shards)).withColumn("block", every(blocks))
    asking = asked.withColumnRenamed("query_id", "id").withColumn("block", own(blocks)).withColumn("shard", every(shards))
    met = shape(dealt(vectors), 0).unionByName(shape(dealt(postings), 1)).unionByName(shape(asking, 2))
    met = met.repartition(max(task_count(spark), min(blocks * shards, 2 * groups)), "block", "shard")
    met = met.sortWithinPartitions("block", "shard", "kind", "id")
    found = met.mapInArrow(_multiprobe_searcher(planes.dim, k), _COMPARED)
    found = found.withColumn("compared", F.sum("compared").over(Window.partitionBy("query_id")))
    return rank_candidates(found, k).select("query_id", "id", "distance", "rank", "compared")

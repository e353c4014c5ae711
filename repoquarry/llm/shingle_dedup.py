"""One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8.

Documents with equal shingle sets are one node. A node is posted under `BANDS` bands of
`ROWS` minima of its set each; two sets alike at 0.8 share no band with a chance of
(1 - 0.8 ** 4) ** 32, below 1 in 10 million. Each node of a band is compared with the band's
smallest; then nodes outside the group of the smallest are compared with all nodes of the
band that are in another group. So a pair that shares a band is compared, or is in one group
already, and a group of near copies makes a star and not all its pairs. Comparison is by the
sets themselves; a node in many pairs is spread over several tasks.

Defined cases: null and empty texts are one node; texts of fewer words than a shingle have one
shingle of all their words. Rows with a null id take part. An empty table gives an empty
result. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import content_key, slices
from repoquarry.llm.simhash import components
from repoquarry.session import materialise

WIDTH = 5
BANDS, ROWS = 32, 4
PAIRS_A_TASK = 256  # of one node
_BLOCK = 1 << 10  # shingles whose minima are taken at once
_RANDOM = np.random.default_rng(5)
_FACTORS = _RANDOM.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The hashes of the shingles, each once, in order."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII spaces split
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    hashes = (xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n))
    return np.unique(np.fromiter(hashes, np.uint64, n))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed long for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), _BLOCK):
        mixed = (hashes[start : start + _BLOCK] ^ _MASKS) * _FACTORS
        np.minimum(least, mixed.min(axis=1), out=least)
    return [
        xxhash.xxh64_intdigest(row.tobytes(), number) - (1 << 63)
        for number, row in enumerate(least.reshape(BANDS, ROWS))
    ]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        nodes, banded = [], []
        for t in batch.column(1):
            hashes = shingle_set(t.as_py() or "")
            nodes.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            banded.append(bands(hashes))
        arrays = [batch.column(0), pa.array(nodes, pa.binary()), pa.array(banded, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["_id", "_node", "_bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingle_set(t.as_py() or "").view(np.int64) for t in batch.column(1)]
        arrays = [batch.column(0), pa.array(sets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["_node", "_set"])


def alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (_a, _b) whose sets have a similarity of 0.8 or more. A node's text
    is that of its row `_k` in (_key, _text)."""
    pairs = materialise(pairs.distinct(), "pairs")
    ends = pairs.select(F.col("_a").alias("_node")).union(pairs.select("_b")).distinct()
    wanted = nodes.join(ends, "_node").select("_node", "_k")
    held = texts.join(wanted, F.col("_key") == F.col("_k")).select("_node", "_text")
    held = held.dropDuplicates(["_node"])
    sets = materialise(held.mapInArrow(_sets, "_node binary, _set array<bigint>"), "sets")
    shares = pairs.groupBy("_a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).alias("_shares"))
    share = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_shares") - 1)).alias("_share")
    left = sets.select(F.col("_node").alias("_a"), F.col("_set").alias("_x"))
    left = left.join(shares, "_a").select("_a", "_x", share)
    right = sets.select(F.col("_node").alias("_b"), F.col("_set").alias("_y"))
    dealt = pairs.join(shares, "_a").select(
        "_a", "_b", F.pmod(F.xxhash64("_b"), F.col("_shares")).alias("_share")
    )
    both = F.size(F.array_intersect("_x", "_y"))
    enough = 5 * both >= 4 * (F.size("_x") + F.size("_y") - both)
    return dealt.join(right, "_b").join(left, ["_a", "_share"]).where(enough).select("_a", "_b")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(_node, _root) for all nodes."""
    roots = components(links).withColumnRenamed("_fp", "_f")
    rooted = nodes.join(roots, F.col("_node") == F.col("_f"), "left")
    return rooted.select("_node", F.coalesce("_root", "_node").alias("_root"))


def near_groups(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """(_node, _root) for the nodes of (_id, _node, _bands), `_id` with a content key `k`."""
    nodes = marked.groupBy("_node").agg(F.min("_id.k").alias("_k"), F.first("_bands").alias("_bands"))
    nodes = materialise(nodes, "nodes")
    posts = nodes.select("_node", F.explode("_bands").alias("_band"))
    shared = posts.groupBy("_band").agg(F.min("_node").alias("_a"), F.max("_node").alias("_z"))
    shared = shared.where("_a != _z").select("_band", "_a")
    met = materialise(posts.join(shared, "_band"), "bands")
    star = met.where("_a != _node").select("_a", F.col("_node").alias("_b"))
    links = materialise(alike(star, nodes, texts), "links")
    rooted = materialise(_rooted(nodes.select("_node"), links), "groups")
    named = met.join(rooted, "_node")
    centre = rooted.select(F.col("_node").alias("_a"), F.col("_root").alias("_centre"))
    outside = named.join(centre, "_a").where("_root != _centre")
    outside = outside.select("_band", F.col("_node").alias("_other"), F.col("_root").alias("_apart"))
    rest = named.where("_a != _node").join(outside, "_band").where("_root != _apart")
    rest = rest.select(F.least("_node", "_other").alias("_a"), F.greatest("_node", "_other").alias("_b"))
    return _rooted(nodes.select("_node"), links.union(alike(rest, nodes, texts)))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with its columns: the smallest id (null last), then the
    smallest content key."""
    key = content_key(*docs.columns)
    pair = docs.select(
        F.struct(F.col(id).alias("i"), key.alias("k")).alias("_id"), F.col(text).cast("string").alias("_text")
    )
    kind = pair.schema["_id"].dataType.simpleString()
    marked = pair.mapInArrow(_nodes, f"_id {kind}, _node binary, _bands array<bigint>")
    marked = materialise(marked, "shingles")
    texts = pair.select(F.col("_id.k").alias("_key"), "_text")
    groups = near_groups(marked, texts)
    rank = F.struct(F.col("_id.i").isNull(), F.col("_id.i"), F.col("_id.k").alias("k"))
    best = (
        marked.join(groups, "_node")
        .groupBy("_root")
        .agg(F.min(rank)["k"].alias("_best"))
        .select("_best")
        .distinct()
    )
    whole = docs.select(F.struct("*").alias("_doc"), key.alias("_key"))
    kept = whole.join(best, F.col("_key") == F.col("_best"), "left_semi")
    once = kept.groupBy("_key").agg(F.first("_doc").alias("_doc"))
    return once.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])

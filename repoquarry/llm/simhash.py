"""Near-duplicate groups of documents by SimHash fingerprints.

A fingerprint has 64 bits. It is embedded as the number of ones in each of its 32 segments
of two bits. One differing bit changes one of these counts by one, so the Manhattan
distance of two embeddings is at most the number of differing bits: embeddings further
apart than that need no look. The range join runs on the grid of embeddings: each is posted
in its own cell and the cells one step away, and two embeddings within two steps share a
cell. Fingerprints alone in all their cells are done. The others are verified exactly the
same way on the bits: each is posted at itself and the 64 values one bit away. Two
fingerprints share such a point if and only if they differ in at most two bits, and a point
has at most 65 fingerprints, however many documents are alike. So no pairs within a group
are made; a point links its fingerprints to the smallest.

Equal fingerprints are one node from the start. Components come from rounds of stars, each
written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts
of fewer words than a shingle have one shingle of all their words. Rows with a null id take
part; the component of a group with no id at all is null. Repeated rows are linked. An empty
table gives an empty result. Other columns are passed over, or kept by `one_of_each`,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import content_key, slices
from repoquarry.session import materialise, task_count

_BLOCK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str, width: int) -> int:
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII spaces split
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _BLOCK):
        stop = min(n, start + _BLOCK)
        shingles = (b" ".join(words[i : i + width]) for i in range(start, stop))
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, stop - start
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * int(ones[i]) > n)


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, value = "", 0
        for batch in slices(batches):
            values = []
            for t in batch.column(1):
                text = t.as_py() or ""
                if text != last:
                    last, value = text, fingerprint(text, width)
                values.append(value)
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["_id", "_fp"])

    return run


def with_fingerprints(docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """(_id, _fp), the fingerprint as a signed long."""
    slim = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(_fingerprints(width), f"_id {kind}, _fp bigint")


def segment_counts(fp: Column) -> Column:
    """The ones in each of 32 segments of two bits, packed two bits each: 0, 1 or 2."""
    low = F.lit(0x5555555555555555)
    one = F.shiftrightunsigned(fp, 1)
    odd = fp.bitwiseXOR(one).bitwiseAND(low)
    both = fp.bitwiseAND(one).bitwiseAND(low)
    return odd.bitwiseOR(F.shiftleft(both, 1))


def _shifted(value: int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("bigint"), by)


def _near_cells(counts: Column) -> Column:
    """A cell of the grid and those one step away."""

    def step(i: Column) -> Column:
        place = F.shiftleft(F.shiftright(i, 1), 1)
        digit = F.call_function("shiftrightunsigned", counts, place).bitwiseAND(F.lit(3))
        # Between 0 and 1 the last bit changes, between 1 and 2 both do.
        return F.when((i % 2 == 0) & (digit <= 1), counts.bitwiseXOR(_shifted(1, place))).when(
            (i % 2 == 1) & (digit >= 1), counts.bitwiseXOR(_shifted(3, place))
        )

    steps = F.transform(F.sequence(F.lit(0), F.lit(63)), step)
    return F.concat(F.array(counts), F.array_compact(steps))


def _near_points(fp: Column) -> Column:
    """A fingerprint and the 64 values one bit away."""
    return F.concat(
        F.array(fp),
        F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda i: fp.bitwiseXOR(_shifted(1, i)),
        ),
    )


def candidates(nodes: DataFrame) -> DataFrame:
    """Fingerprints with another within two steps on the grid. The nodes, a few files of
    longs, are dealt to every slot first: each becomes 65 posts."""
    nodes = nodes.repartition(task_count(nodes.sparkSession), "_fp")
    posts = nodes.select("_fp", F.explode(_near_cells(segment_counts(F.col("_fp")))).alias("_cell"))
    shared = posts.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return posts.join(shared.select("_cell"), "_cell", "left_semi").select("_fp").distinct()


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """(_a, _b), _a < _b: links that connect all fingerprints with up to `distance` (0 to 2)
    differing bits; not all their pairs."""
    if distance not in (0, 1, 2):
        raise ValueError("distances of 0, 1 and 2 bits are supported")
    posts = candidates(nodes).select("_fp", F.explode(_near_points(F.col("_fp"))).alias("_point"))
    met = posts.groupBy("_point").agg(F.collect_list("_fp").alias("_of"))  # at most 65
    met = met.where(F.size("_of") > 1)
    # Fingerprints one bit apart meet at each other's point; two bits, between them.
    centre = F.col("_point") if distance == 1 else F.array_min("_of")
    star = met.select(centre.alias("_c"), F.explode("_of").alias("_fp"))
    exact = F.bit_count(F.col("_c").bitwiseXOR(F.col("_fp"))) <= distance
    star = star.where((F.col("_c") != F.col("_fp")) & exact)
    if distance == 1:
        star = star.join(nodes.select(F.col("_fp").alias("_c")), "_c", "left_semi")
    pair = (F.least("_c", "_fp").alias("_a"), F.greatest("_c", "_fp").alias("_b"))
    return star.select(*pair).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """A count and an order-free digest of the links."""
    digest = F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())


def components(edges: DataFrame) -> DataFrame:
    """(_fp, _root) for all linked nodes: the smallest node each can reach.

    Large stars and small stars in turn: every node hands its larger (then its smaller)
    neighbours to the smallest node it sees. The rounds grow with the logarithm of the size.
    """
    edges = materialise(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("_b", "_a")).toDF("_u", "_v")
        least = both.groupBy("_u").agg(F.least(F.col("_u"), F.min("_v")).alias("_m"))
        large = both.where("_v > _u").join(least, "_u").select("_m", "_v").where("_m < _v")
        large = large.distinct().toDF("_a", "_b")
        small = large.groupBy("_b").agg(F.min("_a").alias("_m"))
        joined = large.join(small, "_b")
        star = joined.select("_m", F.col("_a").alias("_v")).union(small.select("_m", "_b"))
        after = materialise(star.where("_m < _v").distinct().toDF("_a", "_b"), "links")
        now = _state(after)
        if now == state:
            break
        edges, state = after, now
    return edges.groupBy(F.col("_b").alias("_fp")).agg(F.min("_a").alias("_root"))


def _groups(marked: DataFrame, distance: int) -> DataFrame:
    """(_node, _component) for the distinct fingerprints of (_id, _fp)."""
    nodes = materialise(marked.groupBy("_fp").agg(F.min("_id").alias("_least")), "nodes")
    roots = components(links(nodes, distance)).withColumnRenamed("_fp", "_f")
    rooted = nodes.join(roots, F.col("_fp") == F.col("_f"), "left")
    rooted = rooted.select("_fp", "_least", F.coalesce("_root", "_fp").alias("_root"))
    named = rooted.groupBy("_root").agg(F.min("_least").alias("_component"))
    return rooted.join(named, "_root").select(F.col("_fp").alias("_node"), "_component", "_root")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5,
                distance: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for every row."""
    marked = materialise(with_fingerprints(docs, id, text, width), "fingerprints")
    groups = _groups(marked, distance)
    digits = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    joined = marked.join(groups, F.col("_fp") == F.col("_node"))
    return joined.select(
        F.col("_id").alias(id), digits.alias("fingerprint"), F.col("_component").alias("component_id")
    )


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5,
                distance: int = 2) -> DataFrame:
    """One row of each group, with its columns: the smallest id, then the smallest content
    key. Only ids and keys move to choose it; the texts move once, those that stay."""
    key = content_key(*docs.columns)
    pair = docs.select(F.struct(F.col(id), key.alias("k")).alias("_id"), F.col(text).alias("_text"))
    keyed = materialise(with_fingerprints(pair, "_id", "_text", width), "fingerprints")
    ids = keyed.select(F.col("_fp"), F.col(f"_id.{id}").alias("_i"), F.col("_id.k").alias("_k"))
    groups = _groups(ids.select(F.col("_i").alias("_id"), "_fp"), distance)
    rank = F.struct(F.col("_i").isNull(), "_i", "_k")
    best = (
        ids.join(groups, F.col("_fp") == F.col("_node"))
        .groupBy("_root")
        .agg(F.min(rank)["_k"].alias("_best"))
        .select("_best")
        .distinct()
    )
    whole = docs.select(F.struct("*").alias("_doc"), key.alias("_key"))
    kept = whole.join(best, F.col("_key") == F.col("_best"), "left_semi")
    once = kept.groupBy("_key").agg(F.first("_doc").alias("_doc"))
    return once.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])

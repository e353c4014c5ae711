"""Ranked lexical search: each query's best documents by an integer BM25-like score, found
by branch and bound over a document FP-tree.

Terms are maximal runs of letters, digits and any non-ASCII code point, with only A-Z
lower-cased. Over all documents: N documents with a term, L terms in all, df a term's
documents, and for each document n (its terms) and m = 25 + (75 n N) div L. A term weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))); a document scores, for each term of the query
(repeats included), w * ((10^9 tf) div (1000 tf + 8 m)). All statistics are Spark sums.

The tree. A shard is a batch of documents of a task. They are cut down to the terms that some
query holds (the restricted vector), ordered by descending corpus df, and put in the order of
the trie of these vectors, so that documents with the same frequent terms share a path and a
node is a run of documents. A leaf, of LEAF documents at most, bounds the score of each by the
largest gain of every term in it, an inner node by the largest bound of its children. All
queries search together, as matrix products: depth first, best bound first; a subtree is left
by the queries whose bound there is below the k-th score found, in this shard or an earlier
one of the task (equal bounds are searched, for the tie on doc_id). Each task gives its exact
top k per query; the top k of those is the answer.

Queries go to the tasks in blocks of QUERY_BLOCK_BYTES at most; a larger query table is
searched block after block. The query vocabulary meets the documents' terms as a broadcast
when within BROADCAST_BYTES, else by a shuffle join.

Defined cases: null texts have no terms and score nothing. A null doc_id takes part in all
statistics and is ranked after every id of equal score. Repeated rows are documents of
their own. Only scores above 0 are returned; a query without terms returns nothing. An empty
table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.llm.common import lower_ascii
from repoquarry.session import materialise

# Fixed values of the contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10

BROADCAST_BYTES = 64 << 20
QUERY_BLOCK_BYTES = 32 << 20
MATRIX_BYTES = 16 << 20  # weights of the queries searched together, gains scored together
LEAF = 256  # documents of a leaf
DEPTH = 12  # ranks a path branches on at most


def terms_of(text) -> F.Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(TERM), 0)


def gain(tf, m):
    """Of whole numbers or of arrays of them."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """The FP-tree of a shard's restricted term vectors (ranks ascending), laid out depth
    first: a node is a run of documents that share a path of ranks, a leaf a run of at most
    LEAF documents. Kept as flat arrays, so that bounds and scores are matrix products."""

    def __init__(self) -> None:
        self._added: list[tuple] = []
        self._laid_out = False

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Tree:
        """The tree of a batch (doc_id, m, [(rank, tf)])."""
        tree, ids, vectors = cls(), batch.column(0), batch.column(2)
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        ranks, tfs = (x.to_numpy(zero_copy_only=False) for x in vectors.flatten().flatten())
        tree._lay_out(
            pc.fill_null(ids, 0).to_numpy(zero_copy_only=False),
            ids.is_null().to_numpy(zero_copy_only=False),
            batch.column(1).to_numpy(zero_copy_only=False),
            lengths.astype(np.int64), ranks.astype(np.int64), tfs.astype(np.int64),
        )
        return tree

    def insert(self, row, m: int, ranks: list[int], tfs: list[int]) -> None:
        self._added.append((row, m, ranks, tfs))
        self._laid_out = False

    def _lay_out(self, ids, null, ms, lengths, ranks, tfs) -> None:
        starts = np.concatenate([[0], np.cumsum(lengths)])
        heads = np.full((len(ids), DEPTH), -1, np.int64)  # a path that ends comes first
        for depth in range(DEPTH):
            longer = lengths > depth
            heads[longer, depth] = ranks[starts[:-1][longer] + depth]
        order = np.lexsort(heads.T[::-1])
        self.ids, self.null, lengths = ids[order], null[order], lengths[order]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(self.starts[-1]) + np.repeat(starts[:-1][order] - self.starts[:-1], lengths)
        self.row = np.repeat(np.arange(len(ids)), lengths)
        self.ranks, tfs, m = ranks[at], tfs[at], ms[order][self.row]
        self.gains = gain(tfs, m)
        self.nodes: list[tuple[int, int, list[int]]] = []  # (first, end, children)
        self._grow(heads[order], 0, len(ids), 0)
        self._laid_out = True

    def _grow(self, heads: np.ndarray, lo: int, hi: int, depth: int) -> int:
        """Number of the node of documents lo to hi, which share `depth` ranks. Small children
        that follow each other share a leaf; so do documents beyond DEPTH ranks."""
        own, kids = len(self.nodes), []
        self.nodes.append((lo, hi, kids))
        if hi - lo <= LEAF:
            return own
        if depth == DEPTH:
            ends = [*range(lo + LEAF, hi, LEAF), hi]
        else:
            change = np.flatnonzero(np.diff(heads[lo:hi, depth])) + lo + 1
            ends = [*change.tolist(), hi]
        start = held = lo
        for end in ends:
            if end - start > LEAF and held > start:
                kids.append(self._grow(heads, start, held, DEPTH))
                start = held
            if end - start > LEAF:
                kids.append(self._grow(heads, start, end, min(DEPTH, depth + 1)))
                start = end
            held = end
        if held > start:
            kids.append(self._grow(heads, start, held, DEPTH))
        return own

    def search(self, weights: dict[int, int], k: int = K) -> list[tuple[int, object]]:
        """The k best (score, row) of this tree with score above 0: exact."""
        best = _Best([(None, weights)], k)
        if not self._laid_out:
            rows, ms, ranks, tfs = zip(*self._added)
            self._lay_out(
                np.array([r or 0 for r in rows], np.int64), np.array([r is None for r in rows]), np.array(ms, np.int64),
                np.array([len(x) for x in ranks], np.int64), np.concatenate(ranks).astype(np.int64),
                np.concatenate(tfs).astype(np.int64),
            )
        best.search(self)
        return [(score, row) for _, row, score in best.rows()]


class _Best:
    """The best k documents so far of some queries: higher score, then smaller id, a null id
    last. Their weights are one matrix (term, query)."""

    def __init__(self, queries: list[tuple[object, dict[int, int]]], k: int = K) -> None:
        self.items, self.k = [item for item, _ in queries], k
        self.terms = np.unique(np.array([r for _, weights in queries for r in weights], np.int64))
        # All sums are whole numbers: exact in doubles below 2 ** 53, and else in integers.
        most = max((sum(weights.values()) for _, weights in queries), default=0) * 1_000_000
        self.number = np.float64 if most < 1 << 53 else np.int64
        self.weights = np.zeros((len(self.terms), len(queries)), self.number)
        for i, (_, weights) in enumerate(queries):
            at = np.searchsorted(self.terms, np.fromiter(weights, np.int64, len(weights)))
            self.weights[at, i] = np.fromiter(weights.values(), np.int64, len(weights))
        self.floor = np.ones(len(queries), np.int64)  # below it a score is of no use
        self.q = self.score = self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def search(self, tree: Tree) -> None:
        """Branch and bound, depth first and best bound first."""
        if not len(self.terms) or not len(tree.ranks):
            return
        column = np.minimum(np.searchsorted(self.terms, tree.ranks), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[column] == tree.ranks)
        column, row, gains = column[known], tree.row[known], tree.gains[known].astype(self.number)
        starts = np.searchsorted(row, np.arange(len(tree.ids) + 1))
        bounds: list = [None] * len(tree.nodes)
        for node in range(len(tree.nodes) - 1, -1, -1):  # children have the higher numbers
            lo, hi, kids = tree.nodes[node]
            if kids:
                bounds[node] = np.maximum.reduce([bounds[kid] for kid in kids])
                continue
            # No document of a leaf gains more by a term than the largest gain in it.
            part = slice(starts[lo], starts[hi])
            held, at = np.unique(column[part], return_inverse=True)
            most = np.zeros(len(held), self.number)
            np.maximum.at(most, at, gains[part])
            bounds[node] = most @ self.weights[held]
        pending = [0]
        while pending:
            node = pending.pop()
            lo, hi, kids = tree.nodes[node]
            wanted = np.flatnonzero(bounds[node] >= self.floor)
            if not len(wanted):
                continue
            if kids:
                pending += sorted(kids, key=lambda kid: bounds[kid][wanted].max())
                continue
            part = slice(starts[lo], starts[hi])
            held, at = np.unique(column[part], return_inverse=True)
            weights = self.weights[np.ix_(held, wanted)]
            step = max(1, MATRIX_BYTES // (8 * max(1, len(held))))
            for first in range(lo, hi, step):
                end = min(hi, first + step)
                a, b = starts[first] - starts[lo], starts[end] - starts[lo]
                vectors = np.zeros((end - first, len(held)), self.number)
                vectors[row[part][a:b] - first, at[a:b]] = gains[part][a:b]
                self._offer(tree, first, wanted, vectors @ weights)

    def _offer(self, tree: Tree, first: int, wanted: np.ndarray, scores: np.ndarray) -> None:
        scores = scores.astype(np.int64)
        limit = self.floor[wanted]
        if len(scores) >= self.k:
            limit = np.maximum(limit, np.partition(scores, -self.k, axis=0)[-self.k])
        rows, which = np.nonzero(scores >= limit)
        if not len(rows):
            return
        q = np.concatenate([self.q, wanted[which]])
        score = np.concatenate([self.score, scores[rows, which]])
        id = np.concatenate([self.id, tree.ids[first + rows]])
        null = np.concatenate([self.null, tree.null[first + rows]])
        order = np.lexsort((id, null, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        kept = place < self.k
        self.q, order = q[kept], order[kept]
        self.score, self.id, self.null = score[order], id[order], null[order]
        full = place[kept] == self.k - 1
        self.floor[self.q[full]] = self.score[full]

    def rows(self) -> list[tuple]:
        """(item, document, score), best first within an item."""
        found = zip(self.q.tolist(), self.id.tolist(), self.null.tolist(), self.score.tolist())
        return [(self.items[q], None if null else id, score) for q, id, null, score in found]


def _together(queries: list[tuple[object, dict[int, int]]]) -> Iterator[list[tuple[object, dict[int, int]]]]:
    """Queries in runs whose matrix of weights is within MATRIX_BYTES."""
    run, terms = [], set()
    for query in queries:
        more = terms | query[1].keys()
        if run and 8 * len(more) * (len(run) + 1) > MATRIX_BYTES:
            yield run
            run, more = [], set(query[1])
        run.append(query)
        terms = more
    if run:
        yield run


def _searched(queries: list[tuple[object, dict[int, int]]]):
    """Function for mapInArrow: each batch of documents is a shard with a tree of its own, and
    what the queries have found in one bounds the search of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [_Best(run) for run in _together(queries)]
        for batch in batches:
            if batch.num_rows:
                tree = Tree.of(batch)
                for best in every:
                    best.search(tree)
        out = [row for best in every for row in best.rows()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[i] for row in out], pa.int64()) for i in range(3)], ["item_id", "doc_id", "score"]
        )

    return run


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, doc_id, n, _terms): each row's terms, written once."""
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), terms_of(text).alias("_terms"))
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.size("_terms").alias("n"), "_terms")
    return materialise(rows, "lexical-terms")


def rank(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    rows = statistics(docs, id, text)
    totals = rows.agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")
    ).first()
    n_docs, n_terms = int(totals["N"]), int(totals["L"])
    asked = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.explode(terms_of(item_text)).alias("term"))
    asked = materialise(asked.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("c")), "lexical-items")
    vocab = asked.select("term").distinct()
    size = vocab.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term") + 48), F.lit(0))).first()
    if not size[0] or not n_docs:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    wanted = F.broadcast(vocab) if size[1] <= BROADCAST_BYTES else vocab
    held = rows.select("_row", "doc_id", "n", F.explode("_terms").alias("term")).join(wanted, "term")
    tf = materialise(held.groupBy("_row", "doc_id", "n", "term").agg(F.count(F.lit(1)).alias("tf")), "lexical-tf")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("bigint")
    # A sort by range, then ids that grow with it: ranks in order of df, without one task.
    by_df = df.select("term", "df", weight.alias("w")).orderBy(F.desc("df"), "term")
    ranked = materialise(by_df.withColumn("rank", F.monotonically_increasing_id()), "lexical-ranks")
    m = F.expr(f"25L + (75L * CAST(n AS BIGINT) * {n_docs}L) div {n_terms}L")
    terms = ranked.select("term", "rank")
    vectors = tf.join(F.broadcast(terms) if size[1] <= BROADCAST_BYTES else terms, "term")
    vectors = vectors.groupBy("_row", "doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("rank", "tf"))).alias("_v"))
    vectors = materialise(vectors.select("_row", "doc_id", m.alias("m"), "_v"), "lexical-vectors")
    weights = asked.join(ranked, "term").select("item_id", (F.col("c") * F.col("w")).alias("weight"), "rank")
    weights = weights.where(F.col("weight") > 0).groupBy("item_id").agg(F.collect_list(F.struct("rank", "weight")).alias("_q"))
    found = None
    for block in _blocks(weights):
        part = vectors.select("doc_id", "m", "_v").mapInArrow(_searched(block), "item_id bigint, doc_id bigint, score bigint")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = found.select("item_id", F.row_number().over(best).alias("rank"), "doc_id", "score")
    return placed.where(F.col("rank") <= k)


def _blocks(weights: DataFrame) -> Iterator[list[tuple[object, dict[int, int]]]]:
    """The queries in blocks of about QUERY_BLOCK_BYTES, dealt by a hash of their id."""
    sized = materialise(weights, "lexical-queries")
    total = sized.agg(F.coalesce(F.sum(F.size("_q") * 24 + 32), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // QUERY_BLOCK_BYTES))
    for number in range(blocks):
        block = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        yield [(r.item_id, {x["rank"]: x["weight"] for x in r._q}) for r in block]

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from repoquarry.operators import approx, search
from repoquarry.operators.render import render_results
from repoquarry.schemas import META_SCHEMA
from repoquarry.session import scratch_path

CORPUS = "id bigint, embedding array<float>"
QUERIES = "query_id bigint, embedding array<float>"


def cosine(a, b):
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    norms = np.linalg.norm(a) * np.linalg.norm(b)
    return 1 - a @ b / norms if norms else math.nan


def brute_force(corpus, queries, k, limit=None):
    want = {}
    for q, v in queries:
        near = [(cosine(e, v), i) for i, e in corpus if e is not None]
        if limit is not None:
            near = [n for n in near if n[0] <= limit]
        near.sort(key=lambda n: (math.isnan(n[0]), round(n[0], 12) if n[0] == n[0] else 0, n[1]))
        want[q] = [i for _, i in near[:k]]
    return want


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def vectors(seed, n, dim=8, start=0):
    rng = np.random.default_rng(seed)
    return [(start + i, [float(x) for x in rng.normal(size=dim).astype(np.float32)]) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    corpus = vectors(1, 300)
    hot = corpus[0][1]
    corpus += [(1000 + i, hot) for i in range(150)]  # a third of all rows are copies
    corpus += [(5000, [0.0] * 8), (5001, None)]
    queries = vectors(2, 20) + [(100, hot), (101, [2 * x for x in hot])]
    return corpus, queries


@pytest.mark.parametrize("k", [1, 2, 7, 200])
def test_exact_search(spark, data, k):
    corpus, queries = data
    df = spark.createDataFrame(corpus, CORPUS).repartition(6)
    got = search.nearest(df, spark.createDataFrame(queries, QUERIES), k)
    assert found(got) == brute_force(corpus, queries, k)


def test_blocks_of_queries_and_small_batches(spark, data):
    corpus, queries = data
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    df = spark.createDataFrame(corpus, CORPUS).repartition(3)
    got = search.nearest(df, spark.createDataFrame(queries, QUERIES), 3, block_bytes=200)
    assert found(got) == brute_force(corpus, queries, 3)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_grid_join_of_blocks(spark, data):
    """Beyond the broadcast limit, query blocks meet corpus shards on a (block, shard) grid;
    within it they are broadcast and the corpus is not shuffled. Both are exact."""
    corpus, queries = data
    df, asked = spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(queries, QUERIES)
    want = brute_force(corpus, queries, 3)
    grid = search.search_blocks(df.where("embedding IS NOT NULL"), asked, 3, block_bytes=200, broadcast_bytes=0)
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block#" in plan and "shard#" in plan.split("hashpartitioning(block#", 1)[1].split(")", 1)[0]
    assert "BroadcastExchange" not in plan
    assert found(search.rank_candidates(grid, 3)) == want
    near = search.search_blocks(df.where("embedding IS NOT NULL"), asked, 3, block_bytes=200)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning(block" not in plan
    assert found(search.rank_candidates(near, 3)) == want


def test_twenty_megabytes_of_queries_are_not_keyed_by_block(spark):
    """20 MB of queries: the plan has no shuffle keyed by block alone, whatever Spark
    estimates of either side."""
    rng = np.random.default_rng(3)
    asked = spark.range(20_000).select(
        F.col("id").alias("query_id"), F.array(*[F.rand(i).cast("float") for i in range(256)]).alias("embedding")
    )
    corpus = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=256)]) for i in range(50)], CORPUS)
    for limit in (search.BROADCAST_QUERY_BYTES, 0):
        plan = search.search_blocks(corpus, asked, 2, broadcast_bytes=limit)._jdf.queryExecution().executedPlan().toString()
        keyed = [p.split(")", 1)[0] for p in plan.split("hashpartitioning(")[1:]]
        assert not any(k.startswith("block#") and "shard#" not in k for k in keyed)


def test_threshold(spark, data):
    corpus, queries = data
    df = spark.createDataFrame(corpus, CORPUS)
    got = search.nearest(df, spark.createDataFrame(queries, QUERIES), 5, max_distance=0.3)
    want = {q: ids for q, ids in brute_force(corpus, queries, 5, 0.3).items() if ids}
    assert found(got) == want


def test_zero_vectors_and_rows_without_vectors_come_last(spark):
    corpus = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, None), (5, [0.0, 1.0])]
    df = spark.createDataFrame(corpus, CORPUS)
    queries = spark.createDataFrame([(1, [0.0, 2.0])], QUERIES)
    assert found(search.nearest(df, queries, 10)) == {1: [5, 1, 2]}
    assert found(search.nearest(df, queries, 4, keep_unembedded=True)) == {1: [5, 1, 2, 3]}
    zero = spark.createDataFrame([(1, [0.0, 0.0])], QUERIES)
    rows = search.nearest(df, zero, 2).orderBy("rank").collect()
    assert [r.id for r in rows] == [1, 2] and all(math.isnan(r.distance) for r in rows)


def test_empty_sides(spark):
    none = spark.createDataFrame([], CORPUS)
    queries = spark.createDataFrame([(1, [1.0])], QUERIES)
    assert search.nearest(none, queries).count() == 0
    assert search.nearest(none, spark.createDataFrame([], QUERIES)).count() == 0


def test_mixed_dimensions_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], CORPUS)
    with pytest.raises(Exception, match="dimensions"):
        search.nearest(df, spark.createDataFrame([(1, [1.0, 1.0])], QUERIES)).collect()


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(1200):
        # One cluster holds a third of the rows.
        c = 0 if i % 3 == 0 else int(rng.integers(12))
        rows.append((i, [float(x) for x in (centres[c] + 0.3 * rng.normal(size=16)).astype(np.float32)]))
    queries = [(i, v) for i, v in rows[::25]]
    exact = brute_force(rows, queries, 5)
    return spark.createDataFrame(rows, CORPUS), spark.createDataFrame(queries, QUERIES), exact


def recall(got, exact):
    hits = sum(len(set(got.get(q, [])) & set(ids)) for q, ids in exact.items())
    return hits / sum(map(len, exact.values()))


def test_hashed_search(spark, clustered):
    corpus, queries, exact = clustered
    path = scratch_path(spark, "lsh")
    approx.build_lsh(corpus, path)
    got = found(approx.search_lsh(spark, path, queries, 5))
    assert recall(got, exact) >= 0.9
    assert all(len(set(ids)) == len(ids) for ids in got.values())
    blocks = found(approx.search_lsh(spark, path, queries, 5, block_bytes=500))
    assert blocks == got


def test_probe_order():
    rng = np.random.default_rng(5)
    for _ in range(20):
        d = np.abs(rng.normal(size=7))
        scores = sorted(sum(d[i] for i in range(7) if m >> i & 1) for m in range(128))
        got = approx.probe_masks(d, 40)
        assert [sum(d[i] for i in range(7) if m >> i & 1) for m in got] == pytest.approx(scores[:40])
        assert len(set(got)) == 40
    assert approx.probe_masks(np.array([0.5]), 9) == [0, 1]
    assert approx.bits_for(2000) == 8 and approx.bits_for(2_000_000) == 18


def test_multiprobe_search(spark, clustered):
    corpus, queries, exact = clustered
    path = scratch_path(spark, "multiprobe")
    approx.build_multiprobe(corpus, path)
    few = approx.search_multiprobe(spark, path, corpus, queries, 5, probes=2).collect()
    many = approx.search_multiprobe(spark, path, corpus, queries, 5, probes=8)
    assert recall(found(many), exact) >= 0.9
    compared = lambda rows: sum({r.query_id: r.compared for r in rows}.values())
    assert compared(few) <= compared(many.collect()) < 1200 * len(exact)
    assert all(len(set(ids)) == len(ids) for ids in found(many).values())


def test_multiprobe_makes_no_row_per_pair(spark, capsys):
    """A third of the vectors are equal, some ids have several rows, some queries several vectors."""
    rows = vectors(6, 90)
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows] + [(7, rows[8][1]), (9, None), (91, None)]
    corpus = spark.createDataFrame(rows, CORPUS)
    queries = spark.createDataFrame([(i % 40, v) for i, v in rows] + [(None, rows[0][1])], QUERIES)
    path = scratch_path(spark, "multiprobe")
    approx.build_multiprobe(corpus, path, bits=3)
    every = approx.search_multiprobe(spark, path, corpus, queries, 6, probes=8)
    far = lambda a, b: 1 - np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    want = {}
    for q, v in ((i % 40, v) for i, v in rows if v):
        want.setdefault(q, []).extend((round(far(v, x), 9) + 0.0, i) for i, x in rows if x)
    got = {}
    for r in every.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(r.distance, 9) + 0.0, r.id))
        assert r.compared == 90
    assert {q: [d for d, _ in found] for q, found in got.items()} == {q: [d for d, _ in sorted(found)[:6]] for q, found in want.items()}
    assert all(set(found) <= set(want[q]) for q, found in got.items())
    every.explain()
    above = capsys.readouterr().out.split("MapInArrow")[0]
    assert "Join" not in above and "Window" in above


@pytest.mark.parametrize("pairs", [1, 50, 1 << 19])
def test_multiprobe_pairs_at_once(monkeypatch, pairs):
    monkeypatch.setattr(approx, "_PAIRS", pairs)
    rng = np.random.default_rng(8)
    ids, cells = np.sort(rng.integers(0, 30, 60)), rng.integers(0, 9, (60, 2))
    points, asked = rng.normal(size=(60, 4)), rng.normal(size=(50, 4))
    q_ids, q_cells = np.sort(rng.integers(0, 20, 50)), rng.integers(0, 12, (50, 3))
    shard = approx._Shard([(ids, points)], [(ids, cells[:, 0]), (ids, cells[:, 1]), (np.array([99]), np.array([3]))])
    got = {}
    for batch in shard.search(q_ids, asked, q_cells, 4):
        for r in batch.to_pylist():
            got.setdefault(r["query_id"], []).append((round(r["distance"], 9), r["id"], r["compared"]))
    for q in set(q_ids.tolist()):
        read = set(q_cells[q_ids == q].ravel().tolist())
        near = {int(i) for i, own in zip(ids, cells) if read & set(own.tolist())}
        far = [
            (round(1 - np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x), 9), int(i))
            for v in asked[q_ids == q] for i, x in zip(ids, points) if int(i) in near
        ]
        assert [(d, i) for d, i, _ in got.get(q, [])] == sorted(far)[:4]
        assert sum(n for _, _, n in got.get(q, [])) == len(near)


def test_clustered_search(spark, clustered):
    corpus, queries, exact = clustered
    path = scratch_path(spark, "clusters")
    approx.build_clusters(corpus, path, cells=12)
    assert recall(found(approx.search_clusters(spark, path, queries, 5, probes=3)), exact) >= 0.9
    assert found(approx.search_clusters(spark, path, queries, 5, probes=12)) == exact
    approx.drop_derived(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        approx.search_clusters(spark, path, queries, 5)


def test_approximate_search_prunes(spark, clustered):
    corpus, queries, _ = clustered
    path = scratch_path(spark, "clusters")
    approx.build_clusters(corpus, path, cells=12)
    assert spark.read.parquet(f"{path}/cells").count() == 1200
    few = approx.search_clusters(spark, path, queries.limit(1), 5, probes=1)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_hashing_visits_few_rows(spark):
    """Without clusters, a search compares a query with a small share of the rows."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(2000, 32)))]
    path = scratch_path(spark, "lsh")
    approx.build_lsh(spark.createDataFrame(rows, CORPUS), path, tables=4, bits=6)
    cells = spark.read.parquet(f"{path}/cells")
    own = cells.where("id < 50").select(F.col("id").alias("q"), "cell")
    met = own.join(cells, "cell").select("q", "id").distinct().count()
    assert met < 0.15 * 50 * 2000


def test_rendering(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    meta = [("github", "u", None, "c", 7, 9, "go", "a/b.go"), None]
    results = spark.createDataFrame(
        [(1, 2, "", meta[1], None), (1, 1, "https://x", meta[0], "text")],
        "query_id bigint, rank int, repo_url string, meta "
        + META_SCHEMA.simpleString()
        + ", content string",
    )
    got = {r.query_id: r.rendered for r in render_results(queries, results).collect()}
    assert got[1] == (
        "### Result 1\n**Repository:** https://x\n**File:** a/b.go\n**Language:** go\n**Chunk:** 7\n"
        "\n**Content:**\n```\ntext\n```\n\n"
        "### Result 2\n**Repository:** Unknown\n\n**Content:**\n```\n\n```\n"
    )
    assert got[2] == "No results found for the query."


def test_embedding_null_filter_runs_the_embedder_once(spark):
    from repoquarry.operators.embed import HashEmbedder, embed_column

    docs = spark.createDataFrame([(1, "a b")], "id bigint, text string")
    embedded = embed_column(docs, "text", HashEmbedder(8)).where(F.col("embedding").isNotNull())
    plan = embedded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_exact_clusters_with_proof(spark, clustered):
    """Radii prune cells by the triangle inequality; the result is the exact one, and far
    fewer cells are read than there are."""
    corpus, queries, exact = clustered
    path = scratch_path(spark, "clusters")
    approx.build_clusters(corpus, path, cells=12)
    got = approx.search_clusters_exact(spark, path, queries, 5, probes=1)
    assert found(got) == exact
    read = {r.query_id: r.cells_read for r in got.collect()}
    assert sum(read.values()) < 12 * len(read)
    odd = spark.createDataFrame([(1, [0.0] * 16), (2, None)], QUERIES)
    assert found(approx.search_clusters_exact(spark, path, odd, 3, probes=1)) == found(search.nearest(corpus, odd, 3))


def test_grid_moves_no_packed_queries(spark, clustered):
    """Beyond the broadcast limit a row meets single queries, never a packed block of them;
    with cells, in small batches and blocks, the grid finds what the broadcast finds."""
    corpus, queries, exact = clustered
    nth = F.array(F.col("id") % 7, F.col("id") % 5 + 10)
    celled = corpus.withColumn("cell", F.explode(nth)).union(corpus.where("id < 0").withColumn("cell", F.lit(99).cast("bigint")))
    q = F.col("query_id")
    asked = queries.withColumn("cells", F.array(q % 7, (q + 1) % 7, q % 5 + 10, F.lit(-1).cast("bigint")))
    best = lambda **limits: found(
        search.rank_candidates(
            search.search_blocks(celled, asked, 4, **limits).groupBy("query_id", "id").agg(F.min("distance").alias("distance")), 4
        )
    )
    want = best()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        assert best(broadcast_bytes=0, block_bytes=700) == want and len(want) == 48
        grid = search.search_blocks(corpus, queries, 5, block_bytes=700, broadcast_bytes=0)
        assert "q_vectors" not in grid._jdf.queryExecution().executedPlan().toString()
        assert found(search.rank_candidates(grid, 5)) == exact
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_recall_computes_the_truth_once(spark, monkeypatch, tmp_path):
    from repoquarry.plans import registered

    vecs = spark.createDataFrame([(i, v, 0) for i, v in vectors(4, 60)], "vec_id bigint, embedding array<float>, label int")
    vecs.write.parquet(f"{tmp_path}/embeddings.parquet")
    made = spark.sparkContext.accumulator(0)
    real = search.nearest

    def counted(*args, **options):
        def seen(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        out = real(*args, **options)
        return out.mapInArrow(seen, out.schema)

    monkeypatch.setattr(registered.search, "nearest", counted)
    got = registered.QUERIES["knn_multiprobe_recall"](spark, str(tmp_path)).collect()
    assert [r.probes for r in got] == [2, 8, 32] and got[2].recall > 0.9
    assert made.value == 300


def test_failed_requests_share_a_pause(spark):
    import time

    from repoquarry.operators.embed import embed_column

    class Refuses:
        dim = 2

        def embed(self, texts):
            if len(texts) > 1:
                raise ValueError("one at a time")
            return [[1.0, 1.0]]

    docs = spark.range(3000).select("id", F.col("id").cast("string").alias("text")).coalesce(1)
    embed_column(docs.limit(10), "text", Refuses(), 5, "quarantine").collect()
    before = time.time()
    done = embed_column(docs, "text", Refuses(), 5, "quarantine")
    assert done.where("embedding IS NOT NULL AND embed_error IS NULL").count() == 3000
    assert time.time() - before < 8  # 600 pauses of 0.1 s, four at a time, were 15 s


def test_files_go_out_by_their_size(tmp_path):
    import pandas as pd
    import pyarrow as pa

    from repoquarry.plans import derived
    from repoquarry.sources import repo_files

    texts = ["é" * 1_500_000 + str(i) for i in range(9)] + ["x"] * 200
    batch = pa.RecordBatch.from_pydict(
        {"repo_url": ["r"] * 209, "commit": ["c"] * 209, "rel": [f"d{i % 3}/f{i}" for i in range(209)], "text": texts}
    )
    assert [b.column_names for b in derived._writer(str(tmp_path))(iter([batch]))] == [["repo_url", "commit"]]
    names = pd.DataFrame({"root": [f"{tmp_path}/r"] * 210, "rel": [f"d{i % 3}/f{i}" for i in range(209)] + ["gone"]})
    parts = list(repo_files._read(iter([names])))
    assert [len(p) for p in parts] == [3, 3, 3, 201]
    assert [c.decode() for p in parts for c in p["content"][: len(p) - (p is parts[-1])]] == texts
    assert parts[-1]["error"].iloc[-1].startswith("FileNotFoundError")

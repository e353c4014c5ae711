import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from repoquarry.operators.embed import HashEmbedder, embed_column, token_counts
from repoquarry.params import IndexParams
from repoquarry.plans import jobs
from repoquarry.session import scratch_path
from repoquarry.sources.index_table import IndexTable
from repoquarry.streaming.incremental import ingest_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for the embedders below

DIM = 16
SCHEMA = "repo_url string, content string, seq bigint"


@pytest.fixture
def table(spark):
    return IndexTable.create(spark, scratch_path(spark, "index"), DIM, 4)


def docs(spark, rows):
    return spark.createDataFrame([(r, c, i) for i, (r, c) in enumerate(rows)], SCHEMA)


def contents(table):
    return sorted((r.repo_url or "", r.content) for r in table.read().collect())


ROWS = [("a", "one"), ("b", "two"), (None, "three"), ("", "four"), ("a", "five\x00")]


class Flaky(HashEmbedder):
    """Fails on every batch with a poisoned text."""

    def embed(self, texts):
        if any("poison" in t for t in texts):
            raise ValueError("refused")
        return super().embed(texts)


class Short(HashEmbedder):
    def embed(self, texts):
        return super().embed(texts)[:-1]


def test_embedder_agrees_with_the_counts(spark):
    texts = ["A b a, été! don't", "x", "", "naïve 漢字 x_1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    counts = {}
    for r in token_counts(rows, "id", "text", 32).collect():
        counts.setdefault(r.id, np.zeros(32))[r.bucket] = r.n
    got = HashEmbedder(32).embed(texts)
    for i, row in enumerate(got):
        want = counts.get(i, np.zeros(32))
        np.testing.assert_allclose(row, want / max(np.linalg.norm(want), 1e-30), atol=1e-6)


def test_failed_batch_is_retried_text_by_text(spark):
    texts = spark.createDataFrame([(i, "poison" if i == 3 else f"t{i}") for i in range(9)], "id int, text string")
    got = embed_column(texts.coalesce(1), "text", Flaky(DIM), 4, "quarantine").orderBy("id").collect()
    assert [r.embedding is None for r in got] == [i == 3 for i in range(9)]
    assert got[3].embed_error == "ValueError: refused"
    with pytest.raises(Exception, match="no embedding for the text at index 3"):
        embed_column(texts.coalesce(1), "text", Flaky(DIM), 4, "fail").collect()


def test_too_few_vectors_are_an_error(spark):
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    with pytest.raises(Exception, match="no embedding"):
        embed_column(texts, "text", Short(DIM)).collect()


def test_append_and_ids(spark, table):
    first = jobs.ingest(table, docs(spark, ROWS))
    assert (first.stored, first.deleted) == (5, 0)
    assert [(r.seq, r.id) for r in first.ids.collect()] == [(i, i + 1) for i in range(5)]
    again = jobs.ingest(table, docs(spark, ROWS))
    assert [r.id for r in again.ids.collect()] == [6, 7, 8, 9, 10]
    assert contents(table) == sorted([(r or "", c.replace("\x00", "")) for r, c in ROWS] * 2)
    stored = table.read().first()
    assert stored.created_at == stored.updated_at and len(stored.embedding) == DIM


def test_ids_without_an_order_column(spark, table):
    rows = docs(spark, [("a", f"t{i}") for i in range(20)] + [("a", " ")]).drop("seq").repartition(3)
    done = jobs.ingest(table, rows, params=IndexParams(on_error="quarantine"))
    ids = [r.id for r in done.ids.collect()]
    assert len(set(ids)) == 20 and min(ids) >= 1 and max(ids) <= 21
    assert table.manifest().max_id == max(ids)


def test_documents_that_share_an_order_or_have_none(spark, table):
    rows = [("a", "one", 5), ("a", "two", 5), ("b", "one", 5), ("b", "none", None), ("b", "nor", None), ("a", "last", 9),
            ("a", "poison", 9), (None, "one", 5)]
    given = spark.createDataFrame(rows, SCHEMA)
    done = jobs.ingest(table, given, Flaky(DIM), IndexParams(on_error="quarantine"))
    assert done.stored == 7 and contents(table) == sorted((r or "", c) for r, c, _ in rows if c != "poison")
    ids = [(r.seq, r.id) for r in done.ids.collect()]
    assert [s for s, _ in ids] == [None, None, 5, 5, 5, 5, 9] and [i for _, i in ids][:6] == [1, 2, 3, 4, 5, 6]
    assert [(r.seq, r.content) for r in done.quarantine.collect()] == [(9, "poison")]
    mixed = spark.createDataFrame([(100, "x", 1), (None, "y", 1), (None, "z", None)], "id bigint, content string, seq bigint")
    assert {r.id for r in jobs.ingest(table, mixed).ids.collect()} == {100, 101, 102}
    assert table.read().count() == 10


def test_brought_ids(spark, table):
    rows = spark.createDataFrame([(7, "x"), (None, "y"), (3, "z")], "id bigint, content string")
    jobs.ingest(table, rows.coalesce(1).withColumn("seq", F.monotonically_increasing_id()))
    assert sorted((r.id, r.content) for r in table.read().collect()) == [(3, "z"), (7, "x"), (8, "y")]
    for clash in ([(3, "again")], [(20, "a"), (20, "b")]):
        with pytest.raises(ValueError, match="used more than once"):
            jobs.ingest(table, spark.createDataFrame(clash, "id bigint, content string"))
    assert table.read().count() == 3


def test_delete_keeps_rows_of_other_and_of_no_repository(spark, table):
    jobs.ingest(table, docs(spark, ROWS))
    assert table.repo_exists("a") and not table.repo_exists("c")
    assert table.delete_repo("a") == 2
    assert table.delete_repo("a") == 0 and table.delete_repo("c") == 0
    assert contents(table) == [("", "four"), ("", "three"), ("b", "two")]
    assert not table.repo_exists("a") and table.repo_exists("")


def test_delete_everything_in_a_bucket(spark, table):
    jobs.ingest(table, docs(spark, [("a", "one"), ("a", "two")]))
    assert table.delete_repo("a") == 2
    assert table.read().count() == 0
    jobs.ingest(table, docs(spark, [("a", "three")]))
    assert contents(table) == [("a", "three")]


def test_replace(spark, table):
    jobs.ingest(table, docs(spark, ROWS))
    before = {r.repo_url: r.created_at for r in table.read().collect()}
    done = jobs.ingest(table, docs(spark, [("a", "new"), ("c", "fresh")]), clear_existing=True)
    assert (done.stored, done.deleted) == (2, 2)
    assert contents(table) == [("", "four"), ("", "three"), ("a", "new"), ("b", "two"), ("c", "fresh")]
    new = table.of_repo("a").first()
    assert new.created_at == before["a"] and new.updated_at > new.created_at
    jobs.ingest(table, docs(spark, [("a", "new")]), clear_existing=True)
    assert table.of_repo("a").count() == 1


def test_one_repository_for_all_documents(spark, table):
    rows = spark.createDataFrame([("x",), ("y",)], "content string")
    jobs.ingest(table, rows, repo_url="u")
    jobs.ingest(table, rows, repo_url="u", clear_existing=True)
    assert contents(table) == [("u", "x"), ("u", "y")]


def test_quarantine(spark, table):
    rows = [("a", "good"), ("a", ""), ("a", " \n"), ("a", None), ("a", "poison")]
    done = jobs.ingest(table, docs(spark, rows), Flaky(DIM), IndexParams(on_error="quarantine"))
    assert contents(table) == [("a", "good")] and done.stored == 1
    assert {(r.seq, r.error) for r in done.quarantine.collect()} == {
        (1, "content is missing"),
        (2, "content is white space only"),
        (3, "content is missing"),
        (4, "ValueError: refused"),
    }
    assert [r.seq for r in done.ids.collect()] == [0]


@pytest.mark.parametrize("bad", ["", " ", None, "poison"])
def test_failed_ingest_changes_nothing(spark, table, bad):
    jobs.ingest(table, docs(spark, ROWS))
    before, version = contents(table), table.manifest().version
    with pytest.raises(Exception):
        jobs.ingest(
            table,
            docs(spark, [("a", "new"), ("a", bad)]),
            Flaky(DIM),
            IndexParams(on_error="fail"),
            clear_existing=True,
        )
    assert contents(table) == before and table.manifest().version == version


@pytest.mark.parametrize("on_error", ["fail", "quarantine"])
def test_an_outage_keeps_the_old_rows(spark, table, on_error):
    class Down(HashEmbedder):
        def embed(self, texts):
            raise OSError("no service")

    jobs.ingest(table, docs(spark, ROWS))
    before = contents(table)
    with pytest.raises(Exception):
        jobs.ingest(table, docs(spark, ROWS), Down(DIM), IndexParams(on_error=on_error), clear_existing=True)
    assert contents(table) == before


def test_one_refused_text_keeps_its_repository(spark, table):
    jobs.ingest(table, docs(spark, ROWS))
    before, some = contents(table), IndexParams(on_error="quarantine")
    for bad in ("poison", "", " "):
        with pytest.raises(jobs.NotReplaced):
            jobs.ingest(table, docs(spark, [("a", "new"), ("a", bad)]), Flaky(DIM), some, clear_existing=True)
    assert contents(table) == before
    # A repository that had no rows loses none.
    jobs.ingest(table, docs(spark, [("a", "new"), ("c", "poison")]), Flaky(DIM), some, clear_existing=True)
    assert ("a", "new") in contents(table) and ("a", "one") not in contents(table)


def test_compaction_and_vacuum(spark, table):
    jobs.ingest(table, docs(spark, ROWS))
    jobs.ingest(table, docs(spark, [("a", "six")]), clear_existing=True)
    table.delete_repo("b")
    rows = sorted((r.id, r.repo_url or "", r.content, r.created_at) for r in table.read().collect())
    table.compact()
    assert len(table.manifest().runs) == 1 and table.vacuum(1) == 0
    assert table.vacuum(0) > 3 and table.vacuum(0) == 0
    assert sorted((r.id, r.repo_url or "", r.content, r.created_at) for r in table.read().collect()) == rows
    assert jobs.ingest_one(table, "next") > max(r[0] for r in rows)


def test_approximate_search_follows_the_index(spark):
    """Each text finds itself, and only while it is live."""
    table = IndexTable.create(spark, scratch_path(spark, "index"), 512, 4)
    texts = [f"alpha{i} beta{i * 7} gamma{i % 5}" for i in range(60)]
    jobs.ingest(table, docs(spark, [(f"r{i % 6}", t) for i, t in enumerate(texts)]))
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")

    def own():
        rows = jobs.search(table, asked, k=1, approximate=True).where("distance < 1e-6").collect()
        return {r.query_id for r in rows if r.content == texts[r.query_id]}

    assert own() == set(range(60))
    table.delete_repo("r1")
    jobs.ingest(table, docs(spark, [("r2", "something else")]), clear_existing=True)
    assert own() == {i for i in range(60) if i % 6 not in (1, 2)}
    jobs.ingest(table, docs(spark, [("r1", texts[1])]))
    table.compact()
    table.vacuum(0)
    assert own() == {i for i in range(60) if i % 6 not in (1, 2)} | {1}


def test_equal_numbers_are_refused(spark, table):
    rows = spark.createDataFrame([("a", "x", 0), ("a", "y", 0)], SCHEMA)
    with pytest.raises(ValueError, match="more than once"):
        jobs.ingest(table, rows, dense_seq=True)


def test_nothing_to_ingest(spark, table):
    with pytest.raises(ValueError, match="no documents"):
        jobs.ingest(table, docs(spark, []).limit(0))


def test_single_document_and_foreign_meta(spark, table):
    got = jobs.ingest_one(table, "hello", '{"file_path":"a.py","mine":{"x":1}}', 42)
    [row] = table.read().collect()
    assert got == row.id == 42
    assert row.meta.file_path == "a.py" and row.meta_json == '{"file_path":"a.py","mine":{"x":1}}'
    assert jobs.ingest_one(table, "world") == 43
    with pytest.raises(Exception, match="white space"):
        jobs.ingest_one(table, " ")


def test_concurrent_publish_is_refused(spark, table):
    stale = table.manifest()
    jobs.ingest(table, docs(spark, ROWS))
    with pytest.raises(Exception, match="exist"):
        table.publish_runs(["other"], stale, 0)
    assert len(contents(table)) == 5


def test_wrong_dimension(spark, table):
    with pytest.raises(ValueError, match="dimensions"):
        jobs.ingest(table, docs(spark, ROWS), HashEmbedder(DIM + 1))


def test_create_open_drop(spark, table):
    with pytest.raises(Exception, match="exist"):
        IndexTable.create(spark, table.path, DIM, 4)
    assert IndexTable.open(spark, table.path, 99, 9).manifest().dim == DIM
    assert table.read().count() == 0 and not table.repo_exists("a")
    table.drop()
    assert not table.exists()
    table.drop()


def test_repo_lookup_reads_one_bucket(spark, table):
    jobs.ingest(table, docs(spark, [(f"r{i}", "x") for i in range(20)]))
    plan = table.of_repo("r1")._jdf.queryExecution().executedPlan().toString()
    assert "repo_bucket" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_existing(spark, table):
    jobs.ingest(table, docs(spark, ROWS))
    asked = spark.createDataFrame([("a",), ("zz",), ("",), (None,)], "repo_url string")
    assert sorted(r.repo_url for r in table.existing(asked).collect()) == ["", "a"]


def test_stream_stores_each_batch_once(spark, table, tmp_path):
    source = str(tmp_path / "in")
    docs(spark, [("a", "one"), ("b", "two")]).drop("seq").write.mode("append").parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema("repo_url string, content string").parquet(source)
        query = ingest_stream(table, stream, "s", str(tmp_path / checkpoint))
        query.awaitTermination()

    run("one")
    assert contents(table) == [("a", "one"), ("b", "two")]
    docs(spark, [("c", "three")]).drop("seq").write.mode("append").parquet(source)
    run("one")
    assert contents(table) == [("a", "one"), ("b", "two"), ("c", "three")]
    # A checkpoint lost after the rows were stored delivers its batches again.
    run("two")
    assert contents(table) == [("a", "one"), ("b", "two"), ("c", "three")]


def test_many_batches_are_few_runs(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr("repoquarry.streaming.incremental.MAX_RUNS", 3)
    source = str(tmp_path / "in")
    for i in range(8):
        docs(spark, [(f"r{i}", f"text {i}")]).drop("seq").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("repo_url string, content string").option("maxFilesPerTrigger", 1).parquet(source)
    ingest_stream(table, stream, "s", str(tmp_path / "c")).awaitTermination()
    assert contents(table) == [(f"r{i}", f"text {i}") for i in range(8)]
    assert len(table.manifest().runs) <= 4


class Slow(HashEmbedder):
    """Takes its time and tells, in the first place of each vector, how many requests of
    its process were running when it answered."""

    def __init__(self, dim, pause):
        super().__init__(dim)
        self.pause = pause

    def embed(self, texts):
        import threading
        import time

        # One counter per worker process, made there (a lock does not pickle).
        state = threading.__dict__.setdefault("_slow_embedder", {"lock": threading.Lock(), "running": 0})
        with state["lock"]:
            state["running"] += 1
            now = state["running"]
        time.sleep(self.pause)
        out = super().embed(texts)
        with state["lock"]:
            state["running"] -= 1
        out[:, 0] = now
        return out


def test_requests_in_flight(spark):
    texts = spark.createDataFrame([(i, f"text number {i}") for i in range(120)], "id bigint, content string").coalesce(1)
    got = embed_column(texts, "content", Slow(8, 0.05), batch_size=2, in_flight=3).orderBy("id").collect()
    seen = [r.embedding[0] for r in got]
    assert max(seen) == 3 and min(seen) >= 1  # three at once, never more
    plain = HashEmbedder(8).embed([r.content for r in got])
    assert [list(r.embedding[1:]) for r in got] == [list(v[1:]) for v in plain]  # in order
    one = embed_column(texts, "content", Slow(8, 0.0), batch_size=2, in_flight=1).collect()
    assert max(r.embedding[0] for r in one) == 1

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

import repoquarry.__main__ as command
from repoquarry.operators.embed import HashEmbedder
from repoquarry.params import IndexParams
from repoquarry.plans import jobs
from repoquarry.session import scratch_path
from repoquarry.sources.index_table import IndexTable
from repoquarry.sources import repo_files
from repoquarry.sources.repo_files import list_files, read_files

URL = "https://github.com/o/"


@pytest.fixture(scope="module")
def snapshots(tmp_path_factory):
    root = tmp_path_factory.mktemp("repos")
    notebook = {"cells": [{"cell_type": "code", "source": "print('in notebook')"}], "nbformat": 4}
    one = {
        "src/a.py": b"def a():\n    return 1\n",
        "src/deep/er/still/b.go": b"package b\n",
        "pkg/__init__.py": b"# init\n",
        ".github/w.yml": b"on: push\n",
        ".git/config": b"secret",
        "x/node_modules/y.js": b"no",
        ".env": b"no",
        "logo.PNG": b"\x89PNG",
        "big.txt": b"x" * 51_201,
        "edge.md": b"word " * 10_240,
        "blank.md": " \x1c\n".encode(),
        "n.ipynb": json.dumps(notebook).encode(),
        "bad.ipynb": b"{",
        "crlf.txt": b"a\r\nb\rc \xff",
        "same1.md": b"the same text\n",
        "same2.md": b"the same text\n",
        "_hidden/.dot": b"hidden text\n",
    }
    two = {"same3.md": b"the same text\n", "main.go": "\n".join(map(str, range(100))).encode()}
    for name, files in (("one", one), ("two", two)):
        for rel, content in files.items():
            path = root / name / rel
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content)
    os.symlink(root / "one" / "src", root / "two" / "link")
    os.symlink(root / "one" / "gone", root / "two" / "dangling")
    return root


def manifest(spark, root, names=("one", "two")):
    rows = [(f"{URL}{n}", f"c-{n}", str(root / n)) for n in names]
    return spark.createDataFrame(rows, "repo_url string, commit string, root string")


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_listing(spark, snapshots, levels):
    got = {(r.repo_url[-3:], r.rel): r.size for r in list_files(manifest(spark, snapshots), levels).collect()}
    assert ("two", "main.go") in got and ("two", "link/a.py") not in got
    assert ("two", "dangling") not in got
    assert got["one", "pkg/__init__.py"] == 7 and got["one", "_hidden/.dot"] == 12
    assert got["one", "src/deep/er/still/b.go"] == 10 and got["one", ".env"] == 2
    assert not any(rel.startswith(".git/") or "node_modules" in rel for _, rel in got)
    assert len(got) == 15 + 2


def test_reading(spark, snapshots):
    files = list_files(manifest(spark, snapshots))
    extra = files.limit(1).withColumn("rel", F.lit("gone.txt"))
    got = {(r.repo_url, r.rel): r for r in read_files(files.unionByName(extra)).collect()}
    assert bytes(got[f"{URL}one", "crlf.txt"].content) == b"a\r\nb\rc \xff"
    gone = next(r for (_, rel), r in got.items() if rel == "gone.txt")
    assert gone.content is None and "FileNotFoundError" in gone.error


@pytest.fixture(scope="module")
def indexed(spark, snapshots):
    table = IndexTable.create(spark, scratch_path(spark, "index"), 512, 4)
    bad = spark.createDataFrame([("ftp://x", "c", "/nowhere")], "repo_url string, commit string, root string")
    params = IndexParams(dim=512)
    done = jobs.index_repositories(table, manifest(spark, snapshots).unionByName(bad), params)
    return table, done


def test_summary(indexed):
    _, done = indexed
    got = {r.repo_url: r.asDict() for r in done.summary.collect()}
    one = got[f"{URL}one"]
    assert one == {
        "repo_url": f"{URL}one",
        "commit": "c-one",
        "total_files": 14,
        "processed_files": 11,  # ten kept and the one that failed
        "skipped_binary": 1,
        "skipped_large": 1,
        "skipped_empty": 1,
        "failed_files": 1,
        "total_chunks": one["total_chunks"],
    }
    assert [r.rel for r in done.failures.collect()] == ["bad.ipynb"]
    assert [r.repo_url for r in done.bad_urls.collect()] == ["ftp://x"]


def test_stored_rows(indexed):
    table, done = indexed
    rows = table.read().collect()
    assert done.ingested.stored == len(rows)
    one = sorted((r for r in rows if r.repo_url == f"{URL}one"), key=lambda r: r.meta.chunk_index)
    assert [r.meta.chunk_index for r in one] == list(range(len(one)))
    assert {r.meta.total_chunks for r in one} == {len(one)}
    assert [r.id for r in sorted(rows, key=lambda r: r.id)] == list(range(1, len(rows) + 1))
    same = [r for r in rows if "the same text" in r.content]
    assert sorted((r.repo_url, r.meta.file_path) for r in same) == [
        (f"{URL}one", "same1.md"),
        (f"{URL}two", "same3.md"),
    ]
    by_path = {r.meta.file_path: r for r in one}
    assert by_path["crlf.txt"].content == "a\nb\nc �"
    assert "## Code Cell 1" in by_path["n.ipynb"].content
    assert by_path["n.ipynb"].meta.language == "python" and by_path["edge.md"].meta.language is None
    assert {r.meta.commit for r in one} == {"c-one"} and {r.meta.source for r in one} == {"github"}


def test_indexing_again_replaces(spark, snapshots, indexed):
    table, done = indexed
    before = table.read().count()
    jobs.index_repositories(table, manifest(spark, snapshots, ["two"]), IndexParams(dim=512))
    assert table.read().count() == before


def test_search(spark, indexed):
    table, _ = indexed
    queries = spark.createDataFrame([(1, "hidden text"), (2, "code cell python print in notebook")], "query_id bigint, query string")
    best = {r.query_id: r for r in jobs.search(table, queries).where("rank = 1").collect()}
    assert best[1].meta.file_path == "_hidden/.dot" and best[2].meta.file_path == "n.ipynb"
    assert jobs.search(table, queries).count() == 4
    shown = {r.query_id: r.rendered for r in jobs.search_rendered(table, queries, k=1).collect()}
    assert "**File:** _hidden/.dot" in shown[1] and shown[1].startswith("### Result 1\n")
    none = {r.rendered for r in jobs.search_rendered(table, queries, max_distance=-1.0).collect()}
    assert none == {"No results found for the query."}


def test_blank_query_is_an_error(spark, indexed):
    queries = spark.createDataFrame([(1, " \n")], "query_id bigint, query string")
    with pytest.raises(Exception, match="white space"):
        jobs.search(indexed[0], queries).collect()


def test_search_of_an_empty_index(spark):
    table = IndexTable.create(spark, scratch_path(spark, "index"), 64, 4)
    queries = spark.createDataFrame([(1, "x")], "query_id bigint, query string")
    [row] = jobs.search_rendered(table, queries).collect()
    assert row.rendered == "No results found for the query."


def test_nothing_to_index(spark, tmp_path):
    table = IndexTable.create(spark, scratch_path(spark, "index"), 64, 4)
    (tmp_path / "empty").mkdir()
    done = jobs.index_repositories(table, manifest(spark, tmp_path, ["empty"]), IndexParams(dim=64))
    assert done.ingested is None and done.summary.count() == 0


def test_group_scope(spark, snapshots):
    files = read_files(list_files(manifest(spark, snapshots)).where("size <= 51200"))
    params = IndexParams(scope="group")
    done = jobs.build_chunks(files, params)
    rows = done.chunks.collect()
    go = [r for r in rows if r.meta.language == "go" and r.repo_url == f"{URL}two"]
    assert [r.content.split("\n")[0] for r in sorted(go, key=lambda r: r.ordinal)] == ["0", "25", "50", "75"]
    assert all(r.meta.file_paths == ["main.go"] and r.meta.file_path is None for r in go)
    semantic = [r for r in rows if r.meta.language is None and r.repo_url == f"{URL}one"]
    assert all(len(r.meta.file_paths) == 1 for r in semantic)  # token chunks end with their file
    members = done.group_files.where("label = 'semantic'").where(f"repo_url = '{URL}one'")
    assert members.count() == members.first().files > 3


def test_group_files_are_stored_with_the_rows(spark, snapshots):
    table = IndexTable.create(spark, scratch_path(spark, "index"), 64, 4)
    params = IndexParams(dim=64, scope="group")
    jobs.index_repositories(table, manifest(spark, snapshots), params)
    jobs.index_repositories(table, manifest(spark, snapshots, ["two"]), params)
    rows = table.group_files().collect()
    assert len(rows) == len({(r.repo_url, r.label, r.rel) for r in rows})
    assert {r.rel for r in rows if r.repo_url == f"{URL}two"} == {"main.go", "same3.md"}
    table.delete_repo(f"{URL}two")
    assert {r.repo_url for r in table.group_files().collect()} == {f"{URL}one"}


def test_a_repository_that_is_there_twice_is_refused(spark, snapshots):
    table = IndexTable.create(spark, scratch_path(spark, "index"), 64, 4)
    twice = manifest(spark, snapshots, ["one", "one", "two"])
    done = jobs.index_repositories(table, twice, IndexParams(dim=64))
    assert [r.repo_url for r in done.bad_urls.collect()] == [f"{URL}one"] * 2
    assert {r.repo_url for r in table.read().collect()} == {f"{URL}two"}
    files = read_files(list_files(manifest(spark, snapshots, ["two"])))
    with pytest.raises(ValueError, match="more than once"):
        jobs.build_chunks(files.union(files))


def test_a_missing_root_keeps_the_old_rows(spark, snapshots):
    table = IndexTable.create(spark, scratch_path(spark, "index"), 64, 4)
    good = manifest(spark, snapshots)
    jobs.index_repositories(table, good, IndexParams(dim=64))
    before = sorted((r.repo_url, r.content) for r in table.read().collect())
    gone = good.withColumn("root", F.when(F.col("repo_url").endswith("one"), F.lit("/nowhere")).otherwise(F.col("root")))
    done = jobs.index_repositories(table, gone, IndexParams(dim=64))
    assert sorted((r.repo_url, r.content) for r in table.read().collect()) == before
    [failed] = done.failures.where(f"repo_url = '{URL}one'").collect()
    assert failed.rel == "." and failed.error.startswith("FileNotFoundError")
    assert {r.repo_url: r.failed_files for r in done.summary.collect()} == {f"{URL}one": 1, f"{URL}two": 0}


def test_a_folder_that_cannot_be_listed_is_an_error(snapshots, monkeypatch):
    real = os.scandir

    def scandir(path):
        if path.endswith("deep"):
            raise PermissionError(13, "Permission denied", path)
        return real(path)

    monkeypatch.setattr(repo_files.os, "scandir", scandir)
    found = {rel: (size, error) for rel, size, error, _ in repo_files._entries(str(snapshots / "one"), "", True)}
    assert found["src/deep"] == (None, "PermissionError: Permission denied")
    assert found["src/a.py"] == (22, None) and "src/deep/er/still/b.go" not in found


def test_same_result_for_any_partitioning(spark, snapshots):
    files = read_files(list_files(manifest(spark, snapshots)).where("size <= 51200"))
    results = []
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = jobs.build_chunks(files.repartition(int(n), F.rand(1))).chunks.collect()
        results.append(sorted((r.ordinal, r.content, r.meta.chunk_index) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_parameters_are_checked():
    for bad in ({"scope": "x"}, {"on_error": "x"}, {"chunk_lines": 15}, {"token_overlap": 1024}, {"dim": 0}):
        with pytest.raises(ValueError):
            IndexParams(**bad)


def test_embedder_is_a_plug_in(spark):
    class Fixed(HashEmbedder):
        def embed(self, texts):
            return super().embed(["x"] * len(texts))

    table = IndexTable.create(spark, scratch_path(spark, "index"), 8, 4)
    docs = spark.createDataFrame([("a",), ("b",)], "content string")
    jobs.ingest(table, docs, Fixed(8))
    assert len({tuple(r.embedding) for r in table.read().collect()}) == 1


def test_command_line(spark, snapshots, tmp_path, monkeypatch):
    manifest(spark, snapshots).write.parquet(str(tmp_path / "manifest"))
    spark.createDataFrame([(1, "hidden text")], "query_id bigint, query string").write.parquet(
        str(tmp_path / "queries")
    )

    def run(*args):
        # The scratch of the shared test session has to stay.
        monkeypatch.setattr(command, "drop_scratch", lambda spark: None)
        monkeypatch.setattr(sys, "argv", ["repoquarry", *args])
        command.main()

    t = str(tmp_path)
    run("index", f"{t}/manifest", f"{t}/index", "--dim", "512", "--report", f"{t}/report")
    run("search", f"{t}/index", f"{t}/queries", f"{t}/found", "--rendered")
    [row] = spark.read.parquet(f"{t}/found").collect()
    assert "_hidden/.dot" in row.rendered
    assert spark.read.parquet(f"{t}/report/summary").count() == 2

"""Numbering, groups and deduplication against brute force, with a hot group."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from repoquarry.operators import chunk, dedup, group
from repoquarry.operators.numbering import dense_numbers, number_rows, running_totals
from repoquarry.session import materialise


@pytest.fixture(params=["1", "7"])
def partitions(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def hot_rows(n=900, seed=1):
    """Two thirds of the rows are in one group; one group has no name."""
    rng = random.Random(seed)
    groups = ["hot", "hot", "hot", "hot", "a", None]
    rows = [(rng.choice(groups), f"k{i:05d}", rng.randint(0, 5)) for i in range(n)]
    rng.shuffle(rows)
    return rows


def test_running_totals(spark, partitions):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, k string, w int").repartition(5)
    got = running_totals(df, ["g"], ["k"], F.col("w"), before_all="overall").collect()
    seen, overall, want = defaultdict(int), 0, {}
    totals = Counter()
    for g, _, w in rows:
        totals[g] += w
    for g, k, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        want[k] = (seen[g], totals[g], overall)
        seen[g] += w
        overall += w
    assert {r.k: (r.before, r.total, r.overall) for r in got} == want


def test_number_rows_without_groups(spark, partitions):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int")
    got = {r.k: r.n for r in number_rows(df, [], ["k"], "n").collect()}
    assert got == {i: i for i in range(101)}


def test_dense_numbers(spark):
    df = spark.range(100, numPartitions=7).withColumn("m", F.monotonically_increasing_id())
    written = materialise(df, "dense")
    got = dense_numbers(written, "m", "n").orderBy("m").collect()
    assert [r.n for r in got] == list(range(100))


def repo_texts(seed=2):
    rng = random.Random(seed)
    out = []
    for repo, files in (("r1", 40), ("r2", 5), ("r3", 1)):
        for i in range(files):
            language = rng.choice(["go", "go", "ruby", None])
            lines = [rng.choice(["x", "yy", "", "same"]) for _ in range(rng.choice([1, 2, 9, 30]))]
            out.append((repo, f"d{i % 3}/f{i:03d}", language, "\n".join(lines)))
    rng.shuffle(out)
    return out


TEXTS = "repo_url string, rel string, language string, text string"


@pytest.mark.parametrize(("lines", "overlap"), [(40, 15), (5, 2), (4, 0), (3, 2)])
def test_group_windows_are_windows_of_the_joined_text(spark, lines, overlap):
    rows = repo_texts()
    texts = spark.createDataFrame(rows, TEXTS)
    joined = defaultdict(list)
    for repo, rel, language, text in sorted(rows, key=lambda r: r[1]):
        joined[repo, language or "semantic"].append(text)
    keys = list(joined)
    whole = spark.createDataFrame([("\n".join(joined[k]),) for k in keys], "t string").coalesce(1)
    want = {
        (*k, i): w
        for k, r in zip(
            keys,
            whole.select(chunk.line_windows(F.col("t"), lines, overlap, None).alias("c")).collect(),
        )
        for i, w in enumerate(r.c)
    }
    got = group.group_line_windows(texts, lines, overlap).collect()
    assert {(r.repo_url, r.label, r.window): r.chunk for r in got} == want


def test_group_lines_and_files(spark):
    rows = repo_texts(3)
    texts = spark.createDataFrame(rows, TEXTS)
    got = defaultdict(dict)
    for r in group.group_lines(texts).collect():
        got[r.repo_url, r.label][r.line_no] = r.line
    members = defaultdict(dict)
    for r in group.group_files(texts).collect():
        members[r.repo_url, r.label][r.position] = r.rel
    for key, numbered in got.items():
        own = sorted((r for r in rows if (r[0], r[2] or "semantic") == key), key=lambda r: r[1])
        assert [numbered[i] for i in range(len(numbered))] == "\n".join(r[3] for r in own).split("\n")
        assert [members[key][i] for i in range(len(own))] == [r[1] for r in own]


def test_path_lists_have_every_path(spark):
    rows = repo_texts(3)
    members = group.group_files(spark.createDataFrame(rows, TEXTS))
    lists = defaultdict(list)
    for r in sorted(group.path_pages(members, 5).collect(), key=lambda r: r.page):
        assert len(r.file_paths) <= 5
        lists[r.repo_url, r.label] += r.file_paths
    want = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        want[r[0], r[2] or "semantic"].append(r[1])
    assert lists == want and max(map(len, want.values())) > 5


def test_windows_name_the_files_they_have_lines_of(spark):
    rows = repo_texts(5)
    got = group.group_line_windows(spark.createDataFrame(rows, TEXTS), 6, 2).collect()
    for r in got:
        own = sorted((x for x in rows if (x[0], x[2] or "semantic") == (r.repo_url, r.label)), key=lambda x: x[1])
        owner = [x[1] for x in own for _ in x[3].split("\n")]
        assert r.file_paths == sorted(set(owner[r.window * 4 : r.window * 4 + 6]))


def unit_rows(seed=4):
    """Files whose chunks repeat within a file, between files, languages and
    repositories; one text makes up a third of all."""
    rng = random.Random(seed)
    rows = []
    for repo in ("r1", "r1", "r1", "r2"):
        for i in range(12):
            label = rng.choice(["go", "python", "semantic"])
            texts = ["hot" if rng.random() < 0.34 else f"t{rng.randint(0, 30)}" for _ in range(6)]
            rows.append((repo, label, f"{len(rows):03d}-{i}", texts))
    rng.shuffle(rows)
    return rows


def test_first_of_equal_chunks_wins(spark, partitions):
    rows = unit_rows()
    units = spark.createDataFrame(rows, "repo_url string, label string, unit string, chunks array<string>")
    units = units.withColumn("digests", dedup.digests(F.col("chunks")))
    groups = units.groupBy("repo_url", "label").agg(F.min("unit").alias("first_rel"))
    numbered = dedup.number_kept(dedup.first_of_equals(units, groups))
    got = dedup.kept_chunks(units, numbered).collect()

    first = {}
    for repo, label, unit, _ in rows:
        first[repo, label] = min(unit, first.get((repo, label), unit))
    seen, want, count = set(), [], Counter()
    ordered = sorted(rows, key=lambda r: (r[0], first[r[0], r[1]], r[2]))
    for repo, _, unit, texts in ordered:
        for pos, text in enumerate(texts):
            if (repo, text) not in seen:
                seen.add((repo, text))
                want.append((repo, unit, pos, text, count[repo], len(want)))
                count[repo] += 1
    assert sorted((r.repo_url, r.unit, r.pos, r.chunk, r.chunk_index, r.ordinal) for r in got) == sorted(want)
    assert all(r.total_chunks == count[r.repo_url] for r in got)

    counted = {r.repo_url: (r.chunks, r.unique_chunks) for r in dedup.duplicate_counts(units).collect()}
    assert counted == {
        repo: (sum(len(r[3]) for r in rows if r[0] == repo), n) for repo, n in count.items()
    }

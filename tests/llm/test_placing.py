"""URL rules, shards and mixes against brute force."""

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from repoquarry.llm import mixing, registered, sharding, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- URL rules -----------------------------------------------------------------------


def judged(url, rules):
    """Every rule is tried on every URL."""
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    hits = [r for r in rules if re.search(r.pattern, f".{host}{path}")]
    best = max(hits, key=lambda r: (r.rank, len(r.name), r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/17?x=/es/", "http://example.org/en/2",
    "http://myexample.org/es/1", "http://org/", "http://org", "http://borg/", "http://x.com/fr/1",
    "http://x.com/de/", "http://x.com/DE/", "http://com/de/9#a", "http://www.cheap-pills.example.com/de/1",
    "http://www.cheap-pills.example.com/en/1", "http://cheappills.com/", "ftp:/none", "", None,
    "://", "http://h?x/de/", "http://x.com/free/casino/", "http://x.com/CASINO", "a://b://c.org/d",
    "http://u:p@x.com:80/fr/", "http://é.org/ü/", "http://x.example.org/en/1", "\n://q.org/\n?",
    "http://" + "a." * 5000 + "org/es/",
]


def test_urls_match_brute_force(spark):
    rows = [(i, u, "mine", 7) for i, u in enumerate(URLS * 3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, token string, _url int")
    rules = registered.URL_RULES + [url_filter.Rule("any", "^$", "allow", 0)]
    out = url_filter.judge_urls(df, url_filter.rule_table(spark, rules))
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, url, *_ in rows:
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == judged(url, rules), url
        assert r.token == "mine" and r._url == 7


def test_rules_wait_under_their_rarest_token(spark):
    keys = spark.createDataFrame([(["a", "b", ""],), (["a", ""],), (["a", ""],)], "_tokens array<string>")
    rules = url_filter.rule_table(
        spark, [url_filter.word_rule("a", "b"), url_filter.Rule("r", "x", "block", 0)]
    )
    index = {r.name: r.token for r in url_filter.token_index(keys, rules).collect()}
    assert index == {"a b": "b", "r": ""}


def test_no_urls(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, verdict string")
    out = url_filter.judge_urls(df, url_filter.rule_table(spark, registered.URL_RULES))
    assert out.collect() == [] and out.columns.count("verdict") == 1


# --- Shards --------------------------------------------------------------------------


def test_table_is_filled_in_turns():
    names, size = ["a", "b", "c"], 11
    orders = []
    for name in names:
        import hashlib

        d = hashlib.sha256(name.encode()).digest()
        first, step = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        orders.append([(first + i * step) % size for i in range(size)])
    owner = {}
    while len(owner) < size:
        for i, order in enumerate(orders):
            free = [s for s in order if s not in owner]
            if free:
                owner[free[0]] = i
    assert sharding.lookup_table(names, size) == [owner[s] for s in range(size)]


def test_table_is_even_and_steady():
    names = [f"s{i}" for i in range(20)]
    full = sharding.lookup_table(names, 5003)
    shares = [full.count(i) for i in range(20)]
    assert max(shares) - min(shares) <= 1
    less = sharding.lookup_table(names[:-1], 5003)
    moved = sum(a != b for a, b in zip(full, less) if a != 19)
    assert moved < 0.2 * 5003
    weighted = sharding.lookup_table(["x", "y"], 5003, [3, 1])
    assert abs(weighted.count(0) / 5003 - 0.75) < 0.01


@pytest.mark.parametrize("names, size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_tables_that_cannot_be(names, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, size)


def test_placement(spark, tmp_path):
    rows = [(i, f"t{i}", "old") for i in range(500)] + [(None, f"n{i}", "old") for i in range(300)]
    rows += [(7, "t7", "old")] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    placed = sharding.place(df, "doc_id", ["a", "b", "c", "d"], 1009, spread=("text",))
    got = placed.collect()
    table = sharding.lookup_table(["a", "b", "c", "d"], 1009)
    hashed = dict(df.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id") % 1009).distinct().collect())
    assert len(got) == len(rows)
    for r in got:
        assert table[r.slot] == r.shard
        if r.doc_id is not None:
            assert r.slot == hashed[r.doc_id] % 1009
    assert len({r.shard for r in got if r.doc_id is None}) == 4
    sharding.write_shards(placed, str(tmp_path / "out"), parts=2)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.count() == len(rows)
    assert sharding.place(df.limit(0), "doc_id", ["a"], 11).collect() == []


def test_placement_without_spread_columns(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id bigint")
    assert {r.shard for r in sharding.place(df, "doc_id", ["a"], 3).collect()} == {0}


# --- Mixes ---------------------------------------------------------------------------


def wanted_targets(sizes, weights=(5, 2, 1), share=1.5):
    """By the words of the contract: share, stop, reshare."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_ones, target = share * sum(sizes.values()), set(order), {}
    while open_ones:
        total = sum(weight[s] for s in open_ones)
        above = {s for s in open_ones if left * weight[s] / total >= 2 * sizes[s]}
        if not above:
            target |= {s: left * weight[s] / total for s in open_ones}
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in above)
        open_ones -= above
    return target


def some_docs():
    docs = []
    for i in range(240):
        source = "hot" if i % 3 == 0 else [None, "a", "b", "", "é", "Z", "tiny"][i % 7]
        if source == "tiny" and i > 20:
            source = "a"
        docs.append((i, " ".join(f"w{j}" for j in range(i * 7 % 90)), "en", source, 1))
    docs += [(5, "same words here", "en", "hot", 1)] * 4
    docs += [(None, "x\ty\nz ", None, None, None), (900, None, "en", "hot", 1), (901, "", "de", "nil", 0)]
    docs += [(902, "long " * 20_000, "en", "b", 1)]
    return docs


def test_mix(spark):
    docs = some_docs()
    df = spark.createDataFrame(docs, DOCS).withColumn("_row", F.lit("x")).withColumn("_n", F.lit(1))
    got = mixing.mixed_words(df, block=64).collect()
    assert len(got) == len(docs)
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {(d[0], len(WORD.findall(d[1] or ""))): d[3] for d in docs}
    for d in docs:
        sizes[d[3]] += len(WORD.findall(d[1] or ""))
    target = wanted_targets(sizes)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s]
        assert math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5
    assert sorted(map(repr, mixing.mixed_words(df, block=64).collect())) == sorted(map(repr, got))


def test_schedule_keeps_weights_in_every_stretch(spark):
    sources = spark.createDataFrame([("a", 30_000), ("b", 30_000), ("c", 30_000)], "_source string, _of bigint")
    targets = mixing.source_targets(sources, weights=(6, 3, 1), share=0.5)
    shares = {r._rank: r._take / 45_000 for r in targets.collect()}
    slots = sorted(tuple(r) for r in mixing.slot_schedule(targets, 10).collect())
    ranks = [s[1] for s in slots]
    for size in (50, 500, 4500):
        for start in range(0, 4500 - size + 1, size):
            for rank, share in shares.items():
                assert abs(ranks[start : start + size].count(rank) - share * size) <= 4
    for rank in shares:
        turns = [s[2] for s in slots if s[1] == rank]
        assert turns == list(range(len(turns)))


def test_mixed_documents(spark):
    docs = some_docs()
    df = spark.createDataFrame(docs, DOCS).withColumn("_a", F.lit(3))
    counted = mixing.mixed_words(df, block=64)
    rows = mixing.mix_documents(df, block=64)
    assert rows.columns == df.columns
    words, got = defaultdict(int), rows.collect()
    texts = {(d[0], d[1]) for d in docs}
    cut = 0
    for r in got:
        words[r.doc_id] += len(WORD.findall(r.text))
        if (r.doc_id, r.text) not in texts:
            cut += 1
            assert any(i == r.doc_id and t and r.text in t for i, t in texts)
    want = {r.doc_id: r.w for r in counted.groupBy("doc_id").agg(F.sum("taken").alias("w")).collect()}
    assert {k: v for k, v in want.items() if v} == dict(words)
    assert cut <= 2 * 8


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mixed_words(empty).collect() == []
    assert mixing.mix_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 1)], DOCS)
    assert [(r["size"], r.target, r.taken) for r in mixing.mixed_words(blank).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix_documents(blank).collect() == []

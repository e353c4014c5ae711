"""Near copies, repeated lines, near vectors and the pipeline against brute force."""

import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from repoquarry.llm import line_dedup, permutation_index, registered, simhash
from repoquarry.llm.common import table

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- SimHash -------------------------------------------------------------------------


def print_of(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints, distance):
    """Component of each row, over all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def check_groups(rows, docs, width, distance):
    prints = [print_of(d[1], width) for d in docs]
    roots = groups_of(prints, distance)
    least = {}
    for d, r in zip(docs, roots):
        ids = [x for x in (least.get(r), d[0]) if x is not None]
        least[r] = min(ids, default=None)
    want = Counter((d[0], f"{p:016x}", least[r]) for d, p, r in zip(docs, prints, roots))
    assert Counter(map(tuple, rows)) == want


@here
def test_groups_of_documents(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").collect()]
    check_groups(registered.op9_simhash(spark, SF).collect(), docs, 3, 2)


def odd_docs():
    base = " ".join(f"word{i % 37}x{i}" for i in range(400))
    docs = [(i, base + f" end{i}", "en", "s", 1) for i in range(40)]
    docs += [(100 + i, base, "en", "s", 1) for i in range(30)]
    docs += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, " \n", "en", "s", 2), (203, "One", "en", "s", 3)]
    docs += [(204, "one", "en", "s", 3), (205, "a b", "en", "s", 3), (205, "a b", "en", "s", 3), (None, "null id", "en", "s", 1)]
    docs += [(None, "one", "en", "s", 1), (206, "İ é É", "en", "s", 1), (207, "very long " * 50_000, "en", "s", 1)]
    return docs


@pytest.mark.parametrize("width, distance", [(3, 2), (5, 2), (3, 1), (3, 0)])
def test_groups_of_odd_documents(spark, width, distance):
    docs = odd_docs()
    df = spark.createDataFrame(docs, DOCS).withColumn("_fp", F.lit("x")).withColumn("fingerprint", F.lit(1))
    check_groups(simhash.near_groups(df, width=width, distance=distance).collect(), docs, width, distance)


def test_chain_of_fingerprints(spark):
    """Each next differs in two bits: one component, however long the chain."""
    fps = [0]
    for i in range(60):
        fps.append(fps[-1] ^ (3 << i))
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)] + [(99, 0x5555_5555_5555_5555)]
    marked = spark.createDataFrame(rows, "_id bigint, _fp bigint")
    got = {r._node: r._component for r in simhash._groups(marked, 2).collect()}
    assert {got[f] for _, f in rows[:-1]} == {0} and got[0x5555_5555_5555_5555] == 99


def test_embedding(spark):
    values = [0, -1, 1, 1 << 62, -(1 << 63), 0x123456789ABCDEF0, -0x0FEDCBA987654321]
    df = spark.createDataFrame([(v,) for v in values], "_fp bigint")
    for r in df.select("_fp", simhash.segment_counts(F.col("_fp")).alias("c"), simhash._near_cells(simhash.segment_counts(F.col("_fp"))).alias("n"), simhash._near_points(F.col("_fp")).alias("p")).collect():
        raw = r._fp % (1 << 64)
        counts = [(raw >> 2 * i & 3).bit_count() for i in range(32)]
        assert [r.c >> 2 * i & 3 for i in range(32)] == counts
        near = [[x >> 2 * i & 3 for i in range(32)] for x in r.n]
        assert all(sum(abs(a - b) for a, b in zip(n, counts)) <= 1 and max(n) <= 2 for n in near)
        assert len(set(r.n)) == len(r.n) == 1 + sum(2 if c == 1 else 1 for c in counts)
        assert len(set(r.p)) == 65
        assert all((x % (1 << 64) ^ raw).bit_count() <= 1 for x in r.p)


def test_one_of_each(spark):
    docs = odd_docs()
    df = spark.createDataFrame(docs, DOCS).withColumn("_best", F.lit(0))
    kept = simhash.one_of_each(df, width=3)
    rows = kept.collect()
    assert kept.columns == df.columns
    roots = groups_of([print_of(d[1], 3) for d in docs], 2)
    least = defaultdict(list)
    for d, r in zip(docs, roots):
        least[r].append(d[0])
    want = [min((i for i in ids if i is not None), default=None) for ids in least.values()]
    assert Counter(r.doc_id for r in rows) == Counter(want)
    assert simhash.one_of_each(df.limit(0)).collect() == simhash.near_groups(df.limit(0)).collect() == []


# --- Lines ---------------------------------------------------------------------------


def cut_by_hand(lines):
    """The chunks of a document, each rolling hash from its window alone."""
    hashes = [xxhash.xxh64_intdigest(x.encode()) for x in lines]
    chunks, start = [], 0
    for i in range(len(lines)):
        seen = hashes[max(0, i + 1 - line_dedup.WINDOW) : i + 1]
        rolling = 0
        for h in seen:
            rolling = (rolling * line_dedup._FACTOR + h) % (1 << 64)
        if i + 1 - start >= 2 and len(seen) == line_dedup.WINDOW and (rolling >> 32) % line_dedup.CUT_EVERY == 0:
            chunks.append((start, i + 1))
            start = i + 1
    return chunks + ([(start, len(lines))] if start < len(lines) else [])


def deduped(docs):
    """{(id, text): (text without repeats, lines cut)}"""
    import hashlib

    def key(d):
        parts = [f"{len(str(v))}:{v}" if v is not None else "-" for v in d[:2]]
        return hashlib.md5("|".join(parts).encode()).hexdigest()

    seen, out = set(), {}
    for d in sorted(set(d[:2] for d in docs), key=lambda d: (d[0] is None, d[0] or 0, key(d))):
        lines = (d[1] or "").split("\n")
        left, gone = [], 0
        for a, b in cut_by_hand(lines):
            piece = "\n".join(lines[a:b])
            if b - a >= 2 and piece.encode().strip(b" \t\n\r\x0b\f") and piece in seen:
                gone += b - a
                continue
            if b - a >= 2:
                seen.add(piece)
            left += lines[a:b]
        out[d] = ("\n".join(left) if d[1] else d[1], gone)
    return out


def lines_docs():
    passage = "\n".join(f"a shared line number {i} of some words" for i in range(12))
    docs = [(i, f"own {i}\nmore {i}\n{passage}\ntail {i}", "en", "s", 1) for i in range(50)]
    docs += [(60, passage, "en", "s", 1), (60, passage, "en", "s", 1), (60, passage + "\nx", "en", "s", 1), (None, passage, None, None, None)]
    docs += [(61, None, "en", "s", 1), (62, "", "en", "s", 1), (63, "\n\n\n\n", "en", "s", 1), (64, "\n\n\n\n", "en", "s", 1), (65, "one line", "en", "s", 1)]
    docs += [(66, "one line", "en", "s", 1), (67, passage + "\n" + passage, "en", "s", 1), (68, "é\r\nü\r\n" * 9, "en", "s", 1), (69, "long\n" * 60_000, "en", "s", 1)]
    return docs


def check_lines(rows, docs):
    want = deduped(docs)
    assert Counter(map(tuple, rows)) == Counter((d[0], *want[d[:2]]) for d in docs)


def test_repeated_lines(spark):
    docs = lines_docs()
    df = spark.createDataFrame(docs, DOCS).withColumn("_key", F.lit(1)).withColumn("_start", F.lit("x"))
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "_gone"]
    check_lines(out.select("doc_id", "text", "_gone").collect(), docs)
    total = {r.doc_id: r._gone for r in out.collect()}
    assert total[1] >= 8 and total[0] == 0
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


@here
def test_lines_of_documents(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").collect()]
    check_lines(registered.op3_dedup_lines(spark, SF).collect(), docs)


def test_cuts_move_with_the_text():
    lines = [f"line {i * i}".encode() for i in range(200)]
    plain = {(a, b) for a, b in line_dedup.line_chunks(lines)}
    moved = {(a - 3, b - 3) for a, b in line_dedup.line_chunks([b"x", b"y", b"z", *lines])}
    assert len(plain & moved) >= 0.9 * len(plain)


def test_bytes_decide():
    text = "a\nb\nc"
    assert line_dedup.without(text, {0: b"a\nb"}) == ("c", 2)
    assert line_dedup.without(text, {0: b"a\nB"}) == (text, 0)


# --- Vectors -------------------------------------------------------------------------


def true_neighbours(ids, vectors, asked, k):
    out = {}
    for i in asked:
        scores = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, scores)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def by_query(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
@here
def test_recall(spark, sf):
    rows = table(spark, f"/root/testdata/{sf}", "embeddings").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows], dtype=np.float64)
    want = true_neighbours(ids, vectors, np.flatnonzero(ids % 100 == 0), 10)
    got = by_query(registered.op2_nearest_vectors(spark, f"/root/testdata/{sf}").collect())
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found, key=lambda x: (x[1], x[0]))
        for vec, score in found:
            assert math.isclose(score, np.sqrt(((vectors[ids == vec] - vectors[ids == q]) ** 2).sum()), rel_tol=1e-12)
        hits += len({v for v, _ in found} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 10 * len(want)


def test_recall_in_many_blocks(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 24)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = by_query(permutation_index.nearest(df, F.col("vec_id") % 100 == 0, block_rows=700, least=50).collect())
    want = true_neighbours(np.arange(3000), vectors, range(0, 3000, 100), 10)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 300


def test_pivots_beside_many_copies(spark):
    """A third of all rows are the vector of smallest hash."""
    vectors = np.random.default_rng(7).normal(size=(3000, 8)).round(3)
    df = spark.createDataFrame([(v.tolist(),) for v in vectors], "_v array<double>")
    hot = df.orderBy(F.xxhash64("_v")).limit(1)
    copies = hot.crossJoin(spark.range(1500)).select("_v")
    pivots = permutation_index.choose_pivots(df.union(copies), 256)
    assert len({tuple(p) for p in pivots}) == len(pivots) == 256
    assert pivots.tolist() == permutation_index.choose_pivots(df, 256).tolist()


def test_footrule():
    rng = np.random.default_rng(1)
    order = np.array([rng.permutation(20)[:6] for _ in range(50)], dtype=np.int16)
    files = permutation_index.inverted_files(order, 20)
    query = rng.permutation(20)[:6]

    def place(o):
        return [list(o).index(p) if p in o else 6 for p in range(20)]

    want = [sum(abs(a - b) for a, b in zip(place(query), place(o))) for o in order]
    assert permutation_index.footrules(query, files, 50).tolist() == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0])]
    rows += [(6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (200, [0.0, 2.0]), (200, [0.0, 2.0]), (300, [nan, 0.0]), (10, [-3.0, 1e300])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("_v", F.lit(1)).withColumn("_key", F.lit(2))
    got = permutation_index.nearest(df, F.col("vec_id") % 100 == 0, k=3).collect()
    of = lambda q: sorted((r.rank, r.vec_id, round(r.score, 6)) for r in got if r.query_id == q)
    assert of(100) == [(1, 1, 0.0), (2, 2, 0.0), (3, 2, 0.0)]
    two = [(1, 200, 0.0), (2, 1, 2.236068), (3, 2, 2.236068)]
    assert of(200) == sorted(two + two)
    assert len(got) == 9
    assert permutation_index.nearest(df.limit(0), F.lit(True)).collect() == []
    assert permutation_index.nearest(df.where("vec_id = 100"), F.lit(True)).collect() == []


def test_vectors_move_once_for_many_queries(spark, capsys):
    points = np.random.default_rng(5).normal(size=(1300, 8))
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], "vec_id long, embedding array<double>")
    got = permutation_index.nearest(df, F.lit(True), k=3, block_rows=400, rerank=1.0, least=1)
    far = ((points[:, None] - points[None]) ** 2).sum(-1)
    np.fill_diagonal(far, np.inf)
    want = {(i, n + 1, int(j)) for i, row in enumerate(far) for n, j in enumerate(np.argsort(row)[:3])}
    assert {(r.query_id, r.rank, r.vec_id) for r in got.collect()} == want
    got.explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "FlatMapGroups" not in plan  # no block is copied to parts of the queries



# --- The pipeline --------------------------------------------------------------------


@here
def test_pipeline(spark):
    """Each stage against brute force on what its predecessor kept."""
    from repoquarry.llm import mixing, quality_rules, sentencepiece_codec

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mix", "sentencepiece_encode"]
    docs = table(spark, SF, "documents")
    columns, rows, kept = docs.columns, [tuple(r) for r in docs.collect()], docs
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, kept, SF)
        kept, rows = rows, [tuple(r) for r in rows.collect()]
        kept = spark.createDataFrame(rows, kept.schema)
        if name == "quality_rules":
            bits = {d[0] for d in before if not failing(quality_rules.measure(d[1] or ""))}
            assert sorted(rows) == sorted(d for d in before if d[0] in bits) and rows
        elif name == "line_dedup":
            want = deduped(before)
            assert sorted(rows) == sorted((d[0], want[d[:2]][0], *d[2:]) for d in before)
        elif name == "simhash_near_dedup":
            roots = groups_of([print_of(d[1], 3) for d in before], 2)
            first = {}
            for d, r in sorted(zip(before, roots)):
                first.setdefault(r, d)
            assert sorted(rows) == sorted(first.values())
        elif name == "source_mix":
            taken = mixing.mixed_words(spark.createDataFrame(before, docs.schema)).collect()
            words = defaultdict(int)
            for d in rows:
                words[d[0]] += len(d[1].split())
            assert {r.doc_id: r.taken for r in taken if r.taken} == dict(words)
        if name != "sentencepiece_encode":
            assert kept.columns == columns
    texts = Counter((d[0], d[1]) for d in before)
    decoded = sentencepiece_codec.decode_ids(kept, registered.TOKENIZER).collect()
    assert Counter((r.doc_id, r.text) for r in decoded) == texts
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def failing(m):
    n, chars, symbols, again, repeated, lines, upper, digits = m
    return (
        n < 50 or 2 * repeated > n or 10 * symbols > n or 10 * again > 4 * lines
        or not 2 * n <= chars <= 12 * n or 2 * upper > chars or 2 * digits > chars
    )


def test_stages_on_odd_tables(spark):
    odd = spark.createDataFrame(odd_docs() + lines_docs(), DOCS).withColumn("_doc", F.lit("x")).withColumn("_key", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert len(stage(spark, odd, SF).collect()) > 0
        assert stage(spark, odd.limit(0), SF).collect() == []

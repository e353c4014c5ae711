"""Personal data, spelling variants and ranked search against brute force."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from repoquarry.llm import pii, registered
from repoquarry.llm.common import table

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    None, "", " ", "\n\n", "a", "é" * 60, "w " * 60, "a\x1cb \x85 c", "🙂 " * 70, "A" * 5000,
    "mail me at Jo.Doe@Example.com now", "ip 10.0.0.1 and 300.1.1.1 and 1.2.3.4.5",
    "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "call +1 (415) 555-2671 or +12 3",
    "long text " * 30_000 + " x@y.zz",
]


def odd_docs(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)] + [(3, ODD[3], "en", "s", 1), (None, "a@b.cc", None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("_id", F.lit("other")).withColumn("spans", F.lit("mine"))


# --- Personal data -------------------------------------------------------------------


def brute_base(text):
    """The contract's base spans, written out on its own."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(int(p) for p in m.group().split(".")) <= 255:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        s = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 12 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def brute_pii(rows):
    """(doc_id -> (counts, digest, spans)) with the statistics summed by hand."""
    kinds = ("email", "ip", "card", "phone", "quasi")
    seen = []
    for doc_id, text in rows:
        text = text or ""
        base = brute_base(text)
        words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{3,}", text)]
        words = [w for w in words if not any(a < w[1] and w[0] < b for a, _, b in base)]
        near = defaultdict(set)
        for a, k, b in base:
            value = text[a:b]
            value = value.lower() if k == 0 else "".join(c for c in value if c.isdigit()) if k in (2, 3) else value
            left = [w[2] for w in words if w[1] <= a][-pii.WINDOW :]
            right = [w[2] for w in words if w[0] >= b][: pii.WINDOW]
            near[(k, value)].update(left + right)
        seen.append((doc_id, text, base, words, near))
    df = Counter(t for *_, words, _ in seen for t in {w[2] for w in words})
    together = Counter((t, e) for *_, near in seen for e, ts in near.items() for t in ts)
    disclosing = {t for (t, e), c in together.items() if c >= pii.MIN_DOCS and c / df[t] >= pii.MIN_POSTERIOR}
    out = {}
    for doc_id, text, base, words, _ in seen:
        spans = sorted(base + [(a, 4, b) for a, b, t in words if t in disclosing])
        name = lambda s: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in s)
        counts = tuple(sum(k == i for _, k, _ in base) for i in range(4))
        out.setdefault(doc_id, []).append((counts, hashlib.sha256(name(base).encode()).hexdigest(), name(spans)))
    return out, disclosing


@pytest.mark.parametrize("text", ODD[1:])
def test_base_spans(text):
    assert pii.base_spans(text) == brute_base(text)


def test_checks_drop_without_retry():
    assert pii.base_spans("10.0.0.256") == []  # a part above 255: the whole match goes
    assert [k for _, k, _ in pii.base_spans("4111-1111-1111-1111")] == [2]
    assert pii.base_spans("+1 2 3") == []  # too few digits
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")


@here
def test_pii_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, disclosing = brute_pii(rows)
    got = registered.op11_find_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    for r in got:
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256, r.spans) in want[r.doc_id]
    found = pii.disclosing_terms(pii.statistics(docs.withColumn("_k", F.col("doc_id")), "_k", "text"))
    assert {r.term for r in found.collect()} == disclosing
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 0


def test_pii_odd_rows(spark):
    docs = odd_docs(spark)
    got = pii.find_pii(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, _ = brute_pii(rows)
    assert len(got) == len(rows)
    for r in got:
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256, r.spans) in want[r.doc_id]
    empty = [r for r in got if r.doc_id == 0][0]
    assert empty.spans == "" and empty.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.sanitised for r in got if r.doc_id == 10] == ["mail me at [EMAIL] now"]
    assert pii.find_pii(docs.limit(0)).collect() == []


def test_terms_that_disclose(spark):
    """A rare word seen next to one address in three documents gives it away; a word seen
    everywhere does not; an address alone in one document discloses nothing."""
    rows = [(i, f"the writer zyxquor said write to {'z.q@mail.org'} today") for i in range(3)]
    rows += [(10 + i, f"the weather today is fine number {i}") for i in range(20)]
    rows += [(40, "the lonely hermit wrote to solo@one.org once")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert "quasi" in got[0].spans and "[TERM]" in got[0].sanitised
    assert got[0].sanitised.count("[TERM]") >= 2 and "zyxquor" not in got[0].sanitised
    assert "today" in got[0].sanitised and "quasi" not in got[10].spans and "quasi" not in got[40].spans
    assert math.isclose(1.0, max(r.posterior for r in pii.disclosing_terms(
        pii.statistics(docs.withColumn("_k", F.col("doc_id")), "_k", "text")).collect()))


# --- Spelling variants ---------------------------------------------------------------


def brute_variants(rows):
    import zlib

    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def one_apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    words = sorted(vocab)
    near = {w: [o for o in words if one_apart(w, o)] for w in words}
    out = {}
    for w in words:
        best = min(near[w], key=lambda o: (-vocab[o], o), default=None)
        form = best if best is not None and vocab[best] >= 5 * vocab[w] else None
        out[w] = [form, None, vocab[w], len(near[w]), vocab[form] if form else None]
    for w in words:
        r = w
        while out[r][0]:
            r = out[r][0]
        out[w][1] = r
    return out


@here
def test_spelling_variants(spark):
    from repoquarry.llm import spelling

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in registered.op12_spelling_variants(spark, "/root/testdata/sf0.01").collect()}
    assert got == want
    assert any(v[0] for v in want.values())


def test_spelling_odd_rows(spark):
    from repoquarry.llm import spelling

    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "Wonderful " * 6), (None, None)]
    rows += [(50 + i, "wonderful " * 30 + "wonderfull wondreful ÀÀÀÀÀÀ " * 6 + "wnderful " * 5) for i in range(3)]
    rows += [(60, "aaaaaa aaaaab aaaaba " * 6), (60, "aaaaaa aaaaab aaaaba " * 6)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumn("word", F.lit("x")).withColumn("_w", F.lit(1))
    want = brute_variants(rows)
    got = {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in spelling.variants(docs).collect()}
    assert got == want and got["wonderfull"][0] == "wonderful"
    assert spelling.variants(docs.limit(0)).collect() == []


def test_hot_signatures_are_refined(spark, monkeypatch):
    """With every key hot, the refined level finds the same pairs."""
    from repoquarry.llm import spelling

    rows = [(i, "abcdef abcdeg abcdfg bcdefg abcdefg abdcef " * 5) for i in range(2)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    plain = sorted(tuple(r) for r in spelling.variants(docs).collect())
    monkeypatch.setattr(spelling, "HOT", 1)
    assert sorted(tuple(r) for r in spelling.variants(docs).collect()) == plain
    assert plain == sorted((w, *v) for w, v in brute_variants(rows).items()) and len(plain) == 6


# --- Ranked lexical search -----------------------------------------------------------


def brute_rank(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [(d, Counter(term.findall((t or "").translate(low)))) for d, t in docs]
    big_n = sum(1 for _, c in split if c)
    big_l = sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        asked = Counter(term.findall((text or "").translate(low)))
        scored = []
        for d, c in split:
            m = 25 + (75 * sum(c.values()) * big_n) // big_l if big_l else 0
            s = sum(n * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, n in asked.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, d, -s))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@here
def test_ranked_search_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    want = brute_rank(docs, items)
    got = sorted(tuple(r) for r in registered.op13_ranked_search(spark, sf).collect())
    assert got == want and len(got) > 100


def test_ranked_search_odd_rows(spark):
    from repoquarry.llm import lexical_search

    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "Zebra zebra QUAGGA"), (90, "zebra zebra quagga")]
    rows += [(91, "Zebra"), (92, "quagga ü"), (93, "zebra, zebra; quagga"), (94, "zebra")]
    asks = [(1, "zebra quagga quagga"), (2, None), (3, "nothing matches"), (4, "Ü ü 🙂"), (None, "zebra")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumn("score", F.lit("x"))
    items = spark.createDataFrame(asks, "item_id bigint, text string").withColumn("rank", F.lit(1))
    got = sorted((tuple(r) for r in lexical_search.rank(docs, items).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == brute_rank(rows, asks)
    assert [r[2] for r in got if r[0] == 1][:2] == [90, 93]  # equal scores: the smaller id first
    assert lexical_search.rank(docs.limit(0), items).collect() == []
    assert lexical_search.rank(docs, items.limit(0)).collect() == []


def test_tree_prunes_and_stays_exact():
    from repoquarry.llm.lexical_search import Tree, gain

    import random

    rnd = random.Random(7)
    tree, vectors = Tree(), {}
    for d in range(3000):
        ranks = sorted(rnd.sample(range(40), rnd.randint(1, 8)))
        tfs = [rnd.randint(1, 5) for _ in ranks]
        m = rnd.randint(30, 200)
        tree.insert(d, m, ranks, tfs)
        vectors[d] = (m, dict(zip(ranks, tfs)))
    for _ in range(20):
        weights = {r: rnd.randint(1, 3000) for r in rnd.sample(range(40), 3)}
        exact = sorted((-sum(w * gain(v.get(r, 0), m) for r, w in weights.items()), d) for d, (m, v) in vectors.items())
        want = [(-s, d) for s, d in exact if s < 0][:10]
        assert tree.search(weights) == want


def test_long_queries_over_shards_in_bounded_work():
    """Verbose queries over documents that hold most of their terms: one shard after another, as
    a task meets them, exact and within seconds (a search per query and node took minutes)."""
    import time

    import numpy as np
    import pyarrow as pa

    from repoquarry.llm import lexical_search as ls

    rng = np.random.default_rng(11)
    docs = []
    for d in range(3000):
        ranks = np.unique((rng.random(80) ** 3 * 400).astype(int)).tolist()
        docs.append((None if d % 500 == 7 else d // 2, int(rng.integers(30, 200)), [{"rank": r, "tf": int(rng.integers(1, 6))} for r in ranks]))
    docs += [(9000, 50, []), (9001, 50, None)] + [(9100 + i, 50, [{"rank": 3, "tf": 2}]) for i in range(600)]
    asks = [(i, {int(r): int(rng.integers(1, 3000)) for r in rng.choice(400, 40, replace=False)}) for i in range(60)]
    asks += [(None, {3: 7}), (99, {10**12: 5})]
    kind = pa.schema([("doc_id", pa.int64()), ("m", pa.int64()), ("_v", pa.list_(pa.struct([("rank", pa.int64()), ("tf", pa.int64())])))])
    batches = [
        pa.RecordBatch.from_pydict(dict(zip(kind.names, map(list, zip(*docs[s : s + 900])))), schema=kind)
        for s in range(0, len(docs), 900)
    ]
    before = time.process_time()
    out = list(ls._searched(asks)(iter(batches)))
    assert time.process_time() - before < 20
    got = [r for b in out for r in zip(*(c.to_pylist() for c in b.columns))]
    want = []
    for item, weights in asks:
        scored = ((sum(weights.get(x["rank"], 0) * ls.gain(x["tf"], m) for x in v or ()), d) for d, m, v in docs)
        best = sorted((-s, d is None, d or 0) for s, d in scored if s > 0)[:10]
        want += [(item, None if null else d, -s) for s, null, d in best]
    assert got == want and len(got) > 600

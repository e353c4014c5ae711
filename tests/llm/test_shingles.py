"""The pipeline's near copies against all pairs by exact Jaccard similarity."""

import random
import re

import corpus_pipeline

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def set_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(docs):
    sets, parent = [set_of(d[1]) for d in docs], list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(docs))]


def test_near_copies_at_four_fifths(spark):
    rng, docs = random.Random(3), []
    for base in range(12):
        words = [f"b{base}w{i}" for i in range(120)]
        docs.append((10 * base, " ".join(words)))
        for copy in range(1, 6):
            near = list(words)
            for at in rng.sample(range(0, 120, 6), copy):
                near[at] = f"new{copy}x{at}"
            docs.append((10 * base + copy, " ".join(near)))
    base = " ".join(f"word{i}" for i in range(60))
    docs += [(500 + i, f"{base} end{i}") for i in range(300)]  # one large group
    docs += [(900, None), (901, ""), (902, "One"), (903, "one"), (None, "one"), (904, "a b"), (905, "a b c")]
    rows = [(*d, "en", "s", 1) for d in docs]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, DOCS), "").collect()
    first = {}
    for d, r in zip(docs, groups(docs)):
        first[r] = min(first.get(r, d), d, key=lambda d: (d[0] is None, d[0] or 0))
    assert sorted(r.doc_id for r in kept) == sorted(d[0] for d in first.values())
    assert sum(d[0] < 500 for d in first.values() if d[0] is not None) < 72

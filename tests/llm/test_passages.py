"""Passages that repeat in different surroundings, against brute force."""

from collections import Counter

import pytest

from repoquarry.llm import line_dedup

DOCS = "doc_id bigint, text string"


def passage(n):
    words = -(-56 // n)
    return [" ".join(f"p{n}l{i}w{j}" for j in range(words)) for i in range(n)]


def deduped(docs):
    """[(id, text, lines cut)]: pairs of lines and long lines that occurred before go."""
    seen, out = {}, []
    for place, (doc, text) in enumerate(docs):
        lines = (text or "").split("\n")
        solid = [i for i, line in enumerate(lines) if line.strip()]
        gone = set()
        for n, i in enumerate(solid):
            spans = [range(i, solid[n + 1] + 1)] if n + 1 < len(solid) else []
            spans += [range(i, i + 1)] if len(lines[i].split()) > 50 else []
            for span in spans:
                first = seen.setdefault(tuple(lines[j] for j in span), (place, n))
                if first[0] != place or n - first[1] >= len([j for j in span if j in solid]):
                    gone |= set(span)
        left = "\n".join(line for i, line in enumerate(lines) if i not in gone)
        out.append((doc, left if text else text, len(gone)))
    return out


@pytest.mark.parametrize("n", range(1, 7))
def test_passages_go_whole(spark, n):
    lines = passage(n)
    docs = [(d, "\n".join([f"top {d}"] * (d % 4) + [f"own {d} {d}", *lines, f"tail {d}"])) for d in range(12)]
    rows = line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()
    assert Counter(map(tuple, rows)) == Counter(deduped(docs))
    assert all((lines[0] in r.text, lines[-1] in r.text) == (r.doc_id == 0,) * 2 for r in rows)


def test_odd_passages(spark):
    a, b = passage(3), passage(2)
    texts = [
        "\n".join(a), "\n\n".join(b), "\n".join(["x", *a[1:], "", *b, "y"]), "\n\n".join(["q", *b, "", "z"]), "\n".join(a + a),
        "long\n" * 9, "one\ntwo", "one\n\ntwo", "two\none\ntwo", "one", "one", None, "", "\n\n", "\n\n", "é\r\nü\r\n" * 4, passage(1)[0] + "\n" + passage(1)[0],
    ]
    docs = list(enumerate(texts))
    rows = line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()
    assert Counter(map(tuple, rows)) == Counter(deduped(docs))

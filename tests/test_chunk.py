import random
import re

import pytest
from pyspark.sql import functions as F

from repoquarry.operators import chunk
from repoquarry.params import IndexParams


def chunks_of(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.c for r in rows.select("i", make(F.col("t")).alias("c")).orderBy("i").collect()]


def some_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "bb", "c_d", "été", "don't", "x.y", "--", "漢字", "loooooooooong" * 5, "(", "12"]
    seps = [" ", " ", "\n", "\n\n", "\t", "  ", "\n    ", ""]
    out = ["", "\n", " \n ", "x", "one two", "\n\na\n"]
    for _ in range(n):
        size = rng.choice([3, 30, 300])
        out.append("".join(rng.choice(words) + rng.choice(seps) for _ in range(size)))
    return out


@pytest.mark.parametrize(
    ("lines", "want"), [(1, 1), (39, 1), (40, 1), (41, 2), (65, 2), (66, 3), (91, 4)]
)
def test_number_of_line_windows(spark, lines, want):
    [got] = chunks_of(
        spark, ["\n".join(map(str, range(lines)))], lambda t: chunk.line_windows(t, 40, 15, None)
    )
    assert len(got) == want


@pytest.mark.parametrize(("lines", "overlap"), [(40, 15), (7, 3), (5, 0), (2, 1)])
def test_line_windows_are_a_sliding_window(spark, lines, overlap):
    texts = some_texts(1)
    for text, got in zip(
        texts, chunks_of(spark, texts, lambda t: chunk.line_windows(t, lines, overlap, None))
    ):
        own = text.split("\n")
        want = []
        start = 0
        while True:
            want.append("\n".join(own[start : start + lines]))
            if start + lines >= len(own):
                break
            start += lines - overlap
        assert got == want


def test_large_windows_are_cut_by_characters(spark):
    texts = some_texts(2)
    whole = chunks_of(spark, texts, lambda t: chunk.line_windows(t, 7, 3, None))
    cut = chunks_of(spark, texts, lambda t: chunk.line_windows(t, 7, 3, 50))
    for a, b in zip(whole, cut):
        assert "".join(b) == "".join(a)
        assert all(len(c) <= 50 for c in b)
        assert all(c in b for c in a if len(c) <= 50)


TOKEN = re.compile(r"\w+|[^\w\s]")


def python_pieces(text, limit):
    spans = [m.span() for m in re.finditer(r"(?:\w+|[^\w\s])\s*", text)]
    if not spans:
        return [text] if text else []
    out, i, start = [], 0, 0
    while i < len(spans):
        last = min(i + limit, len(spans))
        ends = range(last, i, -1)
        j = next(
            (e for e in ends if e == len(spans) or text[spans[e - 1][1] - 1] == "\n"),
            next((e for e in ends if text[spans[e - 1][1] - 1].isspace()), last),
        )
        out.append(text[start : spans[j - 1][1]])
        i, start = j, spans[j - 1][1]
    return out


@pytest.mark.parametrize("limit", [1, 3, 8, 64])
def test_token_pieces(spark, limit):
    texts = some_texts(3)
    for text, got in zip(texts, chunks_of(spark, texts, lambda t: chunk.token_pieces(t, limit))):
        assert got == python_pieces(text, limit)
        assert "".join(got) == text
        assert all(len(TOKEN.findall(p)) <= limit for p in got)


@pytest.mark.parametrize(("size", "overlap"), [(1024, 64), (30, 5), (20, 0), (10, 8)])
def test_token_windows_keep_their_budget(spark, size, overlap):
    texts = [t for t in some_texts(4) if t.strip()]
    for text, got in zip(
        texts, chunks_of(spark, texts, lambda t: chunk.token_windows(t, size, overlap))
    ):
        assert all(len(TOKEN.findall(c)) <= size for c in got)
        rebuilt = got[0]
        for c in got[1:]:
            shared = max(
                n for n in range(min(len(c), len(rebuilt)) + 1) if rebuilt.endswith(c[:n])
            )
            rebuilt += c[shared:]
        if overlap == 0:
            assert "".join(got) == text


@pytest.mark.parametrize(("size", "overlap"), [(1024, 64), (64, 0), (100, 30), (200, 100)])
def test_token_windows_are_filled(spark, size, overlap):
    """No chunk could have taken the next piece, and none shares more than the overlap."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "bc, d", "e\n", "f.g"]) for _ in range(rng.choice([3, 80, 2500]))) for _ in range(12)]
    piece = min(64, overlap or 64, size - overlap)
    for text, got in zip(texts, chunks_of(spark, texts, lambda t: chunk.token_windows(t, size, overlap))):
        pieces, n = python_pieces(text, piece), lambda p: len(TOKEN.findall(p))
        want, start = [], 0
        while True:
            end = start + 1
            while end < len(pieces) and n("".join(pieces[start : end + 1])) <= size:
                end += 1
            want.append("".join(pieces[start:end]))
            if end == len(pieces):
                break
            start = next(j for j in range(start + 1, end + 1) if n("".join(pieces[j:end])) <= overlap)
        assert got == want


def test_unbroken_runs_are_cut(spark):
    [got] = chunks_of(spark, ["x" * 50_000], lambda t: chunk.token_windows(t, 100, 10))
    assert "".join(got) == "x" * 50_000 and max(map(len, got)) == 1600


def some_code(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        lines = []
        for _ in range(rng.choice([1, 5, 40])):
            lines.append(
                rng.choice(
                    [
                        "import os",
                        "",
                        "@deco",
                        "# note",
                        "def f(x):",
                        "class A:",
                        "    def m(self):",
                        "    @property",
                        "    x = 1 + 2",
                        "        return 'some longer line of text'",
                        "async def g():",
                        "y" * rng.choice([3, 70]),
                    ]
                )
            )
        out.append("\n".join(lines))
    return out


def python_declarations(text, budget):
    """The definition, written for one file at a time."""
    opens = re.compile(r"^\s*(?:async\s+def|def|class)\s")
    leads = re.compile(r"^\s*[@#]")
    lines = text.split("\n")
    size = [len(re.sub(r"\s", "", x)) for x in lines]

    def begins(i):
        here = opens.search(lines[i]) or leads.search(lines[i])
        return bool(here) and not (i > 0 and leads.search(lines[i - 1]))

    def cut(s, e, test):
        marks = [s, *[i for i in range(s + 1, e) if test(i)], e]
        return list(zip(marks, marks[1:]))

    units = []
    for s, e in cut(0, len(lines), lambda i: re.match(r"\S", lines[i]) and begins(i)):
        if sum(size[s:e]) <= budget:
            units.append((s, e))
            continue
        for a, b in cut(s, e, begins):
            units += [(a, b)] if sum(size[a:b]) <= budget else [(i, i + 1) for i in range(a, b)]
    packed = []
    for s, e in units:
        if packed and sum(size[packed[-1][0] : e]) <= budget:
            packed[-1] = (packed[-1][0], e)
        else:
            packed.append((s, e))
    return lines, size, packed


@pytest.mark.parametrize("budget", [30, 120, 1024])
@pytest.mark.parametrize("overlap", [0, 3])
def test_declaration_chunks(spark, budget, overlap):
    texts = some_code(5)
    got = chunks_of(
        spark, texts, lambda t: chunk.declaration_chunks(t, "python", budget, overlap)
    )
    for text, chunks in zip(texts, got):
        lines, size, packed = python_declarations(text, budget)
        want = []
        for k, (s, e) in enumerate(packed):
            if sum(size[s:e]) > budget:
                line = lines[s]
                want += [line[i : i + budget] for i in range(0, len(line), budget)]
                continue
            start = max(s - overlap, packed[k - 1][0]) if k else s
            want.append("\n".join(lines[start:e]))
        assert chunks == want


def test_declarations_stay_whole(spark):
    code = "import a\n\n@d\ndef f():\n    return 1\n\n\nclass B:\n    def c(self):\n        return 2\n"
    [got] = chunks_of(spark, [code], lambda t: chunk.declaration_chunks(t, "python", 32, 0))
    assert got == [
        "import a\n\n@d\ndef f():\n    return 1\n\n",
        "class B:\n    def c(self):\n        return 2\n",
    ]


def test_expansion_names_the_enclosing_declaration(spark):
    code = "class B:\n    def c(self):\n        return 2\n    def d(self):\n        return 3"
    [got] = chunks_of(
        spark, [code], lambda t: chunk.declaration_chunks(t, "python", 30, 0, expand=True)
    )
    assert got[1] == "class B:\n    def d(self):\n        return 3"


@pytest.mark.parametrize(
    ("language", "code", "want"),
    [
        ("java", "package a;\npublic class A {\n  int x;\n}\n@Tag\ninterface B {\n}", 2),
        ("typescript", "import x;\nexport function f() {\n}\nexport const g = (a) => {\n}", 2),
        ("csharp", "using X;\nnamespace N {\n}\n[Attr]\npublic record R(int A);\n", 2),
    ],
)
def test_openers_of_other_languages(spark, language, code, want):
    [got] = chunks_of(spark, [code], lambda t: chunk.declaration_chunks(t, language, 30, 0))
    assert len(got) == want and "\n".join(got) == code


def test_routing(spark):
    rows = spark.createDataFrame(
        [("python", "def f():\n  pass"), ("go", "a\nb"), (None, "plain text")], "l string, t string"
    )
    params = IndexParams()
    got = {
        r.l: r.c for r in rows.select("l", chunk.route(F.col("t"), F.col("l"), params).alias("c")).collect()
    }
    assert got == {"python": ["def f():\n  pass"], "go": ["a\nb"], None: ["plain text"]}


def test_one_long_line_and_many_short_lines(spark):
    """Sizes at the file limit stay linear."""
    texts = ["x" * 51_200, "\n" * 51_199, "a b " * 12_800, "." * 51_200]
    params = IndexParams()
    for language in ("python", "go", None):
        kind = F.lit(language).cast("string")
        got = chunks_of(spark, texts, lambda t: chunk.route(t, kind, params))
        assert all(got)

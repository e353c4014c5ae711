import json
import math
import unicodedata
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from repoquarry.functions import paths, text, tokens, vector
from repoquarry.operators.select import decide, file_state, listed, split_repo_urls, with_texts


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_suffix_is_that_of_pathlib(spark):
    names = ["a.py", "a/b.TAR.gz", ".gitignore", "a/.env", "Makefile", "a.", "a.b/c", "..a", "x.y.Z"]
    assert column(spark, names, paths.suffix) == [PurePosixPath(n).suffix.lower() for n in names]


def test_language(spark):
    names = ["a.py", "h.h", "n.IPYNB", "Makefile", ".gitignore", "a.tsx", "a.rs", "a.md"]
    want = ["python", "cpp", "python", None, None, "typescript", "rust", None]
    assert column(spark, names, paths.language) == want


def test_ignored_paths(spark):
    cases = {
        ".git/config": True,
        "a/node_modules/b.js": True,
        ".env": True,
        "build": True,
        "a/build": True,
        "foo.egg-info/x.txt": False,
        "Build/x.txt": False,
        ".github/w.yml": False,
        "pkg/__init__.py": False,
        "my.git/x": False,
        "builds/x": False,
        None: True,
    }
    assert column(spark, list(cases), paths.is_ignored) == list(cases.values())


def test_relative_to(spark):
    root = F.lit("/r/a/")
    got = column(spark, ["/r/a/x/y", "/r/ab/x", "/r/a"], lambda c: paths.relative_to(c, root))
    assert got == ["x/y", None, None]


def test_repo_urls(spark):
    urls = ["https://github.com/a/b", "git@github.com:a/b", "http://github.com/a", None, ""]
    rows = spark.createDataFrame([(u,) for u in urls], "repo_url string")
    good, bad = split_repo_urls(rows)
    assert good.count() == 2 and bad.count() == 3


def test_decisions(spark):
    files = [
        ("logo.PNG", 90_000),
        ("x.tar.gz", 5),
        ("big.txt", 51_201),
        ("edge.txt", 51_200),
        ("gone.txt", None),
        (".git/config", 5),
    ]
    rows = spark.createDataFrame(files, "rel string, size bigint")
    got = {r.rel: (r.decision.include, r.decision.reason) for r in decide(listed(rows), 51_200).collect()}
    assert got == {
        "logo.PNG": (False, "binary"),
        "x.tar.gz": (False, "binary"),
        "big.txt": (False, "too_large"),
        "edge.txt": (True, "ok"),
        "gone.txt": (False, "ignored"),
    }


def test_strip_and_blank_agree_with_python(spark):
    spaces = [chr(c) for c in range(1, 0x3002) if chr(c).isspace()]
    odd = ["\u200b", "\ufeff", "\u180e"]
    values = [s + "a b" + s for s in spaces + odd] + ["", " \t", "".join(spaces), "x", "a\x1c"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.is_blank) == [not v.strip() for v in values]


def test_nul_removal(spark):
    assert column(spark, ["a\x00b\x00", None, ""], text.remove_nul) == ["ab", None, ""]


def test_decode(spark):
    raw = [
        b"a\r\nb\rc\n\r\n",
        b"a\xffb\xe2\x82c\xf0\x9f\x98",
        b"\xef\xbb\xbfx",
        "é€😀".encode(),
        b"\xed\xa0\x80",
        b"",
    ]
    want = [
        b.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for b in raw
    ]
    assert column(spark, [bytearray(b) for b in raw], text.decode_text, "binary") == want


def test_human_bytes(spark):
    def python(n):
        for unit in ("B", "KB", "MB", "GB"):
            if n < 1024:
                return f"{n:.1f} {unit}"
            n /= 1024
        return f"{n:.1f} TB"

    sizes = [0, 1, 1023, 1024, 1280, 1331, 1536, 51_200, 10**6, 2**20 - 1, 2**30, 5 * 2**40 + 7]
    sizes += [1024 + 64 * i for i in range(300)]
    assert column(spark, sizes, text.human_bytes, "bigint") == [python(n) for n in sizes]


def test_defaults_and_short_commit(spark):
    assert column(spark, [None, "", "x"], lambda c: text.or_default(c, "Unknown")) == [
        "Unknown",
        "Unknown",
        "x",
    ]
    assert column(spark, ["0123456789"], text.short_commit) == ["01234567"]


def test_token_classes_of_python_and_spark(spark):
    from repoquarry.operators.embed import _TOKEN

    values = ["été x_1, don't!", "a\u00a0b", "漢字かな", "x²½Ⅷ", "  ", "a--b\n\tc", "naïve"]
    assert column(spark, values, tokens.tokens) == [_TOKEN.findall(v) for v in values]
    assert all(unicodedata.normalize("NFC", v) == v for v in values)


NOTEBOOK = {
    "cells": [
        {"cell_type": "code", "source": ["a = 1\n", "b = 2"]},
        {"cell_type": "code", "source": " \n"},
        {"cell_type": "markdown", "source": "# T"},
        {"cell_type": "raw", "source": "[1]"},
        {"cell_type": "code"},
    ],
    "nbformat": 4,
}


def test_notebook(spark):
    good = json.dumps(NOTEBOOK)
    untyped = json.dumps({"cells": [{"source": "x"}], "nbformat": 4})
    contents = [
        good.encode(),
        good.encode() + b"  \n",
        good.encode() + b"}",
        good.encode() + b"]",
        good.encode() + b"," + good.encode(),
        b"{bad",
        untyped.encode(),
        json.dumps({"cells": [], "nbformat": 4}).encode(),
        json.dumps({"worksheets": [], "nbformat": 3}).encode(),
        b"[1]",
        good.replace("# T", "\u00e9").encode("latin-1", "ignore") + b"\xff",
        b"",
    ]
    want = (
        "\n## Code Cell 1\n```python\na = 1\nb = 2\n```\n"
        "\n## Markdown Cell 3\n# T\n"
        "\n## Raw Cell 4\n[1]"
    )
    got = column(spark, [bytearray(c) for c in contents], text.notebook_text, "binary")
    assert got == [want, want, None, None, None, None, None, "", None, None, None, None]


def test_failures_do_not_stop_others(spark):
    rows = [
        ("a.ipynb", bytearray(b"{"), None),
        ("b.txt", bytearray(b"hello"), None),
        ("c.txt", None, "OSError: gone"),
        ("blank.md", bytearray("\u00a0\x1c\n".encode()), None),
    ]
    files = spark.createDataFrame(rows, "rel string, content binary, error string")
    read = with_texts(files).withColumn(
        "state", file_state(F.lit("ok"), F.col("error"), F.col("text"))
    )
    assert {r.rel: r.state for r in read.collect()} == {
        "a.ipynb": "failed",
        "b.txt": "kept",
        "c.txt": "failed",
        "blank.md": "blank",
    }


def test_cosine_distance(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r.d for r in df.select(vector.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got[0] == pytest.approx(0) and got[1] == pytest.approx(0.2)
    assert math.isnan(got[2]) and got[3] is None

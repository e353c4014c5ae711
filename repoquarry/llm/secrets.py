"""Secrets in texts: known formats, and strings of high entropy.

Known formats are found by expressions. Beyond them, every run of characters that keys are
made of is a candidate. A window slides over the stretches of one character class; counts
of its characters change by one in and one out, and with them the Shannon entropy. Windows
at or above the threshold of their class are joined and reported as `entropy`, unless an
allow-list names the string or the span meets one already found.

Defined cases: a null text is an empty text, without spans. Spans are in code points, end
exclusive, and lie in one text. Very long texts and runs cost time linear in their length.
Repeated rows get equal answers, an empty table an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import slices

KINDS = ("assign", "access", "hex", "entropy")
_WORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

# Class: its characters, the window, and the least entropy in bits a character.
CLASSES = (
    ("upper_hex", re.compile(r"[0-9A-F]{20,}"), 20, 3.0),
    ("alnum", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 3.9),
)
ALLOWED = (
    re.compile(r"[A-Za-z]+"),  # letters only: words and names
    re.compile(r"[0-9]+"),  # numbers
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"[A-Za-z]*([-_/=+][A-Za-z]*)+"),  # words with separators
    re.compile(r"(.)\1*"),
    re.compile(r"sha(1|256|512)-[A-Za-z0-9+/=]+"),  # integrity digests
)


def window_entropies(string: str, width: int) -> Iterator[tuple[int, float]]:
    """(start, bits a character) of every window, by counts that change by one."""
    counts: dict[str, int] = {}
    cost = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    total = 0.0  # the sum of c * log2(c)
    for i, char in enumerate(string):
        c = counts.get(char, 0)
        total += cost[c + 1] - cost[c]
        counts[char] = c + 1
        if i >= width:
            old = string[i - width]
            c = counts[old]
            total += cost[c - 1] - cost[c]
            counts[old] = c - 1
        if i >= width - 1:
            yield i - width + 1, math.log2(width) - total / width


def _mixed(string: str) -> bool:
    """A digit and a letter: words alone are never keys."""
    return any(c.isdigit() for c in string) and any(c.isalpha() for c in string)


def entropy_spans(text: str, allowed=ALLOWED) -> list[tuple[int, int]]:
    """Joined windows of high entropy in the candidate strings of a text."""
    spans: list[tuple[int, int]] = []
    for candidate in _CANDIDATE.finditer(text):
        string = candidate.group()
        if not _mixed(string) or any(a.fullmatch(string) for a in allowed):
            continue
        for _, characters, width, least in CLASSES:
            for stretch in characters.finditer(text, candidate.start(), candidate.end()):
                if not _mixed(stretch.group()):
                    continue
                for start, bits in window_entropies(stretch.group(), width):
                    if bits >= least:
                        spans.append((stretch.start() + start, stretch.start() + start + width))
    joined: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(stop, joined[-1][1]))
        else:
            joined.append((start, stop))
    return joined


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known formats, in order."""
    found = []
    low = text.lower()
    if any(word in low for word in _WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 12:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    more = [
        (a, 3, b)
        for a, b in entropy_spans(text)
        if not any(x < b and a < y for x, _, y in base)
    ]
    numbers = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    digest = hashlib.sha256(_named(base).encode()).hexdigest()
    return (*numbers, digest, _named(sorted(base + more)))


_FIELDS = (
    ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()),
)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [scan(t.as_py() or "") for t in batch.column(1)]
        columns = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
        arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *arrays], ["_id", *[name for name, _ in _FIELDS]]
        )


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    slim = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = slim.schema[0].dataType.simpleString()
    schema = f"_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return slim.mapInArrow(_scanned, schema).withColumnRenamed("_id", id)

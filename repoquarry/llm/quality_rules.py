"""Quality rules as a ledger of failure bits and measurements.

`ledger` evaluates every rule once for each document and stores a bit for each that fails,
next to what was measured. A policy is a named, versioned mask of rules; applying one, or
comparing many, reads only the bits. `ablation` counts, for each rule of a policy, the
documents that it alone rejects, from one small table of distinct bit patterns.

Defined cases: a null text is an empty text; it fails the rule on length. A document without
words passes the rules on ratios. Repeated rows get equal answers, an empty table an empty
result. `ledger` returns the key and its own columns, `filter_documents` the columns of its
input, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import slices

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits",
)
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
_UPPER = re.compile("[A-Z]+")
_DIGITS = re.compile("[0-9]+")


# Name and failure condition of each rule; the position is its bit, so rules are only ever
# added at the end.
_CONDITIONS = {
    "too_short": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 4 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    "upper_case": "10 * n_upper > 5 * word_chars",
    "digits": "10 * n_digits > 5 * word_chars",
}
RULES = tuple(_CONDITIONS)
BASE = ("too_short", "repeated_words")
POLICIES = {
    "base-1": BASE,
    "prose-1": (*BASE, "symbols", "repeated_lines"),
    "prose-2": RULES,
}


def mask(*names: str) -> int:
    return sum(1 << RULES.index(name) for name in set(names))


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    raw = text.encode()
    words = raw.split()  # bytes split at just the six ASCII spaces
    n = len(words)
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        often = {k for k, v in Counter(triples).items() if v > 1}
        upto = 0
        for i, triple in enumerate(triples):
            if triple in often:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return (
        n,
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(map(len, _UPPER.findall(text))),
        sum(map(len, _DIGITS.findall(text))),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [measure(t.as_py() or "") for t in batch.column(1)]
        columns = zip(*rows) if rows else [[] for _ in MEASURES]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["_id", *MEASURES])


def ledger(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, measurements, `fail_bits`) for every row; each text is read once."""
    slim = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    types = ", ".join(f"{m} bigint" for m in MEASURES)
    measured = slim.mapInArrow(_measured, f"_id {slim.schema[0].dataType.simpleString()}, {types}")
    return with_bits(measured).withColumnRenamed("_id", id)


def with_bits(measured: DataFrame) -> DataFrame:
    """Add `fail_bits`: bit i is set if rule i fails."""
    bits = F.lit(0).cast("bigint")
    for i, condition in enumerate(_CONDITIONS.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn("fail_bits", bits)


def failed(policy: str) -> Column:
    """Whether a document of the ledger fails any rule of a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(*POLICIES[policy]))) != 0


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_alone) of a policy: documents that fail the rule, and those that
    would be kept without it. Bit patterns are counted first, in the tasks."""
    names = POLICIES[policy]
    patterns = entries.groupBy(
        F.col("fail_bits").bitwiseAND(F.lit(mask(*names))).alias("bits")
    ).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask(r)).cast("bigint").alias("bit")) for r in names])
    each = patterns.select("bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_alone"),
    )


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [measure(t.as_py() or "") for t in batch.column(0)]
        arrays = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column(1), *arrays], ["_doc", *MEASURES])


def filter_documents(docs: DataFrame, text: str = "text", policy: str = "prose-2") -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    pair = docs.select(F.col(text).cast("string").alias("_text"), F.struct("*").alias("_doc"))
    types = ", ".join(f"{m} bigint" for m in MEASURES)
    schema = f"_doc {pair.schema['_doc'].dataType.simpleString()}, {types}"
    marked = with_bits(pair.mapInArrow(_keep, schema))
    return marked.where(~failed(policy)).select(*[F.col("_doc")[c].alias(c) for c in docs.columns])

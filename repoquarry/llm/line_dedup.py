"""Removal of passages of several lines that repeat anywhere in the corpus.

Each two lines that follow one another (blank lines between them aside) are looked up at
every offset, and each line of over `LONG_LINE` words by itself. What occurred before goes,
if its bytes equal those of its first occurrence; so a passage goes from its first line to
its last, whatever stands around it. Of all copies of a line the first always stays.

First means the smallest id (null last), then the text's digest, then the place. Rows with
equal id and text are one document, in which nothing is a repeat of the other row.

Defined cases: null and empty texts stay as they are. Blank lines go only inside a passage,
and a single line only if it is long. Two lines that share one with their first occurrence
stay. A text that is wholly removed becomes empty; its row stays. Lines are what stands
between \\n. An empty table gives an empty result. Other columns pass through, whatever their
names.

Digests are counted before texts move: occurrences are summed in the tasks, so a passage
in a third of all documents is one row a task. Neighbouring repeats with neighbouring first
occurrences are one passage, of which one copy is brought for comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import content_key, slices
from repoquarry.session import materialise

WINDOW = 2  # lines
CUT_EVERY = 2  # lines, on average, beyond the first two of a chunk
_FACTOR = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1
MIN_LINES = 2
LONG_LINE = 50  # words; a line of more is a passage of its own


def line_chunks(lines: list[bytes], window: int = WINDOW, every: int = CUT_EVERY):
    """(start, stop) of each chunk, in lines."""
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    last = pow(_FACTOR, window, 1 << 64)
    rolling, start = 0, 0
    for i, value in enumerate(hashes):
        rolling = (rolling * _FACTOR + value) & _WRAP
        if i >= window:
            rolling = (rolling - hashes[i - window] * last) & _WRAP
        if i + 1 - start >= MIN_LINES and i + 1 >= window and (rolling >> 32) % every == 0:
            yield start, i + 1
            start = i + 1
    if start < len(lines):
        yield start, len(lines)


def solid_lines(lines: list[bytes]) -> list[int]:
    """The numbers of the lines that are not blank."""
    return [i for i, line in enumerate(lines) if line.strip()]


def units(text: str) -> list[tuple[int, bytes]]:
    """(place, bytes) of what may be a repeat: each two lines that follow one another, with
    the blank lines between them, and each long line. The place is twice the number among
    the lines that are not blank, and one more for a long line."""
    lines = text.encode().split(b"\n")
    solid = solid_lines(lines)
    found = []
    for n, i in enumerate(solid):
        if n + 1 < len(solid):
            found.append((2 * n, b"\n".join(lines[i : solid[n + 1] + 1])))
        if len(lines[i].split()) > LONG_LINE:
            found.append((2 * n + 1, lines[i]))
    return found


def runs(key: bytes, hits: list[dict]) -> list[tuple[int, int, bytes, int]]:
    """(start, length, first document, start there) of the passages that the repeated units
    of a document make up, in lines that are not blank. Units go on in one passage where
    their first occurrences do."""
    found, covered = [], set()
    for hit in sorted(hits, key=lambda h: (h["at"] % 2, h["at"])):
        at, first = hit["at"] // 2, hit["first_at"] // 2
        if hit["at"] % 2:
            if at not in covered:
                found.append((at, 1, hit["first"], first))
            continue
        if hit["first"] == key and at - first < 2:  # shares a line with its first occurrence
            continue
        covered |= {at, at + 1}
        if found:
            start, n, doc, there = found[-1]
            if doc == hit["first"] and at == start + n - 1 and first == there + n - 1:
                found[-1] = (start, n + 1, doc, there)
                continue
        found.append((at, 2, hit["first"], first))
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        at, places, digests = [], [], []
        for row, t in enumerate(batch.column(1)):
            for place, piece in units(t.as_py() or ""):
                at.append(row)
                places.append(place)
                digests.append(xxhash.xxh3_128_digest(piece))
        arrays = [
            batch.column(0).take(pa.array(at, pa.int64())),
            pa.array(places, pa.int32()),
            pa.array(digests, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["_key", "_at", "_digest"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for k, hits in zip(batch.column(0), batch.column(1)):
            rows += [(k.as_py(), *r) for r in runs(k.as_py(), hits.as_py())]
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
        columns = zip(*rows) if rows else [()] * 5
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, ["_k", "_start", "_n", "_first", "_there"])


def _first_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the given passages of a text."""
    for batch in slices(batches):
        at, there, lengths, pieces = [], [], [], []
        for row, (t, wanted) in enumerate(zip(batch.column(1), batch.column(2))):
            lines = (t.as_py() or "").encode().split(b"\n")
            solid = solid_lines(lines)
            for w in wanted.as_py():
                at.append(row)
                there.append(w["there"])
                lengths.append(w["n"])
                last = solid[w["there"] + w["n"] - 1]
                pieces.append(b"\n".join(lines[solid[w["there"]] : last + 1]))
        arrays = [
            batch.column(0).take(pa.array(at, pa.int64())),
            pa.array(there, pa.int32()),
            pa.array(lengths, pa.int32()),
            pa.array(pieces, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["_first", "_there", "_n", "_piece"])


def without(text: str, pieces: dict[int, bytes]) -> tuple[str, int]:
    """The text without the passages whose bytes equal the given ones, and how many lines went."""
    lines = text.encode().split(b"\n")
    keep = [True] * len(lines)
    for start, piece in pieces.items():
        n = piece.count(b"\n") + 1
        if b"\n".join(lines[start : start + n]) == piece:
            keep[start : start + n] = [False] * n
    left = b"\n".join(line for line, stays in zip(lines, keep) if stays)
    return left.decode(), len(keep) - sum(keep)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, gone = [], []
        for t, repeats in zip(batch.column(1), batch.column(2)):
            text, n = t.as_py(), 0
            if repeats.is_valid and text:
                solid = solid_lines(text.encode().split(b"\n"))
                text, n = without(text, {solid[r["start"]]: r["piece"] for r in repeats.as_py()})
            texts.append(text)
            gone.append(n)
        arrays = [batch.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["_doc", "_text", "_gone"])


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with later repeats of passages cut from the text, and `_gone`, the
    number of lines cut."""
    key = F.unhex(content_key(id, text))
    whole = docs.select(key.alias("_key"), F.struct("*").alias("_doc"))
    known = docs.select(
        F.struct(F.col(id).isNull().alias("no"), F.col(id).alias("id"), key.alias("k")).alias("_key"),
        F.col(text).alias("_text"),
    )
    key_type = known.schema["_key"].dataType.simpleString()
    seen = known.mapInArrow(_digests, f"_key {key_type}, _at int, _digest binary")
    place = F.struct("_key", "_at")
    counted = seen.groupBy("_digest").agg(
        F.min(place).alias("_first"), F.max(place).alias("_last")
    )
    repeated = counted.where("_first != _last").select("_digest", "_first")
    hit = F.struct(
        F.col("_at").alias("at"),
        F.col("_first._key.k").alias("first"),
        F.col("_first._at").alias("first_at"),
    )
    later = (
        seen.join(repeated, "_digest")
        .where(F.struct("_key", "_at") != F.col("_first"))
        .groupBy(F.col("_key.k").alias("_k"))
        .agg(F.collect_set(hit).alias("_hits"))  # the units of one document
        .mapInArrow(_runs, "_k binary, _start int, _n int, _first binary, _there int")
    )
    later = materialise(later, "passages")
    source = ("_first", "_there", "_n")
    span = F.struct(F.col("_there").alias("there"), F.col("_n").alias("n"))
    wanted = later.select(*source).distinct().groupBy("_first").agg(F.collect_list(span).alias("_spans"))
    texts = docs.select(key.alias("_key"), F.col(text).alias("_text"))
    firsts = (
        texts.join(wanted.hint("merge"), F.col("_key") == F.col("_first"))
        .select("_first", "_text", "_spans")
        .mapInArrow(_first_pieces, "_first binary, _there int, _n int, _piece binary")
        .groupBy(*source)
        .agg(F.min("_piece").alias("_piece"))
    )
    piece = F.struct(F.col("_start").alias("start"), F.col("_piece").alias("piece"))
    repeats = later.join(firsts, list(source)).groupBy("_k").agg(F.collect_list(piece).alias("_repeats"))
    joined = whole.join(repeats.hint("merge"), F.col("_key") == F.col("_k"), "left")
    doc_type = joined.schema["_doc"].dataType.simpleString()
    cut = joined.select("_doc", F.col("_doc")[text].alias("_text"), "_repeats").mapInArrow(
        _cut, f"_doc {doc_type}, _text string, _gone bigint"
    )
    return cut.select(
        *[F.col("_text").alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns],
        "_gone",
    )

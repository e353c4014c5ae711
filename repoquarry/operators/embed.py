"""Embedding texts in Arrow batches, with a pluggable embedder.

An embedder is a small picklable object with `dim` and `embed(texts) -> ndarray`.
Each Python worker gets its own copy, so a model is loaded once per task at most.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.text import is_blank, strip
from repoquarry.functions.tokens import token_bucket, tokens
from repoquarry.session import explode_all

RESULT = "struct<vector:array<float>,error:string>"


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


# The token pattern of `functions.tokens` in the words of Python's `re`, where \s
# would be all of Unicode's white space.
_TOKEN = re.compile(r"\w+|[^\w \t\n\x0b\f\r]")


@lru_cache(maxsize=1 << 17)
def _hash_of(token: str) -> int:
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big")


class HashEmbedder:
    """Offline default: token counts hashed into `dim` places, as a unit vector.

    Texts are near when they share words; it knows nothing about meaning.
    """

    def __init__(self, dim: int = 1536) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        """One bincount over the whole batch: token hashes of all texts flattened, each
        offset by its row times `dim`."""
        found = [_TOKEN.findall(text.lower()) for text in texts]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        hashes = np.fromiter((_hash_of(t) for tokens in found for t in tokens), np.int64, int(lengths.sum()))
        rows = np.repeat(np.arange(len(found), dtype=np.int64), lengths)
        cells = rows * self.dim + hashes % self.dim
        out = np.bincount(cells, minlength=len(found) * self.dim).astype(np.float64).reshape(len(found), self.dim)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32)


def token_counts(texts: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """The counts behind the offline embedder as rows (key, bucket, n)."""
    each = texts.select(key, explode_all(tokens(F.lower(F.col(text)))).alias("nth", "token"))
    # A text without tokens is one row with a NULL token here, and drops out.
    found = each.where("token IS NOT NULL")
    return (
        found.select(key, token_bucket(F.col("token"), dim).alias("bucket"))
        .groupBy(key, "bucket")
        .agg(F.count("*").alias("n"))
    )


def _checked(vectors: np.ndarray, rows: int, dim: int) -> np.ndarray:
    vectors = np.asarray(vectors, dtype=np.float32)
    if vectors.shape != (rows, dim):
        raise ValueError(f"embedder returned shape {vectors.shape}, not {(rows, dim)}")
    return vectors


IN_FLIGHT = 4  # requests a task keeps running at once
RETRIES, BACKOFF = 1, 0.1  # a failed request is sent once more after 0.1 s (doubling)


def _answer(embedder: Embedder, texts: list[str]) -> np.ndarray | None:
    """Vectors of one request, None if it fails."""
    try:
        return _checked(embedder.embed(texts), len(texts), embedder.dim)
    except Exception:
        return None


def _text_by_text(embedder: Embedder, texts: list[str], fail: bool):
    """Vectors and errors of a request that keeps failing, a text at a time."""
    vectors = np.full((len(texts), embedder.dim), np.nan, dtype=np.float32)
    errors: list[str | None] = [None] * len(texts)
    for i, text in enumerate(texts):
        try:
            vectors[i] = _checked(embedder.embed([text]), 1, embedder.dim)[0]
        except Exception as exc:
            if fail:
                raise RuntimeError(f"no embedding for the text at index {i}") from exc
            errors[i] = f"{type(exc).__name__}: {exc}"
    return vectors, errors


def _as_arrow(vectors: np.ndarray, errors: list[str | None]) -> pa.StructArray:
    n, dim = vectors.shape
    failed = np.array([e is not None for e in errors], dtype=bool)
    offsets = np.arange(n + 1, dtype=np.int32) * dim
    lists = pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(vectors.reshape(-1)), mask=pa.array(failed)
    )
    return pa.StructArray.from_arrays(
        [lists, pa.array(errors, pa.string())], names=["vector", "error"]
    )


def in_order(requests: Iterator, in_flight: int, pool: ThreadPoolExecutor) -> Iterator:
    """Results of calls `(fn, *args)` in the order given, with at most `in_flight` running
    and the next sent as soon as the oldest is taken."""
    window: deque = deque()
    for fn, *args in requests:
        if len(window) >= in_flight:
            yield window.popleft().result()
        window.append(pool.submit(fn, *args))
    while window:
        yield window.popleft().result()


def embedding_of(
    text: Column, embedder: Embedder, batch_size: int, fail: bool = True, in_flight: int = IN_FLIGHT,
    retries: int = RETRIES,
) -> Column:
    """Struct of the vector of a text, and of the error when there is none.

    Texts are stripped first and go to the embedder `batch_size` at a time; each task keeps
    `in_flight` requests running, so that its slot does not wait for one answer at a time,
    and puts the answers back in order. The failed requests of a batch are sent again
    together, after one pause that doubles with each attempt, then text by text.
    """

    @F.arrow_udf(RESULT)
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with ThreadPoolExecutor(max(1, in_flight)) as pool:
            for batch in batches:
                if not len(batch):
                    yield _as_arrow(np.zeros((0, embedder.dim), np.float32), [])
                    continue
                starts = range(0, len(batch), batch_size)

                def sent(fn, which, *args):
                    requests = ((fn, embedder, batch.slice(starts[i], batch_size).to_pylist(), *args) for i in which)
                    return zip(which, in_order(requests, max(1, in_flight), pool))

                vectors = [answer for _, answer in sent(_answer, range(len(starts)))]
                errors: list[str | None] = [None] * len(batch)
                for attempt in range(retries + 1):
                    failed = [i for i, answer in enumerate(vectors) if answer is None]
                    if not failed or attempt == retries:
                        break
                    time.sleep(BACKOFF * 2**attempt)
                    for i, answer in sent(_answer, failed):
                        vectors[i] = answer
                for i, (answer, own) in sent(_text_by_text, failed, fail):
                    vectors[i], errors[starts[i] : starts[i] + len(own)] = answer, own
                yield _as_arrow(np.concatenate(vectors), errors)

    # Marked so that a filter on the result is not pushed below it, which would embed
    # every text a second time.
    return embed.asNondeterministic()(strip(text))


def check_content(docs: DataFrame, content: str, on_error: str) -> DataFrame:
    """Add `error` for contents that cannot be embedded: NULL, '' or white space.

    With `on_error="fail"` such a row stops the job instead.
    """
    text = F.col(content)
    error = F.when(text.isNull() | (text == ""), "content is missing").when(
        is_blank(text), "content is white space only"
    )
    if on_error == "fail":
        error = F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("invalid document: "), error)))
    return docs.withColumn("error", error.cast("string"))


def embed_column(
    docs: DataFrame,
    text: str,
    embedder: Embedder,
    batch_size: int = 32,
    on_error: str = "fail",
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """Add `embedding` and `embed_error`. Each task keeps `in_flight` requests running."""
    result = embedding_of(F.col(text), embedder, batch_size, on_error == "fail", in_flight)
    return (
        docs.withColumn("_e", result)
        .withColumn("embedding", F.col("_e.vector"))
        .withColumn("embed_error", F.col("_e.error"))
        .drop("_e")
    )

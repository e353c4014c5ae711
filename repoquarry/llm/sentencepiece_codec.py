"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here: pieces with scores and types, the kind of model, the
normaliser's character map and its white-space settings. From these a tokenizer is built:
unigram scores, or the merges that pair scores imply, with byte fallback; the normaliser;
and the metaspace marker, which stands for a space.

Texts are cut into segments where no piece of the vocabulary can reach across: before a run
of markers that no piece has inside, and around a line feed that only a byte piece covers.
Ids of a text are then those of its segments. Distinct segments are encoded in batches, by
as many threads as set, and kept for the next texts; equal words are encoded once.

Parity with the reference library is checked by `verify_parity` for given texts; the query's
tests hold all texts of a table against it. Every text is also decoded again and compared.

Defined cases: null and empty texts have no ids and decode to the empty text. Repeated rows
get equal ids, an empty table an empty result; other columns are not read. Texts that hold
the marker itself decode it as a space, as in the reference library.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, models, normalizers

from repoquarry.llm.common import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
KEPT_SEGMENTS = 100_000  # per worker, then the table starts again
BATCH_BYTES = 1 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[wire]
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class Codec:
    """Encodes and decodes like the model in `data`."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        rules: dict = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece.get(2, bytes(4)))[0]
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        self.unigram = trainer.get(3, 1) == 1
        if not self.unigram and trainer.get(3) != 2:
            raise ValueError("unigram and BPE models are supported")
        self.prefix = bool(rules.get(3, 1))
        self.squeeze = bool(rules.get(4, 1))
        if not rules.get(5, 1) or trainer.get(24, 0):
            raise ValueError("models need escaped white space, before words")
        kinds = [kind for _, _, kind in self.pieces]
        self.unknown = kinds.index(UNKNOWN)
        self.byte_fallback = kinds.count(BYTE) == 256
        self.charsmap = rules.get(2, b"")
        self._normalizer = normalizers.Precompiled(self.charsmap) if self.charsmap else None
        self._tokenizer = self._build()
        self._cut = self._segments()
        self._known: dict[str, bytes] = {}
        self._bytes = [self._piece_bytes(i) for i in range(len(self.pieces))]

    def _build(self) -> Tokenizer:
        ids = {piece: i for i, (piece, _, _) in enumerate(self.pieces)}
        if self.unigram:
            # Pieces that never come from text keep their id but lose every comparison.
            scores = [
                (p, s if kind in (NORMAL, USER) else (s if kind == UNKNOWN else -1e9))
                for p, s, kind in self.pieces
            ]
            model = models.Unigram(scores, self.unknown, self.byte_fallback)
        else:
            merges = []
            for piece, score, kind in self.pieces:
                if kind == NORMAL:
                    for i in range(1, len(piece)):
                        left, right = ids.get(piece[:i]), ids.get(piece[i:])
                        if left is not None and right is not None:
                            merges.append((-score, left, right, (piece[:i], piece[i:])))
            merges.sort()
            model = models.BPE(
                vocab=ids,
                merges=[pair for *_, pair in merges],
                unk_token=self.pieces[self.unknown][0],
                fuse_unk=True,
                byte_fallback=self.byte_fallback,
            )
        tokenizer = Tokenizer(model)
        added = [AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER]
        if added:
            tokenizer.add_tokens(added)
        return tokenizer

    def _segments(self) -> re.Pattern | None:
        """Where texts may be cut; None if a piece could reach across."""
        normal = [p for p, _, kind in self.pieces if kind in (NORMAL, USER)]
        if any(MARK in p.lstrip(MARK) for p in normal) or not self.byte_fallback:
            return None
        if any("\n" in p for p in normal):
            return re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        return re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")

    def _piece_bytes(self, number: int) -> bytes:
        piece, _, kind = self.pieces[number]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return piece.replace(MARK, " ").encode()

    def normalised(self, text: str) -> str:
        """The text as it is encoded, with markers."""
        if self._normalizer is not None:
            text = self._normalizer.normalize_str(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        text = text.replace(" ", MARK)
        if self.squeeze:
            text = text.rstrip(MARK)
        return MARK + text if self.prefix and text else text

    def _learn(self, segments: set[str]) -> None:
        waiting: list[str] = []
        size = 0
        for segment in segments:
            waiting.append(segment)
            size += len(segment)
            if size >= BATCH_BYTES:
                self._encode(waiting)
                waiting, size = [], 0
        self._encode(waiting)

    def _encode(self, segments: list[str]) -> None:
        for segment, found in zip(
            segments, self._tokenizer.encode_batch_fast(segments, add_special_tokens=False)
        ):
            self._known[segment] = np.array(found.ids, np.int32).tobytes()

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers in a row."""
        cut = self._cut
        parts = []
        for text in texts:
            normal = self.normalised(text)
            parts.append(cut.findall(normal) if cut is not None else [normal] if normal else [])
        if len(self._known) > KEPT_SEGMENTS:
            self.forget()
        known = self._known
        new = set(chain.from_iterable(parts)).difference(known)
        if new:
            self._learn(new)
        lookup = known.__getitem__
        return [b"".join(map(lookup, p)) for p in parts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        return [np.frombuffer(p, np.int32).tolist() for p in self.encode_packed(texts)]

    def forget(self) -> None:
        """Give up the segments kept so far."""
        self._known = {}

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of byte pieces join; what is no UTF-8 becomes U+FFFD, one
        for each byte."""
        raw = b"".join(map(self._bytes.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = raw.decode("utf-8", "surrogateescape")
            text = re.sub("[\udc80-\udcff]", "�", text)
        return self._without_prefix(text)

    def _without_prefix(self, text: str) -> str:
        if self.squeeze:
            return text.lstrip(" ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def plain(self, text: str) -> str:
        """What decoding the ids of a text gives when nothing is unknown."""
        return self._without_prefix(self.normalised(text).replace(MARK, " "))


_CODECS: dict[bytes, Codec] = {}  # one model a worker, by digest


def codec_of(data: bytes, threads: int = 1) -> Codec:
    digest = hashlib.sha256(data).digest()
    if digest not in _CODECS:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        _CODECS.clear()
        _CODECS[digest] = Codec(data)
    return _CODECS[digest]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def verify_parity(path: str, texts: list[str]) -> list[str]:
    """The texts that the reference library encodes or decodes differently."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = codec_of(read_model(path))
    odd = []
    for text, ids in zip(texts, codec.encode(texts)):
        if ids != theirs.encode(text) or codec.decode(ids) != theirs.decode(ids):
            odd.append(text)
    return odd


def _sent(df: DataFrame, model: str) -> Broadcast:
    """The model on all executors: a file of a few megabytes at most."""
    return df.sparkSession.sparkContext.broadcast(read_model(model))


def _encoder(model: Broadcast, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value, threads)
        for batch in slices(batches):
            texts = [t.as_py() or "" for t in batch.column(1)]
            packed = codec.encode_packed(texts)
            ids = [np.frombuffer(p, np.int32) for p in packed]
            same = [codec.decode(i.tolist()) == codec.plain(t) for i, t in zip(ids, texts)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.frombuffer(b"".join(packed), np.int32)
            arrays = [
                batch.column(0),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                pa.array(sizes),
                pa.array(same, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(
                arrays, ["_id", "token_ids", "n_tokens", "round_trip"]
            )
        codec.forget()

    return run


def encode_texts(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text",
                 threads: int = 2) -> DataFrame:
    """(id, token_ids, n_tokens, round_trip): `round_trip` says whether the ids decode to
    the normalised text. The model file is read on the driver and sent to the executors."""
    slim = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = slim.schema[0].dataType.simpleString()
    schema = f"_id {kind}, token_ids array<int>, n_tokens bigint, round_trip boolean"
    return slim.mapInArrow(_encoder(_sent(docs, model), threads), schema).withColumnRenamed("_id", id)


def _decoder(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch in slices(batches):
            texts = [codec.decode(i.as_py() or []) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    return run


def decode_ids(encoded: DataFrame, model: str, id: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(id, text) of rows with token ids."""
    slim = encoded.select(F.col(id).alias("_id"), F.col(ids).alias("_ids"))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(_decoder(_sent(encoded, model)), f"_id {kind}, text string").withColumnRenamed("_id", id)

r"""Token ids of whole texts by a public byte-level BPE vocabulary.

A sentencepiece model is serialised from the vocabulary itself: each token's bytes, mapped one to one to printable
characters, become a piece whose score is its negative rank, with identity normalisation; merging the best scored
pair first is then merging by rank. Pre-tokens are split by the vocabulary's pattern and encoded once
each per task; decoding is the inverse mapping of the bytes.

Null and empty texts give an empty list, blank texts are encoded as they are; no special tokens are added, and their
strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import importlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemaruang.session import spread

#: The pattern that splits text before merging (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The cache of pre-tokens of one task is emptied beyond this many.
CACHE = 1_000_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The vocabulary's file: in ``folder``, else the folder named by TOKENIZER_DIR, else where the installed package keeps it."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if not folder:
        folder = os.path.dirname(importlib.import_module("public_tokenizers").__file__)
    return os.path.join(folder, name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_letters() -> list[str]:
    """One printable character for each byte: itself where it is printable in Latin-1, else the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes | int | float) -> bytes:
    """One field in protocol-buffer wire format."""
    if isinstance(payload, bytes):
        return _varint(number << 3 | 2) + _varint(len(payload)) + payload
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    return _varint(number << 3) + _varint(payload)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the id after the last is the unknown piece, which no mapped text can yield."""
    letters = byte_letters()
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without a gap")
    # ModelProto: 1 pieces (1 piece, 2 score, 3 type: 1 normal, 2 unknown), 2 trainer_spec, 3 normalizer_spec
    parts = [_field(1, _field(1, "".join(letters[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, t in enumerate(order)]
    parts.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    n = len(order)
    # TrainerSpec: 3 model_type (2 BPE), 4 vocab_size, 40 unk_id, 41 bos_id, 42 eos_id, 43 pad_id (-1: none)
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, none) + _field(42, none) + _field(43, none)
    # NormalizerSpec: 1 name, 3 add_dummy_prefix, 4 remove_extra_whitespaces, 5 escape_whitespaces
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(parts) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.known: dict[str, list[int]] = {}

    def _map(self, pre: str) -> str:
        return pre.encode("utf-8", "replace").decode("latin-1").translate(self.letters)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts one after another."""
        split = [self.split(t) if t else [] for t in texts]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = list({p for pres in split for p in pres if p not in known})
        if new:
            known.update(zip(new, self.processor.encode([self._map(p) for p in new], num_threads=1)))
        ids: list[int] = []
        offsets = np.zeros(len(texts) + 1, np.int64)
        for i, pres in enumerate(split):
            for p in pres:
                ids += known[p]
            offsets[i + 1] = len(ids)
        return offsets, np.array(ids, np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[1].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path)


def _batches(table: pa.Table, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches(max_chunksize=rows)


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row; no shuffle."""
    where = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        for batch in batches:
            offsets, ids = enc.encode_all(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=[key, "ids"])

    rows = spread(df.select(F.col(key).cast("long").alias(key), text))
    return rows.mapInArrow(run, f"`{key}` long, ids array<int>")


def decode_column(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the inverse of encode_column."""
    where = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(key).cast("long").alias(key), ids).mapInArrow(run, f"`{key}` long, text string")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row."""
    return encode_column(df, key, text, path).select(key, F.size("ids").alias("n_tokens"))

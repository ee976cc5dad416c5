"""Byte-level BPE by a sentencepiece model that is serialised here from a rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velaspan.llm.kernels import give_back
from velaspan.llm.memory import Memory, groups
from velaspan.llm.workspace import documents

#: Chunks, and pre-tokens, whose ids a worker remembers in each of two generations (about 200 bytes each).
CACHE = 150_000
#: Unicode's White_Space, spelled out: engines differ on \s for U+001C to U+001F.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece i is ``pieces[i]`` in byte characters, with score -i.

    One unknown piece follows, which nothing ever maps to. Normalisation is the
    identity: no prefix, no folding or escaping of white space.
    """
    to = byte_characters()
    out = bytearray()
    for rank, piece in enumerate(pieces):
        out += _field(1, _field(1, "".join(to[b] for b in piece).encode()) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    out += _field(2, _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, -1) + _field(42, -1) + _field(43, -1))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file (base64 and rank a line), by rank from 0 without gaps."""
    rows = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, Path(path).read_bytes().splitlines()))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks must run from 0 without gaps")
    return [p for _, p in rows]


class Codec:
    """Encode texts to ids and back. One per worker process, by :func:`codec`."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        pieces = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(pieces))
        self.map = dict(enumerate(byte_characters()))
        back = {c: b for b, c in self.map.items()}
        self.pieces = [bytes(map(back.__getitem__, self.model.id_to_piece(i))) for i in range(len(pieces))]
        # a piece that no merges lead to is itself all the same, as the rank libraries have it
        whole = self.model.encode([self._mapped(p) for p in pieces], num_threads=1)
        self.apart = {p: struct.pack("<I", i) for i, (p, ids) in enumerate(zip(pieces, whole, strict=True)) if ids != [i]}
        pattern = pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")
        self.split = regex.compile(pattern).findall
        self.run = regex.compile(f" [{WHITE}]")
        self.cut = regex.compile(f" (?=[^{WHITE}])")
        self.tokens, self.chunks = Memory(self._tokens, CACHE), Memory(self._chunks, CACHE)

    def _mapped(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self.map)

    def _tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of pre-tokens, merged by the model."""
        data = [t.encode() for t in tokens]
        found = self.model.encode([self._mapped(t) for t in data], num_threads=1)
        return [self.apart.get(t) or struct.pack(f"<{len(ids)}I", *ids) for t, ids in zip(data, found, strict=True)]

    def _chunks(self, chunks: list[str]) -> Iterator[bytes]:
        parts = [self.split(c) for c in chunks]
        known = self.tokens.having({t for p in parts for t in p})
        return (b"".join([known[t] for t in p]) for p in parts)

    def _cut(self, text: str) -> list[str]:
        """A pre-token never reaches over a space that stands before a non-space, so texts are cut there."""
        parts = self.cut.split(text) if self.run.search(text) else text.split(" ")
        if len(parts) > 1 and not parts[-1]:  # the text's last space has nothing after it
            parts[-2:] = [parts[-2] + " "]
        parts[1:] = [" " + p for p in parts[1:]]
        return parts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = [self._cut(t) if t else [] for t in texts]
        known = self.chunks.having({c for p in parts for c in p})
        return [b"".join([known[c] for c in p]) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the characters of the model's pieces stand for."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each text: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]).

    ids are those of byte-level BPE by the ranks in ``path``, each match of
    ``pattern`` separately, no special tokens: merged by sentencepiece, lowest
    rank first, leftmost first; a match that is a piece itself is that piece.
    Texts come back by the inverse mapping of the model's pieces. Null and empty texts have no ids. Rows are independent, so
    nothing is shuffled; repeated ids stay repeated rows; other columns are
    ignored. ``with_ids`` adds the ids (array<int>) and the decoded bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            at = 0
            for group in groups(x.as_py() for x in batch.column(1)):
                ids = own.encode(group)
                texts = [own.decode(x) for x in ids]
                out = [batch.column(0).slice(at, len(group)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
                if with_ids:
                    out += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(texts, pa.binary())]
                at += len(group)
                yield pa.RecordBatch.from_arrays(out, names=names)
            give_back()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids)


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every whole text of ``documents`` by the 50k byte ranks, and back."""
    import public_tokenizers

    return encoded(documents(spark, sf_dir), path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

"""Byte-level BPE through a sentencepiece model written straight from a rank file.

The rank file lists byte strings with their merge rank. Every byte is mapped to
one printable character, so each byte string becomes a sentencepiece piece whose
score is the negative rank: sentencepiece then merges the pair of lowest rank
first, leftmost on ties, as byte-level BPE asks. The piece ids are the ranks.
The normaliser is the identity, so pieces meet the text unchanged.

Texts are cut by the pre-token pattern; every pre-token is encoded on its own.
Decoding maps ids back to pieces and their characters back to bytes.
"""

from __future__ import annotations

import base64
import struct
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from sensorframe.llm.common import map_rows, text_of

#: Pre-tokens of up to so many characters are remembered, in two generations of so many.
REMEMBER_CHARS, REMEMBER = 32, 60_000
_MODELS: dict[int, "Model"] = {}


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, b: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(b)) + b


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model as protocol buffer; ids are ranks, the unknown piece is last."""
    chars = byte_characters()
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[b] for b in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"single bytes without a rank: {missing[:5]}")

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    pieces = [piece("".join(chars[b] for b in word), -float(i), 1) for i, word in enumerate(by_rank)]
    pieces.append(piece("<unk>", 0.0, 2))
    trainer = b"".join([_number(3, 2), _number(4, len(pieces)), _number(22, 0), _number(35, 0),
                        _number(40, len(by_rank))])
    identity = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*pieces, _bytes(2, trainer), _bytes(3, identity)])


class Remembered(dict):
    """Packed ids by pre-token. When full, the older half is dropped unless it is asked for again."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, token: str) -> bytes:
        packed = self.older.get(token)
        if packed is None:
            packed = self.encode(token)
        if len(token) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER:
                self.older = dict(self)
                self.clear()
            self[token] = packed
        return packed


class Model:
    """The serialised model with its byte tables; remembers short pre-tokens."""

    def __init__(self, proto: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        chars = byte_characters()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        to_byte = {c: b for b, c in enumerate(chars)}
        n = self.sp.get_piece_size() - 1
        self.pieces = [bytes(map(to_byte.__getitem__, self.sp.id_to_piece(i))) for i in range(n)]
        self.whole = {p: i.to_bytes(4, "little") for i, p in enumerate(self.pieces)}
        self.seen = Remembered(self.encode_token)

    def encode_token(self, token: str) -> bytes:
        raw = token.encode()
        packed = self.whole.get(raw)  # a pre-token that is a piece stands as it is
        if packed is None:
            ids = self.sp.encode(raw.decode("latin-1").translate(self.to_chars))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def encode(self, tokens: list[str]) -> bytes:
        """Packed ids (little-endian, 32 bits) of pre-tokens."""
        return b"".join(map(self.seen.__getitem__, tokens))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def model_of(proto: bytes) -> Model:
    """The worker's copy of a model, built once per process."""
    key = hash(proto)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(proto)
    return _MODELS[key]


def encode(docs: DataFrame, proto: bytes, pattern: str, keep=("doc_id",), text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int), ``n_tokens`` (bigint) and ``ids_sha256`` of every whole text.

    The digest is over the ids as little-endian unsigned 32-bit integers. A null
    text counts as empty and gives an empty array; rows stay rows, repeated or
    not. Of other columns only those in ``keep`` are returned.
    """
    def make():
        model, cut = model_of(proto), regex.compile(pattern).findall

        def run(b: pa.RecordBatch) -> list:
            packed = [model.encode(cut(t.as_py())) for t in b.column("_text")]
            n = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            values = np.frombuffer(b"".join(packed), "<i4")
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(n),
                    pa.array([sha256(p).hexdigest() for p in packed])]
        return run

    rows = docs.select(*keep, text_of(text).alias("_text"))
    return map_rows(rows, "ids array<int>, n_tokens bigint, ids_sha256 string", keep, make)


def decode(coded: DataFrame, proto: bytes, keep=("doc_id",), ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary): the bytes that the ids stand for; null ids give no bytes."""
    def make():
        model = model_of(proto)

        def run(b: pa.RecordBatch) -> list:
            lists = b.column("_ids")
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            return [pa.array([model.decode(values[i:j].tolist()) for i, j in zip(at[:-1], at[1:])], pa.binary())]
        return run

    rows = coded.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids"))
    return map_rows(rows, "decoded binary", keep, make)


def round_trip(docs: DataFrame, proto: bytes, pattern: str, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one visit: ``ids``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text.

    The ids are decoded again by the inverse mapping where they are made, so one
    Python worker a task holds the model and the decoded bytes do not travel.
    """
    def make():
        model, cut = model_of(proto), regex.compile(pattern).findall

        def run(b: pa.RecordBatch) -> list:
            packed = [model.encode(cut(t.as_py())) for t in b.column("_text")]
            n = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            values = np.frombuffer(b"".join(packed), "<i4")
            back = [sha256(model.decode(values[i:j].tolist())).hexdigest() for i, j in zip(offsets[:-1], offsets[1:])]
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(n),
                    pa.array([sha256(p).hexdigest() for p in packed]), pa.array(back, pa.string())]
        return run

    rows = docs.select(*keep, text_of(text).alias("_text"))
    return map_rows(rows, "ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep, make)

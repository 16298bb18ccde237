"""A SentencePiece model file read without its library: protobuf fields in plain bytes.

Only the fields that encoding needs are read: pieces with score and kind, the kind of
model, the special ids and the settings of the normaliser.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"

# field numbers and values of the public protobuf schema
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, UNK_ID = 3, 35, 40
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"protobuf wire type {kind}")
        yield tag >> 3, value


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    def cuts_at_spaces(self) -> bool:
        """No piece has the space mark after another character: texts may be cut before it."""
        return not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.pieces)


def parse(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in _fields(data):
        if number == PIECES:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append(piece)
            model.scores.append(score)
            model.kinds.append(kind)
        elif number == TRAINER:
            for n, v in _fields(value):
                if n == MODEL_TYPE:
                    model.model_type = v
                elif n == BYTE_FALLBACK:
                    model.byte_fallback = bool(v)
                elif n == UNK_ID:
                    model.unk_id = v
        elif number == NORMALIZER:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    return model


def model_bytes(spark, path: str) -> bytes:
    """The file, read where the driver or any of Spark's file systems has it."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])

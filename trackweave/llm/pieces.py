"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed, its parts are rebuilt as a tokenizers pipeline (normaliser,
space mark, unigram scores or merges in score order, byte fallback). Where no piece
crosses a cut before spaces, each distinct part of a batch is encoded and decoded once;
otherwise whole texts are. The library's threads share each list. Ids of parts (and their decoded bytes, where
they are asked for) are remembered in flat buffers of at most ``MOST_KNOWN`` bytes. The file travels as bytes
(its size is checked); tasks need no path. The first use in a process compares what is used with the original
library, on a fixed set of texts and on the first ``PARITY`` texts of the process with up to
``PARITY_CHARS`` characters, and stops on any difference.

Defined cases: null text has null ids, count and text; empty text has no ids; special
tokens written out in a text are ordinary text, and decoding gives the text back. Texts are encoded whole, at
any length. Repeated rows are encoded each by itself, an empty table gives no rows, and all other columns pass through.
Models with user-defined pieces are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from trackweave.llm.piece_model import BPE, BYTE, NORMAL, SPACE_MARK, TOKENIZER, USER_DEFINED, PieceModel, model_bytes, parse
from trackweave.llm.segments import Parts, column_parts

MOST_BYTES = 64 << 20  # of a model file sent to the tasks
TEXTS = 1 << 21  # characters encoded in one call
MOST_KNOWN = 32 << 20  # bytes of remembered parts in a process
LOT = 1 << 13  # parts encoded in one call
PARITY = 16
PARITY_CHARS = 1 << 14

PROBES = [
    "", " ", "  two  spaces ", "Hello, world!", "\n\tline\r\nline", "Ärger, naïve, été, señor", "日本語 한국어 🙂🙃",
    "</s> <s> <unk> <0x0A>", "▁marked▁ text", "aaaaaaaaaaaaaaaa bbbb", "x" * 300, "1234567890 3.14", "á​\x00z",
]


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece; a better piece is merged first."""
    usable = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
    found = []
    for piece, i in usable.items():
        pairs = [(piece[:j], piece[j:]) for j in range(1, len(piece)) if piece[:j] in usable and piece[j:] in usable]
        found += [(-model.scores[i], usable[a], usable[b], a, b) for a, b in pairs]
    found.sort()
    return [(a, b) for *_, a, b in found]


def rebuild(data: bytes) -> Tokenizer:
    """A tokenizers pipeline that encodes as the model file says."""
    model = parse(data)
    if USER_DEFINED in model.kinds:
        raise ValueError("user-defined pieces are not rebuilt")
    unk = model.pieces[model.unk_id]
    if model.model_type == BPE:
        vocab = {p: i for i, p in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram(list(zip(model.pieces, model.scores)), unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    made = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(SPACE_MARK))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", SPACE_MARK))
    made.normalizer = normalizers.Sequence(steps)
    if model.cuts_at_spaces():
        # no piece crosses such a cut, so words are encoded by themselves and remembered
        made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+"), "isolated")
    made.decoder = decoders.Sequence([decoders.Replace(SPACE_MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])])
    return made


@lru_cache(maxsize=2)
def checked(data: bytes) -> Tokenizer:
    """The rebuilt tokenizer, after it has agreed with the original library."""
    import sentencepiece

    made = rebuild(data)
    known = sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in PROBES:
        ids = made.encode(text, add_special_tokens=False).ids
        if ids != known.encode(text) or made.decode(ids, skip_special_tokens=False) != known.decode(ids):
            raise ValueError(f"the rebuilt tokenizer differs from the model on {text!r}")
    return made


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``TEXTS`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= TEXTS:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def encode(tokenizer: Tokenizer, texts: list[str | None]) -> list[np.ndarray | None]:
    """Ids of whole texts, encoded as they are."""
    got = iter(tokenizer.encode_batch_fast([t for t in texts if t is not None], add_special_tokens=False))
    return [None if t is None else np.array(next(got).ids, dtype=np.int32) for t in texts]


def _gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of ``values`` one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(begin - (ends - size), size)]


class Buffer:
    """Spans of one kind of values, one after the other."""

    def __init__(self, kind: type):
        self.values = np.zeros(0, dtype=kind)
        self.ends = np.zeros(1, dtype=np.int64)

    def add(self, lots: list[tuple[np.ndarray, list[int]]]) -> None:
        """Lots of spans, each given as values in a row and sizes."""
        self.values = np.concatenate([self.values, *[v for v, _ in lots]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([n for _, sizes in lots for n in sizes], dtype=np.int64)])

    def taken(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(values, sizes)`` of the spans of the given numbers."""
        size = self.ends[which + 1] - self.ends[which]
        return _gathered(self.values, self.ends[which], size), size


class PartCoder:
    """Encodes and decodes single parts, given with space marks in place of spaces."""

    def __init__(self, data: bytes, model: PieceModel):
        self.prefix = int(model.add_dummy_prefix)
        self.tokenizer = rebuild(data)
        self.tokenizer.normalizer = None  # the parts carry their marks
        self.tokenizer.pre_tokenizer = None  # and need no further cut
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE_MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.plain = [p.replace(SPACE_MARK, " ") for p in model.pieces]
        self.bytes = frozenset(i for i, k in enumerate(model.kinds) if k == BYTE)
        self.decodes = False
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.ids, self.texts = Buffer(np.int32), Buffer(np.uint8)

    def size(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.place, self.ids.values, self.ids.ends, self.texts.values, self.texts.ends))

    def text(self, ids: list[int]) -> str:
        if self.bytes.isdisjoint(ids):
            return "".join([self.plain[i] for i in ids])
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def _learn(self, parts: Parts, which: np.ndarray) -> None:
        """Encodes the parts of the given numbers, a lot at a time, and remembers them in that order."""
        ids, texts = [], []
        for lo in range(0, len(which), LOT):
            some = self.tokenizer.encode_batch_fast(parts.texts(which[lo : lo + LOT], SPACE_MARK), add_special_tokens=False)
            lists = [e.ids for e in some]
            ids.append((np.fromiter((i for x in lists for i in x), dtype=np.int32), [len(x) for x in lists]))
            if self.decodes:
                back = [self.text(x).encode() for x in lists]
                texts.append((np.frombuffer(b"".join(back), dtype=np.uint8), [len(x) for x in back]))
        self.ids.add(ids)
        self.texts.add(texts)

    def numbers(self, parts: Parts, decode: bool) -> np.ndarray:
        """The number of each part among those remembered; new ones are encoded once."""
        if self.size() > MOST_KNOWN or (decode and not self.decodes):
            self.forget()
            self.decodes = decode
        keys, at, number = np.unique(parts.key, return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(found, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~known)
        first = len(self.ids.ends) - 1
        self._learn(parts, at[new])
        place = np.empty(len(keys), dtype=np.int64)
        place[known] = self.place[found[known]]
        place[new] = first + np.arange(len(new))
        joined = np.concatenate([self.keys, keys[new]])
        order = np.argsort(joined, kind="stable")
        self.keys, self.place = joined[order], np.concatenate([self.place, place[new]])[order]
        return place[number]


@lru_cache(maxsize=2)
def by_parts(data: bytes) -> PartCoder | None:
    """A coder of parts, where the model lets texts be cut before spaces."""
    model = parse(data)
    if model.charsmap or model.remove_extra_whitespaces or not model.escape_whitespaces or not model.cuts_at_spaces():
        return None
    return PartCoder(data, model)


def _ids_by_parts(column: pa.Array, coder: PartCoder, decode: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """``(first row, ids in a row, where each text's begin, decoded texts)``."""
    for row, parts in column_parts(column, coder.prefix, SPACE_MARK):
        which = coder.numbers(parts, decode)
        ids, size = coder.ids.taken(which)
        at = np.concatenate([[0], np.cumsum(size)])[parts.first]
        texts: list[str] = []
        if decode:
            flat, size = coder.texts.taken(which)
            cuts = np.concatenate([[0], np.cumsum(size)])[parts.first]
            whole = flat.tobytes()
            texts = [whole[a:b].decode()[coder.prefix :] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        yield row, ids, at, texts


def _ids(column: pa.Array, data: bytes, decode: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """Ids and, if asked for, decoded texts, by the way that the model allows."""
    single = by_parts(data)
    if single is not None:
        yield from _ids_by_parts(column, single, decode)
        return
    whole = checked(data)
    for start, part in _groups([t or "" for t in column.to_pylist()]):
        ids = encode(whole, part)
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        back = whole.decode_batch([x.tolist() for x in ids], skip_special_tokens=False) if decode else []
        yield start, np.concatenate(ids), at, back


@lru_cache(maxsize=2)
def _library(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def compare(data: bytes, texts: list[str]) -> None:
    """Stops unless the way in use encodes and decodes the texts as the original library does."""
    known = _library(data)
    for start, ids, at, back in _ids(pa.array(texts, pa.string()), data):
        for i, text in enumerate(back):
            got = ids[at[i] : at[i + 1]].tolist()
            if got != known.encode(texts[start + i]) or text != known.decode(got):
                raise ValueError(f"the rebuilt tokenizer differs from the model on {texts[start + i]!r}")


_COMPARED: set[bytes] = set()


def _compare_once(data: bytes, column: pa.Array) -> None:
    """Once in a process: the fixed probes and the first short texts of ``column``."""
    if data in _COMPARED:
        return
    found: list[str] = []
    for value in column:
        text = value.as_py()
        if text is not None and len(text) <= PARITY_CHARS:
            found.append(text)
        if len(found) == PARITY:
            break
    compare(data, PROBES + found)
    _COMPARED.add(data)


def _hash(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def _encoder(sent, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _compare_once(sent.value, batch.column("text"))
            for start, ids, at, texts in _ids(batch.column("text"), sent.value, digest):
                kept = batch.slice(start, len(at) - 1)
                null = kept.column("text").is_null().to_numpy(zero_copy_only=False)
                count = pa.array(np.diff(at), pa.int64(), mask=null)
                if digest:
                    there = [(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    same = [t == d for t, d in zip(kept.column("text").to_pylist(), texts)]
                    extra = [
                        pa.array([_hash(ids[a:b].astype("<i4").tobytes()) for a, b in there], pa.string(), mask=null),
                        pa.array([_hash(t.encode()) for t in texts], pa.string(), mask=null),
                        pa.array(np.array(same, dtype=bool), mask=null),
                    ]
                    names = ["doc_id", "n_tokens", "ids_hash", "decoded_hash", "round_trip"]
                    yield pa.RecordBatch.from_arrays([kept.column("doc_id"), count, *extra], names=names)
                else:
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(null))
                    columns = [kept.column(i) for i in range(kept.num_columns)]
                    yield pa.RecordBatch.from_arrays([*columns, count, lists], names=[*kept.schema.names, "n_tokens", "ids"])

    return run


def _sent(docs: DataFrame, path: str):
    data = model_bytes(docs.sparkSession, path)
    if len(data) > MOST_BYTES:
        raise ValueError("the model file is too large to be sent to the tasks")
    checked(data)
    return docs.sparkSession.sparkContext.broadcast(data)


def encoded(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """All columns of ``docs`` with ``n_tokens`` and ``ids``, which replace columns of those names."""
    rows = docs.drop("n_tokens", "ids")
    schema = StructType([*rows.schema.fields, StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(_encoder(_sent(docs, path), False), schema)


def round_trips(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens, ids_hash, decoded_hash, round_trip)`` of every text."""
    rows = docs.select("doc_id", "text")
    schema = StructType(
        [rows.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_hash", StringType()), StructField("decoded_hash", StringType()), StructField("round_trip", BooleanType())]
    )
    return rows.mapInArrow(_encoder(_sent(docs, path), True), schema)


def decoded(rows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """All columns of ``rows`` with ``text`` made from ``ids``."""
    sent = _sent(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = checked(sent.value)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            back = iter(tokenizer.decode_batch([x for x in ids if x is not None], skip_special_tokens=False))
            texts = pa.array([None if x is None else next(back) for x in ids], pa.string())
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], texts], names=[*names, "text"])

    kept = rows.drop("text")
    return rows.mapInArrow(run, StructType([*kept.schema.fields, StructField("text", StringType())]))

"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank vocabulary.

Every byte string of the vocabulary becomes a piece in the printable byte alphabet, scored by its negative rank, with
identity normalisation; the unknown piece is put behind the last rank, so piece ids are ranks. Texts are cut into
pre-tokens, each is encoded by itself, and decoding maps the pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from evitrust.llm.words import slices

#: The code points that count as white space in the pre-token pattern.
SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CACHED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def byte_alphabet() -> list[str]:
    """A printable character for every byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """A protobuf field: bytes as length-delimited, float as 32 bits, int as varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the id after the last one is unknown."""
    names = byte_alphabet()
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[b] for b in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    out = [_field(1, _field(1, "".join(names[x] for x in b).encode()) + _field(2, float(-i)) + _field(3, 1))
           for i, b in enumerate(by_rank)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one task. Pre-tokens meet again and again, so the ids of recent ones are kept."""

    def __init__(self, model: bytes, pattern: str, cached: int = CACHED):
        import regex
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        space = f"[{SPACE}]"
        # \s of the rank files' library is the Unicode property, which lacks the separators U+001C to U+001F
        self.pretokens = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", space)
                                       .replace(r"(?!\S)", f"(?![^{SPACE}])")).findall
        # No pre-token reaches over a place before white space that follows something else
        self.chunks = regex.compile(f"{space}*[^{SPACE}]+|{space}+").findall
        names = byte_alphabet()
        self.to_names = {b: c for b, c in enumerate(names)}
        back = {c: bytes([b]) for b, c in enumerate(names)}
        size = self.model.get_piece_size() - 1
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.whole = {p: [i] for i, p in enumerate(pieces)}
        self.bytes = [b"".join(map(back.__getitem__, p)) for p in pieces]
        self.cache: dict[str, list[int]] = {}  # of chunks
        self.pieces: dict[str, list[int]] = {}  # of pre-tokens in the byte alphabet
        self.cached = cached

    def _names(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", self.to_names[32])
        return piece.encode().decode("latin-1").translate(self.to_names)

    def _learn(self, chunks: list[str]) -> None:
        # letters with at most a space before them are one pre-token
        cut = [[c] if (c[1:] if c[0] == " " else c).isalpha() else self.pretokens(c) for c in chunks]
        cut = [[self._names(p) for p in parts] for parts in cut]
        known, whole = self.pieces, self.whole
        for p in {p for parts in cut for p in parts if p not in known and p in whole}:
            known[p] = whole[p]
        new = [*{p for parts in cut for p in parts if p not in known}]
        if new:
            known.update(zip(new, self.model.encode(new, out_type=int, num_threads=1)))
        for chunk, parts in zip(chunks, cut):
            self.cache[chunk] = known[parts[0]] if len(parts) == 1 else [i for p in parts for i in known[p]]

    def encode(self, text: str) -> list[int]:
        if len(self.cache) > self.cached:
            self.cache.clear()
            self.pieces.clear()
        chunks, cache = self.chunks(text), self.cache
        new = [c for c in set(chunks) if c not in cache]
        if new:
            self._learn(new)
        return list(chain.from_iterable(map(cache.__getitem__, chunks)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>) of every whole text. Null text is empty and gives no ids; repeated rows stay."""
    model = serialise_model(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, pattern)
        for batch in slices(batches, text_col):
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, decoded binary); null ids decode to no bytes."""
    table = sorted(ranks, key=ranks.get)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b"".join(map(table.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    rows = encoded.select(id_col, ids_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Digest of encoding and decoding in one task, so that ids never leave it: (id, n_tokens, ids_sha256,
    decoded_sha256). The same Codec as ``encode``; ids are decoded again from the ids alone."""
    model = serialise_model(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, pattern)
        number = [str(i) for i in range(len(ranks))]
        for batch in slices(batches, text_col):
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

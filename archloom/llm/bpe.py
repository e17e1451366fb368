"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank vocabulary.

Every byte is written as one printable character, every token of the vocabulary becomes a piece of such
characters whose score is its negative rank, and the normaliser is the identity. Pre-tokens (the matches of the
split pattern) are encoded one by one; decoding maps ids back to pieces and characters back to bytes.

Nothing is trained, and there are no special tokens. Null texts count as empty, empty texts have no ids. A text of
any length is read whole; repeated rows give repeated results; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archloom.llm.common import whole_text

#: Pre-tokens, and characters of them, whose ids a worker remembers, twice over at most beside those of one text; results
#: don't depend on them.
REMEMBERED, REMEMBERED_CHARACTERS = 200_000, 2_000_000

#: Stands for no byte.
SEPARATOR = chr(512)


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else the next free one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes by length, float as 32 bits, int as varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece i is the token of rank i; the unknown piece comes last and is never met."""
    characters = byte_characters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing}")
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(characters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))  # 1: normal
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))  # 2: unknown
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))  # model type 2: BPE
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class ByteBpe:
    """Encodes and decodes by a serialised model."""

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        characters = byte_characters()
        self.to_characters = {b: c for b, c in enumerate(characters)} | {255: SEPARATOR}  # no UTF-8 text has byte 255
        back = {c: b for b, c in enumerate(characters)}
        n = self.pieces.get_piece_size() - 1
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        self.whole = {name: i for i, name in enumerate(names)}
        self.bytes_of = [bytes(map(back.__getitem__, name)) for name in names]
        self.digits_of = [str(i) for i in range(n)]
        self.apart = n  # the id of the separator, which is the unknown piece
        self.unlike = {i for i, ids in enumerate(self.pieces.encode(names, num_threads=1)) if ids != [i]}
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.characters = 0  # of the young

    def _encode_new(self, tokens: list[str]) -> None:
        """Encode pre-tokens in one call, with a character between them that no piece has, and remember their ids."""
        written = b"\xff".join(map(str.encode, tokens)).decode("latin-1").translate(self.to_characters)
        ids, start = [*self.pieces.encode(written), self.apart], 0
        for token in tokens:
            end = ids.index(self.apart, start)
            self.young[token] = ids[start:end]
            start = end + 1
        if self.unlike:  # a pre-token that is in the vocabulary is its own id, even if no merges lead to it
            for token in tokens:
                if (own := self.whole.get(token.encode().decode("latin-1").translate(self.to_characters))) in self.unlike:
                    self.young[token] = [own]

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        found = list(map(self.young.get, tokens))
        if None in found:
            new = {t for t, ids in zip(tokens, found, strict=True) if ids is None}
            if len(self.young) + len(new) > REMEMBERED or self.characters + sum(map(len, new)) > REMEMBERED_CHARACTERS:
                self.old, self.young, self.characters = self.young, {}, 0
                new = set(tokens)
            self.characters += sum(map(len, new))
            self.young.update((t, ids) for t in new if (ids := self.old.get(t)) is not None)
            if new := [t for t in new if t not in self.young]:
                self._encode_new(new)
            found = map(self.young.__getitem__, tokens)
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, hash of the ids, hash of the bytes that the ids decode to."""
        ids = self.encode(text)
        listed = ",".join(map(self.digits_of.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


_loaded: dict[tuple[int, str], ByteBpe] = {}


def codec(model: bytes, pattern: str) -> ByteBpe:
    """One codec for each model in a process."""
    key = (hash(model), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBpe(model, pattern)
    return _loaded[key]


def _append(frame: DataFrame, source: str, fields: list[tuple[str, T.DataType, pa.DataType]], of, drop: tuple[str, ...] = ()) -> DataFrame:
    """Append columns made from one column; batches are cut so that their output stays small."""
    taken = ({n for n, _, _ in fields} | set(drop)) & set(frame.columns)
    schema = T.StructType([f for f in frame.schema.fields if f.name not in taken] + [T.StructField(n, t) for n, t, _ in fields])
    kept = [f.name for f in frame.schema.fields if f.name not in taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = of()
        for batch in batches:
            at = batch.schema.get_field_index(source)
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = [make(v.as_py()) for v in part.column(at)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in kept] + [pa.array([m[i] for m in made], t) for i, (_, _, t) in enumerate(fields)], names=kept + [n for n, _, _ in fields])

    return frame.mapInArrow(run, schema)


def encode_frame(docs: DataFrame, model: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids (array<int>); a column of that name is replaced."""
    return _append(docs, text, [(ids, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], lambda: lambda t, c=codec(model, pattern): (c.encode(t or ""),))


def decode_frame(encoded: DataFrame, model: bytes, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded with a column of the bytes its ids stand for; null ids count as none."""
    return _append(encoded, ids, [(decoded, T.BinaryType(), pa.binary())], lambda: lambda x, c=codec(model, pattern): (c.decode(x or []),))


def round_trip(docs: DataFrame, model: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text in one pass; only counts and hashes leave the worker, not the ids."""
    fields = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    narrow = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    return _append(narrow, "text", fields, lambda: codec(model, pattern).digests).drop("text")


_counters: dict[tuple[int, str], tiktoken.Encoding] = {}


def token_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """docs with the number of ids that `encode_frame` gives each text in place of the text; where only lengths are wanted.
    The tiktoken library counts them from the same ranks in a quarter of the time."""
    key, size = (hash(tuple(ranks.items())), pattern), pa.int64()

    def counter():
        if key not in _counters:
            _counters.clear()
            _counters[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = _counters[key].encode_ordinary
        return lambda t: (len(encode(t or "")),)

    return _append(docs, text, [(into, T.LongType(), size)], counter, drop=(text,))

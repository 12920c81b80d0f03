"""Byte-level BPE through sentencepiece: the rank file becomes a sentencepiece model, written field by field.

Every byte is shown to sentencepiece as one character, so that its character-level merges are byte merges; a piece's
score is its negative rank, so that the best-scored merge is the lowest-ranked one; the normaliser is the identity.
Piece numbers equal ranks. Text is cut by the pre-token pattern, each pre-token is encoded by itself, and decoding maps
ids back to pieces and pieces back to bytes.

Null texts count as empty; an empty text has no ids. Any text round-trips exactly, of any length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import regex
import sentencepiece
from pyspark.sql import DataFrame

from fanchart.llm.arrow import map_rows

# A byte's character is this number plus the byte: all are letters, none is white space or sentencepiece's own mark.
FIRST_CHARACTER = 0x100
# Ids of this many different chunks are kept per Python worker.
CACHED_CHUNKS = 1 << 19
# The code points of Unicode's White_Space property, which is what \s means in pre-token patterns.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Field numbers and kinds of the public sentencepiece model format.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _KIND = 1, 2, 3
_UNKNOWN = 2
_MODEL_TYPE, _BPE, _VOCABULARY_SIZE, _UNK_ID, _BOS_ID, _EOS_ID, _PAD_ID = 3, 2, 4, 40, 41, 42, 43
_NAME, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def as_characters(data: bytes) -> str:
    wide = bytearray(FIRST_CHARACTER.to_bytes(2, "little") * len(data))
    wide[0::2] = data
    return wide.decode("utf-16-le")


def as_bytes(characters: str) -> bytes:
    return bytes([ord(c) - FIRST_CHARACTER for c in characters])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; ranks must be gapless from 0. The unknown piece, which no byte ever needs, comes last."""
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be gapless from 0")
    pieces = [
        _block(_PIECES, _block(_PIECE, as_characters(token).encode()) + _varint(_SCORE << 3 | 5) + struct.pack("<f", -rank))
        for rank, token in enumerate(by_rank)
    ]
    pieces.append(_block(_PIECES, _block(_PIECE, b"<unk>") + _number(_KIND, _UNKNOWN)))
    trainer = _number(_MODEL_TYPE, _BPE) + _number(_VOCABULARY_SIZE, len(pieces)) + _number(_UNK_ID, len(by_rank))
    trainer += _number(_BOS_ID, -1) + _number(_EOS_ID, -1) + _number(_PAD_ID, -1)
    normalizer = _block(_NAME, b"identity") + _number(_DUMMY_PREFIX, 0) + _number(_EXTRA_SPACES, 0) + _number(_ESCAPE_SPACES, 0)
    return b"".join([*pieces, _block(_TRAINER, trainer), _block(_NORMALIZER, normalizer)])


class Tokenizer:
    """Encodes text to ids and ids to bytes with a serialised model and a pre-token pattern.

    Texts are first cut before every run of white space. No pre-token of the usual patterns goes on from other
    characters into white space, so that pre-tokens of a chunk are those of the text, and chunks can be remembered.
    """

    def __init__(self, model: bytes, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.processor.get_piece_size() - 1
        self.token_bytes = [as_bytes(self.processor.id_to_piece(i)) for i in range(size)]
        self.pretokens = regex.compile(pattern)
        self.chunks = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
        self.known: dict[str, list[int]] = {}
        # Tokens that the merges do not reach: as pre-tokens they still are that token.
        pieces = [self.processor.id_to_piece(i) for i in range(size)]
        merged = self.processor.encode(pieces, num_threads=1)
        self.unreached = {p: [i] for i, (p, ids) in enumerate(zip(pieces, merged)) if ids != [i]}

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text. Chunks not seen before go to sentencepiece in one call, which is costly to make."""
        known = self.known
        if len(known) > CACHED_CHUNKS:
            known.clear()
        cut = [self.chunks.findall(text) for text in texts]
        unseen = {c for chunks in cut for c in chunks if c not in known}
        if unseen:
            self._learn(list(unseen))
        for chunks in cut:
            yield list(chain.from_iterable(map(known.__getitem__, chunks)))

    def _learn(self, chunks: list[str]) -> None:
        parts = list(map(self.pretokens.findall, chunks))
        mapped = [as_characters(p.encode()) for part in parts for p in part]
        ids = iter(self.processor.encode(mapped, num_threads=1))
        if self.unreached:
            ids = iter([self.unreached.get(m, i) for m, i in zip(mapped, ids)])
        for chunk, part in zip(chunks, parts):
            self.known[chunk] = [i for _ in part for i in next(ids)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(model: bytes, pattern: str) -> Tokenizer:
    """One tokenizer per Python worker and model."""
    return Tokenizer(model, pattern)


def _shared_model(df: DataFrame, path: str):
    """The model as a broadcast: its size is that of the vocabulary file."""
    return df.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(path)))


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` array<int>."""
    model = _shared_model(df, path)

    def start():
        encode = tokenizer(model.value, pattern).encode_all
        return lambda texts: [(ids,) for ids in encode([t or "" for t in texts])]

    return map_rows(df, [text], {"ids": "array<int>"}, start, sliced=True)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` binary, from an array of ids; null ids give no bytes."""
    model = _shared_model(df, path)

    def start():
        decode = tokenizer(model.value, pattern).decode
        return lambda value: (decode(value or []),)

    return map_rows(df, [ids], {"decoded": "binary"}, start)


def token_digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 of each text: encode, then decode the ids, without moving them."""
    model = _shared_model(df, path)

    def start():
        own = tokenizer(model.value, pattern)
        decimal = [str(i) for i in range(len(own.token_bytes))]

        def digests(texts: list[str | None]) -> list[tuple]:
            rows = []
            for ids in own.encode_all([t or "" for t in texts]):
                shown = " ".join(map(decimal.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            return rows

        return digests

    outputs = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    return map_rows(df, [text], outputs, start, sliced=True)

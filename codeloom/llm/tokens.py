"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

The vocabulary (byte strings by rank) is written as a sentencepiece BPE model: each byte becomes a visible
character, each token a piece of such characters scored by its negative rank,
and nothing is normalised.  A text is cut into pre-tokens by the vocabulary's
pattern, each is encoded by the model, and ids are decoded by the inverse of the
byte mapping.  Merging the best-scored pair first is merging the lowest rank
first, so the ids are those of the vocabulary.

Defined results: a null and an empty text have no ids; strings of special tokens
are ordinary text; bytes that aren't UTF-8 are read as U+FFFD; texts of any
length are encoded whole.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import ship, spread

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts a text into pre-tokens for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE = 400_000  # pre-tokens whose ids a worker keeps


def byte_chars() -> list[str]:
    """A visible character for each byte: itself where it is printable, else the next above 255."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(printable))
    at = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}
    return [chr(at[b]) for b in range(256)]


def read_ranks(vocabulary: str | bytes) -> list[bytes]:
    """Tokens by rank of a vocabulary, a path or the file's content; ranks without gaps."""
    data = vocabulary if isinstance(vocabulary, bytes) else Path(vocabulary).read_bytes()
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """The tokens as a serialised sentencepiece model; the id after the last is its unknown piece.

    Fixed values: the numbers of the fields and enums of sentencepiece's public
    message format.
    """
    chars = byte_chars()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -rank) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2))
    bpe, size, unk = _field(3, 2), _field(4, len(tokens) + 1), _field(40, len(tokens))
    none = _varint(2**64 - 1)
    absent = b"".join(_varint(n << 3) + none for n in (41, 42, 43))
    out += _field(2, bpe + size + unk + absent)
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Encoder:
    """Texts to ids and back."""

    def __init__(self, vocabulary: str | bytes):
        import regex
        import sentencepiece

        tokens = read_ranks(vocabulary)
        self.size = len(tokens)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self._cut = regex.compile(PATTERN).findall
        chars = byte_chars()
        self._shown = {b: c for b, c in enumerate(chars) if chr(b) != c}
        self._byte = {c: b for b, c in enumerate(chars)}
        self._known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self._cut(t) if t else [] for t in texts]
        known = self._known
        new = {w for ws in cut for w in ws if w not in known}
        if new:
            if len(known) + len(new) > _CACHE:
                known.clear()
                new = {w for ws in cut for w in ws}
            words = list(new)
            shown = [w.encode("utf-8").decode("latin-1").translate(self._shown) for w in words]
            known.update(zip(words, self._model.encode(shown, num_threads=1)))
        return [list(chain.from_iterable(map(known.__getitem__, ws))) for ws in cut]

    def decode(self, ids: list[int]) -> str:
        pieces = "".join(map(self._model.id_to_piece, ids))
        return bytes(map(self._byte.__getitem__, pieces)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(vocabulary)


def shipped(spark: SparkSession, vocabulary: str) -> Broadcast:
    """The content of a vocabulary's file, read by the driver and sent to the executors (about a megabyte)."""
    return spark.sparkContext.broadcast(Path(vocabulary).read_bytes())


def _texts(b: pa.RecordBatch) -> list[str | None]:
    return [x if x is None else x.decode("utf-8", "replace") for x in b.column("text").to_pylist()]


def _slices(b: pa.RecordBatch, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of not much more than ``most`` bytes of text; no text is cut."""
    sizes = np.cumsum([0, *(len(x or b"") for x in b.column("text").to_pylist())])
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids): a narrow map over the documents; nothing is shuffled."""
    ship(documents.sparkSession)
    shared = shipped(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole):
                ids = encoder(shared.value).encode(_texts(b))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    src = documents.select(key, F.col(text).cast("binary").alias("text"))
    return spread(src).mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), vocabulary: str = BYTE_BPE_50K, check: bool = True) -> DataFrame:
    """(key, *keep, tokens, exact): number of ids, and whether decoding them gives the text back (null without ``check``)."""
    ship(documents.sparkSession)
    shared = shipped(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole):
                e, texts = encoder(shared.value), _texts(b)
                ids = e.encode(texts)
                same = [e.decode(i) == (t or "") if check else None for i, t in zip(ids, texts)]
                names = [n for n in b.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(list(map(len, ids)), pa.int64()), pa.array(same, pa.bool_())], names=[*names, "tokens", "exact"])

    src = documents.select(key, *keep, F.col(text).cast("binary").alias("text"))
    types = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in (key, *keep))
    return spread(src).mapInArrow(run, f"{types}, tokens long, exact boolean")

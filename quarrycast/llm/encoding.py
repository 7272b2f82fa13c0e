"""Encoding of texts with a byte-level BPE vocabulary through a sentencepiece model.

The vocabulary (a file of base64 tokens with their ranks) is serialised as a sentencepiece BPE model:
each token becomes a piece whose bytes are mapped to printable characters, with the negative rank as its
score, so that the best-scored merge is the lowest-ranked one. The normaliser is the identity. Texts are
cut into pre-tokens first, each pre-token is encoded alone, and ids equal ranks.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrycast.runtime import ship

#: Fixed value: the pattern that cuts text into pre-tokens for the rank files.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A file of ranks of a public tokenizer; a parameter of every function here.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEEP = 300_000  #: pre-tokens whose ids a worker remembers
LONGEST_KEPT = 64  #: characters of the longest pre-token that is remembered


def byte_map() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; one unknown piece follows them."""
    chars, tokens = byte_map(), sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2 ... without gaps")
    score = lambda s: _varint(2 << 3 | 5) + struct.pack("<f", s)
    out = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + score(-float(r))) for r, t in enumerate(tokens)]
    out.append(_field(1, _field(1, b"<unk>") + score(0.0) + _field(3, 2)))
    out.append(_field(2, _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))))  # BPE, its size, id of <unk>
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))  # no prefix, no trimming, no escapes
    return b"".join(out)


class Encoder:
    """Ids of texts by a model of model_bytes()."""

    def __init__(self, model: bytes, pattern: str = PRETOKEN):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.chars = byte_map()
        self.table = {b: c for b, c in enumerate(self.chars)}
        self.kept: dict[str, list[int]] = {}

    def _mapped(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.table)

    def encode(self, text: str | None) -> list[int]:
        """The ids of text; null and empty texts have the empty list."""
        out: list[int] = []
        if not text:
            return out
        kept, add = self.kept, out.extend
        for piece in self.cut(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.sp.encode(self._mapped(piece))
                if len(piece) <= LONGEST_KEPT:
                    if len(kept) >= KEEP:
                        kept.clear()
                    kept[piece] = ids
            add(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the pieces' characters mapped back to bytes."""
        back = {c: b for b, c in enumerate(self.chars)}
        return bytes(back[c] for i in ids for c in self.sp.id_to_piece(int(i))).decode("utf-8", "replace")


_held: tuple[bytes, Encoder] | None = None


def _encoder(model) -> Encoder:
    """The encoder of a broadcast model, made once in each worker."""
    global _held
    if _held is None or _held[0] != model.value:
        _held = model.value, Encoder(model.value)
    return _held[1]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids array<int>) of every row of df; one map over the rows, no shuffle.

    Null and empty texts have the empty list, never null. Repeated rows and null keys stay as they are;
    columns besides key and text don't matter. The model is broadcast: its size is that of the vocabulary.
    """
    spark = df.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(model_bytes(read_ranks(vocabulary)))
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model)
        for batch in batches:
            flat, ends = [], [0]
            for t in batch.column("t").to_pylist():
                flat.extend(enc.encode(t))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("k"), ids], ["k", "ids"])

    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(ids: Column, spark, vocabulary: str = BYTE_BPE_50K) -> Column:
    """The text of a column of id lists; null stays null, the empty list is the empty text."""
    model = spark.sparkContext.broadcast(model_bytes(read_ranks(vocabulary)))

    @F.pandas_udf("string")
    def back(lists):
        enc = _encoder(model)
        return lists.map(lambda x: None if x is None else enc.decode(list(x)))

    return back(ids)

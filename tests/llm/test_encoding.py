"""Encoding against another implementation, round trips, and the defined cases."""

import base64
import os
import random

import pytest

from quarrycast.llm import encoding
from tests.conftest import rows

VOCABULARY = encoding.BYTE_BPE_50K
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return encoding.Encoder(encoding.model_bytes(encoding.read_ranks(VOCABULARY)))


@pytest.fixture(scope="module")
def other():
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=encoding.PRETOKEN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    alphabet = "abc ABC  \n\t,.'’é中ना👩‍💻▁ĠÃ©12�\x00\x7f  "
    yield from ["", " ", "\n\n ", "don't we'll", "<|endoftext|> hi", "▁x ▁▁", "a" * 20_000, " " * 5_000, "नमस्ते 世界", "x\r\ny"]
    for _ in range(300):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80)))


def test_same_ids_and_round_trip(encoder, other):
    for t in texts():
        ids = encoder.encode(t)
        assert ids == other.encode_ordinary(t), t[:50]
        assert encoder.decode(ids) == t


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, "hello", 5, "k"), (1, "hello", 5, "k"), (2, "", None, None), (3, None, 1, "t"), (None, "a", 1, "t"), (4, "word " * 100_000, 1, "t")], "doc_id long, text string, ids int, k string")
    out = {(r.doc_id, tuple(r.ids[:3]), len(r.ids)) for r in encoding.encode(df).collect()}
    assert {(d, n) for d, _, n in out} >= {(2, 0), (3, 0)} and len(out) == 5
    assert encoding.encode(df).count() == 6 and encoding.encode(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert encoding.encode(df.where("false")).count() == 0


def test_decode_column(spark):
    df = spark.createDataFrame([(1, "héllo wörld"), (2, "")], "doc_id long, text string")
    ids = encoding.encode(df)
    assert rows(ids.select("doc_id", encoding.decode(ids["ids"], spark).alias("t"))) == [(1, "héllo wörld"), (2, "")]


def test_gaps_in_ranks():
    with pytest.raises(ValueError):
        encoding.model_bytes({b"a": 0, b"b": 2})

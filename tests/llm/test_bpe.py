"""Byte-level BPE against the library on whole texts, for chunk sizes that force many seams."""

import hashlib
import random

import public_tokenizers
import pytest

from scanloom.llm.bpe import codec, decode, encode
from scanloom.llm.queries import QUERIES
from tests.llm.support import docs_frame, write_documents

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
rng = random.Random(3)
ALPHABET = ["we'll ", "it's", "l'l", "  ", "\n", "\n\n ", "élan ", "日本", "123456", " 9", "!!", "'", "''ve", "abc", " x", "\t", "😀", " "]
ODD = [(1, ""), (2, None), (None, "null id"), (3, "a" * 3000), (4, " " * 3000), (5, "x " * 1500), (6, "same"), (6, "same"), (7, "'" * 900),
       (8, "word " * 40 + "z" * 500 + " tail" * 60), (8, "word " * 40 + "z" * 500 + " tail" * 60),
       *((100 + i, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 900)))) for i in range(25))]


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (200, 60), (16_384, 512)])
def test_equals_the_library_and_round_trips(spark, chunk, overlap):
    out = decode(encode(docs_frame(spark, ODD), RANKS, PATTERN, chunk, overlap), RANKS, PATTERN).collect()
    whole = codec(RANKS, PATTERN)
    want = sorted((i is not None, i or 0, whole.encode(t or ""), (t or "").encode()) for i, t in ODD)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"]), bytes(r["bytes"])) for r in out) == want


def test_query(spark, tmp_path):
    out = QUERIES["op2_byte_bpe"](spark, write_documents(spark, tmp_path, ODD)).collect()
    whole = codec(RANKS, PATTERN)
    want = sorted((len(whole.encode(t or "")) // 4, hashlib.sha256(whole.encode(t or "")).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for _, t in ODD)
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == want


def test_empty_table(spark, tmp_path):
    assert QUERIES["op2_byte_bpe"](spark, write_documents(spark, tmp_path, [])).collect() == []

"""Ids of the packing stage against the tokenizer as its file gives it."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from scanloom.llm.packing import WordEncoder
from scanloom.llm.queries import QUERIES
from tests.llm.support import prose, write_documents

rng = random.Random(5)


def test_ids_of_the_untouched_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "x<|startoftext|>Y <|ENDOFTEXT|> <|endoftext|", "H\u0331 T\u0308 J\u030c W\u030a Y\u030a h\u0331 E\u0301",
             "\u0130stanbul \u03a3\u03a3 Stra\u1e9ee \u1100\u1161\u11a8 \u0958", "It'S US'\u0301 A\u0308\u0331 I\x85H\u0331\xa0\u3000T\u0308 A\x1cB",
             " \u0331H \n\u0308<|endoftext|>\u0308", "Q" * 60 + "H\u0331<|endoftext|>", "", "x" * 5000, "\u00c9 \u00e9 Stra\u00dfe <|endoftext|>", prose(rng, 9000)]
    pool = ["H", "T", "a", "E", "\u0331", "\u0308", "\u0301", " ", "\n", "\x85", "\u00a0", "'", "S", "<|endoftext|>", "<|", "<", "|>", "7", "\u00c9", "\u212b"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    encoder = WordEncoder(path)
    for at in range(0, len(texts), 100):
        for text, got in zip(texts[at:at + 100], encoder.encode(texts[at:at + 100])):
            assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_query_gives_the_ids_of_the_untouched_tokenizer(spark, tmp_path):
    rows = [(1, "a <|endoftext|> b"), (2, "H\u0331 T\u0308 <|startoftext|>"), (3, "plain Text")]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())) for i, t in rows
            for ids in [[*tok.encode(t, add_special_tokens=False).ids, 1]]]
    out = QUERIES["op7_best_fit_packing"](spark, write_documents(spark, tmp_path, rows)).collect()
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in out) == want

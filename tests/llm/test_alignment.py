"""Alignment against a direct cut at common ends, counted over all documents."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from scanloom.llm import alignment
from scanloom.llm.queries import QUERIES
from tests.llm.support import docs_frame, prose, write_documents

rng = random.Random(12)
A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")

ROWS = [(1, None), (2, ""), (3, " "), (4, "naïve café — 東京 \U0001f600 <|endoftext|> </s> <s> <unk> <0x41>"), (5, "a▁b ▁"), (6, "x" * 3000),
        (7, "line one\nline two\r\n\ttabs   and   runs"), (7, "line one\nline two\r\n\ttabs   and   runs"), (None, "the the the the"),
        (8, "ﬁne ½   nb é"), (9, prose(rng, 20_000)), *((20 + i, prose(rng, rng.randrange(1, 60))) for i in range(60))]


def brute(rows):
    a_tok, b_tok = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    alphabet = {}
    spare = 256
    for byte in range(256):  # what a byte-level vocabulary prints for each byte
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            alphabet[chr(byte)] = byte
        else:
            alphabet[chr(spare)] = byte
            spare += 1
    found, counts = [], Counter()
    for doc, text in rows:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_tok.encode(text or "")
        a_bytes = [bytes(alphabet[c] for c in a_tok.id_to_token(i)) for i in a]
        pieces = [b_tok.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
        whole = b" " + (text or "").encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            found.append((doc, 0, 0, [], []))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted({*a_ends} & {*b_ends}):
            p, q = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append((a[i:p], b[j:q]))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        counts.update(links)
        found.append((doc, len(a), len(b), groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for doc, n_a, n_b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc or 0, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out)


def result(out):
    return sorted((r["doc_id"] or 0, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in out)


@pytest.mark.parametrize("links,chars", [(1 << 21, 1 << 20), (150, 40)])
def test_equals_direct_cuts(spark, tmp_path, monkeypatch, links, chars):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", links)
    monkeypatch.setattr(alignment, "BATCH_CHARS", chars)
    assert result(QUERIES["op12_alignment"](spark, write_documents(spark, tmp_path, ROWS)).collect()) == brute(ROWS)


def test_pointers():
    for _ in range(200):
        last = rng.randrange(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, last + 1), rng.randrange(0, last)), last})) for _ in range(2))
        ends = sorted({*a.tolist()} & {*b.tolist()})
        got = alignment.group_ends(a, b)
        assert [g.tolist() for g in got] == [np.searchsorted(ends, x).tolist() for x in (a, b)]


def test_empty_tables(spark, tmp_path):
    assert QUERIES["op12_alignment"](spark, write_documents(spark, tmp_path, [])).collect() == []
    assert result(QUERIES["op12_alignment"](spark, write_documents(spark, tmp_path, [(1, None), (2, "")])).collect()) == brute([(1, None), (2, "")])


def test_clashing_columns(spark):
    rows = [(1, "some words"), (2, "other words")]
    frame = docs_frame(spark, rows)
    for name in ("block", "pair", "links", "count", "n_a"):
        frame = frame.withColumn(name, alignment.F.lit("mine"))
    assert result(alignment.align(frame, A, B).collect()) == brute(rows)

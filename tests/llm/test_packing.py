"""Packing: ids as the library gives them, valid places, best fit against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from scanloom.llm import packing
from scanloom.llm.packing import best_fit_decreasing, pack
from scanloom.llm.queries import QUERIES
from tests.llm.support import prose, write_documents

rng = random.Random(4)
ROWS = [(1, None), (2, ""), (3, "x" * 5000), (4, "same Text, it's ok"), (4, "same Text, it's ok"), (None, "É é Straße <|endoftext|>"),
        (5, prose(rng, 9000)), *((10 + i, prose(rng, rng.randrange(1, 1500))) for i in range(60))]


def brute(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        if fit:
            min(fit, key=lambda b: b[0])[0] -= n
        else:
            bins.append([capacity - n])
    return sorted(b[0] for b in bins)


def test_tree_equals_linear_search():
    for seed in range(30):
        r = np.random.default_rng(seed)
        capacity = int(r.integers(5, 70))
        lengths = r.integers(1, capacity + 1, int(r.integers(1, 200)))
        bins, offsets = best_fit_decreasing(lengths, capacity)
        rest = [capacity - lengths[bins == b].sum() for b in range(bins.max() + 1)]
        assert sorted(rest) == brute(lengths.tolist(), capacity)
        for b in range(bins.max() + 1):
            order = np.argsort(offsets[bins == b])
            assert (np.cumsum(lengths[bins == b][order]) - lengths[bins == b][order] == offsets[bins == b][order]).all()


def check(out, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = np.asarray(ids[at:at + 4096], "<u4")
            want.append((i or 0, p, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins), -(-sum(w[3] for w in want) // 4096)


def test_query(spark, tmp_path):
    used, least = check(QUERIES["op7_best_fit_packing"](spark, write_documents(spark, tmp_path, ROWS)).collect(), ROWS)
    assert used <= least + 1


def test_empty_and_many_blocks(spark, tmp_path):
    assert QUERIES["op7_best_fit_packing"](spark, write_documents(spark, tmp_path, [])).collect() == []
    pieces = spark.range(3000).selectExpr("id as doc_id", "cast(id % 97 + 1 as long) as length", "'x' as offset")
    out = pack(pieces, 100, 20_000).toPandas()
    assert len(out) == 3000 and out.groupby("sequence_id").length.sum().max() <= 100
    assert out.sequence_id.nunique() <= 1.05 * out.length.sum() / 100 + 10


def test_many_short_pieces(spark, monkeypatch):
    """Empty texts: blocks are bounded by pieces as well."""
    monkeypatch.setattr(packing, "PIECES_PER_BLOCK", 1000)
    rows = spark.range(9000).selectExpr("id as doc_id", "0 as piece", "0L as start", "1L as length", "0L as ids_crc32")
    out = packing.pack(rows).collect()
    assert len(out) == 9000 and len({(r["sequence_id"], r["offset"]) for r in out}) == 9000
    assert len({r["sequence_id"] for r in out}) == 9

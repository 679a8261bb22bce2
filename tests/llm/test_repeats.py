"""Repeated byte strings and word windows against brute force, with hot anchors, periods, ties and odd rows."""

import hashlib
import random

import numpy as np
import pytest

from scanloom.llm import repeats
from scanloom.llm.queries import QUERIES
from scanloom.llm.repeats import leaders
from scanloom.llm.substring import repeated_windows
from scanloom.llm.suffix import common_prefixes, longest_previous_factors, repeated_suffixes, suffix_array
from tests.llm.support import prose, write_documents

rng = random.Random(8)
PASSAGE = prose(rng, 70)
ROWS = [(1, PASSAGE), (2, None), (3, ""), (4, "ab" * 400), (5, "x" * 99), (6, "x" * 101), (7, "a b " * 60), (9, "é" * 130), (9, "é" * 130),
        (None, prose(rng, 30) + PASSAGE), (None, PASSAGE[:250]), (11, PASSAGE + " " + PASSAGE), (12, "\0" * 150), (13, "\0" * 120 + "end"),
        (14, prose(rng, 5000, 30)),
        *((20 + i, prose(rng, rng.randrange(0, 60)) + " " + PASSAGE[rng.randrange(80):-rng.randrange(1, 80)] + " " + prose(rng, rng.randrange(0, 60)))
          for i in range(40))]


def brute(rows, width, split):
    """Per row (symbols, removed, spans, kept), rows in the order of the contract; equal rows are one document."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    from scanloom.llm.common import text_tag
    spark = SparkSession.getActiveSession()
    frame = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "n int, doc_id long, text string")
    tags = {r["n"]: r["tag"] for r in frame.select("n", text_tag().alias("tag")).collect()}
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, tags[n]))
    seen, out, last = set(), [], None
    for n in order:
        if (rows[n], tags[n]) == last:
            out.append(out[-1])
            continue
        last = (rows[n], tags[n])
        symbols = split(rows[n][1] or "")
        gone = [False] * len(symbols)
        for at in range(len(symbols) - width + 1):
            window = tuple(symbols[at:at + width])
            if window in seen:
                gone[at:at + width] = [True] * width
            seen.add(window)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((len(symbols), sum(gone), spans, [s for s, g in zip(symbols, gone) if not g]))
    return out


@pytest.fixture(params=["one pass", "small tiles and hot anchors"])
def limits(request, monkeypatch):
    if request.param != "one pass":
        for name, value in (("TILE", 256), ("FLUSH", 1500), ("BUCKET_ROWS", 3), ("BLOCK_BYTES", 4000)):
            monkeypatch.setattr(repeats, name, value)


def test_bytes(spark, tmp_path, limits):
    out = QUERIES["op4_suffix_dedup"](spark, write_documents(spark, tmp_path, ROWS)).collect()
    want = [(n, g, s, hashlib.sha256(bytes(k)).hexdigest()) for n, g, s, k in brute(ROWS, 100, str.encode)]
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == sorted(want)


def test_words(spark, tmp_path, limits):
    out = QUERIES["op8_substring_dedup"](spark, write_documents(spark, tmp_path, ROWS)).collect()
    want = [(n, g, hashlib.sha256(b" ".join(k)).hexdigest()) for n, g, _, k in brute(ROWS, 20, lambda t: t.encode().split())]
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == sorted(want)


@pytest.mark.parametrize("name", ["op4_suffix_dedup", "op8_substring_dedup"])
def test_empty_table(spark, tmp_path, name):
    assert QUERIES[name](spark, write_documents(spark, tmp_path, [])).collect() == []


def test_leaders_are_leftmost_least():
    for seed in range(20):
        r = np.random.default_rng(seed)
        grams, span = r.integers(0, 5, 60).astype(np.uint64), int(r.integers(1, 20))
        want = [i + int(np.argmin(grams[i:i + span])) for i in range(60 - span + 1)]
        assert leaders(grams, span)[:len(want)].tolist() == want


def test_longest_previous_factors():
    for seed in range(30):
        r = random.Random(seed)
        text = "".join(r.choice("ab") for _ in range(r.randrange(1, 40)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = lambda i, j: next((k for k, (x, y) in enumerate(zip(text[i:], text[j:])) if x != y), min(len(text) - i, len(text) - j))
        lcp = np.array([0, *(common(order[k - 1], order[k]) for k in range(1, len(order)))])
        want = [max((common(i, j) for j in range(i)), default=0) for i in order]
        assert longest_previous_factors(np.array(order), lcp).tolist() == want


def test_suffix_array_and_common_prefixes():
    for seed in range(40):
        r = random.Random(seed)
        depth = r.choice([7, 14, 50])
        text = [r.randrange(2) for _ in range(r.randrange(1, 90))] + ([0] * 60 if seed % 3 == 0 else [])
        order, levels = suffix_array(np.array(text), depth)
        deep = levels[-1][0]
        if deep < depth:
            deep = len(text)  # no ties were left
        assert order.tolist() == sorted(range(len(text)), key=lambda i: (text[i:i + deep], -i))
        common = lambda i, j: next((k for k, (x, y) in enumerate(zip(text[i:], text[j:])) if x != y), min(len(text) - i, len(text) - j))
        lcp = common_prefixes(np.array(text), order, levels)
        reach = levels[-1][0]  # equal as far as this counts as this, or more
        for got, want in zip(lcp[1:].tolist(), [common(order[k - 1], order[k]) for k in range(1, len(text))]):
            assert got == want or min(got, want) >= reach


@pytest.mark.parametrize("flags,join", [(repeated_suffixes, lambda s: bytes(s)), (repeated_windows, lambda s: b" ".join(b"%d" % x for x in s))])
def test_settling_a_bucket(flags, join):
    r = random.Random(2)
    lists = [[r.randrange(1, 3) for _ in range(r.randrange(6, 30))] for _ in range(40)]
    seen, want = set(), []
    for s in lists:
        for at in range(len(s) - 5):
            want.append(tuple(s[at:at + 6]) in seen)
            seen.add(tuple(s[at:at + 6]))
    assert flags([join(s) for s in lists], 6).tolist() == want

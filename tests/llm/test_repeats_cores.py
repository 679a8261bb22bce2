"""Halves of runs meet by anchor and core: what shares an anchor alone is done, and the exact step sees whole groups."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import repeats
from scanloom.llm.repeats import runs_of
from scanloom.llm.suffix import BYTES, WIDTH, common_prefixes, longest_previous_factors, repeated_suffixes, sorted_by, suffix_array
from scanloom.llm.substring import WORDS
from tests.llm.support import docs_frame

PHRASE = "of the people by the people for the people"


def noise(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def test_a_shared_anchor_alone_needs_no_settling(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_ROWS", 10)
    rng = random.Random(5)
    rows = [(n, noise(rng, 150) + PHRASE + noise(rng, 150)) for n in range(60)]
    ids = repeats.keyed(docs_frame(spark, rows)).select(F.col("__key").alias("key"), F.col("__tag").alias("tag"), "__text")
    runs = repeats._find_runs(ids, BYTES)
    assert runs.groupBy("anchor").count().filter("count > 10").count() > 0  # the phrase leads runs of all documents
    assert repeats._decided(runs).filter("end = 0 and not again").count() == 0
    assert repeats.repeated_stretches(docs_frame(spark, rows), BYTES).count() == 0


@pytest.mark.parametrize("copied", [99, 100, 101, 140])
def test_stretches_that_overlap_an_anchor_meet(spark, copied):
    rng = random.Random(copied)
    rows = []
    for n in range(30):  # the phrase lies at another place of the copied stretch each time
        left, right = noise(rng, copied), noise(rng, copied)
        whole = left + PHRASE + right
        at = rng.randrange(len(left))
        part = whole[at:at + copied]
        rows += [(10 * n, noise(rng, 60) + whole + noise(rng, 60)), (10 * n + 1, noise(rng, 130) + "1" + part + "2" + noise(rng, 130))]
    got = {r["key"]: r["spans"] for r in repeats.repeated_stretches(docs_frame(spark, rows), BYTES).collect()}
    seen, want = set(), {}
    for key, text in rows:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - WIDTH + 1):
            if data[p:p + WIDTH] in seen:
                gone[p:p + WIDTH] = True
            seen.add(data[p:p + WIDTH])
        if gone.any():
            want[key] = np.flatnonzero(gone).tolist()
    assert {k: sorted({i for s in spans for i in range(s["start"], s["end"])}) for k, spans in got.items()} == want
    assert len(want) == (30 if copied >= 100 else 0)


@pytest.mark.parametrize("unit,text", [(BYTES, "ab" * 100 + "the quick brown fox " * 20 + "x" * 300), (WORDS, "a b a b c d e f g " * 30)])
def test_equal_windows_have_equal_cores(unit, text):
    rng = random.Random(1)
    text = text + noise(rng, 50) + " " + text
    symbols = unit.split(text)
    values = unit.hashes(symbols)
    starts, windows, anchors, _, cores = runs_of(values, np.array([len(values)]), unit.width, unit.anchor)
    found, windows_seen = {}, 0
    for s, n, anchor, core in zip(starts.tolist(), windows.tolist(), anchors.tolist(), cores.tolist()):
        first = core & 0xFF
        assert 0 <= first <= n
        for at in range(s, s + n):
            one = at < s + first
            key = (anchor, one, core >> 36 if one else core >> 8 & (1 << 28) - 1)
            assert found.setdefault(unit.join(symbols[at:at + unit.width]), key) == key
            windows_seen += 1
    assert windows_seen == len(values) - unit.width + 1


def test_sorted_by_two_keys():
    r = np.random.default_rng(3)
    for most in (5, 1 << 40, 1 << 61):  # beside the row number, or as an order
        groups, inner = np.sort(r.integers(0, 3, 500)), r.integers(0, most, 500) // 3
        inner[::7] = inner[0]
        want = sorted(range(500), key=lambda i: (groups[i], inner[i]))
        order, head = sorted_by(groups, inner, most)
        assert order.tolist() == want
        pairs = [(groups[i], inner[i]) for i in want]
        assert head.tolist() == [True, *(a != b for a, b in zip(pairs[1:], pairs))]


def test_prefixes_below_the_least_count_as_none():
    for seed in range(20):
        r = random.Random(seed)
        text = np.array([r.randrange(2) for _ in range(r.randrange(1, 200))] + ([0] * 60 if seed % 2 else []))
        for width in (3, 10, 25):
            order, levels = suffix_array(text, width)
            whole = common_prefixes(text, order, levels)
            some = common_prefixes(text, order, levels, width)
            assert some.tolist() == np.where(whole >= width, whole, 0).tolist()
            assert ((longest_previous_factors(order, some) >= width) == (longest_previous_factors(order, whole) >= width)).all()


def test_blocks_are_cut_between_groups(spark):
    rng = random.Random(4)
    passages = [noise(rng, 200) for _ in range(20)]
    rows = [(n, noise(rng, rng.randrange(80)) + rng.choice(passages)[rng.randrange(90):] + noise(rng, rng.randrange(80))) for n in range(200)]
    got = [sorted((r["key"], sorted({i for s in r["spans"] for i in range(s["start"], s["end"])})) for r in repeats.repeated_stretches(docs_frame(spark, rows), replace(BYTES, block=b)).collect())
           for b in (1, 3000, 1 << 20)]
    assert got[0] == got[1] == got[2]
    assert len(got[0]) > 100


def test_settling_nothing():
    assert repeated_suffixes([], 100).tolist() == []

"""SimHash near duplicates against brute force over all pairs of fingerprints."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from scanloom.llm import simhash
from scanloom.llm.common import LOWEST
from scanloom.llm.queries import QUERIES
from tests.llm.support import docs_frame, prose, write_documents

rng = random.Random(13)


def mark(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def joined(pairs_of):
    """Least key of each fingerprint's component; ``pairs_of`` maps key to fingerprint."""
    items = sorted(pairs_of)
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for x, i in enumerate(items):
        for j in items[:x]:
            if (pairs_of[i] ^ pairs_of[j]).bit_count() <= 4:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in items}


def edited(text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def rows():
    base, other = prose(rng, 900, 10**6), prose(rng, 300, 10**6)
    out = [(1, ""), (2, None), (3, " \n "), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (None, base.upper()), (7, base), (7, base),
           (8, "é ü " * 40), (9, prose(rng, 30_000))]
    out += [(20 + i, edited(base, rng.randrange(0, 40))) for i in range(60)]
    out += [(100 + i, edited(other, rng.randrange(0, 9))) for i in range(30)]
    return out + [(200 + i, prose(rng, 40)) for i in range(60)]


@pytest.mark.parametrize("runs,pairs", [((512, 64, 8), 1 << 20), ((4, 2), 9), ((7,), 50)])
def test_index(monkeypatch, runs, pairs):
    """One index, searched below single top nodes and between two of them."""
    monkeypatch.setattr(simhash, "RUNS", runs)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    codes = sorted({(rng.getrandbits(3) * 0x1111111111111111) ^ sum(1 << b for b in rng.sample(range(64), 6)) for _ in range(90)})
    index = simhash.Index(np.array(codes, np.uint64), np.array([0, 30, 50]))
    index.search(np.arange(3), np.arange(3))
    index.search(np.array([0, 0, 1]), np.array([1, 2, 2]))
    want = joined(dict(enumerate(codes)))
    assert {frozenset(np.flatnonzero(index.label == k)) for k in set(index.label)} == {frozenset(i for i in want if want[i] == k) for k in set(want.values())}


@pytest.mark.parametrize("leaf,held", [(4096, 65_536), (3, 16)])
def test_equals_all_pairs(spark, tmp_path, monkeypatch, leaf, held):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    docs = rows()
    marks = [(LOWEST if i is None else i, mark(t)) for i, t in docs]
    of = {}
    for i, fp in marks:
        of.setdefault(fp, i)
        of[fp] = min(of[fp], i)
    component = joined({i: fp for fp, i in of.items()})
    monkeypatch.setattr(simhash, "HELD", held)
    out = QUERIES["op13_simhash_near_dedup"](spark, write_documents(spark, tmp_path, docs)).collect()
    low = lambda v: LOWEST if v is None else v
    assert sorted((low(r["doc_id"]), r["fingerprint"], low(r["component_id"])) for r in out) == \
        sorted((i, f"{fp:016x}", component[of[fp]]) for i, fp in marks)


@pytest.mark.parametrize("leaf,held", [(4096, 65_536), (5, 40)])
def test_dense_groups_of_fingerprints(spark, monkeypatch, leaf, held):
    """Fingerprints few bits apart, some groups wider than the distance, over many leaves of one top node."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "HELD", held)
    codes = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            code = centre
            for bit in rng.sample(range(64), rng.randrange(0, 8)):
                code ^= 1 << bit
            codes.add(code)
    codes |= {rng.getrandbits(64) for _ in range(100)}
    codes = sorted(codes)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame(list(zip(signed, range(len(codes)))), "fp long, key long").repartition(4)
    found = simhash.staged(simhash.leaves(distinct), "leaves")
    links = simhash.staged(simhash._exploded(found), "links")
    more = simhash.links_across(found, simhash.components(links))
    labels = {r["id"]: r["component"] for r in simhash.components(links.union(more)).collect()}
    want = joined(dict(enumerate(codes)))
    groups, got = {}, {}
    for i, root in want.items():
        groups.setdefault(root, set()).add(signed[i])
    for fp in signed:
        got.setdefault(labels.get(fp, fp), set()).add(fp)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))
    assert all((a ^ b) & (2**64 - 1) and ((a ^ b) & (2**64 - 1)).bit_count() <= 4 or want[signed.index(a)] == want[signed.index(b)]
               for a, b in ((r["a"], r["b"]) for r in links.union(more).collect()))


def test_empty_table(spark, tmp_path):
    assert QUERIES["op13_simhash_near_dedup"](spark, write_documents(spark, tmp_path, [])).collect() == []


def test_clashing_columns(spark):
    frame = docs_frame(spark, [(1, "a b c d e"), (2, "a b c d e")])
    for name in ("key", "fp", "component", "order", "block"):
        frame = frame.withColumn(name, simhash.F.lit("mine"))
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicate_report(frame).collect()) == [(1, 1), (2, 1)]

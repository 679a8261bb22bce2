"""Near duplicates against brute force over all pairs."""

import random

import pytest

from scanloom.llm import minhash
from scanloom.llm.common import LOWEST
from scanloom.llm.queries import QUERIES
from tests.llm.support import prose, write_documents

rng = random.Random(10)


def edited(text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def rows():
    base, other = prose(rng, 200), prose(rng, 400)
    out = [(1, ""), (2, None), (3, "one two"), (4, "ONE  two"), (5, "three"), (6, base), (6, base), (None, base.upper()), (7, " \n "), (9, "é " * 40)]
    out += [(20 + i, edited(base, rng.randrange(0, 9))) for i in range(40)]  # about 0.65 to 1 with each other
    out += [(100 + i, prose(rng, 60) + " " + other[:600] + " " + prose(rng, 60)) for i in range(30)]  # a shared passage
    chain = prose(rng, 300).split()
    out += [(200 + i, " ".join(chain[i * 18:i * 18 + 150])) for i in range(8)]  # linked only with their neighbours
    return out


def test_heavily_edited_copies(spark, tmp_path):
    """Copies of one base, many of them farther apart than the threshold: chains decide."""
    base = prose(rng, 120, 10**6)
    docs = [(i, edited(base, rng.randrange(0, 7))) for i in rng.sample(range(1000), 150)]
    assert result(QUERIES["op10_minhash_near_dedup"](spark, write_documents(spark, tmp_path, docs)).collect()) == brute(docs)


def brute(docs):
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((LOWEST if i is None else i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def result(out):
    low = lambda v: LOWEST if v is None else v
    return sorted((low(r["doc_id"]), r["n_shingles"], low(r["component_id"]), r["kept"]) for r in out)


@pytest.mark.parametrize("block,part,chunk", [(512, 65_536, 2048), (3, 7, 4)])
def test_equals_all_pairs(spark, tmp_path, monkeypatch, block, part, chunk):
    for name, value in (("BLOCK", block), ("PART", part), ("CHUNK", chunk)):
        monkeypatch.setattr(minhash, name, value)
    docs = rows()
    assert result(QUERIES["op10_minhash_near_dedup"](spark, write_documents(spark, tmp_path, docs)).collect()) == brute(docs)


def test_empty_table(spark, tmp_path):
    assert QUERIES["op10_minhash_near_dedup"](spark, write_documents(spark, tmp_path, [])).collect() == []


def test_components_of_long_paths(spark):
    path = list(range(40))
    rng.shuffle(path)
    links = spark.createDataFrame([*zip(path, path[1:]), (100, 101)], "a long, b long")
    assert {(r["id"], r["component"]) for r in minhash.components(links).collect()} == {*((i, 0) for i in path), (100, 100), (101, 100)}


def test_one_of_each(spark, tmp_path):
    docs = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "z"), (4, "z")]
    frame = spark.read.parquet(write_documents(spark, tmp_path, docs) + "/documents.parquet")
    kept = minhash.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "a b c d e f"), (3, None), (4, "z")]

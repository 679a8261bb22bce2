"""The language model against a direct computation, its normalisation, and its gain on held-out texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from scanloom.llm import lm
from scanloom.llm.queries import QUERIES
from tests.llm.support import prose, write_documents

rng = random.Random(5)
ROWS = [(1, None), (2, ""), (3, "The the THE"), (3, "The the THE"), (None, "w1 w2 w3"), (4, "unseen words only"), (5, "a " * 700), (6, "a " * 700),
        *((10 + i, prose(rng, rng.randrange(1, 200), 60)) for i in range(60))]


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def direct(rows):
    train = [tokens(t) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    pairs = Counter(p for t in train for p in zip(["begin", *t], t))
    context, followers, before = Counter(), defaultdict(Counter), Counter()
    for (a, b), c in pairs.items():
        context[a] += c
        followers[a][min(c, 3)] += 1
        before[b] += 1
    d = lm.discounts(*(sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)))
    e = lm.discounts(*(sum(c == k for c in before.values()) for k in (1, 2, 3, 4)))
    count = Counter(w for t in train for w in t)
    total, v, types = sum(count.values()), len(count), len(pairs)
    rest = sum(e[min(c, 3)] for c in before.values()) / types

    def p(a, b):
        low = max(before[b] - e[min(before[b], 3)], 0) / types + rest / (v + 1)
        if not context[a]:
            return low
        back = sum(d[k] * n for k, n in followers[a].items()) / context[a]
        return max(pairs[a, b] - d[min(pairs[a, b], 3)], 0) / context[a] + back * low
    out = []
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (v + 1))) for w in ws)
        out.append((i or 0, len(ws), sum(count[w] > 0 for w in ws), total, round(base, 6), round(sum(math.log10(p(a, b)) for a, b in zip(["begin", *ws], ws)), 6)))
    return sorted(out), p, count, context


@pytest.mark.parametrize("flush", [1 << 20, 50])
def test_equals_direct_computation(spark, tmp_path, monkeypatch, flush):
    monkeypatch.setattr(lm, "FLUSH", flush)
    out = QUERIES["op5_lm_scoring"](spark, write_documents(spark, tmp_path, ROWS)).collect()
    want, *_ = direct(ROWS)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in out) == want
    assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 10 == 0) for r in out)


def test_shards_follow_the_size_of_the_texts(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{write_documents(spark, tmp_path, ROWS)}/documents.parquet")
    few = lm.train(docs)
    monkeypatch.setattr(lm, "SHARD_BYTES", 500)
    many = lm.train(docs)
    size = sum(len((t or "").encode()) for _, t in ROWS)
    assert (few.pair_shards, many.pair_shards) == (lm.FEWEST_SHARDS, -(-size // 500))
    assert (few.types, few.tokens, few.vocabulary) == (many.types, many.tokens, many.vocabulary)
    assert [r["score"] for r in lm.score(docs, few).orderBy("doc_id", "score").collect()] == [r["score"] for r in lm.score(docs, many).orderBy("doc_id", "score").collect()]


def test_probabilities_sum_to_one():
    _, p, count, context = direct(ROWS)
    for a in ["begin", "never seen", *list(context)[:20]]:
        assert abs(sum(p(a, b) for b in [*count, "unknown"]) - 1) < 1e-9


def test_better_than_the_base_on_held_out_texts(spark):
    out = QUERIES["op5_lm_scoring"](spark, "/root/testdata/sf0.001").toPandas()
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_empty_table_and_nothing_to_learn_from(spark, tmp_path):
    assert QUERIES["op5_lm_scoring"](spark, write_documents(spark, tmp_path / "a", [])).collect() == []
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = QUERIES["op5_lm_scoring"](spark, write_documents(spark, tmp_path / "b", [(alone, "x y")])).first()
    assert (row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (0, 0, 0.0, 0.0)

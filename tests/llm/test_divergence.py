"""Source divergence against a direct count with whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scanloom.llm import divergence
from scanloom.llm.queries import ORACLES, QUERIES

rng = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    words = [f"{a}{b}" for a in ("été", "Wort", "plain", "Ünï", "ﬁ") for b in "abcdefgh"] + ["東京", "naïve"]
    out = []
    for i in range(300):
        lang, source = rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "ü", "S1", None])
        text = " ".join(rng.choice(words).upper() if rng.random() < .2 else rng.choice(words) for _ in range(rng.randrange(0, 60)))
        out.append((i, rng.choice([text.replace(" ", "-9_"), text, text, None]), lang, source, 0))
    out += [(400, "lonely words here", "fr", "s1", 0), (401, None, "fr", "s2", 0), (402, "", "fr", "s3", 0)]
    out += [(500, out[0][1], "en", "s1", 0), (500, out[0][1], "en", "s1", 0), (501, "planet " * 20_000, "en", "long", 0)]
    return out


def brute(data, least):
    terms = lambda t: [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in data:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        df[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
        counts[lang, None].update(terms(text))
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]

        def share(s):
            total = sum(counts[lang, s][t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[lang, s][t] + 5) // (total + 5 * len(kept)) for t in kept}
        p, q = share(source), share(None)
        pairs = [(-sum(abs(p[t] - other[t]) for t in kept), s.encode()) for g, s in groups if g == lang and s != source for other in [share(s)]]
        best = [(q[t] - p[t], t.encode()) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:50])):
            out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def result(frame):
    assert dict(frame.dtypes)["rank"] == "int" and dict(frame.dtypes)["value"] == "bigint"
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in frame.collect())


@pytest.mark.parametrize("small", [False, True])
def test_equals_direct_counts(spark, tmp_path, monkeypatch, small):
    if small:  # many shards, passes, flushes and blocks of sources
        for name, value in (("SHARD", 4), ("BROADCAST_BYTES", 200), ("CELLS", 6), ("HELD_TERMS", 5), ("SOURCES", 2), ("TOP", 50)):
            monkeypatch.setattr(divergence, name, value)
    data = rows()
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert result(QUERIES["op11_divergence"](spark, str(tmp_path))) == brute(data, 30)


def test_top_with_ties(spark):
    """More terms than are ranked, many with equal values."""
    data = [(i, " ".join(f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(140) if (k + i) % (2 + i % 3)), "en", f"s{i % 3}", 0) for i in range(90)]
    assert result(divergence.audit(spark.createDataFrame(data, SCHEMA), 5)) == brute(data, 5)


def test_empty_tables(spark):
    assert result(divergence.audit(spark.createDataFrame([], SCHEMA))) == []
    data = [(1, None, None, None, 0), (2, "a", "en", "x", 0), (3, "a", "en", "y", 0)]
    assert result(divergence.audit(spark.createDataFrame(data, SCHEMA))) == brute(data, 30)


def test_clashing_columns(spark):
    data = rows()[:80]
    frame = spark.createDataFrame(data, SCHEMA)
    for name in ("term", "shard", "number", "value", "slots"):
        frame = frame.withColumn(name, divergence.F.lit("mine"))
    assert result(divergence.audit(frame, 3)) == brute(data, 3)


def test_perfect_hash():
    for n in (1, 2, 3, 7, 100, 5000):
        keys = [f"key{i}".encode() for i in range(n)]
        made = divergence.PerfectHash.build(keys)
        assert sorted(made.find(keys, divergence.term_hashes(keys)).tolist()) == list(range(n))
        others = [f"other{i}".encode() for i in range(500)]
        assert (made.find(others, divergence.term_hashes(others)) == -1).all()


def test_shares_of_large_counts():
    counts = np.array([9 * 10**14, 1, 123_456_789_012_345], np.int64)
    total, v = int(counts.sum()), 3
    _, p = divergence.shares(np.arange(3, dtype="<i4").tobytes(), counts.tobytes(), 3, total, v)
    assert p.tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * v) for c in counts]


def test_has_sql():
    assert "op11_divergence" in ORACLES

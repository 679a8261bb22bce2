"""The registered fuzzy match takes every word of every document."""

import difflib
import re

from scanloom.plans import QUERIES


def test_all_words_are_matched(spark, tmp_path):
    texts = ["alpha betamax\tgammaray", "delta", None, "", "  Betamaxx\nnothing gamaray  alpha", "epsilon, " + "z" * 4000,
             "delta  deltas omicron omikron", "betamax omicronn"]
    known = ["alpha betamax", "gammaray! delta", "omicron omicrom", None, "epsilon"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(known)], "bench_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gids = sorted({g for t in known if t for g in re.split(r"\W+", t.lower()) if g})
    want = {}
    for word in {w for t in texts if t for w in t.lower().split()}:
        close = difflib.get_close_matches(word, gids, n=len(gids), cutoff=0.8)
        if len(close) == 1:
            want[word] = close[0]
    rows = QUERIES["J15_fuzzy_lab_match"](spark, str(tmp_path)).collect()
    assert {r.lab_id: r.gid for r in rows} == want and len(rows) == len(want)
    assert {"betamax", "gamaray", "epsilon,"} <= set(want)

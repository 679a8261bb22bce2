"""The pipeline's stages against brute force, each on its own input, and their registration."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
import tests.llm.test_packing
from scanloom.llm.queries import ORACLES, QUERIES
from tests.llm.support import docs_frame, prose
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered_queries():
    assert [n for n in (f"op{k}_" for k in range(1, 11)) if not any(q.startswith(n) for q in entry.queries())] == []
    assert "pipeline" in entry.queries() and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_equals_oracle(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == COLUMNS
            assert (docs.toPandas().n_chars == docs.toPandas().text.str.len()).all()
    ids = [set(f.doc_id) for f in seen.values()]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert ids[2] == ids[3] == ids[4]  # the last two stages drop no document
    packed = seen["packing"].groupby("sequence_id").length.sum()
    assert packed.max() <= 4096


def test_near_duplicates_and_passages_take_effect(spark):
    rng = random.Random(1)
    one, passage = prose(rng, 100, 10**6), prose(rng, 40, 10**6)
    rows = [(1, one), (2, one + " end"), (3, prose(rng, 60, 10**6) + " " + passage), (4, passage + " " + prose(rng, 60, 10**6))]
    left = corpus_pipeline.near_dedup(spark, docs_frame(spark, rows), SF)
    assert {r["doc_id"] for r in left.collect()} == {1, 3, 4}
    less = {r["doc_id"]: r for r in corpus_pipeline.substring_dedup(spark, left, SF).collect()}
    assert less[1]["text"] == one and less[3]["text"] == rows[2][1]  # untouched texts stay as they are
    assert less[4]["text"].split() == rows[3][1].split()[40:] and less[4]["n_chars"] == len(less[4]["text"])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_odd_and_empty_rows(spark, stage):
    for rows in ([], [(1, None), (2, ""), (None, "x y z"), (5, "é " * 300), (5, "é " * 300)]):
        docs = docs_frame(spark, rows).selectExpr("*", "1 as score", "'k' as kept")
        out = stage(spark, docs, SF)
        assert out.count() <= max(1, len(rows))
        if stage is not corpus_pipeline.packing:
            assert out.columns == docs.columns


CLASHING = {"kept": "mine", "n_words": "seven", "score": "high", "cleaned": "c", "n_removed": "r", "carried": "struct", "__key": "k", "__tag": "t", "__text": "x", "key": "y", "n": "z"}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_callers_columns_keep_their_values(spark, stage):
    rng = random.Random(2)
    sentences = lambda: " ".join(f"{prose(rng, 9, 10**6)}.".replace("\n", " ") for _ in range(12))
    rows = [(1, sentences()), (2, sentences() + " " + sentences()), (3, sentences() * 400)]
    docs = docs_frame(spark, rows).withColumns({c: F.lit(v) for c, v in CLASHING.items()})
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    found = out.collect()
    assert found and all(r[c] == v for r in found for c, v in CLASHING.items()) and {r["lang"] for r in found} == {"en"}


def test_packing_stage_equals_the_query(spark):
    """Pieces of the stage are those of the tokenizer, each document whole."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(0, 300))) for i in range(40)] + [(90, prose(rng, 9000)), (91, None)]
    out = corpus_pipeline.packing(spark, docs_frame(spark, rows), SF).collect()
    packed = tests.llm.test_packing.check(out, rows)
    assert packed[0] <= packed[1] + 2


def test_quality_stage_equals_the_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r["doc_id"]: r for r in QUERIES["op3_quality_rules"](spark, SF).collect()}
    left = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    assert left == {i for i, r in judged.items() if r["kept"]}


def test_toxicity_stage_equals_the_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = {r["doc_id"]: r["score"] for r in QUERIES["op9_toxicity"](spark, SF).collect()}
    left = {r["doc_id"] for r in corpus_pipeline.toxicity(spark, docs, SF).select("doc_id").collect()}
    assert left == {i for i, s in scored.items() if s < corpus_pipeline.TOXIC_FROM}

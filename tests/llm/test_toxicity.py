"""Toxicity: held-out accuracy, misspellings, labels of the held-out fold unread, odd rows."""

import random
import zlib

import numpy as np
import pytest

from scanloom.llm import toxicity
from scanloom.llm.queries import QUERIES
from scanloom.llm.toxicity import WordScores, document_scores, subwords, train
from tests.llm.support import prose, write_documents

rng = random.Random(9)
BAD = ["blockhead", "nitwit", "dimwit", "scoundrel"]


def toxic(words):
    out = prose(rng, words).split()
    for _ in range(2):
        out.insert(rng.randrange(len(out)), rng.choice(BAD))
    return " ".join(out)


@pytest.fixture(scope="module")
def model():
    texts = [prose(rng, rng.randrange(20, 300)) for _ in range(150)] + [toxic(rng.randrange(20, 300)) for _ in range(100)]
    return train(texts, [0] * 150 + [1] * 100)


def scores(model, texts):
    line, bias = model.direction()
    return document_scores(texts, WordScores(line), bias)


def test_unseen_texts_and_misspellings(model):
    assert (scores(model, [toxic(400) for _ in range(40)]) > 0.5).mean() > 0.95
    assert (scores(model, [prose(rng, 400) for _ in range(40)]) < 0.5).mean() > 0.95
    clean, odd = scores(model, [prose(rng, 30)])[0], scores(model, [prose(rng, 15) + " blockheadd nitwitt " + prose(rng, 15)])[0]
    assert odd > clean


def test_subwords_are_those_of_each_word():
    grams, sizes = subwords([b"abc", b"", b"abcd."])
    assert sizes.tolist() == [3 + 2 + 1 + 1, 0 + 1, 4 + 3 + 2 + 1]
    again, _ = subwords([b"abcd"])
    assert grams[8:].tolist() == again.tolist()


def test_one_label_only_and_nothing():
    assert scores(train(["a b"], [1]), ["x", ""]).tolist() == pytest.approx([0.75] * 2)
    assert scores(train([], []), ["x"]).tolist() == [0.5]


def test_query(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "no id")]
    rows += [(10 + i, toxic(100) if i % 3 == 0 else prose(rng, 100)) for i in range(240)]
    folder = write_documents(spark, tmp_path, rows)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    # held-out labels are wrong on purpose: read, they would spoil the model
    labels = [(10 + i, 1, int((i % 3 == 0) == (fold(10 + i) != 0))) for i in range(240)] + [(None, 1, 1), (11, 0, None), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = QUERIES["op9_toxicity"](spark, folder).collect()
    assert len(out) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    by = {r["doc_id"]: r for r in out}
    right = [by[10 + i]["predicted"] == (i % 3 == 0) for i in range(240) if fold(10 + i) == 0]
    assert by[10]["held_out"] == (fold(10) == 0) and np.mean(right) > 0.9


def test_empty_tables(spark, tmp_path):
    folder = write_documents(spark, tmp_path, [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert QUERIES["op9_toxicity"](spark, folder).collect() == []


def test_sample_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC_SAMPLE", 3)
    monkeypatch.setattr(toxicity, "CLEAN_SAMPLE", 4)
    got = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: got.update(texts=texts, labels=labels))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    assert sorted(got["labels"]) == [0] * 4 + [1] * 3

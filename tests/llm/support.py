"""Small tables and brute-force helpers for the training-data operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows, schema=DOCS):
    """A documents table of (doc_id, text) rows."""
    full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def prose(rng: random.Random, words: int, lexicon: int = 400) -> str:
    return " ".join(f"w{rng.randrange(lexicon)}{rng.choice(['', '', '', ',', '.', chr(10)])}" for _ in range(words))


def write_documents(spark, folder, rows):
    docs_frame(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)

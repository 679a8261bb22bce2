"""The corpus pipeline: toxicity, quality rules, near duplicates, repeated passages, packing.

Each stage is (name, function of (spark, docs, sf_dir)); it works on all that the stage before it kept, and its
decisions take effect. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import staged
from scanloom.llm.minhash import one_of_each
from scanloom.llm.packing import pack, tokenised_pieces
from scanloom.llm.quality import quality_rules
from scanloom.llm.substring import drop_repeated_words
from scanloom.llm.toxicity import fit, score

TOXIC_FROM = 0.5


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one struct, which no operator's own columns can overwrite."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(_others(docs)))).alias("carried"))


def _returned(rows: DataFrame, docs: DataFrame, made=None) -> DataFrame:
    """The columns of ``docs`` as they came, with another text (and its length) where one is ``made``."""
    own = {c: F.col(f"carried.c{n}") for n, c in enumerate(_others(docs))} | {"doc_id": F.col("doc_id"), "text": F.col("text") if made is None else made}
    if made is not None and "n_chars" in own:
        own["n_chars"] = F.length(made).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(own[c].alias(c) for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic passage scores TOXIC_FROM or more go; the others keep all their columns.

    Null and empty texts are scored like any other; repeated rows are judged alike.
    """
    model = fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _returned(score(_carried(docs), model).filter(F.col("score") < TOXIC_FROM), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; documents that the rules reject go, empty and null texts among them. Other columns stay."""
    judged = quality_rules(_carried(docs)).filter("kept")
    return _returned(judged, docs, F.col("cleaned"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates stays, and of rows equal in id and text one; empty texts all stay."""
    return _returned(one_of_each(_carried(docs)), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that start earlier go; a document without such keeps its text as it is, null too."""
    less = drop_repeated_words(_carried(docs), ["doc_id", "text", "carried"])
    return _returned(less, docs, F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, as pieces with their place in sequences of 4096 tokens; null texts are the end id."""
    pieces = tokenised_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("toxicity", toxicity), ("quality rules", quality), ("near dedup", near_dedup),
          ("substring dedup", substring_dedup), ("packing", packing)]

ORACLE_SQL = None  # a trained classifier and a tokenizer have no SQL; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

"""Toxicity by subword-bag embeddings, averaged over passages into a linear softmax; trained jointly in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import arrow_map, tail_bucket

BUCKETS, DIM = 1 << 17, 8
GRAMS = (3, 4, 5)  # bytes of a subword, taken from <word>
PASSAGE = 8  # words averaged into one vector; scoring moves on by half a passage
TOXIC_SAMPLE, CLEAN_SAMPLE, SAMPLE_CHARS = 1000, 1500, 65_536  # bounds of the training sample: rows by label, length of a text
FOLDS = 5  # labels of fold 0 are held out
ROUNDS, RATE = 100, 2.0
SIGNIFICANT = 4.0  # standard errors below which a subword starts at zero
CACHED_WORDS = 1_000_000
EDGE = b".,;:!?\"'()[]{}|*%&#$<>-"

_scores: dict[int, dict] = {}


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, subwords of each word): byte n-grams of <word> and the word itself."""
    framed = [b"<" + (w.strip(EDGE) or w) + b">" for w in words]
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    text = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(framed)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at, base = np.arange(len(text)), np.uint64(0x100000001B3)
    found, owners, rolled = [], [], np.zeros(len(text), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolled = rolled[:len(text) - n + 1] * base + text[n - 1:]
        if n in GRAMS:
            fits = at[:len(rolled)] + n <= ends[:len(rolled)]
            found.append(rolled[fits] + np.uint64(n))
            owners.append(owner[:len(rolled)][fits])
    whole = np.fromiter((hash_of(w) for w in framed), np.uint64, len(framed))
    found, owners = np.concatenate([*found, whole]), np.concatenate([*owners, np.arange(len(framed))])
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    buckets = (found >> np.uint64(40)).astype(np.int64) % BUCKETS
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=len(framed))


def hash_of(word: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(word)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each range, in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Model:
    embeddings: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def direction(self) -> tuple[np.ndarray, float]:
        """The softmax of two classes is a sigmoid of one difference, linear in the averaged embeddings."""
        return (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Embeddings and softmax, trained together by gradient descent on each document's highest passage.

    Starts from how significantly a subword's documents differ by label, so the first choice of passages is
    informed; steps follow the summed errors, so subwords of few documents stay near their start.
    """
    rng = np.random.default_rng(seed)
    split = [words_of(t) for t in texts]
    kept = [i for i, w in enumerate(split) if w]
    split, y = [split[i] for i in kept], np.array([labels[i] for i in kept], np.int64)
    model = Model(rng.normal(0, 0.01, (BUCKETS, DIM)), rng.normal(0, 0.01, (DIM, 2)), np.zeros(2))
    if not len(y) or y.min() == y.max():  # one class only: its share is the score
        model.weights[:] = 0
        model.bias[1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
        return model
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
    spelled = list(vocabulary)
    parts = [subwords(spelled[at:at + 8192]) for at in range(0, len(spelled), 8192)]
    grams, per_word = np.concatenate([g.astype(np.int32) for g, _ in parts]), np.concatenate([n for _, n in parts])
    del parts
    first = np.cumsum(per_word) - per_word
    words = np.fromiter((vocabulary[w] for ws in split for w in ws), np.int64)
    doc_sizes = np.array([len(ws) for ws in split])
    pieces = -(-doc_sizes // PASSAGE)
    passage_doc = np.repeat(np.arange(len(split)), pieces)
    number = _ragged(np.zeros(len(split), np.int64), pieces)
    passage_start = np.repeat(np.cumsum(doc_sizes) - doc_sizes, pieces) + number * PASSAGE
    passage_size = np.minimum(PASSAGE, np.repeat(doc_sizes, pieces) - number * PASSAGE)
    passage_first = np.cumsum(pieces) - pieces

    seen = np.zeros((2, BUCKETS))
    for doc, start in enumerate(np.cumsum(doc_sizes) - doc_sizes):
        own = np.unique(words[start:start + doc_sizes[doc]])
        seen[y[doc], np.unique(grams[_ragged(first[own], per_word[own])])] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    rate0, rate1, rate = seen[0] / n0, seen[1] / n1, (seen.sum(0) + 1) / (len(y) + 2)
    z = (rate1 - rate0) / np.sqrt(rate * (1 - rate) * (1 / n0 + 1 / n1))
    model.embeddings[:, 0], model.weights[0] = np.sign(z) * np.maximum(np.abs(z) - SIGNIFICANT, 0), (-0.5, 0.5)
    share = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    for _ in range(ROUNDS):
        line, _ = model.direction()
        score = np.add.reduceat(line[grams], first)
        total = np.add.reduceat(score[words], passage_start) / np.add.reduceat(per_word[words], passage_start)
        best = np.lexsort((-total, passage_doc))[passage_first]
        chosen = words[_ragged(passage_start[best], passage_size[best])]
        bag = grams[_ragged(first[chosen], per_word[chosen])]
        doc_of = np.repeat(np.repeat(np.arange(len(best)), passage_size[best]), per_word[chosen])
        count = np.bincount(doc_of, minlength=len(best))
        mean = np.stack([np.bincount(doc_of, model.embeddings[bag, d], len(best)) for d in range(DIM)], 1) / count[:, None]
        logits = mean @ model.weights + model.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        off = (p - np.eye(2)[y]) * share[:, None]
        back = off @ model.weights.T * RATE * PASSAGE
        model.weights -= RATE * (mean.T @ off)
        model.bias -= RATE * off.sum(0)
        for d in range(DIM):
            model.embeddings[:, d] -= np.bincount(bag, back[doc_of, d], BUCKETS)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of labelled rows, drawn by a hash of the id; labels of fold 0 are never read.

    At most TOXIC_SAMPLE + CLEAN_SAMPLE documents of at most SAMPLE_CHARS characters reach the driver.
    """
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (tail_bucket("doc_id", FOLDS) != 0))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("__draw", F.xxhash64("doc_id", F.lit(5))))
    short = docs.filter(F.length("text") <= SAMPLE_CHARS).select("doc_id")
    known = known.join(short.distinct(), "doc_id", "left_semi")
    drawn = [r for toxic, n in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE))
             for r in known.filter(F.col("toxic") == toxic).orderBy("__draw", "doc_id").limit(n).collect()]
    label = {r["doc_id"]: r["toxic"] for r in drawn}
    few = docs.sparkSession.createDataFrame([(i,) for i in label], "doc_id long")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id", "left_semi")
            .filter(F.length("text") <= SAMPLE_CHARS).dropDuplicates(["doc_id"]).collect())
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [label[r["doc_id"]] for r in rows])


class WordScores(dict):
    """word -> summed subword scores + 1j * number of subwords."""

    def __init__(self, line: np.ndarray):
        super().__init__()
        self.line = line

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            new = list(words)
        if new:
            grams, sizes = subwords(new)
            sums = np.add.reduceat(self.line[grams].astype(np.float64), np.cumsum(sizes) - sizes)
            self.update(zip(new, (sums + 1j * sizes).tolist()))


def document_scores(texts: list[str | None], known: WordScores, bias: float) -> np.ndarray:
    """The highest passage's probability of label 1; a text without words has the bias alone."""
    split = [words_of(t) for t in texts]
    known.learn(set().union(*split))
    out = np.zeros(len(texts))
    for i, words in enumerate(split):
        if words:
            sums = np.concatenate([[0], np.cumsum(np.fromiter(map(known.__getitem__, words), np.complex128, len(words)))])
            starts = np.arange(0, max(1, len(words) - PASSAGE // 2), PASSAGE // 2)
            part = sums[np.minimum(starts + PASSAGE, len(words))] - sums[starts]
            out[i] = (part.real / part.imag).max()
    return 1 / (1 + np.exp(-(out + bias)))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) of ``docs`` with ``score``: every row, whole texts, nulls as empty.

    A document's score is that of its most toxic passage, so length does not dilute it.
    """
    line, bias = model.direction()
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    key = hash((line.tobytes(), bias))

    def step(batch: pa.RecordBatch):
        known = _scores.get(key)
        if known is None:
            _scores.clear()
            known = _scores[key] = WordScores(line)
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            made = pa.array(document_scores(part.column(text).to_pylist(), known, bias))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made], [*keep, "score"])
    # the text travels once: as itself where it is kept
    text = "text" if "text" in keep and docs.schema["text"].dataType.simpleString() == "string" else "__text"
    read = docs.select(*keep, *([] if text in keep else [F.col("text").cast("string").alias(text)]))
    return arrow_map(read, step, read.select(*keep, F.lit(0.0).alias("score")).schema)

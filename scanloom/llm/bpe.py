"""Byte-level BPE over overlapping chunks: pre-tokenise, stitch where boundaries agree, encode, decode."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import arrow_map

CHUNK, OVERLAP = 16_384, 512  # characters
MARGIN = 8  # a match that ends so far before a chunk's end does not depend on what follows the chunk

_codecs: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """Encoding by a rank file; each match of ``pattern`` (without look-behind) is encoded by itself."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.tokens[i] for i in memoryview(ids).cast("I")])

    def boundaries(self, text: str, last: bool, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
        """Pre-token ends within the head overlap, and trusted ones within the tail overlap (both from 0)."""
        head, tail, trusted = [0], [], len(text) if last else len(text) - MARGIN
        for match in self.pattern.finditer(text):
            end = match.end()
            if end < overlap:
                head.append(end)
            if chunk <= end <= trusted:
                tail.append(end - chunk)
        return head, tail


def codec(ranks_path: str, pattern: str) -> Codec:
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def _pre_tokenised(chunks: DataFrame, ranks: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    def step(batch: pa.RecordBatch):
        names, last = batch.schema.names, batch.column("__last").to_pylist()
        found = [codec(ranks, pattern).boundaries(t, end, chunk, overlap) for t, end in zip(batch.column("__part").to_pylist(), last)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([h for h, _ in found], pa.list_(pa.int32())), pa.array([t for _, t in found], pa.list_(pa.int32()))],
            [*names, "__head", "__tail"])
    return arrow_map(chunks, step, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema) + ", __head array<int>, __tail array<int>")


def _mapped(df: DataFrame, source: str, target: str, kind: pa.DataType, turn) -> DataFrame:
    """``df`` with column ``source`` replaced by ``target`` = turn(value)."""
    rest = [c for c in df.columns if c not in (source, target)]

    def step(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            made = pa.array([turn(v) for v in part.column(source).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), made], [*rest, target])
    df = df.select(*rest, source)
    return arrow_map(df, step, df.select(*rest, F.lit(None).cast("binary").alias(target)).schema)


def encode(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): ids of the whole text as little-endian uint32, one row per row of ``docs``.

    Texts beyond one chunk are cut into chunks of ``chunk`` characters that overlap by ``overlap``, spread over the
    cluster and pre-tokenised. A seam is closed at the first boundary both neighbours agree on: the left one is
    right up to there, and the pattern looks only forward, so the right one is from there on. From the first seam
    without such a boundary (a run longer than the overlap) the rest of that text is one piece. Pieces are encoded
    by themselves; their ids in order are the text's. Null is the empty text; repeated rows are encoded each.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    size = F.length("__text")
    turn = lambda t: codec(ranks, pattern).encode(t)
    short = _mapped(texts.filter(size <= chunk + overlap), "__text", "ids", pa.binary(), turn)

    def cut(batch: pa.RecordBatch):
        for doc, tag, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "__tag", "__text"))):
            starts = range(0, len(text) - overlap, chunk)
            for number, start in enumerate(starts):
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": [doc], "__tag": [tag], "__chunk": [number], "__last": [number == len(starts) - 1],
                     "__part": [text[start:start + chunk + overlap]]},
                    pa.schema([("doc_id", pa.int64()), ("__tag", pa.int64()), ("__chunk", pa.int32()), ("__last", pa.bool_()), ("__part", pa.string())]))

    chunks = arrow_map(texts.filter(size > chunk + overlap).withColumn("__tag", F.xxhash64("__text")), cut,
                       "doc_id long, __tag long, __chunk int, __last boolean, __part string")
    chunks = _pre_tokenised(chunks.repartition("doc_id", "__tag", "__chunk"), ranks, pattern, chunk, overlap)
    row = ["doc_id", "__tag", "__copy"]
    in_order = Window.partitionBy(*row).orderBy("__chunk")
    seams = (chunks.withColumn("__copy", F.row_number().over(Window.partitionBy("doc_id", "__tag", "__chunk").orderBy("__last")))
             .withColumn("__sync", F.when(F.col("__chunk") == 0, 0).otherwise(
                 F.array_min(F.array_intersect(F.lag("__tail").over(in_order), "__head"))))
             .withColumn("__open", F.min(F.col("__sync").isNotNull()).over(in_order))
             .withColumn("__run", F.sum(F.col("__open").cast("int")).over(in_order))
             .withColumn("__next", F.lead("__open").over(in_order))
             .withColumn("__until", F.lead("__sync").over(in_order)))
    begin = F.when(F.col("__open"), F.col("__sync")).otherwise(0)
    end = F.when(F.col("__last"), F.length("__part")).when(F.col("__next"), chunk + F.col("__until")).otherwise(chunk)
    own = seams.select(*row, "__run", "__chunk", F.substring(F.col("__part"), begin + 1, end - begin).alias("__own"))
    pieces = (own.groupBy(*row, "__run").agg(F.sort_array(F.collect_list(F.struct("__chunk", "__own"))).alias("__parts"))
              .select(*row, "__run", F.array_join("__parts.__own", "").alias("__piece")))
    encoded = _mapped(pieces, "__piece", "__ids", pa.binary(), turn)
    whole = (encoded.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("__run", "__ids"))).alias("__all"))
             .select("doc_id", F.unhex(F.array_join(F.transform("__all", lambda piece: F.hex(piece["__ids"])), "")).alias("ids")))
    return short.unionByName(whole)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded`` with ``bytes``, the tokens' raw bytes in a row (not always valid UTF-8 by parts, so not a string)."""
    kept = encoded.withColumn("__ids", F.col("ids"))
    return _mapped(kept, "__ids", "bytes", pa.binary(), lambda ids: codec(ranks, pattern).decode(ids or b""))

"""The registered queries of the training-data operators, with DuckDB twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from scanloom.llm import lm
from scanloom.llm.alignment import align
from scanloom.llm.bpe import decode, encode
from scanloom.llm.common import documents, tail_bucket
from scanloom.llm.divergence import audit
from scanloom.llm.knn import scaled_vectors, top_k
from scanloom.llm.minhash import near_duplicate_report
from scanloom.llm.packing import pack, tokenised_pieces
from scanloom.llm.quality import quality_rules
from scanloom.llm.sharding import shard_rows
from scanloom.llm.simhash import near_duplicate_report as simhash_report
from scanloom.llm.substring import drop_repeated_words
from scanloom.llm.suffix import drop_repeated_bytes
from scanloom.llm.toxicity import FOLDS, fit, score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: each shard is a uniform sample without replacement; equal texts are independent rows."""
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))
    return shard_rows(rows, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return decode(ids, ranks, public_tokenizers.PATTERN).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenised_pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, ["doc_id"]).select(
        "doc_id", (tail_bucket("doc_id", FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_quality_rules", r"""
    with words as (
        select doc_id, coalesce(text, '') as t, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as w
        from documents),
    windows as (select doc_id, p, w[p:p + 2] as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as p from words)),
    repeated as (
        select doc_id, count(distinct p + o) as n
        from (select doc_id, p, count(*) over (partition by doc_id, k) as c from windows), (values (0), (1), (2)) as v(o) where c > 1 group by doc_id),
    lines as (
        select doc_id, line, [x for x in regexp_split_to_array(line, '[\x20\x09-\x0D]+') if x <> ''] as w
        from (select doc_id, unnest(string_split(t, chr(10))) as line from words)),
    judged as (
        select doc_id, line, length(array_to_string(w, '')) as chars,
               not regexp_matches(line, '[.!?…。]["''”»)\]]*([\x20\x09-\x0D]|$)') or len(regexp_extract_all(line, '[!?]{2,}')) * 5 > len(w)
               or len(regexp_extract_all(line, '[|»›•]')) * 10 > len(w) or len(regexp_extract_all(line, '[#*$%&<>]')) * 5 > len(w)
               or len(w) <= 20 and regexp_matches(lower(line), 'all rights reserved|licensed under|released under the|cookie (policy|settings)|privacy policy|terms of (use|service)|enable javascript|lorem ipsum')
               as fails
        from lines where len(w) > 0),
    by_doc as (
        select doc_id, count(*) - count(distinct line) as dup, coalesce(sum(chars) filter (fails), 0) as lost from judged group by doc_id),
    base as (
        select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
               coalesce(dup, 0) as n_dup_lines, coalesce(n, 0) as n_repeat_words, coalesce(lost, 0) as lost,
               len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) as base_failed
        from words left join repeated using (doc_id) left join by_doc using (doc_id))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and 100 * lost <= 30 * word_chars as kept
    from base""")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "cleaned")


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(documents(spark, sf_dir), ["doc_id"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_substring_dedup", r"""
    with words as (
        select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
    windows as (
        select doc_id, p, array_to_string(w[p:p + 19], ' ') as s
        from (select doc_id, w, unnest(range(1, len(w) - 18)) as p from words)),
    ranked as (select doc_id, p, row_number() over (partition by s order by doc_id, p) as n from windows),
    gone as (select distinct doc_id, unnest(range(p, p + 20)) as p from ranked where n > 1),
    kept as (
        select doc_id, string_agg(word, ' ' order by p) as t
        from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words) anti join gone using (doc_id, p) group by doc_id)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
    from words left join (select doc_id, count(*) as n from gone group by doc_id) using (doc_id) left join kept using (doc_id)""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_words(documents(spark, sf_dir), ["doc_id"]).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_minhash_near_dedup", r"""
    with recursive words as (
        select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[\x20\x09-\x0D]+') if x <> ''] as w
        from documents),
    shingles as (
        select distinct doc_id, array_to_string(w[p:p + 4], ' ') as s
        from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) as p from words)),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b using (s) where a.doc_id <> b.doc_id group by all),
    links as (
        select a, b from shared join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)),
    reached(doc_id, r) as (select a, b from links union select reached.doc_id, b from reached join links on r = a)
    select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id, doc_id <= coalesce(m, doc_id) as kept
    from words left join sizes using (doc_id) left join (select doc_id, min(r) as m from reached group by doc_id) using (doc_id)""")
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_report(documents(spark, sf_dir))


@query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = tail_bucket("doc_id", 10) == 0
    model = lm.train(docs.filter(~held_out))
    return lm.score(docs, model, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op6_voronoi_top_k", """
    with v as (
        select vec_id, [floor(1024 * cast(x as double)) for x in embedding] as e from embeddings
        where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    scored as (
        select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.e, v.e) as bigint) as score
        from v as q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0)
    select query_id, cast(rank as integer) as rank, vec_id, score
    from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 10""")
def op6_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, F.col("vec_id") % 100 == 0, 10)


@query("op11_divergence", r"""
    with docs as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t from documents),
    words as (
        select rid, lang, source, translate(unnest(regexp_extract_all(t, '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')),
                                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs),
    kept as (select lang, term from words group by all having count(distinct rid) >= 30),
    v as (select lang, count(*) as v from kept group by all),
    groups as (select distinct lang, source from docs),
    sides as (select lang, source, false as whole from groups union all select distinct lang, '', true from groups),
    counted as (
        select lang, source, false as whole, term, count(*) as c from words join kept using (lang, term) group by all
        union all select lang, '', true, term, count(*) from words join kept using (lang, term) group by all),
    totals as (select lang, source, whole, sum(c) as n from counted group by all),
    shares as (
        select s.lang, s.source, s.whole, k.term, coalesce(c, 0) as c,
               cast(1 + (1000000000::hugeint * (coalesce(c, 0) + 5)) // (coalesce(n, 0) + 5 * v) as bigint) as p
        from sides s join kept k on s.lang = k.lang join v on v.lang = s.lang
        left join counted x on x.lang = s.lang and x.source = s.source and x.whole = s.whole and x.term = k.term
        left join totals t on t.lang = s.lang and t.source = s.source and t.whole = s.whole),
    pairs as (
        select a.lang, a.source, b.source as item,
               coalesce((select sum(abs(x.p - y.p)) from shares x join shares y on x.lang = y.lang and x.term = y.term
                         where not x.whole and not y.whole and x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
        from groups a join groups b on a.lang = b.lang and a.source <> b.source),
    best as (
        select x.lang, x.source, x.term as item, x.p - y.p as value
        from shares x join shares y on x.lang = y.lang and x.term = y.term and y.whole where not x.whole and x.c > 0 and x.p > y.p),
    ranked as (
        select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
        union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from best)
    select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 50""")
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_simhash_near_dedup")
def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_report(documents(spark, sf_dir))


QUERIES["pipeline"] = corpus_pipeline.run

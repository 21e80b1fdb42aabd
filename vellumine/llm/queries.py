"""The operators' queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    embedding_dedup,
    exact_dedup,
    html_extract,
    language_id,
    mixing,
    neighbours,
    periodic_runs,
    phrases,
    sentencepiece_viterbi,
    sharding,
    simhash,
    token_counts,
    token_store,
)
from .common import ASCII_WORD, table

BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
#: Bytes of a shard of the query; sharding.LIMIT, a file's usual size, would leave its small tables whole.
SHARD_BYTES = 1 << 20


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that the sentencepiece library gives with the public BPE model, by Viterbi over the
    paths that the model's merges allow; and whether decoding them gives the text again."""
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_viterbi.encode(docs, public_tokenizers.path(PIECES), ["doc_id"])


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.assign_shards(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)
    return shards.select("doc_id", "n_bytes", "depth", "shard", "shard_bytes")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth document by crc32 of its id the words from some word on repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(rf"({ASCII_WORD})"), F.lit(1))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (F.floor(h / 10)).alias("g"), (h % 10 == 0).alias("chosen"))
    rows = rows.withColumn("w", F.when(F.col("chosen"), words)).withColumn("n", F.size("w").cast("long"))
    a = F.expr("g % n")
    p = F.expr(f"1 + (n - g % n) div (3 + g % 8)")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.when(F.col("n") > 0, p))
    planted = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as length, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.length")).alias("length"),
        F.col("best.period").alias("period"), F.expr("(-best.length * 1000) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (
        op1_html_extract, op2_simhash, op3_exact_dedup, op4_mixing, op5_embedding_dedup,
        op6_language_id, op7_sentencepiece, op8_sharding, op9_token_store, op10_token_counts,
        op11_phrases, op12_nearest, op13_periodic_runs,
    )
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)

"""One query for each operator over its whole table, and SQL where it can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dac, embed, media, media_fixture, ngram_join, packing, pii, quality, sharding, substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


@query("op7_sharding", sharding.oracle("documents", "doc_id", "doc_id, text, lang, source, n_chars"))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.laid_out(table(spark, sf_dir, "documents"), "doc_id")


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, field).drop("text")


@query("op6_ngram_jaccard", ngram_join.oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(table(spark, sf_dir, "documents"))


@query("op10_substring", substring.oracle())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query("op1_token_codes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.tokenise(table(spark, sf_dir, "documents"))


@query("op1_random_access", "SELECT doc_id, TRUE AS exact FROM documents WHERE text IS NOT NULL")
def op1_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.random_access(table(spark, sf_dir, "documents"))


@query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # the decoder gets the ids and a digest, not the texts again
    back = bpe.decode(coded.select("doc_id", "token_ids", F.sha1("text").alias("digest")))
    return back.select("doc_id", "token_ids", F.size("token_ids").cast("bigint").alias("n_tokens"), F.sha1("decoded").eqNullSafe(F.col("digest")).alias("round_trip"))


@query("op8_round_trip", "SELECT doc_id, md5(text) AS digest FROM documents")
def op8_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return back.select("doc_id", F.md5(F.col("decoded").cast("binary")).alias("digest"))


@query("op3_embedding_near_duplicates", embed.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_links(table(spark, sf_dir, "embeddings"))


@query("op3_planted_copies", embed.oracle(embed.COPIES))
def op3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_links(embed.with_copies(table(spark, sf_dir, "embeddings")))


@query("op4_media_clips")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.clips(media_fixture.film(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id", "media")

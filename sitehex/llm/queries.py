"""The registered queries of this package: each operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitehex.llm import (
    chat,
    decontamination,
    fingerprint,
    html_text,
    langid,
    ngram_join,
    packing,
    periodic_runs,
    secret_scan,
    sharding,
    toxicity,
    url_filters,
    whitening,
)
from sitehex.llm.common import fold_of, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 3) == 1
    model = langid.train(documents.where(~held_out))
    return langid.predict(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words")


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.next_and_edited(read(spark, sf_dir, "documents"))


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return secret_scan.scan(documents, secret_scan.train(documents))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = fold_of("doc_id", 4) == 2
    model = toxicity.train(documents, labels.where(~held_out))
    return toxicity.score(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op7_chat_preferences", chat.PREFERENCE_SQL)
def op7_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = chat.format_pairs(chat.pairs_from_conversations(read(spark, sf_dir, "conversations")))
    return formatted.withColumns({side: chat.told(side) for side in ("chosen_parts", "rejected_parts")})


@query("op9_sharding", sharding.SHARD_SQL)
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(read(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op4_ngram_jaccard_join", ngram_join.JACCARD_SQL)
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(read(spark, sf_dir, "documents")).drop("text_hash", "component")


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op11_url_filters", url_filters.URL_SQL)
def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(read(spark, sf_dir, "pages"))


def repeat_from_a_place(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten by its id: from some word on, the words repeat with some period. A null id leaves all as they are."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    unit = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[: n - a]


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(read(spark, sf_dir, "documents"), edit=repeat_from_a_place)


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))

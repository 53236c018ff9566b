"""One query per operator over its whole table, and its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from insight_spark.llm import decontaminate, html_extract, language_id, lm_score, pattern_packing, preference, quality_model, quality_rules, secret_scan, simhash, simple8b, spelling, token_alignment
from insight_spark.llm.common import crc_bucket
from insight_spark.session import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


@_query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load_table(spark, sf_dir, "documents"))


@_query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLES["op9_quality_rules"] = quality_rules.oracle()


@_query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(load_table(spark, sf_dir, "documents")))


def quality_classifier(spark: SparkSession, sf_dir: str) -> quality_model.Model:
    """Learned from the labels of ids whose crc32 modulo 5 is not 0."""
    return quality_model.train(
        load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"), crc_bucket("doc_id", 5) != 0
    )


@_query("op8_quality_model")
def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.score(load_table(spark, sf_dir, "documents"), quality_classifier(spark, sf_dir))
    return scored.select(
        "doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@_query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    pieces = language_id.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    held_out = crc_bucket("doc_id", 3) == 1
    model = language_id.train(docs, pieces, ~held_out)
    found = language_id.predict(docs, model, pieces)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query("op2_pattern_packing")
def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pattern_packing.pack_documents(
        load_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query("op7_simple8b")
def op7_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = simple8b.round_trip(
        load_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))


@_query("op5_preference")
def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against its echo: the last answer replaced by what the assistant was just told."""
    turns = load_table(spark, sf_dir, "conversations")
    names = ("conv_id", "turn", "role", "text")
    return preference.format_pairs(turns, preference.echo_rejections(turns, *names), *names)


ORACLES["op5_preference"] = preference.ORACLE


@_query("op6_lm_score")
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good. Background: all documents."""
    docs = load_table(spark, sf_dir, "documents")
    good = load_table(spark, sf_dir, "labels").filter("quality = 1")
    models = lm_score.train(lm_score.mark_target(docs.select("doc_id", "text"), good), F.col("_target"))
    return lm_score.score(docs, models)


@_query("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(load_table(spark, sf_dir, "documents"), "text", "doc_id")
    return spelling.variants(spelling.vocabulary(found.select(spelling.misspell("doc_id").alias("run"))))


@_query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(
        load_table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
    )


@_query("op13_html_extract")
def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load_table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages)).select("page_id", "url", "text", "n_chars")

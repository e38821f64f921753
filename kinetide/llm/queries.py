"""Registered queries of the corpus operators and their SQL twins."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinetide.llm.common import table
from kinetide.llm.golay import simhash_classes
from kinetide.llm.language import identify_languages
from kinetide.llm.lm import score_texts
from kinetide.llm.mixing import mix_sources
from kinetide.llm.ngram_join import jaccard_classes
from kinetide.llm.oracle import ORACLE as ORACLE
from kinetide.llm.packing import pack_documents
from kinetide.llm.quality import quality
from kinetide.llm.ranked_search import search
from kinetide.llm.runs import periodic_runs
from kinetide.llm.secret_scan import scan_secrets
from kinetide.llm.surrogates import replace_entities
from kinetide.llm.topk import top_k
from kinetide.llm.warc import archive_round_trip


def op1_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op3_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op6_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op8_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op9_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op10_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op11_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


def op12_lcp_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), repeat_some=True).drop("runs", "collapsed")


def op13_shared_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secret_guess_cost, op2_chunked_warc, op3_swap_packing, op4_surrogates, op5_ngram_jaccard, op6_hash_threshold_mix, op7_tokeniser_fertility, op8_branch_and_bound, op9_log_bilinear, op10_ftrl_language,
        op11_golay_simhash, op12_lcp_runs, op13_shared_term_search,
    )
}

"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import (
    exact, fim, langid, linedup, mixing, neardup, packing, quality, rules, search, secretscan, sharding, warc)
from ledgerline.llm.common import cut
from ledgerline.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=16)


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read_table(spark, sf_dir, "documents"))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_documents(read_table(spark, sf_dir, "documents"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"), min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return rules.judge(read_table(spark, sf_dir, "documents"), trusted)


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read_table(spark, sf_dir, "documents"))


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(read_table(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linedup.drop_common_lines(read_table(spark, sf_dir, "documents"), least=10, min_chars=1)
    return cut(kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build_index(read_table(spark, sf_dir, "documents"))
    return search.search(index, read_table(spark, sf_dir, "benchmark"), k=10)


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(read_table(spark, sf_dir, "documents"), seed=1, plain_from=90, spm_below=20)
    return cut(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                           F.sha2("output", 256).alias("output_sha256"),
                           F.sha2(fim.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")))


ORACLES["op3_exact_dedup"] = exact.ORACLE
ORACLES["op7_warc"] = warc.ORACLE
ORACLES["op11_line_dedup"] = linedup.ORACLE
ORACLES["op12_ranked_search"] = search.ORACLE
ORACLES["op13_fill_in_middle"] = fim.ORACLE

"""The registered queries of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import decontaminate, html_extract, language_id, license_scan, lm_score, mixing, shared_search, simhash, spelling_variants, substring_dedup, token_files, topk_search, url_lists, url_queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents"))


@query
def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.evaluate(url_queries.captures(pages), url_queries.entries(pages))


ORACLE["op2_url_lists"] = url_queries.oracle()


@query
def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


ORACLE["op3_topk_search"] = topk_search.oracle()


@query
def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).drop("text_key")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = mixing.standard(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return told.withColumns({c: F.round(c, 6) for c in ("mix_probability", "mix_weight")})


ORACLE["op6_mixing"] = f"SELECT * REPLACE (round(mix_probability, 6) AS mix_probability, round(mix_weight, 6) AS mix_weight) FROM ({mixing.oracle()})"


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.kept_words(table(spark, sf_dir, "documents")))


ORACLE["op7_substring_dedup"] = substring_dedup.oracle()


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).drop("text_key")


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


ORACLE["op10_license_scan"] = license_scan.oracle()


@query
def op11_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_key")


ORACLE["op11_shared_search"] = shared_search.oracle()


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))

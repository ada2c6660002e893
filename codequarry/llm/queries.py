"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(table(spark, sf_dir, "documents"))


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import place

    shards = [f"shard-{k:03d}" for k in range(64)]
    return place(table(spark, sf_dir, "documents"), shards).select("doc_id", "slot", "shard")


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import report

    return report(table(spark, sf_dir, "documents"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join

    return join(table(spark, sf_dir, "documents"))


@query
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(table(spark, sf_dir, "documents"))


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def _oracles() -> None:
    from . import audit, centroids, decontaminate, jaccard, topk

    ORACLE_SQL["op12_filter_audit"] = audit.ORACLE
    ORACLE_SQL["op13_centroids"] = centroids.oracle()

    ORACLE_SQL["op6_jaccard_join"] = jaccard.ORACLE
    ORACLE_SQL["op7_topk"] = topk.ORACLE
    ORACLE_SQL["op4_decontamination"] = decontaminate.ORACLE


_oracles()

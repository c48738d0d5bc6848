"""The registered queries of this subpackage, each over the whole of its tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc, bpe, jaccard, metricjoin, mpegts, packing, pst, quality, repeats, urlrules

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.converted(arc.page_archives(_table(spark, sf_dir, "pages"))).drop("offset")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlrules.filtered(_table(spark, sf_dir, "pages"))
    return found.withColumn("rules", F.concat_ws(",", F.col("rules").cast("array<string>")))


def op5_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(_table(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.scored(_table(spark, sf_dir, "documents"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metricjoin.near_classes(_table(spark, sf_dir, "embeddings"))


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.elementary_units(mpegts.text_streams(_table(spark, sf_dir, "documents")))


def op9_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality, op2_arc_to_warc, op3_repeated_passages, op4_url_rules, op5_near_pairs, op6_suffix_tree_scores, op7_near_vectors, op8_transport_streams, op9_packed_sequences, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    return {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "sql").glob("*.sql"))} | {"op4_url_rules": urlrules.sql()}

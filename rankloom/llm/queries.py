"""Queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from .matching import match_records

    return match_records(_read(spark, d, "papers_with_duplicates")).select("rec_a", "rec_b")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .topn import best_items

    return best_items(_read(spark, d, "predictions"))


def _survivors(spark: SparkSession, d: str, policy: str) -> DataFrame:
    from .components import record_groups
    from .survivor import survivors

    records = _read(spark, d, "papers_with_duplicates")
    groups = record_groups(_read(spark, d, "paper_matches"), records)
    return survivors(records, groups, _read(spark, d, "source_trust"), policy)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d, "priority")


def p3_votes(spark: SparkSession, d: str) -> DataFrame:
    """The survivors if the sums of votes decide before the fixed order."""
    return _survivors(spark, d, "votes")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from .format_dups import format_copies

    return format_copies(_read(spark, d, "papers_with_duplicates"), _read(spark, d, "predictions"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from .names import variant_pairs

    return variant_pairs(_read(spark, d, "papers_with_duplicates"), _read(spark, d, "given_names"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from .components import record_groups

    return record_groups(_read(spark, d, "paper_matches"), _read(spark, d, "papers_with_duplicates"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from .tokens import encode_corpus

    return encode_corpus(_read(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    from .containers import pack
    from .tokens import count_tokens

    return pack(count_tokens(_read(spark, d, "documents")))


def p9_exchange(spark: SparkSession, d: str) -> DataFrame:
    """The same in small partitions, so that those with gaps exchange documents: (documents, containers, least) in all.

    ``least`` is the number of containers that the tokens would fill to the brim.
    """
    from .containers import pack
    from .tokens import count_tokens

    packed = pack(count_tokens(_read(spark, d, "documents")), part_items=500)
    whole = F.ceil(F.sum("size") / F.lit(2048)).cast("long")
    return packed.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("container_id").alias("containers"), whole.alias("least"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from .sentences import sentences

    return sentences(_read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}

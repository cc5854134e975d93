"""The queries of the llm subpackage: name -> (spark, directory) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read
from . import furniture, leakage, lookalikes, markup, mixing, residue, sentences, sitelines


def _read(spark: SparkSession, where: str, table: str) -> DataFrame:
    return read(spark, where, table)


def p1_found(spark: SparkSession, where: str) -> DataFrame:
    return markup.found(_read(spark, where, "wcxb_samples"), _read(spark, where, "test_responses"))


def p1_clean(spark: SparkSession, where: str) -> DataFrame:
    return markup.cleaned(_read(spark, where, "wcxb_samples"), _read(spark, where, "test_responses"))


def p2_found(spark: SparkSession, where: str) -> DataFrame:
    return residue.find_residue(_read(spark, where, "wcxb_samples"), "file_id", "html").withColumnRenamed("record", "file_id")


def p2_clean(spark: SparkSession, where: str) -> DataFrame:
    return residue.without_residue(_read(spark, where, "wcxb_samples"), "file_id", "html")


def p3_found(spark: SparkSession, where: str) -> DataFrame:
    return furniture.furniture_lines(_read(spark, where, "wcxb_samples"), "file_id", "html", "main_content_text").withColumnRenamed("record", "file_id")


def p3_bodies(spark: SparkSession, where: str) -> DataFrame:
    return furniture.main_bodies(_read(spark, where, "wcxb_samples"), "file_id", "html").withColumnRenamed("record", "file_id").distinct()


def p5_found(spark: SparkSession, where: str) -> DataFrame:
    return lookalikes.lookalike_pairs(_read(spark, where, "templates"))


def p5_groups(spark: SparkSession, where: str) -> DataFrame:
    return lookalikes.lookalike_groups(_read(spark, where, "templates"))


def p5_wandering(spark: SparkSession, where: str) -> DataFrame:
    return lookalikes.wandering_observations(_read(spark, where, "template_observations"), _read(spark, where, "templates"))


def p6_found(spark: SparkSession, where: str) -> DataFrame:
    return sitelines.repeated_lines(_read(spark, where, "fixtures"), "id", "host", "html").select("id", "line")


def p6_clean(spark: SparkSession, where: str) -> DataFrame:
    return sitelines.without_repeated(_read(spark, where, "fixtures"), "id", "host", "html")


def p6_blocks(spark: SparkSession, where: str) -> DataFrame:
    return sitelines.boilerplate_blocks(_read(spark, where, "fixtures"), "id", "host", "html").select("site", "lines", "support", "text")


def p7_found(spark: SparkSession, where: str) -> DataFrame:
    return leakage.found(_read(spark, where, "documents"), _read(spark, where, "eval_items"))


def p7_overlaps(spark: SparkSession, where: str) -> DataFrame:
    return leakage.leaked(_read(spark, where, "documents"), _read(spark, where, "eval_items"))


def p8_mix(spark: SparkSession, where: str) -> DataFrame:
    return mixing.mix(_read(spark, where, "documents"), _read(spark, where, "mix_targets"))


def p8_shares(spark: SparkSession, where: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, where), _read(spark, where, "mix_targets"))


def p9_found(spark: SparkSession, where: str) -> DataFrame:
    return sentences.sentence_units(_read(spark, where, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_clean": p1_clean, "p2_found": p2_found, "p2_clean": p2_clean, "p3_found": p3_found, "p3_bodies": p3_bodies, "p5_found": p5_found, "p5_groups": p5_groups, "p5_wandering": p5_wandering, "p6_found": p6_found, "p6_clean": p6_clean, "p6_blocks": p6_blocks, "p7_found": p7_found, "p7_overlaps": p7_overlaps, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)

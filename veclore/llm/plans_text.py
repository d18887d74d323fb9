"""Queries of problems 6 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclore.llm import pii
from veclore.llm.leaks import leaks
from veclore.tables import table


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items").select("item_id", "text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per item: pages it leaked to and the longest passage."""
    found = _leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("pages"), F.max("words").alias("longest"))
    return table(spark, folder, "eval_items").select("item_id", "suite").join(found, "item_id")


def _pages(spark: SparkSession, folder: str):
    pages = table(spark, folder, "documents").select("doc_id", "text")
    return pages, pii.train(pages, table(spark, folder, "name_parts"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found_texts(*_pages(spark, folder))


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The pages with personal data, each replaced by its placeholder."""
    return pii.redacted(*_pages(spark, folder)).where("entities > 0")


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted, "p6_found": p6_found, "p6_items": p6_items}
ORACLES: dict[str, str] = {}

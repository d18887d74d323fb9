"""Queries of problems 1 and 7."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclore.llm import mixing, sampling
from veclore.tables import current_rows, known_type, table


def _sample_input(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = current_rows(table(spark, folder, "embedding_cache"), "id", "types", "years", "loaded_at").withColumn("types", known_type(F.col("types")))
    cells = table(spark, folder, "sample_targets")
    return rows, cells.withColumn("kind", known_type(F.col("types")))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell: what was asked, is there, was allotted and is missing; and of its plan, whether the minima fit into the
    sample, the rows it gets in all, and the cell's actual share of them."""
    report = sampling.sample_report(*_sample_input(spark, folder))
    return report.select(*sampling.CELL, "target_share", "available", "wanted", "quota", F.round("short", 3).alias("short"), "plan_rows", "plan_quota", "feasible", F.round("actual_share", 6).alias("actual_share"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_report(*_sample_input(spark, folder)).where("available < needed").select("plan_id", "types", "year_from").distinct()


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.proportional_sample(*_sample_input(spark, folder))


#: Rank file of a public tokenizer; another path in the environment wins.
VOCABULARY = os.environ.get("VECLORE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def _sizes(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Sizes in runs of non-white-space characters, or in tokens of a public tokenizer."""
    text = F.col("text")
    tokens = mixing.public_tokens(spark, vocabulary)(text) if vocabulary else mixing.space_tokens(text)
    return mixing.source_sizes(table(spark, folder, "documents"), tokens, seed=0)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.mix_plan(_sizes(spark, folder), table(spark, folder, "mix_targets"))
    return plan.where(F.col("there") * F.col("max_repeats") < F.col("wanted")).select("plan_id", "source").distinct()


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each target and their repeats, sizes in tokens of a public tokenizer."""
    sizes = _sizes(spark, folder, VOCABULARY)
    return mixing.mixed(sizes, mixing.mix_plan(sizes, table(spark, folder, "mix_targets")))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Actual shares of each plan, sizes in tokens of a public tokenizer."""
    return mixing.mix_report(_sizes(spark, folder, VOCABULARY), table(spark, folder, "mix_targets"))


_CURRENT = r"""WITH cur AS (SELECT id, years, 'H' || regexp_extract(types, '(?i)H(\d+)N(\d+)', 1) || 'N' || regexp_extract(types, '(?i)H(\d+)N(\d+)', 2) kind
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, types DESC, years DESC) rn FROM embedding_cache WHERE cache_name = 'fixed') WHERE rn = 1)"""
P1_FOUND_SQL = (
    _CURRENT
    + """ SELECT DISTINCT plan_id, types, year_from FROM sample_targets t
WHERE (SELECT count(*) FROM cur c WHERE c.kind = t.types AND c.kind <> 'HN' AND c.years BETWEEN t.year_from AND t.year_to) < greatest(min_rows, target_share * sample_rows)"""
)
P7_FOUND_SQL = r"""
WITH size AS (SELECT lower(trim(source)) src, sum(len(regexp_extract_all(text, '\S+'))) n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1)
SELECT DISTINCT plan_id, source FROM mix_targets m WHERE coalesce((SELECT n FROM size s WHERE s.src = lower(trim(m.source))), 0) * max_repeats < target_share * budget_tokens"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_sample": p1_sample, "p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLES = {"p1_found": P1_FOUND_SQL, "p7_found": P7_FOUND_SQL}

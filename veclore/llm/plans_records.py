"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclore.llm.partenum import all_pairs, groups, similar
from veclore.tables import accession, table


def _records(spark: SparkSession, folder: str) -> DataFrame:
    key = accession(F.col("epi_isl")).try_cast("bigint").alias("key")
    return table(spark, folder, "records").select(key, F.col("ha_sequence").alias("first_text"), F.col("na_sequence").alias("second_text"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return all_pairs(*similar(_records(spark, folder))).select(F.col("a").alias("epi_a"), F.col("b").alias("epi_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return groups(*similar(_records(spark, folder))).select(F.col("key").alias("epi"), "group_id", "links")


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
P5_FOUND_SQL = r"""
WITH r AS (SELECT try_cast(nullif(regexp_extract(regexp_replace(epi_isl, '\s+', '', 'g'), '(\d+)$', 1), '') AS BIGINT) k, upper(regexp_replace(coalesce(ha_sequence, ''), '[\s-]+', '', 'g')) a, upper(regexp_replace(coalesce(na_sequence, ''), '[\s-]+', '', 'g')) b FROM records),
one AS (SELECT k, max(a) a, max(b) b FROM r WHERE k IS NOT NULL GROUP BY 1),
s AS (SELECT k, hash(x) h FROM (SELECT k, unnest(list_transform(range(1, len(a) - 14), lambda i: substr(a, i, 16))) x FROM one UNION SELECT k, unnest(list_transform(range(1, len(b) - 14), lambda i: substr(b, i, 16))) FROM one)),
n AS (SELECT k, count(*) n FROM s GROUP BY 1),
p AS (SELECT x.k a, y.k b, count(*) c FROM s x JOIN s y ON x.h = y.h AND x.k < y.k GROUP BY 1, 2)
SELECT a epi_a, b epi_b FROM p JOIN n u ON u.k = a JOIN n v ON v.k = b WHERE c >= 0.6 * (u.n + v.n - c)"""
P5_GROUPS_SQL = f"""{P5_FOUND_SQL.replace("WITH r AS", "WITH RECURSIVE r AS", 1).replace("GROUP BY 1, 2)\nSELECT a epi_a", "GROUP BY 1, 2),\nf AS MATERIALIZED (SELECT a epi_a")}),
e AS MATERIALIZED (SELECT epi_a x, epi_b y FROM f UNION ALL SELECT epi_b, epi_a FROM f), degree AS (SELECT x, count(*) links FROM e GROUP BY 1),
reach(k, c) AS (SELECT k, k FROM n UNION SELECT e.y, r.c FROM reach r JOIN e ON e.x = r.k WHERE e.y > r.c), low AS (SELECT k, min(c) c FROM reach GROUP BY 1)
SELECT k epi, c group_id, coalesce(links, 0) links FROM low LEFT JOIN degree ON x = k"""
ORACLES = {"p5_found": P5_FOUND_SQL, "p5_groups": P5_GROUPS_SQL}

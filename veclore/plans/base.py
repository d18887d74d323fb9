"""Inputs that several queries share, in both forms: a DataFrame, and the WITH clauses of the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclore.functions.sequences import month_index
from veclore.sources.tables import resolved_labels
from veclore.tables import accession, current_rows, known_type, table, usable


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """id, grp, vector, month_index, epi of the current cached rows with a usable vector and a known type."""
    rows = current_rows(table(spark, folder, "embedding_cache"), "id", "embeddings", "types", "years", "months", "epi_isl", "loaded_at")
    rows = rows.where(usable(F.col("embeddings")) & known_type(F.col("types")).isNotNull())
    return rows.select("id", known_type(F.col("types")).alias("grp"), F.col("embeddings").cast("array<double>").alias("vector"), month_index(F.col("years"), F.col("months")).alias("month_index"), accession(F.col("epi_isl")).alias("epi"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """id, grp, ha, na, year, month, strain_name, month_index: one row per accession, sequences cleaned; of several rows the largest by (load time, sequences, name, type, year, month)."""
    r = table(spark, folder, "records")
    clean = lambda c: F.upper(F.regexp_replace(c, r"[\s-]+", ""))
    rows = r.select(
        accession(F.col("epi_isl")).try_cast("bigint").alias("id"), "loaded_at", clean("ha_sequence").alias("ha"), clean("na_sequence").alias("na"), "strain_name", known_type(F.col("subtype")).alias("grp"), "year", "month"
    ).where("id is not null")
    last = rows.groupBy("id").agg(F.max(F.struct("loaded_at", "ha", "na", "strain_name", "grp", "year", "month")).alias("r"))
    return last.select("id", "r.grp", "r.ha", "r.na", "r.year", "r.month", "r.strain_name", month_index(F.col("r.year"), F.col("r.month")).alias("month_index"))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """epi, label: the cleaned clade of each accession's last metadata row."""
    meta = table(spark, folder, "clade_metadata")
    key = accession(F.coalesce(F.nullif(F.trim("epi_isl"), F.lit("")), F.col("isolate_id")))
    raw = meta.select(key.alias("epi_isl"), "matched", "clade_raw", "clade", "major_clade", "lineage", "genotype", F.struct("loaded_at", "meta_id").alias("at"))
    return resolved_labels(raw, "at").select(F.col("epi_isl").alias("epi"), F.col("clade").alias("label"), "major_clade")


_ACC = r"nullif(regexp_replace(regexp_extract(regexp_replace({c}, '\s+', '', 'g'), '(\d+)$', 1), '^0+([0-9])', '\1'), '')"
_TYPE = r"CASE WHEN regexp_matches({c}, '(?i)H\d+N\d+') THEN 'H' || regexp_extract({c}, '(?i)H(\d+)N(\d+)', 1) || 'N' || regexp_extract({c}, '(?i)H(\d+)N(\d+)', 2) END"
_MONTH = "CASE WHEN {m} IS NOT NULL THEN {y} * 12 + greatest(1, least(12, {m})) - 1 END"


def acc_sql(c: str) -> str:
    return _ACC.format(c=c)


def type_sql(c: str) -> str:
    return _TYPE.format(c=c)


CACHED_SQL = f"""
cur0 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) rn FROM embedding_cache WHERE cache_name = 'fixed' AND id IS NOT NULL),
cached AS (SELECT id, {_TYPE.format(c="types")} grp, embeddings::DOUBLE[] vector, {_MONTH.format(y="years", m="months")} month_index, {_ACC.format(c="epi_isl")} epi
  FROM cur0 WHERE rn = 1 AND regexp_matches(types, '(?i)H\\d+N\\d+') AND len(embeddings) = 64
  AND len(list_filter(embeddings, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0)"""
RECORDS_SQL = f"""
rec0 AS (SELECT try_cast({_ACC.format(c="epi_isl")} AS BIGINT) id, loaded_at, upper(regexp_replace(ha_sequence, '[\\s-]+', '', 'g')) ha, upper(regexp_replace(na_sequence, '[\\s-]+', '', 'g')) na,
  strain_name, {_TYPE.format(c="subtype")} grp, year, month FROM records),
recs AS (SELECT id, grp, ha, na, year, month, strain_name, {_MONTH.format(y="year", m="month")} month_index
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, ha DESC NULLS LAST, na DESC NULLS LAST, strain_name DESC NULLS LAST, grp DESC NULLS LAST, year DESC NULLS LAST, month DESC NULLS LAST) rn
  FROM rec0 WHERE id IS NOT NULL) WHERE rn = 1)"""
NULL_LABELS = "('', 'nan', 'none', 'na', 'n/a', 'not assigned', 'unassigned')"


def clean_sql(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) NOT IN {NULL_LABELS} THEN trim({c}) END"


LABELS_SQL = f"""
labels AS (SELECT epi, label, coalesce(major, array_to_string(list_slice(string_split(label, '.'), 1, 2), '.')) major_clade FROM (
  SELECT {_ACC.format(c="coalesce(nullif(trim(epi_isl), ''), isolate_id)")} epi, {clean_sql("nullif(trim(clade), '')")} label, {clean_sql("nullif(trim(major_clade), '')")} major,
    row_number() OVER (PARTITION BY {_ACC.format(c="coalesce(nullif(trim(epi_isl), ''), isolate_id)")} ORDER BY loaded_at DESC NULLS LAST, meta_id DESC) rn FROM clade_metadata)
  WHERE rn = 1 AND epi IS NOT NULL)"""


def pairs_sql(source: str, per_row: int, seed: int) -> str:
    """The SQL twin of ``operators.ranks.sampled_pairs`` while a group fits one bucket; ``source``: grp, id."""
    return f"""
num AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY sha1('{seed}|' || id::VARCHAR), id) - 1 AS place, count(*) OVER (PARTITION BY grp) n FROM {source} WHERE grp IS NOT NULL AND id IS NOT NULL),
drawn AS (SELECT grp, id i, d.draw, (place + (place * 7919 + d.draw * 104729 + {seed}) % (n - 1) + 1) % n AS place FROM num, (SELECT unnest(range(1, {per_row + 1})) draw) d WHERE n > 1),
pairs AS (SELECT d.grp, d.i, m.id j, d.draw FROM drawn d JOIN num m ON m.grp = d.grp AND m.place = d.place)"""


def asks_sql(k: int, extra: str = "", distance: str = "list_distance(a.vector, b.vector)") -> str:
    """Nearest k rows of each cached row whose id is divisible by 100."""
    return f"""
near0 AS (SELECT a.grp, a.id query_id, b.id neighbor_id, {distance} distance FROM cached a JOIN cached b ON a.grp = b.grp AND a.id <> b.id WHERE a.id % 100 = 0 {extra}),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) rank FROM near0) WHERE rank <= {k})"""

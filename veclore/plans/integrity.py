"""Queries on references between the domain tables (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclore.operators.references import Reference, orphan_cascade
from veclore.tables import accession, current_rows, label_key, reads_true, table


def references(spark: SparkSession, folder: str) -> dict[str, Reference]:
    """The foreign keys of the domain tables. ``parent`` and ``probe`` only pass orphans on; they have no time of their own rules."""
    text = lambda c: F.col(c).cast("string")
    cache = current_rows(table(spark, folder, "embedding_cache"), "id", "epi_isl", "loaded_at")
    meta = table(spark, folder, "clade_metadata")
    catalog = table(spark, folder, "clade_catalog")
    records = table(spark, folder, "records").select(
        accession(F.col("epi_isl")).alias("target_key"), accession(F.col("epi_isl")).alias("row_key"), F.col("loaded_at").alias("since"), F.col("withdrawn_at").alias("until")
    )
    clades = catalog.select(label_key(F.col("clade")).alias("target_key"), label_key(F.col("clade")).alias("row_key"), F.col("loaded_at").alias("since"), F.col("withdrawn_at").alias("until"))
    named = F.when(F.coalesce(F.trim(F.regexp_replace("epi_isl", r"\s+", "")), F.lit("")) == "", F.col("isolate_id")).otherwise(F.col("epi_isl"))
    cached = cache.select(text("id").alias("target_key"), text("id").alias("row_key"), F.to_timestamp(F.lit("1900-01-01")).alias("since"), F.lit(None).cast("timestamp").alias("until"))
    probes = table(spark, folder, "neighbor_probes").select(text("id").alias("row_key"), text("id").alias("ref_key"), F.to_timestamp(F.lit("2100-01-01")).alias("at"))
    return {
        "cache": Reference("embedding_cache", "epi_isl", cache.select(text("id").alias("row_key"), accession(F.col("epi_isl")).alias("ref_key"), F.col("loaded_at").alias("at")), "records", records),
        "meta": Reference("clade_metadata", "epi_isl", meta.where(reads_true(F.col("matched"))).select(text("meta_id").alias("row_key"), accession(named).alias("ref_key"), F.col("loaded_at").alias("at")), "records", records),
        "label": Reference("clade_metadata", "clade", meta.select(text("meta_id").alias("row_key"), label_key(F.col("clade")).alias("ref_key"), F.col("loaded_at").alias("at")), "clade_catalog", clades),
        "parent": Reference("clade_catalog", "parent_clade", catalog.select(label_key(F.col("clade")).alias("row_key"), label_key(F.col("parent_clade")).alias("ref_key"), F.lit("2100-01-01").cast("timestamp").alias("at")), "clade_catalog", clades),
        "probe": Reference("neighbor_probes", "id", probes, "embedding_cache", cached),
    }


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows whose own reference is not met: depth 0 of the cascade."""
    orphans = orphan_cascade(list(references(spark, folder).values()))
    found = orphans.where("depth = 0 and ref_table in ('embedding_cache', 'clade_metadata')")
    return found.select("ref_table", "ref_field", F.col("row_key").cast("bigint").alias("row_key")).distinct()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, field and month of loading: direct, and inherited from orphaned parents."""
    refs = references(spark, folder)
    orphans = orphan_cascade(list(refs.values()))
    dated = orphans.withColumn("period", F.date_format("at", "yyyy-MM"))
    counts = dated.groupBy("ref_table", "ref_field", "period").agg(
        F.countDistinct(F.when(F.col("depth") == 0, F.col("row_key"))).alias("direct"), F.countDistinct(F.when(F.col("depth") > 0, F.col("row_key"))).alias("inherited"), F.max("depth").alias("deepest")
    )
    return counts


P4_FOUND_SQL = r"""
WITH cache AS (
  SELECT id, loaded_at, epi_isl FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, epi_isl DESC) rn
    FROM embedding_cache WHERE cache_name = 'fixed') WHERE rn = 1),
rec AS (SELECT ltrim(regexp_extract(regexp_replace(epi_isl, '\s+', '', 'g'), '(\d+)$', 1), '0') k, loaded_at, withdrawn_at FROM records),
refs AS (
  SELECT 'embedding_cache' ref_table, 'epi_isl' ref_field, id row_key, loaded_at,
    ltrim(regexp_extract(regexp_replace(epi_isl, '\s+', '', 'g'), '(\d+)$', 1), '0') k FROM cache
  UNION ALL
  SELECT 'clade_metadata', 'epi_isl', meta_id, loaded_at,
    ltrim(regexp_extract(regexp_replace(CASE WHEN trim(coalesce(epi_isl, '')) = '' THEN isolate_id ELSE epi_isl END, '\s+', '', 'g'), '(\d+)$', 1), '0')
  FROM clade_metadata WHERE lower(regexp_replace(matched, '\s+', '', 'g')) = 'true'),
labels AS (SELECT 'clade_metadata' ref_table, 'clade' ref_field, meta_id row_key, loaded_at, lower(trim(clade)) k FROM clade_metadata
  WHERE clade IS NOT NULL AND lower(trim(clade)) NOT IN ('', 'na', 'n/a', 'nan', 'none', 'unassigned', 'not assigned'))
SELECT DISTINCT ref_table, ref_field, row_key FROM refs r WHERE k <> '' AND NOT EXISTS (
  SELECT 1 FROM rec t WHERE t.k = r.k AND t.loaded_at <= r.loaded_at AND (t.withdrawn_at IS NULL OR t.withdrawn_at > r.loaded_at))
UNION ALL
SELECT DISTINCT ref_table, ref_field, row_key FROM labels r WHERE NOT EXISTS (
  SELECT 1 FROM clade_catalog t WHERE lower(trim(t.clade)) = r.k AND t.loaded_at <= r.loaded_at AND (t.withdrawn_at IS NULL OR t.withdrawn_at > r.loaded_at))
"""



def _report_sql(rounds: int = 12) -> str:
    """The cascade unrolled: each round adds the rows that name a key of which every carrier is an orphan. On the test tables
    it comes to rest after three; the operator has no such limit."""
    acc = r"nullif(regexp_replace(regexp_extract(regexp_replace({c}, '\s+', '', 'g'), '(\d+)$', 1), '^0+([0-9])', '\1'), '')"
    label = "CASE WHEN lower(trim({c})) NOT IN ('', 'na', 'n/a', 'nan', 'none', 'unassigned', 'not assigned') THEN lower(trim({c})) END"
    epi = acc.format(c="CASE WHEN trim(coalesce(epi_isl, '')) = '' THEN isolate_id ELSE epi_isl END")
    steps = [f"""f0 AS (SELECT t, f, k, row_at, 0 AS depth FROM refs r WHERE NOT EXISTS (SELECT 1 FROM targets g WHERE g.t = r.target AND g.tk = r.rk AND g.since <= r.row_at AND (g.until IS NULL OR g.until > r.row_at)))"""]
    for i in range(1, rounds):
        steps.append(f"""d{i} AS (SELECT g.t, g.tk FROM carriers g LEFT JOIN (SELECT DISTINCT t, k FROM f{i - 1}) o ON o.t = g.t AND o.k = g.k GROUP BY 1, 2 HAVING bool_and(o.k IS NOT NULL))""")
        steps.append(f"""f{i} AS (SELECT * FROM f{i - 1} UNION ALL SELECT r.t, r.f, r.k, r.row_at, {i} FROM refs r JOIN d{i} d ON d.t = r.target AND d.tk = r.rk WHERE NOT EXISTS (SELECT 1 FROM f{i - 1} x WHERE x.t = r.t AND x.f = r.f AND x.k = r.k))""")
    return f"""WITH cache AS (SELECT id, loaded_at, epi_isl FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, epi_isl DESC) rn FROM embedding_cache WHERE cache_name = 'fixed' AND id IS NOT NULL) WHERE rn = 1),
targets AS (SELECT 'records' t, {acc.format(c="epi_isl")} tk, {acc.format(c="epi_isl")} k, loaded_at since, withdrawn_at until FROM records WHERE loaded_at IS NOT NULL
  UNION ALL SELECT 'clade_catalog', {label.format(c="clade")}, {label.format(c="clade")}, loaded_at, withdrawn_at FROM clade_catalog WHERE loaded_at IS NOT NULL
  UNION ALL SELECT 'embedding_cache', id::VARCHAR, id::VARCHAR, TIMESTAMP '1900-01-01', NULL FROM cache),
carriers AS (SELECT DISTINCT t, tk, k FROM (SELECT 'records' t, {acc.format(c="epi_isl")} tk, {acc.format(c="epi_isl")} k FROM records UNION ALL SELECT 'clade_catalog', {label.format(c="clade")}, {label.format(c="clade")} FROM clade_catalog
  UNION ALL SELECT 'embedding_cache', id::VARCHAR, id::VARCHAR FROM cache) WHERE tk IS NOT NULL),
refs AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT 'embedding_cache' t, 'epi_isl' f, 'records' target, id::VARCHAR k, {acc.format(c="epi_isl")} rk, loaded_at row_at FROM cache
  UNION ALL SELECT 'clade_metadata', 'epi_isl', 'records', meta_id::VARCHAR, {epi}, loaded_at FROM clade_metadata WHERE lower(regexp_replace(matched, '\\s+', '', 'g')) = 'true'
  UNION ALL SELECT 'clade_metadata', 'clade', 'clade_catalog', meta_id::VARCHAR, {label.format(c="clade")}, loaded_at FROM clade_metadata
  UNION ALL SELECT 'clade_catalog', 'parent_clade', 'clade_catalog', {label.format(c="clade")}, {label.format(c="parent_clade")}, TIMESTAMP '2100-01-01' FROM clade_catalog
  UNION ALL SELECT 'neighbor_probes', 'id', 'embedding_cache', id::VARCHAR, id::VARCHAR, TIMESTAMP '2100-01-01' FROM neighbor_probes) WHERE rk IS NOT NULL),
{", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}
SELECT t ref_table, f ref_field, strftime(row_at, '%Y-%m') AS period, count(DISTINCT CASE WHEN depth = 0 THEN k END) direct, count(DISTINCT CASE WHEN depth > 0 THEN k END) inherited, max(depth)::INT deepest FROM f{rounds - 1} GROUP BY 1, 2, 3"""


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
ORACLES = {"p4_found": P4_FOUND_SQL, "p4_report": _report_sql()}

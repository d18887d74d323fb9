"""Readers and writers of datasets, embedding caches, label files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclore.functions.sequences import clean_label, major_label
from veclore.sources.fasta import file_place

CACHE_COLUMNS = ("id", "embeddings", "years", "months", "types")
LABEL_SCHEMA = "epi_isl string, Isolate_Id string, matched string, clade_raw string, Clade string, major_clade string, Lineage string, Genotype string"
WINDOW = "struct<year:int,month:int,strain_idx:bigint,n_strains:bigint>"


class CacheError(ValueError):
    """An embedding cache that must not be used."""


def checked_cache(cache: DataFrame, size: int | None = None, columns: tuple[str, ...] = CACHE_COLUMNS) -> DataFrame:
    """The cache, if it has all columns, unique non-NULL ids and vectors of one length; else ``CacheError``. One pass of aggregates."""
    missing = [c for c in columns if c not in cache.columns]
    if missing:
        raise CacheError(f"missing columns: {missing}")
    facts = cache.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min(F.size("embeddings")).alias("low"), F.max(F.size("embeddings")).alias("high"), F.count("embeddings").alias("vectors")).first()
    if facts["n"] != facts["ids"]:
        raise CacheError(f"{facts['n'] - facts['ids']} rows with a repeated or missing id")
    if facts["vectors"] != facts["n"] or facts["low"] != facts["high"] or (size and facts["low"] != size):
        raise CacheError(f"vector lengths {facts['low']}..{facts['high']}, {facts['n'] - facts['vectors']} missing")
    return cache


def write_cache(cache: DataFrame, path: str, **facts: str) -> None:
    """The cache as parquet by type, with a sidecar row of facts about how it was made."""
    cache.write.mode("overwrite").partitionBy("types").parquet(f"{path}/rows")
    spark = cache.sparkSession
    side = spark.range(1).select(F.current_timestamp().alias("written_at"), *(F.lit(str(v)).alias(k) for k, v in facts.items()))
    side.write.mode("overwrite").json(f"{path}/facts")


def append_new(new: DataFrame, path: str, key: str = "id") -> None:
    """Append the rows whose key the table at ``path`` doesn't have yet; a repeated run adds nothing."""
    spark = new.sparkSession
    there = spark.read.parquet(path).select(key)
    new.join(there, key, "left_anti").dropDuplicates([key]).write.mode("append").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV: aliases of columns resolved, null tokens cleaned, the last line of a key wins (of several files: of the last by name)."""
    raw = spark.read.schema(LABEL_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)
    return resolved_labels(raw.withColumn("at", file_place()), "at")


def resolved_labels(raw: DataFrame, order: str) -> DataFrame:
    """(epi_isl, matched, clade_raw, clade, major_clade, lineage, genotype), one row per key: the last by ``order``.

    An empty main column falls through to its alias; the major label defaults to the first two parts of the label.
    """
    has = {c.lower(): c for c in raw.columns}
    col = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(has[n])), F.lit("")) for n in names if n in has))
    cleaned = raw.select(
        col("epi_isl", "isolate_id").alias("epi_isl"), (F.lower(col("matched")) == "true").alias("matched"), clean_label(col("clade_raw", "clade")).alias("clade_raw"), clean_label(col("clade")).alias("clade"),
        major_label(col("major_clade"), col("clade")).alias("major_clade"), clean_label(col("lineage")).alias("lineage"), clean_label(col("genotype")).alias("genotype"), F.col(order).alias("__at"),
    )
    rest = [c for c in cleaned.columns if c not in ("epi_isl", "__at")]
    last = cleaned.where("epi_isl is not null").groupBy("epi_isl").agg(F.max_by(F.struct(*rest), "__at").alias("r"))
    return last.select("epi_isl", *(f"r.{c}" for c in rest))


def write_dataset(records: DataFrame, path: str) -> None:
    """Paired records as JSON lines, a folder per subtype."""
    records.write.mode("overwrite").partitionBy("subtype").json(path)


def read_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Datasets of JSON lines, or of whole documents whose ``paired_strains`` hold the records."""
    return spark.read.schema(schema).json(path)


def read_documents(spark: SparkSession, path: str, record_schema: str) -> DataFrame:
    """(subtype, record columns) of multi-line dataset documents."""
    whole = spark.read.option("multiLine", True).schema(f"subtype string, paired_strains array<struct<{record_schema.replace(' ', ':').replace(',:', ',')}>>, stats map<string,bigint>").json(path)
    return whole.select("subtype", F.explode("paired_strains").alias("r")).select("subtype", "r.*")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def content_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): a digest of a table's content that neither order nor files change, and that no task computes whole: the sum of
    48 bits of each row's md5. NULL and empty text differ; repeated rows count."""
    text = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns))
    part = F.conv(F.left(F.md5(text), F.lit(12)), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))

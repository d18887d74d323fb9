"""Multi-line FASTA files as a DataFrame: one row per record, split by Spark's text reader."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veclore.functions.sequences import date_part, header_field, segment_name, subtype


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, on any file system Spark knows; a warning names those that don't."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
        else:
            warnings.warn(f"left out, not found: {p}", stacklevel=3)
    return out


def file_place() -> Column:
    """Where a row of a text or CSV file stands: it orders the rows of a file, and files by name, however Spark packs them into tasks."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))


def read_fasta(spark: SparkSession, paths: str | list[str], last: bool = False) -> DataFrame:
    """(file, header, sequence): headers trimmed, bodies joined and in upper case. Missing paths are left out; none gives an empty frame.

    The reader splits at line ends that are followed by ``>``; undecodable bytes become replacement signs.
    ``last``: of records of a file with the same header only the last, by the place in the file.
    """
    held = existing(spark, [paths] if isinstance(paths, str) else list(paths))
    if not held:
        return spark.createDataFrame([], "file string, header string, sequence string")
    raw = spark.read.option("lineSep", "\n>").text(held).select(F.col("_metadata.file_path").alias("file"), "value", file_place().alias("place"))
    parts = F.split(F.regexp_replace("value", r"^\s*>", ""), r"\r?\n", 2)
    header = F.trim(F.regexp_replace(F.get(parts, F.lit(0)), r"\r", ""))
    body = F.upper(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", ""))
    rows = raw.select("file", header.alias("header"), body.alias("sequence"), "place").where("header != ''")
    if last:
        rows = rows.groupBy("file", "header").agg(F.max_by("sequence", "place").alias("sequence"))
    return rows.select("file", "header", "sequence")


def parsed_headers(records: DataFrame, header: str = "header") -> DataFrame:
    """The fields of ``epi|strain|subtype|date|segment`` headers beside the other columns; headers with fewer fields, of other
    segments or without a year are dropped."""
    h = F.col(header)
    out = records.select(
        *[c for c in records.columns if c != header], header_field(h, 0).alias("epi_isl"), F.replace(header_field(h, 1), F.lit("_"), F.lit(" ")).alias("strain_name"), subtype(header_field(h, 2)).alias("subtype"),
        *(date_part(header_field(h, 3), p).alias(p) for p in ("year", "month", "day")), segment_name(header_field(h, 4)).alias("segment"),
    )
    return out.where("segment is not null and year is not null")


def write_fasta(records: DataFrame, path: str, header: str = "header", sequence: str = "sequence", width: int = 70) -> None:
    """FASTA text files, bodies broken into lines of ``width``; rows with a NULL sequence are left out."""
    lines = F.regexp_replace(sequence, f"(.{{{width}}})(?!$)", "$1\n")
    rows = records.where(f"{sequence} is not null").select(F.concat(F.lit(">"), F.regexp_replace(header, r"\s+", " "), F.lit("\n"), lines).alias("value"))
    rows.write.mode("overwrite").text(path)

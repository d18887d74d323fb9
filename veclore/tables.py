"""Readers and row rules shared by the queries: which rows count, and how keys are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def accession(c: Column) -> Column:
    """The number that ends an accession, without blanks and leading zeros; NULL if there is none. Kept as text: any length fits."""
    digits = F.regexp_extract(F.regexp_replace(c, r"\s+", ""), r"(\d+)$", 1)
    return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=\d)", ""))


def known_type(c: Column) -> Column:
    """``HxNy`` found anywhere in the value, in any case; NULL otherwise."""
    h, n = (F.regexp_extract(c, r"(?i)H(\d+)N(\d+)", i) for i in (1, 2))
    return F.when(h != "", F.concat(F.lit("H"), h, F.lit("N"), n))


def label_key(c: Column) -> Column:
    """A label without case and outer blanks; the tokens that mean "no label" become NULL."""
    clean = F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    return F.when(~clean.isin("", "na", "n/a", "nan", "none", "unassigned", "not assigned"), clean)


def reads_true(c: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(c, r"\s+", "")) == "true", F.lit(False))


def current_rows(cache: DataFrame, *columns: str) -> DataFrame:
    """The row of each id that was loaded last in the ``fixed`` cache, with ``columns``.

    A maximum over structs, so one hot id is combined before the shuffle. Equal load times are broken by the other
    columns, a NULL load time loses to any other; rows without an id are none.
    """
    others = [c for c in columns if c not in ("id", "loaded_at")]
    last = F.max(F.struct("loaded_at", *others)).alias("last")
    rows = cache.where((F.col("cache_name") == "fixed") & F.col("id").isNotNull()).groupBy("id").agg(last)
    return rows.select("id", *(F.col(f"last.{c}").alias(c) for c in columns if c != "id"))


def usable(vector: Column, size: int = 64) -> Column:
    """``size`` finite elements that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))

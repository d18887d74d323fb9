"""Record hygiene: duplicates and their representatives, quality accounting, pairing of segments and accessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veclore.functions.sequences import good_sequence


def representatives(rows: DataFrame, key: list[Column], policy: str = "first", order: str = "id", month: str = "month_index", seed: int = 0) -> DataFrame:
    """One row per content key: the ``first`` by ``order``, the ``earliest`` or ``latest`` month (ties: lowest ``order``), or a ``random`` one.

    A minimum over (policy, order, row): combined before the shuffle, so a key with a third of all rows is no hot task.
    NULL keys are one key; NULL months come first. All columns are kept.
    """
    rank = {
        "first": F.lit(0), "earliest": F.col(month), "latest": -F.col(month), "random": F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(order).cast("string"))),
    }[policy]
    names = [f"__k{i}" for i in range(len(key))]
    keyed = rows.select("*", *(c.alias(n) for c, n in zip(key, names)))
    best = keyed.groupBy(*names).agg(F.min_by(F.struct(*rows.columns), F.struct(rank.alias("r"), F.col(order).alias("o"))).alias("row"))
    return best.select("row.*")


def duplicate_sizes(rows: DataFrame, key: Column) -> DataFrame:
    """(copies, groups): how many content keys occur how often."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("groups"))


def reject_reason(ha: Column, na: Column, year: Column) -> Column:
    """The first rule a record fails, in this order; NULL for a good record."""
    return (
        F.when(F.coalesce(ha, F.lit("")) == "", "no_ha").when(F.coalesce(na, F.lit("")) == "", "no_na").when(year.isNull(), "no_date")
        .when(~good_sequence(ha, "HA"), "bad_ha").when(~good_sequence(na, "NA"), "bad_na")
    )


def paired_segments(rows: DataFrame) -> DataFrame:
    """Rows (key, at, segment, sequence, ...meta) to one row per key: the first row's other columns, the last HA and the last NA sequence."""
    meta = [c for c in rows.columns if c not in ("key", "at", "segment", "sequence")]
    last = lambda s: F.max_by(F.when(F.col("segment") == s, F.col("sequence")), F.when(F.col("segment") == s, F.col("at")))
    out = rows.groupBy("key").agg(F.min_by(F.struct(F.lit(0).alias("_"), *meta), F.col("at")).alias("meta"), last("HA").alias("ha_sequence"), last("NA").alias("na_sequence"))
    return out.select("key", *(f"meta.{c}" for c in meta), "ha_sequence", "na_sequence")


def paired_by_name(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """Left rows (id, name) with the first right row (id, name) of the same name; a right row may serve many left ones. NULL names match nothing."""
    first = right.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("id").alias("right_id"))
    return left.join(first, name, "left").select(left["id"], F.col(name), "right_id")


def paired_by_number(left: DataFrame, right: DataFrame, deltas: tuple[int, ...] = (2, 1, 3, 4)) -> DataFrame:
    """Left rows (id, prefix, number) with the right row of the same prefix whose number is off by the first of ``deltas`` that exists."""
    tries = F.array(*(F.struct(F.lit(d).alias("delta"), F.lit(i).alias("priority")) for i, d in enumerate(deltas)))
    asked = left.select("id", "prefix", "number", F.explode(tries).alias("t")).select("id", "prefix", (F.col("number") + F.col("t.delta")).alias("number"), "t.priority", "t.delta")
    there = right.groupBy("prefix", "number").agg(F.min("id").alias("right_id"))
    hits = asked.join(there, ["prefix", "number"])
    return hits.groupBy("id").agg(F.min_by(F.struct("right_id", "delta"), "priority").alias("hit")).select("id", "hit.right_id", "hit.delta")

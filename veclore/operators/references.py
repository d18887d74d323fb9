"""References to rows that do not exist: direct orphans as of each row's own time, and the orphans they leave behind.

A reference holds if, at the row's own time, some row of the target was already there and not yet withdrawn. The check
never pairs rows: per key and period it takes a running maximum of "valid until", so a key that holds a third of all
rows is spread over its periods and combined before each shuffle.

Defined cases: a NULL key is no reference; a row without a time cannot have its reference met; a target without a
``since`` never counts; repeated rows are judged once; empty tables give empty results.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veclore.runtime import written

#: Stands for "not withdrawn".
FOREVER = "9999-12-31 00:00:00"


@dataclass(frozen=True)
class Reference:
    """``rows``: row_key, ref_key, at. ``targets``: target_key, row_key, since, until (NULL: still valid)."""

    table: str
    field: str
    rows: DataFrame
    target_table: str
    targets: DataFrame


def unmet(rows: DataFrame, targets: DataFrame, period: str = "month") -> DataFrame:
    """The distinct (ref_key, at) of ``rows`` that no target meets; ``rows``: ref_key, at; ``targets``: target_key, since, until."""
    asked = rows.where(F.col("ref_key").isNotNull()).select(F.col("ref_key").alias("key"), "at").distinct()
    there = (
        targets.where(F.col("target_key").isNotNull() & F.col("since").isNotNull())
        .groupBy(F.col("target_key").alias("key"), F.col("since").alias("at"))
        .agg(F.max(F.coalesce("until", F.lit(FOREVER).cast("timestamp"))).alias("until"))
    )
    asked_at = asked.where(F.col("at").isNotNull()).withColumn("until", F.lit(None).cast("timestamp")).withColumn("asks", F.lit(True))
    events = asked_at.unionByName(there.withColumn("asks", F.lit(False))).withColumn("period", F.date_trunc(period, "at"))
    within = Window.partitionBy("key", "period").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = events.withColumn("in_period", F.max("until").over(within)).where("asks")
    before = Window.partitionBy("key").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    periods = events.groupBy("key", "period").agg(F.max("until").alias("last")).withColumn("earlier", F.max("last").over(before))
    best = F.greatest("in_period", "earlier")  # skips NULLs
    judged = running.join(periods.select("key", "period", "earlier"), ["key", "period"], "left")
    late = judged.where(best.isNull() | (best <= F.col("at"))).select("key", "at")
    return late.unionByName(asked.where(F.col("at").isNull())).select(F.col("key").alias("ref_key"), "at")


def direct_orphans(reference: Reference) -> DataFrame:
    """(ref_table, ref_field, row_key, at, ref_key) of the rows whose own reference is not met."""
    rows = reference.rows.where(F.col("ref_key").isNotNull()).select("row_key", "ref_key", "at").distinct()
    lost = unmet(rows, reference.targets)
    out = rows.alias("r").join(lost.alias("l"), (F.col("r.ref_key") == F.col("l.ref_key")) & F.col("r.at").eqNullSafe(F.col("l.at")), "left_semi")
    return out.select(F.lit(reference.table).alias("ref_table"), F.lit(reference.field).alias("ref_field"), "row_key", "at", "ref_key")


def orphan_cascade(references: list[Reference]) -> DataFrame:
    """Direct orphans (depth 0) and rows that inherit it: a key is dead when every row that carries it is an orphan, and
    a row whose met reference names a dead key becomes an orphan one round later, until a round adds none.

    Returns (ref_table, ref_field, row_key, at, depth). A table may refer to itself. The narrow rows of every reference are
    written once, and only references to tables that have references of their own can pass orphans on: of these each round
    joins the keys that the last round's orphans carry. A written table ends a round's lineage.
    """
    held = [Reference(r.table, r.field, _narrow(r.rows), r.target_table, r.targets) for r in references]
    found = written(_union([direct_orphans(r).select("ref_table", "ref_field", "row_key", "at", F.lit(0).alias("depth")) for r in held]), "orphans")
    owners = {r.table for r in held}
    passing = [(r, _carriers(r)) for r in held if r.target_table in owners]
    if not passing:
        return found
    last = found
    for depth in itertools.count(1):
        parts = []
        for r, carriers in passing:
            # keys that a new orphan carries, and of which no carrier is left that isn't one
            fresh = last.where(F.col("ref_table") == r.target_table).select("row_key").distinct()
            asked = carriers.join(fresh, "row_key", "left_semi").select("target_key").distinct()
            dead_rows = found.where(F.col("ref_table") == r.target_table).select("row_key").distinct()
            alive = carriers.join(asked, "target_key", "left_semi").join(dead_rows, "row_key", "left_anti").select("target_key")
            dead = asked.join(alive, "target_key", "left_anti")
            known = found.where((F.col("ref_table") == r.table) & (F.col("ref_field") == r.field)).select("row_key").distinct()
            rows = r.rows.join(dead, r.rows.ref_key == dead.target_key, "left_semi").join(known, "row_key", "left_anti")
            parts.append(rows.select(F.lit(r.table).alias("ref_table"), F.lit(r.field).alias("ref_field"), "row_key", "at", F.lit(depth).alias("depth")))
        last = written(_union(parts), "orphans")
        if last.isEmpty():
            return found
        found = found.unionByName(last)


def _narrow(rows: DataFrame) -> DataFrame:
    return written(rows.where(F.col("ref_key").isNotNull()).select("row_key", "ref_key", "at").distinct(), "references")


def _carriers(r: Reference) -> DataFrame:
    return written(r.targets.where(F.col("target_key").isNotNull()).select("target_key", "row_key").distinct(), "carriers")


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)

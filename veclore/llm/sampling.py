"""Sample whose share of each category matches given targets (problem 1).

Rows are counted once per (category, value, hash bucket); everything after that works on counts, and only the rows of
one boundary bucket per cell are ever ranked. A cell is a target row: category, a closed range of values, a share of the
plan's total and a minimum.

Defined cases: rows with a NULL category or value belong to no cell; a NULL share or minimum counts as 0, a NULL bound
as open; equal target rows are one cell; a cell without rows is reported with 0; ties of the random key go to the
smaller id; empty targets give an empty report and sample.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veclore.runtime import broadcast_if_small, written

CELL = ["plan_id", "types", "year_from", "year_to"]
#: Hash buckets per cell: a boundary bucket holds about 1/4096 of a cell's rows.
BUCKET_BITS = 12


def random_key(c: Column, seed: int) -> Column:
    """63 random bits that depend on the id and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(c, F.lit(seed)), 1)


def largest_remainder(wanted: list[float], seats: int) -> list[int]:
    """Integers near ``wanted`` (scaled to ``seats``): floors first, the rest to the largest fractions, ties to the earlier cell."""
    total = sum(wanted)
    if not total or seats <= 0:
        return [0] * len(wanted)
    exact = [w * seats / total for w in wanted]
    out = [int(x) for x in exact]
    order = sorted(range(len(wanted)), key=lambda i: (out[i] - exact[i], i))
    for i in order[: max(0, seats - sum(out))]:
        out[i] += 1
    return out


def quotas(plan: pd.DataFrame, spill: bool = False) -> pd.DataFrame:
    """Quotas of one plan's cells. Cells whose share is under their minimum are raised to it and the others share what is
    left; then each is capped by what is available, and the gap is reported; with ``spill`` it moves to the cells that have
    more, in proportion to their shares.

    Minima that exceed the sample are kept all the same, and the plan is marked as not ``feasible``. ``plan_rows`` is the
    sample asked for, ``plan_quota`` the sample there will be."""
    plan = plan.sort_values(CELL[1:], na_position="first").reset_index(drop=True)
    share, least = plan.target_share.clip(lower=0), plan.min_rows.clip(lower=0)
    seats = round(float(plan.sample_rows.max() * min(1.0, share.sum())))
    quota, pinned = [0] * len(plan), [False] * len(plan)
    while True:
        left = seats - sum(q for q, p in zip(quota, pinned) if p)
        free = [i for i, p in enumerate(pinned) if not p]
        for i, q in zip(free, largest_remainder([share[i] for i in free], left)):
            quota[i] = q
        low = [i for i in free if quota[i] < least[i]]
        if not low:
            break
        for i in low:
            quota[i], pinned[i] = int(least[i]), True
    plan["wanted"] = quota
    given = [min(q, int(a)) for q, a in zip(quota, plan.available)]
    while spill and sum(given) < seats:
        open_cells = [i for i, (q, a) in enumerate(zip(given, plan.available)) if q < a and share[i] > 0]
        more = largest_remainder([share[i] for i in open_cells], seats - sum(given))
        if not any(more):
            break
        for i, m in zip(open_cells, more):
            given[i] = min(given[i] + m, int(plan.available[i]))
    plan["quota"] = given
    plan["plan_rows"], plan["plan_quota"], plan["feasible"] = int(plan.sample_rows.max()), sum(given), bool(least.sum() <= seats)
    return plan


def target_cells(cells: DataFrame) -> DataFrame:
    """The distinct targets, with one name for each."""
    targets = cells.select(
        *CELL, F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).cast("bigint").alias("min_rows"), F.coalesce("sample_rows", F.lit(0)).cast("bigint").alias("sample_rows"), "kind"
    ).distinct()
    return targets.withColumn("cell", F.to_json(F.struct(*targets.columns)))


def keyed_rows(rows: DataFrame, seed: int) -> DataFrame:
    """(id, kind, years, key, bucket) of the rows that belong to a category and a value."""
    keyed = rows.where(F.col("types").isNotNull() & F.col("years").isNotNull()).select("id", F.col("types").alias("kind"), "years")
    return keyed.withColumn("key", random_key(F.col("id"), seed)).withColumn("bucket", F.shiftright("key", 63 - BUCKET_BITS).cast("int"))


def count_cells(keyed: DataFrame, targets: DataFrame, buckets: bool) -> DataFrame:
    """(cell, n), or (cell, bucket, n): rows are counted per category and value first, whatever the number of targets."""
    by = ["bucket"] if buckets else []
    counts = keyed.groupBy("kind", "years", *by).agg(F.count("*").alias("n"))
    return targets.join(counts, "kind").where(_within()).groupBy("cell", *by).agg(F.sum("n").alias("n"))


def _within() -> Column:
    return F.coalesce(F.col("years") >= F.col("year_from"), F.lit(True)) & F.coalesce(F.col("years") <= F.col("year_to"), F.lit(True))


def sample_report(rows: DataFrame, cells: DataFrame, seed: int = 0, spill: bool = False) -> DataFrame:
    """One row per cell: what the target asks for, what is available, the quota, how much is missing, and what became of its plan.

    ``rows``: id, types, years. ``cells``: plan_id, types, year_from, year_to, target_share, min_rows, sample_rows, and
    ``kind``, the category in the form ``rows.types`` has. Buckets are not needed here: a category is counted by value.
    """
    targets = target_cells(cells)
    return _report(targets, count_cells(keyed_rows(rows, seed), targets, False), spill)


def _report(targets: DataFrame, by_cell: DataFrame, spill: bool) -> DataFrame:
    available = by_cell.groupBy("cell").agg(F.sum("n").alias("available"))
    full = targets.join(available, "cell", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.schema.fields)
    # one group per plan: as many rows as the plan has target cells, whatever the data's size
    allotted = full.groupBy("plan_id").applyInPandas(lambda plan: quotas(plan, spill), f"{names}, wanted bigint, quota bigint, plan_rows bigint, plan_quota bigint, feasible boolean")
    need = F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("sample_rows"))
    allotted = allotted.withColumn("actual_share", F.col("quota") / F.nullif(F.col("plan_quota"), F.lit(0)))
    return allotted.withColumn("needed", need).withColumn("short", F.greatest(need - F.col("available"), F.lit(0.0)))


def proportional_sample(rows: DataFrame, cells: DataFrame, seed: int = 0, spill: bool = False) -> DataFrame:
    """(plan_id, types, year_from, year_to, id): per cell the quota's smallest random keys."""
    keyed, targets = written(keyed_rows(rows, seed), "rows"), target_cells(cells)
    by_cell = written(count_cells(keyed, targets, True), "cells")
    report = _report(targets, by_cell, spill).where("quota > 0").select(*CELL, "kind", "cell", "quota")
    upto = Window.partitionBy("cell").orderBy("bucket")
    running = by_cell.withColumn("upto", F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))
    edge = running.join(report, "cell").where("before < quota and quota <= upto").select(*CELL, "kind", "cell", F.col("bucket").alias("edge"), (F.col("quota") - F.col("before")).alias("rest"))
    inside = keyed.join(broadcast_if_small(edge), "kind").where(_within() & (F.col("bucket") <= F.col("edge")))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("key", "id"))
    boundary = inside.where("bucket = edge").withColumn("rank", rank).where("rank <= rest")
    return inside.where("bucket < edge").select(*CELL, "id").unionByName(boundary.select(*CELL, "id"))

"""Candidate sets for target records, rank metrics of scored candidates, and classification metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veclore.operators.ranks import hash_order

POLICIES = ("same_month", "near", "past", "length", "group")


def candidates(windows: DataFrame, rows: DataFrame, policy: str, most: int, months: int = 3, tolerance: float = 0.03, seed: int = 0, context: int = 3) -> DataFrame:
    """(window_id, grp, candidate_id, is_target, fingerprint, length, month_gap): up to ``most`` rows per window, the target among them.

    ``windows``: window_id, grp, target_id, target_month, target_length, target_fingerprint, context_ids.
    ``rows``: grp, id, month_index, length, fingerprint. ``policy``: the target's month; within ``months`` of it; before it;
    of a length within ``tolerance``; or the whole group. Rows of the context are left out, nearer months go first, then hashed
    order, and of equal fingerprints the target's, else the first in this order, is kept. ``context``: the most rows a context has;
    ``tolerance`` lies between 0 and 1.

    One row per (group, month, fingerprint) is kept first, and of those the ``most`` (and as many as a window can leave out)
    of each month, or of each month and length: rows beyond them come after ``most`` others in any window. So a hot group
    adds no more than months (times lengths in reach) times ``most`` rows to a window, whatever its size. Windows meet rows
    on the group and the months, or the steps of length, that they can reach.
    """
    one = rows.groupBy("grp", "month_index", "fingerprint").agg(F.min(F.struct("id", "length")).alias("r")).select("grp", "month_index", "fingerprint", "r.id", "r.length")
    w = windows.select("window_id", "grp", "target_id", "target_month", "target_length", "target_fingerprint", "context_ids")
    gap = F.abs(F.col("month_index") - F.col("target_month"))
    allowed = {
        "same_month": gap == 0, "near": gap <= months, "past": F.col("month_index") < F.col("target_month"), "group": F.lit(True),
        "length": F.abs(F.col("length") - F.col("target_length")) <= tolerance * F.col("target_length"),
    }[policy]
    alike = ["grp", "month_index", "length"] if policy == "length" else ["grp", "month_index"]
    order = Window.partitionBy(*alike).orderBy(hash_order(F.col("id"), seed), "id")
    few = one.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most + 1 + context).drop("__n")
    own = w.select("window_id", "grp", F.col("target_id").alias("candidate_id"), F.lit(True).alias("is_target"), F.col("target_fingerprint").alias("fingerprint"), F.col("target_length").alias("length"), F.lit(0).alias("month_gap"))
    on = ["grp"]
    if policy == "length":
        step = lambda c: F.floor(F.ln(F.greatest(F.col(c), F.lit(1))) / math.log1p(tolerance))
        reach = 1 + math.ceil(-math.log1p(-tolerance) / math.log1p(tolerance))
        few, w, on = few.withColumn("__step", step("length")), w.withColumn("__step", F.explode(F.sequence(step("target_length") - reach, step("target_length") + reach))), ["grp", "__step"]
    elif policy in ("same_month", "near"):
        reach = months if policy == "near" else 0
        w, on = w.withColumn("month_index", F.explode(F.sequence(F.col("target_month") - reach, F.col("target_month") + reach))), ["grp", "month_index"]
    near = w.join(few, on).where(allowed & (F.col("fingerprint") != F.col("target_fingerprint")) & ~F.array_contains("context_ids", F.col("id")))
    near = near.select("window_id", "grp", F.col("id").alias("candidate_id"), F.lit(False).alias("is_target"), "fingerprint", "length", gap.alias("month_gap"))
    each = near.unionByName(own).groupBy("window_id", "grp", "fingerprint").agg(F.min(F.struct((~F.col("is_target")).alias("o"), "month_gap", hash_order(F.col("candidate_id"), seed).alias("h"), "candidate_id", "is_target", "length")).alias("c"))
    each = each.select("window_id", "grp", "c.candidate_id", "c.is_target", "fingerprint", "c.length", "c.month_gap")
    pick = Window.partitionBy("window_id").orderBy(F.desc("is_target"), "month_gap", hash_order(F.col("candidate_id"), seed), "candidate_id")
    return each.withColumn("__n", F.row_number().over(pick)).where(F.col("__n") <= most).drop("__n")


def target_ranks(scored: DataFrame) -> DataFrame:
    """(window_id, grp, candidates, target_rank, normalised_rank, reciprocal_rank, top1, top5, top10) from window_id, grp, candidate_id,
    is_target, mean_nll. Smaller scores are better, missing ones last, ties by candidate id; top-k is NULL where a window has fewer than k candidates."""
    order = Window.partitionBy("window_id").orderBy(F.isnan("mean_nll") | F.col("mean_nll").isNull(), "mean_nll", "candidate_id")
    ranked = scored.withColumn("r", F.row_number().over(order)).groupBy("window_id", "grp").agg(F.count("*").alias("candidates"), F.min(F.when(F.col("is_target"), F.col("r"))).alias("target_rank"))
    top = lambda k: F.when(F.col("candidates") >= k, (F.col("target_rank") <= k).cast("double")).alias(f"top{k}")
    normal = F.when(F.col("candidates") > 1, (F.col("target_rank") - 1) / (F.col("candidates") - 1)).otherwise(0.0)
    return ranked.where("target_rank is not null").select("window_id", "grp", "candidates", "target_rank", normal.alias("normalised_rank"), (1 / F.col("target_rank")).alias("reciprocal_rank"), top(1), top(5), top(10))


def harmonic(n: Column) -> Column:
    """Sum of 1 / i up to n; 0 for n < 1."""
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, i: s + 1 / i)).otherwise(0.0)


def rank_report(ranks: DataFrame, group: list[str]) -> DataFrame:
    """Means over windows: rank, median rank, MRR, top-k over the windows where it applies, and the MRR a random order is expected to have."""
    return ranks.groupBy(*group).agg(
        F.count("*").alias("windows"), F.avg("target_rank").alias("mean_rank"), F.percentile("target_rank", 0.5).alias("median_rank"), F.avg("normalised_rank").alias("mean_normalised"), F.avg("reciprocal_rank").alias("mrr"),
        F.avg("top1").alias("top1"), F.avg("top5").alias("top5"), F.avg("top10").alias("top10"), F.avg(harmonic(F.col("candidates")) / F.col("candidates")).alias("random_mrr"),
    )


def classification(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Accuracy, macro F1 and share of unknown answers from (true_class, predicted); predicted is NULL where it is neither of the classes."""
    group = group or []
    p, t = F.col("predicted"), F.col("true_class")
    cells = {f"{a}{b}": F.count_if((t == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)}
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(p.isNull()).alias("unknown"), F.count_if(t == 0).alias("t0"), F.count_if(t == 1).alias("t1"), *cells.values())
    f1 = lambda a: F.coalesce(2 * F.col(f"c{a}{a}") / F.nullif(F.col(f"c{a}{a}") + F.col(f"c{1 - a}{a}") + F.col(f"t{a}"), F.lit(0)), F.lit(0.0))
    return out.select(*group, "n", "c00", "c01", "c10", "c11", ((F.col("c00") + F.col("c11")) / F.col("n")).alias("accuracy"), ((f1(0) + f1(1)) / 2).alias("macro_f1"), (F.col("unknown") / F.col("n")).alias("unknown_share"))


def calibrated_report(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """One row on a two-class answer read from ``logits`` (id, true_class 0 or 1, split ``cal`` or ``test``, an array of doubles).

    The output that stands for a class (``idx_a``, ``idx_b``) is the largest mean logit of its calibration rows, ties to the
    first. If both are the same the answer is ``ambiguous`` and has no accuracy. A test row is unknown if its largest logit
    belongs to neither; it is counted, and answered by the larger of the two all the same. Without calibration rows of a
    class nothing is answered; NULL logits are left aside. To the driver come the two indexes.
    """
    x = F.col(logits)
    means = rows.where("split = 'cal'").select("true_class", F.posexplode(x).alias("pos", "x")).groupBy("true_class", "pos").agg(F.avg("x").alias("m"))
    best = {r["true_class"]: r["i"] for r in means.groupBy("true_class").agg(F.max_by("pos", F.struct("m", -F.col("pos"))).alias("i")).where("true_class in (0, 1)").collect()}
    a, b = (F.lit(best.get(c)).cast("int") for c in (0, 1))
    there = F.filter(x, lambda v: v.isNotNull())
    size = F.nullif(F.size(there), F.lit(0))
    mean = F.aggregate(there, F.lit(0.0), lambda s, v: s + v) / size
    spread = F.sqrt(F.aggregate(F.transform(there, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / size)
    top = F.array_position(x, F.array_max(x)).cast("int") - 1
    known = a.isNotNull() & b.isNotNull() & (a != b)
    test = rows.where("split = 'test'").select("true_class", F.when(known, F.when(F.get(x, a) >= F.get(x, b), 0).otherwise(1)).alias("predicted"), (~top.isin(best.get(0, -1), best.get(1, -1))).alias("outside"), spread.alias("spread"))
    cells = [F.count_if((F.col("true_class") == t) & (F.col("predicted") == p)).alias(f"c{t}{p}") for t in (0, 1) for p in (0, 1)]
    out = test.agg(F.count("*").alias("n"), F.count_if("outside").alias("unknown"), F.avg("spread").alias("mean_logit_std"), *cells)
    f1 = [F.coalesce(2 * F.col(f"c{c}{c}") / F.nullif(2 * F.col(f"c{c}{c}") + F.col("c01") + F.col("c10"), F.lit(0)), F.lit(0.0)) for c in (0, 1)]
    return out.select(
        a.alias("idx_a"), b.alias("idx_b"), (a == b).alias("ambiguous"), "n", "c00", "c01", "c10", "c11", F.when(known, (F.col("c00") + F.col("c11")) / F.nullif(F.col("n"), F.lit(0))).alias("accuracy"),
        F.when(known, (f1[0] + f1[1]) / 2).alias("macro_f1"), "unknown", (F.col("unknown") / F.nullif(F.col("n"), F.lit(0))).alias("unknown_share"), "mean_logit_std",
    )

"""Summaries, coverage with totals, spectra of covariance and intrinsic dimension."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veclore.operators import ranks
from veclore.runtime import written


def describe(rows: DataFrame, group: list[str], value: Column, quantiles: dict[str, float], within: tuple[int, ...] = (), continuous: bool = False) -> DataFrame:
    """n, mean, min, max, exact interpolated quantiles, and the share of values at most each of ``within``. NULL and NaN are left out.

    The state of a group holds a count per distinct value, as fits lengths, months and counts; for ``continuous`` values the
    quantiles come from running counts over many tasks.
    """
    v = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    held = rows.select(*group, v.alias("__v")).where("__v is not null")
    parts = [F.count("*").alias("n"), F.avg("__v").alias("mean"), F.min("__v").alias("low"), F.max("__v").alias("high")]
    parts += [] if continuous else [F.percentile("__v", q).alias(name) for name, q in quantiles.items()]
    parts += [F.avg((F.col("__v") <= w).cast("double")).alias(f"within_{w}") for w in within]
    out = held.groupBy(*group).agg(*parts)
    if continuous and quantiles:
        spread = ranks.quantiles(held, group, "__v", quantiles)
        both = out.alias("o").join(spread.alias("q"), functools.reduce(Column.__and__, [F.col(f"o.{g}").eqNullSafe(F.col(f"q.{g}")) for g in group], F.lit(True)))
        out = both.select("o.*", *(f"q.{name}" for name in quantiles))
    first = [*group, "n", "mean", "low", "high", *quantiles]
    return out.select(*first, *(c for c in out.columns if c not in first))


def coverage(rows: DataFrame, group: str, flags: dict[str, Column], total: str = "Combined") -> DataFrame:
    """Per group and over all: rows, and for each flag how many rows have it and their share."""
    counts = [F.count("*").alias("n"), *(F.count_if(c).alias(f"{k}_n") for k, c in flags.items()), F.grouping_id().alias("__all")]
    both = rows.rollup(group).agg(*counts)
    shares = [(F.col(f"{k}_n") / F.col("n")).alias(f"{k}_share") for k in flags]
    return both.select(F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col(group)).alias(group), "n", *(f"{k}_n" for k in flags), *shares)


def letters(rows: DataFrame, text: str) -> DataFrame:
    """(letter, n): how often each letter occurs, in upper case. Each text gives one row per different letter to the shuffle."""
    upper = rows.select(F.upper(text).alias("t")).where("t is not null and t != ''")
    each = upper.select("t", F.explode(F.array_distinct(F.split("t", ""))).alias("letter")).where("letter != ''")
    return each.groupBy("letter").agg(F.sum(F.length("t") - F.length(F.replace(F.col("t"), F.col("letter"), F.lit("")))).alias("n"))


# --- covariance and its spectrum -------------------------------------------------------------------------------------


def gram(rows: DataFrame, vector: str, group: str | None = None) -> DataFrame:
    """(group, i, j, value): sums of products of the vector with a leading 1. Each task adds up its batches per group and
    sends one matrix; groups are met in any number."""
    size = f"{vector} is not null"
    kind = dict(rows.dtypes)[group] if group else "string"

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for g, p in b.groupby("grp", dropna=False):
                x = np.stack(p.v.to_numpy())
                x = np.hstack([np.ones((len(x), 1)), x])
                held[g] = held[g] + x.T @ x if g in held else x.T @ x
        for g, m in held.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({"grp": g, "i": i.ravel(), "j": j.ravel(), "value": m.ravel()})

    narrow = rows.where(size).select((F.col(group) if group else F.lit("all")).alias("grp"), F.col(vector).cast("array<double>").alias("v"))
    parts = narrow.mapInPandas(sums, f"grp {kind}, i int, j int, value double")
    return parts.groupBy("grp", "i", "j").agg(F.sum("value").alias("value"))


def covariance(rows: DataFrame, vector: str, group: str | None = None) -> DataFrame:
    """(grp, i, j, cov): sample covariance of every pair of dimensions, counted from 0."""
    g = gram(rows, vector, group)
    sums = g.where("i = 0").select("grp", F.col("j").alias("k"), "value")
    n = sums.where("k = 0").select("grp", F.col("value").alias("n"))
    a, b = sums.select("grp", F.col("k").alias("i"), F.col("value").alias("si")), sums.select("grp", F.col("k").alias("j"), F.col("value").alias("sj"))
    full = g.where("i > 0 and j > 0").join(a, ["grp", "i"]).join(b, ["grp", "j"]).join(n, "grp")
    cov = (F.col("value") - F.col("si") * F.col("sj") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1.0))
    return full.select("grp", (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), cov.alias("cov"))


def spectrum(rows: DataFrame, vector: str, group: str | None = None) -> DataFrame:
    """(grp, n80, n90, n95, n99, participation, total, shares, reached): how many components reach each share of the variance,
    (sum of eigenvalues)^2 / sum of their squares, and of each component, the largest first, its share and the share reached
    with it. One group's matrix (dimensions squared) is solved in one task."""

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        d = int(p.i.max()) + 1
        m = np.zeros((d, d))
        m[p.i, p.j] = p["cov"]
        w = np.clip(np.linalg.eigvalsh((m + m.T) / 2)[::-1], 0, None)
        w = w[w > 1e-12]
        share = w / w.sum() if len(w) else np.array([])
        upto = np.cumsum(share)
        reach = {f"n{int(q * 100)}": [int(np.searchsorted(upto, q) + 1) if len(w) else 0] for q in (0.8, 0.9, 0.95, 0.99)}
        return pd.DataFrame({"grp": [p.grp.iloc[0]], **reach, "participation": [float(w.sum() ** 2 / (w * w).sum()) if len(w) else None], "total": [float(w.sum())], "shares": [share], "reached": [upto]})

    cov = covariance(rows, vector, group)
    return cov.groupBy("grp").applyInPandas(solve, f"grp {dict(cov.dtypes)['grp']}, n80 int, n90 int, n95 int, n99 int, participation double, total double, shares array<double>, reached array<double>")


def principal_axes(rows: DataFrame, vector: str, d: int) -> tuple[list[float], list[list[float]]]:
    """(mean, d leading components) over all rows. Only the matrix of sums comes to the driver: its size is the dimension squared."""
    cells = gram(rows, vector).collect()
    m = np.zeros((max(c["i"] for c in cells) + 1,) * 2)
    for c in cells:
        m[c["i"], c["j"]] = c["value"]
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    _, v = np.linalg.eigh((m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1))
    v = v[:, ::-1][:, :d].T
    v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]  # a sign of its own for each component
    return mean.tolist(), v.tolist()


def standardised(rows: DataFrame, vector: str) -> DataFrame:
    """``vector`` with mean 0 and population standard deviation 1 per dimension; dimensions without spread are only centred."""
    cells = gram(rows, vector).where("i = 0 or i = j").collect()
    n = next(c["value"] for c in cells if c["i"] == c["j"] == 0)
    mean = {c["j"]: c["value"] / n for c in cells if c["i"] == 0 and c["j"] > 0}
    var = {c["i"]: c["value"] / n - mean[c["i"]] ** 2 for c in cells if c["i"] == c["j"] and c["i"] > 0}
    dev = {k: float(np.sqrt(max(v, 0.0))) for k, v in var.items()}
    mu = F.array(*(F.lit(float(mean[k])) for k in sorted(mean)))
    sd = F.array(*(F.lit(dev[k] if dev[k] >= 1e-12 else 1.0) for k in sorted(dev)))
    centred = F.zip_with(F.col(vector).cast("array<double>"), mu, lambda x, m: x - m)
    return rows.withColumn(vector, F.zip_with(centred, sd, lambda x, s: x / s))


def standardised_by(rows: DataFrame, vector: str, group: str, size: int) -> DataFrame:
    """``vector`` with mean 0 and population deviation 1 per dimension inside each group. Means and deviations are one row per
    group, combined before the shuffle."""
    v = F.col(vector).cast("array<double>")
    facts = rows.groupBy(F.col(group).alias("__g")).agg(F.array(*(F.avg(v[i]) for i in range(size))).alias("__mean"), F.array(*(F.stddev_pop(v[i]) for i in range(size))).alias("__sd"))
    centred = F.zip_with(v, "__mean", lambda x, m: x - m)
    out = F.zip_with(centred, "__sd", lambda x, s: F.when(s < 1e-12, x).otherwise(x / s))
    return rows.join(facts, F.col(group) == F.col("__g")).withColumn(vector, out).select(*rows.columns)


# --- two-neighbour intrinsic dimension -------------------------------------------------------------------------------


def two_neighbors(neighbors: DataFrame, group: str = "grp") -> DataFrame:
    """(group, id, r1, r2, mu) of every query with two neighbours in a neighbour table; ``mu`` is NULL where it isn't valid
    (0 < r1 < r2)."""
    two = neighbors.where("rank <= 2").groupBy(group, F.col("query_id").alias("id")).agg(F.min("distance").alias("r1"), F.max("distance").alias("r2"), F.count("*").alias("c"))
    return two.where("c = 2").select(group, "id", "r1", "r2", F.when((F.col("r1") > 1e-12) & (F.col("r2") > F.col("r1")), F.col("r2") / F.col("r1")).alias("mu"))


def two_neighbor_ratios(neighbors: DataFrame, group: str = "grp") -> DataFrame:
    """Only the valid ones of ``two_neighbors``."""
    return two_neighbors(neighbors, group).where("mu is not null")


def _in_order(held: DataFrame, group: str) -> DataFrame:
    """With ``__i``, the place of each row from 1 by (mu, id) in its group, and ``__n``, the group's rows."""
    same = Window.partitionBy(group, "mu")
    placed = ranks.average_ranks(held, [group], "mu", name="__r").withColumn("__t", F.row_number().over(same.orderBy("id"))).withColumn("__s", F.count("*").over(same))
    placed = placed.withColumn("__i", F.col("__r") - (F.col("__s") - 1) / 2.0 + F.col("__t") - 1)
    return placed.join(held.groupBy(group).agg(F.count("*").alias("__n")), group).drop("__r", "__t", "__s")


def two_neighbor_dimension(ratios: DataFrame, group: str = "grp", trim: float = 0.0, least: int = 10) -> DataFrame:
    """Per group: the slope of -log(1 - F) on log mu with F = (i - .5) / n, its fit, the rows used, those left out as invalid
    (mu NULL) and as trimmed, and the range of mu. ``trim`` cuts that share of the ratios at either end (ends included) of
    groups with more than ten; groups under ``least`` ratios give NULL."""
    held = written(ratios, "ratios")
    facts = held.groupBy(group).agg(F.count("mu").alias("__valid"), F.count_if(F.col("mu").isNull()).alias("invalid"))
    held = held.where("mu is not null")
    if trim > 0:
        ends = held.groupBy(group).agg(F.count("*").alias("__c")).join(ranks.quantiles(held, [group], "mu", {"__lo": trim, "__hi": 1 - trim}), group)
        held = written(held.join(ends, group).where("__c <= 10 or mu between __lo and __hi").drop("__c", "__lo", "__hi"), "ratios")
    curve = _in_order(held, group).select(group, "mu", "__i", "__n", F.log("mu").alias("x"), (-F.log1p(-(F.col("__i") - 0.5) / F.col("__n"))).alias("y"))
    fit = curve.groupBy(group).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("dimension"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.min("mu").alias("mu_min"), F.avg(F.when(F.col("__i").between(F.col("__n") / 2, F.col("__n") / 2 + 1), F.col("mu"))).alias("mu_median"), F.max("mu").alias("mu_max"))
    enough = F.col("n") >= least
    out = facts.join(fit, group, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(group, "n", "invalid", (F.col("__valid") - F.col("n")).alias("trimmed"), *(F.when(enough, F.col(c)).alias(c) for c in ("dimension", "intercept", "r2")), "mu_min", "mu_median", "mu_max")


def two_neighbor_script(pairs: DataFrame, group: str = "grp", trim: float = 0.05, least: int = 10) -> DataFrame:
    """(group, n, dimension), the variant that keeps all rows: mu is 1 where r1 is 0, the share ``trim`` is cut by place at
    either end, F = i / n, and only mu > 1.001 with F < .9999 are fitted. ``pairs``: group, id, r1, r2."""
    mu = F.when(F.col("r1") > 1e-10, F.col("r2") / F.col("r1")).otherwise(1.0)
    placed = _in_order(written(pairs.select(group, "id", mu.alias("mu")), "ratios"), group)
    cut = F.floor(trim * F.col("__n"))
    kept = placed.withColumn("__cut", cut).where("__i > __cut and __i <= __n - __cut").select(group, "mu", ((F.col("__i") - F.col("__cut")) / (F.col("__n") - 2 * F.col("__cut"))).alias("f"))
    curve = kept.where((F.col("mu") > 1.001) & (F.col("f") < 0.9999)).select(group, F.log("mu").alias("x"), (-F.log(1 - F.col("f"))).alias("y"))
    fit = curve.groupBy(group).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("dimension"))
    return fit.select(group, "n", F.when(F.col("n") >= least, F.col("dimension")).alias("dimension"))

"""Monthly series: centroids, context windows, lags, and rolling-origin forecasts of linear models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Chi-squared quantiles at 50, 90 and 95 % for 1..10 degrees of freedom.
CHI2 = {
    1: (0.454936, 2.705543, 3.841459), 2: (1.386294, 4.605170, 5.991465), 3: (2.365974, 6.251389, 7.814728), 4: (3.356694, 7.779440, 9.487729), 5: (4.351460, 9.236357, 11.070498),
    6: (5.348121, 10.644641, 12.591587), 7: (6.345811, 12.017037, 14.067140), 8: (7.344121, 13.361566, 15.507313), 9: (8.342833, 14.683657, 16.918978), 10: (9.341818, 15.987179, 18.307038),
}
NOMINAL = (0.5, 0.9, 0.95)


def monthly_centroids(rows: DataFrame, vector: str = "vector", group: str = "grp", month: str = "month_index") -> DataFrame:
    """(group, month, n, centroid): mean vector of each month. Dimensions are averaged as rows, combined before the shuffle."""
    flat = rows.where(f"{vector} is not null and {month} is not null").select(group, month, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    means = flat.groupBy(group, month, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    out = means.groupBy(group, month).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("c"))  # one entry per dimension
    return out.select(group, month, "n", F.transform("c", lambda s: s["m"]).alias("centroid"))


def lagged(series: DataFrame, column: str, group: str = "grp", month: str = "month_index", consecutive: bool = True) -> DataFrame:
    """``series`` with ``lag1`` and ``lag2`` of ``column``; only values of the months directly before, unless not ``consecutive``.
    A group's window holds one row per month."""
    w = Window.partitionBy(group).orderBy(month)
    out = series
    for i in (1, 2):
        value = F.lag(column, i).over(w)
        out = out.withColumn(f"lag{i}", F.when(F.col(month) - F.lag(month, i).over(w) == i, value) if consecutive else value)
    return out


def context_windows(rows: DataFrame, least: int = 5, length: int = 3, group: str = "grp", month: str = "month_index", key: str = "id") -> DataFrame:
    """(group, target month, target_id, target_n, context_1..n: month and id): the ``length`` kept months before each kept
    month. Months under ``least`` rows are dropped first, so contexts may skip calendar months; a month is stood for by its smallest id."""
    kept = rows.where(f"{month} is not null").groupBy(group, month).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where(F.col("n") >= least)
    w = Window.partitionBy(group).orderBy(month)
    cols = [c for i in range(length, 0, -1) for c in (F.lag(month, i).over(w).alias(f"month_{i}"), F.lag("first_id", i).over(w).alias(f"id_{i}"))]
    return kept.select(group, F.col(month).alias("target_month"), F.col("first_id").alias("target_id"), F.col("n").alias("target_n"), *cols).where(f"month_{length} is not null")


def expanding_mean(series: DataFrame, value: str, group: str = "grp", month: str = "month_index") -> DataFrame:
    """Mean of all earlier months, for each month."""
    w = Window.partitionBy(group).orderBy(month).rangeBetween(Window.unboundedPreceding, -1)
    return series.withColumn("earlier_mean", F.avg(value).over(w))


def persistence_errors(series: DataFrame, value: str, group: str = "grp", month: str = "month_index") -> DataFrame:
    """(group, model, n, rmse, mae, ratio) of two forecasts of a scalar series that need no fit: last value, and last value plus last step.
    ``ratio`` is the error over that of the last value."""
    steps = lagged(series, value, group, month).where("lag1 is not null and lag2 is not null")
    models = F.array(F.struct(F.lit("persistence").alias("model"), (F.col(value) - F.col("lag1")).alias("e")), F.struct(F.lit("velocity").alias("model"), (F.col(value) - 2 * F.col("lag1") + F.col("lag2")).alias("e")))
    errors = steps.select(group, F.explode(models).alias("m")).select(group, "m.model", "m.e")
    out = errors.groupBy(group, "model").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"))
    base = F.max(F.when(F.col("model") == "persistence", F.col("rmse"))).over(Window.partitionBy(group))
    return out.withColumn("ratio", F.col("rmse") / F.nullif(base, F.lit(0.0)))


def ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients (inputs + 1, outputs) with an intercept that isn't penalised."""
    z = np.hstack([np.ones((len(x), 1)), x])
    p = penalty * np.eye(z.shape[1])
    p[0, 0] = 0.0
    return np.linalg.lstsq(z.T @ z + p, z.T @ y, rcond=None)[0]


def regular_covariance(e: np.ndarray, d: int, reg: float, kind: str = "full", inflation: float = 1.0) -> np.ndarray:
    """Covariance of residuals, its diagonal only if ``kind`` says so, plus ``reg`` on the diagonal, times ``inflation``."""
    q = np.atleast_2d(np.cov(e.T)) if len(e) >= 2 else np.zeros((d, d))
    if kind == "diagonal":
        q = np.diag(np.diag(q))
    return (q + reg * np.eye(d)) * inflation


def increment_covariance(e: np.ndarray, eps: float) -> np.ndarray:
    """Covariance of increments plus ``eps`` on the diagonal, scaled by the mean variance where that is above 1."""
    q = np.atleast_2d(np.cov(e.T))
    return q + np.eye(len(q)) * eps * max(np.trace(q) / len(q), 1.0)


def gaussian(e: np.ndarray, q: np.ndarray) -> tuple[float, float]:
    """(log density, squared Mahalanobis distance) of one error."""
    m = float(e @ np.linalg.solve(q, e))
    return float(-0.5 * (m + np.linalg.slogdet(q)[1] + len(e) * np.log(2 * np.pi))), m


def rolling_forecasts(series: DataFrame, first_target: int, last_target: int, dims: list[int], penalty: float = 1e-3, reg: float = 1e-6, kind: str = "full", inflation: float = 1.0, group: str = "grp", month: str = "month_index", vector: str = "centroid") -> DataFrame:
    """(group, dim, target, model, squared_error, absolute_error, distance, nll, m2, trace, logdet): each target month forecast from the months before it
    by persistence, velocity, VAR(1), VAR(2), and Gaussian walks (covariance as asked for, and scaled to the increments) on the first ``dim`` elements of the monthly vectors.

    Every (group, target) pair is a group of its own, whose rows are the months up to the target: it is refitted from them alone.
    """
    held = series.where(f"{vector} is not null").select(F.col(group).alias("grp"), F.col(month).cast("int").alias("m"), F.col(vector).alias("v"))
    targets = held.where(F.col("m").between(first_target, last_target)).select("grp", F.col("m").alias("target"))
    past = targets.join(held, "grp").where("m <= target")

    def forecast(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("m")
        target, at = int(p.target.iloc[0]), dict(zip(p.m, p.v))
        rows = []
        if target - 1 in at and target - 2 in at:
            for d in dims:
                x = {m: np.asarray(v[:d], float) for m, v in at.items()}
                old = [m for m in sorted(x) if m < target]
                one = [(x[m - 1], x[m]) for m in old if m - 1 in x]
                two = [(np.concatenate([x[m - 1], x[m - 2]]), x[m]) for m in old if m - 1 in x and m - 2 in x]
                last, before, true = x[target - 1], x[target - 2], x[target]
                made = {"persistence": (last, None), "velocity": (2 * last - before, None)}
                if len(one) >= 3:
                    step = np.array([b - a for a, b in one])
                    made["walk"] = (last + step.mean(axis=0), regular_covariance(step, d, reg, kind, inflation))
                    made["increments"] = (last + step.mean(axis=0), increment_covariance(step, reg))
                for name, pairs, source in (("var1", one, last), ("var2", two, np.concatenate([last, before]))):
                    if len(pairs) >= len(source) + 2:
                        a, b = np.array([q[0] for q in pairs]), np.array([q[1] for q in pairs])
                        c = ridge(a, b, penalty)
                        made[name] = (np.concatenate([[1.0], source]) @ c, regular_covariance(b - np.hstack([np.ones((len(a), 1)), a]) @ c, d, reg, kind, inflation))
                for name, (guess, q) in made.items():
                    e = true - guess
                    nll, m2 = (None, None) if q is None else (lambda g: (-g[0], g[1]))(gaussian(e, q))
                    size = (None, None) if q is None else (float(np.trace(q)), float(np.linalg.slogdet(q)[1]))
                    rows.append((p.grp.iloc[0], d, target, name, float((e * e).mean()), float(np.abs(e).mean()), float(np.sqrt((e * e).sum())), nll, m2, *size))
        return pd.DataFrame(rows, columns=["grp", "dim", "target", "model", "squared_error", "absolute_error", "distance", "nll", "m2", "trace", "logdet"])

    kind_of = dict(held.dtypes)["grp"]
    return past.groupBy("grp", "target").applyInPandas(forecast, f"grp {kind_of}, dim int, target int, model string, squared_error double, absolute_error double, distance double, nll double, m2 double, trace double, logdet double")


def forecast_report(errors: DataFrame) -> DataFrame:
    """Per group, dimension and model: RMSE, MAE, mean distance, ratio to persistence, mean and total NLL, mean trace and log-determinant, coverage of the 50, 90 and 95 % regions and the summed calibration error."""
    table = F.create_map(*(x for d, q in CHI2.items() for x in (F.lit(d), F.array(*map(F.lit, q)))))
    inside = [F.avg(F.when(F.col("m2").isNotNull(), (F.col("m2") <= table[F.col("dim")][i]).cast("double"))).alias(f"cover_{int(p * 100)}") for i, p in enumerate(NOMINAL)]
    out = errors.groupBy("grp", "dim", "model").agg(F.count("*").alias("targets"), F.sqrt(F.avg("squared_error")).alias("rmse"), F.avg("absolute_error").alias("mae"), F.avg("distance").alias("mean_distance"), F.avg("nll").alias("mean_nll"), F.sum("nll").alias("total_nll"), F.avg("trace").alias("mean_trace"), F.avg("logdet").alias("mean_logdet"), *inside)
    base = F.max(F.when(F.col("model") == "persistence", F.col("rmse"))).over(Window.partitionBy("grp", "dim"))
    off = sum((F.abs(F.col(f"cover_{int(p * 100)}") - p) for p in NOMINAL), F.lit(0.0))
    return out.withColumn("ratio", F.col("rmse") / F.nullif(base, F.lit(0.0))).withColumn("improvement", 1 - F.col("ratio")).withColumn("calibration_error", off)


def best_rows(rows: DataFrame, group: list[str], metric: str, largest: bool = False) -> DataFrame:
    """The row of each group with the smallest (or largest) finite metric; ties go to the smaller other columns."""
    others = [c for c in rows.columns if c not in (*group, metric)]
    good = rows.where(F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(metric) < float("inf")))
    order = F.struct((-F.col(metric) if largest else F.col(metric)).alias("m"), *others)
    return good.groupBy(*group).agg(F.min(F.struct(order.alias("o"), metric)).alias("b")).select(*group, *(f"b.o.{c}" for c in others), F.col(f"b.{metric}").alias(metric))

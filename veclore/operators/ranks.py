"""Ranks, samples and pairs inside groups without putting a whole group into one task."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(key: Column, seed: int | str = 0) -> Column:
    """A reproducible random order: sha1 of seed and id, the same in any SQL engine."""
    return F.sha1(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def _same(group: list[str], left: str, right: str) -> Column:
    return functools.reduce(Column.__and__, [F.col(f"{left}.{g}").eqNullSafe(F.col(f"{right}.{g}")) for g in group], F.lit(True))


def _places(rows: DataFrame, group: list[str], value: str, buckets: int = 64) -> DataFrame:
    """(group, value, __n, __upto, __total) of each distinct value: its rows, the rows up to it, and those of the group.

    The group's quantiles cut its distinct values into buckets; running sums inside a bucket are shifted by the rows of the
    lower ones. Ties, however many, are one row.
    """
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("__n"))
    cuts = counts.groupBy(*group).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 2000).alias("__cuts"))
    placed = counts.alias("r").join(cuts.alias("c"), _same(group, "r", "c")).select("r.*", F.size(F.filter("c.__cuts", lambda x: x < F.col(f"r.{value}"))).alias("__bucket"))
    sizes = placed.groupBy(*group, "__bucket").agg(F.sum("__n").alias("__rows"))
    below = F.sum("__rows").over(Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("__below", F.coalesce(below, F.lit(0))).withColumn("__total", F.sum("__rows").over(Window.partitionBy(*group))).drop("__rows")
    upto = F.sum("__n").over(Window.partitionBy(*group, "__bucket").orderBy(value))
    ranked = placed.withColumn("__in", upto).alias("p").join(sizes.alias("s"), _same([*group, "__bucket"], "p", "s"))
    return ranked.select(*(F.col(f"p.{c}") for c in (*group, value)), "__n", (F.col("__below") + F.col("__in")).alias("__upto"), "__total")


def quantiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column per share): exact interpolated quantiles of the values of a group, NULL and NaN left out. No task holds the
    values of a group: those on either side of each place are picked by their running counts. Groups without values have no row."""
    held = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*group, F.col(value).cast("double").alias("__v"))
    place = {k: (F.col("__total") - 1) * F.lit(float(q)) for k, q in shares.items()}
    at = lambda p: F.max(F.when((F.col("__upto") - F.col("__n") <= p) & (p < F.col("__upto")), F.col("__v")))
    ends = [c for k in shares for c in (at(F.floor(place[k])).alias(f"__a_{k}"), at(F.ceil(place[k])).alias(f"__b_{k}"))]
    found = _places(held, group, "__v").groupBy(*group).agg(F.max("__total").alias("__total"), *ends)
    return found.select(*group, *((F.col(f"__a_{k}") + (F.col(f"__b_{k}") - F.col(f"__a_{k}")) * (place[k] - F.floor(place[k]))).alias(k) for k in shares))


def average_ranks(rows: DataFrame, group: list[str], value: str, buckets: int = 64, name: str = "rank") -> DataFrame:
    """``rows`` with the average rank (ties share it) of ``value`` in its group; NULL values get none.

    Ranks are counted on the distinct values and how often each occurs (``_places``).
    """
    valued = rows.where(F.col(value).isNotNull())
    ranked = _places(valued, group, value, buckets).select(*group, value, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name))
    return valued.alias("r").join(ranked.alias("k"), _same([*group, value], "r", "k")).select("r.*", name)


def spearman(rows: DataFrame, group: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Per group: rows with both values and rows without, the Spearman correlation with average ranks (NULL under ``least``
    rows), and mean and population deviation of both values."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    both = good(x) & good(y)
    held = rows.groupBy(*group).agg(F.count_if(both).alias("pairs"), F.count_if(~F.coalesce(both, F.lit(False))).alias("omitted"), *(f(F.when(both, F.col(c).cast("double"))).alias(f"{n}_{k}") for n, c in (("x", x), ("y", y)) for k, f in (("mean", F.avg), ("sd", F.stddev_pop))))
    ranked = average_ranks(average_ranks(rows.where(both), group, x, name="__rx"), group, y, name="__ry")
    rho = ranked.groupBy(*group).agg(F.corr("__rx", "__ry").alias("rho"))
    out = held.alias("h").join(rho.alias("k"), _same(group, "h", "k"), "left")
    return out.select(*(F.col(f"h.{g}") for g in group), "pairs", "omitted", F.when(F.col("pairs") >= least, F.col("rho")).alias("rho"), "x_mean", "x_sd", "y_mean", "y_sd")


def numbered(rows: DataFrame, group: str, key: str, seed: int | str = 0, lead: str | None = None) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in the group's hashed order, and ``size``, the rows of the group. With ``lead``
    that column comes first in the order.

    The first digits of the hash make 4,096 ordered buckets (of each ``lead``): places are counted inside a bucket and
    shifted by the rows of the buckets before it, so no group is sorted in one place. NULL groups and keys have no place.
    """
    held = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull()).withColumn("__h", hash_order(F.col(key), seed)).withColumn("__b", F.left("__h", F.lit(3)))
    by = [group, *([lead] if lead else []), "__b"]
    sizes = held.groupBy(*by).agg(F.count("*").alias("__n"))
    order = [*([lead] if lead else []), "__b"]
    before = F.sum("__n").over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).withColumn("size", F.sum("__n").over(Window.partitionBy(group))).drop("__n")
    inside = held.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy("__h", key)) - 1)
    return inside.join(sizes, by).select(*rows.columns, (F.col("__before") + F.col("__i")).alias("at"), "size")


def rotated(at: Column, size: Column, replicate: Column) -> Column:
    """The place whose value a row gets in a replicate: the hashed order is turned by a shift of its own, never by none. A turn
    of a random order is a random permutation, and needs no sort per replicate."""
    return F.when(size > 1, F.pmod(at + 1 + F.pmod(replicate * 7919, size - 1), size)).otherwise(at)


def smallest_hashes(rows: DataFrame, group: list[str], key: str, n: int, seed: int | str = 0) -> DataFrame:
    """At most ``n`` rows of each group, those with the smallest hash order. Only ``n`` rows per group and task reach the shuffle."""
    order = Window.partitionBy(*group).orderBy("__h", key)
    return rows.withColumn("__h", hash_order(F.col(key), seed)).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__h", "__n")


def half_split(rows: DataFrame, group: list[str], key: str, seed: int | str = 0) -> DataFrame:
    """``split``: the half with the smaller hash orders (rounded down) is ``cal``, the rest ``test``."""
    placed = numbered(rows, group[0], key, seed) if len(group) == 1 else numbered(rows.withColumn("__g", F.to_json(F.struct(*group))), "__g", key, seed)
    return placed.withColumn("split", F.when(F.col("at") < F.floor(F.col("size") / 2), "cal").otherwise("test")).select(*rows.columns, "split")


def sampled_pairs(rows: DataFrame, group: str, key: str, per_row: int = 2, seed: int = 0, unique: bool = False) -> DataFrame:
    """(group, i, j, draw): ``per_row`` partners of every row, others of its group, at hashed distances in a hashed order.

    A pair is a pair of equi-joins on (group, place). Pairs may repeat, as draws with replacement do; with ``unique`` each
    unordered pair comes once, with i < j and its first draw. A group of one row has none.
    """
    held = rows.select(F.col(group).alias("grp"), F.col(key).alias("id"))
    placed = numbered(held, "grp", "id", seed)
    drawn = placed.where("size > 1").select("grp", F.col("id").alias("i"), "at", "size", F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("draw"))
    step = F.pmod(F.col("at") * 7919 + F.col("draw") * 104729 + seed, F.col("size") - 1) + 1
    drawn = drawn.select("grp", "i", "draw", F.pmod(F.col("at") + step, F.col("size")).alias("at"))
    pairs = drawn.join(placed.select("grp", "at", F.col("id").alias("j")), ["grp", "at"]).select("grp", "i", "j", "draw")
    if not unique:
        return pairs
    return pairs.groupBy("grp", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("draw").alias("draw"))


def permuted(rows: DataFrame, group: str, key: str, value: str, replicate: int = 0) -> DataFrame:
    """(group, key, value): the values of each group handed round (see ``rotated``)."""
    placed = numbered(rows.select(group, key, value), group, key)
    there = placed.select(group, "at", F.col(value).alias("__v"))
    return placed.select(group, key, rotated(F.col("at"), F.col("size"), F.lit(replicate)).alias("at")).join(there, [group, "at"]).select(group, key, F.col("__v").alias(value))

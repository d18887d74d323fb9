"""Do neighbours share labels? Precision at k, its baselines and controls."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veclore.operators.ranks import numbered, rotated
from veclore.runtime import written


def precision(neighbors: DataFrame, labels: DataFrame, ks: list[int], group: str = "grp") -> DataFrame:
    """(group, k, queries, mean_precision, median_precision, mean_labelled): share of a query's labelled neighbours with its own label.

    ``labels``: id, label. Only labelled queries with at least one labelled neighbour count. One neighbour table serves all ks.
    """
    named = labels.where("label is not null").select("id", "label").distinct()
    q, n = named.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), named.select(F.col("id").alias("neighbor_id"), F.col("label").alias("nl"))
    hits = neighbors.join(q, "query_id").join(n, "neighbor_id").withColumn("same", (F.col("ql") == F.col("nl")).cast("double"))
    each = hits.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k").groupBy(group, "k", "query_id").agg(F.avg("same").alias("p"), F.count("*").alias("m"))
    return each.groupBy(group, "k").agg(F.count("*").alias("queries"), F.avg("p").alias("mean_precision"), F.percentile("p", 0.5).alias("median_precision"), F.avg("m").alias("mean_labelled"))


def label_shares(rows: DataFrame, group: str = "grp") -> DataFrame:
    """(group, labelled, classes, largest_share, expected): the chance that two different labelled rows of a group agree is
    the precision that random neighbours are expected to have."""
    counts = rows.where("label is not null").groupBy(group, "label").agg(F.count("*").alias("n"))
    whole = counts.groupBy(group).agg(F.sum("n").alias("labelled"), F.count("*").alias("classes"), F.max("n").alias("top"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"))
    pairs = F.nullif(F.col("labelled") * (F.col("labelled") - 1), F.lit(0))
    return whole.select(group, "labelled", "classes", (F.col("top") / F.col("labelled")).alias("largest_share"), (F.col("agree") / pairs).alias("expected"))


def permutation_control(neighbors: DataFrame, rows: DataFrame, k: int, replicates: int, group: str = "grp") -> DataFrame:
    """(group, replicates, control_mean, control_sd, control_p05, control_p95): precision at k when the labels of each group are
    handed round, the neighbour graph fixed. ``rows``: group, id, label.

    Labelled rows are numbered once; the edges of the graph are repeated per replicate and look up the labels at the turned
    places of their two ends, so no replicate sorts or numbers the rows again.
    """
    placed = written(numbered(rows.where("label is not null").select(group, "id", "label"), group, "id"), "places")
    ends = lambda name: placed.select(F.col(group), F.col("id").alias(name), F.col("at").alias(f"{name}_at"), *(["size"] if name == "query_id" else []))
    edges = neighbors.where(F.col("rank") <= k).select(group, "query_id", "neighbor_id").join(ends("query_id"), [group, "query_id"]).join(ends("neighbor_id"), [group, "neighbor_id"])
    runs = edges.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    for name in ("query_id", "neighbor_id"):
        runs = runs.withColumn("at", rotated(F.col(f"{name}_at"), F.col("size"), F.col("replicate"))).join(placed.select(group, "at", F.col("label").alias(f"{name}_label")), [group, "at"]).drop("at")
    each = runs.groupBy(group, "replicate", "query_id").agg(F.avg((F.col("query_id_label") == F.col("neighbor_id_label")).cast("double")).alias("p"))
    means = each.groupBy(group, "replicate").agg(F.avg("p").alias("m"))  # one row per group and replicate
    return means.groupBy(group).agg(F.count("*").alias("replicates"), F.avg("m").alias("control_mean"), F.stddev_samp("m").alias("control_sd"), F.percentile("m", 0.05).alias("control_p05"), F.percentile("m", 0.95).alias("control_p95"))


def random_neighbors(queries: DataFrame, rows: DataFrame, k: int, seed: int = 0, group: str = "grp") -> DataFrame:
    """(group, query_id, rank, neighbor_id): k different rows of the query's group, never itself, that stand behind a hashed
    place of a hashed order; all others where there are fewer. Queries that are no rows have none."""
    placed = numbered(rows.select(group, "id"), group, "id", seed)
    asked = placed.join(queries.select("id").distinct(), "id", "left_semi").where("size > 1")
    drawn = asked.select(group, F.col("id").alias("query_id"), F.col("at").alias("own"), "size", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), (F.col("size") - 1).cast("int")))).alias("rank"))
    step = F.pmod(F.col("own") * 7919 + seed + F.col("rank"), F.col("size") - 1) + 1
    drawn = drawn.select(group, "query_id", "rank", F.pmod(F.col("own") + step, F.col("size")).alias("at"))
    return drawn.join(placed.select(group, "at", F.col("id").alias("neighbor_id")), [group, "at"]).select(group, "query_id", "rank", "neighbor_id")


def label_baseline(rows: DataFrame, queries: DataFrame, k: int, seeds: tuple[int, ...], group: str = "grp") -> DataFrame:
    """(group, random_mean, random_sd): precision at k of random labelled rows of the group, mean and sample deviation over seeds."""
    labelled = rows.where("label is not null").select(group, "id", "label")
    each = [precision(random_neighbors(queries, labelled, k, s, group), labelled, [k], group).select(group, F.lit(s).alias("seed"), "mean_precision") for s in seeds]
    return functools.reduce(DataFrame.unionByName, each).groupBy(group).agg(F.avg("mean_precision").alias("random_mean"), F.stddev_samp("mean_precision").alias("random_sd"))


def stratified_baseline(neighbors: DataFrame, rows: DataFrame, k: int, width: int, seeds: tuple[int, ...], group: str = "grp", month: str = "month_index") -> DataFrame:
    """(group, eligible, precision, random_mean, random_sd, enrichment): precision at k of the labelled queries that have at least
    k other labelled rows within ``width`` months, against k random ones of these. ``rows``: group, id, label, month.

    Labelled rows are numbered by month and hash, so the months around a query are one stretch of places, and its draws are
    places spread over that stretch.
    """
    labelled = rows.where(F.col("label").isNotNull() & F.col(month).isNotNull()).select(group, "id", "label", F.col(month).alias("m"))
    months = labelled.groupBy(group, "m").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy("m")
    total = lambda low, high: F.coalesce(F.sum("n").over(w.rangeBetween(low, high)), F.lit(0))
    stretch = months.select(group, "m", total(Window.unboundedPreceding, -width - 1).alias("low"), total(-width, width).alias("there"))
    asked = labelled.join(neighbors.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")
    runs = []
    for s in seeds:
        placed = written(numbered(labelled, group, "id", s, lead="m"), "places")
        mine = placed.join(asked.select("id"), "id", "left_semi").join(stretch, [group, "m"]).where(F.col("there") > k)
        drawn = mine.select(group, F.col("id").alias("query_id"), F.col("label").alias("ql"), (F.col("at") - F.col("low")).alias("own"), "low", "there", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("t"))
        step = F.pmod(F.col("own") * 7919 + s + F.col("t") * F.floor((F.col("there") - 1) / k), F.col("there") - 1) + 1
        drawn = drawn.select(group, "query_id", "ql", (F.col("low") + F.pmod(F.col("own") + step, F.col("there"))).alias("at"))
        hits = drawn.join(placed.select(group, "at", F.col("label").alias("nl")), [group, "at"])
        each = hits.groupBy(group, "query_id").agg(F.avg((F.col("ql") == F.col("nl")).cast("double")).alias("p"))
        runs.append(each.groupBy(group).agg(F.count("*").alias("eligible"), F.avg("p").alias("p")))
    eligible = asked.join(stretch, [group, "m"]).where(F.col("there") > k).select(F.col("id").alias("query_id"))
    true = precision(neighbors.join(eligible, "query_id", "left_semi"), rows, [k], group).select(group, F.col("mean_precision").alias("precision"))
    random = functools.reduce(DataFrame.unionByName, runs).groupBy(group).agg(F.max("eligible").alias("eligible"), F.avg("p").alias("random_mean"), F.stddev_samp("p").alias("random_sd"))
    return random.join(true, group, "left").withColumn("enrichment", F.col("precision") / F.nullif(F.col("random_mean"), F.lit(0.0)))


def month_gaps(neighbors: DataFrame, months: DataFrame, group: str = "grp") -> DataFrame:
    """(group, query_id, rank, gap): months between a query and its neighbour. ``months``: id, month_index."""
    q, n = months.select(F.col("id").alias("query_id"), F.col("month_index").alias("mq")), months.select(F.col("id").alias("neighbor_id"), F.col("month_index").alias("mn"))
    return neighbors.join(q, "query_id").join(n, "neighbor_id").select(group, "query_id", "rank", F.abs(F.col("mq") - F.col("mn")).alias("gap"))

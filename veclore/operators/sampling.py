"""Adaptive stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veclore.operators.ranks import hash_order


def stratified(rows: DataFrame, group: str, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each group spread evenly over its strata: small strata give all they have, the others share the rest
    equally, the last places go to the larger strata. Rows of a stratum are taken in hashed order.

    Quotas come from a window over strata (one row each). NULL strata are a stratum of their own; a group with fewer than
    ``n`` rows is taken whole.
    """
    counts = rows.groupBy(group, stratum).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(group).orderBy("__c", stratum)
    whole = Window.partitionBy(group)
    m = counts.withColumn("__r", F.row_number().over(w)).withColumn("__m", F.count("*").over(whole)).withColumn("__below", F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fits = F.col("__below") + F.col("__c") * (F.col("__m") - F.col("__r") + 1) <= n  # all strata up to here can be taken whole
    m = m.withColumn("__whole", fits).withColumn("__left", F.lit(n) - F.coalesce(F.sum(F.when(F.col("__whole"), F.col("__c"))).over(whole), F.lit(0)))
    m = m.withColumn("__open", F.count_if(~F.col("__whole")).over(whole)).withColumn("__last", F.col("__m") - F.col("__r"))
    even = F.floor(F.col("__left") / F.col("__open")) + (F.col("__last") < F.col("__left") % F.col("__open")).cast("int")
    quota = m.select(group, F.col(stratum).alias("__s"), F.when(F.col("__whole"), F.col("__c")).otherwise(F.least(even, F.col("__c"))).alias("__q"))
    joined = rows.alias("r").join(quota.alias("q"), (F.col(f"r.{group}") == F.col(f"q.{group}")) & F.col(f"r.{stratum}").eqNullSafe(F.col("q.__s"))).select("r.*", "__q")
    order = Window.partitionBy(group, stratum).orderBy(F.col("__h"), key)
    ranked = joined.withColumn("__h", hash_order(F.col(key), seed)).withColumn("__n", F.row_number().over(order))
    return ranked.where(F.col("__n") <= F.col("__q")).select(*rows.columns)

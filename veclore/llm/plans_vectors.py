"""Queries of problems 2 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclore.llm.clusters import clusters
from veclore.llm.curves import nearest
from pyspark.sql.window import Window

from veclore.runtime import written
from veclore.tables import accession, current_rows, known_type, label_key, table, usable


#: Members from which on a cell counts as dense.
DENSE = 3


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """id, types and embeddings of the current rows with a usable vector."""
    rows = current_rows(table(spark, folder, "embedding_cache"), "id", "types", "embeddings", "epi_isl", "loaded_at")
    return rows.where(usable(F.col("embeddings"))).withColumn("types", known_type(F.col("types")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    probes = table(spark, folder, "neighbor_probes").select("id").distinct().withColumn("asks", F.lit(True))
    rows = vectors(spark, folder).join(probes, "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    return nearest(rows, k=10).select("id", "neighbor_id")


def p2_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest of every row whose id is divisible by 100, against all rows of its type."""
    rows = vectors(spark, folder).withColumn("asks", F.col("id") % 100 == 0)
    return nearest(rows, k=10).select("id", "rank", "neighbor_id", F.round("distance", 6).alias("distance"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    members, _ = clusters(vectors(spark, folder).select("id", "embeddings"))
    return members.where("n >= 5").select("id", "cluster_id")


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster of at least 5: its size and cells, those that are dense and the members in them, the three members nearest to the middle of its densest cell, its commonest label and all its labels with the members that carry each."""
    rows = written(vectors(spark, folder).select("id", "embeddings", accession(F.col("epi_isl")).alias("epi")), "vectors")
    members, cells = clusters(rows.select("id", "embeddings"))
    members = written(members.where("n >= 5"), "members")
    densest = cells.groupBy("cluster_id").agg(F.max_by(F.struct("cell", "low", "high"), F.struct("n", -F.col("cell"))).alias("d"), F.count("*").alias("cells"), F.count_if(F.col("n") >= DENSE).alias("dense_cells"), F.sum(F.when(F.col("n") >= DENSE, F.col("n")).otherwise(0)).alias("in_dense"))
    middle = F.zip_with("d.low", "d.high", lambda a, b: (a + b) / 2)
    off = F.aggregate(F.zip_with("x", "middle", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    densest = densest.where(F.col("d").isNotNull()).select("cluster_id", F.col("d.cell").alias("cell"), middle.alias("middle"), "cells", "dense_cells", "in_dense")
    inner = members.join(densest, ["cluster_id", "cell"]).select("cluster_id", "id", off.alias("off"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("off", "id"))
    typical = inner.withColumn("rank", rank).where("rank <= 3").groupBy("cluster_id").agg(*(F.max(F.when(F.col("rank") == i, F.col("id"))).alias(f"typical_{i}") for i in (1, 2, 3)))
    meta = table(spark, folder, "clade_metadata").select(accession(F.coalesce(F.nullif(F.trim("epi_isl"), F.lit("")), "isolate_id")).alias("epi"), label_key(F.col("clade")).alias("clade"))
    meta = meta.where("epi is not null and clade is not null").distinct()
    named = written(members.select("id", "cluster_id").join(rows.select("id", "epi"), "id").join(meta, "epi").select("cluster_id", "id", "clade"), "named")
    votes = named.groupBy("cluster_id", "clade").agg(F.count("*").alias("votes"))
    found = F.sort_array(F.collect_list(F.struct(-F.col("votes"), "clade")))
    top = votes.groupBy("cluster_id").agg(F.min_by("clade", F.struct(-F.col("votes"), "clade")).alias("clade"), F.count("*").alias("clades"), F.transform(found, lambda v: F.struct(v["clade"].alias("clade"), (-v["col1"]).alias("votes"))).alias("clade_votes"))
    top = top.join(named.groupBy("cluster_id").agg(F.countDistinct("id").alias("labelled")), "cluster_id")
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("members"))
    return sizes.join(densest.select("cluster_id", "cells", "dense_cells", "in_dense"), "cluster_id").join(typical, "cluster_id").join(top, "cluster_id", "left")


QUERIES = {"p3_found": p3_found, "p3_clusters": p3_clusters, "p2_found": p2_found, "p2_neighbors": p2_neighbors}
P2_FOUND_SQL = r"""
WITH cur AS (SELECT id, embeddings::DOUBLE[] v, 'H' || regexp_extract(types, '(?i)H(\d+)N(\d+)', 1) || 'N' || regexp_extract(types, '(?i)H(\d+)N(\d+)', 2) kind
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) rn FROM embedding_cache WHERE cache_name = 'fixed') WHERE rn = 1 AND len(embeddings) = 64),
ok AS (SELECT * FROM cur WHERE kind <> 'HN' AND len(list_filter(v, lambda x: isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.id, b.id neighbor_id, list_distance(a.v, b.v) d FROM ok a JOIN (SELECT DISTINCT id FROM neighbor_probes) p ON p.id = a.id JOIN ok b ON a.kind = b.kind AND a.id <> b.id)
SELECT id, neighbor_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor_id) rn FROM pairs) WHERE rn <= 10"""
_OK_SQL = P2_FOUND_SQL[: P2_FOUND_SQL.index(",\npairs AS")]
P2_NEIGHBORS_SQL = f"""{_OK_SQL},
pairs AS (SELECT a.id, b.id neighbor_id, list_distance(a.v, b.v) d FROM ok a JOIN ok b ON a.kind = b.kind AND a.id <> b.id WHERE a.id % 100 = 0)
SELECT id, rank::INT rank, neighbor_id, round(d, 6) distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor_id) rank FROM pairs) WHERE rank <= 10"""
P3_FOUND_SQL = f"""{_OK_SQL.replace("WITH cur", "WITH RECURSIVE cur").replace("kind <> 'HN' AND ", "")},
edges AS MATERIALIZED (SELECT a.id x, b.id y FROM ok a JOIN ok b ON a.id <> b.id WHERE list_distance(a.v, b.v) <= 0.8),
reach(id, c) AS (SELECT id, id FROM ok UNION SELECT e.y, r.c FROM reach r JOIN edges e ON e.x = r.id WHERE e.y > r.c),
low AS (SELECT id, min(c) cluster_id FROM reach GROUP BY 1)
SELECT id, cluster_id FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) n FROM low) WHERE n >= 5"""
ORACLES = {"p2_found": P2_FOUND_SQL, "p2_neighbors": P2_NEIGHBORS_SQL, "p3_found": P3_FOUND_SQL}

"""Exact nearest neighbours of a stated query set inside groups, block by block; retrieve-and-rerank; bands of months."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veclore.runtime import written

#: Rows of a block on either side: a task holds one block of queries and one block of rows.
QUERY_BLOCK, ROW_BLOCK = 2_000, 20_000


def exact_neighbors(rows: DataFrame, k: int, group: str = "grp", key: str = "id", vector: str = "vector", asks: str = "asks", band: str | None = None, width: int | None = None, metric: str = "euclidean", features: Callable[[pd.Series, str], np.ndarray] | None = None, row_block: int | None = None, digits: int | None = None) -> DataFrame:
    """(group, query_id, rank, neighbor_id, distance) of the rows with ``asks`` true against all rows of their group.

    Queries and rows are cut into hash blocks; every pair of blocks is one group of a join key, compared by
    matrix products, and gives its k best per query, so neither a group nor its pairs are ever in one place. With
    ``band`` and ``width`` only rows at most ``width`` away in that column count: blocks are cut by stretches of ``width``
    first, and a query meets its own stretch and the two beside it. ``metric``: ``euclidean``, ``cosine`` (1 - cosine) or
    ``hamming`` (share of differing elements). ``features`` makes the matrix from the column and the group inside the task, so
    that a text travels instead of its terms. Distances are rounded to ``digits`` before they are ranked. The row itself is left
    out by its id; ties go to the smaller id. Rows with NULL group, key or vector are none.
    """
    row_block = row_block or ROW_BLOCK
    kind = dict(rows.dtypes)[vector]
    value = F.col(vector) if features or not kind.startswith("array") else F.col(vector).cast("array<tinyint>" if metric == "hamming" else "array<double>")
    near = F.col(band).cast("long") if band else F.lit(0).cast("long")
    cols = [F.col(group).alias("grp"), F.col(key).alias("id"), value.alias("v"), F.col(asks).alias("asks"), near.alias("band"), F.floor(near / max(1, width or 1)).alias("part")]
    held = written(rows.where(f"{group} is not null and {key} is not null and {vector} is not null").select(*cols), "knn")
    sizes = held.groupBy("grp", "part").agg(F.ceil(F.count("*") / row_block).cast("int").alias("rb"), F.ceil(F.count_if("asks") / QUERY_BLOCK).cast("int").alias("qb"))
    beside = F.array(*(F.col("part") + i for i in ((-1, 0, 1) if band else (0,))))
    # a pair of parts: the queries' (q) and the rows' (r)
    meets = sizes.where("qb > 0").select("grp", F.col("part").alias("q_part"), "qb", F.explode(beside).alias("r_part"))
    meets = meets.join(sizes.select("grp", F.col("part").alias("r_part"), "rb"), ["grp", "r_part"])
    spread = lambda c: F.pmod(F.xxhash64("id", F.lit(17)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    there = held.join(meets, (held.grp == meets.grp) & (held.part == meets.r_part)).drop(meets.grp).withColumn("r", spread("rb")).withColumn("q", every("qb")).withColumn("side", F.lit(0))
    asked = held.where("asks").join(meets, (held.grp == meets.grp) & (held.part == meets.q_part)).drop(meets.grp).withColumn("q", spread("qb")).withColumn("r", every("rb")).withColumn("side", F.lit(1))
    names = ["grp", "q_part", "r_part", "q", "r", "side", "id", "v", "band"]
    matrix = features or (lambda v, g: np.stack(v.to_numpy()))

    def best(p: pd.DataFrame) -> pd.DataFrame:
        ask, row = p[p.side == 1], p[p.side == 0]
        if not len(ask) or not len(row):
            return pd.DataFrame({"grp": [], "query_id": [], "neighbor_id": [], "distance": []})
        x, y = matrix(row.v, p.grp.iloc[0]), matrix(ask.v, p.grp.iloc[0])
        ids, bands, out = row.id.to_numpy(), row.band.to_numpy(), []
        if metric == "cosine":
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
        square = None if metric == "hamming" else np.einsum("ij,ij->i", x, x)
        for s in range(0, len(y), 64):
            part = y[s : s + 64]
            rough = np.stack([np.count_nonzero(x != z, axis=1) / x.shape[1] for z in part]) if metric == "hamming" else square[None] - 2 * part @ x.T
            for i, (me, b) in enumerate(zip(ask.id.to_numpy()[s : s + 64], ask.band.to_numpy()[s : s + 64])):
                r = rough[i]
                r[ids == me] = np.inf
                if band:
                    r[np.abs(bands - b) > width] = np.inf
                bound = np.partition(r, k - 1)[k - 1] if len(r) > k else np.inf
                c = np.flatnonzero((r <= bound + 1e-6 * (1 + abs(bound) if np.isfinite(bound) else 1)) & np.isfinite(r))
                d = {"euclidean": lambda c=c, z=part[i]: np.sqrt(((x[c] - z) ** 2).sum(axis=1)), "cosine": lambda c=c, z=part[i]: 1 - (x[c] * z).sum(axis=1), "hamming": lambda c=c, r=r: r[c]}[metric]()
                d = d if digits is None else np.round(d, digits)
                o = np.lexsort((ids[c], d))[:k]
                out.append((np.repeat(me, len(o)), ids[c][o], d[o]))
        return pd.DataFrame({"grp": p.grp.iloc[0], **dict(zip(("query_id", "neighbor_id", "distance"), map(np.concatenate, zip(*out))))})

    kind = dict(held.dtypes)
    found = there.select(*names).unionByName(asked.select(*names)).groupBy("grp", "q_part", "r_part", "q", "r").applyInPandas(best, f"grp {kind['grp']}, query_id {kind['id']}, neighbor_id {kind['id']}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("grp").alias(group), "query_id", "rank", "neighbor_id", "distance")


def band_counts(rows: DataFrame, width: int, group: str = "grp", month: str = "month_index") -> DataFrame:
    """(group, month, rows, in_band): rows of each month, and of all months at most ``width`` away. Works on month counts."""
    counts = rows.where(F.col(group).isNotNull() & F.col(month).isNotNull()).groupBy(group, month).agg(F.count("*").alias("rows"))
    around = Window.partitionBy(group).orderBy(month).rangeBetween(-width, width)
    return counts.withColumn("in_band", F.sum("rows").over(around))

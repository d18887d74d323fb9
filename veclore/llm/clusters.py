"""Clusters of mutually similar vectors by a grid of dense cells (problem 3).

Two vectors belong together if their distance is at most ``radius``, directly or by way of others. The features are
quantised to cells as wide as the radius; a cell whose bounding box is longer than the radius is cut in half again, until
all members of a cell are within the radius of each other. From then on the work is on cells: their counts, boxes and one
member each. Cells are joined with their neighbours on a coarse grid of projected features; neighbours whose
members lie within the radius are linked, and minimum labels are passed along the links to convergence. Only pairs of
cells that the boxes allow to touch and that are still apart afterwards are decided by their points. The result is exact.

No step pairs the points of a cell. A full place of the coarse grid is cut further and then into blocks, and both cells of an
undecided pair into salted chunks, so no task holds an unbounded group.

Defined cases: rows with a NULL id or vector are none; finite values of any size are cells like others; identical vectors share a cell; ``min_cell`` leaves out sparser
cells as noise (1 keeps all); ids must be unique; empty input gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclore.operators.graph import connected_components
from veclore.runtime import broadcast_if_small, written

#: Cells that one task compares at once, and points of one chunk of an undecided pair.
BLOCK = 3000
CHUNK = 5000
#: Cells whose members the axes are fitted on (the axes only steer how evenly the work falls).
FIT_CELLS = 10_000
#: Axes and width of the slabs, in radii, by which places that hold more than a block are cut further.
LEVELS = (((0, 1, 2), 8.0), ((3, 4, 5), 8.0), ((0, 1, 2), 4.0), ((3, 4, 5), 4.0), ((6, 7, 8), 4.0))
AXES = 9
#: Centres are clipped to so many radii before they are projected: clipping brings no two of them further apart, and sums stay exact.
FAR = 1e6


def _cell(vector, width: float):
    """Hash of the whole numbers below the elements in steps of ``width``; beyond 2**52 steps the quotient is a whole number itself."""
    steps = lambda x: x.cast("double") / width
    return F.xxhash64(F.transform(vector, lambda x: F.when(F.abs(steps(x)) < 2.0**52, F.floor(steps(x)).cast("double")).otherwise(steps(x))), F.lit(width))


def cells(points: DataFrame, radius: float, size: int) -> tuple[DataFrame, DataFrame]:
    """(points with their final cell, cells: cell, n, first_id, member, low, high).

    A cell's box is at most ``radius`` long from corner to corner. The width starts at the radius and is halved for cells
    that are too long; at ``radius / sqrt(size)`` the bound holds by construction.
    """
    axes = [F.col("x")[i] for i in range(size)]
    levels = int(np.ceil(np.log2(np.sqrt(size)))) + 1
    open_points, done_points, done_cells = points.select("id", F.col("embeddings").alias("x")), None, None
    for level in range(levels):
        width = radius / 2**level
        placed = open_points.withColumn("cell", _cell(F.col("x"), width))
        boxes = placed.groupBy("cell").agg(
            F.count("*").alias("n"), F.min(F.struct("id", "x")).alias("first"), *(F.min(a).alias(f"l{i}") for i, a in enumerate(axes)), *(F.max(a).alias(f"h{i}") for i, a in enumerate(axes))
        )
        low, high = F.array(*(f"l{i}" for i in range(size))), F.array(*(f"h{i}" for i in range(size)))
        squares = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (y.cast("double") - x) * (y.cast("double") - x)), F.lit(0.0), lambda s, v: s + v)
        table = boxes.select("cell", "n", F.col("first.id").alias("first_id"), F.col("first.x").alias("member"), low.alias("low"), high.alias("high"), (squares(low, high) > radius * radius).alias("wide"))
        table = written(table, "cells")
        tight, wide = table.where("not wide").drop("wide"), table.where("wide").select("cell")
        last = level == levels - 1 or wide.isEmpty()
        kept = placed if last else placed.join(wide, "cell", "left_anti")
        part = table.drop("wide") if last else tight
        done_points = kept if done_points is None else done_points.unionByName(kept)
        done_cells = part if done_cells is None else done_cells.unionByName(part)
        if last:
            break
        open_points = written(placed.join(wide, "cell", "left_semi").select("id", "x"), "points")
    return done_points, done_cells


def coarse_axes(table: DataFrame) -> np.ndarray:
    """(dimensions, axes): the directions in which about ``FIT_CELLS`` cells differ most, values clipped to eight interquartile
    ranges around the median. The sample has the smallest hashed cell numbers and comes to the driver."""
    share = min(1.0, FIT_CELLS / max(1, table.count()))
    sample = table.where(F.shiftrightunsigned(F.xxhash64("cell"), 1) <= min(int(share * 2**63), 2**63 - 1)).select("member").limit(2 * FIT_CELLS).toPandas()
    x = np.stack((sample if len(sample) else table.select("member").limit(1).toPandas()).member.to_numpy()).astype(np.float64)
    low, middle, high = np.quantile(x, (0.25, 0.5, 0.75), axis=0)
    x = np.clip(x, middle - 8 * (high - low), middle + 8 * (high - low)) - middle
    _, v = np.linalg.eigh(x.T @ x / len(x))
    return v[:, ::-1][:, :AXES]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` items is linked to by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def placed_cells(table: DataFrame, radius: float) -> DataFrame:
    """(cell, first_id, member, reach, place): every cell in the places where it may meet others. Only a cell's member and its
    reach, the distance from it to the farthest corner of the box, travel; boxes stay where they are.

    Two touching boxes have centres at most two radii apart: half a diagonal each, and the gap. A place is a box of slabs
    along the leading axes; a cell that lies within two radii of a slab's upper end stands in the next slab as well, so any
    two that touch share a place. Places with more than ``BLOCK`` cells are cut again, along other axes and in thinner slabs.
    """
    axes = coarse_axes(table)
    near = 2 * radius * (1 + 1e-9)

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                low, high, member = (np.stack(b[c].to_numpy()).astype(np.float64) for c in ("low", "high", "member"))
                y = np.clip((low + high) / 2, -FAR * radius, FAR * radius) @ axes
                reach = np.sqrt((np.maximum(member - low, high - member) ** 2).sum(axis=1))
                yield pd.DataFrame({"cell": b.cell, "first_id": b.first_id, "member": [m.tobytes() for m in member.astype(np.float32)], "reach": reach, "y": list(y), "place": ""})

    held = table.select("cell", "first_id", "member", "low", "high").mapInPandas(projected, "cell bigint, first_id bigint, member binary, reach double, y array<double>, place string")
    done, levels = [], [(tuple(i for i in use if i < axes.shape[1]), wide * radius) for use, wide in LEVELS]
    for use, wide in [level for level in levels if level[0]]:
        held = written(held, "spread")
        sizes = held.groupBy("place").agg(F.count("*").alias("n"), *(F.min(F.col("y")[i]).alias(f"from_{i}") for i in use)).where(F.col("n") > BLOCK)
        full = broadcast_if_small(written(sizes.drop("n"), "places"), 100_000)
        if full.isEmpty():
            break
        done.append(held.join(full, "place", "left_anti"))
        held = held.join(full, "place")
        for i in use:
            at = F.floor((F.col("y")[i] - F.col(f"from_{i}")) / wide)
            over = F.col("y")[i] - F.col(f"from_{i}") > (at + 1) * wide - near
            held = held.withColumn(f"at_{i}", F.explode(F.when(over, F.array(at, at + 1)).otherwise(F.array(at))))
        held = held.withColumn("place", F.concat_ws(",", "place", *(f"at_{i}" for i in use))).select("cell", "first_id", "member", "reach", "y", "place")
    return functools.reduce(DataFrame.unionByName, [*done, written(held, "spread")]).drop("y")


def cell_links(table: DataFrame, radius: float) -> DataFrame:
    """(a, b, sure): cells that are linked by a pair of members, as a spanning forest per block; and undecided ones, whose
    boxes may touch although the block's links leave them apart. A place that no slab could cut is compared in pairs of
    blocks: its cells are bounded by the grid, not by the rows."""
    places = placed_cells(table, radius)
    sizes = places.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select("place", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocked = places.join(sizes, "place").withColumn("mine", F.pmod(F.xxhash64("cell"), F.col("blocks")).cast("int"))
    blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocked = blocked.withColumn("block", F.concat_ws("/", "place", F.least("mine", "other"), F.greatest("mine", "other")))

    def link(p: pd.DataFrame) -> pd.DataFrame:
        """One block pair: at most about 2 * BLOCK cells."""
        p = p.sort_values("first_id").reset_index(drop=True)
        x = np.frombuffer(b"".join(p.member), np.float32).reshape(len(p), -1).astype(np.float64)
        reach, cell = p.reach.to_numpy(), p.cell.to_numpy()
        square = (x * x).sum(axis=1)
        n, a, b, near = len(p), [], [], []
        for s in range(0, n, 512):
            both = square[s : s + 512, None] + square[None]
            bound = (radius + reach[s : s + 512, None] + reach[None]) ** 2
            i, j = np.nonzero(both - 2 * x[s : s + 512] @ x.T <= bound + 1e-12 * both + 1e-9)  # rounding grows with the squares
            i += s
            keep = i < j
            i, j = i[keep], j[keep]
            true = _squares(x, i, x, j) <= radius * radius
            a.append(i[true])
            b.append(j[true])
            near.append(np.stack([i[~true], j[~true]]))
        root = _roots(n, np.concatenate(a), np.concatenate(b))
        tree = np.flatnonzero(root != np.arange(n))
        i, j = np.concatenate(near, axis=1)
        apart = root[i] != root[j]
        sure = pd.DataFrame({"a": cell[tree], "b": cell[root[tree]], "sure": True})
        return pd.concat([sure, pd.DataFrame({"a": cell[i[apart]], "b": cell[j[apart]], "sure": False})], ignore_index=True)

    return written(blocked.drop("mine", "other", "blocks", "place").groupBy("block").applyInPandas(link, "a bigint, b bigint, sure boolean"), "links")


def _squares(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (i, j), in pieces."""
    return np.concatenate([((x[i[s : s + 100_000]] - y[j[s : s + 100_000]]) ** 2).sum(axis=1) for s in range(0, len(i), 100_000)] or [np.empty(0)])


def decided_links(points: DataFrame, table: DataFrame, pairs: DataFrame, radius: float) -> DataFrame:
    """(a, b) of the undecided cell pairs that do have two points within the radius."""
    facts = table.select("cell", "n", "low", "high")
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in ("a", "b"):
        both = both.join(facts.select(*(F.col(c).alias(f"{side}_{c}") for c in facts.columns)), F.col(side) == F.col(f"{side}_cell")).drop(f"{side}_cell")
    box = lambda side: F.zip_with(f"{side}_low", f"{side}_high", lambda lo, hi: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi")))
    apart = F.zip_with(box("a"), box("b"), lambda a, b: F.greatest(F.lit(0.0), a["lo"] - b["hi"], b["lo"] - a["hi"]))
    both = both.where(F.aggregate(apart, F.lit(0.0), lambda t, g: t + g * g) <= radius * radius)  # boxes that may touch
    chunks = [F.ceil(F.col(f"{side}_n") / CHUNK).cast("int").alias(f"{side}_chunks") for side in ("a", "b")]
    both = written(both.select("*", *chunks), "pairs")
    sides = []
    for side, other in (("a", "b"), ("b", "a")):
        sides.append(both.select("a", "b", "a_chunks", "b_chunks", F.col(side).alias("cell"), F.col(f"{other}_low").alias("low"), F.col(f"{other}_high").alias("high"), F.lit(side == "a").alias("is_a")))
    # only points that the other cell's box lets come near
    gap = F.aggregate(
        F.zip_with(F.col("x"), F.zip_with("low", "high", lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))), lambda v, s: F.greatest(F.lit(0.0), s["lo"].cast("double") - v, v.cast("double") - s["hi"])), F.lit(0.0), lambda t, g: t + g * g
    )
    own = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    near = points.join(sides[0].unionByName(sides[1]), "cell").where(gap <= radius * radius)
    near = near.select("a", "b", "is_a", "x", F.when(F.col("is_a"), own("a_chunks")).otherwise(every("a_chunks")).alias("u"), F.when(F.col("is_a"), every("b_chunks")).otherwise(own("b_chunks")).alias("v"))

    def touch(p: pd.DataFrame) -> pd.DataFrame:
        """A chunk of either cell."""
        a, b = (np.stack(p.x[p.is_a == v].to_numpy()).astype(np.float64) if (p.is_a == v).any() else np.empty((0, 1)) for v in (True, False))
        for s in range(0, len(a) if len(b) else 0, 512):
            both = (a[s : s + 512] ** 2).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None]
            i, j = np.nonzero(both - 2 * a[s : s + 512] @ b.T <= radius * radius + 1e-12 * both + 1e-9)
            if (_squares(a, i + s, b, j) <= radius * radius).any():
                return p[["a", "b"]].head(1)
        return p[["a", "b"]].head(0)

    return near.withColumn("u", F.explode("u")).withColumn("v", F.explode("v")).groupBy("a", "b", "u", "v").applyInPandas(touch, "a bigint, b bigint").distinct()


def clusters(rows: DataFrame, radius: float = 0.8, size: int = 64, min_cell: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members: id, cell, cluster_id, n, x; cells: cell, n, cluster_id, cluster_n, low, high) for rows (id, embeddings). ``cluster_id`` is the smallest id of
    the cluster, ``n`` its size; single vectors are clusters of one."""
    points = rows.where("id is not null and embeddings is not null").select("id", "embeddings")
    points, table = cells(written(points, "points"), radius, size)
    table = table.where(F.col("n") >= min_cell)
    if table.isEmpty():
        none = table.select(F.col("first_id").alias("id"), "cell", F.col("first_id").alias("cluster_id"), "n", F.col("member").alias("x"))
        return none, table.select("cell", "n", F.col("first_id").alias("cluster_id"), F.col("n").alias("cluster_n"), "low", "high")
    links = cell_links(table, radius)
    sure = links.where("sure").select("a", "b")
    label = connected_components(sure)
    apart = links.where("not sure").select("a", "b").distinct()
    for side in ("a", "b"):
        apart = apart.join(label.select(F.col("node").alias(side), F.col("component").alias(f"{side}_label")), side, "left")
    apart = written(apart.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b"), "apart")
    if not apart.isEmpty():
        more = written(decided_links(points, table, apart, radius), "links")
        label = connected_components(sure.unionByName(more))
    named = table.join(label.withColumnRenamed("node", "cell"), "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    whole = named.groupBy("component").agg(F.min("first_id").alias("cluster_id"), F.sum("n").alias("cluster_n"))
    named = written(named.join(whole, "component").select("cell", "n", "cluster_id", "cluster_n", "low", "high"), "clusters")
    members = points.select("id", "cell", "x").join(named.select("cell", "cluster_id", F.col("cluster_n").alias("n")), "cell").select("id", "cell", "cluster_id", "n", "x")
    return members, named

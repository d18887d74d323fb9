"""Nearest vectors by shifted space-filling curves (problem 2).

Each of several curves turns, projects and shifts the vectors differently and orders them by a Hilbert key. Spark range
partitions and sorts every ordering; a query looks at the rows up to ``reach`` places before and after its own place in
each ordering. Reach grows with the square root of the type's rows, so that recall holds from thousands to millions of
rows. The windows of all orderings are merged by a distance between short codes, and the best of them, fetched by id, are
ranked by the true distance.

A row stands on a curve with its key, its id and a code of one byte per dimension: the half cell between two quantiles of that
dimension. Quantiles are taken per type (``OWN_CUTS`` largest types; the others share theirs) from at most about ``FIT_ROWS`` of its
rows, so both the key's and the code's cells are narrow where the rows are, and vectors of any length take one end cell each.
A row that lies far outside of them brings its whole vector instead of a code. Every row is indexed; the projections are drawn from a seed.

Windows cross the borders of partitions: the ends of every partition are handed to as many neighbours as a window spans.

Recall against brute force is measured in the tests and in the README; ``curves`` and ``window`` are its knobs. Defined
cases: rows with a NULL id, group or vector are no rows here; identical vectors are neighbours at distance 0, and stand
on the curves as one row however many there are; equal distances go to the smaller id; a group with fewer than k other rows gives fewer; ids must be unique; empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veclore.runtime import broadcast_if_small, written

#: Curve dimensions, and bits of each in a key; bits of a word of the key.
DIMS, BITS, WORD = 8, 20, 5
#: Cuts of an axis, and of a dimension (a byte tells half cells apart); types with cuts of their own.
CUTS, DIM_CUTS, OWN_CUTS = 255, 127, 24
#: Rows of a type that its cuts are fitted on; all rows are indexed.
FIT_ROWS = 10_000
#: Reach of a window: so many times the square root of the type's rows.
GROWTH = 4.5
#: Rows of a partition: at least so many, and at least so many times the longest reach.
ROWS_PER_PARTITION, REACHES_PER_PARTITION = 40_000, 20
#: Candidates of a query, as multiples of k: from one window, and of all windows together.
PER_WINDOW, MERGED = 4, 6


def projections(size: int, curves: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random orthonormal directions (curves, size, DIMS) and shifts (curves, DIMS) as parts of the ranks; of vectors
    shorter than DIMS the directions are only unit vectors."""
    rng = np.random.default_rng(seed)
    turn = rng.normal(size=(curves, size, DIMS))
    turn = np.stack([np.linalg.qr(t)[0] for t in turn]) if size >= DIMS else turn / np.linalg.norm(turn, axis=1, keepdims=True)
    return turn, rng.uniform(0.0, 0.3, (curves, DIMS))


def hilbert_words(q: np.ndarray, bits: int = BITS, word: int = WORD) -> list[np.ndarray]:
    """Place on the Hilbert curve of integer points ``q`` (n, dims), each coordinate under ``2**bits``: words of ``word``
    bits of every coordinate, the highest first.

    The usual bit-by-bit construction: from the highest bit down, the point's cube is chosen and the axes of all lower
    bits are turned and flipped as the curve enters that cube; then the Gray code is undone.
    """
    n, dims = q.shape
    x = [q[:, d].astype(np.uint64) for d in range(dims)]
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for d in range(dims):
            inside = ((x[d] >> np.uint64(b)) & np.uint64(1)).astype(bool)
            swap = np.where(inside, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap
    for d in range(1, dims):
        x[d] = x[d] ^ x[d - 1]
    flip = np.zeros(n, np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & np.uint64(1), np.uint64((1 << b) - 1), np.uint64(0))
    words = []
    for high in range(bits, 0, -word):
        key = np.zeros(n, np.uint64)
        for b in range(high - 1, max(high - word, 0) - 1, -1):
            for d in range(dims):
                key = (key << np.uint64(1)) | (((x[d] ^ flip) >> np.uint64(b)) & np.uint64(1))
        words.append(key.view(np.int64))
    return words


def hilbert_key(q: np.ndarray, bits: int) -> np.ndarray:
    """The place as one word."""
    return hilbert_words(q, bits, bits)[0]


def hilbert_bytes(q: np.ndarray) -> list[bytes]:
    """The place as bytes that sort as the curve runs."""
    size = DIMS * WORD // 8
    words = [w.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :] for w in hilbert_words(q)]
    return [r.tobytes() for r in np.hstack(words)]


def ranked(y: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Place of each value among the ascending ``cuts``, in [0, 1): every cell between two cuts gets the same share and is
    straight inside. The two end cells have no far end: there the place nears 0 or 1 as the value goes out, so one far value
    takes nothing from the others."""
    m, (left, right) = len(cuts), margins(cuts)
    cell = np.searchsorted(cuts, y, side="right")
    low, high = cuts[np.clip(cell - 1, 0, m - 1)], cuts[np.clip(cell, 0, m - 1)]
    inner = (y - low) / np.where(high > low, high - low, 1.0)
    below, above = np.maximum(cuts[0] - y, 0.0), np.maximum(y - cuts[-1], 0.0)
    t = np.where(cell == 0, left / (below + left), np.where(cell == m, above / (above + right), inner))
    return (cell + np.minimum(t, 1.0 - 1e-12)) / (m + 1)


def margins(cuts: np.ndarray) -> tuple[float, float]:
    """How wide the outer eighths of the cuts are; of all cuts, or 1, where these are 0."""
    m, eighth = len(cuts), -(-len(cuts) // 8)
    whole = (cuts[-1] - cuts[0]) or 1.0
    return (cuts[min(eighth, m - 1)] - cuts[0]) or whole, (cuts[-1] - cuts[max(m - 1 - eighth, 0)]) or whole


def cells(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, values) of one dimension's cells: between two cuts, and as far outside as the outer eighths are wide. A cell has
    two halves with a value each. In a cell much wider than its neighbour, a gap between dense stretches, the value is near
    the neighbour: that is where the rows are."""
    left, right = margins(cuts)
    edges = np.concatenate([[cuts[0] - left], cuts, [cuts[-1] + right]])
    wide = np.diff(edges)
    before, after = np.concatenate([wide[:1], wide[:-1]]), np.concatenate([wide[1:], wide[-1:]])
    low, high = edges[:-1] + np.minimum(wide / 4, before), edges[1:] - np.minimum(wide / 4, after)
    return edges, np.stack([low, high], axis=1).ravel()


def coded(x: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """A byte per dimension, the value's half cell (see ``cells``); the vector itself, four bytes per dimension, where a value
    lies outside of all cells."""
    code, far = np.empty(x.shape, np.uint8), np.zeros(len(x), bool)
    for d, c in enumerate(cuts):
        edges, _ = cells(c)
        at = np.searchsorted(c, x[:, d], side="right")
        code[:, d] = 2 * at + (x[:, d] > (edges[at] + edges[at + 1]) / 2)
        far |= (x[:, d] < edges[0]) | (x[:, d] > edges[-1])
    return [r.tobytes() if f else c.tobytes() for f, r, c in zip(far, x, code)]


def decoded(codes: pd.Series, cuts: np.ndarray | None, size: int) -> np.ndarray:
    """Vectors of the cells' values."""
    whole = np.fromiter((len(c) != size for c in codes), bool, len(codes))
    out = np.empty((len(codes), size), np.float32)
    if whole.any():
        out[whole] = np.frombuffer(b"".join(codes[whole]), np.float32).reshape(-1, size)
    if not whole.all():
        value = np.stack([cells(c)[1] for c in cuts])
        out[~whole] = value[np.arange(size), np.frombuffer(b"".join(codes[~whole]), np.uint8).reshape(-1, size)]
    return out


def _near(v: np.ndarray, ids: np.ndarray, at: int, low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, squared distances, places away) of the ``most`` rows of [low, high) nearest to row ``at``; ties to the nearer place."""
    off = v[low:high] - v[at]
    d = np.einsum("ij,ij->i", off, off) if np.abs(v[at]).max() < 1e15 else (off.astype(np.float64) ** 2).sum(axis=1)
    d = d.astype(np.float64)
    if low <= at < high:
        d[at - low] = np.inf
    keep = np.flatnonzero(d <= np.partition(d, most - 1)[most - 1]) if len(d) > most else np.arange(len(d))
    if low <= at < high:
        keep = keep[keep != at - low]
    gap = np.abs(keep + low - at)
    keep = keep[np.lexsort((gap, d[keep]))[:most]]
    return ids[low + keep], d[keep], np.abs(keep + low - at)


def _segments(p: pd.DataFrame) -> list[tuple[int, int]]:
    """Runs of one curve and type."""
    curve, kind = p.curve.to_numpy(), p.types.to_numpy()
    cut = np.flatnonzero((curve[1:] != curve[:-1]) | (kind[1:] != kind[:-1])) + 1
    ends = [0, *cut.tolist(), len(p)]
    return list(zip(ends[:-1], ends[1:]))


class Cuts:
    """What the tasks know of each type: cuts of the projected axes and of the dimensions, and the reach of a window.
    Types without are smaller than a window: they need no order."""

    def __init__(self, window: int):
        self.window, self.axes, self.dims, self.reaches, self.shared = window, {}, {}, {}, {}

    def name(self, kind: str) -> str | None:
        return kind if kind in self.axes else "" if kind in self.shared and "" in self.axes else None

    def reach(self, kind: str) -> int:
        return self.reaches.get(kind, self.window)


def fitted(held: DataFrame, turn: np.ndarray, window: int, size: int) -> tuple[Cuts, int]:
    """(Cuts, rows): quantiles of about ``FIT_ROWS`` rows of each type, those with the smallest hashed ids; one task sorts the
    sample of one type. The driver gets the sizes of types with more rows than a window, and the cuts of each axis and
    dimension for at most ``OWN_CUTS`` + 1 of them."""
    sizes = written(held.groupBy("types").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.sum("n").alias("rows")).first()["rows"] or 0
    large = [(r["types"], r["n"]) for r in sizes.where(F.col("n") > window).orderBy(F.desc("n"), "types").toLocalIterator()]
    out = Cuts(window)
    if not large:
        return out, total
    out.reaches = {kind: max(window, int(GROWTH * n**0.5)) for kind, n in large}
    own, out.shared = dict(large[:OWN_CUTS]), dict(large[OWN_CUTS:])
    flat = np.concatenate(list(turn), axis=1)

    def quantiles(p: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(p.embeddings.to_numpy()).astype(np.float64)
        axes = np.quantile(x @ flat, np.arange(1, CUTS + 1) / (CUTS + 1), axis=0).T
        dims = np.quantile(x, np.arange(1, DIM_CUTS + 1) / (DIM_CUTS + 1), axis=0).T
        return pd.DataFrame({"types": [p.types.iloc[0]], "axes": [axes.tobytes()], "dims": [dims.tobytes()]})

    share = F.create_map(*(F.lit(v) for kind, n in own.items() for v in (kind, FIT_ROWS / n)))
    rest = F.lit(FIT_ROWS / max(1, sum(out.shared.values())))
    drawn = F.shiftrightunsigned(F.xxhash64("id"), 1) < F.coalesce(share[F.col("types")], rest) * float(2**63)
    sample = held.where(drawn).select(F.when(F.col("types").isin(list(own)), F.col("types")).otherwise("").alias("types"), "embeddings")
    for r in sample.groupBy("types").applyInPandas(quantiles, "types string, axes binary, dims binary").toLocalIterator():
        out.axes[r["types"]] = np.frombuffer(r["axes"]).reshape(-1, CUTS)
        out.dims[r["types"]] = np.frombuffer(r["dims"]).reshape(size, DIM_CUTS)
    # a type of which the sample has nothing keeps whole vectors and an order by id
    return out, total


def copies(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Identical vectors of a type as one row each: (id, types, embeddings, asks) with the smallest id; (rep, id) of its
    smallest k + 1 ids, where it has more than one; (id, rep) of every row that asks. Vectors are told apart by 128 bits of
    hash, so that only narrow rows are grouped. Counts are combined and places cut before the shuffle: a group of any size is bounded."""
    plain = F.transform("embeddings", lambda x: x + F.lit(0.0).cast("float"))  # -0.0 is 0.0
    rows = rows.where("id is not null and types is not null and embeddings is not null").select("id", "types", plain.alias("embeddings"), F.coalesce("asks", F.lit(False)).alias("asks"))
    rows = written(rows.withColumn("h1", F.xxhash64("embeddings")).withColumn("h2", F.xxhash64(F.lit(1), "embeddings")), "rows")
    key = ["types", "h1", "h2"]
    several = rows.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.bool_or("asks").alias("any")).where("n > 1")
    members = written(rows.select("id", *key, "asks").join(several, key).select("rep", "id", "asks", "any"), "members")
    fate = broadcast_if_small(members.select("id", (F.col("rep") == F.col("id")).alias("leads"), "any"), 1_000_000)
    held = rows.join(fate, "id", "left").where(F.coalesce("leads", F.lit(True))).select("id", "types", "embeddings", F.coalesce("any", "asks").alias("asks"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    smallest = members.select("rep", "id").withColumn("place", place).where(F.col("place") <= k + 1).select("rep", "id")
    alone = rows.where("asks").select("id").join(members.select("id"), "id", "left_anti").select("id", F.col("id").alias("rep"))
    return held, written(smallest, "copies"), alone.unionByName(members.where("asks").select("id", "rep"))


def nearest(rows: DataFrame, k: int = 10, curves: int = 6, window: int = 400, seed: int = 7, size: int = 64) -> DataFrame:
    """(id, neighbor_id, distance, rank) for every row of ``rows`` (id, types, embeddings, asks) with ``asks`` true,
    among the other rows of the same ``types``.

    The k nearest ids of a row all belong to the k nearest distinct vectors (ties: smaller first id) or to its own copies:
    any other vector has k smaller ids or distances before it.
    """
    held, same, asking = copies(rows, k)
    found = _distinct_nearest(held, k, curves, window, seed, size)
    whole = found.select("id", "neighbor_id", "distance").unionByName(held.where("asks").select("id", F.col("id").alias("neighbor_id"), F.lit(0.0).alias("distance")))
    whole = whole.withColumnRenamed("id", "asked").join(same.select(F.col("rep").alias("neighbor_id"), F.col("id").alias("copy")), "neighbor_id", "left")
    whole = whole.select("asked", F.coalesce("copy", "neighbor_id").alias("neighbor_id"), "distance")
    first = F.row_number().over(Window.partitionBy("asked").orderBy("distance", "neighbor_id"))
    whole = whole.withColumn("place", first).where(F.col("place") <= k + 1)  # one may be the row itself
    each = asking.join(whole, F.col("rep") == F.col("asked")).where(F.col("id") != F.col("neighbor_id")).select("id", "neighbor_id", "distance")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


@F.pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    return pd.Series(np.sqrt(((np.stack(a.to_numpy()).astype(np.float64) - np.stack(b.to_numpy()).astype(np.float64)) ** 2).sum(axis=1)))


_FOUND = "id bigint, neighbor_id bigint, distance double, gap int"


def _distinct_nearest(held: DataFrame, k: int, curves: int, window: int, seed: int, size: int) -> DataFrame:
    """``nearest`` among distinct vectors."""
    turn, shift = projections(size, curves, seed)
    cuts, count = fitted(held, turn, window, size)
    longest = max([window, *cuts.reaches.values()])
    parts = max(2, -(-count * curves // max(ROWS_PER_PARTITION, REACHES_PER_PARTITION * longest if cuts.axes else 0)))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b.embeddings.to_numpy()).astype(np.float32)
            code, keys = np.empty(len(b), object), np.empty((curves, len(b)), object)
            for kind, at in b.groupby("types").indices.items():
                name = cuts.name(kind)
                if name is None:
                    code[at], keys[:, at] = [r.tobytes() for r in x[at]], b""
                    continue
                code[at] = coded(x[at], cuts.dims[name])
                for c in range(curves):
                    y = x[at].astype(np.float64) @ turn[c]
                    u = np.stack([ranked(y[:, d], cuts.axes[name][c * DIMS + d]) for d in range(DIMS)], axis=1)
                    keys[c, at] = hilbert_bytes(np.minimum((u + shift[c]) * (1 << BITS) / 1.3, (1 << BITS) - 1).astype(np.uint64))
            small = pd.Series([cuts.name(t) is None for t in b.types], index=b.index)
            for c in range(curves):
                out = pd.DataFrame({"curve": np.int32(c), "types": b.types, "key": keys[c], "id": b.id, "asks": b.asks, "code": code})
                yield out if c == 0 else out[~small]  # one order is enough where a window holds all

    order = ["curve", "types", "key", "id"]
    placed = held.mapInPandas(keyed, "curve int, types string, key binary, id bigint, asks boolean, code binary").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ends_of = "part int, pos int, n int, curve int, types string, id bigint, asks boolean, code binary"
    schema = f"asked bigint, neighbor_id bigint, distance double, gap int, {ends_of}"
    names = [c.split()[0] for c in schema.split(", ")]

    def answers(found: list) -> pd.DataFrame:
        asked, near, d, gap = (np.concatenate([f[i] for f in found]) for i in range(4))
        return pd.DataFrame({"asked": asked, "neighbor_id": near, "distance": d, "gap": gap.astype(np.int32)})

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Answers from inside the partition, and the rows at its two ends."""
        got = [b for b in batches if len(b)]
        if not got:
            return
        p = pd.concat(got, ignore_index=True)
        ids, asks, found = p.id.to_numpy(), p.asks.to_numpy(), []
        for low, high in _segments(p):
            kind = p.types.iloc[low]
            name, reach = cuts.name(kind), cuts.reach(kind)
            at = np.flatnonzero(asks[low:high])
            if not len(at):
                continue
            v, near = decoded(p.code.iloc[low:high], None if name is None else cuts.dims[name], size), ids[low:high]
            for i in at.tolist():
                n, d, gap = _near(v, near, i, max(0, i - reach), min(high - low, i + reach + 1), PER_WINDOW * k)
                found.append((np.full(len(n), near[i]), n, d, gap))
        if found:
            yield _padded(answers(found), names)
        pos = np.arange(len(p), dtype=np.int32)
        end = (pos < longest) | (pos >= len(p) - longest)
        yield _padded(p[end].drop(columns="key").assign(part=np.int32(TaskContext.get().partitionId()), pos=pos[end], n=np.int32(len(p))), names)

    first = written(placed.mapInPandas(windows, schema), "curves")
    ends = first.where("part is not null").select(*(c.split()[0] for c in ends_of.split(", ")))
    rows_of = {r["part"]: r["n"] for r in ends.groupBy("part").agg(F.max("n").alias("n")).toLocalIterator()}  # one number per partition
    spread = held.sparkSession.createDataFrame(border_parts(rows_of, longest), "border int, part int, side int, at int, low int, high int")

    def across(p: pd.DataFrame) -> pd.DataFrame:
        """One border: at most ``longest`` rows from either side of it."""
        p = p.sort_values(["side", "at", "pos"]).reset_index(drop=True)
        ids, asks, side, found = p.id.to_numpy(), p.asks.to_numpy(), p.side.to_numpy(), []
        for low, high in _segments(p):
            kind, edge = p.types.iloc[low], int((side[low:high] == 0).sum())  # the rows before the border come first
            at = np.flatnonzero(asks[low:high])
            if not len(at) or edge in (0, high - low):
                continue
            name, reach = cuts.name(kind), cuts.reach(kind)
            v, near = decoded(p.code.iloc[low:high], None if name is None else cuts.dims[name], size), ids[low:high]
            for i in at.tolist():
                a, z = (edge, min(high - low, i + reach + 1)) if i < edge else (max(0, i - reach), edge)
                if a < z:
                    n, d, gap = _near(v, near, i, a, z, PER_WINDOW * k)
                    found.append((np.full(len(n), near[i]), n, d, gap))
        return answers(found).rename(columns={"asked": "id"}) if found else pd.DataFrame(columns=["id", "neighbor_id", "distance", "gap"])

    borders = ends.join(F.broadcast(spread), "part").where("pos between low and high").drop("part", "n", "low", "high")
    inside = first.where("asked is not null").select(F.col("asked").alias("id"), "neighbor_id", "distance", "gap")
    merged = inside.unionByName(borders.groupBy("border").applyInPandas(across, _FOUND))
    merged = merged.groupBy("id", "neighbor_id").agg(F.min(F.struct("distance", "gap")).alias("d"))
    few = F.row_number().over(Window.partitionBy("id").orderBy("d", "neighbor_id"))
    pairs = written(merged.withColumn("place", few).where(F.col("place") <= MERGED * k).select("id", "neighbor_id"), "pairs")
    wanted = broadcast_if_small(pairs.select("id").union(pairs.select("neighbor_id")).distinct(), 1_000_000)
    exact = held.select("id", "embeddings").join(wanted, "id", "left_semi")
    near = pairs.join(exact.select(F.col("id").alias("neighbor_id"), F.col("embeddings").alias("b")), "neighbor_id").join(exact.withColumnRenamed("embeddings", "a"), "id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor_id"))
    return near.select("id", "neighbor_id", _distance("a", "b").alias("distance")).withColumn("rank", rank).where(F.col("rank") <= k)


def _padded(out: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    return out.assign(**{c: pd.Series([None] * len(out), index=out.index, dtype=object) for c in names if c not in out})[names]


def border_parts(rows_of: dict[int, int], reach: int) -> list[tuple[int, int, int, int, int, int]]:
    """(border, part, side, at, low, high): which rows of which partitions, counted from 0, lie within ``reach`` of the border
    behind each partition; ``at`` puts the partitions of a side in order."""
    held, out = sorted(p for p, n in rows_of.items() if n), []
    for i, border in enumerate(held[:-1]):
        left = reach
        for j in range(i, -1, -1):
            n = rows_of[held[j]]
            out.append((border, held[j], 0, j, max(0, n - left), n - 1))
            left -= n
            if left <= 0:
                break
        left = reach
        for j in range(i + 1, len(held)):
            n = rows_of[held[j]]
            out.append((border, held[j], 1, j, 0, min(n, left) - 1))
            left -= n
            if left <= 0:
                break
    return out

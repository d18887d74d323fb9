import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.parity import assert_same
from veclore.llm import clusters, curves, plans_vectors

SCHEMA = "id bigint, types string, embeddings array<float>, asks boolean"


@pytest.mark.parametrize("name", sorted(plans_vectors.ORACLES))
def test_parity(spark, data, name):
    assert_same(spark, data, plans_vectors.QUERIES[name], plans_vectors.ORACLES[name])


def test_hilbert_steps_are_unit_steps():
    import itertools

    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        g = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        k = curves.hilbert_key(g, bits)
        assert sorted(k.tolist()) == list(range(len(g)))
        assert (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def lineages(n, seed=0, size=64):
    """Points near random three-dimensional patches, as vectors of evolving records are."""
    rng = np.random.default_rng(seed)
    out = []
    for c in range(8):
        patch = np.linalg.qr(rng.normal(size=(size, 3)))[0]
        out.append(rng.normal(size=size) * 4 + rng.normal(scale=0.1, size=(n // 8, 3)) @ patch.T + rng.normal(scale=0.005, size=(n // 8, size)))
    return np.concatenate(out).astype(np.float32)


def rows_of(x, types="ab"):
    return [(i, types[i % len(types)], [float(v) for v in r], i % 10 == 0) for i, r in enumerate(x)]


def brute(rows, k):
    ids, kind, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.float32).astype(np.float64)
    out = set()
    for i, r in enumerate(rows):
        if r[3]:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            d[(kind != r[1]) | (ids == r[0])] = np.inf
            o = np.lexsort((ids, d))[:k]
            out |= {(r[0], int(ids[j])) for j in o if np.isfinite(d[j])}
    return out


def test_recall_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(curves, "ROWS_PER_PARTITION", 300)  # many borders
    rows = rows_of(lineages(2400))
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("curve", F.lit("clash")).withColumn("distance", F.lit(0))
    got = curves.nearest(frame, k=10, curves=5, window=60)
    pairs = {(r["id"], r["neighbor_id"]) for r in got.collect()}
    true = brute(rows, 10)
    assert len(pairs & true) / len(true) >= 0.97
    assert got.groupBy("id").agg(F.count("*").alias("n")).where("n != 10").count() == 0


def test_a_far_vector_leaves_the_others_their_keys(spark):
    x = lineages(2400)
    x[2399], x[2398] = 1e7, -1e7
    rows = rows_of(x)
    got = {(r["id"], r["neighbor_id"]) for r in curves.nearest(spark.createDataFrame(rows, SCHEMA), k=10, curves=5, window=60).collect()}
    true = brute(rows, 10)
    assert len(got & true) / len(true) >= 0.97


def test_near_copies_keep_their_order(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    x[500:] = x[0] + np.outer(rng.permutation(1000), rng.normal(size=64)) * 1e-6  # a line of near copies, ids in no order
    rows = rows_of(x.astype(np.float32), "a")
    got = {(r["id"], r["neighbor_id"]) for r in curves.nearest(spark.createDataFrame(rows, SCHEMA), k=10, curves=5, window=60).collect() if r["id"] >= 500}
    true = {p for p in brute(rows, 10) if p[0] >= 500}
    assert len(got & true) / len(true) >= 0.97


def test_more_copies_than_a_window(spark):
    x = lineages(2400)
    x[800:1600] = x[800]
    x[801] = x[800] + 0.01
    rows = rows_of(x, "a") + [(5000, "a", [0.0] * 64, True), (5001, "a", [-0.0] * 64, False)]
    got = {(r["id"], r["neighbor_id"]) for r in curves.nearest(spark.createDataFrame(rows, SCHEMA), k=10, curves=5, window=60).collect()}
    true = brute(rows, 10)
    of_copies = {p for p in true if 800 <= p[0] < 1600}
    assert of_copies == {p for p in got if 800 <= p[0] < 1600} and (5000, 5001) in got
    assert len(got & true) / len(true) >= 0.97


def test_small_groups_ties_and_nulls(spark):
    x = [[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [5.0, 5.0]]
    rows = [(i, "a", v, True) for i, v in enumerate(x)] + [(10, "b", [1.0, 1.0], True), (11, None, [1.0, 1.0], True), (12, "a", None, True), (None, "a", [0.0, 1.0], True)]
    got = sorted((r["id"], r["rank"], r["neighbor_id"]) for r in curves.nearest(spark.createDataFrame(rows, SCHEMA), k=2, window=5, size=2).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1), (3, 1, 0), (3, 2, 1)]
    assert curves.nearest(spark.createDataFrame([], SCHEMA), k=2, size=2).count() == 0


def components(x, radius):
    root = list(range(len(x)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i in range(len(x)):
        for j in np.flatnonzero(((x[i + 1 :] - x[i]) ** 2).sum(axis=1) <= radius * radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


@pytest.mark.parametrize("block, chunk", [(3000, 5000), (12, 15)])
def test_clusters_against_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(clusters, "BLOCK", block)
    monkeypatch.setattr(clusters, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    chain = np.cumsum(rng.normal(scale=0.25, size=(150, 8)), axis=0)  # long, thin, with gaps
    ball = rng.normal(scale=0.25, size=(150, 8)) + 20
    spread = rng.uniform(-6, 6, size=(120, 8))  # sparse: near the limit
    x = np.concatenate([chain, ball, spread, ball[:5]]).astype(np.float32)
    rows = [(i + 100, [float(v) for v in r]) for i, r in enumerate(x)] + [(9999, None), (None, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "id bigint, embeddings array<float>").withColumn("cell", F.lit("clash")).withColumn("x", F.lit(1)).withColumn("n", F.lit(1))
    members, cells = clusters.clusters(frame, radius=0.8, size=8)
    got = {(r["id"], r["cluster_id"]) for r in members.collect()}
    assert got == {(i + 100, c + 100) for i, c in enumerate(components(x.astype(np.float64), 0.8))}
    sizes = {r["cluster_id"]: r["n"] for r in members.select("cluster_id", "n").distinct().collect()}
    assert sum(sizes.values()) == len(x) and cells.agg(F.sum("n")).first()[0] == len(x)


def test_far_values_and_full_places(spark, monkeypatch):
    """Values up to 1e30, and more cells in a place than a block holds."""
    monkeypatch.setattr(clusters, "BLOCK", 40)
    rng = np.random.default_rng(4)
    x = rng.uniform(-5, 5, size=(900, 3)) @ np.linalg.qr(rng.normal(size=(8, 3)))[0].T
    far = np.zeros((6, 8))
    far[:, 0] = [1e30, 1e30, 1e12, 1e12, -1e12, 1e30]
    far[:, 1] = [0.1, 0.2, 0.1, 0.3, 0.0, 5.0]
    x = np.concatenate([x, far]).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, embeddings array<float>")
    got = {(r["id"], r["cluster_id"]) for r in clusters.clusters(frame, radius=0.8, size=8)[0].collect()}
    assert got == set(enumerate(components(x.astype(np.float64), 0.8)))
    assert len({c for _, c in got}) > 10


def test_clusters_of_nothing(spark):
    members, cells = clusters.clusters(spark.createDataFrame([], "id bigint, embeddings array<float>"), size=8)
    assert members.count() == 0 and cells.count() == 0


def test_described_clusters(spark, data):
    assert set(plans_vectors.p3_clusters(spark, data).columns) >= {"cluster_id", "members", "typical_1", "clade"}


def test_every_label_of_a_cluster_counts(spark, monkeypatch):
    at = "2024-01-01 00:00:00"
    cache = spark.createDataFrame([(i, "fixed", [1.0 + i / 1000] * 64, "H1N1", f"EPI_ISL_{i}", at) for i in range(1, 7)], "id bigint, cache_name string, embeddings array<float>, types string, epi_isl string, loaded_at string")
    labels = [(1, "A"), (1, "Z"), (2, "B"), (2, "Z"), (3, "Z"), (3, "Z"), (4, "B"), (5, None)]
    meta = spark.createDataFrame([(f"EPI_ISL_{i}", None, c, at) for i, c in labels], "epi_isl string, isolate_id string, clade string, loaded_at string")
    tables = {"embedding_cache": cache.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")), "clade_metadata": meta}
    monkeypatch.setattr(plans_vectors, "table", lambda spark, folder, name: tables[name])
    r = plans_vectors.p3_clusters(spark, "").collect()
    assert len(r) == 1 and r[0]["members"] == 6 and r[0]["clades"] == 3 and r[0]["labelled"] == 4
    votes = [(v["clade"].upper(), v["votes"]) for v in r[0]["clade_votes"]]
    assert votes == [("Z", 3), ("B", 2), ("A", 1)] and r[0]["clade"].upper() == "Z"

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclore.functions import sequences as S
from veclore.functions import tokens as T
from veclore.functions import vectors as V
from veclore.functions.align import alignment_counts
from veclore.operators import graph, kmers, knn, labels, ranking, ranks, records, sampling, series, stats


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int' if isinstance(v, int) else 'array<double>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def points(spark, n=200, d=4, groups=2, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[5] = x[4]  # one exact copy
    rows = [(i, f"g{i % groups}", [float(v) for v in x[i]], int(rng.integers(0, 60))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, grp string, vector array<double>, month_index int")


def test_headers_dates_names(spark):
    h = "E1|A/Town_X/1/2014|A_/_h1n1|2014-03-18|Seg4"
    assert [one(spark, S.header_field(F.col("h"), i), h=h) for i in (0, 4)] == ["E1", "Seg4"]
    assert one(spark, S.header_field(F.col("h"), 0), h="a|b|c|d") is None
    assert one(spark, S.subtype(F.col("h")), h="A_/_h1n1") == "H1N1" and one(spark, S.subtype(F.col("h")), h="mixed") == "mixed"
    assert [one(spark, S.date_part(F.col("h"), p), h="2017") for p in ("year", "month", "day")] == [2017, 6, 15]
    assert one(spark, S.name_year(F.col("h")), h="A/TOWN/20/03") == 2003 and one(spark, S.name_year(F.col("h")), h="A/TOWN/20/87") == 1987
    assert one(spark, S.strain_key(F.col("h")), h="a/b c(H1N1)") == "A/BCH1N1" and one(spark, S.strain_key(F.col("h")), h="a/b h3n2") == "A/B"
    assert one(spark, S.major_label(F.col("m"), F.col("c")), m="NA", c="3C.2a1.b.2") == "3C.2a1"
    assert one(spark, S.month_index(F.col("y"), F.col("m")), y=2000, m=13) == 24011


def test_sequence_limits(spark):
    for n, good in ((1649, False), (1650, True), (1800, True), (1801, False)):
        assert one(spark, S.good_sequence(F.col("s"), "HA"), s="A" * n) is good
    assert one(spark, S.good_sequence(F.col("s"), "HA"), s="A" * 1683 + "N" * 17) is True  # exactly 1 %
    assert one(spark, S.good_sequence(F.col("s"), "HA"), s="A" * 1682 + "N" * 18) is False
    assert one(spark, S.good_sequence(F.col("s"), "HA"), s=None) is False
    assert one(spark, S.translated(F.col("s")), s="ATGTAAGGNCC") == "M*X"
    assert one(spark, S.translated(F.col("s"), stop=True), s="ATGNNNTAAGGG") == "MK"
    assert one(spark, S.kmers(F.col("s"), 3), s="ABCDE") == ["ABC", "BCD", "CDE"] and one(spark, S.kmers(F.col("s"), 3), s="AB") == []


def test_hamming(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, S.hamming(a, b), a="AAAA", b="AATA") == 0.25
    assert one(spark, S.hamming(a, b), a="A" * 100, b="A" * 90) is None and one(spark, S.hamming(a, b, None), a="A" * 100, b="A" * 90) == 0.0
    assert one(spark, S.hamming(a, b), a="", b="A") is None
    assert one(spark, S.weighted_hamming(a, b, a, b), a="AC", b="AG") == 0.5


def test_tokens(spark):
    ids = one(spark, T.encoded_record(F.col("h"), F.col("n"), F.col("t")), h="ATCGNNTAGC", n="GCTATTCGAA", t="<H3N2>")
    assert (ids[0], ids[1], ids[12], ids[13], ids[-1]) == (11, 8, 6, 9, 7)
    assert one(spark, T.decoded(T.encoded_record(F.col("h"), F.col("n"), F.col("t"))), h="ATCGNNTAGC", n="GCTATTCGAA", t="<H3N2>") == "ATCGNNTAGCGCTATTCGAA"
    assert one(spark, T.encoded_letters(F.col("h")), h="ATXGN") == [0, 3, 4, 2, 4]
    assert one(spark, T.padded(T.encoded_letters(F.col("h")), 4, left=True), h="AC") == [5, 5, 0, 1]


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, V.euclidean(a, b), a=[0.0, 3.0], b=[4.0, 0.0]) == 5.0
    assert one(spark, V.cosine_distance(a, b), a=[0.0, 0.0], b=[1.0, 0.0]) is None
    assert one(spark, V.unit(a), a=[3.0, 4.0]) == [0.6, 0.8] and one(spark, V.unit(a), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.finite(a), a=[1.0, float("nan")]) is False


def brute_alignment(a, b):
    """Best score by plain dynamic programming over three layers."""
    n, m, low = len(a), len(b), -1e9
    p, d, r = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    p[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                p[i][j] = max(p[i - 1][j - 1], d[i - 1][j - 1], r[i - 1][j - 1]) + (a[i - 1] == b[j - 1])
            if i:
                d[i][j] = max(max(p[i - 1][j], r[i - 1][j]) - 2, d[i - 1][j] - 0.5)
            if j:
                r[i][j] = max(max(p[i][j - 1], d[i][j - 1]) - 2, r[i][j - 1] - 0.5)
    return max(p[n][m], d[n][m], r[n][m])


def test_alignment_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ACGT"), rng.integers(1, 14))) for _ in range(2))
        wrong, gaps, aligned = alignment_counts(a, b)
        assert all(alignment_counts(a, b, band) == (wrong, gaps, aligned) for band in (0, 1, 3, 500))
        assert 2 * aligned + gaps == len(a) + len(b)
        best = brute_alignment(a, b)
        # gaps of g letters in k runs cost 2 k + .5 (g - k): the score fixes k
        runs = (aligned - wrong - best - 0.5 * gaps) / 1.5
        assert abs(runs - round(runs)) < 1e-9 and 0 <= round(runs) <= gaps
    assert alignment_counts("ACGT", "ACGT") == (0, 0, 4)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges + [(7, None)], "a bigint, b bigint")
    assert {(r["node"], r["component"]) for r in graph.connected_components(frame).collect()} == {(x, find(x)) for x in root}
    assert graph.connected_components(frame.where("a < 0")).count() == 0


def test_ranks_and_spearman(spark):
    rng = np.random.default_rng(1)
    rows = [("a", int(v), float(v % 7), i) for i, v in enumerate(rng.integers(0, 40, 300))] + [("b", 1, 1.0, -1), ("b", None, 2.0, -2)]
    frame = spark.createDataFrame(rows, "g string, v int, w double, id int")
    got = {r["id"]: r["rank"] for r in ranks.average_ranks(frame, ["g"], "v", buckets=8).collect()}
    v = np.array([r[1] for r in rows[:300]])
    want = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert all(got[i] == want[i] for i in range(300)) and got[-1] == 1 and -2 not in got
    w = np.array([r[2] for r in rows[:300]])
    rank = lambda z: np.array([(z < x).sum() + ((z == x).sum() + 1) / 2 for x in z])
    rho = {r["g"]: r["rho"] for r in ranks.spearman(frame, ["g"], "v", "w").collect()}
    assert abs(rho["a"] - np.corrcoef(rank(v), rank(w))[0, 1]) < 1e-9 and rho["b"] is None


def test_pairs_stay_in_groups(spark):
    rows, frame = points(spark, 101)
    grp = {r[0]: r[1] for r in rows}
    got = ranks.sampled_pairs(frame, "grp", "id", 3).collect()
    assert len(got) == 303 and all(r["i"] != r["j"] and grp[r["i"]] == grp[r["j"]] == r["grp"] for r in got)
    assert ranks.sampled_pairs(frame.limit(1), "grp", "id").count() == 0
    moved = ranks.permuted(frame, "grp", "id", "month_index", 1).collect()
    assert sorted(r["month_index"] for r in moved if r["grp"] == "g0") == sorted(r[3] for r in rows if r[1] == "g0")


@pytest.mark.parametrize("band", [None, 6])
def test_neighbors_against_brute_force(spark, band, monkeypatch):
    monkeypatch.setattr(knn, "ROW_BLOCK", 30)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    rows, frame = points(spark)
    frame = frame.withColumn("asks", F.col("id") % 9 == 4).withColumn("rank", F.lit("clash"))
    got = knn.exact_neighbors(frame, 3, band="month_index" if band else None, width=band).collect()
    want = set()
    for q, g, v, m in rows:
        if q % 9 == 4:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, h, x, n in rows if h == g and i != q and (band is None or abs(n - m) <= band))
            want |= {(q, r + 1, i) for r, (_, i) in enumerate(near[:3])}
    assert {(r["query_id"], r["rank"], r["neighbor_id"]) for r in got} == want
    assert knn.exact_neighbors(frame.where("false"), 3).count() == 0


def test_precision_and_controls(spark):
    near = spark.createDataFrame([("g", 1, r, n) for r, n in ((1, 2), (2, 3), (3, 4))] + [("g", 5, 1, 1), ("g", 9, 1, 1)], "grp string, query_id int, rank int, neighbor_id int")
    lab = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y"), (5, "y")], "id int, label string")
    got = {r["k"]: r for r in labels.precision(near, lab, [1, 3]).collect()}
    assert got[1]["mean_precision"] == 0.5 and got[3]["mean_precision"] == 0.25 and got[3]["queries"] == 2 and got[3]["mean_labelled"] == 1.5
    shares = labels.label_shares(lab.withColumn("grp", F.lit("g"))).first()
    assert abs(shares["expected"] - 4 / 12) < 1e-12 and shares["classes"] == 2


def test_representatives(spark):
    rows = spark.createDataFrame([(3, "k", 5), (1, "k", 9), (2, "k", 5), (4, None, 1)], "id int, key string, month_index int")
    kept = lambda p: sorted(r["id"] for r in records.representatives(rows, [F.col("key")], p).collect())
    assert kept("first") == [1, 4] and kept("earliest") == [2, 4] and kept("latest") == [1, 4] and len(kept("random")) == 2


def test_spectrum_and_covariance(spark):
    rows, frame = points(spark)
    x = np.array([r[2] for r in rows])
    cov = np.zeros((4, 4))
    for r in stats.covariance(frame, "vector").collect():
        cov[r["i"], r["j"]] = r["cov"]
    assert np.allclose(cov, np.cov(x.T))
    s = stats.spectrum(frame, "vector").first()
    w = np.linalg.eigvalsh(np.cov(x.T))
    assert abs(s["total"] - w.sum()) < 1e-9 and abs(s["participation"] - w.sum() ** 2 / (w**2).sum()) < 1e-9
    mean, axes = stats.principal_axes(frame, "vector", 2)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.array(axes) @ np.array(axes).T, np.eye(2))


def test_two_neighbor_dimension(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(400, 2))
    rows = [(i, "g", [float(a), float(b), 0.0], True) for i, (a, b) in enumerate(x)]
    frame = spark.createDataFrame(rows, "id int, grp string, vector array<double>, asks boolean")
    r = stats.two_neighbor_ratios(knn.exact_neighbors(frame, 2))
    got = stats.two_neighbor_dimension(r, trim=0.02).first()
    assert 1.6 < got["dimension"] < 2.5 and got["r2"] > 0.9


def test_forecasts_find_a_linear_process(spark):
    rng = np.random.default_rng(4)
    x, rows = np.array([1.0, -1.0]), []
    for m in range(60):
        rows.append(("g", m, [float(v) for v in x]))
        x = np.array([[0.5, 0.3], [-0.2, 0.6]]) @ x + 0.5 + rng.normal(scale=0.01, size=2)
    frame = spark.createDataFrame([r for r in rows if r[1] != 30], "grp string, month_index int, centroid array<double>")
    got = {r["model"]: r for r in series.forecast_report(series.rolling_forecasts(frame, 40, 59, [2])).collect()}
    assert got["var1"]["targets"] == 20 and got["var1"]["rmse"] < 0.03 and 0.3 <= got["var1"]["cover_90"] <= 1.0 and got["persistence"]["ratio"] == 1.0
    assert np.allclose(series.ridge(np.array([[0.0], [1.0], [2.0]]), np.array([[1.0], [3.0], [5.0]]), 0.0).ravel(), [1.0, 2.0])
    lags = series.lagged(frame.select("grp", "month_index", F.col("centroid")[0].alias("v")), "v").where("month_index = 31").first()
    assert lags["lag1"] is None and lags["lag2"] is None


def test_kmer_neighbors(spark):
    rows = spark.createDataFrame([(1, "g", "ACGTACGTAA"), (2, "g", "ACGTACGTAC"), (3, "g", "TTTTTTTTTT"), (4, "g", None), (5, "g", "AC")], "id int, grp string, t string")
    w = kmers.tfidf(kmers.term_counts(rows, F.col("t"), 3))
    norms = w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(norms) == 3 and all(abs(r["n"] - 1) < 1e-9 for r in norms)
    got = kmers.cosine_neighbors(w, rows.where("id = 1"), 2).collect()
    assert [(r["neighbor_id"], r["rank"]) for r in got] == [(2, 1)] and got[0]["similarity"] > 0.8
    assert all(len(r["vector"]) == 8 for r in kmers.random_projection(w, 8).collect())


def test_ranking(spark):
    scored = spark.createDataFrame([("w", "g", i, i == 3, s) for i, s in ((1, 0.5), (2, float("nan")), (3, 0.5), (4, 0.1))] + [("one", "g", 1, True, None)], "window_id string, grp string, candidate_id int, is_target boolean, mean_nll double")
    got = {r["window_id"]: r for r in ranking.target_ranks(scored).collect()}
    assert got["w"]["target_rank"] == 3 and got["w"]["top5"] is None and got["w"]["top1"] == 0 and got["one"]["normalised_rank"] == 0
    rep = ranking.rank_report(ranking.target_ranks(scored), ["grp"]).first()
    assert abs(rep["mrr"] - (1 / 3 + 1) / 2) < 1e-9 and abs(rep["random_mrr"] - ((1 + 1 / 2 + 1 / 3 + 1 / 4) / 4 + 1) / 2) < 1e-9
    c = ranking.classification(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, None)], "true_class int, predicted int")).first()
    assert c["accuracy"] == 0.5 and abs(c["macro_f1"] - (2 / 3 + 2 / 4) / 2) < 1e-9 and c["unknown_share"] == 0.25


def test_candidates_keep_the_target(spark):
    rows = spark.createDataFrame([(1, "g", 10, 100, "f1"), (2, "g", 10, 101, "f1"), (3, "g", 11, 100, "f3"), (4, "g", 20, 100, "f4"), (5, "g", 9, 150, "f5"), (6, "h", 10, 100, "f6")], "id int, grp string, month_index int, length int, fingerprint string")
    w = spark.createDataFrame([("w", "g", 2, 10, 101, "f1", [5])], "window_id string, grp string, target_id int, target_month int, target_length int, target_fingerprint string, context_ids array<int>")
    got = lambda p: sorted(r["candidate_id"] for r in ranking.candidates(w, rows, p, 10).collect())
    assert got("same_month") == [2] and got("near") == [2, 3] and got("group") == [2, 3, 4] and got("length") == [2, 3, 4] and got("past") == [2]


def test_stratified(spark):
    rows = spark.createDataFrame([("g", y, y * 100 + i) for y, n in ((1, 2), (2, 50), (3, 50), (4, 3)) for i in range(n)], "grp string, year int, id int")
    got = {r["year"]: r["n"] for r in sampling.stratified(rows, "grp", "year", "id", 20).groupBy("year").agg(F.count("*").alias("n")).collect()}
    assert got[1] == 2 and got[4] == 3 and sum(got.values()) == 20 and abs(got[2] - got[3]) <= 1
    assert sampling.stratified(rows, "grp", "year", "id", 1000).count() == 105


def test_components_of_long_chains_in_no_order(spark):
    import random

    from veclore.operators.graph import connected_components

    ids = list(range(1000, 1800))
    random.Random(1).shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(5, 5), (7, 6), (6, 7), (None, 1)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 1000 for i in ids} | {5: 5, 6: 6, 7: 6}


def test_candidates_of_hot_months_equal_brute_force(spark):
    """Cutting each month (or month and length) before the join loses no candidate: few lengths, few months, many rows."""
    import hashlib

    rng = np.random.default_rng(5)
    rows = [(i, "g", int(rng.integers(0, 9)), int(rng.integers(96, 104)), f"f{rng.integers(0, 500)}") for i in range(600)]
    lengths = {}
    rows = [(i, g, m, lengths.setdefault(f, n), f) for i, g, m, n, f in rows]
    frame = spark.createDataFrame(rows, "id int, grp string, month_index int, length int, fingerprint string")
    windows = [(f"w{r[0]}", "g", r[0], r[2], r[3], r[4], [rows[r[0] + 1][0], rows[r[0] + 2][0]]) for r in rows[::120]]
    w = spark.createDataFrame(windows, "window_id string, grp string, target_id int, target_month int, target_length int, target_fingerprint string, context_ids array<int>")
    order = lambda i: hashlib.sha1(f"0|{i}".encode()).hexdigest()
    first = {}
    for i, _, m, n, f in rows:
        first[m, f] = min(first.get((m, f), (i, n)), (i, n))
    for policy in ranking.POLICIES:
        want = set()
        for name, _, target, month, length, mark, context in windows:
            fits = {"same_month": lambda m, n: m == month, "near": lambda m, n: abs(m - month) <= 3, "past": lambda m, n: m < month, "group": lambda m, n: True, "length": lambda m, n: abs(n - length) <= 0.03 * length}[policy]  # noqa: B023
            all_of = sorted((abs(m - month), order(i), i, f) for (m, f), (i, n) in first.items() if f != mark and i not in context and fits(m, n))
            kept, seen = [target], {mark}
            for _, _, i, f in all_of:
                if f not in seen and len(kept) < 10:
                    kept.append(i)
                    seen.add(f)
            want |= {(name, i) for i in kept}
        assert {(r["window_id"], r["candidate_id"]) for r in ranking.candidates(w, frame, policy, 10).collect()} == want, policy


def test_calibrated_report(spark):
    rows = [(0, "cal", [5.0, 1.0, 0.0]), (0, "cal", [4.0, 1.0, 0.0]), (1, "cal", [0.0, 1.0, 3.0]), (0, "test", [2.0, 9.0, 1.0]), (0, "test", [1.0, 0.0, 2.0]), (1, "test", [0.0, 1.0, 3.0]), (1, "test", [1.0, 0.0, 1.0])]
    report = lambda r: ranking.calibrated_report(spark.createDataFrame(r, "true_class int, split string, logits array<double>")).first()
    got = report(rows)
    assert (got["idx_a"], got["idx_b"], got["ambiguous"], got["n"], got["unknown"]) == (0, 2, False, 4, 1)
    assert (got["c00"], got["c01"], got["c10"], got["c11"], got["accuracy"]) == (1, 1, 1, 1, 0.5) and got["macro_f1"] == 0.5
    same = report([(t, s, [3.0, 1.0, 0.0]) for t, s, _ in rows])
    assert same["ambiguous"] and same["accuracy"] is None and same["c00"] == 0 and same["n"] == 4
    none = report([r for r in rows if r[1] == "test"])
    assert none["idx_a"] is None and none["accuracy"] is None and report([(0, "test", None)])["n"] == 1
    assert report([])["n"] == 0


def test_batches_and_masks(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, [4]), (3, None), (4, [])], "id int, ids array<int>")
    got = {r["id"]: (r["ids"], r["attention_mask"]) for r in T.batched(rows, left=True).collect()}
    assert got == {1: ([1, 2, 3], [1, 1, 1]), 2: ([5, 5, 4], [0, 0, 1]), 3: (None, None), 4: ([5, 5, 5], [0, 0, 0])}
    assert {r["id"]: r["ids"] for r in T.batched(rows, length=2).collect()}[1] == [1, 2]


def test_increment_covariance():
    e = np.array([[1.0, 0.0], [3.0, 0.0], [5.0, 0.0]])
    assert np.allclose(series.increment_covariance(e, 0.5), [[5.0, 0.0], [0.0, 1.0]])


def test_quantiles_equal_numpy(spark):
    """Ties, one hot value, groups of one and two rows, a NULL group, missing and infinite values."""
    rng = np.random.default_rng(6)
    groups = {"a": [7.0] * 300 + list(rng.normal(size=400)), "b": [1.5], "c": [2.0, -3.0], None: list(rng.integers(0, 5, 50).astype(float)), "e": [float("inf"), 1.0, 2.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("f", None)]
    frame = spark.createDataFrame(rows, "grp string, v double")
    shares = {"p05": 0.05, "p50": 0.5, "p90": 0.9, "low": 0.0, "high": 1.0}
    got = {r["grp"]: r for r in ranks.quantiles(frame, ["grp"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g in ("a", "b", "c", None):
        assert all(abs(got[g][k] - np.quantile(groups[g], q)) < 1e-9 for k, q in shares.items()), g
    assert got["e"]["p50"] == 2.0
    few = {r["grp"]: r for r in stats.describe(frame.where("grp != 'e'"), ["grp"], F.col("v"), {"p05": 0.05, "p50": 0.5}, (1,)).collect()}
    many = {r["grp"]: r for r in stats.describe(frame.where("grp != 'e'"), ["grp"], F.col("v"), {"p05": 0.05, "p50": 0.5}, (1,), continuous=True).collect()}
    assert few.keys() == many.keys() and all(np.allclose(few[g][1:], many[g][1:]) for g in few)
    assert ranks.quantiles(frame.where("false"), ["grp"], "v", shares).count() == 0

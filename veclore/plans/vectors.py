"""Queries on cached vectors: neighbours, labels, correlation, spectra, intrinsic dimension, monthly series."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclore.functions import sequences as S
from veclore.functions import vectors as V
from veclore.operators import knn, ranks, series, stats
from veclore.operators import labels as L
from veclore.plans.base import CACHED_SQL, LABELS_SQL, RECORDS_SQL, asks_sql, cached, labels, pairs_sql, records
from veclore.runtime import written
from veclore.tables import table

SEED, K = 42, 10
ROUND = lambda c, n=6: F.round(c, n).alias(c)


def _asking(spark: SparkSession, folder: str) -> DataFrame:
    return cached(spark, folder).withColumn("asks", F.col("id") % 100 == 0)


def _near(spark: SparkSession, folder: str, k: int = K, **options) -> DataFrame:
    """Neighbours of every row whose id is divisible by 100, against all rows of its group."""
    return written(knn.exact_neighbors(_asking(spark, folder), k, **options), "near")


def knn_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Euclidean neighbours."""
    return _near(spark, folder).withColumn("distance", F.round("distance", 6))


KNN_SQL = f"WITH {CACHED_SQL}, {asks_sql(K)} SELECT grp, query_id, rank::INT rank, neighbor_id, round(distance, 6) distance FROM near"


def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """The two nearest by cosine."""
    return _near(spark, folder, 2, metric="cosine").withColumn("distance", F.round("distance", 6))


COSINE_SQL = f"WITH {CACHED_SQL}, {asks_sql(2, distance='1 - list_cosine_similarity(a.vector, b.vector)')} SELECT grp, query_id, rank::INT rank, neighbor_id, round(distance, 6) distance FROM near"


def knn_band(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours at most 12 months away."""
    rows = _asking(spark, folder).where("month_index is not null")
    return knn.exact_neighbors(rows, 5, band="month_index", width=12).withColumn("distance", F.round("distance", 6))


BAND_SQL = f"WITH {CACHED_SQL}, {asks_sql(5, 'AND abs(a.month_index - b.month_index) <= 12')} SELECT grp, query_id, rank::INT rank, neighbor_id, round(distance, 6) distance FROM near"


def temporal_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """A23, P10, P16, W01, A02 (flagship): one row per distinct vector, nearest 5 of the asking rows, months between them, and
    their ratios to the months between random rows."""
    rows = distinct_vectors(_asking(spark, folder))
    near = knn.exact_neighbors(rows, 5)
    months = rows.where("month_index is not null").select("id", "grp", "month_index")
    gaps = L.month_gaps(near, months)
    out = stats.describe(gaps, ["grp"], F.col("gap"), {"p25": 0.25, "median": 0.5, "p75": 0.75}, (1, 3, 6, 12))
    drawn = L.month_gaps(L.random_neighbors(rows.where("asks and month_index is not null"), months, 5, SEED), months)
    base = stats.describe(drawn, ["grp"], F.col("gap"), {"random_median": 0.5}).select("grp", F.col("mean").alias("random_mean"), "random_median")
    ratio = lambda a: (F.col(a) / F.nullif(F.col(f"random_{a}"), F.lit(0.0))).alias(f"{a}_ratio")
    full = out.join(base, "grp", "left").select("*", ratio("median"), ratio("mean"))
    return full.select("grp", "n", *(ROUND(c) for c in full.columns[2:]))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """The row with the smallest id of each vector of a group. Vectors are told apart by 128 bits of hash: narrow rows decide,
    the vectors themselves are neither a grouping key nor carried through it."""
    keyed = rows.withColumn("__h1", F.xxhash64("vector")).withColumn("__h2", F.xxhash64(F.lit(1), "vector"))
    first = keyed.groupBy("grp", "__h1", "__h2").agg(F.min("id").alias("id")).select("id")
    return written(rows.join(first, "id", "left_semi"), "distinct")


_DRAWN = lambda src, k, seed: f"""rn AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY sha1('{seed}|' || id::VARCHAR), id) - 1 AS at, count(*) OVER (PARTITION BY grp) n FROM {src}),
rq AS MATERIALIZED (SELECT q.grp, q.id query_id, t.t AS rank, (q.at + (q.at * 7919 + {seed} + t.t) % (q.n - 1) + 1) % q.n AS place FROM rn q, (SELECT unnest(range(1, {k + 1})) t) t WHERE q.n > 1 AND t.t <= q.n - 1),
rd AS (SELECT rq.grp, query_id, rank, b.id neighbor_id FROM rq JOIN rn b ON b.grp = rq.grp AND b.at = rq.place)"""  # noqa: E731
TEMPORAL_SQL = f"""WITH {CACHED_SQL.replace("cached AS (", "cached1 AS (")}, cached AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, vector ORDER BY id) r FROM cached1) WHERE r = 1), {asks_sql(5)},
mon AS (SELECT grp, id, month_index FROM cached WHERE month_index IS NOT NULL), {_DRAWN("mon", 5, SEED)},
g AS (SELECT n.grp, abs(a.month_index - b.month_index)::DOUBLE gap FROM near n JOIN mon a ON a.id = n.query_id JOIN mon b ON b.id = n.neighbor_id),
h AS (SELECT n.grp, abs(a.month_index - b.month_index)::DOUBLE gap FROM rd n JOIN mon a ON a.id = n.query_id JOIN mon b ON b.id = n.neighbor_id WHERE n.query_id % 100 = 0),
rs AS (SELECT grp, avg(gap) random_mean, quantile_cont(gap, 0.5) random_median FROM h GROUP BY 1),
s AS (SELECT grp, count(*) n, avg(gap) mean, min(gap) low, max(gap) high, quantile_cont(gap, 0.25) p25, quantile_cont(gap, 0.5) median, quantile_cont(gap, 0.75) p75,
  {", ".join(f"avg((gap <= {w})::INT) within_{w}" for w in (1, 3, 6, 12))} FROM g GROUP BY 1)
SELECT s.grp, n, {", ".join(f"round({c}, 6) {c}" for c in ("mean", "low", "high", "p25", "median", "p75", "within_1", "within_3", "within_6", "within_12", "random_mean", "random_median"))},
  round(median / nullif(random_median, 0), 6) median_ratio, round(mean / nullif(random_mean, 0), 6) mean_ratio FROM s LEFT JOIN rs ON rs.grp = s.grp"""


def random_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Months to random rows of the group, for the same queries."""
    rows = _asking(spark, folder).where("month_index is not null")
    drawn = L.random_neighbors(rows.where("asks"), rows, 5, SEED)
    out = stats.describe(L.month_gaps(drawn, rows.select("id", "month_index")), ["grp"], F.col("gap"), {"median": 0.5})
    return out.select("grp", "n", *(ROUND(c) for c in out.columns[2:]))


GAPS_SQL = f"""WITH {CACHED_SQL}, mon AS (SELECT grp, id, month_index FROM cached WHERE month_index IS NOT NULL), {_DRAWN("mon", 5, SEED)},
h AS (SELECT n.grp, abs(a.month_index - b.month_index)::DOUBLE gap FROM rd n JOIN mon a ON a.id = n.query_id JOIN mon b ON b.id = n.neighbor_id WHERE n.query_id % 100 = 0)
SELECT grp, count(*) n, round(avg(gap), 6) mean, min(gap) low, max(gap) high, quantile_cont(gap, 0.5) median FROM h GROUP BY 1"""


def band_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per month, and within 6 months of it."""
    return knn.band_counts(cached(spark, folder), 6)


BAND_COUNTS_SQL = f"WITH {CACHED_SQL}, c AS (SELECT grp, month_index, count(*) AS rows FROM cached WHERE month_index IS NOT NULL GROUP BY 1, 2) SELECT grp, month_index, rows, sum(rows) OVER (PARTITION BY grp ORDER BY month_index RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING)::BIGINT in_band FROM c"


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return cached(spark, folder).join(labels(spark, folder), "epi", "left").select("id", "grp", "label", "major_clade", "month_index")


def label_precision(spark: SparkSession, folder: str) -> DataFrame:
    """Share of neighbours with the query's label, and its ratio to what random ones are expected to have."""
    rows = written(_labelled(spark, folder), "labelled")
    got = L.precision(_near(spark, folder), rows.select("id", "label"), [5, 10])
    base = L.label_shares(rows)
    out = got.join(base, "grp").withColumn("enrichment", F.col("mean_precision") / F.nullif(F.col("expected"), F.lit(0.0)))
    return out.select("grp", "k", "queries", "labelled", "classes", *(ROUND(c) for c in ("mean_precision", "median_precision", "mean_labelled", "largest_share", "expected", "enrichment")))


_LAB = f"lab AS (SELECT c.id, c.grp, l.label, l.major_clade FROM cached c LEFT JOIN labels l ON l.epi = c.epi)"
PRECISION_SQL = f"""WITH {CACHED_SQL}, {LABELS_SQL}, {_LAB}, {asks_sql(K)},
h AS (SELECT n.grp, k.k, query_id, avg((a.label = b.label)::INT) p, count(*) m FROM near n JOIN lab a ON a.id = n.query_id JOIN lab b ON b.id = n.neighbor_id, (VALUES (5), (10)) k(k)
  WHERE a.label IS NOT NULL AND b.label IS NOT NULL AND rank <= k.k GROUP BY ALL),
g AS (SELECT grp, k, count(*) queries, avg(p) mp, quantile_cont(p, 0.5) dp, avg(m) ml FROM h GROUP BY 1, 2),
c AS (SELECT grp, label, count(*) n FROM lab WHERE label IS NOT NULL GROUP BY 1, 2), s AS (SELECT grp, sum(n)::BIGINT labelled, count(*) classes, max(n) / sum(n) top, sum(n * (n - 1)) / nullif(sum(n) * (sum(n) - 1), 0) e FROM c GROUP BY 1)
SELECT g.grp, k, queries, labelled, classes, round(mp, 6) mean_precision, round(dp, 6) median_precision, round(ml, 6) mean_labelled, round(top, 6) largest_share, round(e, 6) expected, round(mp / nullif(e, 0), 6) enrichment FROM g JOIN s ON s.grp = g.grp"""


def label_control(spark: SparkSession, folder: str) -> DataFrame:
    """Precision at 5 when labels are handed round inside groups, 100 times."""
    out = L.permutation_control(_near(spark, folder), written(_labelled(spark, folder), "labelled"), 5, 100)
    return out.select("grp", "replicates", *(ROUND(c) for c in out.columns[2:]))


_TURNED = lambda at, n, r: f"CASE WHEN {n} > 1 THEN ({at} + 1 + ({r} * 7919) % ({n} - 1)) % {n} ELSE {at} END"
CONTROL_SQL = f"""WITH {CACHED_SQL}, {LABELS_SQL}, {_LAB}, {asks_sql(K)},
num AS (SELECT grp, id, label, row_number() OVER (PARTITION BY grp ORDER BY sha1('0|' || id::VARCHAR), id) - 1 AS at, count(*) OVER (PARTITION BY grp) n FROM lab WHERE label IS NOT NULL),
e AS (SELECT q.grp, n.query_id, q.at qa, b.at ba, q.n FROM near n JOIN num q ON q.id = n.query_id JOIN num b ON b.id = n.neighbor_id WHERE rank <= 5),
t AS MATERIALIZED (SELECT e.grp, r.r, query_id, {_TURNED("qa", "e.n", "r.r")} qt, {_TURNED("ba", "e.n", "r.r")} bt FROM e, (SELECT unnest(range(1, 101)) r) r),
p AS (SELECT t.grp, t.r, query_id, avg((x.label = y.label)::INT) p FROM t JOIN num x ON x.grp = t.grp AND x.at = t.qt JOIN num y ON y.grp = t.grp AND y.at = t.bt GROUP BY 1, 2, 3),
m AS (SELECT grp, r, avg(p) m FROM p GROUP BY 1, 2)
SELECT grp, count(*) replicates, round(avg(m), 6) control_mean, round(stddev_samp(m), 6) control_sd, round(quantile_cont(m, 0.05), 6) control_p05, round(quantile_cont(m, 0.95), 6) control_p95 FROM m GROUP BY 1"""
SEEDS = (42, 7, 123)


def label_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Precision at 5 of random labelled rows, mean and deviation over three seeds."""
    rows = written(_labelled(spark, folder), "labelled")
    out = L.label_baseline(rows, rows.where("id % 100 = 0 and label is not null"), 5, SEEDS)
    return out.select("grp", ROUND("random_mean"), ROUND("random_sd"))


def _baseline_sql() -> str:
    one = lambda s: f"""(WITH lb AS (SELECT * FROM lab WHERE label IS NOT NULL), {_DRAWN("lb", 5, s)}, p AS (SELECT rd.grp, query_id, avg((a.label = b.label)::INT) p FROM rd JOIN lb a ON a.id = query_id JOIN lb b ON b.id = neighbor_id WHERE query_id % 100 = 0 GROUP BY 1, 2)
  SELECT grp, avg(p) m FROM p GROUP BY 1)"""  # noqa: E731
    return f"WITH {CACHED_SQL}, {LABELS_SQL}, {_LAB}, u AS ({' UNION ALL '.join(map(one, SEEDS))}) SELECT grp, round(avg(m), 6) random_mean, round(stddev_samp(m), 6) random_sd FROM u GROUP BY 1"


def label_strata(spark: SparkSession, folder: str) -> DataFrame:
    """Precision at 5 against random labelled rows at most 12 months away, and the enrichment."""
    out = L.stratified_baseline(_near(spark, folder), written(_labelled(spark, folder), "labelled"), 5, 12, SEEDS)
    return out.select("grp", "eligible", *(ROUND(c) for c in ("precision", "random_mean", "random_sd", "enrichment")))


def _strata_sql() -> str:
    one = lambda s: f"""(WITH pl AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY m, sha1('{s}|' || id::VARCHAR), id) - 1 AS at FROM l), q AS (SELECT pl.*, pl.at - low own FROM pl JOIN st USING (grp, m) WHERE id % 100 = 0 AND there > 5 AND id IN (SELECT query_id FROM near)),
  dt AS MATERIALIZED (SELECT q.grp, q.id, q.label, (q.low + (q.own + (q.own * 7919 + {s} + t.t * ((q.there - 1) // 5)) % (q.there - 1) + 1) % q.there)::BIGINT AS place FROM (SELECT q.*, st.low, st.there FROM q JOIN st USING (grp, m)) q, (SELECT unnest(range(0, 5)) t) t),
  d AS (SELECT dt.grp, dt.id, avg((dt.label = b.label)::INT) p FROM dt JOIN pl b ON b.grp = dt.grp AND b.at = dt.place GROUP BY 1, 2)
  SELECT grp, count(*) eligible, avg(p) p FROM d GROUP BY 1)""".replace("SELECT pl.*, pl.at - low own FROM", "SELECT pl.*, pl.at - st.low own FROM")  # noqa: E731
    return f"""WITH {CACHED_SQL}, {LABELS_SQL}, lab AS (SELECT c.id, c.grp, c.month_index, l.label FROM cached c LEFT JOIN labels l ON l.epi = c.epi), {asks_sql(K)},
l AS (SELECT id, grp, label, month_index m FROM lab WHERE label IS NOT NULL AND month_index IS NOT NULL), mo AS (SELECT grp, m, count(*) n FROM l GROUP BY 1, 2),
st AS (SELECT grp, m, coalesce(sum(n) OVER (PARTITION BY grp ORDER BY m RANGE BETWEEN UNBOUNDED PRECEDING AND 13 PRECEDING), 0)::BIGINT low, sum(n) OVER (PARTITION BY grp ORDER BY m RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING)::BIGINT there FROM mo),
u AS ({" UNION ALL ".join(map(one, SEEDS))}), r AS (SELECT grp, max(eligible) eligible, avg(p) random_mean, stddev_samp(p) random_sd FROM u GROUP BY 1),
h AS (SELECT n.grp, query_id, avg((a.label = b.label)::INT) p FROM near n JOIN l q ON q.id = n.query_id JOIN st ON st.grp = q.grp AND st.m = q.m AND there > 5 JOIN lab a ON a.id = n.query_id JOIN lab b ON b.id = n.neighbor_id WHERE rank <= 5 AND a.label IS NOT NULL AND b.label IS NOT NULL GROUP BY 1, 2),
t AS (SELECT grp, avg(p) p FROM h GROUP BY 1)
SELECT r.grp, eligible, round(t.p, 6) AS precision, round(random_mean, 6) random_mean, round(random_sd, 6) random_sd, round(t.p / nullif(random_mean, 0), 6) enrichment FROM r LEFT JOIN t ON t.grp = r.grp"""


def date_control(spark: SparkSession, folder: str) -> DataFrame:
    """For three seeds the median gap in months of true neighbours, of handed-round months and of random rows, and the ratios."""
    rows = written(_asking(spark, folder).where("month_index is not null").select("id", "grp", "month_index", "asks"), "months")
    near = _near(spark, folder, 5)
    median = lambda gaps, name: gaps.groupBy("grp").agg(F.percentile("gap", 0.5).alias(name))
    true, out = written(median(L.month_gaps(near, rows), "true_median"), "medians"), None
    for seed in SEEDS:
        turned = median(L.month_gaps(near, ranks.permuted(rows, "grp", "id", "month_index", seed)), "permuted_median")
        drawn = median(L.month_gaps(L.random_neighbors(rows.where("asks"), rows, 5, seed), rows), "random_median")
        one = true.join(turned, "grp").join(drawn, "grp").select(F.lit(seed).alias("seed"), "grp", "true_median", "permuted_median", "random_median")
        out = one if out is None else out.unionByName(one)
    ratio = lambda c: F.round(F.col("true_median") / F.nullif(F.col(f"{c}_median"), F.lit(0.0)), 6).alias(f"to_{c}")
    return out.select("*", ratio("permuted"), ratio("random"))


def _dates_sql() -> str:
    one = lambda s: f"""(WITH {_DRAWN("mon", 5, s)}, h AS (SELECT n.grp, abs(a.month_index - b.month_index)::DOUBLE gap FROM rd n JOIN mon a ON a.id = n.query_id JOIN mon b ON b.id = n.neighbor_id WHERE n.query_id % 100 = 0),
  tm AS (SELECT x.id, y.month_index FROM num x JOIN num y ON y.grp = x.grp AND y.at = {_TURNED("x.at", "x.n", s)}), p AS (SELECT n.grp, abs(a.month_index - b.month_index)::DOUBLE gap FROM near n JOIN tm a ON a.id = n.query_id JOIN tm b ON b.id = n.neighbor_id)
  SELECT {s} seed, t.grp, t.m true_median, p.m permuted_median, h.m random_median FROM t JOIN (SELECT grp, quantile_cont(gap, 0.5) m FROM p GROUP BY 1) p ON p.grp = t.grp JOIN (SELECT grp, quantile_cont(gap, 0.5) m FROM h GROUP BY 1) h ON h.grp = t.grp)"""  # noqa: E731
    return f"""WITH {CACHED_SQL}, {asks_sql(5)}, mon AS (SELECT grp, id, month_index FROM cached WHERE month_index IS NOT NULL),
num AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sha1('0|' || id::VARCHAR), id) - 1 AS at, count(*) OVER (PARTITION BY grp) n FROM mon),
t AS (SELECT n.grp, quantile_cont(abs(a.month_index - b.month_index)::DOUBLE, 0.5) m FROM near n JOIN mon a ON a.id = n.query_id JOIN mon b ON b.id = n.neighbor_id GROUP BY 1),
u AS ({" UNION ALL ".join(map(one, SEEDS))}) SELECT *, round(true_median / nullif(permuted_median, 0), 6) to_permuted, round(true_median / nullif(random_median, 0), 6) to_random FROM u"""


def label_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows per group and over all."""
    out = stats.coverage(_labelled(spark, folder), "grp", {"label": F.col("label").isNotNull(), "major": F.col("major_clade").isNotNull()})
    return out.select("grp", "n", "label_n", "major_n", ROUND("label_share"), ROUND("major_share"))


COVERAGE_SQL = f"""WITH {CACHED_SQL}, {LABELS_SQL}, {_LAB} SELECT CASE WHEN grouping(grp) = 1 THEN 'Combined' ELSE grp END grp, count(*) n, count(label) label_n, count(major_clade) major_n, round(count(label) / count(*), 6) label_share, round(count(major_clade) / count(*), 6) major_share
FROM lab GROUP BY ROLLUP (grp)"""


def label_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Dense codes of the labels of each group; the window holds one row per label."""
    from pyspark.sql.window import Window

    counts = _labelled(spark, folder).where("label is not null").groupBy("grp", "label").agg(F.count("*").alias("n"))
    return counts.withColumn("code", F.dense_rank().over(Window.partitionBy("grp").orderBy("label")) - 1)


CODES_SQL = f"WITH {CACHED_SQL}, {LABELS_SQL}, {_LAB} SELECT grp, label, count(*) n, (dense_rank() OVER (PARTITION BY grp ORDER BY label) - 1)::INT code FROM lab WHERE label IS NOT NULL GROUP BY grp, label"


def _latent_pairs(spark: SparkSession, folder: str, seed: int = SEED) -> DataFrame:
    rows = cached(spark, folder)
    seq = records(spark, folder).where("ha is not null and na is not null").select(F.col("id").cast("string").alias("epi"), "ha", "na")
    full = written(rows.join(seq, "epi").select("id", "grp", "vector", "ha", "na", "month_index"), "pairs")
    pairs = ranks.sampled_pairs(full, "grp", "id", per_row=2, seed=seed)
    a, b = (full.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "vector", "ha", "na", "month_index"))) for s in ("i", "j"))
    return pairs.join(a, F.col("i") == F.col("id_i")).join(b, F.col("j") == F.col("id_j"))


def spearman_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of vector and sequence distance over sampled pairs."""
    p = _latent_pairs(spark, folder)
    d = p.select("grp", F.round(V.euclidean(F.col("vector_i"), F.col("vector_j")), 9).alias("latent"), F.round(S.weighted_hamming(*(F.col(c) for c in ("ha_i", "ha_j", "na_i", "na_j"))), 9).alias("metric"))
    out = ranks.spearman(written(d, "pairs"), ["grp"], "latent", "metric")
    band = F.when(F.col("rho") > 0.5, "strong").when(F.col("rho") > 0.3, "moderate").when(F.col("rho") > 0.1, "weak").when(F.col("rho").isNotNull(), "none")
    return out.select("grp", "pairs", "omitted", *(ROUND(c) for c in ("rho", "x_mean", "x_sd", "y_mean", "y_sd")), band.alias("band"))


_LATENT_SQL = f"""{CACHED_SQL}, {RECORDS_SQL}, src AS (SELECT c.id, c.grp, c.vector, r.ha, r.na, c.month_index FROM cached c JOIN recs r ON r.id::VARCHAR = c.epi WHERE ha IS NOT NULL AND na IS NOT NULL), {pairs_sql("src", 2, SEED)}"""


def _spearman_sql() -> str:
    from veclore.plans.sequences import _HAM

    return f"""WITH {_LATENT_SQL}, s AS (SELECT p.grp, round(list_distance(a.vector, b.vector), 9) latent, {_HAM("a.ha", "b.ha")} h, {_HAM("a.na", "b.na")} n, least(len(a.ha), len(b.ha)) w1, least(len(a.na), len(b.na)) w2 FROM pairs p JOIN src a ON a.id = p.i JOIN src b ON b.id = p.j),
m AS (SELECT grp, latent, round((h * w1 + n * w2) / nullif(w1 + w2, 0), 9) metric FROM s), v AS (SELECT * FROM m WHERE latent IS NOT NULL AND metric IS NOT NULL),
r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY latent) + (count(*) OVER (PARTITION BY grp, latent) - 1) / 2.0 x, rank() OVER (PARTITION BY grp ORDER BY metric) + (count(*) OVER (PARTITION BY grp, metric) - 1) / 2.0 y FROM v),
k AS (SELECT grp, CASE WHEN count(*) >= 10 THEN corr(x, y) END rho FROM r GROUP BY 1),
f AS (SELECT grp, count(*) FILTER (latent IS NOT NULL AND metric IS NOT NULL) pairs, count(*) FILTER (latent IS NULL OR metric IS NULL) omitted, avg(latent) FILTER (metric IS NOT NULL) a, stddev_pop(latent) FILTER (metric IS NOT NULL) b, avg(metric) FILTER (latent IS NOT NULL) c, stddev_pop(metric) FILTER (latent IS NOT NULL) d FROM m GROUP BY 1)
SELECT f.grp, pairs, omitted, round(rho, 6) rho, round(a, 6) x_mean, round(b, 6) x_sd, round(c, 6) y_mean, round(d, 6) y_sd, CASE WHEN rho > 0.5 THEN 'strong' WHEN rho > 0.3 THEN 'moderate' WHEN rho > 0.1 THEN 'weak' WHEN rho IS NOT NULL THEN 'none' END band FROM f LEFT JOIN k ON k.grp = f.grp"""


def spearman_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation of the correlation of distance and month gap over three seeds."""
    rows, out = cached(spark, folder).where("month_index is not null"), None
    rows = written(rows, "rows")
    for seed in (42, 7, 123):
        p = ranks.sampled_pairs(rows, "grp", "id", 2, seed)
        a, b = (rows.select(F.col("id").alias(s), F.col("vector").alias(f"v{s}"), F.col("month_index").alias(f"m{s}")) for s in ("i", "j"))
        d = p.join(a, "i").join(b, "j").select("grp", F.round(V.euclidean(F.col("vi"), F.col("vj")), 9).alias("d"), F.abs(F.col("mi") - F.col("mj")).alias("m"))
        one = ranks.spearman(written(d, "pairs"), ["grp"], "d", "m")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("grp").agg(F.count("rho").alias("seeds"), F.round(F.avg("rho"), 6).alias("mean_rho"), F.round(F.stddev_pop("rho"), 6).alias("sd_rho"))


def _seeds_sql() -> str:
    one = lambda s: f"""(WITH {pairs_sql("src", 2, s)}, d AS (SELECT p.grp, round(list_distance(a.vector, b.vector), 9) d, abs(a.month_index - b.month_index) m FROM pairs p JOIN src a ON a.id = p.i JOIN src b ON b.id = p.j),
  r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY d) + (count(*) OVER (PARTITION BY grp, d) - 1) / 2.0 x, rank() OVER (PARTITION BY grp ORDER BY m) + (count(*) OVER (PARTITION BY grp, m) - 1) / 2.0 y FROM d)
  SELECT grp, CASE WHEN count(*) >= 10 THEN corr(x, y) END rho FROM r GROUP BY 1)"""  # noqa: E731
    return f"WITH {CACHED_SQL}, src AS (SELECT * FROM cached WHERE month_index IS NOT NULL), u AS ({' UNION ALL '.join(one(s) for s in (42, 7, 123))}) SELECT grp, count(rho) seeds, round(avg(rho), 6) mean_rho, round(stddev_pop(rho), 6) sd_rho FROM u GROUP BY 1"


def embedding_control(spark: SparkSession, folder: str) -> DataFrame:
    """The correlation with sequence distance when vectors are handed round inside groups, 20 times, the pairs fixed."""
    p = written(_latent_pairs(spark, folder).select("grp", "i", "j", F.round(S.weighted_hamming(*(F.col(c) for c in ("ha_i", "ha_j", "na_i", "na_j"))), 9).alias("metric")), "pairs")
    placed = written(ranks.numbered(cached(spark, folder).select("id", "grp", "vector"), "grp", "id"), "places")
    at = placed.select("id", "at", "size")
    d = p.join(at.select(F.col("id").alias("i"), F.col("at").alias("at_i"), "size"), "i").join(at.select(F.col("id").alias("j"), F.col("at").alias("at_j")), "j").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(20))))
    for e in ("i", "j"):
        d = d.withColumn("at", ranks.rotated(F.col(f"at_{e}"), F.col("size"), F.col("replicate"))).join(placed.select("grp", "at", F.col("vector").alias(f"v{e}")), ["grp", "at"]).drop("at")
    d = d.select("grp", "replicate", F.round(V.euclidean(F.col("vi"), F.col("vj")), 9).alias("d"), "metric")
    rho = ranks.spearman(written(d, "pairs"), ["grp", "replicate"], "d", "metric")
    out = rho.groupBy("grp").agg(F.count("rho").alias("replicates"), F.avg("rho").alias("mean"), F.stddev_samp("rho").alias("sd"), F.percentile("rho", 0.05).alias("p05"), F.percentile("rho", 0.95).alias("p95"))
    return out.select("grp", "replicates", *(ROUND(c) for c in ("mean", "sd", "p05", "p95")))


def _embedding_sql() -> str:
    from veclore.plans.sequences import _HAM

    return f"""WITH {_LATENT_SQL}, s AS (SELECT p.grp, p.i, p.j, {_HAM("a.ha", "b.ha")} h, {_HAM("a.na", "b.na")} n, least(len(a.ha), len(b.ha)) w1, least(len(a.na), len(b.na)) w2 FROM pairs p JOIN src a ON a.id = p.i JOIN src b ON b.id = p.j),
m AS MATERIALIZED (SELECT grp, i, j, round((h * w1 + n * w2) / nullif(w1 + w2, 0), 9) metric FROM s),
pl AS MATERIALIZED (SELECT grp, id, vector, row_number() OVER (PARTITION BY grp ORDER BY sha1('0|' || id::VARCHAR), id) - 1 AS at, count(*) OVER (PARTITION BY grp) n FROM cached),
e AS MATERIALIZED (SELECT m.grp, metric, x.at xa, y.at ya, x.n FROM m JOIN pl x ON x.id = m.i JOIN pl y ON y.id = m.j WHERE metric IS NOT NULL),
t AS MATERIALIZED (SELECT e.grp, r.r, metric, {_TURNED("xa", "e.n", "r.r")} xt, {_TURNED("ya", "e.n", "r.r")} yt FROM e, (SELECT unnest(range(1, 21)) r) r),
d AS MATERIALIZED (SELECT t.grp, t.r, metric, round(list_distance(x.vector, y.vector), 9) d FROM t JOIN pl x ON x.grp = t.grp AND x.at = t.xt JOIN pl y ON y.grp = t.grp AND y.at = t.yt),
k AS (SELECT grp, r, rank() OVER (PARTITION BY grp, r ORDER BY d) + (count(*) OVER (PARTITION BY grp, r, d) - 1) / 2.0 x, rank() OVER (PARTITION BY grp, r ORDER BY metric) + (count(*) OVER (PARTITION BY grp, r, metric) - 1) / 2.0 y FROM d),
c AS (SELECT grp, r, CASE WHEN count(*) >= 10 THEN corr(x, y) END rho FROM k GROUP BY 1, 2)
SELECT grp, count(rho) replicates, round(avg(rho), 6) mean, round(stddev_samp(rho), 6) sd, round(quantile_cont(rho, 0.05), 6) p05, round(quantile_cont(rho, 0.95), 6) p95 FROM c GROUP BY 1"""


def random_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The correlation for random unit vectors drawn from the ids, 10 draws over the pairs of each of three seeds."""
    out = []
    for seed in SEEDS:
        p = _latent_pairs(spark, folder, seed).select("grp", "i", "j", S.weighted_hamming(*(F.col(c) for c in ("ha_i", "ha_j", "na_i", "na_j"))).alias("metric"))
        d = p.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(10)))).select("grp", "replicate", V.random_distance(F.col("i"), F.col("j"), F.col("replicate") + 1000 * seed).alias("d"), "metric")
        out.append(ranks.spearman(written(d, "pairs"), ["grp", "replicate"], "d", "metric").select("grp", "rho"))
    rho = functools.reduce(DataFrame.unionByName, out)
    return rho.groupBy("grp").agg(F.count("rho").alias("draws"), F.avg("rho").alias("mean"), F.stddev_samp("rho").alias("sd"), F.percentile("rho", 0.05).alias("p05"), F.percentile("rho", 0.95).alias("p95"))


def covariance_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Covariance matrix of each group."""
    return stats.covariance(cached(spark, folder), "vector", "grp").select("grp", "i", "j", (F.round("cov", 5) + 0.0).alias("cov"))


COVARIANCE_SQL = f"""WITH {CACHED_SQL}, f AS (SELECT grp, id, unnest(vector) x, unnest(range(0, 64)) p FROM cached)
SELECT a.grp, a.p::INT i, b.p::INT j, round(coalesce(covar_samp(a.x, b.x), 0), 5) + 0.0 AS cov FROM f a JOIN f b ON a.id = b.id GROUP BY 1, 2, 3"""


def pca_spectrum(spark: SparkSession, folder: str) -> DataFrame:
    """Effective dimensions per group and over all."""
    rows = written(cached(spark, folder).select("grp", "vector"), "rows")
    return stats.spectrum(rows, "vector", "grp").unionByName(stats.spectrum(rows, "vector")).drop("shares", "reached")


def spectrum_values(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest shares of variance of each group, in descending order, and the share reached with each."""
    s = stats.spectrum(cached(spark, folder), "vector", "grp")
    each = s.select("grp", F.posexplode(F.arrays_zip("shares", "reached")).alias("i", "e")).where("i < 10")
    return each.select("grp", (F.col("i") + 1).alias("component"), F.round("e.shares", 6).alias("share"), F.round("e.reached", 6).alias("reached")).orderBy("grp", F.desc("share"), "component")


def standard_features(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation of each standardised dimension (0 and 1)."""
    flat = stats.standardised(cached(spark, folder), "vector").select(F.posexplode("vector").alias("pos", "x"))
    return flat.groupBy("pos").agg(F.count("*").alias("n"), (F.round(F.avg("x"), 4) + 0.0).alias("mean"), F.round(F.stddev_pop("x"), 4).alias("sd"))


STANDARD_SQL = f"WITH {CACHED_SQL}, f AS (SELECT unnest(vector) x, unnest(range(0, 64)) pos FROM cached) SELECT pos::INT pos, count(*) n, 0.0 mean, CASE WHEN stddev_pop(x) >= 1e-12 THEN 1.0 ELSE 0.0 END sd FROM f GROUP BY 1"


def projected_points(spark: SparkSession, folder: str) -> DataFrame:
    """First two principal coordinates, and the vector without them."""
    rows = cached(spark, folder)
    mean, axes = stats.principal_axes(rows, "vector", 2)
    xy = V.projected(F.col("vector"), mean, axes)
    rest = rows.withColumn("rest", V.without(F.col("vector"), mean, axes)).withColumn("xy", xy)
    return rest.select("id", "grp", F.round(F.col("xy")[0], 6).alias("x"), F.round(F.col("xy")[1], 6).alias("y"), F.round(V.norm(F.col("rest")), 6).alias("rest_norm"), F.transform("rest", lambda v: F.round(v, 5)).alias("rest"))


def vector_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Of sampled pairs, the cosine distance, the unit vectors' distance, and of the straight path in 20 steps
    between them the norm half way, the variation of the step lengths and the ratio of its smallest to its largest norm."""
    rows = written(cached(spark, folder), "rows")
    p = ranks.sampled_pairs(rows, "grp", "id", 1, SEED)
    a, b = (rows.select(F.col("id").alias(s), F.col("vector").alias(f"v{s}")) for s in ("i", "j"))
    x, y = F.col("vi"), F.col("vj")
    full = p.join(a, "i").join(b, "j").select("grp", "i", "j", V.cosine_distance(x, y).alias("cosine"), V.euclidean(V.unit(x), V.unit(y)).alias("unit_distance"), V.norm(V.between(x, y, F.lit(0.5))).alias("middle"), V.path_facts(x, y).alias("path"))
    return full.select("grp", "i", "j", ROUND("cosine"), ROUND("unit_distance"), ROUND("middle"), F.round("path.variation", 6).alias("variation"), F.round("path.norm_ratio", 6).alias("norm_ratio"))


PATHS_SQL = f"""WITH {CACHED_SQL}, {pairs_sql("cached", 1, SEED)}, v AS (SELECT p.grp, p.i, p.j, a.vector x, b.vector y FROM pairs p JOIN cached a ON a.id = p.i JOIN cached b ON b.id = p.j),
q AS (SELECT *, list_inner_product(x, x) xx, list_inner_product(y, y) yy, list_inner_product(x, y) xy FROM v),
n AS (SELECT *, list_transform(range(0, 21), lambda t: sqrt(greatest((1 - t / 20) ** 2 * xx + 2 * t / 20 * (1 - t / 20) * xy + (t / 20) ** 2 * yy, 0))) norms FROM q)
SELECT grp, i, j, round(1 - list_cosine_similarity(x, y), 6) cosine, round(sqrt(2 - 2 * list_cosine_similarity(x, y)), 6) unit_distance, round(norms[11], 6) middle, 0.0 AS variation, round(list_min(norms) / nullif(list_max(norms), 0), 6) norm_ratio FROM n"""


def neighbor_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of the two nearest distances and of their ratio, and how many distances are zero."""
    r = written(stats.two_neighbors(_near(spark, folder, 2)), "ratios")
    valid = F.col("mu").isNotNull()
    zeros = [F.count_if(F.col(c) <= 1e-12).alias(f"{c}_zero") for c in ("r1", "r2")]
    out = r.groupBy("grp").agg(F.count("mu").alias("n"), *zeros)
    for c in ("r1", "r2", "mu"):
        spread = ranks.quantiles(r.where(valid), ["grp"], c, {f"{c}_{int(q * 100)}": q for q in (0.1, 0.5, 0.9)})
        out = out.join(spread.select("grp", *(F.round(n, 6).alias(n) for n in spread.columns[1:])), "grp", "left")
    return out


RATIOS_SQL = f"""WITH {CACHED_SQL}, {asks_sql(2)}, r AS (SELECT grp, query_id, min(distance) r1, max(distance) r2 FROM near GROUP BY 1, 2 HAVING count(*) = 2), v AS (SELECT *, CASE WHEN r1 > 1e-12 AND r2 > r1 THEN r2 / r1 END mu FROM r)
SELECT grp, count(mu) n, count(*) FILTER (r1 <= 1e-12) r1_zero, count(*) FILTER (r2 <= 1e-12) r2_zero, {", ".join(f"round(quantile_cont({c}, {q}) FILTER (mu IS NOT NULL), 6) {c}_{int(q * 100)}" for c in ("r1", "r2", "mu") for q in (0.1, 0.5, 0.9))} FROM v GROUP BY 1"""


_DIMENSION = ("dimension", "intercept", "r2", "mu_min", "mu_median", "mu_max")


def intrinsic_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """Two-neighbour dimension of the standardised vectors of each group, for two trims."""
    rows = stats.standardised_by(_asking(spark, folder), "vector", "grp", 64)
    r, out = written(stats.two_neighbors(knn.exact_neighbors(rows, 2)), "ratios"), None
    for trim in (0.01, 0.05):
        one = stats.two_neighbor_dimension(r, trim=trim, least=3).select(F.lit(trim).alias("trim"), "grp", "n", "invalid", "trimmed", *(ROUND(c) for c in _DIMENSION))
        out = one if out is None else out.unionByName(one)
    return out


_STANDARD = """dims AS (SELECT grp, p, avg(x) m, stddev_pop(x) s FROM (SELECT grp, unnest(vector) x, unnest(range(0, 64)) p FROM {src}) GROUP BY 1, 2),
{name} AS (SELECT c.id, c.grp, list((c.x - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END ORDER BY c.p) vector FROM (SELECT id, grp, unnest(vector) x, unnest(range(0, 64)) p FROM {src}) c JOIN dims d ON d.grp = c.grp AND d.p = c.p GROUP BY 1, 2)"""


def _dimension_sql() -> str:
    one = lambda t: f"""(WITH e AS (SELECT grp, count(*) c, quantile_cont(mu, {t}) lo, quantile_cont(mu, {1 - t}) hi FROM w WHERE mu IS NOT NULL GROUP BY 1), k AS (SELECT w.* FROM w JOIN e ON e.grp = w.grp WHERE mu IS NOT NULL AND (c <= 10 OR mu BETWEEN lo AND hi)),
  c AS (SELECT grp, mu, ln(mu) x, -ln(1 - (row_number() OVER (PARTITION BY grp ORDER BY mu, query_id) - 0.5) / count(*) OVER (PARTITION BY grp)) y FROM k),
  f AS (SELECT grp, count(mu) valid, count(*) FILTER (mu IS NULL) invalid FROM w GROUP BY 1),
  g AS (SELECT grp, count(*) n, regr_slope(y, x) a, regr_intercept(y, x) b, regr_r2(y, x) c, min(mu) lo, quantile_cont(mu, 0.5) md, max(mu) hi FROM c GROUP BY 1)
  SELECT {t}::DOUBLE AS trim, f.grp, coalesce(n, 0) n, invalid, valid - coalesce(n, 0) trimmed, round(CASE WHEN n >= 3 THEN a END, 6) dimension, round(CASE WHEN n >= 3 THEN b END, 6) intercept, round(CASE WHEN n >= 3 THEN c END, 6) r2, round(lo, 6) mu_min, round(md, 6) mu_median, round(hi, 6) mu_max FROM f LEFT JOIN g ON g.grp = f.grp)"""  # noqa: E731
    source = CACHED_SQL.replace("cached AS (", "cached1 AS (")
    return f"WITH {source}, {_STANDARD.format(src='cached1', name='cached')}, {asks_sql(2)}, r AS (SELECT grp, query_id, min(distance) r1, max(distance) r2 FROM near GROUP BY 1, 2 HAVING count(*) = 2), w AS (SELECT *, CASE WHEN r1 > 1e-12 AND r2 > r1 THEN r2 / r1 END mu FROM r) " + " UNION ALL ".join(one(t) for t in (0.01, 0.05))


def dimension_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The dimension over sample sizes, seeds and trims; ``status`` tells where too few ratios are left. All samples
    are one search: a sample of a group is a group of its own."""
    rows, parts = written(cached(spark, folder).select("id", "grp", "vector"), "rows"), []
    for seed in (42, 7):
        placed = ranks.numbered(rows, "grp", "id", seed)
        parts.append(placed.withColumn("sample", F.explode(F.array(*map(F.lit, (500, 2000))))).where("at < sample").select("id", F.concat_ws("/", "grp", "sample", F.lit(seed)).alias("grp"), "vector"))
    drawn = written(stats.standardised_by(functools.reduce(DataFrame.unionByName, parts), "vector", "grp", 64), "samples")
    near = written(stats.two_neighbors(_unique_queries(drawn)), "ratios")
    sizes, out = drawn.groupBy("grp").agg(F.count("*").alias("used")), None
    for trim in (0.01, 0.05):
        one = stats.two_neighbor_dimension(near, trim=trim).join(sizes, "grp").select(F.split_part("grp", F.lit("/"), F.lit(1)).alias("grp"), F.split_part("grp", F.lit("/"), F.lit(2)).cast("int").alias("requested"), F.split_part("grp", F.lit("/"), F.lit(3)).cast("int").alias("seed"), F.lit(trim).alias("trim"), "used", "n", "invalid", ROUND("dimension"), ROUND("r2"), F.when(F.col("dimension").isNull(), "few").otherwise("ok").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def _unique_queries(drawn: DataFrame) -> DataFrame:
    """Two neighbours inside each sample of its rows whose id is divisible by 100; an id stands in several samples, so the
    samples' names are part of the ids."""
    named = drawn.select(F.concat_ws("/", "grp", F.format_string("%018d", "id")).alias("key"), "grp", "vector", (F.col("id") % 100 == 0).alias("asks"))
    return knn.exact_neighbors(named, 2, key="key")


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector of each month, one row per dimension."""
    c = series.monthly_centroids(cached(spark, folder))
    return c.select("grp", "month_index", "n", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


CENTROIDS_SQL = f"WITH {CACHED_SQL}, f AS (SELECT grp, month_index, unnest(vector) v, unnest(range(0, 64)) pos FROM cached WHERE month_index IS NOT NULL) SELECT grp, month_index, count(*) n, pos::INT pos, round(avg(v), 6) x FROM f GROUP BY grp, month_index, pos"


def context_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Three kept months before each kept month."""
    return series.context_windows(cached(spark, folder))


CONTEXT_SQL = f"""WITH {CACHED_SQL}, k AS (SELECT grp, month_index m, count(*) n, min(id) f FROM cached WHERE month_index IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5),
w AS (SELECT grp, m target_month, f target_id, n target_n, {", ".join(f"lag(m, {i}) OVER q month_{i}, lag(f, {i}) OVER q id_{i}" for i in (3, 2, 1))} FROM k WINDOW q AS (PARTITION BY grp ORDER BY m)) SELECT * FROM w WHERE month_3 IS NOT NULL"""


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    return cached(spark, folder).where("month_index is not null").groupBy("grp", "month_index").agg(F.count("*").alias("n"), F.avg(F.col("vector")[0]).alias("x"))


_MONTHLY_SQL = f"{CACHED_SQL}, ms AS (SELECT grp, month_index, count(*) n, avg(vector[1]) x FROM cached WHERE month_index IS NOT NULL GROUP BY 1, 2)"


def month_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Values of the two months before, steps, and the mean of all earlier months."""
    s = series.expanding_mean(series.lagged(_monthly(spark, folder), "x"), "x")
    r = lambda c, n: F.round(c, 6).alias(n)
    return s.select("grp", S.month_label(F.col("month_index")).alias("month"), "n", r("x", "x"), r("lag1", "lag1"), r("lag2", "lag2"), r(F.col("x") - F.col("lag1"), "step"), r("earlier_mean", "earlier_mean"))


STEPS_SQL = f"""WITH {_MONTHLY_SQL}, l AS (SELECT *, CASE WHEN month_index - lag(month_index, 1) OVER w = 1 THEN lag(x, 1) OVER w END lag1, CASE WHEN month_index - lag(month_index, 2) OVER w = 2 THEN lag(x, 2) OVER w END lag2,
  avg(x) OVER (PARTITION BY grp ORDER BY month_index RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) em FROM ms WINDOW w AS (PARTITION BY grp ORDER BY month_index))
SELECT grp, printf('%04d-%02d', (month_index // 12)::INT, (month_index % 12 + 1)::INT) AS month, n, round(x, 6) x, round(lag1, 6) lag1, round(lag2, 6) lag2, round(x - lag1, 6) step, round(em, 6) earlier_mean FROM l"""


def simple_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of last value and last step, and their ratio."""
    out = series.persistence_errors(_monthly(spark, folder), "x")
    return out.select("grp", "model", "n", ROUND("rmse"), ROUND("mae"), ROUND("ratio"))


_ERRORS_SQL = f"""{_MONTHLY_SQL}, l AS (SELECT *, CASE WHEN month_index - lag(month_index, 1) OVER w = 1 THEN lag(x, 1) OVER w END a, CASE WHEN month_index - lag(month_index, 2) OVER w = 2 THEN lag(x, 2) OVER w END b FROM ms WINDOW w AS (PARTITION BY grp ORDER BY month_index)),
e AS (SELECT grp, 'persistence' AS model, x - a e FROM l WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT grp, 'velocity', x - 2 * a + b FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
g AS (SELECT grp, model, count(*) n, sqrt(avg(e * e)) rmse, avg(abs(e)) mae FROM e GROUP BY 1, 2),
o AS (SELECT grp, model, n, rmse, mae, rmse / nullif(max(CASE WHEN model = 'persistence' THEN rmse END) OVER (PARTITION BY grp), 0) ratio FROM g)"""
SIMPLE_SQL = f"WITH {_ERRORS_SQL} SELECT grp, model, n, round(rmse, 6) rmse, round(mae, 6) mae, round(ratio, 6) ratio FROM o"


def best_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """The model with the smallest error in each group."""
    return series.best_rows(series.persistence_errors(_monthly(spark, folder), "x").select("grp", "model", F.round("rmse", 6).alias("rmse")), ["grp"], "rmse")


BEST_SQL = f"WITH {_ERRORS_SQL} SELECT grp, model, rmse FROM (SELECT grp, model, round(rmse, 6) rmse, row_number() OVER (PARTITION BY grp ORDER BY round(rmse, 6), model) r FROM o) WHERE r = 1"


def rolling_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Forecasts refitted for every month from the third year on, with coverage of their regions."""
    rows = cached(spark, folder)
    mean, axes = stats.principal_axes(rows, "vector", 3)
    flat = rows.withColumn("vector", V.projected(F.col("vector"), mean, axes))
    s = series.monthly_centroids(flat)
    first = s.agg(F.min("month_index")).first()[0] or 0
    return series.forecast_report(series.rolling_forecasts(s, int(first) + 24, 40_000, [1, 3]))


def calibration_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Calibration error over covariance kinds, regularisation, inflation and dimensions; the best setting per group and model."""
    rows = cached(spark, folder)
    mean, axes = stats.principal_axes(rows, "vector", 4)
    s = written(series.monthly_centroids(rows.withColumn("vector", V.projected(F.col("vector"), mean, axes))), "series")
    first, out = s.agg(F.min("month_index")).first()[0] or 0, None
    for kind, inflation, reg in itertools.product(("full", "diagonal"), (1.0, 1.5), (1e-6, 1e-3)):
        one = series.forecast_report(series.rolling_forecasts(s, int(first) + 24, 40_000, [1, 2, 4], reg=reg, kind=kind, inflation=inflation))
        one = one.where("mean_nll is not null").select(F.lit(kind).alias("kind"), F.lit(inflation).alias("inflation"), F.lit(reg).alias("reg"), "dim", "grp", "model", "targets", "calibration_error")
        out = one if out is None else out.unionByName(one)
    return series.best_rows(out, ["grp", "model"], "calibration_error")


def year_sample(spark: SparkSession, folder: str) -> DataFrame:
    """7 rows of each group with the smallest hashes."""
    return ranks.smallest_hashes(cached(spark, folder).select("grp", "id"), ["grp"], "id", 7, SEED)


SAMPLE_SQL = f"WITH {CACHED_SQL} SELECT grp, id FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY sha1('{SEED}|' || id::VARCHAR), id) r FROM cached) WHERE r <= 7"


def half_split(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each group in the calibration half and in the test half."""
    return ranks.half_split(cached(spark, folder).select("grp", "id"), ["grp"], "id", SEED).groupBy("grp", "split").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


SPLIT_SQL = f"""WITH {CACHED_SQL}, r AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY sha1('{SEED}|' || id::VARCHAR), id) r, count(*) OVER (PARTITION BY grp) n FROM cached)
SELECT grp, CASE WHEN r <= n // 2 THEN 'cal' ELSE 'test' END AS split, count(*) n, sum(id)::BIGINT ids FROM r GROUP BY 1, 2"""


def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Accessions of the cache and of the records: union, distinct, both, and only one of them."""
    a, b = cached(spark, folder).select("epi").where("epi is not null"), records(spark, folder).select(F.col("id").cast("string").alias("epi"))
    da, db = a.distinct(), b.distinct()
    parts = [("all", a.unionByName(b)), ("distinct", a.unionByName(b).distinct()), ("both", da.join(db, "epi", "left_semi")), ("cache_only", da.join(db, "epi", "left_anti")), ("records_only", db.exceptAll(da))]
    out = None
    for name, rows in parts:
        one = rows.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


SETS_SQL = f"""WITH {CACHED_SQL}, {RECORDS_SQL}, a AS (SELECT epi FROM cached WHERE epi IS NOT NULL), b AS (SELECT id::VARCHAR epi FROM recs), da AS (SELECT DISTINCT epi FROM a), db AS (SELECT DISTINCT epi FROM b)
SELECT 'all' AS part, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) n UNION ALL SELECT 'distinct', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'both', count(*) FROM da WHERE epi IN (SELECT epi FROM db)
UNION ALL SELECT 'cache_only', count(*) FROM da WHERE epi NOT IN (SELECT epi FROM db) UNION ALL SELECT 'records_only', count(*) FROM db WHERE epi NOT IN (SELECT epi FROM da)"""

QUERIES = {f.__name__: f for f in (knn_exact, knn_cosine, knn_band, temporal_neighbors, random_gaps, band_counts, label_precision, label_control, label_baseline, label_strata, date_control, label_coverage, label_codes, spearman_pairs, spearman_seeds, embedding_control, random_vectors, covariance_cells, pca_spectrum, spectrum_values, standard_features, projected_points, vector_paths, neighbor_ratios, intrinsic_dimension, dimension_grid, centroids, context_windows, month_steps, simple_forecasts, best_forecasts, rolling_forecasts, calibration_grid, year_sample, half_split, set_operations)}
ORACLES = {
    "random_gaps": GAPS_SQL, "label_control": CONTROL_SQL, "label_baseline": _baseline_sql(), "label_strata": _strata_sql(), "date_control": _dates_sql(), "embedding_control": _embedding_sql(),
    "knn_exact": KNN_SQL, "knn_cosine": COSINE_SQL, "knn_band": BAND_SQL, "temporal_neighbors": TEMPORAL_SQL, "band_counts": BAND_COUNTS_SQL, "label_precision": PRECISION_SQL, "label_coverage": COVERAGE_SQL, "label_codes": CODES_SQL, "spearman_pairs": _spearman_sql(), "spearman_seeds": _seeds_sql(),
    "covariance_cells": COVARIANCE_SQL, "standard_features": STANDARD_SQL, "vector_paths": PATHS_SQL, "neighbor_ratios": RATIOS_SQL, "intrinsic_dimension": _dimension_sql(), "centroids": CENTROIDS_SQL, "context_windows": CONTEXT_SQL, "month_steps": STEPS_SQL, "simple_forecasts": SIMPLE_SQL, "best_forecasts": BEST_SQL,
    "year_sample": SAMPLE_SQL, "half_split": SPLIT_SQL, "set_operations": SETS_SQL,
}

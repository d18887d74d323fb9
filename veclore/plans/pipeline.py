"""Queries through files and streams, on summaries and reports, and on ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veclore.functions import sequences as S
from veclore.functions import vectors as V
from veclore.operators import ranking, ranks, series, stats
from veclore.operators.records import representatives
from veclore.operators.sampling import stratified
from veclore.plans.base import CACHED_SQL, RECORDS_SQL, acc_sql, cached, clean_sql, records
from veclore.plans.sequences import _CODON, _HAM, _MM
from veclore.runtime import place, written
from veclore.sources import fasta, reports
from veclore.sources import tables as files
from veclore.streaming import jobs
from veclore.tables import accession, table


def fasta_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Records written as FASTA, one file set per segment, read back, parsed and paired."""
    r = records(spark, folder).where("year is not null and ha is not null and na is not null")
    date = F.format_string("%d-%02d-%02d", "year", F.coalesce("month", F.lit(6)), F.lit(15))
    paths = []
    for segment, mark, column in (("HA", "4", "ha"), ("NA", "NA", "na")):
        paths.append(place(spark, f"fasta-{segment}"))
        head = F.concat_ws("|", "id", F.replace(F.coalesce("strain_name", F.lit("?")), F.lit(" "), F.lit("_")), F.concat(F.lit("A_/_"), F.coalesce("grp", F.lit("?"))), date, F.lit(mark))
        fasta.write_fasta(r.where(f"{column} != ''").select(head.alias("header"), F.col(column).alias("sequence")), paths[-1])
    rows = fasta.parsed_headers(fasta.read_fasta(spark, [*paths, paths[0] + "-missing"], last=True))
    out = rows.groupBy("epi_isl").agg(*(F.max(c).alias(c) for c in ("strain_name", "subtype", "year", "month", "day")), *(F.max(F.when(F.col("segment") == s, F.md5("sequence"))).alias(s.lower()) for s in ("HA", "NA")))
    return out


FASTA_SQL = f"""WITH {RECORDS_SQL} SELECT id::VARCHAR epi_isl, coalesce(replace(strain_name, '_', ' '), '?') strain_name, CASE WHEN grp IS NULL THEN 'A_/_?' ELSE grp END subtype, year, coalesce(month, 6) AS month, 15 AS day,
  CASE WHEN ha <> '' THEN md5(ha) END ha, CASE WHEN na <> '' THEN md5(na) END na FROM recs WHERE year IS NOT NULL AND ha IS NOT NULL AND na IS NOT NULL AND (ha <> '' OR na <> '')"""


def dataset_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Paired records as JSON by subtype, read back and counted."""
    path = place(spark, "dataset")
    files.write_dataset(records(spark, folder).where("grp is not null").select(F.col("grp").alias("subtype"), "id", "ha", "na", "year", "month"), path)
    back = files.read_dataset(spark, path, "subtype string, id bigint, ha string, na string, year int, month int")
    return back.groupBy("subtype", "year").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum(F.length("ha")).alias("letters"))


DATASET_SQL = f"WITH {RECORDS_SQL} SELECT grp subtype, year, count(*) n, sum(id)::BIGINT ids, sum(len(ha))::BIGINT letters FROM recs WHERE grp IS NOT NULL GROUP BY 1, 2"


def label_file(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata as CSV in the order of loading, read back with aliases and null tokens resolved; the last line of a key wins."""
    path = place(spark, "labels")
    meta = table(spark, folder, "clade_metadata")
    key = accession(F.coalesce(F.nullif(F.trim("epi_isl"), F.lit("")), F.col("isolate_id")))
    lines = meta.select(F.lit(None).cast("string").alias("epi_isl"), key.alias("Isolate_Id"), "matched", "clade_raw", F.col("clade").alias("Clade"), "major_clade", F.col("lineage").alias("Lineage"), F.col("genotype").alias("Genotype"), F.col("loaded_at").alias("__t"), "meta_id")
    # one file per key range, sorted inside: lines of a key stay in order
    lines.repartitionByRange(8, "Isolate_Id").sortWithinPartitions("Isolate_Id", "__t", "meta_id").drop("__t", "meta_id").write.option("header", True).option("emptyValue", "").csv(path)
    return files.read_labels(spark, path)


LABEL_FILE_SQL = f"""SELECT epi_isl, matched, coalesce(raw, clade) clade_raw, clade, coalesce(major, array_to_string(list_slice(string_split(clade, '.'), 1, 2), '.')) major_clade, lineage, genotype FROM (
  SELECT {acc_sql("coalesce(nullif(trim(epi_isl), ''), isolate_id)")} epi_isl, lower(nullif(trim(matched), '')) = 'true' matched, {clean_sql("coalesce(nullif(trim(clade_raw), ''), nullif(trim(clade), ''))")} raw, {clean_sql("nullif(trim(clade), '')")} clade, {clean_sql("nullif(trim(major_clade), '')")} major,
  {clean_sql("nullif(trim(lineage), '')")} lineage, {clean_sql("nullif(trim(genotype), '')")} genotype, row_number() OVER (PARTITION BY {acc_sql("coalesce(nullif(trim(epi_isl), ''), isolate_id)")} ORDER BY loaded_at DESC NULLS LAST, meta_id DESC) rn FROM clade_metadata) WHERE rn = 1 AND epi_isl IS NOT NULL"""
LABEL_FILE_SQL = LABEL_FILE_SQL.replace("coalesce(raw, clade) clade_raw", "raw clade_raw")


def resumed_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache written by type and checked, half of it first, then all of it twice; no id is repeated."""
    path = place(spark, "cache")
    rows = cached(spark, folder).select("id", "grp", F.size("vector").alias("size"), "month_index")
    rows.where("month_index is null or month_index % 2 = 0").write.parquet(path)
    for _ in range(2):
        files.append_new(rows, path)
    back = spark.read.parquet(path)
    return back.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("size").alias("size"))


RESUMED_SQL = f"WITH {CACHED_SQL} SELECT grp, count(*) n, count(DISTINCT id) ids, max(len(vector))::INT AS size FROM cached GROUP BY 1"


def checked_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A cache that passes its checks, counted by type."""
    rows = cached(spark, folder).select("id", F.col("vector").alias("embeddings"), F.floor(F.col("month_index") / 12).alias("years"), (F.col("month_index") % 12 + 1).alias("months"), F.col("grp").alias("types"))
    return files.checked_cache(written(rows, "cache"), 64).groupBy("types").agg(F.count("*").alias("n"), F.min("years").alias("first_year"), F.max("years").alias("last_year"))


CHECKED_SQL = f"WITH {CACHED_SQL} SELECT grp types, count(*) n, min(month_index // 12)::BIGINT first_year, max(month_index // 12)::BIGINT last_year FROM cached GROUP BY 1"


def table_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Size and sha256 of the files of the records table."""
    return files.file_digests(spark, f"{folder}/records.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


DIGESTED = ["epi_isl", "strain_name", "subtype", "year", "month", "day", "ha_sequence", "na_sequence", "lab_code"]


def content_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and digest of the content of the records table, whatever its files are."""
    return files.content_digest(table(spark, folder, "records"), DIGESTED)


_DIGESTED_SQL = " || '|' || ".join(f"coalesce('=' || {c}::VARCHAR, '')" for c in DIGESTED)
DIGEST_SQL = f"SELECT count(*) AS rows, coalesce(sum(('0x' || substr(md5({_DIGESTED_SQL}), 1, 12))::BIGINT), 0)::HUGEINT::VARCHAR digest FROM records"


def sequence_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Summary of HA lengths per type."""
    out = stats.describe(records(spark, folder), ["grp"], F.length("ha"), {"p05": 0.05, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}, (1700,))
    return out.select("grp", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


LENGTHS_SQL = f"""WITH {RECORDS_SQL} SELECT grp, count(ha) n, round(avg(len(ha)), 6) mean, min(len(ha))::DOUBLE low, max(len(ha))::DOUBLE high, {", ".join(f"round(quantile_cont(len(ha)::DOUBLE, {q}), 6) {k}" for k, q in (("p05", 0.05), ("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95)))},
  round(avg((len(ha) <= 1700)::INT), 6) within_1700 FROM recs WHERE ha IS NOT NULL GROUP BY 1"""


def year_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Records by group and year."""
    return records(spark, folder).groupBy("grp", "year").agg(F.count("*").alias("n"))


YEARS_SQL = f"WITH {RECORDS_SQL} SELECT grp, year, count(*) n FROM recs GROUP BY 1, 2"


def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The yearly counts as Markdown lines."""
    return reports.text_rows(year_counts(spark, folder))


REPORT_SQL = f"WITH {RECORDS_SQL} SELECT '| ' || coalesce(grp, 'NA') || ' | ' || coalesce(year::VARCHAR, 'NA') || ' | ' || count(*) || ' |' AS line FROM recs GROUP BY grp, year"


def length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Bins of a figure of HA lengths."""
    return reports.histogram(records(spark, folder).withColumn("len", F.length("ha")), "grp", "len", 1600, 1850, 10)


HISTOGRAM_SQL = f"WITH {RECORDS_SQL} SELECT grp, CASE WHEN len(ha) < 1600 THEN 0 WHEN len(ha) >= 1850 THEN 11 ELSE floor((len(ha) - 1600) / 25) + 1 END::INT AS bin, count(*) n FROM recs WHERE ha IS NOT NULL GROUP BY 1, 2"


def length_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of a figure of NA lengths."""
    return reports.box(records(spark, folder).withColumn("len", F.length("na")), "grp", "len")


BOX_SQL = f"""WITH {RECORDS_SQL}, q AS (SELECT grp, count(*) n, quantile_cont(len(na)::DOUBLE, 0.25) q1, quantile_cont(len(na)::DOUBLE, 0.5) median, quantile_cont(len(na)::DOUBLE, 0.75) q3 FROM recs WHERE na IS NOT NULL GROUP BY 1)
SELECT q.grp, any_value(n) n, any_value(q1) q1, any_value(median) median, any_value(q3) q3, min(len(na))::DOUBLE low, max(len(na))::DOUBLE high FROM q JOIN recs r ON r.grp IS NOT DISTINCT FROM q.grp
WHERE len(na) >= q1 - 1.5 * (q3 - q1) AND len(na) <= q3 + 1.5 * (q3 - q1) GROUP BY q.grp"""
BOX_SQL = BOX_SQL.replace("r.grp IS NOT DISTINCT FROM q.grp", "r.grp = q.grp")


def vector_density(spark: SparkSession, folder: str) -> DataFrame:
    """Squares of a density figure of the first two elements of the vectors."""
    return reports.density(cached(spark, folder).select("grp", F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y")), "grp", "x", "y", 0.5)


DENSITY_SQL = f"WITH {CACHED_SQL} SELECT grp, floor(vector[1] / 0.5)::BIGINT x_bin, floor(vector[2] / 0.5)::BIGINT y_bin, count(*) n FROM cached GROUP BY 1, 2, 3"


def vector_ellipses(spark: SparkSession, folder: str) -> DataFrame:
    """95 % ellipses of the first two elements of the vectors."""
    out = reports.ellipses(cached(spark, folder).select("grp", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y")), "grp", "x", "y")
    return out.select("grp", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


ELLIPSE_SQL = f"""WITH {CACHED_SQL}, m AS (SELECT grp, count(*) n, avg(vector[1]) x, avg(vector[2]) y, var_samp(vector[1]) a, var_samp(vector[2]) b, covar_samp(vector[1], vector[2]) c FROM cached GROUP BY 1), s AS (SELECT *, sqrt((a - b) ** 2 / 4 + c ** 2) s FROM m)
SELECT grp, n, round(x, 6) x, round(y, 6) y, {", ".join(f"CASE WHEN n > 1 THEN round({e}, 6) END {name}" for name, e in (("long", "sqrt(5.991465 * greatest((a + b) / 2 + s, 0))"), ("short", "sqrt(5.991465 * greatest((a + b) / 2 - s, 0))"), ("angle", "degrees(atan2(2 * c, a - b) / 2)")))} FROM s"""


def stratified_years(spark: SparkSession, folder: str) -> DataFrame:
    """100 rows of each type spread over the years."""
    rows = cached(spark, folder).where("month_index is not null").withColumn("year", F.floor(F.col("month_index") / 12).cast("int")).select("grp", "year", "id")
    return stratified(rows, "grp", "year", "id", 100, 42).groupBy("grp", "year").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


STRATIFIED_SQL = f"""WITH {CACHED_SQL}, y AS (SELECT grp, month_index // 12 AS year, id FROM cached WHERE month_index IS NOT NULL), c AS (SELECT grp, year, count(*) c FROM y GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w r, count(*) OVER (PARTITION BY grp) m, coalesce(sum(c) OVER (PARTITION BY grp ORDER BY c, year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM c WINDOW w AS (PARTITION BY grp ORDER BY c, year)),
t AS (SELECT *, b + c * (m - r + 1) <= 100 AS w FROM r), l AS (SELECT *, 100 - coalesce(sum(CASE WHEN w THEN c END) OVER (PARTITION BY grp), 0) lft, count(*) FILTER (NOT w) OVER (PARTITION BY grp) o FROM t),
q AS (SELECT grp, year, CASE WHEN w THEN c ELSE least(c, lft // o + (m - r < lft % o)::INT) END q FROM l),
n AS (SELECT y.*, row_number() OVER (PARTITION BY grp, year ORDER BY sha1('42|' || id::VARCHAR), id) k FROM y) SELECT n.grp, n.year::INT AS year, count(*) n, sum(id)::BIGINT ids FROM n JOIN q ON q.grp = n.grp AND q.year = n.year WHERE k <= q GROUP BY 1, 2"""


def _windows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = records(spark, folder).where("grp is not null and month_index is not null and ha is not null").select("id", "grp", "month_index", F.length("ha").alias("length"), S.content_key(F.col("ha"), F.col("na"), bits=256).alias("fingerprint"))
    rows = written(rows, "rows")
    w = series.context_windows(rows)
    target = rows.select(F.col("id").alias("target_id"), F.col("length").alias("target_length"), F.col("fingerprint").alias("target_fingerprint"))
    w = w.join(target, "target_id").select(F.concat_ws("/", "grp", "target_month").alias("window_id"), "grp", "target_id", "target_month", "target_length", "target_fingerprint", F.array("id_1", "id_2", "id_3").alias("context_ids"))
    return w, rows


#: Bins of months between a candidate and its target.
GAPS = (("months_0", 0, 0), ("months_1_3", 1, 3), ("months_4_12", 4, 12), ("months_13", 13, 100_000))


def candidate_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of each window under five policies: how many, distinct contents, those of the context,
    range of lengths, and how many lie how many months away."""
    w, rows = _windows(spark, folder)
    w, out = written(w, "windows"), None
    for policy in ranking.POLICIES:
        c = ranking.candidates(w, rows, policy, 10).join(w.select("window_id", "context_ids"), "window_id")
        gaps = [F.count_if(F.col("month_gap").between(low, high)).alias(name) for name, low, high in GAPS]
        one = c.groupBy("grp").agg(F.countDistinct("window_id").alias("windows"), F.count("*").alias("candidates"), F.countDistinct("window_id", "fingerprint").alias("contents"), F.count_if("is_target").alias("targets"), F.count_if(F.array_contains("context_ids", F.col("candidate_id"))).alias("of_context"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.max("month_gap").alias("farthest"), *gaps)
        one = one.select(F.lit(policy).alias("policy"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_CANDIDATES_SQL = f"""{RECORDS_SQL}, rw AS (SELECT id, grp, month_index m, len(ha) l, ha, na, sha256(coalesce(ha, '') || '|' || coalesce(na, '')) f FROM recs WHERE grp IS NOT NULL AND month_index IS NOT NULL AND ha IS NOT NULL),
kept AS (SELECT grp, m, min(id) t FROM rw GROUP BY 1, 2 HAVING count(*) >= 5), lg AS (SELECT grp, m tm, t, lag(t, 1) OVER g c1, lag(t, 2) OVER g c2, lag(t, 3) OVER g c3 FROM kept WINDOW g AS (PARTITION BY grp ORDER BY m)),
wn AS (SELECT lg.*, r.l tl, r.f tf FROM lg JOIN rw r ON r.id = t WHERE c3 IS NOT NULL), po AS (SELECT unnest({list(ranking.POLICIES)}) AS policy), one AS (SELECT grp, m, f, min(id) id, any_value(l) l FROM rw GROUP BY 1, 2, 3),
nr AS (SELECT policy, wn.grp, tm, c1, c2, c3, id, false tgt, f, l, abs(m - tm) gap FROM wn JOIN one ON one.grp = wn.grp CROSS JOIN po WHERE f <> tf AND id NOT IN (c1, c2, c3)
  AND CASE policy WHEN 'same_month' THEN m = tm WHEN 'near' THEN abs(m - tm) <= 3 WHEN 'past' THEN m < tm WHEN 'length' THEN abs(l - tl) <= 0.03::DOUBLE * tl ELSE true END UNION ALL SELECT policy, grp, tm, c1, c2, c3, t, true, tf, tl, 0 FROM wn, po),
ea AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY policy, grp, tm, f ORDER BY NOT tgt, gap, sha1('0|' || id::VARCHAR), id) = 1),
ca AS (SELECT * FROM ea QUALIFY row_number() OVER (PARTITION BY policy, grp, tm ORDER BY tgt DESC, gap, sha1('0|' || id::VARCHAR), id) <= 10)"""
AUDIT_SQL = f"""WITH {_CANDIDATES_SQL} SELECT policy, grp, count(DISTINCT tm) windows, count(*) candidates, count(DISTINCT (tm, f)) contents, count(*) FILTER (tgt) targets, count(*) FILTER (id IN (c1, c2, c3)) of_context, min(l)::INT shortest, max(l)::INT longest, max(gap)::INT farthest,
  {", ".join(f"count(*) FILTER (gap BETWEEN {low} AND {high}) {name}" for name, low, high in GAPS)} FROM ca GROUP BY 1, 2"""


def candidate_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates near the target's month ranked by their sequence distance to the record before it."""
    w, rows = _windows(spark, folder)
    w = written(w, "windows")
    c = ranking.candidates(w, rows, "near", 10)
    seq = records(spark, folder).select("id", "ha", "na")
    last = w.select("window_id", F.get("context_ids", F.lit(0)).alias("last_id"))
    both = c.join(last, "window_id").join(seq.select(F.col("id").alias("candidate_id"), F.col("ha").alias("ha_c"), F.col("na").alias("na_c")), "candidate_id").join(seq.select(F.col("id").alias("last_id"), F.col("ha").alias("ha_l"), F.col("na").alias("na_l")), "last_id")
    scored = both.withColumn("mean_nll", S.hamming(F.col("ha_c"), F.col("ha_l"), None))
    out = ranking.rank_report(ranking.target_ranks(scored), ["grp"])
    return out.select("grp", "windows", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


RANKS_SQL = f"""WITH {_CANDIDATES_SQL}, sc AS (SELECT ca.grp, tm, tgt, id, {_HAM("a.ha", "b.ha", False)} s FROM ca JOIN rw a USING (id) JOIN rw b ON b.id = c1 WHERE policy = 'near'),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, tm ORDER BY s IS NULL, s, id) r, count(*) OVER (PARTITION BY grp, tm) n FROM sc),
t AS (SELECT *, CASE WHEN n > 1 THEN (r - 1) / (n - 1) ELSE 0 END nr, list_sum(list_transform(range(1, n + 1), lambda i: 1 / i)) / n h FROM r WHERE tgt)
SELECT grp, count(*) windows, round(avg(r), 6) mean_rank, round(quantile_cont(r::DOUBLE, 0.5), 6) median_rank, round(avg(nr), 6) mean_normalised, round(avg(1 / r), 6) mrr, round(avg((r <= 1)::INT), 6) top1, round(avg(CASE WHEN n >= 5 THEN (r <= 5)::INT END), 6) top5,
  round(avg(CASE WHEN n >= 10 THEN (r <= 10)::INT END), 6) top10, round(avg(h), 6) random_mrr FROM t GROUP BY 1"""


def window_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Of each window, the record before the target read as its forecast: amino acids that differ, compared length and
    their ratio, per segment. Forecasts of at most 100 letters give -1, 0 and 0; targets without both segments are left out."""
    w, _ = _windows(spark, folder)
    seq = records(spark, folder).select("id", "ha", "na")
    made, real = (seq.select(F.col("id").alias(k), F.col("ha").alias(f"ha_{k[0]}"), F.col("na").alias(f"na_{k[0]}")) for k in ("made_id", "target_id"))
    both = w.select("window_id", "grp", "target_month", "target_id", F.get("context_ids", F.lit(0)).alias("made_id")).join(real.where("ha_t != '' and na_t != ''"), "target_id").join(made, "made_id")
    for s in ("ha", "na"):
        long = F.length(f"{s}_m") > 100
        for side in ("m", "t"):
            both = both.withColumn(f"{s}_p{side}", F.when(long, S.translated(F.col(f"{s}_{side}"), True)))
        wrong, size = S.mismatches(F.col(f"{s}_pm"), F.col(f"{s}_pt")), F.least(F.length(f"{s}_pm"), F.length(f"{s}_pt"))
        both = both.withColumn(f"{s}_mismatch", F.coalesce(wrong, F.lit(-1))).withColumn(f"{s}_length", F.coalesce(size, F.lit(0)))
        both = both.withColumn(f"{s}_rate", F.when(F.col(f"{s}_length") > 0, F.round(F.col(f"{s}_mismatch") / F.col(f"{s}_length"), 6)).otherwise(0.0)).withColumn(f"made_{s}_len", F.coalesce(F.length(f"{s}_m"), F.lit(0)))
    return both.select("window_id", "grp", "target_month", *(f"{s}_{c}" for s in ("ha", "na") for c in ("mismatch", "length", "rate")), "made_ha_len", "made_na_len")


_PROTEIN = lambda c: f"CASE WHEN made > 100 THEN split_part({_CODON(f'replace({c}, chr(78), chr(65))')}, '*', 1) END"
WINDOW_MISMATCH_SQL = f"""WITH {_CANDIDATES_SQL}, sg AS (SELECT wn.grp, tm, unnest(['ha', 'na']) s, unnest([m.ha, m.na]) x, unnest([t.ha, t.na]) y FROM wn JOIN rw t ON t.id = wn.t JOIN rw m ON m.id = c1 WHERE t.ha <> '' AND t.na <> ''),
sz AS (SELECT *, coalesce(len(x), 0) made FROM sg), p AS (SELECT grp, tm, s, made, {_PROTEIN("x")} x, {_PROTEIN("y")} y FROM sz), q AS (SELECT *, CASE WHEN least(len(x), len(y)) > 0 THEN {_MM("x", "y")} ELSE -1 END mm, CASE WHEN made > 100 THEN coalesce(least(len(x), len(y)), 0) ELSE 0 END n FROM p)
SELECT grp || '/' || tm window_id, grp, tm target_month, {", ".join(f"max(mm) FILTER (s = '{s}')::INT {s}_mismatch, max(n) FILTER (s = '{s}')::INT {s}_length, max(CASE WHEN n > 0 THEN round(mm / n, 6) ELSE 0 END) FILTER (s = '{s}') {s}_rate, max(made) FILTER (s = '{s}')::INT made_{s}_len" for s in ("ha", "na"))} FROM q GROUP BY grp, tm"""


def event_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each user ranked by value; the user's first event is the target."""
    e = table(spark, folder, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    scored = e.join(first, "user_id").select(F.col("user_id").cast("string").alias("window_id"), F.lit("all").alias("grp"), F.col("event_id").alias("candidate_id"), (F.col("event_id") == F.col("first_id")).alias("is_target"), F.col("value").alias("mean_nll"))
    out = ranking.rank_report(ranking.target_ranks(scored), ["grp"])
    return out.select("grp", "windows", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


EVENT_RANKS_SQL = """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value IS NULL OR isnan(value), value, event_id) r, count(*) OVER (PARTITION BY user_id) n, min(event_id) OVER (PARTITION BY user_id) f FROM events WHERE user_id IS NOT NULL),
t AS (SELECT *, CASE WHEN n > 1 THEN (r - 1) / (n - 1) ELSE 0 END nr, list_sum(list_transform(range(1, n + 1), lambda i: 1 / i)) / n h FROM r WHERE event_id = f)
SELECT 'all' grp, count(*) windows, round(avg(r), 6) mean_rank, round(quantile_cont(r::DOUBLE, 0.5), 6) median_rank, round(avg(nr), 6) mean_normalised, round(avg(1 / r), 6) mrr, round(avg((r <= 1)::INT), 6) top1, round(avg(CASE WHEN n >= 5 THEN (r <= 5)::INT END), 6) top5,
  round(avg(CASE WHEN n >= 10 THEN (r <= 10)::INT END), 6) top10, round(avg(h), 6) random_mrr FROM t"""


def _distances(rows: DataFrame, groups: tuple[str, ...]) -> list[Column]:
    """Squared distances of ``vector`` to the mean of each group, NULL for a group without rows. The means, a number per group and
    dimension, come to the driver and go back as literals."""
    flat = rows.where(F.col("grp").isin(*groups)).select("grp", F.posexplode("vector").alias("pos", "x")).groupBy("grp", "pos").agg(F.avg("x").alias("m"))
    means = {r["grp"]: [v["m"] for v in r["v"]] for r in flat.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("v")).collect()}
    return [V.euclidean(F.col("vector"), F.array(*map(F.lit, means[g]))) ** 2 if g in means else F.lit(None).cast("double") for g in groups]


def subtype_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """H1N1 against H3N2 by the nearer group mean; nearly equal distances are unknown."""
    rows = cached(spark, folder).where("grp in ('H1N1', 'H3N2')")
    d = rows.select("grp", *(c.alias(f"d{n}") for c, n in zip(_distances(rows, ("H1N1", "H3N2")), "ab")))
    ratio = F.col("da") / F.nullif(F.col("db"), F.lit(0.0))
    answered = d.select((F.col("grp") == "H3N2").cast("int").alias("true_class"), F.when(ratio < 0.9, 0).when(ratio > 1.1, 1).alias("predicted"))
    out = ranking.classification(answered)
    return out.withColumn("label", F.when(F.col("macro_f1") > 0.9, "good").when(F.col("macro_f1") > 0.6, "fair").otherwise("weak")).select("n", "c00", "c01", "c10", "c11", *(F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "unknown_share")), "label")


CLASSIFIER_SQL = f"""WITH {CACHED_SQL}, f AS (SELECT id, grp, unnest(vector) x, unnest(range(0, 64)) p FROM cached WHERE grp IN ('H1N1', 'H3N2')), m AS (SELECT p, avg(x) FILTER (grp = 'H1N1') a, avg(x) FILTER (grp = 'H3N2') b FROM f GROUP BY 1),
d AS (SELECT id, grp, sum((x - a) ** 2) / nullif(sum((x - b) ** 2), 0) r FROM f JOIN m ON m.p = f.p GROUP BY 1, 2), c AS (SELECT (grp = 'H3N2')::INT t, CASE WHEN r < 0.9 THEN 0 WHEN r > 1.1 THEN 1 END p FROM d),
n AS (SELECT count(*) n, count(*) FILTER (t = 0 AND p = 0) c00, count(*) FILTER (t = 0 AND p = 1) c01, count(*) FILTER (t = 1 AND p = 0) c10, count(*) FILTER (t = 1 AND p = 1) c11, count(*) FILTER (p IS NULL) u, count(*) FILTER (t = 0) t0, count(*) FILTER (t = 1) t1 FROM c),
s AS (SELECT *, (coalesce(2 * c00 / nullif(c00 + c10 + t0, 0), 0) + coalesce(2 * c11 / nullif(c11 + c01 + t1, 0), 0)) / 2 f FROM n)
SELECT n, c00, c01, c10, c11, round((c00 + c11) / n, 6) accuracy, round(f, 6) macro_f1, round(u / n, 6) unknown_share, CASE WHEN f > 0.9 THEN 'good' WHEN f > 0.6 THEN 'fair' ELSE 'weak' END AS label FROM s"""


CLASSES = ("H1N1", "H3N2", "H1N2")


def calibrated_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """H1N1 against H3N2 by three scores, the nearness to the means of three groups. Means and the score that stands for each
    class come from one half of the rows, the report from the other."""
    rows = cached(spark, folder).where(F.col("grp").isin(*CLASSES)).select("id", "grp", "vector")
    rows = written(rows.join(ranks.half_split(rows.select("grp", "id"), ["grp"], "id", 42).select("id", "split"), "id"), "halves")
    logits = F.array(*(-d for d in _distances(rows.where("split = 'cal'"), CLASSES)))
    scored = rows.where("grp in ('H1N1', 'H3N2')").select((F.col("grp") == "H3N2").cast("int").alias("true_class"), "split", logits.alias("logits"))
    out = ranking.calibrated_report(written(scored, "scored"))
    return out.select(*(F.round(c, 6).alias(c) if c in ("accuracy", "macro_f1", "unknown_share", "mean_logit_std") else F.col(c) for c in out.columns))


CALIBRATED_SQL = f"""WITH {CACHED_SQL}, h AS (SELECT id, grp, vector, row_number() OVER (PARTITION BY grp ORDER BY sha1('42|' || id::VARCHAR), id) <= count(*) OVER (PARTITION BY grp) // 2 cal FROM cached WHERE grp IN {CLASSES}),
f AS (SELECT id, grp, cal, unnest(vector) x, unnest(range(0, 64)) p FROM h), m AS (SELECT grp g, p, avg(x) m FROM f WHERE cal GROUP BY 1, 2),
d AS (SELECT id, grp, cal, g, -sum((x - m) ** 2) l FROM f JOIN m ON m.p = f.p WHERE grp <> 'H1N2' GROUP BY 1, 2, 3, 4), l AS (SELECT id, (grp = 'H3N2')::INT t, cal, {", ".join(f"max(l) FILTER (g = '{g}') l{i}" for i, g in enumerate(CLASSES))} FROM d GROUP BY 1, 2, 3),
k AS (SELECT t, CASE WHEN avg(l0) >= greatest(avg(l1), avg(l2)) THEN 0 WHEN avg(l1) >= greatest(avg(l1), avg(l2)) THEN 1 ELSE 2 END i FROM l WHERE cal GROUP BY 1), ab AS (SELECT (SELECT i FROM k WHERE t = 0) a, (SELECT i FROM k WHERE t = 1) b),
z AS (SELECT t, a, b, CASE WHEN a <> b THEN CASE WHEN [l0, l1, l2][a + 1] >= [l0, l1, l2][b + 1] THEN 0 ELSE 1 END END p, CASE WHEN l0 >= greatest(l1, l2) THEN 0 WHEN l1 >= greatest(l1, l2) THEN 1 ELSE 2 END NOT IN (a, b) u, list_stddev_pop([l0, l1, l2]) sd FROM l, ab WHERE NOT cal),
c AS (SELECT any_value(a) idx_a, any_value(b) idx_b, count(*) n, count(*) FILTER (t = 0 AND p = 0) c00, count(*) FILTER (t = 0 AND p = 1) c01, count(*) FILTER (t = 1 AND p = 0) c10, count(*) FILTER (t = 1 AND p = 1) c11, count(*) FILTER (u) unknown, avg(sd) sd FROM z)
SELECT idx_a, idx_b, idx_a = idx_b AS ambiguous, n, c00, c01, c10, c11, CASE WHEN idx_a <> idx_b THEN round((c00 + c11) / n, 6) END accuracy,
  CASE WHEN idx_a <> idx_b THEN round((coalesce(2 * c00 / nullif(2 * c00 + c01 + c10, 0), 0) + coalesce(2 * c11 / nullif(2 * c11 + c01 + c10, 0), 0)) / 2, 6) END macro_f1, unknown, round(unknown / n, 6) unknown_share, round(sd, 6) mean_logit_std FROM c"""


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream. It is copied to a folder of its own first: file streams read folders. All its files are
    one batch: they are in no order of time, and between batches the watermark would drop rows."""
    path = place(spark, "events")
    e = table(spark, folder, "events")
    e.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return jobs.stream(spark, path, spark.read.parquet(path).schema, None)


def stream_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """S09, U02, W01 as a stream: events deduplicated on their content, counted by type."""
    out = place(spark, "distinct")
    rows = jobs.deduplicated(_event_stream(spark, folder), S.content_key(F.col("user_id").cast("string"), F.col("event_type"), F.date_format("ts", "yyyy-MM-dd")), "ts", "400 days")
    jobs.run_to_table(rows.select("event_type", "content_key"), out, out + "-checkpoint")
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


STREAM_DISTINCT_SQL = "SELECT event_type, count(DISTINCT coalesce(user_id::VARCHAR, '') || '|' || strftime(ts, '%Y-%m-%d')) n FROM events WHERE ts IS NOT NULL GROUP BY 1"


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """A10 as a stream: daily means per event type, given out once the watermark has passed the day."""
    out = place(spark, "windows")
    rows = jobs.windowed(_event_stream(spark, folder), "ts", "1 hour", "1 day", ["event_type"], n=F.count("*"), mean=F.avg("value"))
    jobs.run_to_table(rows, out, out + "-checkpoint")
    back = spark.read.parquet(out)
    return back.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))


STREAM_WINDOWS_SQL = """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) n, round(avg(value), 6) mean FROM events
GROUP BY date_trunc('day', ts), event_type HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user with less than 30 minutes between events, those that the watermark has closed."""
    out = place(spark, "sessions")
    rows = jobs.sessions(_event_stream(spark, folder), "ts", "1 hour", "30 minutes", ["user_id"], n=F.count("*"))
    jobs.run_to_table(rows, out, out + "-checkpoint")
    return spark.read.parquet(out).groupBy("n").agg(F.count("*").alias("sessions"))


SESSIONS_SQL = """WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END b FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM b), x AS (SELECT count(*) n, max(ts) + INTERVAL 30 MINUTE e FROM s GROUP BY user_id, s)
SELECT n, count(*) sessions FROM x WHERE e <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1"""


QUERIES = {f.__name__: f for f in (fasta_pairs, dataset_roundtrip, label_file, resumed_cache, checked_vectors, table_digests, content_digests, sequence_lengths, year_counts, report_lines, length_histogram, length_boxes, vector_density, vector_ellipses, stratified_years, candidate_audit, candidate_ranks, window_mismatches, event_ranks, subtype_classifier, calibrated_classifier, stream_distinct, stream_windows, stream_sessions)}
ORACLES = {
    "fasta_pairs": FASTA_SQL, "dataset_roundtrip": DATASET_SQL, "label_file": LABEL_FILE_SQL, "resumed_cache": RESUMED_SQL, "checked_vectors": CHECKED_SQL, "sequence_lengths": LENGTHS_SQL, "year_counts": YEARS_SQL, "report_lines": REPORT_SQL, "length_histogram": HISTOGRAM_SQL, "length_boxes": BOX_SQL,
    "stratified_years": STRATIFIED_SQL, "event_ranks": EVENT_RANKS_SQL, "subtype_classifier": CLASSIFIER_SQL, "stream_distinct": STREAM_DISTINCT_SQL, "stream_windows": STREAM_WINDOWS_SQL,
    "stream_sessions": SESSIONS_SQL, "content_digests": DIGEST_SQL, "vector_density": DENSITY_SQL, "vector_ellipses": ELLIPSE_SQL, "candidate_audit": AUDIT_SQL, "candidate_ranks": RANKS_SQL, "window_mismatches": WINDOW_MISMATCH_SQL, "calibrated_classifier": CALIBRATED_SQL,
}

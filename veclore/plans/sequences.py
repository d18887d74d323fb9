"""Queries on records and their sequences: parsing, quality, duplicates, pairing, distances, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclore.functions import sequences as S
from veclore.functions import tokens as T
from veclore.functions.align import alignment_distance
from veclore.operators import kmers as K
from veclore.operators import records as R
from veclore.operators import stats
from veclore.operators.knn import exact_neighbors
from veclore.operators.ranks import sampled_pairs
from veclore.plans.base import RECORDS_SQL, acc_sql, pairs_sql, records
from veclore.runtime import written
from veclore.tables import accession, table

AA, SEED = S.AMINO_ACIDS, 42


def name_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Year in the name, pairing key, accession parts."""
    r = table(spark, folder, "records")
    n = F.col("strain_name")
    return r.select("epi_isl", "strain_name", S.name_year(n).alias("name_year"), S.strain_key(n).alias("strain_key"), S.accession_prefix(F.col("epi_isl")).alias("prefix"), S.accession_number(F.col("epi_isl")).alias("number"))


NAME_FIELDS_SQL = r"""
SELECT epi_isl, strain_name, CASE WHEN y4 <> '' THEN y4::INT WHEN y2 <> '' THEN CASE WHEN y2::INT <= 30 THEN y2::INT + 2000 ELSE y2::INT + 1900 END WHEN ya <> '' THEN ya::INT END name_year,
  regexp_replace(regexp_replace(regexp_replace(upper(strain_name), '\s+', '', 'g'), 'H\d+N\d+$', ''), '[()]', '', 'g') strain_key,
  nullif(regexp_extract(trim(epi_isl), '^([A-Za-z_]+)(\d+)$', 1), '') prefix, try_cast(nullif(regexp_extract(trim(epi_isl), '^([A-Za-z_]+)(\d+)$', 2), '') AS BIGINT) number
FROM (SELECT *, regexp_extract(strain_name, '/((?:19|20)\d{2})$', 1) y4, regexp_extract(strain_name, '/(\d{2})$', 1) y2, regexp_extract(strain_name, '[|/\s]((?:19|20)\d{2})[|/\s]', 1) ya FROM records)"""


def date_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of a written date, defaults of a bare year, month number in its four forms, and label; counted by date."""
    r = table(spark, folder, "records")
    text = F.when(F.col("year").isNotNull() & F.col("day").isNotNull(), F.format_string("%d-%02d-%02d", "year", "month", "day")).otherwise(F.col("year").cast("string"))
    d = r.select(text.alias("d"))
    parts = d.select(*(S.date_part(F.col("d"), p).alias(p) for p in ("year", "month", "day")), S.date_imputed(F.col("d")).alias("imputed"))
    m = S.month_index(F.col("year"), F.col("month"))
    forms = [S.month_index(F.col("year"), F.col("month"), clip, first).alias(name) for name, clip, first in (("clipped_from_1", True, 1), ("plain_from_0", False, 0), ("plain_from_1", False, 1))]
    return parts.groupBy("year", "month", "day", "imputed", m.alias("month_index"), *forms, S.month_label(m).alias("label")).agg(F.count("*").alias("n"))


DATE_FIELDS_SQL = """
SELECT year, month, day, imputed, CASE WHEN month IS NOT NULL THEN year * 12 + greatest(1, least(12, month)) - 1 END month_index, CASE WHEN month IS NOT NULL THEN year * 12 + greatest(1, least(12, month)) END clipped_from_1,
  year * 12 + month - 1 plain_from_0, year * 12 + month plain_from_1,
  CASE WHEN month IS NOT NULL THEN printf('%04d-%02d', year, greatest(1, least(12, month))) END AS label, count(*) n FROM (
  SELECT year, CASE WHEN year IS NOT NULL THEN CASE WHEN day IS NOT NULL THEN month ELSE 6 END END AS month, CASE WHEN year IS NOT NULL THEN coalesce(day, 15) END AS day,
  CASE WHEN year IS NOT NULL THEN day IS NULL END imputed FROM records) GROUP BY ALL"""


def quality_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Records by the first rule they fail."""
    r = table(spark, folder, "records").withColumn("ha", S.canonical(F.col("ha_sequence"))).withColumn("na", S.canonical(F.col("na_sequence")))
    reason = F.coalesce(R.reject_reason(F.col("ha"), F.col("na"), F.col("year")), F.lit("kept"))
    return r.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg(S.letter_share(F.col("ha"), "N")), 8).alias("n_share"))


QUALITY_SQL = r"""
WITH c AS (SELECT upper(regexp_replace(ha_sequence, '[^\x00-\x7F]', '', 'g')) ha, upper(regexp_replace(na_sequence, '[^\x00-\x7F]', '', 'g')) na, year FROM records),
q AS (SELECT *, (len(ha) - len(replace(ha, 'N', ''))) / nullif(len(ha), 0) hn, (len(na) - len(replace(na, 'N', ''))) / nullif(len(na), 0) nn FROM c)
SELECT CASE WHEN coalesce(ha, '') = '' THEN 'no_ha' WHEN coalesce(na, '') = '' THEN 'no_na' WHEN year IS NULL THEN 'no_date'
  WHEN NOT (len(ha) BETWEEN 1650 AND 1800 AND regexp_matches(ha, '^[ATCGN]+$') AND hn <= 0.01) THEN 'bad_ha'
  WHEN NOT (len(na) BETWEEN 1200 AND 1600 AND regexp_matches(na, '^[ATCGN]+$') AND nn <= 0.01) THEN 'bad_na' ELSE 'kept' END reason, count(*) n, round(avg(hn), 8) n_share FROM q GROUP BY 1"""


def valid_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records per group with both segments and a date, in a range of years, longer than 300, and months of at least 5."""
    r = records(spark, folder)
    ok = (F.coalesce(F.col("ha"), F.lit("")) != "") & (F.coalesce(F.col("na"), F.lit("")) != "") & F.col("month_index").isNotNull()
    per_month = r.where(ok).groupBy("grp", "month_index").agg(F.count("*").alias("m"))
    flags = r.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"), F.count_if(ok & F.col("year").between(2005, 2015)).alias("in_years"), F.count_if(F.coalesce(F.length("ha") > 300, F.lit(False))).alias("long"))
    months = per_month.groupBy("grp").agg(F.count_if(F.col("m") >= 5).alias("full_months"), F.count("*").alias("months")).withColumnRenamed("grp", "g")
    return flags.join(months, F.col("grp").eqNullSafe(F.col("g")), "left").drop("g")


VALID_SQL = f"""WITH {RECORDS_SQL}, f AS (SELECT *, coalesce(ha, '') <> '' AND coalesce(na, '') <> '' AND month_index IS NOT NULL ok FROM recs),
m AS (SELECT grp, count(*) FILTER (m >= 5) full_months, count(*) AS months FROM (SELECT grp, month_index, count(*) m FROM f WHERE ok GROUP BY 1, 2) GROUP BY 1)
SELECT f.grp, count(*) n, count(*) FILTER (ok) valid, count(*) FILTER (ok AND year BETWEEN 2005 AND 2015) in_years, count(*) FILTER (len(ha) > 300) long, any_value(full_months) full_months, any_value(months) AS months
FROM f LEFT JOIN m ON f.grp IS NOT DISTINCT FROM m.grp GROUP BY 1"""


def translations(spark: SparkSession, folder: str) -> DataFrame:
    """Proteins of HA in both readings."""
    r = records(spark, folder).where("ha is not null")
    p, q = S.translated(F.col("ha")), S.translated(F.col("ha"), stop=True)
    return r.select("id", F.length(p).alias("codons"), F.md5(p).alias("protein"), F.length(q).alias("to_stop"), F.left(q, F.lit(12)).alias("start"))


_CODON = lambda s: f"array_to_string(list_transform(range(0, len({s}) // 3), lambda i: CASE WHEN instr('TCAG', substr({s}, 3*i+1, 1)) > 0 AND instr('TCAG', substr({s}, 3*i+2, 1)) > 0 AND instr('TCAG', substr({s}, 3*i+3, 1)) > 0 THEN substr('{AA}', (16*(instr('TCAG', substr({s}, 3*i+1, 1))-1) + 4*(instr('TCAG', substr({s}, 3*i+2, 1))-1) + instr('TCAG', substr({s}, 3*i+3, 1)))::INT, 1) ELSE 'X' END), '')"
TRANSLATIONS_SQL = f"WITH {RECORDS_SQL}, p AS (SELECT id, {_CODON('ha')} p, split_part({_CODON('replace(ha, chr(78), chr(65))')}, '*', 1) q FROM recs WHERE ha IS NOT NULL) SELECT id, len(p) codons, md5(p) protein, len(q) to_stop, substr(q, 1, 12) AS start FROM p"


def content_keys(spark: SparkSession, folder: str) -> DataFrame:
    """sha1 and sha256 keys of a record's content, and a short form."""
    r = records(spark, folder)
    return r.select("id", S.content_key(F.col("ha"), F.col("na")).alias("ha_na"), S.content_key(F.col("grp"), F.col("ha"), F.col("na")).alias("with_group"), F.left(S.content_key(F.col("ha"), F.col("na"), bits=256), F.lit(12)).alias("short"))


CONTENT_SQL = f"WITH {RECORDS_SQL} SELECT id, sha1(coalesce(ha, '') || '|' || coalesce(na, '')) ha_na, sha1(coalesce(grp, '') || '|' || coalesce(ha, '') || '|' || coalesce(na, '')) with_group, substr(sha256(coalesce(ha, '') || '|' || coalesce(na, '')), 1, 12) short FROM recs"


def token_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Encoded length, padded sum and mask, decoded text, budgeted lengths, and whether a start codon's tokens occur."""
    r = records(spark, folder)
    ids = T.encoded_record(F.col("ha"), F.col("na"), F.concat(F.lit("<"), "grp", F.lit(">")))
    e = r.select("id", "ha", "na", ids.alias("ids"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    ha, na = T.budgeted(F.col("ha"), F.col("na"), 2048)
    start = F.array(F.lit(0), F.lit(3), F.lit(2))
    return e.select("id", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first"), total(T.padded(F.col("ids"), 4096)).alias("padded"), total(T.mask(T.padded(F.col("ids"), 4096))).alias("mask"), total(T.padded(F.col("ids"), 1024, left=True)).alias("cut"), F.md5(T.decoded(F.col("ids"))).alias("decoded"), F.length(ha).alias("ha_budget"), F.length(na).alias("na_budget"), S.contains_run(F.col("ids"), start).alias("has_start"))


_SUBTYPES = ", ".join(f"'{k[1:-1]}': {v}" for k, v in T.SUBTYPE_IDS.items())
_IDS = lambda c: f"list_transform(CASE WHEN len({c}) > 0 THEN string_split({c}, '') ELSE [] END, lambda x: CASE x WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END)"
TOKENS_SQL = f"""WITH {RECORDS_SQL}, e AS (SELECT id, ha, na, list_concat(list_concat(list_concat([coalesce(MAP {{{_SUBTYPES}}}[grp], 4), 8], {_IDS("ha")}), list_concat([6, 9], {_IDS("na")})), [7]) ids FROM recs)
SELECT id, len(ids)::INT n, ids[1] AS first, (list_sum(list_slice(ids, 1, 4096)) + greatest(0, 4096 - len(ids)) * 5)::INT padded, least(4096, len(ids))::INT AS mask, (list_sum(list_slice(ids, 1, 1024)) + greatest(0, 1024 - len(ids)) * 5)::INT cut,
  md5(translate(array_to_string(list_filter(ids, lambda x: x < 5), ''), '01234', 'ACGTN')) decoded,
  CASE WHEN len(ha) + len(na) <= 2043 THEN len(ha) WHEN ha IS NOT NULL THEN least(len(ha), 1123) END ha_budget, CASE WHEN len(ha) + len(na) <= 2043 THEN len(na) WHEN na IS NOT NULL THEN least(len(na), 920) END na_budget,
  contains(',' || array_to_string(ids, ',') || ',', ',0,3,2,') has_start FROM e"""


def letter_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Letters of HA and how often they occur."""
    return stats.letters(table(spark, folder, "records"), "ha_sequence")


LETTERS_SQL = "SELECT letter, count(*)::BIGINT n FROM (SELECT unnest(string_split(upper(ha_sequence), '')) letter FROM records WHERE ha_sequence <> '') WHERE letter <> '' GROUP BY 1"


def position_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of the first 400 letters by position (pad and A share code 0)."""
    codes = records(spark, folder).where("ha is not null").select(F.posexplode(S.position_codes(F.col("ha"), 400)).alias("pos", "code"))
    return codes.groupBy("pos", "code").agg(F.count("*").alias("n"))


POSITION_SQL = f"""WITH {RECORDS_SQL}, p AS (SELECT unnest(range(0, 400)) pos), c AS (SELECT p.pos, substr(rpad(substr(ha, 1, 400), 400, 'A'), p.pos::INT + 1, 1) x FROM recs, p WHERE ha IS NOT NULL)
SELECT pos::INT pos, CASE WHEN instr('ARNDCQEGHILKMFPSTWYV', x) > 0 THEN instr('ARNDCQEGHILKMFPSTWYV', x) - 1 ELSE 21 END::INT code, count(*) n FROM c GROUP BY 1, 2"""


def _pairs(spark: SparkSession, folder: str, seed: int = SEED) -> DataFrame:
    r = records(spark, folder).where("ha is not null and na is not null and grp is not null")
    seq = r.select("id", "ha", "na")
    pairs = sampled_pairs(r, "grp", "id", per_row=2, seed=seed)
    return pairs.join(seq.select(F.col("id").alias("i"), F.col("ha").alias("ha_i"), F.col("na").alias("na_i")), "i").join(seq.select(F.col("id").alias("j"), F.col("ha").alias("ha_j"), F.col("na").alias("na_j")), "j")


def hamming_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Distances of sampled pairs: each segment, weighted, without tolerance, and of both joined."""
    p = _pairs(spark, folder)
    a, b, c, d = (F.col(x) for x in ("ha_i", "ha_j", "na_i", "na_j"))
    r = lambda x: F.round(x, 9)
    return p.select("grp", "i", "j", "draw", r(S.hamming(a, b)).alias("ha"), r(S.hamming(c, d)).alias("na"), r(S.weighted_hamming(a, b, c, d)).alias("both"), r(S.hamming(a, b, None)).alias("prefix"), r(S.hamming(F.concat(a, c), F.concat(b, d))).alias("joined"))


_MM = lambda a, b: f"len(list_filter(list_zip(string_split(substr({a}, 1, least(len({a}), len({b}))), ''), string_split(substr({b}, 1, least(len({a}), len({b}))), '')), lambda z: z[1] <> z[2]))"
_HAM = lambda a, b, tol=True: f"CASE WHEN least(len({a}), len({b})) > 0" + (f" AND (greatest(len({a}), len({b})) - least(len({a}), len({b}))) / greatest(len({a}), len({b})) <= 0.05" if tol else "") + f" THEN {_MM(a, b)} / least(len({a}), len({b})) END"
_PAIR_SQL = f"""WITH {RECORDS_SQL}, src AS (SELECT * FROM recs WHERE ha IS NOT NULL AND na IS NOT NULL AND grp IS NOT NULL), {pairs_sql("src", 2, SEED)},
s AS (SELECT p.*, a.ha ha_i, b.ha ha_j, a.na na_i, b.na na_j FROM pairs p JOIN src a ON a.id = p.i JOIN src b ON b.id = p.j)"""
HAMMING_SQL = f"""{_PAIR_SQL}, h AS (SELECT grp, i, j, draw, {_HAM("ha_i", "ha_j")} ha, {_HAM("na_i", "na_j")} na, least(len(ha_i), len(ha_j)) w1, least(len(na_i), len(na_j)) w2, {_HAM("ha_i", "ha_j", False)} prefix, {_HAM("(ha_i || na_i)", "(ha_j || na_j)")} joined FROM s)
SELECT grp, i, j, draw::INT draw, round(ha, 9) ha, round(na, 9) na, round((ha * w1 + na * w2) / nullif(w1 + w2, 0), 9) AS both, round(prefix, 9) AS prefix, round(joined, 9) joined FROM h"""


def protein_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Differing amino acids of sampled pairs; empty proteins give -1 and are left out of mean and deviation."""
    p = _pairs(spark, folder).select("grp", S.translated(F.col("ha_i"), True).alias("x"), S.translated(F.col("ha_j"), True).alias("y"))
    m = F.coalesce(S.mismatches(F.col("x"), F.col("y")), F.lit(-1))
    v = F.nullif(F.col("m"), F.lit(-1))
    return p.select("grp", m.alias("m")).groupBy("grp").agg(F.count("*").alias("pairs"), F.count(v).alias("valid"), F.round(F.coalesce(F.avg(v), F.lit(0.0)), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop(v), F.lit(0.0)), 6).alias("sd"))


PROTEIN_SQL = f"""{_PAIR_SQL}, p AS (SELECT grp, split_part({_CODON("replace(ha_i, chr(78), chr(65))")}, '*', 1) x, split_part({_CODON("replace(ha_j, chr(78), chr(65))")}, '*', 1) y FROM s),
m AS (SELECT grp, CASE WHEN least(len(x), len(y)) > 0 THEN {_MM("x", "y")} ELSE -1 END m FROM p)
SELECT grp, count(*) pairs, count(nullif(m, -1)) valid, round(coalesce(avg(nullif(m, -1)), 0), 6) mean, round(coalesce(stddev_pop(nullif(m, -1)), 0), 6) sd FROM m GROUP BY 1"""


def aligned_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Gap-aware distance beside the prefix distance, of 250 pairs per type and seed (those with the smallest hashes), for
    three seeds: HA, NA, and both weighted by length."""
    from veclore.operators.ranks import smallest_hashes

    out = None
    for seed in (42, 7, 123):
        one = smallest_hashes(_pairs(spark, folder, seed).where("draw = 1"), ["grp"], "i", 250, seed).withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    # the pairs are few and each takes long: a row per segment, spread over all cores
    each = out.select("seed", "grp", "i", "j", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(f"{s}_i").alias("x"), F.col(f"{s}_j").alias("y")) for s in ("ha", "na")))).alias("e"))
    each = written(each.repartition(max(64, 4 * spark.sparkContext.defaultParallelism), "seed", "i", "e.s"), "pairs")
    d = each.select("seed", "grp", "i", "j", "e.s", alignment_distance("e.x", "e.y").alias("aligned"), S.hamming(F.col("e.x"), F.col("e.y")).alias("prefix"), F.least(F.length("e.x"), F.length("e.y")).alias("w"))
    of = lambda s, c: F.max(F.when(F.col("s") == s, F.col(c)))
    both = lambda c: (of("ha", c) * of("ha", "w") + of("na", c) * of("na", "w")) / F.nullif(of("ha", "w") + of("na", "w"), F.lit(0))
    parts = [F.round(x, 9).alias(f"{c}_{s}") for c in ("aligned", "prefix") for s, x in (("ha", of("ha", c)), ("na", of("na", c)), ("both", both(c)))]
    return d.groupBy("seed", "grp", "i", "j").agg(*parts)


def dedup_policies(spark: SparkSession, folder: str) -> DataFrame:
    """Rows kept and removed per group, and their months, under each representative policy."""
    r = records(spark, folder).where("grp is not null").select("id", "grp", "month_index", S.content_key(F.col("ha"), F.col("na")).alias("content"))
    r, key, out = written(r, "contents"), [F.col("grp"), F.col("content")], None
    whole = r.groupBy("grp").agg(F.count("*").alias("all"))
    for policy in ("first", "earliest", "latest", "random"):
        kept = R.representatives(r.where("month_index is not null") if policy != "first" else r, key, policy, seed=SEED)
        part = kept.groupBy("grp").agg(F.count("*").alias("kept"), F.sum("id").alias("ids"), F.sum("month_index").alias("months")).join(whole, "grp").select(F.lit(policy).alias("policy"), "grp", "kept", (F.col("all") - F.col("kept")).alias("removed"), "ids", "months")
        out = part if out is None else out.unionByName(part)
    return out


def _policy_sql(policy: str, order: str) -> str:
    where = "" if policy == "first" else "AND month_index IS NOT NULL"
    return f"""SELECT '{policy}' AS policy, grp, count(*) kept, any_value(a) - count(*) removed, sum(id)::BIGINT ids, sum(month_index)::BIGINT AS months FROM (
  SELECT *, row_number() OVER (PARTITION BY grp, k ORDER BY {order}) rn FROM src WHERE grp IS NOT NULL {where}) WHERE rn = 1 GROUP BY grp"""


DEDUP_SQL = f"WITH {RECORDS_SQL}, src AS (SELECT *, sha1(coalesce(ha, '') || '|' || coalesce(na, '')) k, count(*) OVER (PARTITION BY grp) a FROM recs) " + " UNION ALL ".join(
    _policy_sql(p, o) for p, o in (("first", "id"), ("earliest", "month_index, id"), ("latest", "-month_index, id"), ("random", f"sha1('{SEED}|' || id::VARCHAR), id"))
)


def duplicate_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many contents occur how often."""
    return R.duplicate_sizes(table(spark, folder, "records"), S.content_key(F.upper("ha_sequence"), F.upper("na_sequence")))


DUPLICATES_SQL = "SELECT copies, count(*) AS groups FROM (SELECT count(*) copies FROM records GROUP BY sha1(coalesce(upper(ha_sequence), '') || '|' || coalesce(upper(na_sequence), ''))) GROUP BY 1"


def segment_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Both segments of a key brought together from one row per segment."""
    r = table(spark, folder, "records").select(accession(F.col("epi_isl")).alias("key"), F.struct("loaded_at", "lab_code").alias("at"), "lab_code", "ha_sequence", "na_sequence").where("key is not null")
    rows = r.select("key", "at", "lab_code", F.explode(F.array(F.struct(F.lit("HA").alias("s"), F.col("ha_sequence").alias("q")), F.struct(F.lit("NA").alias("s"), F.col("na_sequence").alias("q")))).alias("e"))
    out = R.paired_segments(rows.select("key", "at", "lab_code", F.col("e.s").alias("segment"), F.col("e.q").alias("sequence")))
    return out.select("key", "lab_code", F.length("ha_sequence").alias("ha_len"), F.length("na_sequence").alias("na_len"))


SEGMENT_SQL = f"""SELECT k AS key, (list(lab_code ORDER BY loaded_at, lab_code))[1] lab_code, len((list(ha_sequence ORDER BY loaded_at DESC, lab_code DESC))[1])::INT ha_len, len((list(na_sequence ORDER BY loaded_at DESC, lab_code DESC))[1])::INT na_len
FROM (SELECT *, {acc_sql("epi_isl")} k FROM records) WHERE k IS NOT NULL GROUP BY 1"""


def paired_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Each H1N1 record with the first H3N2 record of the same place and year in its name."""
    r = records(spark, folder).withColumn("name", F.concat_ws("/", F.split_part(F.upper("strain_name"), F.lit("/"), F.lit(2)), F.split_part("strain_name", F.lit("/"), F.lit(4)))).where("strain_name is not null")
    return R.paired_by_name(r.where("grp = 'H1N1'").select("id", "name"), r.where("grp = 'H3N2'").select("id", "name"))


BY_NAME_SQL = f"""WITH {RECORDS_SQL}, n AS (SELECT id, grp, split_part(upper(strain_name), '/', 2) || '/' || split_part(strain_name, '/', 4) AS name FROM recs WHERE strain_name IS NOT NULL)
SELECT l.id, l.name, (SELECT min(r.id) FROM n r WHERE r.grp = 'H3N2' AND r.name = l.name) right_id FROM n l WHERE l.grp = 'H1N1'"""


def paired_by_number(spark: SparkSession, folder: str) -> DataFrame:
    """Each record with the one whose number is off by 2, 1, 3 or 4, tried in this order."""
    r = records(spark, folder).select("id", F.lit("EPI_ISL_").alias("prefix"), F.col("id").alias("number"))
    return R.paired_by_number(r, r)


BY_NUMBER_SQL = f"""WITH {RECORDS_SQL} SELECT id, right_id, delta FROM (SELECT a.id, b.id right_id, d.delta, row_number() OVER (PARTITION BY a.id ORDER BY d.p) rn FROM recs a,
  (VALUES (2, 0), (1, 1), (3, 2), (4, 3)) d(delta, p) JOIN recs b ON b.id = a.id + d.delta) WHERE rn = 1"""


def kmer_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency and inverse of the 5-letter terms of both segments, per type."""
    found = K.term_statistics(records(spark, folder), S.joined_segments(F.col("ha"), F.col("na"), 5), 5)
    return found.select("grp", "term", "df", "tf", F.round(F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1, 9).alias("idf"))


KMER_SQL = f"""WITH {RECORDS_SQL}, t AS (SELECT grp, id, upper(ha) || 'NNNNN' || upper(na) t FROM recs WHERE grp IS NOT NULL AND ha IS NOT NULL AND na IS NOT NULL),
x AS (SELECT grp, id, substr(t, i, 5) term FROM (SELECT grp, id, t, unnest(range(1, len(t) - 3)) i FROM t)), n AS (SELECT grp, count(DISTINCT id) docs FROM x GROUP BY 1)
SELECT x.grp, term, count(DISTINCT id) df, count(*) tf, round(ln((1 + any_value(docs)) / (1 + count(DISTINCT id))) + 1, 9) idf FROM x JOIN n ON n.grp = x.grp GROUP BY 1, 2"""


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return written(records(spark, folder).where("grp is not null and ha is not null and na is not null").select("id", "grp", "ha", "na", (F.col("id") % 100 == 0).alias("asks")), "texts")


def tfidf_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest records by TF-IDF cosine of 5-letter terms, for every record whose id is divisible by 100."""
    near = K.term_neighbors(_texts(spark, folder), S.joined_segments(F.col("ha"), F.col("na"), 5), 5, 5)
    return near.select("grp", "query_id", "rank", "neighbor_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


_TERMS_SQL = f"""WITH {RECORDS_SQL}, tx AS (SELECT grp, id, ha, na, upper(ha) || 'NNNNN' || upper(na) t FROM recs WHERE grp IS NOT NULL AND ha IS NOT NULL AND na IS NOT NULL),
x AS (SELECT grp, id, substr(t, i, 5) term, count(*) tf FROM (SELECT grp, id, t, unnest(range(1, len(t) - 3)) i FROM tx) GROUP BY 1, 2, 3),
nd AS (SELECT grp, count(DISTINCT id) docs FROM x GROUP BY 1), idf AS (SELECT x.grp, term, ln((1 + any_value(docs)) / (1 + count(*))) + 1 idf FROM x JOIN nd ON nd.grp = x.grp GROUP BY 1, 2),
w0 AS (SELECT x.grp, x.id, x.term, tf * idf w FROM x JOIN idf i ON i.grp = x.grp AND i.term = x.term), w AS MATERIALIZED (SELECT grp, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY grp, id)) w FROM w0),
c AS MATERIALIZED (SELECT a.grp, a.id query_id, b.id neighbor_id, round(1 - sum(a.w * b.w), 9) d FROM w a JOIN w b ON a.grp = b.grp AND a.term = b.term AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY 1, 2, 3)"""
TFIDF_SQL = f"""{_TERMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) rank FROM c) SELECT grp, query_id, rank::INT rank, neighbor_id, round(1 - d, 6) similarity FROM r WHERE rank <= 5"""


def _reranked(texts: DataFrame, near: DataFrame) -> DataFrame:
    """The 5 nearest of each query's candidates by two-segment Hamming distance. Queries are few: their texts are broadcast where
    they fit, so that only the candidates' texts move."""
    from veclore.runtime import broadcast_if_small

    q, n = (texts.select(F.col("id").alias(k), F.col("ha").alias(f"ha_{k[0]}"), F.col("na").alias(f"na_{k[0]}")) for k in ("query_id", "neighbor_id"))
    asked = broadcast_if_small(q.where("query_id % 100 = 0"))
    both = near.select("grp", "query_id", "neighbor_id").join(n, "neighbor_id").join(asked, "query_id")
    d = F.round(S.weighted_hamming(F.col("ha_q"), F.col("ha_n"), F.col("na_q"), F.col("na_n")), 9)
    return K.reranked(both, d, 5)


def reranked_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """500 candidates by TF-IDF cosine, then the 5 nearest by two-segment Hamming distance."""
    texts = _texts(spark, folder)
    near = written(K.term_neighbors(texts, S.joined_segments(F.col("ha"), F.col("na"), 5), 5, 500), "candidates")
    return _reranked(texts, near)


RERANKED_SQL = f"""{_TERMS_SQL}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) r FROM c) WHERE r <= 500),
h AS (SELECT k.grp, query_id, neighbor_id, {_HAM("a.ha", "b.ha")} h, {_HAM("a.na", "b.na")} n, least(len(a.ha), len(b.ha)) w1, least(len(a.na), len(b.na)) w2 FROM k JOIN tx a ON a.id = query_id JOIN tx b ON b.id = neighbor_id),
m AS (SELECT grp, query_id, neighbor_id, round((h * w1 + n * w2) / nullif(w1 + w2, 0), 9) distance FROM h)
SELECT grp, query_id, rank::INT rank, neighbor_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance IS NULL, distance, neighbor_id) rank FROM m) WHERE rank <= 5"""


def projected_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest records by Euclidean distance of 384 signed sums of their TF-IDF terms."""
    return K.term_neighbors(_texts(spark, folder), S.joined_segments(F.col("ha"), F.col("na"), 5), 5, 5, signs=384).withColumn("distance", F.round("distance", 6))


def twonn_hamming(spark: SparkSession, folder: str) -> DataFrame:
    """Two nearest by Hamming distance of the first 400 letters of HA, and the dimension by the variant that
    keeps all rows, for two trims."""
    r = records(spark, folder).where("grp is not null and length(ha) > 300")
    rows = r.select("id", "grp", S.position_codes(F.col("ha"), 400).alias("vector"), (F.col("id") % 100 == 0).alias("asks"))
    pairs, out = written(stats.two_neighbors(exact_neighbors(rows, 2, metric="hamming", digits=9)), "pairs"), None
    sizes = pairs.groupBy("grp").agg(F.count("*").alias("queries"), F.round(F.avg("r1"), 6).alias("mean_r1"), F.round(F.avg("r2"), 6).alias("mean_r2"))
    for trim in (0.01, 0.05):
        one = sizes.join(stats.two_neighbor_script(pairs, trim=trim, least=3), "grp", "left").select("grp", F.lit(trim).alias("trim"), "queries", "mean_r1", "mean_r2", F.coalesce("n", F.lit(0)).alias("n"), F.round("dimension", 6).alias("dimension"))
        out = one if out is None else out.unionByName(one)
    return out


def _twonn_sql() -> str:
    code = "list_transform(range(1, 401), lambda i: CASE WHEN i > len(ha) THEN 0 WHEN instr('ARNDCQEGHILKMFPSTWYV', substr(ha, i, 1)) > 0 THEN instr('ARNDCQEGHILKMFPSTWYV', substr(ha, i, 1)) - 1 ELSE 21 END)"
    one = lambda t: f"""(WITH o AS (SELECT grp, query_id, mu, row_number() OVER (PARTITION BY grp ORDER BY mu, query_id) i, count(*) OVER (PARTITION BY grp) n FROM u), k AS (SELECT grp, mu, (i - floor({t} * n)) / (n - 2 * floor({t} * n)) f FROM o WHERE i > floor({t} * n) AND i <= n - floor({t} * n)),
  g AS (SELECT grp, count(*) n, CASE WHEN count(*) >= 3 THEN regr_slope(-ln(1 - f), ln(mu)) END d FROM k WHERE mu > 1.001 AND f < 0.9999 GROUP BY 1)
  SELECT s.grp, {t}::DOUBLE AS trim, queries, mean_r1, mean_r2, coalesce(g.n, 0) n, round(d, 6) dimension FROM s LEFT JOIN g ON g.grp = s.grp)"""  # noqa: E731
    return f"""WITH {RECORDS_SQL}, v AS MATERIALIZED (SELECT id, grp, {code} v FROM recs WHERE grp IS NOT NULL AND len(ha) > 300),
h AS (SELECT a.grp, a.id query_id, b.id neighbor_id, round(len(list_filter(list_zip(a.v, b.v), lambda z: z[1] <> z[2])) / 400, 9) d FROM v a JOIN v b ON a.grp = b.grp AND a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT grp, query_id, min(d) r1, max(d) r2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) r FROM h) WHERE r <= 2 GROUP BY 1, 2 HAVING count(*) = 2),
s AS (SELECT grp, count(*) queries, round(avg(r1), 6) mean_r1, round(avg(r2), 6) mean_r2 FROM p GROUP BY 1), u AS (SELECT grp, query_id, CASE WHEN r1 > 1e-10 THEN r2 / r1 ELSE 1.0 END mu FROM p)
{" UNION ALL ".join(one(t) for t in (0.01, 0.05))}"""


def duplicate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Of contents and of names, records, distinct ones, excess copies, those in groups of several, and the share that
    deduplication removes."""
    r, out = table(spark, folder, "records"), None
    keys = {"content": S.content_key(F.upper("ha_sequence"), F.upper("na_sequence")), "name": S.content_key(F.upper("strain_name"), F.col("subtype_token"))}
    for name, key in keys.items():
        one = r.groupBy(key.alias("k")).agg(F.count("*").alias("c"))
        n, several = F.sum("c"), F.when(F.col("c") > 1, F.col("c"))
        one = one.agg(F.lit(name).alias("of"), n.alias("records"), F.count("*").alias("distinct"), (n - F.count("*")).alias("excess"), F.count(several).alias("groups"), F.coalesce(F.sum(several), F.lit(0)).alias("in_groups"), F.round(1 - F.count("*") / n, 6).alias("removed_share"))
        out = one if out is None else out.unionByName(one)
    return out


DUPLICATE_COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS of, sum(c)::BIGINT records, count(*) \"distinct\", (sum(c) - count(*))::BIGINT excess, count(*) FILTER (c > 1) AS groups, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT in_groups, round(1 - count(*) / sum(c), 6) removed_share FROM (SELECT count(*) c FROM records GROUP BY {key})"
    for name, key in (("content", "sha1(coalesce(upper(ha_sequence), '') || '|' || coalesce(upper(na_sequence), ''))"), ("name", "sha1(coalesce(upper(strain_name), '') || '|' || coalesce(subtype_token, ''))"))
)


def letter_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Per segment, records with letters, with a gap, with an ambiguity letter, and with a letter that is none of the IUPAC ones."""
    r, out = table(spark, folder, "records"), None
    for segment in ("ha", "na"):
        t = F.upper(f"{segment}_sequence")
        has = lambda p: F.count_if(F.coalesce(t.rlike(p), F.lit(False)))  # noqa: B023, E731
        one = r.agg(F.lit(segment).alias("segment"), F.count_if(F.coalesce(t != "", F.lit(False))).alias("records"), has("[-.]").alias("gaps"), has("[RYSWKMBDHVN]").alias("ambiguous"), has("[^ACGTURYSWKMBDHVN.-]").alias("others"))
        out = one if out is None else out.unionByName(one)
    return out


LETTER_FLAGS_SQL = " UNION ALL ".join(
    f"SELECT '{s}' segment, count(*) FILTER (t <> '') records, count(*) FILTER (regexp_matches(t, '[-.]')) gaps, count(*) FILTER (regexp_matches(t, '[RYSWKMBDHVN]')) ambiguous, count(*) FILTER (regexp_matches(t, '[^ACGTURYSWKMBDHVN.-]')) others FROM (SELECT upper({s}_sequence) t FROM records)" for s in ("ha", "na")
)


def paired_chain(spark: SparkSession, folder: str) -> DataFrame:
    """HA rows paired with NA rows by normalised name, those left over by numbers close to theirs; how many by each way.
    The rows of even accessions stand for a file of HA, those of odd ones for a file of NA."""
    r = records(spark, folder).select("id", F.lit("EPI_ISL_").alias("prefix"), F.col("id").alias("number"), S.strain_key(F.regexp_replace("strain_name", r"/\d+/", "/")).alias("name"))
    ha, na = written(r.where("id % 2 = 0"), "ha"), written(r.where("id % 2 = 1"), "na")
    by_name = R.paired_by_name(ha.where("name is not null").select("id", "name"), na.select("id", "name")).where("right_id is not null").select("id", "right_id", F.lit("by_name").alias("way"))
    left = ha.join(by_name.select("id"), "id", "left_anti")
    by_number = R.paired_by_number(left, na).select("id", "right_id", F.lit("by_number").alias("way"))
    return by_name.unionByName(by_number).groupBy("way").agg(F.count("*").alias("pairs"), F.countDistinct("right_id").alias("used"), F.sum("id").alias("ids"), F.sum("right_id").alias("right_ids"))


CHAIN_SQL = rf"""WITH {RECORDS_SQL}, r AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace(strain_name, '/\d+/', '/', 'g')), '\s+', '', 'g'), 'H\d+N\d+$', ''), '[()]', '', 'g') AS name FROM recs),
f AS (SELECT name, min(id) right_id FROM r WHERE id % 2 = 1 AND name IS NOT NULL GROUP BY 1), a AS (SELECT r.id, f.right_id FROM r JOIN f ON f.name = r.name WHERE r.id % 2 = 0),
b AS (SELECT id, right_id FROM (SELECT x.id, y.id right_id, row_number() OVER (PARTITION BY x.id ORDER BY d.p) rn FROM r x, (VALUES (2, 0), (1, 1), (3, 2), (4, 3)) d(delta, p) JOIN r y ON y.id = x.id + d.delta AND y.id % 2 = 1 WHERE x.id % 2 = 0 AND x.id NOT IN (SELECT id FROM a)) WHERE rn = 1)
SELECT way, count(*) pairs, count(DISTINCT right_id) used, sum(id)::BIGINT ids, sum(right_id)::BIGINT right_ids FROM (SELECT *, 'by_name' way FROM a UNION ALL SELECT *, 'by_number' FROM b) GROUP BY 1"""


QUERIES = {f.__name__: f for f in (name_fields, date_fields, quality_reasons, valid_records, translations, content_keys, token_rows, letter_counts, position_letters, hamming_pairs, protein_mismatches, aligned_pairs, dedup_policies, duplicate_sizes, segment_pairs, paired_by_name, paired_by_number, kmer_terms, tfidf_neighbors, reranked_neighbors, projected_neighbors, twonn_hamming, duplicate_counts, letter_flags, paired_chain)}
ORACLES = {
    "name_fields": NAME_FIELDS_SQL, "date_fields": DATE_FIELDS_SQL, "quality_reasons": QUALITY_SQL, "valid_records": VALID_SQL, "translations": TRANSLATIONS_SQL, "content_keys": CONTENT_SQL, "token_rows": TOKENS_SQL, "letter_counts": LETTERS_SQL,
    "position_letters": POSITION_SQL, "hamming_pairs": HAMMING_SQL, "protein_mismatches": PROTEIN_SQL, "dedup_policies": DEDUP_SQL, "duplicate_sizes": DUPLICATES_SQL, "segment_pairs": SEGMENT_SQL, "paired_by_name": BY_NAME_SQL, "paired_by_number": BY_NUMBER_SQL, "kmer_terms": KMER_SQL,
    "tfidf_neighbors": TFIDF_SQL, "reranked_neighbors": RERANKED_SQL, "twonn_hamming": _twonn_sql(), "duplicate_counts": DUPLICATE_COUNTS_SQL, "letter_flags": LETTER_FLAGS_SQL, "paired_chain": CHAIN_SQL,
}

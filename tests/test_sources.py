import pytest
from pyspark.sql import functions as F

from veclore.operators.records import paired_by_name, paired_by_number, paired_segments
from veclore.sources import fasta, reports, tables

TEXT = """>E1|A/Town_X/1/2014|A_/_H1N1|2014-03-18|NA
acgt

ACGT
>E1|A/Town_X/1/2014|A_/_H1N1|2014-03-18|HA
TTTT
>E2|A/Town_Y/2/2017|H3N2|2017|4
GGGG
>bad|header
AAAA
>E3|x|H3N2|2017|PB2
AAAA
>E4|x|H3N2|unknown|HA
AAAA
"""


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(TEXT)
    rows = fasta.read_fasta(spark, [str(tmp_path / "a.fasta"), str(tmp_path / "missing.fasta")])
    assert rows.count() == 6
    got = {(r["epi_isl"], r["segment"]): r for r in fasta.parsed_headers(rows).collect()}
    assert set(got) == {("E1", "NA"), ("E1", "HA"), ("E2", "HA")}
    assert got["E1", "NA"]["sequence"] == "ACGTACGT" and got["E1", "NA"]["strain_name"] == "A/Town X/1/2014" and got["E1", "NA"]["subtype"] == "H1N1"
    assert (got["E2", "HA"]["year"], got["E2", "HA"]["month"], got["E2", "HA"]["day"]) == (2017, 6, 15)
    assert fasta.read_fasta(spark, str(tmp_path / "missing.fasta")).count() == 0


def test_fasta_roundtrip(spark, tmp_path):
    rows = spark.createDataFrame([(f"h{i}|a", "ACGT" * i) for i in range(60)] + [("none", None)], "header string, sequence string")
    fasta.write_fasta(rows, str(tmp_path / "out"))
    back = {(r["header"], r["sequence"]) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert back == {(f"h{i}|a", "ACGT" * i) for i in range(60)}


def test_pairing(spark):
    rows = spark.createDataFrame([("k", 1, "HA", "a", "m1"), ("k", 3, "HA", "b", "m3"), ("k", 2, "NA", "c", "m2"), ("j", 1, "NA", "d", "x")], "key string, at int, segment string, sequence string, meta string")
    got = {r["key"]: (r["meta"], r["ha_sequence"], r["na_sequence"]) for r in paired_segments(rows).collect()}
    assert got == {"k": ("m1", "b", "c"), "j": ("x", None, "d")}
    left, right = spark.createDataFrame([(1, "n"), (2, None)], "id int, name string"), spark.createDataFrame([(9, "n"), (8, "n")], "id int, name string")
    assert {(r["id"], r["right_id"]) for r in paired_by_name(left, right).collect()} == {(1, 8), (2, None)}
    nums = spark.createDataFrame([(1, "P", 10), (2, "P", 11), (3, "P", 12), (4, "Q", 14)], "id int, prefix string, number bigint")
    assert {(r["id"], r["right_id"], r["delta"]) for r in paired_by_number(nums, nums).collect()} == {(1, 3, 2), (2, 3, 1)}


def test_cache_checks(spark, tmp_path):
    good = spark.createDataFrame([(1, [1.0, 2.0], 2000, 1, "x"), (2, [1.0, 3.0], 2000, 1, "y")], "id bigint, embeddings array<double>, years int, months int, types string")
    assert tables.checked_cache(good, 2).count() == 2
    for bad in (good.drop("types"), good.union(good.limit(1)), good.withColumn("embeddings", F.when(F.col("id") == 1, F.col("embeddings"))), good.withColumn("embeddings", F.slice("embeddings", 1, F.col("id").cast("int")))):
        with pytest.raises(tables.CacheError):
            tables.checked_cache(bad, 2)
    tables.write_cache(good, str(tmp_path / "c"), source="test")
    assert spark.read.parquet(str(tmp_path / "c/rows")).count() == 2 and spark.read.json(str(tmp_path / "c/facts")).first()["source"] == "test"
    good.limit(1).write.parquet(str(tmp_path / "t"))
    for _ in range(2):
        tables.append_new(good, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("epi_isl,Isolate_Id,matched,clade_raw,Clade,major_clade,Lineage,Genotype\nE1,,True,NA,3C.2a1.b.2,,unassigned,G\nE1,,true,,3C.3,,L,\n,E2,,x,n/a,M,,\n")
    got = {r["epi_isl"]: r for r in tables.read_labels(spark, str(tmp_path / "l.csv")).collect()}
    assert got["E1"]["clade"] == "3C.3" and got["E1"]["clade_raw"] == "3C.3" and got["E1"]["major_clade"] == "3C.3" and got["E2"]["clade"] is None and got["E2"]["major_clade"] == "M"


def test_dataset_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"subtype": "H1N1", "paired_strains": [{"epi": "a", "year": 2000}, {"epi": "b"}], "stats": {"n": 2}}')
    got = tables.read_documents(spark, str(tmp_path / "d.json"), "epi string, year int").collect()
    assert [(r["subtype"], r["epi"], r["year"]) for r in got] == [("H1N1", "a", 2000), ("H1N1", "b", None)]


def test_reports(spark):
    rows = spark.createDataFrame([("a_b", 1.23456, 2), (None, float("nan"), None)], "g string, x double, n int")
    assert [r["line"] for r in reports.text_rows(rows).collect()] == ["| a_b | 1.2346 | 2 |", "| NA | NA | NA |"]
    assert reports.text_rows(rows, "latex").first()["line"] == r"a\_b & 1.2346 & 2 \\"
    assert reports.head_lines(["a", "b"])[1] == "|---|---|"
    assert '"n":null' in [r["line"] for r in reports.json_rows(rows).collect()][1]
    v = spark.createDataFrame([("g", float(i)) for i in [*range(1, 10), 100]], "g string, v double")
    b = reports.box(v, "g", "v").first()
    assert b["n"] == 10 and b["high"] == 9.0 and b["median"] == 5.5
    assert sum(r["n"] for r in reports.histogram(v, "g", "v", 0, 10, 5).collect()) == 10


def test_fasta_last_of_a_header_wins(spark, tmp_path):
    (tmp_path / "d.fasta").write_text(">a\nAA\n>b\nCC\n>a\nGG\n\nTT\n>c\n>a\nTA\n")
    (tmp_path / "e.fasta").write_text(">a\nCA\n")
    paths = [str(tmp_path / n) for n in ("d.fasta", "e.fasta", "no.fasta")]
    with pytest.warns(UserWarning, match="no.fasta"):
        rows = fasta.read_fasta(spark, paths, last=True)
    assert sorted((r["file"][-7:], r["header"], r["sequence"]) for r in rows.collect()) == [("d.fasta", "a", "TA"), ("d.fasta", "b", "CC"), ("d.fasta", "c", ""), ("e.fasta", "a", "CA")]


def test_labels_of_the_last_file_win(spark, tmp_path):
    head = "epi_isl,Isolate_Id,matched,clade_raw,Clade,major_clade,Lineage,Genotype\n"
    (tmp_path / "1.csv").write_text(head + "E1,,true,,x.1.2,,,\n" + "".join(f"F{i},,true,,y,,,\n" for i in range(2000)))
    (tmp_path / "2.csv").write_text(head + "E1,,true,,z.1.2,,,\nE1,,true,,w.1.2,,,\n")
    assert tables.read_labels(spark, str(tmp_path)).where("epi_isl = 'E1'").first()["clade"] == "w.1.2"


def test_figure_data(spark):
    rows = spark.createDataFrame([("a", 0.1, -0.1), ("a", 0.4, -0.4), ("a", float("nan"), 1.0), ("a", 2.0, None), ("b", 1.0, 1.0)], "grp string, x double, y double")
    assert {tuple(r) for r in reports.density(rows, "grp", "x", "y", 0.5).collect()} == {("a", 0, -1, 2), ("b", 2, 2, 1)}
    line = spark.createDataFrame([("a", float(i), float(i)) for i in range(5)] + [("b", 1.0, 1.0)], "grp string, x double, y double")
    got = {r["grp"]: r for r in reports.ellipses(line, "grp", "x", "y").collect()}
    assert abs(got["a"]["angle"] - 45) < 1e-9 and got["a"]["short"] < 1e-6 and abs(got["a"]["long"] - (5.991465 * 5.0) ** 0.5) < 1e-9
    assert (got["b"]["n"], got["b"]["long"], got["b"]["angle"]) == (1, None, None)
    assert reports.ellipses(line.where("false"), "grp", "x", "y").count() == 0


def test_content_digest(spark):
    rows = [(1, "a"), (2, None), (2, None), (3, "")]
    of = lambda r: tuple(tables.content_digest(spark.createDataFrame(r, "id int, t string"), ["id", "t"]).first())
    assert of(rows) == of(rows[::-1]) and of(rows)[0] == 4
    assert len({of(rows), of(rows[:3]), of([*rows[:3], (3, None)]), of([(1, "a"), (2, None), (3, ""), (3, "")])}) == 4
    assert of([]) == (0, "0")

from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.parity import assert_same
from veclore.llm import mixing, plans_corpus, sampling

ROWS = "id bigint, types string, years int"
CELLS = "plan_id int, types string, year_from int, year_to int, target_share double, min_rows int, sample_rows bigint, kind string"
DOCS = "doc_id bigint, text string, source string"
MIX = "plan_id int, source string, target_share double, max_repeats int, budget_tokens bigint"


@pytest.mark.parametrize("name", ["p1_found", "p7_found"])
def test_parity(spark, data, name):
    assert_same(spark, data, plans_corpus.QUERIES[name], plans_corpus.ORACLES[name])


def test_largest_remainder():
    assert sampling.largest_remainder([1, 1, 1], 10) == [4, 3, 3]
    assert sampling.largest_remainder([0.5, 0.3, 0.2], 10) == [5, 3, 2]
    assert sampling.largest_remainder([0, 0], 5) == [0, 0] and sampling.largest_remainder([], 5) == [] and sampling.largest_remainder([1], -1) == [0]


def test_quotas_keep_minimum_and_cap():
    plan = pd.DataFrame({"plan_id": 1, "types": list("abc"), "year_from": 0, "year_to": 9, "target_share": [0.9, 0.09, 0.01], "min_rows": [0, 0, 5], "sample_rows": 100, "available": [50, 500, 500]})
    got = sampling.quotas(plan)
    assert got.wanted.sum() == 100 and got.wanted[2] == 5 and got.quota[0] == 50 and got.quota[2] == 5


def test_infeasible_minima_and_spill():
    plan = pd.DataFrame({"plan_id": 1, "types": list("abc"), "year_from": 0, "year_to": 9, "target_share": [0.2, 0.3, 0.5], "min_rows": [50, 60, 70], "sample_rows": 100, "available": [500, 500, 500]})
    got = sampling.quotas(plan)
    assert got.quota.tolist() == [50, 60, 70] and not got.feasible.any() and (got.plan_quota == 180).all() and (got.plan_rows == 100).all()
    plan["min_rows"], plan["available"] = 0, [500, 10, 20]
    short, spilt = sampling.quotas(plan), sampling.quotas(plan, spill=True)
    assert short.quota.tolist() == [20, 10, 20] and short.feasible.all() and (short.plan_quota == 50).all()
    assert spilt.quota.tolist() == [70, 10, 20] and (spilt.plan_quota == 100).all()


def test_mix_of_public_tokens(spark, data):
    """Against a plain walk through the documents in the order of their keys."""
    sizes = plans_corpus._sizes(spark, data, plans_corpus.VOCABULARY)
    docs = defaultdict(list)
    for r in sizes.collect():
        docs[r["src"]].append((r["key"], r["tokens"]))
    bits = 63 - mixing.LEVEL_BITS * mixing.LEVELS
    for r in mixing.mix_report(sizes, spark.read.parquet(f"{data}/mix_targets.parquet")).collect():
        held = sorted(docs[(r["source"] or "").strip().lower()])
        whole = sum(t for _, t in held)
        rest = min(r["wanted"], float(r["reachable"]))
        given = whole * int(rest // whole) if whole else 0
        rest, taken, upto = rest - given, 0, 0
        for i, (key, tokens) in enumerate(held):
            upto += tokens
            if i + 1 == len(held) or held[i + 1][0] >> bits != key >> bits:
                taken = upto if upto <= rest else taken
        assert r["given"] == given + taken


def cells(spark):
    return spark.createDataFrame([(1, "x", 0, 4, 0.5, 0, 100, "x"), (1, "x", 5, 9, 0.3, 0, 100, "x"), (1, "y", None, None, 0.2, 0, 100, "y"), (2, "z", 0, 9, 0.1, 3, 10, "z"), (2, "z", 0, 9, 0.1, 3, 10, "z"), (3, "x", 0, 9, None, None, None, "x")], CELLS)


def test_sample(spark):
    # the hot category holds nearly all rows; some rows are useless
    rows = [(i, "x", i % 10) for i in range(5000)] + [(10_000 + i, "y", 3) for i in range(7)] + [(20_000, None, 1), (20_001, "x", None), (None, "y", 3)]
    frame = spark.createDataFrame(rows, ROWS).withColumn("kind", F.lit("clash")).withColumn("bucket", F.lit(1)).withColumn("key", F.lit("k"))
    drawn = sampling.proportional_sample(frame, cells(spark), seed=5).collect()
    got = defaultdict(set)
    for r in drawn:
        got[r["plan_id"], r["types"], r["year_from"]].add(r["id"])
    assert {k: len(v) for k, v in got.items()} == {(1, "x", 0): 50, (1, "x", 5): 30, (1, "y", None): 8}
    keys = {r["id"]: r["k"] for r in frame.select("id", sampling.random_key(F.col("id"), 5).alias("k")).collect()}
    band = sorted((keys[i], i) for i, t, y in rows if t == "x" and y is not None and y <= 4)
    assert got[1, "x", 0] == {i for _, i in band[:50]}  # the smallest random keys, none lost to the buckets
    report = {(r["plan_id"], r["types"], r["year_from"]): r for r in sampling.sample_report(frame, cells(spark), 5).collect()}
    assert len(report) == 5 and report[1, "y", None]["short"] == 12 and report[2, "z", 0]["available"] == 0 and report[2, "z", 0]["short"] == 3 and report[3, "x", 0]["quota"] == 0


def test_sample_of_nothing(spark):
    none = spark.createDataFrame([], ROWS)
    assert sampling.proportional_sample(none, cells(spark)).count() == 0 and sampling.sample_report(none, cells(spark)).where("short > 0").count() == 4
    assert sampling.sample_report(none, cells(spark).where("false")).count() == 0


def test_mix(spark):
    docs = [(i, "w " * (1 + i % 5), " Big") for i in range(4000)] + [(9000 + i, "a b c", "small") for i in range(10)] + [(9100, None, "small"), (9101, "", "small"), (9102, "x", None), (9103, "  \n", "small")]
    frame = spark.createDataFrame(docs, DOCS).withColumn("id", F.lit(1)).withColumn("key", F.lit("clash")).withColumn("tokens", F.lit(9))
    targets = spark.createDataFrame([(1, "big", 0.5, 1, 10_000), (1, "Small ", 0.4, 3, 10_000), (1, "gone", 0.1, 2, 10_000), (2, "BIG", 2.5, 3, 12_000), (2, "BIG", 2.5, 3, 12_000), (3, "big", None, None, None)], MIX)
    sizes = mixing.source_sizes(frame, mixing.space_tokens(F.col("text")), 3)
    plan = mixing.mix_plan(sizes, targets)
    mix = mixing.mixed(sizes, plan).collect()
    total, repeats = Counter(), Counter()
    for r in mix:
        total[r["plan_id"], r["source"]] += r["tokens"] * r["repeats"]
        repeats[r["plan_id"], r["source"], r["repeats"]] += 1
    whole = sum(1 + i % 5 for i in range(4000))
    assert 4990 <= total[1, "big"] <= 5000 and total[1, "Small "] == 90 and repeats[1, "Small ", 3] == 10
    assert 29_990 <= total[2, "BIG"] <= 30_000 and set(k[2] for k in repeats if k[0] == 2) == {2, 3} and whole == 12_000
    report = {(r["plan_id"], r["source"]): r for r in mixing.mix_report(sizes, targets).collect()}
    assert len(report) == 5 and report[1, "gone"]["reachable"] == 0 and report[1, "gone"]["given"] == 0
    assert abs(sum(r["actual_share"] for (p, _), r in report.items() if p == 1) - 1) < 1e-5


def test_mix_of_nothing(spark):
    sizes = mixing.source_sizes(spark.createDataFrame([], DOCS), mixing.space_tokens(F.col("text")), 3)
    targets = spark.createDataFrame([(1, "a", 0.5, 1, 100)], MIX)
    assert mixing.mix_report(sizes, targets).first()["given"] == 0
    assert mixing.mix_report(sizes, targets.where("false")).count() == 0


def test_public_tokens(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "Hello world, hello!", "a"), (2, None, "a"), (3, "", "a")], DOCS)
    assert mixing.PATTERN == tokenizers.PATTERN
    count = mixing.public_tokens(spark, tokenizers.path("byte_bpe_50k.tiktoken"))
    got = {r["doc_id"]: r["n"] for r in docs.select("doc_id", count("text").alias("n")).collect()}
    assert got == {1: 5, 2: 0, 3: 0}

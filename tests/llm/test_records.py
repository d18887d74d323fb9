import random

import pytest
from pyspark.sql import functions as F

from tests.parity import assert_same
from veclore.llm import partenum, plans_records

SCHEMA = "key bigint, first_text string, second_text string"


@pytest.mark.parametrize("name", sorted(plans_records.ORACLES))
def test_parity(spark, data, name):
    assert_same(spark, data, plans_records.QUERIES[name], plans_records.ORACLES[name])


def mutated(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        at, what = rng.randrange(len(s)), rng.random()
        if what < 0.6:
            s[at] = rng.choice("ACGT")
        elif what < 0.8:
            s.insert(at, rng.choice("ACGTN"))
        else:
            del s[at]
    return "".join(s)


def brute(rows, k=16, threshold=0.6):
    sets = {}
    for key, a, b in rows:
        if key is not None:
            for t in (a, b):
                t = partenum.clean(t)
                sets.setdefault(key, set()).update(t[i : i + k] for i in range(len(t) - k + 1))
    keys = sorted(x for x, s in sets.items() if s)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def fixture():
    rng = random.Random(11)
    rows, key = [], 0
    for _ in range(12):
        root = "".join(rng.choice("ACGT") for _ in range(1500))
        for edits in (0, 1, 4, 10, 16, 22, 60, 120):
            s = mutated(rng, root, edits)
            if edits == 4:
                s = s[700:] + s[:700]  # moved piece
            key += 1
            rows.append((key, s[:900], s[900:].lower() if edits == 1 else s[900:]))
    rows += [(500, rows[0][1], rows[0][2]), (501, rows[0][1][:300] + " \n-" + rows[0][1][300:], rows[0][2]), (501, rows[0][1], rows[0][2]), (502, None, None), (503, "", "ACGT"), (None, rows[0][1], rows[0][2]), (504, rows[8][1], None), (505, "ACGTACGTACGTACGTAC", None), (506, None, "ACGTACGTACGTACGTAC")]
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("text", F.lit(1)).withColumn("a", F.lit(1))
    pairs, members = partenum.similar(frame)
    got = {(r["a"], r["b"]) for r in partenum.all_pairs(pairs, members).collect()}
    true = brute(rows)
    assert got <= true and len(true - got) <= 0.01 * len(true) and len(true) > 100
    group = {r["key"]: (r["group_id"], r["links"]) for r in partenum.groups(pairs, members).collect()}
    assert group[500][0] == group[1][0] == 1 and 502 not in group and 503 not in group
    links = {k: sum(k in p for p in got) for k in group}
    assert all(group[k][1] == links[k] for k in group)


def test_bands_meet(spark):
    """Any two sizes within the threshold share a band."""
    import numpy as np

    n = np.unique(np.concatenate([np.arange(1, 3000), 16 * 8 ** np.arange(6) + np.arange(-2, 3)[:, None]], axis=None))
    for threshold in (0.6, 0.8, 0.05):
        band, upper = partenum.bands(n, threshold)
        for i, m in enumerate(n):
            near = (n >= m) & (m >= threshold * n)
            assert all(b == band[i] or (upper[i] and b == band[i] + 1) for b in band[near])


def test_nothing(spark):
    pairs, members = partenum.similar(spark.createDataFrame([(1, None, None)], SCHEMA))
    assert partenum.all_pairs(pairs, members).count() == 0 and partenum.groups(pairs, members).count() == 0


def test_long_texts_and_other_letters(spark):
    rng = random.Random(2)
    s = "".join(rng.choice("ACGTŁß") for _ in range(200_000))
    rows = [(1, s, None), (2, s[:100_000] + "A" + s[100_000:], None), (3, s[::-1], None)]
    assert {(r["a"], r["b"]) for r in partenum.similar(spark.createDataFrame(rows, SCHEMA))[0].collect()} == {(1, 2)}

from datetime import datetime as D

from veclore.operators.references import Reference, direct_orphans, orphan_cascade, unmet

T = "target_key string, row_key string, since timestamp, until timestamp"
R = "row_key string, ref_key string, at timestamp"


def refs(spark, rows, targets, table="child", field="f", parent="parent"):
    return Reference(table, field, spark.createDataFrame(rows, R), parent, spark.createDataFrame(targets, T))


def keys(frame):
    return sorted(r["row_key"] for r in frame.collect())


def test_as_of_rules(spark):
    targets = [("a", "1", D(2020, 1, 1), None), ("b", "2", D(2020, 3, 1), None), ("c", "3", D(2020, 1, 1), D(2020, 2, 1)), ("d", "4", D(2020, 1, 1), D(2020, 2, 1)), ("d", "5", D(2020, 5, 1), None), ("n", "6", None, None)]
    at = D(2020, 2, 1)
    rows = [("met", "a", at), ("late", "b", at), ("withdrawn", "c", at), ("again", "d", D(2020, 6, 1)), ("between", "d", D(2020, 3, 1)), ("missing", "x", at), ("no key", None, at), ("no time", "a", None), ("undated target", "n", at), ("same time", "a", D(2020, 1, 1)), ("missing", "x", at)]
    assert keys(direct_orphans(refs(spark, rows, targets))) == ["between", "late", "missing", "no time", "undated target", "withdrawn"]


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    day = lambda: D(2020, rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23))
    targets = []
    for i in range(300):
        a = day()
        targets.append((rng.choice("hhhhabcd"), str(i), a, day() if rng.random() < 0.7 else None))  # half of all under one key
    rows = [(str(i), rng.choice("hhhhabcdz"), day()) for i in range(400)]
    lost = sorted(k for k, ref, at in rows if not any(t == ref and s <= at and (u is None or u > at) for t, _, s, u in targets))
    assert keys(direct_orphans(refs(spark, rows, targets))) == lost


def test_empty_tables_and_clashing_columns(spark):
    assert direct_orphans(refs(spark, [], [])).count() == 0
    rows = spark.createDataFrame([("1", "x", D(2020, 1, 1), "u", 1)], R + ", until string, period int")
    targets = spark.createDataFrame([], T + ", key string, at int")
    assert unmet(rows, targets).count() == 1
    assert keys(direct_orphans(Reference("t", "f", rows, "p", targets))) == ["1"]


def test_cascade_reaches_grandchildren(spark):
    at = D(2021, 1, 1)
    since = D(2020, 1, 1)
    tree = [(k, k, since, None) for k in ("root", "lost", "leaf", "fine")]
    parents = refs(spark, [("leaf", "lost", at), ("lost", "gone", at), ("fine", "root", at)], tree, "node", "parent", "node")
    users = refs(spark, [("u1", "leaf", at), ("u2", "fine", at), ("u3", "nowhere", at)], tree, "user", "node", "node")
    depth = {(r["ref_table"], r["row_key"]): r["depth"] for r in orphan_cascade([parents, users]).collect()}
    assert depth == {("node", "lost"): 0, ("node", "leaf"): 1, ("user", "u3"): 0, ("user", "u1"): 2}


def test_cascade_of_nothing(spark):
    assert orphan_cascade([refs(spark, [], [])]).count() == 0

import os

from veclore import runtime


def test_written_and_discarded(spark):
    rows = runtime.written(spark.range(5), "test")
    assert rows.count() == 5 and "ExistingRDD" not in rows._jdf.queryExecution().toString()
    folder = f"{runtime.shared_folder(spark)}/veclore/{spark.sparkContext.applicationId}".removeprefix("file:")
    assert os.path.isdir(folder)
    runtime.discard(spark)
    assert not os.path.exists(folder)


def test_broadcast_only_when_small(spark):
    hint = lambda f: "ResolvedHint" in f._jdf.queryExecution().analyzed().toString()
    assert hint(runtime.broadcast_if_small(spark.range(5), 5)) and not hint(runtime.broadcast_if_small(spark.range(6), 5))

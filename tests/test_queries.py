"""Every core query runs; those with a SQL twin give the same rows."""

from datetime import datetime, timedelta

import pytest

from tests.parity import assert_same
from veclore.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, name):
    if name in registry.ORACLES:
        assert_same(spark, data, registry.QUERIES[name], registry.ORACLES[name])
    else:
        assert registry.QUERIES[name](spark, data).toPandas().columns.size


def test_entry_is_complete(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns


def test_core_stands_alone():
    """Nothing outside the llm subpackage imports it."""
    from pathlib import Path

    import veclore

    for path in Path(veclore.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts:
            assert "veclore.llm" not in path.read_text(), path


def test_density_leaves_out_vectors_of_other_lengths(spark, tmp_path):
    """elements must not be read where there are none; the optimizer may read them before the length is looked at."""
    at, inf = datetime(2024, 1, 1), float("inf")
    vectors = [[0.2, -0.7] + [1.0] * 62, [0.3, -0.6] + [0.0] * 62, [-3.0, 4.4] + [2.0] * 62, [], [1.0], [1.0] * 48, [1.0] * 65, None, [0.0] * 64, [inf] + [1.0] * 63, [None] + [1.0] * 63]
    rows = [(i, "fixed", v, 2020, 1, "H1N1", f"EPI_ISL_{i}", None, at) for i, v in enumerate(vectors)] + [(0, "fixed", [], 2020, 1, "H1N1", "EPI_ISL_0", None, at - timedelta(1))]
    schema = "id bigint, cache_name string, embeddings array<float>, years int, months int, types string, epi_isl string, lab_code string, loaded_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "embedding_cache.parquet")
    assert {tuple(r) for r in registry.QUERIES["vector_density"](spark, str(tmp_path)).collect()} == {("H1N1", 0, -2, 2), ("H1N1", -6, 8, 1)}
    assert_same(spark, str(tmp_path), registry.QUERIES["vector_density"], registry.ORACLES["vector_density"])

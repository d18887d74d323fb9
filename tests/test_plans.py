"""What the optimizer makes of the queries: columns read, filters pushed, no products of tables."""

import re
from datetime import datetime, timedelta

from veclore.plans import integrity, pipeline, vectors


def plan(frame):
    return frame._jdf.queryExecution().toString()


def test_scans_read_only_what_they_need(spark, data):
    text = "".join(plan(f) for r in integrity.references(spark, data).values() for f in (r.rows, r.targets))
    assert "embeddings" not in "".join(re.findall(r"ReadSchema: [^\n]*", text)) and "ha_sequence" not in "".join(re.findall(r"ReadSchema: [^\n]*", text))
    assert "EqualTo(cache_name,fixed)" in text


def test_no_cartesian_products(spark, data):
    for query in (integrity.p4_found, vectors.label_coverage, vectors.band_counts, vectors.simple_forecasts):
        text = plan(query(spark, data))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_streams_of_many_files_lose_nothing(spark, tmp_path, monkeypatch):
    rows = [(i, i % 3, "ab"[i % 2], datetime(2024, 1, 1) + timedelta(minutes=20 * (i * 7919 % 600)), float(i)) for i in range(600)]
    frame = spark.createDataFrame(rows, "event_id bigint, user_id int, event_type string, ts timestamp, value double")
    whole, split = str(tmp_path / "whole"), str(tmp_path / "split")
    frame.coalesce(1).write.parquet(f"{whole}/events.parquet")
    frame.coalesce(1).write.parquet(f"{split}/events.parquet")
    monkeypatch.setattr(pipeline, "table", lambda spark, folder, name: spark.read.parquet(f"{folder}/{name}.parquet").repartition(250 if folder == split else 1))
    for query in (pipeline.stream_windows, pipeline.stream_sessions):
        one, many = (sorted(map(tuple, query(spark, f).collect())) for f in (whole, split))
        assert one == many and one

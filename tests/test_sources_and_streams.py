"""Files in and out, and streams against their batch twins."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from panelweave.plans import catalog
from panelweave.sources import io

SMALL = "/root/testdata/sf0.001"


def test_canonical_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "2020"), ("b", 2, "2021")], "symbol string, v int, year string")
    io.write_canonical(df, str(tmp_path / "c"), ["year"])
    io.write_canonical(df.filter("year = '2021'").withColumn("v", F.lit(9)), str(tmp_path / "c"), ["year"])
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [1, 9]
    assert io.read_partition(spark, str(tmp_path / "c"), "year", "2021").first().v == 9
    with pytest.raises(ValueError):
        io.write_canonical(df.filter("v > 100"), str(tmp_path / "c"))


def test_raw_frames_keep_their_lineage(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    io.write_raw(df, str(tmp_path), "vendor", "bars", "r1", "feed", as_text=True)
    io.write_raw(df, str(tmp_path), "vendor", "bars", "r2", "feed")
    back = spark.read.option("mergeSchema", False).parquet(str(tmp_path / "raw/vendor/bars/run_id=r1"))
    assert back.first().a == "1" and back.first()["_source"] == "feed"


def test_sorted_files_and_inventory(spark, tmp_path):
    io.write_sorted(spark.range(1000).withColumn("d", F.expr("date'2020-01-01' + cast(id % 100 as int)")), str(tmp_path / "s"), ["d"], 4)
    files = io.file_inventory(spark, str(tmp_path / "s"), "d")
    total = io.dataset_summary(files, "s").first()
    assert total.rows == 1000 and str(total.min_date) == "2020-01-01" and total.files == files.count()


def test_manifests_and_aborted_runs(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "r1.json").write_text(json.dumps({"run_id": "r1", "status": "ok"}, indent=1))
    started = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    got = {r.run_id: r.status for r in io.ingestion_runs(spark, str(tmp_path / "m"), started).collect()}
    assert got == {"r1": "ok", "r2": "aborted_no_manifest"}


def test_registry_is_complete():
    entries = catalog.entries()
    covered = {i for e in entries.values() for i in e.ids}
    expected = {f"{p}{n}" for p, last in (("F", 28), ("W", 15), ("X", 11), ("E", 11), ("P", 23), ("R", 11), ("G", 21), ("B", 17), ("O", 10), ("C", 6),
                                          ("V", 20), ("ST", 10), ("T", 5), ("J", 21), ("U", 11), ("Q", 20), ("M", 17), ("N", 28), ("H", 5))
                for n in range(1, last + 1)}
    # a trade-rule simulator, its ledger, chart patterns and a check of constants are not queries
    assert expected - covered == {"G5", "C5", "G16", "R2"}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The smallest tables with events and line items as five shuffled part files."""
    folder = str(tmp_path_factory.mktemp("parts"))
    for name in ("events", "lineitem", "part", "orders"):
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        (df.repartition(5, F.xxhash64(*df.columns)) if name in ("events", "lineitem") else df.coalesce(1)).write.parquet(f"{folder}/{name}.parquet")
    return folder


def same(a, b):
    a, b = ({str(r) for r in df.select(*sorted(df.columns)).collect()} for df in (a, b))
    return bool(a) and a == b


@pytest.mark.parametrize("stream,batch", [("session_minutes_stream", "session_minutes"), ("account_stream", "account_positions"), ("volatility_stream", "term_variance")])
def test_streams_of_many_batches_equal_their_batch_twin(spark, parts, stream, batch):
    entries = catalog.entries()
    a = entries[stream].build(spark, parts, files=1)
    assert same(a, entries[batch].build(spark, SMALL).select(*a.columns))


def test_sliding_and_alert_streams_of_many_batches(spark, parts):
    from panelweave.plans import queries_streams
    from panelweave.streaming import jobs
    trades = queries_streams.trades(spark, SMALL)
    sliding = jobs.sliding_stream(trades, queries_streams.BIG).withColumn("big_net", F.round("big_net", 4))
    assert same(queries_streams.sliding_half_hours_stream(spark, parts, files=1), sliding)
    assert same(queries_streams.alert_once_stream(spark, parts, files=1), jobs.alert_stream(trades, 150.0).select("group_id", "side", "day"))


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    from panelweave.streaming import jobs
    rows = [(1, "2024-01-01 10:00:00"), (2, "2024-01-05 10:00:00"), (3, "2024-01-05 09:00:00"), (4, "2024-01-01 10:00:01")]
    for i, (event, ts) in enumerate(rows):
        one = spark.createDataFrame([(event, ts, 1, "purchase", 5.0)], "event_id long, ts string, user_id long, event_type string, value double")
        one.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = jobs.trades_stream(jobs.file_stream(spark, str(tmp_path), "events", 1), late="1 day")
    kept = {r.seq for r in jobs.run_available(stream, "append", "late").select("seq").collect()}
    assert kept == {1, 2, 3}


def test_flagship_runs(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0

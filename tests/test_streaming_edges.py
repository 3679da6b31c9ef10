import os

import pytest
from pyspark.sql import functions as F

from skyledger.operators import summaries as S
from skyledger.streaming import telemetry as ST
from skyledger.streaming.supervision import PipelineListener, run_with_restart


def _enriched(spark, rows):
    return spark.createDataFrame(
        rows, "arrival_seq long, arrival_pos int, id string, ts_ms long, temperature double, "
              "lat double, lon double, org string, city string")


def test_group_limit_guard_raises(spark):
    e = _enriched(spark, [(1, 0, "d", 0, 1.0, 0.0, 0.0, "Org 1", "a"), (2, 0, "d", 1, 1.0, 0.0, 0.0, "Org 1", "b")])
    assert S.group_limit_guard(e, max_org_city=5).first().within_limits
    with pytest.raises(Exception):
        S.group_limit_guard(e, max_org_city=1, fail=True).collect()


def test_event_time_window_drops_rows_behind_watermark(spark, scratch):
    """H1/H3: with a 10 s watermark a row older than (max event time - 10 s)
    arriving in a later batch is dropped (unlike the arrival window, H2)."""
    import time
    src = os.path.join(scratch, "enr")
    batches = [
        [(1, 0, "d1", 200_000, 10.0, 0.0, 0.0, "Org 1", "c"), (2, 0, "d1", 205_000, 20.0, 0.0, 0.0, "Org 1", "c")],
        [(3, 0, "d2", 206_000, 30.0, 0.0, 0.0, "Org 1", "c")],
        # late: the watermark for late rows is the one of the batch before
        [(4, 0, "d2", 100_000, 99.0, 0.0, 0.0, "Org 1", "c"), (5, 0, "d2", 207_000, 5.0, 0.0, 0.0, "Org 1", "c")],
    ]
    for i, rows in enumerate(batches):
        _enriched(spark, rows).coalesce(1).write.parquet(os.path.join(src, f"b{i}"))
        time.sleep(1.1)   # distinct file times: read in this order
    b1 = _enriched(spark, batches[0])
    stream = ST.enriched_stream(spark, src + "/*", b1.schema, max_files_per_trigger=1)
    q = (ST.city_temperature_stream(stream, watermark="10 seconds").writeStream.outputMode("update")
         .format("memory").queryName("wm_test").option("checkpointLocation", os.path.join(scratch, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("wm_test")
    assert got.count() > 0
    assert got.where(F.col("window_start_ms") <= 100_000).count() == 0   # the late row made no window
    assert got.agg(F.max("n")).first()[0] == 4                            # 200 s, 205 s, 206 s, 207 s
    dropped = sum(s_.numRowsDroppedByWatermark for p_ in q.recentProgress for s_ in p_.stateOperators)
    assert dropped == 6    # the late row, counted once per sliding window (60 s / 10 s)


def test_listener_counts_failures(spark, scratch):
    listener = PipelineListener()
    spark.streams.addListener(listener)
    src = os.path.join(scratch, "nums")
    spark.range(0, 5).write.parquet(os.path.join(src, "a"))

    def sink(batch, bid):
        raise ValueError("boom")

    def start():
        return (spark.readStream.schema("id long").parquet(src + "/*").writeStream.foreachBatch(sink)
                .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start())

    with pytest.raises(Exception):
        run_with_restart(start, min_backoff_s=0.05, max_backoff_s=0.1, max_restarts=1)
    import time
    for _ in range(50):
        if sum(listener.terminations.values()) >= 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert sum(listener.terminations.values()) == 2   # first run and one restart
    assert listener.failures(spark).count() >= 1


def test_summaries_resume_from_checkpoint(spark, scratch):
    """Run the summary stream on the first files, stop, add the rest, restart
    from the same checkpoint: the latest table equals the batch result."""
    import time
    from pyspark.sql import Window as W
    from skyledger.plans import telemetry as T
    from skyledger.sources import fixtures as FX
    sf = "/root/testdata/sf0.001"
    e = T.enrich(FX.measurements(spark, sf), FX.places(spark, sf)).withColumn("arrival_pos", F.lit(0))
    e = e.select("id", "arrival_seq", "arrival_pos", "ts_ms", "temperature", "lat", "lon", "org", "city")
    part = e.withColumn("_p", F.ntile(4).over(W.orderBy("arrival_seq")))
    src, state, ck = (os.path.join(scratch, n) for n in ("enr", "state", "ck"))
    for i in (1, 2):
        part.where(F.col("_p") == i).drop("_p").coalesce(1).write.parquet(os.path.join(src, f"b{i}"))
        time.sleep(1.1)
    run = lambda: [q.awaitTermination() for q in ST.start_summaries(
        spark, src + "/*", e.schema, state, max_files_per_trigger=1,
        prefix="resume", checkpoint_root=ck)]
    run()
    for i in (3, 4):
        part.where(F.col("_p") == i).drop("_p").coalesce(1).write.parquet(os.path.join(src, f"b{i}"))
        time.sleep(1.1)
    run()
    got = ST.read_state(spark, state, "latest_city_temperature").select(
        "org", "city", "window_end_ms", F.round("avg_temperature", 6).alias("t"), "n")
    want = T.summaries(e)["latest_city_temperature"].select(
        "org", "city", "window_end_ms", F.round("avg_temperature", 6).alias("t"), "n")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0

import os

from pyspark.sql import Window as W, functions as F

from skyledger.operators.enrich import flatten_measurements, pack_measurements
from skyledger.plans import telemetry as T
from skyledger.sources import fixtures as FX
from skyledger.streaming import telemetry as ST
from skyledger.operators.arrival import arrival_window_temperature
from skyledger.streaming.arrival_window import arrival_window_stream
from skyledger.streaming.cart_state import cart_fold, cart_fold_stream
from skyledger.streaming.supervision import PipelineListener, run_with_restart
from tests.conftest import SF001


def test_telemetry_stream_equals_batch(spark, scratch):
    m = FX.measurements(spark, SF001)
    places = FX.places(spark, SF001)
    packets_dir = os.path.join(scratch, "packets")
    pk = pack_measurements(m).orderBy("arrival_seq")
    pk = pk.withColumn("_part", F.ntile(4).over(W.orderBy("arrival_seq")))
    for i in range(1, 5):
        pk.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("overwrite").json(
            os.path.join(packets_dir, f"b{i}"))
    # one malformed line and a packet without id
    with open(os.path.join(packets_dir, "b4", "edge.json"), "w") as f:
        f.write("{oops\n")
        f.write('{"timestamp": 1, "measurements": []}\n')
    listener = PipelineListener()
    spark.streams.addListener(listener)
    enriched_dir, rejects_dir = os.path.join(scratch, "enriched"), os.path.join(scratch, "rejects")
    q = ST.start_enrichment(spark, packets_dir + "/*", places, enriched_dir, rejects_dir,
                            name="t-enrich", checkpoint=os.path.join(scratch, "ck-enrich"))
    q.awaitTermination()
    enriched = spark.read.parquet(enriched_dir)
    # the packet format carries float temperatures: compare with batch over the same packets
    batch_e = T.enrich(flatten_measurements(pack_measurements(m)), places)
    cols = ["id", "ts_ms", "org", "place_id", "city"]
    assert enriched.count() == m.count()
    assert enriched.select(cols).exceptAll(batch_e.select(cols)).count() == 0
    assert spark.read.parquet(rejects_dir).count() == 2

    # replaying the enrichment from its checkpoint adds nothing
    q = ST.start_enrichment(spark, packets_dir + "/*", places, enriched_dir, rejects_dir,
                            name="t-enrich", checkpoint=os.path.join(scratch, "ck-enrich"))
    q.awaitTermination()
    assert spark.read.parquet(enriched_dir).count() == m.count()

    state = os.path.join(scratch, "state")
    schema = enriched.drop("batch_id").schema
    qs = ST.start_summaries(spark, enriched_dir, schema, state, fan=2,
                            max_files_per_trigger=1, prefix="t-summary",
                            checkpoint_root=os.path.join(scratch, "ck-summary"))
    for x in qs:
        x.awaitTermination()
    spark.streams.removeListener(listener)
    batch = T.summaries(batch_e, order_cols=("arrival_seq", "arrival_pos"))
    latest = ST.read_state(spark, state, "latest_city_temperature")
    a = latest.select("org", "city", "window_end_ms", F.round("avg_temperature", 6).alias("t"))
    b = batch["latest_city_temperature"].select("org", "city", "window_end_ms",
                                                F.round("avg_temperature", 6).alias("t"))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    windows = ST.read_state(spark, state, "city_temperature_windows")
    assert windows.count() == batch["city_temperature"].count()
    ld = ST.read_state(spark, state, "latest_drone_summary").select("org", "window_end_ms", "city", "id")
    bd = batch["latest_drone_summary"].select("org", "window_end_ms", "city", "id")
    assert ld.count() == bd.count() and ld.exceptAll(bd).count() == 0
    tp = {(r.pipeline, r.stage): r.rows for r in listener.throughput(spark).collect()}
    assert tp[("t-enrich", "ingest.packets")] >= pk.count() + 2
    assert tp[("t-enrich", "ingest.rejects")] == 2


def test_stateful_streams_equal_batch(spark, scratch):
    ev = FX.cart_events(spark, SF001, auth="seq7")
    cat = FX.catalog(spark, SF001)
    src = os.path.join(scratch, "cart")
    ev = ev.withColumn("_p", F.ntile(3).over(W.orderBy("seq")))
    for i in range(1, 4):
        ev.where(F.col("_p") == i).drop("_p").coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"b{i}"))
    stream = spark.readStream.schema(ev.drop("_p").schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    out = os.path.join(scratch, "cart-out")
    q = (cart_fold_stream(stream, cat).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", os.path.join(scratch, "ck-cart"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out).where("kind = 'outcome'").select("user_id", "seq", "outcome")
    want = cart_fold(ev.drop("_p"), cat).where("kind = 'outcome'").select("user_id", "seq", "outcome")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_arrival_window_stream_equals_batch(spark, scratch):
    e = T.enrich(FX.measurements(spark, SF001), FX.places(spark, SF001)).select(
        "arrival_seq", "id", "ts_ms", "temperature", "lat", "lon", "org", "city")
    src = os.path.join(scratch, "enr")
    e = e.withColumn("_p", F.ntile(3).over(W.orderBy("arrival_seq")))
    for i in range(1, 4):
        e.where(F.col("_p") == i).drop("_p").coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"b{i}"))
    stream = spark.readStream.schema(e.drop("_p").schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    out = os.path.join(scratch, "aw-out")
    q = (arrival_window_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(scratch, "ck-aw")).trigger(availableNow=True).start())
    q.awaitTermination()
    cols = ["org", "city", "emit_no", "window_start_ms", "n", "first_id"]
    got = spark.read.parquet(out).select(cols)
    want = arrival_window_temperature(e.drop("_p")).select(cols)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_restart_after_failure(spark, scratch):
    src = os.path.join(scratch, "nums")
    spark.range(0, 10).write.parquet(os.path.join(src, "a"))
    flag = os.path.join(scratch, "failed-once")
    failures = []

    def sink(batch, bid):
        if not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("simulated executor loss")
        batch.write.mode("overwrite").parquet(os.path.join(scratch, "out", f"b={bid}"))

    def start():
        return (spark.readStream.schema("id long").parquet(src + "/*").writeStream
                .foreachBatch(sink).option("checkpointLocation", os.path.join(scratch, "ck"))
                .trigger(availableNow=True).start())

    run_with_restart(start, min_backoff_s=0.1, max_backoff_s=0.2, max_restarts=2,
                     on_failure=failures.append)
    assert len(failures) == 1
    assert spark.read.parquet(os.path.join(scratch, "out")).count() == 10

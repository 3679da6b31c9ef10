import os
import time

from pyspark.sql import functions as F

from skyledger.operators.enrich import pack_measurements

SCHEMA = "arrival_seq long, id string, ts_ms long, temperature double, lat double, lon double"


def test_packets_leave_at_the_end_of_their_interval(spark, scratch):
    """Device d3 falls silent at 25 s; its last packet leaves when the others' time has
    passed 30 s, in a run restarted from the checkpoint; intervals that have not
    ended stay state."""
    rows = [(i, f"d{i % 4}", 500 * i + 7, float(i), 0.0, 0.0) for i in range(140) if i % 4 != 3 or 500 * i < 25_000]
    src, out, ck = (os.path.join(scratch, n) for n in ("in", "out", "ck"))
    emitted = []
    for i, (a, b) in enumerate(((0, 20_000), (20_000, 45_000), (45_000, 71_000))):
        spark.createDataFrame([r for r in rows if a <= r[2] < b], SCHEMA).coalesce(1).write.parquet(os.path.join(src, f"b{i}"))
        time.sleep(0.1)
        stream = spark.readStream.schema(SCHEMA).parquet(src + "/*")
        (pack_measurements(stream, watermark="0 seconds").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination())
        emitted.append({(r.id, r.timestamp) for r in spark.read.parquet(out).collect()})
    assert ("d3", 30_000) not in emitted[0] and ("d3", 30_000) in emitted[1]
    now = max(r[2] for r in rows)
    want = pack_measurements(spark.createDataFrame(rows, SCHEMA)).where(F.col("timestamp") <= now)
    got = spark.read.parquet(out).select(want.columns)
    assert got.count() == want.count() == len(emitted[2]) and got.exceptAll(want).count() == 0
    assert not any(t > now for _, t in emitted[2])

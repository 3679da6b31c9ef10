"""H1, H4, H6, C6 on streams.

Two stages, each a Structured Streaming query with its own checkpoint:

1. :func:`start_enrichment` - packets (JSON files) -> split rejects ->
   flatten -> org -> nearest place, in ``foreachBatch`` (the grid join
   aggregates, which a stream cannot do before the window aggregation).
   Each batch is written once to ``<out>/batch_id=<n>``: a replayed batch
   that already committed is skipped, so the enriched table is exactly once.
2. :func:`start_summaries` - the enriched table as a stream -> panes ->
   state tables kept as change logs (H1/H4/A5), which late rows correct (H3).
   Both summaries read every enriched row (C6): one query each, sharing the
   input.

:func:`city_temperature_stream` and :func:`drones_per_city_stream` are the
windows as plain streams with a watermark, which drops rows behind it, for
sinks of one's own.

Rate control (H6) is the source's ``maxFilesPerTrigger``; nothing is
dropped.  Throughput (D15) is published with ``observe``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from skyledger.functions.orgs import DEFAULT_NUM_ORGS
from skyledger.operators import summaries as S
from skyledger.operators.enrich import flatten_measurements
from skyledger.operators.nearest import place_stats
from skyledger.plans.telemetry import enrich
from skyledger.session import stream_checkpoint
from skyledger.sources.files import CORRUPT, read_packets, split_packets
from skyledger.streaming.state_tables import StateTables, hadoop_path_exists

ENRICHED_COLUMNS = ["id", "arrival_seq", "arrival_pos", "ts_ms", "temperature", "lat", "lon",
                    "org", "place_id", "name", "province", "country", "city"]


def numbered(batch: DataFrame, name: str) -> DataFrame:
    """``batch`` with ``name``: its rows' numbers from 0, without gaps, in the order
    of its partitions.  ``batch`` is persisted, so both reads see the same ones;
    the table of partition sizes has one row for each."""
    at = batch.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    sizes = at.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return at.join(before, "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def _enrich_batch(places: DataFrame, out: str, rejects_out: str, num_orgs: int,
                  stats: dict[str, int]):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{out}/batch_id={batch_id}"
        if hadoop_path_exists(spark, f"{target}/_SUCCESS"):
            return   # replay of a committed batch; its rejects were written before it
        batch = batch.persist()   # read once, used by the valid and reject branches
        try:
            valid, rejected = split_packets(batch)
            rejected.write.mode("overwrite").parquet(f"{rejects_out}/batch_id={batch_id}")
            # Packets without an arrival_seq: the batch, then the position in the batch.
            valid = numbered(valid, "_no")
            valid = valid.withColumn("arrival_seq", F.coalesce(
                F.col("arrival_seq"), F.lit(batch_id).cast("long") * (1 << 40) + F.col("_no"))).drop("_no")
            flat = flatten_measurements(valid)
            e = enrich(flat, places, num_orgs, **stats).select(*ENRICHED_COLUMNS)
            e.write.mode("overwrite").parquet(target)
        finally:
            batch.unpersist()
    return write


def start_enrichment(spark: SparkSession, packets_path: str, places: DataFrame, out: str,
                     rejects_out: str, *, name: str = "data-enrichment",
                     num_orgs: int = DEFAULT_NUM_ORGS, max_files_per_trigger: int | None = 1,
                     checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Stage 1.  Packets may carry an ``arrival_seq``; otherwise the order
    of arrival is the micro-batch, then the position in the batch."""
    raw = read_packets(spark, packets_path, stream=True, max_files_per_trigger=max_files_per_trigger,
                       with_arrival=True)
    raw = raw.observe("ingest", F.count(F.lit(1)).alias("packets"),
                      F.count_if(F.col(CORRUPT).isNotNull() | F.col("id").isNull()).alias("rejects"))
    stats = place_stats(places)   # once per stream, not per micro-batch
    w = (raw.writeStream.queryName(name)
         .foreachBatch(_enrich_batch(places, out, rejects_out, num_orgs, stats))
         .option("checkpointLocation", checkpoint or stream_checkpoint(spark, name)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def enriched_stream(spark: SparkSession, enriched_path: str, schema,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(enriched_path)


def city_temperature_stream(enriched: DataFrame, watermark: str = "2 minutes",
                            window: str = S.WINDOW, slide: str = S.SLIDE) -> DataFrame:
    """H1 + D1 on a stream (update mode)."""
    e = enriched.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", watermark)
    first = F.min_by(F.struct("id", "ts_ms", "lat", "lon"), F.struct("arrival_seq", "arrival_pos"))
    g = (e.groupBy("org", "city", F.window("event_time", window, slide).alias("w"))
         .agg(F.avg("temperature").alias("avg_temperature"), F.count(F.lit(1)).alias("n"),
              first.alias("_first")))
    return g.select("org", "city", F.unix_millis(F.col("w.start")).alias("window_start_ms"),
                    F.unix_millis(F.col("w.end")).alias("window_end_ms"), "avg_temperature", "n",
                    F.col("_first.id").alias("first_id"), F.col("_first.ts_ms").alias("first_ts_ms"),
                    F.col("_first.lat").alias("first_lat"), F.col("_first.lon").alias("first_lon"))


def drones_per_city_stream(enriched: DataFrame, watermark: str = "2 minutes",
                           window: str = S.WINDOW, slide: str = S.SLIDE) -> DataFrame:
    """H1 + D3 on a stream: distinct (org, window, city, id)."""
    e = enriched.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", watermark)
    g = (e.groupBy("org", F.window("event_time", window, slide).alias("w"), "city", "id").count())
    return g.select("org", F.unix_millis(F.col("w.start")).alias("window_start_ms"),
                    F.unix_millis(F.col("w.end")).alias("window_end_ms"), "city", "id")


def start_summaries(spark: SparkSession, enriched_path: str, schema, state_path: str, *,
                    max_files_per_trigger: int | None = None,
                    available_now: bool = True, prefix: str = "summary",
                    checkpoint_root: str | None = None, fan: int = 8) -> list[StreamingQuery]:
    """Stage 2: both summaries over the enriched stream (C6), each kept as a
    table of panes and a latest table (H4/A5, see ``state_tables``).  What a
    micro-batch adds is written as changes, so a row may come as late as it
    likes (H3): its pane, and with it every window that holds the row, is
    corrected.  Checkpoints go under ``checkpoint_root`` or else the session's
    shared checkpoint dir."""
    src = enriched_stream(spark, enriched_path, schema, max_files_per_trigger)
    src = src.observe("enriched", F.count(F.lit(1)).alias("rows"))
    tables = StateTables(state_path, fan=fan)
    queries = []
    for name, sink in ((f"{prefix}-by-org", tables.add_temperatures), (f"{prefix}-by-city", tables.add_drones)):
        w = (src.writeStream.queryName(name).foreachBatch(sink)
             .option("checkpointLocation", os.path.join(checkpoint_root, name) if checkpoint_root
                     else stream_checkpoint(spark, name)))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
        queries.append(w.start())
    return queries


def read_state(spark: SparkSession, state_path: str, table: str, orgs: DataFrame | None = None,
               ttl_ms: int | None = None) -> DataFrame:
    """A table kept by ``start_summaries`` (see ``StateTables.read``)."""
    return StateTables(state_path).read(spark, table, orgs, ttl_ms)

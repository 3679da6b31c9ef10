"""Named queries over the driver tables: ``QUERIES[name](spark, sf_dir)``.

Every query reads the test tables (through the fixture views) and runs the
library's operators on all rows.  Column names equal those of the DuckDB
oracle in :mod:`skyledger.plans.oracle_sql`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.operators import arrival as A
from skyledger.operators import cart as C
from skyledger.operators import lookups as G
from skyledger.operators import metrics as MX
from skyledger.operators import quantiles as QT
from skyledger.operators import summaries as S
from skyledger.operators.enrich import (country_filter, flatten_measurements, major_only,
                                        pack_measurements, with_org)
from skyledger.operators.ordering import sample_places, sorted_orgs
from skyledger.functions.geo import qualified_name, unit_sphere_point
from skyledger.functions.hashing import java_string_hash
from skyledger.plans import telemetry as T
from skyledger.session import long_rows_session, shared_table
from skyledger.sources import fixtures as FX
from skyledger.sources.catalog import list_catalog

Query = Callable[[SparkSession, str], DataFrame]


def _r6(c: str, alias: str | None = None):
    return F.round(F.col(c), 6).alias(alias or c)


# --- shared building blocks -------------------------------------------------

def _enriched(spark, d, orgs=None):
    return T.enrich(FX.measurements(spark, d), FX.places(spark, d), orgs=orgs)


def _summaries(spark, d, orgs=None):
    return T.summaries(_enriched(spark, d, orgs))


def _requests(spark, d):
    # 25 org buckets against 20 real orgs: some requested orgs are unknown.
    return T.org_requests(FX.places(spark, d), num_orgs=25)


def _epochs(spark, d):
    return C.cart_epochs(FX.cart_events(spark, d), FX.catalog(spark, d))


def _packets(spark, d):
    return pack_measurements(FX.measurements(spark, d))


# --- telemetry ----------------------------------------------------------------

def q_pack_measurements(spark, d):
    p = _packets(spark, d)
    return p.select("id", "timestamp", F.size("measurements").cast("long").alias("n_measurements"),
                    F.col("measurements")[0]["timestamp"].alias("first_ts_ms"),
                    F.element_at("measurements", -1)["timestamp"].alias("last_ts_ms"),
                    "arrival_seq")


def q_flatten_measurements(spark, d):
    f = flatten_measurements(_packets(spark, d))
    return f.select("id", "arrival_seq", F.col("arrival_pos").cast("long").alias("arrival_pos"),
                    "ts_ms", "temperature", "lat", "lon")


def q_assign_org(spark, d):
    m = FX.measurements(spark, d).select("id").distinct()
    return with_org(m).select("id", java_string_hash("id").alias("id_hash"), "org")


def q_qualified_places(spark, d):
    p = FX.places(spark, d)
    return p.select("place_id", qualified_name("name", "province", "country").alias("city"),
                    *[F.round(c, 9).alias(n) for c, n in
                      zip(unit_sphere_point("lat", "lon"), ("x", "y", "z"))])


def q_major_places_by_country(spark, d):
    p = country_filter(major_only(FX.places(spark, d), True), ["ASIA", "EUROPE", "AMERICA"])
    return p.select("place_id", "name", "country")


def q_nearest_place(spark, d):
    return _enriched(spark, d).select("arrival_seq", "id", "org", "place_id", "city")


def q_avg_city_temperature(spark, d):
    t = S.avg_city_temperature(_enriched(spark, d))
    return t.select("org", "city", "window_start_ms", "window_end_ms", _r6("avg_temperature"), "n",
                    "first_id", "first_ts_ms", "first_lat", "first_lon")


def q_drones_per_org(spark, d):
    return S.drones_per_org(_enriched(spark, d))


def q_drones_per_city(spark, d):
    return S.drones_per_city(_enriched(spark, d))


def q_drone_counts(spark, d):
    return S.drone_counts(S.drones_per_org(_enriched(spark, d)))


def q_city_drone_counts(spark, d):
    return S.city_drone_counts(S.drones_per_city(_enriched(spark, d)))


def q_latest_city_temperature(spark, d):
    t = _summaries(spark, d)["latest_city_temperature"]
    return t.select("org", "city", "window_start_ms", "window_end_ms", _r6("avg_temperature"), "n")


def q_latest_drone_summary(spark, d):
    return _summaries(spark, d)["latest_drone_summary"]


def q_num_cities(spark, d):
    return S.num_cities(_summaries(spark, d)["latest_city_temperature"])


def q_group_limit_guard(spark, d):
    return S.group_limit_guard(_enriched(spark, d))


def q_org_report(spark, d):
    s = _summaries(spark, d)
    r = S.org_report(s["latest_city_temperature"], s["latest_drone_summary"])
    return r.select("org", "city", _r6("temperature"), "city_drone_count", "drone_count")


def q_fan_out(spark, d):
    outs = S.fan_out(_enriched(spark, d))
    temps = outs["city_temperature"].select(
        F.lit("city_temperature").alias("summary"), "org", "city", "window_start_ms",
        F.round("avg_temperature", 6).alias("value"))
    drones = (outs["drones_per_city"].groupBy("org", "city", "window_start_ms")
              .agg(F.count(F.lit(1)).cast("double").alias("value"))
              .select(F.lit("drones_per_city").alias("summary"), "org", "city", "window_start_ms", "value"))
    return temps.unionByName(drones)


def q_get_cities(spark, d):
    req = _requests(spark, d).select("org").distinct()
    return G.get_cities(req, _summaries(spark, d, req)["latest_city_temperature"])


def q_get_cities_lists(spark, d):
    """G1 reply shape: one reply a request; requested orgs repeat, some are unknown."""
    spark = long_rows_session(spark, "cities")
    req = _requests(spark, d).select("org")
    return G.get_cities_lists(req, _summaries(spark, d, req)["latest_city_temperature"], separator="|")


def q_get_temperature(spark, d):
    req = _requests(spark, d)
    g = G.get_temperature(req, _summaries(spark, d, req)["latest_city_temperature"])
    return g.select("org", "city", _r6("cityTemperature"))


def q_get_drone_summary(spark, d):
    req = _requests(spark, d).select("org").distinct()
    return G.get_drone_summary(req, _summaries(spark, d, req)["latest_drone_summary"])


def q_sorted_orgs(spark, d):
    return sorted_orgs(with_org(FX.measurements(spark, d)))


def q_sample_places(spark, d):
    return sample_places(FX.places(spark, d), n=20).select("place_id", "name", "lat", "lon")


def q_report_intervals(spark, d):
    return MX.report_intervals(FX.measurements(spark, d)).select("id", "arrival_seq", "ts_ms", "interval_ms")


def q_send_stats(spark, d):
    s = MX.send_stats(_packets(spark, d))
    return s.select("id", "packets", "measurements_sent",
                    F.col("last_batch_size").cast("long").alias("last_batch_size"))


def q_stage_throughput(spark, d):
    return MX.stage_throughput(_packets(spark, d), _enriched(spark, d))


def q_send_errors(spark, d):
    """Errors by kind over the packet files, to which lines that do not
    parse and packets without an id are added (one for each device)."""
    from skyledger.sources.derived import derived_path, ensure_written
    from skyledger.sources.files import read_packets, split_packets

    def write(path):
        good = _packets(spark, d).select(F.to_json(F.struct("*")).alias("value"))
        ids = FX.measurements(spark, d).select("id").distinct()
        bad = ids.select(F.concat(F.lit('{"id": "'), "id", F.lit('", "measurements": [')).alias("value"))
        no_id = ids.select(F.lit('{"timestamp": 1, "measurements": []}').alias("value"))
        good.unionByName(bad).unionByName(no_id).write.mode("overwrite").text(path)

    path = ensure_written(spark, derived_path(spark, d, "packets-with-errors"), write)
    return MX.send_errors(split_packets(read_packets(spark, path, with_arrival=True))[1])


# --- carts ----------------------------------------------------------------------

def q_validate_products(spark, d):
    v = C.validate_products(FX.cart_events(spark, d), FX.catalog(spark, d))
    return v.select("user_id", "seq", F.col("pos").cast("long").alias("pos"), "product_id")


def q_invalid_product_ids(spark, d):
    return C.invalid_product_ids(FX.cart_events(spark, d), FX.catalog(spark, d))


def q_distinct_ids(spark, d):
    ev = FX.cart_events(spark, d).where(F.col("action") == "add")
    s = C.distinct_ids(ev.withColumnRenamed("product_ids", "ids").withColumn("product_ids", F.col("ids")))
    return s.select("user_id", "seq", F.size("product_ids").alias("n_distinct"),
                    F.size("ids").alias("n_ids"))


def q_cart_epochs(spark, d):
    return _epochs(spark, d).select("user_id", "seq", "action", "epoch", "reset",
                                    F.col("n").cast("long").alias("n"))


def q_commit_outcomes(spark, d):
    return C.commit_outcomes(_epochs(spark, d))


def q_cart_contents(spark, d):
    c = C.cart_contents(_epochs(spark, d))
    return c.select("user_id", "cart_ts", "product_id", F.col("qty").cast("long").alias("qty"))


def q_committed_carts(spark, d):
    c = C.committed_carts(_epochs(spark, d))
    return c.select("user_id", "commit_ts", "status", "product_id", F.col("qty").cast("long").alias("qty"))


def q_merge_carts(spark, d):
    ep = _epochs(spark, d)
    return C.merge_carts(C.cart_contents(ep), C.committed_carts(ep))


def q_cart_kpis(spark, d):
    return C.cart_kpis(_epochs(spark, d))


def _refused_epochs(spark, d):
    """Every seventh command's authentication fails."""
    return C.cart_epochs(FX.cart_events(spark, d, auth="seq7"), FX.catalog(spark, d))


def q_refused_commit_outcomes(spark, d):
    return C.commit_outcomes(_refused_epochs(spark, d))


def q_refused_cart_contents(spark, d):
    return C.cart_contents(_refused_epochs(spark, d)).withColumn("qty", F.col("qty").cast("long"))


def q_refused_committed_carts(spark, d):
    return C.committed_carts(_refused_epochs(spark, d)).withColumn("qty", F.col("qty").cast("long"))


def q_refused_cart_kpis(spark, d):
    return C.cart_kpis(_refused_epochs(spark, d))


def q_cart_reconcile(spark, d):
    """Expected = every id the client added in the open epoch (valid or not);
    actual = the server's open cart."""
    ep = _epochs(spark, d)
    actual = C.cart_contents(ep)
    open_epoch = (ep.groupBy("user_id").agg(F.max_by(F.struct("epoch", "reset"), "seq").alias("l"))
                  .select("user_id", (F.col("l.epoch") + F.col("l.reset").cast("long")).alias("epoch")))
    expected = (ep.where(F.col("action") == "add").join(open_epoch, ["user_id", "epoch"])
                .select("user_id", F.explode("product_ids").alias("product_id"))
                .groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("qty")))
    return C.cart_reconcile(expected, actual)


def q_get_cart(spark, d):
    req = FX.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"))
    g = G.get_cart(req, C.cart_contents(_epochs(spark, d)))
    return g.select("user_id", "status", "cart_ts", "product_id", F.col("qty").cast("long").alias("qty"))


def q_catalog_listing(spark, d):
    return list_catalog(FX.catalog(spark, d))


def _session_log(spark, d):
    return MX.session_log(_epochs(spark, d))


def q_session_outcomes(spark, d):
    return MX.session_outcomes(_session_log(spark, d))


def q_latency_stats(spark, d):
    return MX.latency_stats(_session_log(spark, d)).select("n", "min_ms", "max_ms", _r6("avg_ms"))


def q_session_outcomes_all_stages(spark, d):
    """D13 with the cart check and with refused authentication: every kind of
    outcome that the command log holds."""
    return MX.session_outcomes(MX.session_log(_refused_epochs(spark, d), verify=True))


def _latencies(spark, d):
    """D14's kinds: session length; commit: from the version committed to the
    commit; send: from a packet's first sample to its sending."""
    sessions = _session_log(spark, d).select(F.lit("session").alias("kind"), (F.col("end_ms") - F.col("start_ms")).alias("ms"))
    commits = (FX.cart_events(spark, d).where(F.col("action") == "commit")
               .select(F.lit("commit").alias("kind"), (F.col("ts_ms") - F.col("commit_ts")).alias("ms")))
    sends = _packets(spark, d).select(F.lit("send").alias("kind"),
                                      (F.col("timestamp") - F.col("measurements")[0]["timestamp"]).alias("ms"))
    return sessions.unionByName(commits).unionByName(sends)


def q_latency_quantiles(spark, d):
    return QT.exact_quantiles(_latencies(spark, d), ["kind"], "ms", [0.5, 0.95, 0.99])


def q_latency_sketch_bounds(spark, d):
    """The same quantiles' bounds from mergeable histograms, kept for each part
    of the log (here: ms modulo 7) and added up."""
    parts = _latencies(spark, d).withColumn("part", F.col("ms") % 7)
    kept = QT.histogram(parts, ["kind", "part"], "ms")
    b = QT.bounds(QT.merged(kept, ["kind"]), ["kind"], [0.5, 0.95, 0.99])
    return b.select("kind", "q", "low", "high")


def q_group_admission(spark, d):
    """D8 as admission, with a limit that refuses groups: 20 (org, city) groups a worker."""
    enriched = shared_table(_enriched(spark, d).select("arrival_seq", "org", "city"), "enriched")
    kept, refused = S.admitted_rows(enriched, ["org", "city"], 20)
    return (kept.select("arrival_seq", "org", "city", F.lit(True).alias("admitted"))
            .unionByName(refused.select("arrival_seq", "org", "city", F.lit(False).alias("admitted"))))


def q_merge_carts_of_left(spark, d):
    """D10 with the left cart's timestamp and status."""
    ep = _epochs(spark, d)
    left = C.cart_contents(ep).withColumn("status", F.lit("Open"))
    return C.merge_carts(left, C.committed_carts(ep), scalars=("cart_ts", "status"))


def q_active_sessions(spark, d):
    return MX.active_sessions(_session_log(spark, d))


# --- file sources and replies (A1, A2, A6) --------------------------------------

def q_read_places_tsv(spark, d):
    """A1: the place table written as a 19-column TSV, read back."""
    from skyledger.sources.derived import derived_path, ensure_written
    from skyledger.sources.files import read_places, write_places_tsv
    path = ensure_written(spark, derived_path(spark, d, "places-tsv"),
                          lambda p: write_places_tsv(FX.places(spark, d), p))
    return read_places(spark, path).select("place_id", "name", "province", "country",
                                           "feature_class", "lat", "lon")


def q_read_packets_json(spark, d):
    """A2 + B1: measurements packed per device and 10 s (B9), written as JSON
    lines, read back, rejects split off, flattened."""
    from skyledger.sources.derived import derived_path, ensure_written
    from skyledger.sources.files import read_packets, split_packets
    path = ensure_written(spark, derived_path(spark, d, "packets-json"),
                          lambda p: _packets(spark, d).write.mode("overwrite").json(p))
    valid, _rejected = split_packets(read_packets(spark, path, with_arrival=True))
    f = flatten_measurements(valid)
    return f.select("id", "arrival_seq", F.col("arrival_pos").cast("long").alias("arrival_pos"),
                    "ts_ms", "temperature", "lat", "lon")


def q_temperature_replies_json(spark, d):
    """The temperature lookup replies as JSON objects (null kept)."""
    from skyledger.sources.sinks import to_json_rows
    req = _requests(spark, d)
    g = G.get_temperature(req, _summaries(spark, d, req)["latest_city_temperature"])
    return to_json_rows(g.withColumn("cityTemperature", _r6("cityTemperature")), ["org", "city", "cityTemperature"])


def q_commit_outcomes_from_files(spark, d):
    """A3 + E2: the cart commands written as parquet files, read back with
    the reader, folded."""
    from skyledger.sources.derived import derived_path, ensure_written
    from skyledger.sources.files import read_cart_events
    path = ensure_written(spark, derived_path(spark, d, "cart-events"),
                          lambda p: FX.cart_events(spark, d).write.mode("overwrite").parquet(p))
    return C.commit_outcomes(C.cart_epochs(read_cart_events(spark, path), FX.catalog(spark, d)))


def _state_run(spark, d, run):
    """The packets (JSON files) through the enrichment stream and the summary
    streams, in several micro-batches, to the state tables under ``run``.  Every
    packet file spans the whole time, so from the second micro-batch on most rows
    come hours late.  Streaming micro-batches run without AQE, so for this run
    the shuffle partitions are sized to the default parallelism and restored."""
    import os
    from skyledger.sources.derived import derived_path, ensure_written
    from skyledger.streaming import telemetry as ST
    packets = ensure_written(spark, derived_path(spark, d, "packets-json"),
                             lambda p: _packets(spark, d).write.mode("overwrite").json(p))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions",
                   str(min(int(before), max(1, spark.sparkContext.defaultParallelism))))
    try:
        name = os.path.basename(run)
        # about four micro-batches per stage, whatever the number of files
        files = len(spark.read.text(packets).inputFiles())
        ST.start_enrichment(spark, packets, FX.places(spark, d), os.path.join(run, "enriched"),
                            os.path.join(run, "rejects"), name=f"enrich-{name}",
                            max_files_per_trigger=max(1, -(-files // 4)),
                            checkpoint=os.path.join(run, "ck-enrich")).awaitTermination()
        enriched = spark.read.parquet(os.path.join(run, "enriched"))
        per_trigger = max(1, -(-len(enriched.inputFiles()) // 4))
        for q in ST.start_summaries(spark, os.path.join(run, "enriched"), enriched.drop("batch_id").schema,
                                    os.path.join(run, "state"), max_files_per_trigger=per_trigger, fan=3,
                                    prefix=f"summary-{name}", checkpoint_root=os.path.join(run, "ck-summary")):
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return os.path.join(run, "state")


def q_stream_pack_measurements(spark, d):
    """B9 on a stream: the measurements as four files in order of time, one a
    micro-batch, stopped and started again from its checkpoint after the second;
    a last sample of another device, a day later, lets every interval end."""
    import os
    import uuid
    from skyledger.session import checkpoint_dir
    run = os.path.join(checkpoint_dir(spark), "stream-runs", uuid.uuid4().hex)
    m = FX.measurements(spark, d)
    low, high = m.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    part = F.least(F.floor((F.col("ts_ms") - low) * 4 / (high - low + 1)), F.lit(3))
    last = m.limit(1).select("arrival_seq", F.lit("end of log").alias("id"), F.lit(high + 86_400_000).alias("ts_ms"),
                             "temperature", "lat", "lon")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), max(1, spark.sparkContext.defaultParallelism))))
    try:
        for i in range(5):
            rows = last if i == 4 else m.where(part == i)
            rows.write.parquet(os.path.join(run, "in", f"b{i}"))
            if i in (1, 4):
                stream = spark.readStream.schema(m.schema).parquet(os.path.join(run, "in", "*"))
                (pack_measurements(stream, watermark="0 seconds").writeStream.format("parquet")
                 .option("path", os.path.join(run, "out")).option("checkpointLocation", os.path.join(run, "ck"))
                 .trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    p = spark.read.parquet(os.path.join(run, "out"))
    return p.select("id", "timestamp", F.size("measurements").cast("long").alias("n_measurements"),
                    F.col("measurements")[0]["timestamp"].alias("first_ts_ms"),
                    F.element_at("measurements", -1)["timestamp"].alias("last_ts_ms"), "arrival_seq")


def _new_state(spark, d):
    import os
    import uuid
    from skyledger.session import checkpoint_dir
    return _state_run(spark, d, os.path.join(checkpoint_dir(spark), "stream-runs", uuid.uuid4().hex))


def _kept_state(spark, d):
    """The state tables of an earlier run of the streams over these tables; made
    once under the shared folder, then only read."""
    import os
    from skyledger.sources.derived import derived_path, ensure_written
    at = derived_path(spark, d, "kept-state")

    def write(path):
        state = _new_state(spark, d)
        spark.createDataFrame([(state,)], "state string").write.mode("overwrite").parquet(path)

    ensure_written(spark, at, write)
    return spark.read.parquet(at).first()["state"]


def q_stream_latest_city_temperature(spark, d):
    """H1 + H3 + H4 + A5 + C6 end to end: the latest table that the streams keep,
    each call from a run of its own."""
    from skyledger.streaming import telemetry as ST
    t = ST.read_state(spark, _new_state(spark, d), "latest_city_temperature")
    return t.select("org", "city", "window_start_ms", "window_end_ms", _r6("avg_temperature"), "n")


def q_kept_city_temperature_windows(spark, d):
    """H1 + H3 + D1: every window of the kept panes, late rows included."""
    from skyledger.streaming import telemetry as ST
    t = ST.read_state(spark, _kept_state(spark, d), "city_temperature_windows")
    return t.select("org", "city", "window_start_ms", "window_end_ms", _r6("avg_temperature"), "n", "first_id", "first_ts_ms")


def q_kept_drones_per_city(spark, d):
    """H1 + H3 + D3 from the kept panes."""
    from skyledger.streaming import telemetry as ST
    return ST.read_state(spark, _kept_state(spark, d), "drones_per_city_windows")


def q_kept_get_temperature(spark, d):
    """G2 from kept state: no raw event is read, and only the requested orgs' folders."""
    from skyledger.streaming import telemetry as ST
    req = _requests(spark, d)
    g = G.get_temperature(req, ST.read_state(spark, _kept_state(spark, d), "latest_city_temperature", req))
    return g.select("org", "city", _r6("cityTemperature"))


def q_kept_get_cities(spark, d):
    """G1 from kept state."""
    from skyledger.streaming import telemetry as ST
    req = _requests(spark, d).select("org").distinct()
    return G.get_cities(req, ST.read_state(spark, _kept_state(spark, d), "latest_city_temperature", req))


def q_kept_get_drone_summary(spark, d):
    """G3 from kept state."""
    from skyledger.streaming import telemetry as ST
    req = _requests(spark, d).select("org").distinct()
    return G.get_drone_summary(req, ST.read_state(spark, _kept_state(spark, d), "latest_drone_summary", req))


def q_drone_summary_replies(spark, d):
    """G3 reply shape: the ids of an org and of each of its cities as sorted lists."""
    sets = S.drone_summary_sets(_summaries(spark, d)["latest_drone_summary"])
    cities = F.array_sort(F.transform(F.map_entries("dronesPerCity"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))))
    return sets.select("org", F.array_join("droneIds", ",").alias("drone_ids"), F.array_join(cities, "|").alias("drones_per_city"))


# --- order-dependent operators (H2; H5 batch twin) -------------------------------------

def _fold(spark, d, auth="ok"):
    from skyledger.streaming.cart_state import cart_fold
    return cart_fold(FX.cart_events(spark, d, auth=auth), FX.catalog(spark, d))


def q_cart_fold_outcomes(spark, d):
    f = _fold(spark, d)
    return (f.where((F.col("kind") == "outcome") & (F.col("action") == "commit"))
            .select("user_id", "seq", "ts_ms", "outcome"))


def q_cart_fold_contents(spark, d):
    f = _fold(spark, d).where(F.col("kind") == "cart")
    return f.select("user_id", F.col("version").alias("cart_ts"), "product_id", "qty")


def q_cart_fold_committed(spark, d):
    """Committed carts from the fold; two commits under one timestamp: the
    later one wins."""
    from pyspark.sql import Window as W
    f = (_fold(spark, d).where(F.col("kind") == "committed")
         .withColumnRenamed("version", "commit_ts"))
    last = F.max("seq").over(W.partitionBy("user_id", "commit_ts"))
    return (f.withColumn("_last", last).where(F.col("seq") == F.col("_last"))
            .select("user_id", "commit_ts", F.lit("Committed").alias("status"), "product_id", "qty"))


def q_cart_fold_refused_auth_kpis(spark, d):
    """D12 over the fold when every seventh command's authentication fails."""
    f = _fold(spark, d, auth="seq7").where(F.col("kind") == "outcome")
    return C.cart_kpis(f)


def q_arrival_window_city_temperature(spark, d):
    t = A.arrival_window_temperature(_enriched(spark, d))
    return t.withColumn("avg_temperature", _r6("avg_temperature"))


def q_arrival_window_drones(spark, d):
    return A.arrival_window_drones(_enriched(spark, d))


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}

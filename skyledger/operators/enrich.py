"""B1, B2 (as a column), B7, B8, B9: packet flattening and place filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from skyledger.functions.orgs import DEFAULT_NUM_ORGS, assign_org


def flatten_measurements(packets: DataFrame) -> DataFrame:
    """B1: one row per measurement, carrying the packet id.

    The packet timestamp is dropped; a packet with an empty list yields no
    rows (``explode``, not ``explode_outer``).  If the packets carry an
    ``arrival_seq`` column it is kept and the list position is added as
    ``arrival_pos``, so "first arrived" stays defined.
    """
    keep = ["arrival_seq"] if "arrival_seq" in packets.columns else []
    flat = packets.select("id", *keep, F.posexplode("measurements").alias("arrival_pos", "m"))
    return flat.select(
        "id", *keep, *(["arrival_pos"] if keep else []),
        F.col("m.timestamp").alias("ts_ms"),
        F.col("m.temperature").cast("double").alias("temperature"),
        F.col("m.location.lat").alias("lat"),
        F.col("m.location.lon").alias("lon"))


def with_org(df: DataFrame, num_orgs: int = DEFAULT_NUM_ORGS, id_col: str = "id") -> DataFrame:
    """B2 applied to a DataFrame: adds ``org``."""
    return df.withColumn("org", assign_org(id_col, num_orgs))


def split_locations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable location, and the rejects: a missing, NaN or
    out-of-range latitude or longitude has no nearest place."""
    def within(column, limit):
        return F.coalesce(F.abs(column) <= limit, F.lit(False)) & ~F.isnan(column)
    usable = within("lat", 90) & within("lon", 180)
    return df.where(usable), df.where(~usable)


def major_only(places: DataFrame, enabled: bool = False) -> DataFrame:
    """Keep feature class ``P`` when enabled; otherwise unchanged."""
    return places.where(F.col("feature_class") == "P") if enabled else places


def country_filter(places: DataFrame, codes: Iterable[str] | None) -> DataFrame:
    """Keep the listed countries; an empty or missing list keeps all."""
    codes = list(codes or [])
    return places.where(F.col("country").isin(codes)) if codes else places


def pack_measurements(measurements: DataFrame, send_interval: str = "10 seconds",
                      watermark: str | None = None) -> DataFrame:
    """The inverse of B1.  Buffer each device's samples and emit one
    packet per send interval, measurements in time order.

    The packet ``timestamp`` is the end of the send interval and
    ``arrival_seq`` the smallest member arrival (when present).  A group is
    one device's samples in one interval, so its size is bounded by the
    sampling rate, not by the data size.

    On a stream give a ``watermark`` and write in append mode: the samples of an
    interval are state until event time (of any device) has passed its end by
    the watermark; then the packet leaves, without a further sample of its
    device, and its state goes.  Samples that come later than that are dropped
    by the stream.
    """
    measurements = measurements.withColumn("_at", F.timestamp_millis("ts_ms"))
    if watermark is not None:
        measurements = measurements.withWatermark("_at", watermark)
    ev = F.col("_at")
    m = F.struct(
        F.col("ts_ms").alias("timestamp"),
        F.col("temperature").cast("float").alias("temperature"),
        F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon")).alias("location"))
    aggs = [F.sort_array(F.collect_list(m)).alias("measurements")]
    if "arrival_seq" in measurements.columns:
        aggs.append(F.min("arrival_seq").alias("arrival_seq"))
    g = measurements.groupBy("id", F.window(ev, send_interval).alias("w")).agg(*aggs)
    cols = ["id", F.unix_millis(F.col("w.end")).alias("timestamp"), "measurements"]
    if "arrival_seq" in measurements.columns:
        cols.append("arrival_seq")
    return g.select(*cols)

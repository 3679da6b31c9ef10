"""Sliding-window summaries of enriched measurements.

Windows are event-time windows of ``window`` length every ``slide``
(defaults 60 s / 10 s), [start, end), as Spark's ``window``, made from panes
(:mod:`skyledger.operators.panes`).  The reference's own slide-on-arrival rule
is a different function: see :mod:`skyledger.operators.arrival`.

Sets (drone ids per org, per city) are kept as long rows ``(keys..., id)``
rather than collected arrays, so no group is gathered into one row; the
``*_sets`` helpers build the reply shapes for bounded reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyledger.functions.hashing import java_string_hash
from skyledger.operators import panes as P
from skyledger.operators.quantiles import admission
from skyledger.session import shared_table

WINDOW = "60 seconds"
SLIDE = "10 seconds"

# Group limits of the reference's stream groupBy (fixed values).
MAX_ORG_CITY_GROUPS = 50000
MAX_ORG_GROUPS = 10000
# Summary workers that the orgs are dealt to (fixed value).
WORKERS = 9


def avg_city_temperature(enriched: DataFrame, window: str = WINDOW, slide: str = SLIDE,
                         order_cols: tuple[str, ...] = ("arrival_seq",)) -> DataFrame:
    """D1 (+E3): mean temperature per (org, city, window); id, timestamp and
    location come from the first arrived row of the window.  Averages use
    double precision.  Rows without a time are in no window."""
    s = P.Sliding.of(window, slide)
    order = [c for c in order_cols if c in enriched.columns] or ["ts_ms"]
    return P.windows_of_panes(P.city_panes(enriched.where(F.col("ts_ms").isNotNull()), s, order), s)


def _ids(enriched: DataFrame, keys: list[str], window: str, slide: str) -> DataFrame:
    s = P.Sliding.of(window, slide)
    panes = P.id_panes(enriched.where(F.col("ts_ms").isNotNull()), s, keys)
    return P.id_windows(panes, s, keys).select("org", *s.columns("k"), *keys[1:], "id")


def drones_per_org(enriched: DataFrame, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """Distinct drone ids per org and window, one row per (org, window, id)."""
    return _ids(enriched, ["org"], window, slide)


def drones_per_city(enriched: DataFrame, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """D3: distinct drone ids per (org, window, city), one row per id."""
    return _ids(enriched, ["org", "city"], window, slide)


def newest_city_temperature(enriched: DataFrame, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """D4 straight from the measurements: equals ``latest_city_temperature`` of
    D1, without making its windows."""
    s = P.Sliding.of(window, slide)
    return P.latest_city_state(P.latest_city_rows(enriched.where(F.col("ts_ms").isNotNull()), s), s)


def newest_drone_summary(enriched: DataFrame, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """D5 straight from the measurements: equals ``latest_drone_summary`` of D3,
    without making its windows."""
    s = P.Sliding.of(window, slide)
    return P.latest_id_state(P.latest_id_rows(enriched.where(F.col("ts_ms").isNotNull()), s), s)


def drone_counts(per_org: DataFrame) -> DataFrame:
    """D7 / D2 size: number of distinct drones per org and window."""
    return (per_org.groupBy("org", "window_start_ms", "window_end_ms")
            .agg(F.count(F.lit(1)).alias("drone_count")))


def city_drone_counts(per_city: DataFrame) -> DataFrame:
    """Number of distinct drones per (org, window, city)."""
    return (per_city.groupBy("org", "window_start_ms", "window_end_ms", "city")
            .agg(F.count(F.lit(1)).alias("city_drone_count")))


def latest_city_temperature(city_temps: DataFrame) -> DataFrame:
    """Newest average per (org, city); cities missing from later
    windows keep their last value."""
    latest = F.max_by(F.struct("window_start_ms", "window_end_ms", "avg_temperature", "n"),
                      F.col("window_end_ms"))
    return (city_temps.groupBy("org", "city").agg(latest.alias("_l"))
            .select("org", "city", "_l.*"))


def latest_drone_summary(per_city: DataFrame) -> DataFrame:
    """The newest window's summary per org replaces the previous one as a
    whole, so cities absent from that window vanish.  Rows: (org,
    window_start_ms, window_end_ms, city, id).

    The newest window per org is found by a partial aggregate (one row per
    org) and joined back; the join side holds one row per org.
    """
    newest = (per_city.groupBy("org").agg(F.max("window_end_ms").alias("_newest")))
    return (per_city.join(newest, "org")
            .where(F.col("window_end_ms") == F.col("_newest")).drop("_newest"))


def num_cities(latest_temps: DataFrame) -> DataFrame:
    """Cities known per org (from D4)."""
    return latest_temps.groupBy("org").agg(F.count_distinct("city").alias("num_cities"))


def group_limit_guard(enriched: DataFrame, max_org_city: int = MAX_ORG_CITY_GROUPS,
                      max_org: int = MAX_ORG_GROUPS, fail: bool = False) -> DataFrame:
    """Number of (org, city) and org groups against the reference's
    limits; ``fail`` raises when a limit is exceeded.  One row."""
    pairs = enriched.select("org", "city").distinct()
    row = pairs.agg(F.count(F.lit(1)).alias("org_city_groups"),
                    F.count_distinct("org").alias("org_groups"))
    ok = (F.col("org_city_groups") <= max_org_city) & (F.col("org_groups") <= max_org)
    row = row.withColumn("within_limits", ok)
    if fail:
        row = row.withColumn("within_limits", F.when(ok, ok).otherwise(
            F.raise_error(F.lit("group limit exceeded"))))
    return row


def admitted_rows(enriched: DataFrame, keys: list[str], limit: int, workers: int = WORKERS,
                  order_cols: tuple[str, ...] = ("arrival_seq", "arrival_pos")) -> tuple[DataFrame, DataFrame]:
    """D8 as admission: each worker (``abs(hash(org)) % workers``) takes the first
    ``limit`` groups that reach it, in order of arrival; rows of further groups
    are refused.  Returns (kept rows, refused rows); no worker's groups are
    gathered (see ``quantiles.admission``)."""
    order = [c for c in order_cols if c in enriched.columns]
    first = F.min(F.struct(*order)).alias("_at")
    groups = enriched.groupBy(*keys).agg(first).select(
        *keys, (F.abs(java_string_hash("org")) % workers).alias("_worker"), F.col(f"_at.{order[0]}").alias("_first"),
        (F.col(f"_at.{order[1]}") if len(order) > 1 else F.lit(0)).alias("_tie"))
    groups = shared_table(groups, "groups")   # read by each step of the selection
    admitted = admission(groups, "_worker", "_first", "_tie", limit).where("admitted").select(*keys)
    return enriched.join(admitted, keys, "left_semi"), enriched.join(admitted, keys, "left_anti")


def org_report(latest_temps: DataFrame, latest_summary: DataFrame) -> DataFrame:
    """C4: per org, its known cities with their latest temperature, plus the
    drone counts from the latest drone summary (one query, not one lookup
    per city)."""
    city_counts = (latest_summary.groupBy("org", "city")
                   .agg(F.count(F.lit(1)).alias("city_drone_count")))
    org_counts = (latest_summary.groupBy("org")
                  .agg(F.count_distinct("id").alias("drone_count")))
    return (latest_temps.select("org", "city", F.col("avg_temperature").alias("temperature"))
            .join(city_counts, ["org", "city"], "left")
            .join(org_counts, "org", "left"))


def fan_out(enriched: DataFrame, window: str = WINDOW, slide: str = SLIDE) -> dict[str, DataFrame]:
    """Every enriched row feeds both summaries.  The two results share
    one input plan; within one query Spark reuses the common exchanges."""
    return {
        "city_temperature": avg_city_temperature(enriched, window, slide),
        "drones_per_city": drones_per_city(enriched, window, slide),
    }


def drone_summary_sets(latest_summary: DataFrame) -> DataFrame:
    """Reply shape of ``DroneSummary`` for bounded reads: org, droneIds
    (sorted array), dronesPerCity (map city -> sorted array)."""
    per_city = (latest_summary.groupBy("org", "city")
                .agg(F.sort_array(F.collect_set("id")).alias("ids")))
    return (per_city.groupBy("org")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("droneIds"),
                 F.map_from_entries(F.collect_list(F.struct("city", "ids"))).alias("dronesPerCity")))

"""Telemetry job: flatten -> org -> nearest place -> summaries -> lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyledger.functions.geo import qualified_name
from skyledger.functions.orgs import DEFAULT_NUM_ORGS
from skyledger.operators import summaries as S
from skyledger.operators.enrich import split_locations, with_org
from skyledger.operators.nearest import nearest_place


def enrich(measurements: DataFrame, places: DataFrame, num_orgs: int = DEFAULT_NUM_ORGS,
           num_places: int | None = None, depth: int | None = None,
           orgs: DataFrame | None = None) -> DataFrame:
    """Measurements -> org (B2) -> nearest place (C1) -> qualified city.
    Measurements without a usable location are ``split_locations``' rejects.
    ``orgs`` (a column ``org``) keeps those orgs' measurements only: the org is
    known before C1, so others never meet a place."""
    m = with_org(split_locations(measurements)[0], num_orgs)
    if orgs is not None:
        m = m.join(orgs.select("org").distinct(), "org", "left_semi")
    m = nearest_place(m, places, num_places=num_places, depth=depth)
    return m.withColumn("city", qualified_name("name", "province", "country"))


def summaries(enriched: DataFrame, window: str = S.WINDOW, slide: str = S.SLIDE,
              order_cols: tuple[str, ...] = ("arrival_seq",)) -> dict[str, DataFrame]:
    """Both summaries and their latest-state tables from one enriched input."""
    return {
        "city_temperature": S.avg_city_temperature(enriched, window, slide, order_cols),
        "drones_per_city": S.drones_per_city(enriched, window, slide),
        "latest_city_temperature": S.newest_city_temperature(enriched, window, slide),
        "latest_drone_summary": S.newest_drone_summary(enriched, window, slide),
    }


def org_requests(places: DataFrame, num_orgs: int = DEFAULT_NUM_ORGS) -> DataFrame:
    """Request keys derived from the place table: each place's name mapped
    to an org by the same rule as devices, plus the qualified city name.
    Some pairs are known to the summaries, some are not."""
    return (places.select(F.col("name").alias("id"), "name", "province", "country")
            .transform(lambda d: with_org(d, num_orgs))
            .select("org", qualified_name("name", "province", "country").alias("city")))

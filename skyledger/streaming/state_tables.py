"""A5 / H4: the tables that the summary streams keep.

Each is a :class:`~skyledger.streaming.change_log.ChangeLog`; what a
micro-batch adds is computed from its rows alone:

* ``city_panes``: sums, counts and first row per (org, city, pane), from which
  the windows of D1 are made when read;
* ``latest_city_temperature`` (D4): the sums of each (org, city)'s newest slide;
* ``id_panes``: distinct (org, city, id, pane), from which the windows of D3
  are made when read;
* ``latest_drone_summary`` (D5): the (city, id) of each org's newest slide.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.operators import panes as P
from skyledger.operators import summaries as S
from skyledger.streaming.change_log import ChangeLog


def hadoop_path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


SUMS = "total double, n_temperature long, n long"
FIRST = "_first struct<at: struct<arrival_seq: long, arrival_pos: int>, id: string, ts_ms: long, lat: double, lon: double>"


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("total", "n_temperature", "n")])


def _newest_slides(rows: DataFrame) -> DataFrame:
    return P.newest_city_rows(_added(rows, ["org", "city", "k"]))


def _newest_ids(rows: DataFrame) -> DataFrame:
    return P.newest_id_rows(rows.distinct()).select("org", "k", "city", "id")


@dataclass(frozen=True)
class StateTables:
    """The four tables under one folder, for one window length and slide."""

    path: str
    sliding: P.Sliding = P.Sliding.of(S.WINDOW, S.SLIDE)
    fan: int = 8

    def _log(self, name: str, schema: str, merge) -> ChangeLog:
        return ChangeLog(os.path.join(self.path, name), schema, merge, self.fan)

    @property
    def city_panes(self) -> ChangeLog:
        return self._log("city_panes", f"org string, city string, pane long, {SUMS}, {FIRST}",
                         lambda rows: P.merged_panes(rows, ["org", "city", "pane"]))

    @property
    def city_latest(self) -> ChangeLog:
        return self._log("latest_city_temperature", f"org string, city string, k long, {SUMS}", _newest_slides)

    @property
    def id_panes(self) -> ChangeLog:
        return self._log("id_panes", "org string, city string, id string, pane long", lambda rows: rows.distinct())

    @property
    def id_latest(self) -> ChangeLog:
        return self._log("latest_drone_summary", "org string, k long, city string, id string", _newest_ids)

    def add_temperatures(self, batch: DataFrame, batch_id: int) -> None:
        """The sink of the temperature stream."""
        rows = batch.where(F.col("ts_ms").isNotNull())
        at = rows.withColumns({"arrival_seq": F.col("arrival_seq").cast("long"), "arrival_pos": F.col("arrival_pos").cast("int")})
        self.city_panes.add(P.city_panes(at, self.sliding, ["arrival_seq", "arrival_pos"]), batch_id)
        self.city_latest.add(P.latest_city_rows(rows, self.sliding), batch_id)

    def add_drones(self, batch: DataFrame, batch_id: int) -> None:
        """The sink of the drone stream."""
        rows = batch.where(F.col("ts_ms").isNotNull())
        self.id_panes.add(P.id_panes(rows, self.sliding, ["org", "city"]), batch_id)
        self.id_latest.add(P.latest_id_rows(rows, self.sliding).select("org", "k", "city", "id"), batch_id)

    def read(self, spark: SparkSession, table: str, orgs: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
        """``city_temperature_windows`` (D1), ``drones_per_city_windows`` (D3),
        ``latest_city_temperature`` (D4) or ``latest_drone_summary`` (D5), of all
        orgs or of the requested ones.  D4 keeps stale cities for good; with
        ``ttl_ms`` those whose newest window ended more than that before the
        newest window read are left out."""
        s = self.sliding
        if table == "city_temperature_windows":
            return P.windows_of_panes(self.city_panes.read(spark, orgs), s)
        if table == "drones_per_city_windows":
            w = P.id_windows(self.id_panes.read(spark, orgs), s, ["org", "city"])
            return w.select("org", *s.columns("k"), "city", "id")
        if table == "latest_drone_summary":
            return P.latest_id_state(self.id_latest.read(spark, orgs), s)
        if table != "latest_city_temperature":
            raise ValueError(f"no such table: {table}")
        rows = P.latest_city_state(self.city_latest.read(spark, orgs), s)
        if ttl_ms is None:
            return rows
        newest = rows.agg(F.max("window_end_ms")).first()[0]   # one number
        return rows if newest is None else rows.where(F.col("window_end_ms") >= F.lit(int(newest) - int(ttl_ms)))

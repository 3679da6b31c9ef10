"""Sliding windows by panes.

A pane is ``gcd(window, slide)`` long, so every window [k*slide, k*slide+window)
is a whole number of panes.  Rows are aggregated to panes once; windows are
made from panes after the shuffle, so what is shuffled does not depend on how
many windows a row lies in:

* sums, counts and first rows per (keys, pane), dealt by the keys, are rolled
  up to windows in place;
* distinct ids: each (keys, id, pane) adds only the windows behind those of
  the id's pane before, so no (window, id) is made twice;
* the newest window of a key holds only rows of the key's newest slide, so
  latest states need no windows at all.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_MS = {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def duration_ms(text: str) -> int:
    """``"60 seconds"`` -> 60000; terms add up (``"1 minute 30 seconds"``)."""
    terms = re.findall(r"(\d+)\s*([a-z]+?)s?\b", text.lower())
    if not terms or re.sub(r"(\d+)\s*([a-z]+)", "", text.lower()).strip() or any(u not in _MS for _, u in terms):
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * _MS[u] for n, u in terms)


@dataclass(frozen=True)
class Sliding:
    """Windows of ``window`` ms every ``slide`` ms, from the epoch on."""

    window: int
    slide: int

    @classmethod
    def of(cls, window: str, slide: str) -> "Sliding":
        return cls(duration_ms(window), duration_ms(slide))

    @property
    def pane_ms(self) -> int:
        return math.gcd(self.window, self.slide)

    def pane(self, ts_ms: Column) -> Column:
        return F.floor(ts_ms / self.pane_ms).cast("long") if self.pane_ms > 1 else ts_ms

    def first_window(self, pane: Column) -> Column:
        return (F.floor((pane * self.pane_ms - self.window) / self.slide) + 1).cast("long")

    def last_window(self, pane: Column) -> Column:
        return F.floor(pane * self.pane_ms / self.slide).cast("long")

    def columns(self, k: str) -> list[Column]:
        return [(F.col(k) * self.slide).alias("window_start_ms"), (F.col(k) * self.slide + self.window).alias("window_end_ms")]


def city_panes(enriched: DataFrame, s: Sliding, order: list[str]) -> DataFrame:
    """Per (org, city, pane): ``total`` and ``n_temperature`` of the temperatures,
    ``n`` rows, the first arrived row ``_first`` and its place ``_at``."""
    at = F.struct(*order)
    return (enriched.groupBy("org", "city", s.pane(F.col("ts_ms")).alias("pane"))
            .agg(F.sum("temperature").alias("total"), F.count("temperature").alias("n_temperature"), F.count(F.lit(1)).alias("n"),
                 F.min_by(F.struct(at.alias("at"), "id", "ts_ms", "lat", "lon"), at).alias("_first")))


def merged_panes(panes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``city_panes`` added up by other keys."""
    return panes.groupBy(*keys).agg(
        F.sum("total").alias("total"), F.sum("n_temperature").alias("n_temperature"), F.sum("n").alias("n"),
        F.min_by("_first", "_first.at").alias("_first"))


def average() -> Column:
    return (F.col("total") / F.col("n_temperature")).alias("avg_temperature")


def windows_of_panes(panes: DataFrame, s: Sliding) -> DataFrame:
    """D1 rows from ``city_panes``: dealt by (org, city), then rolled up in place."""
    lo, hi = s.first_window(F.col("pane")), s.last_window(F.col("pane"))
    each = (panes.repartition("org", "city").where(lo <= hi)
            .withColumn("k", F.explode(F.sequence(lo, hi))))
    w = merged_panes(each, ["org", "city", "k"])
    return w.select("org", "city", *s.columns("k"), average(), "n", F.col("_first.id").alias("first_id"),
                    F.col("_first.ts_ms").alias("first_ts_ms"), F.col("_first.lat").alias("first_lat"), F.col("_first.lon").alias("first_lon"))


def id_panes(enriched: DataFrame, s: Sliding, keys: list[str]) -> DataFrame:
    """The distinct (keys, id, pane)."""
    return enriched.select(*keys, "id", s.pane(F.col("ts_ms")).alias("pane")).distinct()


def id_windows(panes: DataFrame, s: Sliding, keys: list[str]) -> DataFrame:
    """The distinct (keys, window, id): each pane adds the windows behind the last
    one of the id's pane before."""
    before = F.lag("pane").over(W.partitionBy(*keys, "id").orderBy("pane"))
    lo, hi = s.first_window(F.col("pane")), s.last_window(F.col("pane"))
    spans = panes.withColumn("_from", F.greatest(lo, F.coalesce(s.last_window(before) + 1, lo))).withColumn("_to", hi)
    return spans.where(F.col("_from") <= F.col("_to")).withColumn("k", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to", "pane")


def in_a_window(s: Sliding) -> Column:
    """Rows between two windows (slide longer than window) are in none."""
    return F.lit(True) if s.window >= s.slide else F.pmod(F.col("ts_ms"), F.lit(s.slide)) < s.window


def latest_city_rows(enriched: DataFrame, s: Sliding) -> DataFrame:
    """Per (org, city) its newest slide ``k`` with the sum and counts of that
    slide's rows: all that the newest window holds."""
    slides = (enriched.where(in_a_window(s)).groupBy("org", "city", F.floor(F.col("ts_ms") / s.slide).alias("k"))
              .agg(F.sum("temperature").alias("total"), F.count("temperature").alias("n_temperature"), F.count(F.lit(1)).alias("n")))
    return newest_city_rows(slides)


def newest_city_rows(slides: DataFrame) -> DataFrame:
    """Of rows (org, city, k, total, n_temperature, n), each once: the newest ``k``."""
    newest = F.max_by(F.struct("k", "total", "n_temperature", "n"), F.col("k")).alias("_l")
    return slides.groupBy("org", "city").agg(newest).select("org", "city", "_l.*")


def latest_city_state(rows: DataFrame, s: Sliding) -> DataFrame:
    """D4 rows from ``latest_city_rows``."""
    return rows.select("org", "city", *s.columns("k"), average(), "n")


def latest_id_rows(enriched: DataFrame, s: Sliding) -> DataFrame:
    """Per org, the distinct (city, id) of its newest slide ``k``."""
    seen = enriched.where(in_a_window(s)).select("org", F.floor(F.col("ts_ms") / s.slide).alias("k"), "city", "id").distinct()
    return newest_id_rows(seen)


def newest_id_rows(seen: DataFrame) -> DataFrame:
    """Of rows (org, k, city, id): those of each org's newest ``k``."""
    newest = seen.groupBy("org").agg(F.max("k").alias("k"))
    return seen.join(newest, ["org", "k"])


def latest_id_state(rows: DataFrame, s: Sliding) -> DataFrame:
    """D5 rows from ``latest_id_rows``."""
    return rows.select("org", *s.columns("k"), "city", "id")

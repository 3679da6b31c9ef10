"""sampling and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sample_places(places: DataFrame, n: int = 1000, seed: int = 7) -> DataFrame:
    """``n`` places in a seeded random order (a top-k on the md5 of
    seed and key, which every engine computes: Spark keeps a bounded heap per task, no full sort)."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("place_id").cast("string")))
    return places.withColumn("_k", key).orderBy("_k", "place_id").limit(n).drop("_k")


def sorted_orgs(df: DataFrame) -> DataFrame:
    """distinct org names in string order ("Org 10" before "Org 2")."""
    return df.select("org").distinct().orderBy("org")

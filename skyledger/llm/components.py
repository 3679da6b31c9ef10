"""Connected components of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import written


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Links each node's neighbours (all larger ones, or all smaller ones and
    the node itself) to the least of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else (
        joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))))
    return out.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of every node of ``links (a, b)``.

    Alternates large and small stars until every node is linked to the least
    node of its component and to nothing else; each round is a written table."""
    def state(df):
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    before = state(links)
    while True:
        links = written(_stars(_stars(links, True), False), "links")
        after = state(links)
        if after == before:
            break
        before = after
    return (links.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())

"""Sharding: proportional stratified interleaving.

Rows are ranked in a seeded shuffle within their source, a row's place is
``(rank + phase) / rows of its source`` (``phase``: a seeded number in [0, 1)
of the source, so that small sources do not all fall on one place), and the
rows in order of place are cut into shards whose counts differ by one at most:
law ``rows``.  Every run of that order, and so every shard, holds each source
in proportion.

Neither ranking sorts the corpus in one task: ranks are a row number within a
bucket plus the rows of all buckets before it.  Within a source the buckets
are ranges of the shuffle key, overall they are ranges of the place, so a
source with a third of all rows is spread over all of them.

Defined results: a null source is a source of its own; null text has size 1
and the crc32 of no bytes; null doc_ids shuffle by a fixed key; repeated rows
each get a place; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.llm.common import table, written

SHARDS = 8
SEED = "7"
#: Buckets of each ranking; only how the work is split depends on them.
BUCKETS = 4096
_HASH_BITS = 60


def _seeded(column, seed: str):
    """A 60-bit number from md5: every engine computes the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), column)), 1, 15), 16, 10).cast("long")


def _preceding(counts: DataFrame, order: str, *keys: str) -> DataFrame:
    """Adds the rows before each bucket and of all buckets; one row a bucket."""
    w = W.partitionBy(*keys)
    return (counts.withColumn("before", F.coalesce(F.sum("n").over(
                w.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("total", F.sum("n").over(w)).drop("n"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    width = (1 << _HASH_BITS) // buckets
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("stratum"),
        _seeded(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed).alias("h"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ).withColumn("bucket", F.expr(f"h div {width}"))

    # Counts scan no text: the columns of the text are pruned from them.
    within = _preceding(rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", "stratum")
    rank = F.row_number().over(W.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "size", "text_crc32"))
    phase = _seeded(F.col("stratum"), seed) / F.lit(float(1 << _HASH_BITS))
    placed = (rows.join(within, ["stratum", "bucket"])
              .withColumn("place", (F.col("before") + rank - 1 + phase) / F.col("total"))
              .select("doc_id", "stratum", "h", "size", "text_crc32", "place",
                      F.floor(F.col("place") * buckets).alias("bucket")))

    placed = written(placed, "sharding")

    # At most one row for each of the buckets: the one window without a key is over these.
    overall = _preceding(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket")
    order = W.partitionBy("bucket").orderBy("place", "stratum", "h", "doc_id", "size", "text_crc32")
    position = F.col("before") + F.row_number().over(order) - 1
    return (placed.join(F.broadcast(overall), "bucket").withColumn("position", position)
            .withColumn("shard", F.expr(f"(position * {shards}) div total").cast("int"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("position") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def op7_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proportional stratified interleaving of all ``documents`` into shards 0 to 7."""
    return interleave(table(spark, sf_dir, "documents"))

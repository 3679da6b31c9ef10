"""Running aggregates per key without putting a key's rows in one task.

A running sum over ``partitionBy(key).orderBy(order)`` would send all rows
of a key to one window partition.  Here the rows carry a bucket of the
order column (``bucket_col``, non-decreasing along the order): windows run
inside (key, bucket), and a small per-(key, bucket) table carries the
totals of all earlier buckets, added back with a join.  If the input is
hash-partitioned on (key, bucket) the windows and the per-bucket aggregate
reuse that partitioning, and only the small table moves (one row per
(key, bucket); the carry window runs per key over that small table).

* ``sums``: inclusive running sums
* ``lasts``: inclusive running last non-null value
* ``lasts_before``: last non-null value over the rows strictly before
* ``maxs_before``: maximum over the rows strictly before
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def bucketed_running(df: DataFrame, keys: list[str], order: list[str], bucket_col: str,
                     sums: dict[str, Column] | None = None,
                     lasts: dict[str, Column] | None = None,
                     lasts_before: dict[str, Column] | None = None,
                     maxs_before: dict[str, Column] | None = None) -> DataFrame:
    sums, lasts = sums or {}, lasts or {}
    lasts_before, maxs_before = lasts_before or {}, maxs_before or {}
    specs = {**sums, **lasts, **lasts_before, **maxs_before}
    b = df
    for n, e in specs.items():
        b = b.withColumn(f"_v_{n}", e)
    inner = W.partitionBy(*keys, bucket_col).orderBy(*order)
    incl = inner.rowsBetween(W.unboundedPreceding, W.currentRow)
    excl = inner.rowsBetween(W.unboundedPreceding, -1)
    for n in sums:
        b = b.withColumn(f"_in_{n}", F.sum(f"_v_{n}").over(incl))
    for n in lasts:
        b = b.withColumn(f"_in_{n}", F.last(f"_v_{n}", ignorenulls=True).over(incl))
    for n in lasts_before:
        b = b.withColumn(f"_in_{n}", F.last(f"_v_{n}", ignorenulls=True).over(excl))
    for n in maxs_before:
        b = b.withColumn(f"_in_{n}", F.max(f"_v_{n}").over(excl))
    ordering = F.struct(*order)
    per_bucket = b.groupBy(*keys, bucket_col).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), ordering)).alias(f"_t_{n}")
          for n in [*lasts, *lasts_before]],
        *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxs_before])
    before = W.partitionBy(*keys).orderBy(bucket_col).rowsBetween(W.unboundedPreceding, -1)
    carry = per_bucket.select(
        *keys, bucket_col,
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}")
          for n in [*lasts, *lasts_before]],
        *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxs_before])
    out = b.join(carry, [*keys, bucket_col], "left")
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.col(f"_in_{n}"))
    for n in [*lasts, *lasts_before]:
        out = out.withColumn(n, F.coalesce(F.col(f"_in_{n}"), F.col(f"_c_{n}")))
    for n in maxs_before:
        out = out.withColumn(n, F.greatest(F.col(f"_in_{n}"), F.col(f"_c_{n}")))
    return out.drop(*[f"_{p}_{n}" for n in specs for p in ("v", "in", "c")])


def ranged(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Range-partition ``df`` on ``order`` and number the partitions
    (``_rp``), which then are ordered, balanced buckets of the order: the
    partitioner samples the data, so a key or instant holding a large share
    of the rows is split over several partitions (ties are broken by the
    remaining order columns).  The rows and their numbers are written to the
    shared folder once, so every branch of a plan sees the same ones: the
    partitioner's sample, taken anew, could draw other borders."""
    from skyledger.session import shared_table
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shared_table(df.repartitionByRange(n, *order).withColumn("_rp", F.spark_partition_id()), "ranged")


def even_buckets(df: DataFrame, keys: list[str], order_col: str, rows: int = 1 << 16, width: int = 1 << 16) -> DataFrame:
    """``df`` with ``_bkt``: a key's rows cut along ``order_col`` into buckets of
    about ``rows`` rows, however its rows lie in the log, so that a table of one
    row for each (key, bucket) is small beside the log.  A key of up to ``rows``
    rows is one bucket, 0.  Counts per (key, stretch of ``width``) are summed
    along the key; stretches go to a bucket whole.  ``df`` is read twice."""
    part = F.floor(F.col(order_col) / width)
    counts = df.groupBy(*keys, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    cut = counts.select(*keys, "_part", F.floor(before / rows).alias("_bkt")).where(F.col("_bkt") > 0)
    return (df.withColumn("_part", part).join(cut, [*keys, "_part"], "left")
            .withColumn("_bkt", F.coalesce("_bkt", F.lit(0).cast("long"))).drop("_part"))

"""D14 quantiles and D8 admission: ranks without gathering a group.

A whole number ``v`` falls into the bin that starts at its ``BITS`` leading
bits (small numbers are bins of their own), so a bin is at most 1/64 as wide
as its numbers are large, and a key has a few thousand bins at most, however
many rows it has.  A histogram is a table (keys, bin, n):

* it is a mergeable sketch: kept per window, added up over windows, and read
  as bounds of any quantile (``merged``, ``bounds``);
* it finds exact order statistics: the bin that holds the wanted rank is known
  from it, and only that bin's rows are counted by value (``ranked``).

Quantile ``q`` of ``n`` numbers is the one of rank ``ceil(q n)`` (1 at least).
Nulls are ignored; a key without numbers has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger.session import shared_table

BITS = 7


def bin_of(value: Column) -> Column:
    """The least number of the value's bin; grows with the value."""
    drop = F.greatest(F.length(F.bin(F.abs(value))) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, ``bin``, ``n``, ``least``, ``most`` of the whole numbers in ``value``."""
    v = F.col(value).cast("long")
    return (df.where(v.isNotNull()).groupBy(*keys, bin_of(v).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most")))


def merged(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms added up over all other columns (windows, parts)."""
    return histograms.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def _cumulated(bins: DataFrame, keys: list[str]) -> DataFrame:
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return bins.withColumns({"_upto": F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)),
                             "_all": F.sum("n").over(by)})


def _rank(q: Column) -> Column:
    return F.greatest(F.ceil(q * F.col("_all")), F.lit(1)).cast("long")


def bounds(bins: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """``keys``, ``q``, ``low``, ``high``: the least and greatest number of the bin
    that holds the quantile, so it lies between them and they are within 1/64
    of each other."""
    wanted = _cumulated(bins, keys).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    return (wanted.where((_rank(F.col("q")) <= F.col("_upto")) & (_rank(F.col("q")) > F.col("_upto") - F.col("n")))
            .select(*keys, "q", F.col("least").alias("low"), F.col("most").alias("high")))


def ranked(df: DataFrame, keys: list[str], value: str, ranks: Column, bins: DataFrame | None = None) -> DataFrame:
    """Exact order statistics: ``keys``, ``rank``, ``value`` for each of ``ranks``
    (an array of longs, may use ``_all``, the key's number of numbers); ranks
    beyond it have no row.  ``bins``: the histogram, if there is one already."""
    bins = histogram(df, keys, value) if bins is None else bins
    wanted = _cumulated(bins, keys).withColumn("rank", F.explode(F.array_distinct(ranks)))
    wanted = (wanted.where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("n")))
              .select(*keys, "bin", "rank", (F.col("rank") - (F.col("_upto") - F.col("n"))).alias("_in_bin")))
    v = F.col(value).cast("long")
    rows = df.where(v.isNotNull()).select(*keys, bin_of(v).alias("bin"), v.alias("value"))
    here = rows.join(wanted.select(*keys, "bin").distinct(), [*keys, "bin"], "left_semi")
    counts = here.groupBy(*keys, "bin", "value").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys, "bin").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    return (counts.withColumn("_to", upto).join(wanted, [*keys, "bin"])
            .where((F.col("_in_bin") <= F.col("_to")) & (F.col("_in_bin") > F.col("_to") - F.col("_n")))
            .select(*keys, "rank", "value"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """``keys``, ``n`` and a column ``p<percent>`` for each quantile, exact.  The
    numbers are read by several steps, so they are written once."""
    names = {q: f"p{100 * q:g}".replace(".", "_") for q in qs}
    df = shared_table(df.select(*keys, F.col(value).cast("long").alias(value)), "numbers")
    bins = histogram(df, keys, value)
    found = ranked(df, keys, value, F.array(*[_rank(F.lit(float(q))) for q in qs]), bins)
    totals = bins.groupBy(*keys).agg(F.sum("n").alias("_all"))
    joined = found.join(totals, keys) if keys else found.crossJoin(totals)
    return joined.groupBy(*keys).agg(F.first("_all").alias("n"), *[
        F.max(F.when(F.col("rank") == _rank(F.lit(float(q))), F.col("value"))).alias(n) for q, n in names.items()])


def admission(groups: DataFrame, worker: str, first: str, tie: str, limit: int) -> DataFrame:
    """``groups`` (one row for each group with its worker and the place of its
    first row: ``first``, ``tie``) with ``admitted``: the first ``limit`` groups of
    each worker, by arrival.  The ``limit``-th first arrival of each worker is
    selected exactly; only groups that arrive with it are ordered among themselves."""
    last = ranked(groups, [worker], first, F.array(F.lit(limit).cast("long"))).select(worker, F.col("value").alias("_last"))
    g = groups.join(last, worker, "left")
    before = g.where(F.col(first) < F.col("_last")).groupBy(worker).agg(F.count(F.lit(1)).alias("_before"))
    at = g.where(F.col(first) == F.col("_last"))
    at = at.withColumn("_no", F.row_number().over(W.partitionBy(worker).orderBy(tie))).join(before, worker, "left")
    tied = at.withColumn("admitted", F.coalesce("_before", F.lit(0)) + F.col("_no") <= limit).drop("_no", "_before")
    others = g.where(F.col("_last").isNull() | (F.col(first) != F.col("_last"))) \
              .withColumn("admitted", F.coalesce(F.col(first) < F.col("_last"), F.lit(limit > 0)))
    return others.unionByName(tied).drop("_last")

"""Exact greedy counters along an ordered log, many tasks to a key.

A *ladder* counts up along a key's rows: each row has a threshold ``c`` and
raises the count ``k`` by one if ``k < c``; otherwise it leaves it.  The row
that raises the count from ``j`` is rung ``j``: the first row after rung
``j - 1`` whose threshold is above ``j``.  Rows may be late (thresholds need
not rise), so the count is no running maximum, and the count after a row
depends on every row before it.

What a stretch of rows does to the count is a monotone step function:
``k -> k + #{b : b > k}`` over its break points ``b``, one a row, all
different; two stretches compose.  The log is cut into buckets of each key,
which are handled by different tasks:

1. per bucket, the greatest threshold; over the small (key, bucket) table,
   the greatest before it (``top``);
2. bounds ``lo <= k <= hi`` of the count at each bucket's start, by prefix
   sums and prefix minima: ``lo`` lets only rows count that are not late,
   ``hi`` every row, and neither passes ``top``;
3. where the bounds differ, the bucket's step function between them (the
   break points inside, found in one fold), composed from the last bucket
   whose count is known;
4. with its start known, each bucket's rows are folded once more.

Everything is a built-in expression: folds are ``aggregate`` over the bucket's
sorted array.  No key is gathered: a chain holds one small row for each bucket
between two whose bounds agree, which in a log that is at most a few rows
behind are neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK = 64

Step = Callable[[Column, Column], Column]


def long(v: int) -> Column:
    return F.lit(v).cast("long")


def scanned(rows: Column, start: Column, step: Step, chunk: int = CHUNK) -> Column:
    """The states before each row of an array, from ``start`` on: chunk by chunk
    first, then within each chunk, so that no array is copied for every row."""
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(rows) / chunk).cast("int") - 1),
                         lambda i: F.slice(rows, i * chunk + 1, chunk))
    pieces = F.when(F.size(rows) > 0, pieces)

    def appended(states: Column, piece: Column) -> Column:
        return F.array_append(states, F.aggregate(piece, F.element_at(states, -1), step))

    starts = F.aggregate(pieces, F.array(start), appended)

    def within(piece: Column, first: Column) -> Column:
        every = F.aggregate(piece, F.array(first), lambda states, row: F.array_append(states, step(F.element_at(states, -1), row)))
        return F.slice(every, 1, F.size(piece))

    return F.flatten(F.zip_with(pieces, F.slice(starts, 1, F.size(pieces)), within))


def climbed(threshold: Callable[[Column], Column]) -> Step:
    """The step of one row of an array: up by one below its threshold."""
    return lambda k, row: F.when(k < threshold(row), k + 1).otherwise(k)


def _bounds(c0: Column, rows: Column, threshold: Callable[[Column], Column]) -> Column:
    """Of one bucket: rows that are not late (``n``) and rows that can count
    (``m``), and the least of top - n, top - m over its rows."""
    zero = F.struct(c0.alias("top"), long(0).alias("n"), long(0).alias("m"),
                    c0.alias("least_n"), c0.alias("least_m"))

    def step(s: Column, row: Column) -> Column:
        c = threshold(row)
        top = F.greatest(s["top"], c)
        n = s["n"] + ((c == top) & (c > 0)).cast("long")
        m = s["m"] + (c > 0).cast("long")
        return F.struct(top.alias("top"), n.alias("n"), m.alias("m"), F.least(s["least_n"], top - n).alias("least_n"),
                        F.least(s["least_m"], top - m).alias("least_m"))

    return F.aggregate(rows, zero, step)


def _step_function(lo: Column, hi: Column, rows: Column, threshold: Callable[[Column], Column]) -> Column:
    """What a bucket does to a count in [lo, hi]: ``above`` (rows that count for
    all of them) and the break points inside, falling."""
    zero = F.struct(lo.alias("kl"), hi.alias("kh"), F.array().cast("array<long>").alias("breaks"))

    def step(s: Column, row: Column) -> Column:
        c, above, breaks = threshold(row), s["kh"] - hi, s["breaks"]
        before = F.size(F.filter(breaks, lambda b, at: b + above + at >= c))
        broken = F.concat(F.slice(breaks, F.lit(1), before), F.array(c - above - before),
                          F.slice(breaks, before + 1, F.size(breaks)))
        split = (s["kl"] < c) & (s["kh"] >= c)
        return F.struct(F.when(s["kl"] < c, s["kl"] + 1).otherwise(s["kl"]).alias("kl"),
                        F.when(s["kh"] < c, s["kh"] + 1).otherwise(s["kh"]).alias("kh"),
                        F.when(split, broken).otherwise(breaks).alias("breaks"))

    return F.aggregate(rows, zero, step, lambda s: F.struct((s["kh"] - hi).alias("above"), s["breaks"].alias("breaks")))


def counts_before(buckets: DataFrame, keys: list[str], bucket: str, rows: str,
                  ladders: dict[str, Callable[[Column], Column]], single: bool = False) -> DataFrame:
    """``buckets`` (one row for each key and bucket, ``rows`` its sorted array)
    with one column for each ladder: its count before each of the rows, an
    array of longs.

    ``ladders`` maps a column's name to its threshold: an array element to a
    long, not null.  ``buckets`` is read four times; hand in a written or
    persisted table.  ``single``: no key has a second bucket, so every count
    starts at 0 and the steps that find the starts are left out.
    """
    if single:
        return buckets.withColumns({n: scanned(F.col(rows), long(0), climbed(t)) for n, t in ladders.items()})
    by_bucket = W.partitionBy(*keys).orderBy(bucket)
    earlier = by_bucket.rowsBetween(W.unboundedPreceding, -1)
    own = [*keys, bucket]
    n_parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(small: DataFrame) -> DataFrame:
        """By key and bucket again: joined as the windows left it, by key alone, all
        of a key's arrays would come to one task (and AQE would join small ones up)."""
        return small.repartition(n_parts, *own)

    def before(agg: Column) -> Column:
        return F.coalesce(agg.over(earlier), long(0))

    highest = buckets.select(*own, *[F.array_max(F.transform(rows, t)).alias(n) for n, t in ladders.items()])
    tops = highest.select(*own, *[F.greatest(before(F.max(n)), long(0)).alias(f"_top_{n}") for n in ladders])

    s = (buckets.select(*own, rows).join(dealt(tops), own)
         .select(*own, *[_bounds(F.col(f"_top_{n}"), F.col(rows), t).alias(n) for n, t in ladders.items()]))
    for n in ladders:
        s = s.withColumns({f"_n_{n}": before(F.sum(f"{n}.n")), f"_m_{n}": before(F.sum(f"{n}.m"))})
    bounds = s.select(*own, *[(F.col(total) + F.least(long(0), before(F.min(F.col(least) - F.col(total))))).alias(name) for n in ladders
                              for total, least, name in ((f"_n_{n}", f"{n}.least_n", f"_lo_{n}"), (f"_m_{n}", f"{n}.least_m", f"_hi_{n}"))])

    functions = buckets.select(*own, rows).join(dealt(bounds), own).select(
        *own, *[F.struct(F.col(f"_lo_{n}").alias("lo"), (F.col(f"_lo_{n}") == F.col(f"_hi_{n}")).alias("known"),
                         _step_function(F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), F.col(rows), t).alias("f")).alias(n) for n, t in ladders.items()])
    known = F.lit(True)
    for n in ladders:
        known = known & F.col(f"{n}.known")
    chains = (functions.withColumn("_chain", F.sum(known.cast("long")).over(by_bucket.rowsBetween(W.unboundedPreceding, W.currentRow)))
              .groupBy(*keys, "_chain").agg(F.array_sort(F.collect_list(F.struct(bucket, *ladders))).alias("_of")))

    def applied(n: str) -> Column:
        return scanned(F.col("_of"), F.col("_of")[0][n]["lo"], lambda k, b: k + b[n]["f"]["above"] + F.size(
            F.filter(b[n]["f"]["breaks"], lambda x: x > k)))

    starts = (chains.select(*keys, F.explode(F.arrays_zip(F.col("_of").alias("of"), *[applied(n).alias(n) for n in ladders])).alias("_z"))
              .select(*keys, F.col(f"_z.of.{bucket}").alias(bucket), *[F.col(f"_z.{n}").alias(f"_from_{n}") for n in ladders]))
    return (buckets.join(dealt(starts), own)
            .withColumns({n: scanned(F.col(rows), F.col(f"_from_{n}"), climbed(t)) for n, t in ladders.items()})
            .drop(*[f"_from_{n}" for n in ladders]))

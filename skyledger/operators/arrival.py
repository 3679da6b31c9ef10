"""H2 in batch: the slide-on-arrival window by built-in expressions.

The rule, per group key and in arrival order (window start ``W``): append the
row; if ``ts - W > window`` emit the whole buffer with the row, then drop rows
from the front until one with ``ts >= W`` was dropped, and ``W += slide``.

Emission ``j`` has ``W = start + j * slide``, so two greedy counters hold all
state (:mod:`skyledger.operators.ladder`):

* emissions: the row that triggers emission ``j`` is the first after trigger
  ``j - 1`` with ``ts - start - j * slide > window``;
* drops: the last row dropped by emission ``j`` is the first after the one of
  ``j - 1`` with ``ts >= start + j * slide`` (the triggering row is one, so
  it lies in the buffer).

The buffer of emission ``j`` is the run of rows from behind drop ``j - 1`` to
trigger ``j``.  Averages are differences of running sums at its two ends
(whole 1024ths are summed as integers, so long logs lose no digits).  Distinct
ids: a row is in the emissions from the count of triggers before it to the
count of drops before it, both of which never fall, so each (key, city, id)
adds only the emissions beyond those of its row before.

A key's log is cut into buckets of about ``SEQ_BUCKET`` rows along the first
order column; no task needs a whole key.  The rows, their (key, bucket) arrays
and the counted rows are written to the shared folder, each once.

Defined results: rows with a null key, time or first order column are left out; a null temperature
counts in ``n`` but not in the average (null if all are null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from skyledger.operators.ladder import counts_before, long
from skyledger.operators.prefix import bucketed_running, even_buckets
from skyledger.session import shared_table

WINDOW_MS = 60_000
SLIDE_MS = 10_000
# Rows of a key that one task folds (see operators.prefix.even_buckets).
SEQ_BUCKET = 1 << 16


def counted_rows(enriched: DataFrame, keys: list[str], window_ms: int, slide_ms: int, initial_start: int | None,
                 order: list[str], columns: list[str], bucket: int = SEQ_BUCKET) -> DataFrame:
    """Every row with ``_bkt``, the key's first window ``start``, the emissions
    (``fired``) and drops (``dropped``) before it, and whether it is one
    (``fires``, ``drops``)."""
    rows = enriched.where(F.col("ts_ms").isNotNull()).dropna(subset=[*keys, order[0]])
    rows = shared_table(rows.select(*keys, *[c for c in dict.fromkeys([*order, *columns]) if c not in keys]), "arrival")
    # a fixed number of partitions: AQE sizes them by bytes, and the folds take far longer than their bytes tell
    n = int(enriched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = even_buckets(rows, keys, order[0], bucket, bucket).repartition(n, *keys, "_bkt")
    buckets = shared_table(
        cut.groupBy(*keys, "_bkt").agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c not in keys]))).alias("_rows")),
        "arrival-buckets")
    if initial_start is None:
        firsts = buckets.groupBy(*keys).agg(F.min_by(F.col("_rows")[0]["ts_ms"], "_bkt").alias("start"))
        started = buckets.join(firsts, keys)
    else:
        started = buckets.withColumn("start", long(initial_start))
    # times from the start on, as a threshold sees one element only
    timed = started.withColumn("_at", F.transform("_rows", lambda r: (r["ts_ms"] - F.col("start")).cast("long")))

    def emissions(at):  # k < (at - window) / slide
        return F.ceil((at - window_ms) / slide_ms).cast("long")

    def drops(at):  # k <= at / slide
        return (F.floor(at / slide_ms) + 1).cast("long")

    single = buckets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    both = counts_before(timed, keys, "_bkt", "_at", {"_fired": emissions, "_dropped": drops}, single)
    each = both.select(*keys, "_bkt", "start", F.explode(F.arrays_zip("_rows", "_fired", "_dropped")).alias("z"))
    at = F.col("z._rows.ts_ms") - F.col("start")
    return shared_table(each.select(*keys, "_bkt", "start", *[F.col(f"z._rows.{c}").alias(c) for c in dict.fromkeys([*order, *columns]) if c not in keys],
                       F.col("z._fired").alias("fired"), F.col("z._dropped").alias("dropped"),
                       (F.col("z._fired") < emissions(at)).alias("fires"), (F.col("z._dropped") < drops(at)).alias("drops")), "arrival-counts")


def _order(enriched: DataFrame, order_cols: tuple[str, ...]) -> list[str]:
    return [c for c in order_cols if c in enriched.columns]


def arrival_window_temperature(enriched: DataFrame, window_ms: int = WINDOW_MS, slide_ms: int = SLIDE_MS,
                               initial_start: int | None = None,
                               order_cols: tuple[str, ...] = ("arrival_seq", "arrival_pos"),
                               bucket: int = SEQ_BUCKET) -> DataFrame:
    """H2 + D1: averages per (org, city) by the arrival rule, with the first
    buffered row's id, time and location."""
    keys, order = ["org", "city"], _order(enriched, order_cols)
    rows = counted_rows(enriched, keys, window_ms, slide_ms, initial_start, order,
                        ["ts_ms", "temperature", "id", "lat", "lon"], bucket)
    whole = F.floor(F.col("temperature") * 1024).cast("long")
    n = int(enriched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bucketed_running(
        rows.repartition(n, *keys, "_bkt"), keys, order, "_bkt",
        sums={"_n": long(1), "_t": F.col("temperature").isNotNull().cast("long"), "_whole": F.coalesce(whole, long(0)),
              "_rest": F.coalesce(F.col("temperature") - whole / 1024, F.lit(0.0))},
        lasts_before={"_behind": F.col("drops")})
    sums = ["_n", "_t", "_whole", "_rest"]
    last = rows.where("fires").select(*keys, F.col("fired").alias("j"), "start", F.col("ts_ms").alias("trigger_ts_ms"),
                                      *[F.col(c).alias(f"e{c}") for c in sums])
    # the buffer's front: the key's first row, then the row behind each drop
    own = {"_n": long(1), "_t": F.col("temperature").isNotNull().cast("long"), "_whole": F.coalesce(whole, long(0)),
           "_rest": F.coalesce(F.col("temperature") - whole / 1024, F.lit(0.0))}
    first = rows.where(F.coalesce("_behind", F.lit(True))).select(
        *keys, F.col("dropped").alias("j"), F.col("id").alias("first_id"), F.col("ts_ms").alias("first_ts_ms"),
        F.col("lat").alias("first_lat"), F.col("lon").alias("first_lon"), *[(F.col(c) - own[c]).alias(f"f{c}") for c in sums])
    j = last.join(first, [*keys, "j"])
    d = {c: F.col(f"e{c}") - F.col(f"f{c}") for c in sums}
    return j.select(*keys, (F.col("j") + 1).alias("emit_no"), (F.col("start") + F.col("j") * slide_ms).alias("window_start_ms"),
                    "trigger_ts_ms", d["_n"].alias("n"),
                    F.when(d["_t"] > 0, (d["_whole"] / 1024 + d["_rest"]) / d["_t"]).alias("avg_temperature"),
                    "first_id", "first_ts_ms", "first_lat", "first_lon")


def arrival_window_drones(enriched: DataFrame, window_ms: int = WINDOW_MS, slide_ms: int = SLIDE_MS,
                          initial_start: int | None = None,
                          order_cols: tuple[str, ...] = ("arrival_seq", "arrival_pos"),
                          bucket: int = SEQ_BUCKET) -> DataFrame:
    """H2 + D2/D3: distinct (city, id) per emitted org window, one row each."""
    keys = ["org"]
    rows = counted_rows(enriched, keys, window_ms, slide_ms, initial_start, _order(enriched, order_cols),
                        ["ts_ms", "city", "id"], bucket)
    fired = rows.where("fires").select("org", F.col("fired").alias("j"), "start", F.col("ts_ms").alias("trigger_ts_ms"))
    emitted = fired.groupBy("org").agg(F.max("j").alias("_last"))
    # a row is in the emissions from `fired` to `dropped`: a device's equal spans first, then what each adds
    spans = rows.select("org", "city", "id", "fired", "dropped").distinct()
    before = F.max("dropped").over(W.partitionBy("org", "city", "id").orderBy("fired", "dropped").rowsBetween(W.unboundedPreceding, -1))
    spans = (spans.withColumn("_from", F.greatest(F.col("fired"), F.coalesce(before + 1, long(0)))).join(emitted, "org")
             .withColumn("_to", F.least("dropped", "_last")).where(F.col("_from") <= F.col("_to")))
    each = spans.select("org", "city", "id", F.explode(F.sequence("_from", "_to")).alias("j"))
    return each.join(fired, ["org", "j"]).select(
        "org", (F.col("j") + 1).alias("emit_no"), (F.col("start") + F.col("j") * slide_ms).alias("window_start_ms"),
        "trigger_ts_ms", "city", "id")

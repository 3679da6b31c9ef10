"""Outcome counters, latency and throughput figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from skyledger.operators.prefix import bucketed_running, ranged
from skyledger.schemas import OUTCOME_COMMITTED, OUTCOME_EMPTY, OUTCOME_OUT_OF_DATE

# Fixed values that must equal the reference: session stage names and the
# failure reasons of the commit and cart query stages.
STAGE_COMMIT = "CommitCart"
STAGE_QUERY_CART = "QueryShoppingCart"
REASON_MISMATCH = "shopping cart doesn't match"
REASON_CONFLICT = "cart timestamp out of date or empty cart"
REASON_COMMIT_ERROR = "error committing to cart with status: 500 Internal Server Error"


def session_log(commands: DataFrame, seq_bucket: int = 1 << 16, verify: bool = False) -> DataFrame:
    """Session log from folded cart commands (``user_id, seq, ts_ms, action,
    outcome``): a session is a user's commands up to and including a commit.
    The commit count per user runs bucketed by ``seq`` (see operators.prefix).
    With ``verify`` the client compares its cart before it commits (needs
    ``epoch``, ``product_ids``, ``n_valid``): ids of the commit's epoch that the
    catalog lacks are in the client's cart only, so the session fails there.
    Columns: session_id, stage, reason, success, start_ms, end_ms."""
    is_commit = (F.col("action") == "commit").cast("long")
    if "_bkt" not in commands.columns:
        commands = commands.withColumn("_bkt", F.floor(F.col("seq") / seq_bucket))
    s = bucketed_running(commands, ["user_id"], ["seq"], "_bkt", sums={"_commits": is_commit})
    s = s.withColumn("session_no", F.col("_commits") - is_commit)
    g = (s.groupBy("user_id", "session_no")
         .agg(F.min("ts_ms").alias("start_ms"),
              F.max_by(F.struct("action", "outcome", "ts_ms", *(["epoch"] if verify else [])), F.col("seq")).alias("l"),
              *([F.max(F.when((F.col("action") == "add") & (F.size("product_ids") > F.col("n_valid")), F.col("epoch"))).alias("_bad")]
                if verify else [])))
    g = g.where(F.col("l.action") == "commit")
    outcome = F.col("l.outcome")
    mismatch = F.coalesce(F.col("_bad") == F.col("l.epoch"), F.lit(False)) if verify else F.lit(False)
    success = (outcome == OUTCOME_COMMITTED) & ~mismatch
    reason = (F.when(success, F.lit(None).cast("string")).when(mismatch, REASON_MISMATCH)
              .when(outcome.isin(OUTCOME_OUT_OF_DATE, OUTCOME_EMPTY), REASON_CONFLICT)
              .otherwise(REASON_COMMIT_ERROR))
    return g.select(
        F.concat_ws("-", "user_id", F.col("session_no").cast("string")).alias("session_id"),
        F.when(success, F.lit(None).cast("string")).when(mismatch, STAGE_QUERY_CART).otherwise(STAGE_COMMIT).alias("stage"),
        reason.alias("reason"), success.alias("success"),
        "start_ms", F.col("l.ts_ms").alias("end_ms"))


def session_outcomes(log: DataFrame) -> DataFrame:
    """Successful sessions, and failed ones by (stage, reason):
    columns success, stage, reason, sessions."""
    return (log.groupBy("success", "stage", "reason")
            .agg(F.count(F.lit(1)).alias("sessions")))


def latency_stats(df: DataFrame, start: str = "start_ms", end: str = "end_ms",
                  group_cols: tuple[str, ...] = (), percentiles: bool = False,
                  accuracy: int = 10000) -> DataFrame:
    """Distribution of ``end - start``: n, min, max, avg (and, with
    ``percentiles``, p50/p95/p99 by ``percentile_approx`` - mergeable
    sketches, so no group is gathered in one place)."""
    lat = (F.col(end) - F.col(start))
    aggs = [F.count(lat).alias("n"), F.min(lat).alias("min_ms"), F.max(lat).alias("max_ms"),
            F.avg(lat).alias("avg_ms")]
    if percentiles:
        aggs.append(F.percentile_approx(lat, [0.5, 0.95, 0.99], accuracy).alias("p50_p95_p99"))
    return df.groupBy(*group_cols).agg(*aggs)


#: Fixed values that must equal the reference: what each pipeline counts at each stage.
PACKET_STAGES = [("data-enrichment", "pre-pipeline"), ("data-enrichment", "flatten-data")]
MEASUREMENT_STAGES = [
    ("data-enrichment", "broadcast-downstream"),
    ("summarize-by-org", "pre-pipeline"), ("summarize-by-org", "group-by-org-city"),
    ("summarize-by-city", "pre-pipeline"), ("summarize-by-city", "group-by-org"),
]


def stage_throughput(packets: DataFrame, enriched: DataFrame) -> DataFrame:
    """D15 in batch: rows that enter each stage of each pipeline: packets
    before and at flattening, enriched measurements everywhere else.  Either
    input is counted once.  Streaming uses ``Dataset.observe`` instead (see
    streaming.telemetry)."""
    def counted(df, stages):
        names = F.array(*[F.struct(F.lit(p).alias("pipeline"), F.lit(s).alias("stage")) for p, s in stages])
        return (df.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(names).alias("_s"), "rows")
                .select("_s.pipeline", "_s.stage", "rows"))
    return counted(packets, PACKET_STAGES).unionByName(counted(enriched, MEASUREMENT_STAGES))


def send_stats(packets: DataFrame) -> DataFrame:
    """D16 per device: packets sent, measurements sent (sum of batch sizes)
    and the last batch size (by packet timestamp)."""
    size = F.size("measurements")
    return (packets.groupBy("id")
            .agg(F.count(F.lit(1)).alias("packets"),
                 F.sum(size).cast("long").alias("measurements_sent"),
                 F.max_by(size, F.col("timestamp")).alias("last_batch_size")))


def send_errors(rejects: DataFrame) -> DataFrame:
    """Errors by kind (the reject reasons of :func:`split_packets`)."""
    return rejects.groupBy(F.col("reason").alias("error")).agg(F.count(F.lit(1)).alias("errors"))


def report_intervals(df: DataFrame, key: str = "id", ts: str = "ts_ms",
                     tiebreak: str = "arrival_seq", partitions: int | None = None) -> DataFrame:
    """Gap between consecutive reports of a device (first row null).

    The rows are range-partitioned on (device, time), so one busy device is
    spread over several balanced partitions; each device's rows occupy a run
    of consecutive partitions.  The lag runs inside (partition, device); the
    first row of a device in a partition takes the device's last time in the
    previous partition, read from a small per-(partition, device) table.
    """
    order = [key, ts] + ([tiebreak] if tiebreak in df.columns else [])
    r = ranged(df, order, partitions)
    inner = W.partitionBy("_rp", key).orderBy(*order[1:])
    r2 = r.withColumn("_prev", F.lag(ts).over(inner))
    last = (r.groupBy("_rp", key).agg(F.max(ts).alias("_last"))
            .select((F.col("_rp") + 1).alias("_rp"), key, "_last"))
    out = r2.join(last, ["_rp", key], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_last"))
    return out.withColumn("interval_ms", F.col(ts) - prev).drop("_rp", "_prev", "_last")


def active_sessions(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """E5: number of open sessions after each start (+1) and stop (-1).

    A running sum over one global order (time, starts before stops, so that a
    session of no length counts up and then down; session id) has no partition key.  The events are range-partitioned on that
    order into balanced, ordered partitions (a busy instant is split too);
    per-partition totals (one row per partition) get a prefix sum, and the
    running sum inside each partition is added to the earlier partitions'
    total.
    """
    starts = log.select("session_id", F.col("start_ms").alias("t"), F.lit(1).alias("delta"))
    stops = log.select("session_id", F.col("end_ms").alias("t"), F.lit(-1).alias("delta"))
    events = starts.unionByName(stops).withColumn("_stop", F.col("delta") < 0)
    ev = ranged(events, ["t", "_stop", "session_id"], partitions)
    totals = ev.groupBy("_rp").agg(F.sum("delta").alias("_pt"))
    before = (totals.withColumn("_base", F.coalesce(F.sum("_pt").over(
        W.orderBy("_rp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("_rp", "_base"))
    inner = W.partitionBy("_rp").orderBy("t", "_stop", "session_id").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    return (ev.join(before, "_rp")
            .withColumn("active", (F.col("_base") + F.sum("delta").over(inner)).cast("long"))
            .select("session_id", "t", "delta", "active"))

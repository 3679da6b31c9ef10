import random

from pyspark.sql import Window as W, functions as F

from skyledger.operators import cart as C
from skyledger.operators import metrics as MX
from skyledger.operators.prefix import bucketed_running
from tests.test_cart import _catalog, _events, _py, _random_rows


def test_bucketed_running_equals_window(spark):
    rnd = random.Random(4)
    rows = [(f"k{rnd.randrange(3)}", i, rnd.choice([None, rnd.randint(0, 9)])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = bucketed_running(df.withColumn("b", F.floor(F.col("seq") / 7)), ["k"], ["seq"], "b",
                           sums={"s": F.coalesce("v", F.lit(0))}, lasts={"l": F.col("v")},
                           lasts_before={"lb": F.col("v")}, maxs_before={"mb": F.col("v")})
    w = W.partitionBy("k").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    wb = W.partitionBy("k").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    want = df.select("k", "seq", F.sum(F.coalesce("v", F.lit(0))).over(w).alias("s"),
                     F.last("v", ignorenulls=True).over(w).alias("l"),
                     F.last("v", ignorenulls=True).over(wb).alias("lb"), F.max("v").over(wb).alias("mb"))
    assert sorted(got.select("k", "seq", "s", "l", "lb", "mb").collect()) == sorted(want.collect())


def test_cart_epochs_with_tiny_buckets(spark):
    rows = _random_rows(8)
    ev, cat = _events(spark, rows), _catalog(spark)
    for b in (1, 5, 1 << 16):
        got = {(r.user_id, r.seq): r.outcome for r in C.commit_outcomes(C.cart_epochs(ev, cat, b)).collect()}
        want = {(u, s): o for u, (outs, _, _, _) in _py(rows).items() for s, o in outs.items()}
        assert got == want, b


def test_report_intervals_and_active_sessions(spark):
    rnd = random.Random(2)
    rows = [(f"d{rnd.randrange(4)}", i, rnd.randrange(0, 1_000_000)) for i in range(400)]
    rows += [("hot", 1000 + i, 5) for i in range(200)]          # one device, one instant
    df = spark.createDataFrame(rows, "id string, arrival_seq long, ts_ms long")
    got = MX.report_intervals(df, partitions=7)
    w = W.partitionBy("id").orderBy("ts_ms", "arrival_seq")
    want = df.select("id", "arrival_seq", (F.col("ts_ms") - F.lag("ts_ms").over(w)).alias("interval_ms"))
    assert sorted(got.select("id", "arrival_seq", "interval_ms").collect()) == sorted(want.collect())
    log = spark.createDataFrame([(f"s{i}", t, t + rnd.randrange(0, 200_000)) for i, t in
                                 enumerate(rnd.randrange(0, 1_000_000) for _ in range(300))],
                                "session_id string, start_ms long, end_ms long")
    act = MX.active_sessions(log, partitions=5)
    ev = sorted([(s, a, 1) for s, a, _ in log.collect()] + [(s, b, -1) for s, _, b in log.collect()],
                key=lambda r: (r[1], r[2], r[0]))
    run, want = 0, {}
    for s, t, d in ev:
        run += d
        want[(s, t, d)] = run
    assert {(r.session_id, r.t, r.delta): r.active for r in act.collect()} == want
    assert max(want.values()) > 1


def test_session_outcomes_and_latency(spark):
    rows = _random_rows(6)
    ep = C.cart_epochs(_events(spark, rows), _catalog(spark))
    log = MX.session_log(ep, seq_bucket=3)
    outs = {(r.success, r.stage, r.reason): r.sessions for r in MX.session_outcomes(log).collect()}
    commits = sum(1 for r in rows if r[3] == "commit")
    assert sum(outs.values()) == commits
    ok = sum(1 for u, (o, _, _, _) in _py(rows).items() for v in o.values() if v == "CartCommitted")
    assert outs[(True, None, None)] == ok
    st = MX.latency_stats(log, percentiles=True).first()
    assert st.n == commits and st.min_ms >= 0 and len(st.p50_p95_p99) == 3

import random

from skyledger.operators.arrival import arrival_window_drones, arrival_window_temperature
from tests.folds import arrival_window


def _enriched(spark, rows):
    return spark.createDataFrame(
        rows, "arrival_seq long, id string, ts_ms long, temperature double, lat double, lon double, "
              "org string, city string")


def test_edges_exact_rule(spark):
    # start = 0; row at exactly 60 s does not fire, 1 ms later fires;
    # a long gap then catches up one slide per row.
    ts = [0, 30_000, 60_000, 60_001, 61_000, 500_000, 500_001, 500_002]
    rows = [(i, f"d{i % 2}", t, float(i), 0.0, 0.0, "Org 1", "c") for i, t in enumerate(ts)]
    out = sorted(arrival_window_temperature(_enriched(spark, rows)).collect(), key=lambda r: r.emit_no)
    ref = arrival_window([(t, float(i), f"d{i % 2}") for i, t in enumerate(ts)])
    assert [(r.window_start_ms, r.trigger_ts_ms, r.n) for r in out] == \
        [(s, trig, len(b)) for s, trig, b in ref]
    assert out[0].trigger_ts_ms == 60_001 and out[0].n == 4   # includes the triggering row
    assert [r.window_start_ms for r in out][-3:] == [10_000, 20_000, 30_000]


def test_random_against_python_fold(spark):
    rnd = random.Random(9)
    rows, t = [], 0
    for i in range(600):
        t += rnd.choice([200, 1_000, 5_000, 20_000, 90_000])
        org = f"Org {rnd.randrange(3)}"
        city = rnd.choice(["a", "b"])
        late = t - rnd.choice([0, 0, 0, 15_000])          # some rows arrive late
        rows.append((i, f"d{rnd.randrange(7)}", late, rnd.uniform(-5, 40), 0.0, 0.0, org, city))
    e = _enriched(spark, rows)
    got = {}
    for r in arrival_window_temperature(e).collect():
        got.setdefault((r.org, r.city), []).append((r.emit_no, r.window_start_ms, r.trigger_ts_ms, r.n,
                                                    round(r.avg_temperature, 9), r.first_id))
    want = {}
    for key in {(r[6], r[7]) for r in rows}:
        seq = [(r[2], r[3], r[1]) for r in rows if (r[6], r[7]) == key]
        want[key] = [(k + 1, s, trig, len(b), round(sum(x[1] for x in b) / len(b), 9), b[0][2])
                     for k, (s, trig, b) in enumerate(arrival_window(seq))]
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    drones = {}
    for r in arrival_window_drones(e).collect():
        drones.setdefault((r.org, r.emit_no), set()).add((r.city, r.id))
    for org in {r[6] for r in rows}:
        seq = [(r[2], r[7], r[1]) for r in rows if r[6] == org]
        for k, (_s, _t, b) in enumerate(arrival_window(seq)):
            assert drones[(org, k + 1)] == {(x[1], x[2]) for x in b}


def _random_rows(seed, n, steps, lateness, orgs=2):
    rnd, rows, t = random.Random(seed), [], 0
    for i in range(n):
        t += rnd.choice(steps)
        rows.append((i, f"d{rnd.randrange(5)}", t - rnd.choice(lateness), rnd.uniform(-5, 40), 0.0, 0.0,
                     f"Org {rnd.randrange(orgs)}", rnd.choice("ab")))
    return rows


def test_late_rows_in_small_buckets(spark):
    """Rows many slides late, so that counts at a bucket's start are not known from bounds alone."""
    for seed, steps, lateness in ((1, [200, 1_000, 3_000], [0, 5_000, 45_000, 300_000]), (2, [0, 11_000, 60_000], [0, 0, 100_000])):
        rows = _random_rows(seed, 400, steps, lateness)
        got = {}
        for r in arrival_window_drones(_enriched(spark, rows), bucket=20).collect():
            got.setdefault((r.org, r.emit_no, r.window_start_ms, r.trigger_ts_ms), []).append((r.city, r.id))
        want = {}
        for org in {r[6] for r in rows}:
            for k, (s, trig, b) in enumerate(arrival_window([(r[2], r[7], r[1]) for r in rows if r[6] == org])):
                want[(org, k + 1, s, trig)] = sorted({(x[1], x[2]) for x in b})
        assert {k: sorted(v) for k, v in got.items()} == want


def test_step_functions_of_ladders(spark):
    """The bounds, break points and counts of the ladder against a plain loop, over every bucket size."""
    from pyspark.sql import functions as F
    from skyledger.operators.ladder import counts_before
    rnd = random.Random(4)
    log = [("k%d" % (i % 3), i, rnd.choice([-2, 0, 1, 2, 3, i // 9, i // 9, i // 20])) for i in range(360)]
    want, k = {}, {}
    for key, i, c in log:
        want[i] = k.get(key, 0)
        k[key] = want[i] + (want[i] < c)
    df = spark.createDataFrame(log, "key string, i long, c long")
    for size in (7, 1000):
        buckets = (df.groupBy("key", F.floor(F.col("i") / size).alias("b"))
                   .agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("rows")))
        out = counts_before(buckets, ["key"], "b", "rows", {"k": lambda r: r["c"], "k2": lambda r: r["c"] - 1})
        got = out.select(F.explode(F.arrays_zip("rows", "k", "k2")).alias("z")).select("z.rows.i", "z.k", "z.k2").collect()
        assert len(got) == len(log) and all(want[r.i] == r.k for r in got)


def test_null_rows_and_temperatures(spark):
    rows = [(0, "d", 0, 1.0, 0.0, 0.0, "Org 1", "c"), (1, "d", None, 5.0, 0.0, 0.0, "Org 1", "c"), (2, "d", 10, None, 0.0, 0.0, "Org 1", "c"),
            (3, "d", 60_001, 4.0, 0.0, 0.0, "Org 1", "c"), (4, "d", 60_002, 4.0, 0.0, 0.0, None, "c"), (5, "d", 200_000, None, 0.0, 0.0, "Org 1", "c")]
    out = sorted(arrival_window_temperature(_enriched(spark, rows)).collect(), key=lambda r: r.emit_no)
    assert [(r.n, r.avg_temperature, r.first_ts_ms) for r in out] == [(3, 2.5, 0), (3, 4.0, 10)]
    empty = _enriched(spark, [])
    assert arrival_window_temperature(empty).count() == arrival_window_drones(empty).count() == 0


def test_no_python_in_the_plan(spark):
    e = _enriched(spark, _random_rows(1, 30, [1_000], [0]))
    for df in (arrival_window_temperature(e), arrival_window_drones(e)):
        assert "Python" not in df._jdf.queryExecution().toString() and "Pandas" not in df._jdf.queryExecution().toString()

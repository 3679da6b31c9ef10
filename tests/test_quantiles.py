import math
import random

from pyspark.sql import functions as F

from skyledger.operators import quantiles as Q
from skyledger.operators import summaries as S
from tests.folds import java_hash

QS = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]


def _rows(seed, n=500):
    rnd = random.Random(seed)
    draw = [lambda: rnd.randrange(20), lambda: rnd.randrange(-5000, 100_000), lambda: int(10 ** rnd.uniform(0, 15)), lambda: 7, lambda: None]
    return [(rnd.choice("ab"), i % 4, rnd.choices(draw, [4, 4, 4, 8, 1])[0]()) for i in range(n)] + [("none", 0, None)]


def _exact(values, q):
    values = sorted(values)
    return values[max(math.ceil(q * len(values)), 1) - 1]


def test_exact_quantiles_and_sketch_bounds(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "kind string, w int, v long").repartition(3)
    values = {k: [r[2] for r in rows if r[0] == k and r[2] is not None] for k in "ab"}
    got = {r.kind: r.asDict() for r in Q.exact_quantiles(df, ["kind"], "v", QS).collect()}
    assert set(got) == {"a", "b"}
    for k, vs in values.items():
        assert got[k] == {"kind": k, "n": len(vs), **{n: _exact(vs, q) for q, n in zip(QS, ("p0", "p1", "p50", "p95", "p99", "p100"))}}
    # sketches kept per window, then added up, bound every quantile closely
    kept = Q.histogram(df, ["kind", "w"], "v")
    for r in Q.bounds(Q.merged(kept, ["kind"]), ["kind"], QS).collect():
        want = _exact(values[r.kind], r.q)
        assert r.low <= want <= r.high and r.high - r.low <= max(abs(r.low), abs(r.high)) / 64
    assert kept.count() < len(rows) and Q.exact_quantiles(df.where("v is null"), ["kind"], "v", QS).count() == 0


def test_bins_grow_with_the_value(spark):
    values = sorted({s * (2 ** e + d) for e in range(0, 62) for d in (-1, 0, 1, 5) for s in (1, -1)} | set(range(-300, 300)))
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", Q.bin_of(F.col("v")).alias("b")).orderBy("v").collect()
    assert all(r.b <= r.v and r.v - r.b <= abs(r.v) / 63 for r in got)
    assert all(a.b <= b.b for a, b in zip(got, got[1:]))


def test_admission_by_first_arrival(spark):
    rnd = random.Random(3)
    rows = [(i // 3, i % 3, f"d{i % 5}", 0, 1.0, 0.0, 0.0, f"Org {rnd.randrange(12)}", f"c{rnd.randrange(9)}") for i in range(400)]
    e = spark.createDataFrame(rows, "arrival_seq long, arrival_pos int, id string, ts_ms long, temperature double, "
                                    "lat double, lon double, org string, city string").repartition(3)
    for keys, limit in ((["org", "city"], 7), (["org"], 1), (["org", "city"], 1000), (["org"], 0)):
        admitted, first = {}, {}
        for r in sorted(rows):
            g = tuple(r[7:9] if len(keys) == 2 else r[7:8])
            if g not in first:
                h = java_hash(r[7])
                worker = abs(h) % 4 if h >= 0 else abs(-(abs(h) % 4))
                first[g] = worker
                admitted[g] = sum(first[x] == worker for x in first) <= limit
        kept, refused = S.admitted_rows(e, keys, limit, workers=4)
        want = sorted(r[:2] for r in rows if admitted[tuple(r[7:9] if len(keys) == 2 else r[7:8])])
        assert sorted((r.arrival_seq, r.arrival_pos) for r in kept.collect()) == want
        assert kept.count() + refused.count() == len(rows)
        assert all(not admitted[(r.org, r.city) if len(keys) == 2 else (r.org,)] for r in refused.collect())


def test_exact_quantiles_work_the_numbers_out_once(spark):
    df = spark.range(1, 1001).select(F.lit("a").alias("kind"), F.col("id").alias("v"))
    got = Q.exact_quantiles(df, ["kind"], "v", QS)
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r.asDict() for r in got.collect()][0]["n"] == 1000

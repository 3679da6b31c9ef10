import random

import pytest

from skyledger.operators import panes as P
from skyledger.operators import summaries as S

SCHEMA = ("arrival_seq long, id string, ts_ms long, temperature double, lat double, lon double, org string, city string")


def _rows(seed, n=300, span=400_000):
    rnd = random.Random(seed)
    return [(i, f"d{rnd.randrange(6)}", rnd.choice([rnd.randrange(-span, span), 10_000 * rnd.randrange(40), 59_999]),
             rnd.choice([None, rnd.uniform(-5, 40), rnd.uniform(-5, 40)]), rnd.random(), rnd.random(), f"Org {rnd.randrange(3)}", rnd.choice("abc"))
            for i in range(n)] + [(n, "d0", None, 1.0, 0.0, 0.0, "Org 0", "a")]


def _members(rows, window, slide):
    """(org, city, window start) -> its rows, by the definition."""
    out = {}
    for r in rows:
        if r[2] is None:
            continue
        k = r[2] // slide
        while k * slide + window > r[2]:
            out.setdefault((r[6], r[7], k * slide), []).append(r)
            k -= 1
    return out


@pytest.mark.parametrize("window, slide", [(60_000, 10_000), (60_000, 25_000), (10_000, 10_000), (10_000, 40_000)])
def test_windows_equal_brute_force(spark, window, slide):
    rows = _rows(window + slide)
    e = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = (f"{window // 1000} seconds", f"{slide // 1000} seconds")
    members = _members(rows, window, slide)
    got = {}
    for r in S.avg_city_temperature(e, *names).collect():
        assert r.window_end_ms == r.window_start_ms + window
        avg = None if r.avg_temperature is None else round(r.avg_temperature, 9)
        got[(r.org, r.city, r.window_start_ms)] = (avg, r.n, r.first_id, r.first_ts_ms, r.first_lat, r.first_lon)
    want = {}
    for key, rs in members.items():
        t = [r[3] for r in rs if r[3] is not None]
        f = min(rs)
        want[key] = (round(sum(t) / len(t), 9) if t else None, len(rs), f[1], f[2], f[4], f[5])
    assert got == want
    per_city = S.drones_per_city(e, *names)
    d3 = [(r.org, r.city, r.window_start_ms, r.id) for r in per_city.collect()]
    assert sorted(d3) == sorted({(*k, r[1]) for k, rs in members.items() for r in rs})
    d2 = [(r.org, r.window_start_ms, r.id) for r in S.drones_per_org(e, *names).collect()]
    assert sorted(d2) == sorted({(k[0], k[2], r[1]) for k, rs in members.items() for r in rs})
    for newest, latest in ((S.newest_city_temperature(e, *names), S.latest_city_temperature(S.avg_city_temperature(e, *names))),
                           (S.newest_drone_summary(e, *names), S.latest_drone_summary(per_city))):
        def rounded(df):
            return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect()), key=str)
        assert rounded(newest) == rounded(latest)


def test_shuffled_rows_do_not_depend_on_the_window(spark):
    """No exchange stands above the point where windows are made."""
    e = spark.createDataFrame(_rows(1), SCHEMA)
    for df in (S.avg_city_temperature(e, "600 seconds", "10 seconds"), S.drones_per_city(e, "600 seconds", "10 seconds")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        made = plan.index("Generate explode")
        assert "Exchange" not in plan[:made] and "Exchange" in plan[made:]


def test_durations():
    assert P.duration_ms("60 seconds") == P.duration_ms("1 minute") == 60_000
    assert P.duration_ms("1 hour 30 minutes") == 5_400_000 and P.duration_ms("250 milliseconds") == 250
    for bad in ("", "soon", "5 parsecs", "x 5 seconds"):
        with pytest.raises(ValueError):
            P.duration_ms(bad)


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert all(f(e).count() == 0 for f in (S.avg_city_temperature, S.drones_per_org, S.drones_per_city, S.newest_city_temperature, S.newest_drone_summary))

import os
import random

from pyspark.sql import functions as F

from skyledger.operators import summaries as S
from skyledger.streaming.change_log import BUCKET, ChangeLog, Run
from skyledger.streaming.state_tables import StateTables

SCHEMA = "org string, key long, n long"


def _log(path, fan=3):
    return ChangeLog(path, SCHEMA, lambda rows: rows.groupBy("org", "key").agg(F.sum("n").alias("n")), fan=fan, buckets=4)


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_reads_equal_sums_after_every_batch_and_runs_stay_few(spark, scratch):
    rnd, log, total, bytes_of = random.Random(1), _log(scratch + "/t"), {}, []
    for batch in range(14):
        rows = [(f"Org {rnd.randrange(5)}", batch * 100 + i % 4, 1) for i in range(20)]
        for org, key, n in rows:
            total[(org, key)] = total.get((org, key), 0) + n
        df = spark.createDataFrame(rows, SCHEMA)
        log.add(df, batch)
        if os.path.isdir(f"{scratch}/t/0-{batch}-{batch}"):
            bytes_of.append(_size(f"{scratch}/t/0-{batch}-{batch}"))
        got = {(r.org, r.key): r.n for r in log.read(spark).collect()}
        assert got == total
        live = log.live(spark)
        assert [r.first for r in live] == [0] + [r.last + 1 for r in live[:-1]] and live[-1].last == batch
        assert len(live) <= 2 * 3 and len(log.complete(spark)) <= 12
        if batch in (4, 9):   # a replay of this batch, and of one merged long ago
            log.add(df, batch)
            log.add(spark.createDataFrame([("Org 0", 0, 50)], SCHEMA), 0)
            assert {(r.org, r.key): r.n for r in log.read(spark).collect()} == total
    assert max(bytes_of) < 1.5 * min(bytes_of)   # bytes of a batch's run follow the batch, not the table
    assert log.live(spark)[0] == Run(2, 0, 8)


def test_an_unfinished_run_is_not_read_and_is_written_again(spark, scratch):
    log = _log(scratch + "/t", fan=2)
    log.add(spark.createDataFrame([("a", 1, 1)], SCHEMA), 0)
    os.makedirs(scratch + "/t/0-1-1")   # a crash before _SUCCESS
    os.makedirs(scratch + "/t/1-0-1")
    assert [tuple(r) for r in log.read(spark).collect()] == [("a", 1, 1)]
    log.add(spark.createDataFrame([("a", 1, 2)], SCHEMA), 1)
    assert [tuple(r) for r in log.read(spark).collect()] == [("a", 1, 3)] and log.live(spark) == [Run(1, 0, 1)]


def test_lookup_reads_requested_folders_only(spark, scratch):
    log = _log(scratch + "/t")
    log.add(spark.createDataFrame([(f"Org {i}", i, 1) for i in range(20)], SCHEMA), 0)
    asked = spark.createDataFrame([("Org 3",), ("Org 3",), ("nobody",)], "org string")
    df = log.read(spark, asked)
    assert [tuple(r) for r in df.collect()] == [("Org 3", 3, 1)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [{BUCKET}" in plan.replace("isnotnull(bucket#", "bucket#") or BUCKET in plan.split("PartitionFilters")[1].split("]")[0]
    assert log.read(spark, asked.where("org = 'none'")).count() == 0
    assert _log(scratch + "/none").read(spark).count() == 0


def test_late_rows_correct_every_table(spark, scratch):
    """Batches in any order of time: each table equals the batch summary of all rows so far."""
    rnd = random.Random(2)
    rows = [(i, 0, f"d{rnd.randrange(5)}", rnd.randrange(400_000), rnd.choice([None, rnd.uniform(-5, 40)]), rnd.random(), rnd.random(),
             f"Org {rnd.randrange(2)}", rnd.choice("ab")) for i in range(200)]
    schema = ("arrival_seq long, arrival_pos int, id string, ts_ms long, temperature double, lat double, lon double, org string, city string")
    tables, order = StateTables(scratch + "/s", fan=2), rnd.sample(rows, len(rows))
    for batch in range(4):
        df = spark.createDataFrame(order[50 * batch:50 * batch + 50], schema)
        tables.add_temperatures(df, batch)
        tables.add_drones(df, batch)
    tables.add_temperatures(df, 3)   # replays
    tables.add_drones(df, 3)
    e = spark.createDataFrame(rows, schema)
    temps, per_city = S.avg_city_temperature(e, order_cols=("arrival_seq", "arrival_pos")), S.drones_per_city(e)
    want = {"city_temperature_windows": temps, "drones_per_city_windows": per_city,
            "latest_city_temperature": S.latest_city_temperature(temps), "latest_drone_summary": S.latest_drone_summary(per_city)}
    for name, df in want.items():
        def rounded(x):
            return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.select(sorted(df.columns)).collect()), key=str)
        assert rounded(tables.read(spark, name)) == rounded(df), name
        one = e.where("org = 'Org 1'").select("org")
        assert tables.read(spark, name, one).count() == df.where("org = 'Org 1'").count() > 0

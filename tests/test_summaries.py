
from pyspark.sql import functions as F

from skyledger.operators import lookups as G
from skyledger.operators import summaries as S


def _enriched(spark, rows):
    return spark.createDataFrame(
        rows, "arrival_seq long, id string, ts_ms long, temperature double, lat double, lon double, "
              "org string, city string")


def test_sliding_windows_edges(spark):
    # rows at t = 0, 60 s, 65 s: 6 windows each, [start, end)
    rows = [(1, "d1", 0, 10.0, 0.0, 0.0, "Org 1", "c"), (2, "d2", 60_000, 20.0, 0.0, 0.0, "Org 1", "c"),
            (3, "d1", 65_000, 30.0, 0.0, 0.0, "Org 1", "c")]
    t = S.avg_city_temperature(_enriched(spark, rows))
    got = {r.window_start_ms: (r.n, r.avg_temperature, r.first_id) for r in t.collect()}
    assert got[0] == (1, 10.0, "d1")            # 60 s is outside [0, 60 s)
    assert got[10_000] == (2, 25.0, "d2")
    assert got[60_000] == (2, 25.0, "d2")
    assert len(got) == 12
    latest = S.latest_city_temperature(t).first()
    assert latest.window_end_ms == 120_000 and latest.avg_temperature == 25.0


def test_drone_summaries_and_lookups(spark):
    rows = [(1, "d1", 0, 1.0, 0.0, 0.0, "Org 1", "a"), (2, "d2", 1_000, 1.0, 0.0, 0.0, "Org 1", "b"),
            (3, "d1", 2_000, 1.0, 0.0, 0.0, "Org 1", "b"), (4, "d3", 200_000, 1.0, 0.0, 0.0, "Org 1", "b"),
            (5, "d9", 0, 7.0, 0.0, 0.0, "Org 2", "z")]
    e = _enriched(spark, rows)
    per_city = S.drones_per_city(e)
    latest = S.latest_drone_summary(per_city)
    # Org 1's newest window only holds d3 in b: city a vanished (whole value replaced)
    assert sorted((r.org, r.city, r.id) for r in latest.collect()) == [("Org 1", "b", "d3"), ("Org 2", "z", "d9")]
    temps = S.latest_city_temperature(S.avg_city_temperature(e))
    req = spark.createDataFrame([("Org 1",), ("Org 7",)], "org string")
    cities = {r.org: r.cities for r in G.get_cities_lists(req, temps).collect()}
    assert cities == {"Org 1": ["a", "b"], "Org 7": []}
    tr = spark.createDataFrame([("Org 1", "a"), ("Org 7", "a")], "org string, city string")
    temp = {(r.org, r.city): r.cityTemperature for r in G.get_temperature(tr, temps).collect()}
    assert temp == {("Org 1", "a"): 1.0, ("Org 7", "a"): None}
    ds = G.get_drone_summary(req, latest).collect()
    assert sorted((r.org, r.city, r.id) for r in ds) == [("Org 1", "b", "d3"), ("Org 7", None, None)]
    sets = S.drone_summary_sets(latest).where("org = 'Org 1'").first()
    assert sets.droneIds == ["d3"] and sets.dronesPerCity == {"b": ["d3"]}
    assert {r.org: r.num_cities for r in S.num_cities(temps).collect()} == {"Org 1": 2, "Org 2": 1}
    guard = S.group_limit_guard(e, max_org_city=2).first()
    assert guard.org_city_groups == 3 and guard.within_limits is False


def test_latest_city_temperature_ttl(spark, scratch):
    from skyledger.streaming.state_tables import StateTables
    cols = "org string, city string, k long, total double, n_temperature long, n long"
    tables = StateTables(scratch + "/state")
    tables.city_latest.add(spark.createDataFrame([("Org 1", "a", 0, 1.0, 1, 1), ("Org 1", "b", 0, 2.0, 1, 1)], cols), 0)
    tables.city_latest.add(spark.createDataFrame([("Org 1", "a", 50, 6.0, 2, 2)], cols), 1)
    keep = {r.city: r.avg_temperature for r in tables.read(spark, "latest_city_temperature").collect()}
    assert keep == {"a": 3.0, "b": 2.0}          # stale city kept (reference behaviour)
    assert {r.city for r in tables.read(spark, "latest_city_temperature", ttl_ms=100_000).collect()} == {"a"}


def test_org_report_and_fan_out(spark):
    rows = [(1, "d1", 0, 10.0, 0.0, 0.0, "Org 1", "a"), (2, "d2", 1_000, 20.0, 0.0, 0.0, "Org 1", "a"),
            (3, "d3", 2_000, 30.0, 0.0, 0.0, "Org 1", "b"), (4, "d9", 0, 7.0, 0.0, 0.0, "Org 2", "z")]
    e = _enriched(spark, rows)
    outs = S.fan_out(e)
    assert set(outs) == {"city_temperature", "drones_per_city"}
    temps = S.latest_city_temperature(outs["city_temperature"])
    latest = S.latest_drone_summary(outs["drones_per_city"])
    rep = {(r.org, r.city): (r.temperature, r.city_drone_count, r.drone_count)
           for r in S.org_report(temps, latest).collect()}
    assert rep == {("Org 1", "a"): (15.0, 2, 3), ("Org 1", "b"): (30.0, 1, 3), ("Org 2", "z"): (7.0, 1, 1)}


def test_city_lists_of_many_requests_are_dealt_over_tasks(spark):
    temps = spark.createDataFrame([("A", "b"), ("A", "a"), ("A", "a"), ("B", "c"), ("C", "d"), (None, "e")], "org string, city string")
    asked = {"A": 3 * G.REPLIES_PER_LIST, "B": G.REPLIES_PER_LIST + 1, "Z": 2, None: 3}
    req = spark.createDataFrame([(o, n) for o, n in asked.items()], "org string, n int").select(
        "org", F.explode(F.sequence(F.lit(1), "n")).alias("request"))
    got = G.get_cities_lists(req, temps, separator="|")
    assert {(r.org, r.cities): r["count"] for r in got.groupBy("org", "cities").count().collect()} == {
        ("A", "a|b"): asked["A"], ("B", "c"): asked["B"], ("Z", ""): 2, (None, ""): 3}
    of_a = got.where("org = 'A'").groupBy(F.spark_partition_id()).count().collect()
    assert len(of_a) > 1 and sum(r["count"] for r in of_a) == asked["A"]
    # a reply's text is not put together again for each request
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("array_join")
    lists = {(r.org, tuple(r.cities)) for r in G.get_cities_lists(req, temps).collect()}
    assert lists == {("A", ("a", "b")), ("B", ("c",)), ("Z", ()), (None, ())}


def _below(plan, node):
    """The lines of each ``node`` of a plan with all that lies below it."""
    lines = plan.splitlines()
    depth = [next((i for i, c in enumerate(x) if c.isalpha()), 0) for x in lines]
    for i, line in enumerate(lines):
        if line[depth[i]:].startswith(node):
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_city_lists_are_added_to_one_reply_at_a_time(spark):
    temps = spark.createDataFrame([("A", "b"), ("A", "a")], "org string, city string")
    req = spark.createDataFrame([("A",), ("Z",)], "org string")
    for separator in (None, "|"):
        plan = G.get_cities_lists(req, temps, separator)._jdf.queryExecution().optimizedPlan().toString()
        made = list(_below(plan, "Generate"))   # explode holds all rows that it makes of one
        assert made and not any("collect_set" in x for x in made)


def test_city_lists_of_megabytes_are_stored_once(spark, scratch):
    from pathlib import Path
    from skyledger.plans.registry import QUERIES
    for table, row, cols in (("supplier", (1, "a", 0), "s_suppkey long, s_name string, s_nationkey int"),
                             ("nation", (0, "n", 0), "n_nationkey int, n_name string, n_regionkey int"),
                             ("region", (0, "r"), "r_regionkey int, r_name string"),
                             ("events", (1, 1, 1.0), "event_id long, user_id long, value double")):
        spark.createDataFrame([row], cols).write.parquet(f"{scratch}/{table}.parquet")
    settings = ("parquet.page.size.row.check.min", "parquet.dictionary.page.size")
    before = [spark.conf.get(k, None) for k in settings]
    own = QUERIES["get_cities_lists"](spark, scratch).sparkSession
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    temps = own.range(120_000).select(F.format_string("Org %d", F.col("id") % 2).alias("org"), F.md5(F.col("id").cast("string")).alias("city"))
    req = own.range(80).select(F.format_string("Org %d", F.col("id") % 4).alias("org"))
    G.get_cities_lists(req, temps, separator="|").write.parquet(f"{scratch}/replies")
    got = spark.read.parquet(f"{scratch}/replies").groupBy("org", "cities").count().collect()
    want = {"Org 2": "", "Org 3": ""}
    for org in ("Org 0", "Org 1"):
        want[org] = "|".join(sorted(r.city for r in temps.where(F.col("org") == org).collect()))
    assert {r.org: r.cities for r in got} == want and {r["count"] for r in got} == {20}
    texts = sum(map(len, want.values()))
    assert min(len(want["Org 0"]), len(want["Org 1"])) > 1 << 20   # longer than a dictionary is by default
    assert sum(f.stat().st_size for f in Path(scratch, "replies").glob("*.parquet")) < 1.2 * texts
    assert [spark.conf.get(k, None) for k in settings] == before   # other results are written as ever

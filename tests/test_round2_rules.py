"""Rules that hold whatever is cached, and rows at the edges of a rule."""

import os

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.operators import cart, lookups, metrics
from skyledger.operators.enrich import split_locations
from skyledger.sources.files import read_place_rejects, read_places


def test_intervals_do_not_depend_on_the_cache(spark):
    df = spark.range(400_000).select(
        (F.col("id") * 7919 % 50).cast("string").alias("id"), (F.xxhash64("id") % 1_000_000).alias("ts_ms"),
        F.col("id").alias("arrival_seq"), F.repeat(F.lit("x"), 40).alias("payload"))
    got = metrics.report_intervals(df, partitions=6)
    spark.catalog.clearCache()
    want = df.withColumn("want", F.col("ts_ms") - F.lag("ts_ms").over(W.partitionBy("id").orderBy("ts_ms", "arrival_seq")))
    wrong = got.join(want.select("arrival_seq", "want"), "arrival_seq").where(~F.col("interval_ms").eqNullSafe(F.col("want")))
    assert wrong.count() == 0 and "payload" in got.columns


def test_active_sessions_never_fall_below_zero(spark):
    log = spark.createDataFrame([(f"s{i}", i // 3 * 10, i // 3 * 10 + (i % 3) * 5) for i in range(3000)],
                                "session_id string, start_ms long, end_ms long")
    got = metrics.active_sessions(log, partitions=5)
    spark.catalog.clearCache()
    rows = sorted(got.collect(), key=lambda r: (r.t, -r.delta, r.session_id))
    active = 0
    for r in rows:
        active += r.delta
        assert r.active == active >= 0
    assert active == 0


def test_reconcile_has_every_user(spark):
    schema = "user_id string, product_id string, qty long"
    expected = spark.createDataFrame([("a", "p", 1), ("b", "p", 2), ("d", None, None)], schema)
    actual = spark.createDataFrame([("a", "p", 1), ("b", None, None), ("c", None, None), ("d", None, None)], schema)
    got = {r.user_id: r.matches for r in cart.cart_reconcile(expected, actual).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True}


def test_merge_keeps_the_left_scalars(spark):
    schema = "user_id string, ts long, product_id string, qty long"
    left = spark.createDataFrame([("a", 5, "p", 1)], schema)
    right = spark.createDataFrame([("a", 9, "p", 2), ("a", 9, "q", 1)], schema)
    got = sorted(tuple(r) for r in cart.merge_carts(left, right, scalars=("ts",)).collect())
    assert got == [("a", 5, "p", 3), ("a", 5, "q", 1)]


def test_a_reply_for_each_request(spark):
    known = spark.createDataFrame([("A", "y"), ("A", "x")], "org string, city string")
    got = sorted((r.org, r.cities) for r in lookups.get_cities_lists(spark.createDataFrame([("A",), ("A",), ("Z",)], "org string"), known).collect())
    assert got == [("A", ["x", "y"]), ("A", ["x", "y"]), ("Z", [])]


def test_locations_without_a_place_are_rejected(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, nan, 1.0), (4, 91.0, 0.0), (5, 0.0, nan), (6, -90.0, 180.0)], "k int, lat double, lon double")
    valid, rejects = split_locations(df)
    assert {r.k for r in valid.collect()} == {1, 6} and rejects.count() == 4


def test_place_rows_with_empty_and_bad_fields(spark, scratch):
    def row(i, lat, admin):
        f = [""] * 19
        f[0], f[1], f[4], f[5], f[6], f[8], f[10] = str(i), "Vaduz", lat, "9.5", "P", "LI", admin
        return "\t".join(f)
    with open(os.path.join(scratch, "places.txt"), "w") as out:
        out.write("\n".join([row(1, "47.1", ""), row(2, "north", "01"), row(3, "47.2", "01")]))
    got = {r.place_id: r.province for r in read_places(spark, scratch).collect()}
    assert got == {1: "", 3: "01"}
    assert [r.geonameid for r in read_place_rejects(spark, scratch).collect()] == ["2"]


def test_refused_commit_keeps_items_and_moves_the_version(spark):
    events = spark.createDataFrame(
        [("u", 1, 10, "add", ["1"], None, True), ("u", 2, 20, "commit", None, 10, False),
         ("u", 3, 30, "commit", None, 10, True), ("u", 4, 40, "commit", None, 20, None)],
        "user_id string, seq long, ts_ms long, action string, product_ids array<string>, commit_ts long, auth_ok boolean")
    from skyledger.sources.catalog import builtin_catalog
    got = cart.commit_outcomes(cart.cart_epochs(events, builtin_catalog(spark))).collect()
    assert {r.seq: r.outcome for r in got} == {2: "CartCommitFailed", 3: "CartOutOfDate", 4: "CartCommitted"}

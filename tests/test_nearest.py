import random
import re

from skyledger.operators.nearest import fine_cell_size, nearest_place
from tests.folds import nearest


def _places(rnd, n):
    rows = [(i + 1, round(rnd.uniform(-90, 90), 4), round(rnd.uniform(-180, 180), 4)) for i in range(n)]
    rows += [(n + 1, 90.0, 0.0), (n + 2, -90.0, 45.0), (n + 3, 10.0, 180.0), (n + 4, 10.0, -180.0),
             (n + 5, 33.0, 44.0), (n + 6, 33.0, 44.0)]   # poles, antimeridian, a tie at one spot
    return rows


def _run(spark, points, places, **kw):
    pdf = spark.createDataFrame(points, "k long, lat double, lon double")
    pl = spark.createDataFrame([(p, la, lo, f"n{p}", "prov", "ctry") for p, la, lo in places],
                               "place_id long, lat double, lon double, name string, province string, country string")
    out = nearest_place(pdf, pl, **kw)
    return {r.k: r.place_id for r in out.select("k", "place_id").collect()}


def test_grid_equals_brute_force(spark):
    rnd = random.Random(11)
    places = _places(rnd, 300)
    pts = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(700)]
    pts += [(10_000, 89.9999, 170.0), (10_001, -89.99, -3.0), (10_002, 10.0, 179.9999),
            (10_003, 10.0, -179.9999), (10_004, 33.0, 44.0), (10_005, 33.0, 44.0)]
    expect = nearest(pts, places)
    # default; everything through the descent; tiny leaves; coarse fast path
    for kw in ({}, {"max_candidates": 0}, {"max_candidates": 0, "leaf_size": 1},
               {"fine_cell": 0.3}, {"fine_cell": 0.01, "leaf_size": 4}):
        got = _run(spark, pts, places, **kw)
        assert got == expect, kw
    assert expect[10_004] == 305   # tie at one spot: lowest id


def test_clustered_places_and_far_points(spark):
    rnd = random.Random(5)
    # a dense cluster plus a few scattered places; points everywhere and inside the cluster
    places = [(i + 1, 48 + rnd.random() * 0.01, 2 + rnd.random() * 0.01) for i in range(400)]
    places += [(1000 + i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(5)]
    pts = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(150)]
    pts += [(500 + i, 48 + rnd.random() * 0.01, 2 + rnd.random() * 0.01) for i in range(100)]
    expect = nearest(pts, places)
    assert _run(spark, pts, places) == expect
    assert _run(spark, pts, places, leaf_size=2, max_candidates=8) == expect


def test_null_coordinates_and_duplicates(spark):
    places = [(1, 0.0, 0.0), (2, 0.0, 10.0)]
    pts = [(1, 0.0, 1.0), (2, 0.0, 1.0), (3, None, 1.0), (4, 0.0, 9.0)]
    got = _run(spark, pts, places)
    assert got == {1: 1, 2: 1, 3: None, 4: 2}


def test_fine_cell_size():
    assert fine_cell_size(1) == 0.5
    assert 0.009 < fine_cell_size(150_000) < 0.0095


def test_far_points_meet_few_places(spark):
    """Places only in a small region, points on the other side of the
    sphere: the descent must not pair every point with every place."""
    from pyspark.sql import functions as F
    from skyledger.operators import nearest as N
    rnd = random.Random(8)
    places = [(i + 1, 40 + rnd.random() * 5, 10 + rnd.random() * 5) for i in range(2000)]
    pts = [(i, -40 - rnd.random() * 5, -170 + rnd.random() * 5) for i in range(50)]
    assert _run(spark, pts, places) == nearest(pts, places)
    pl = spark.createDataFrame(places, "place_id long, lat double, lon double").select(
        "place_id", *N.unit_sphere_point(F.col("lat"), F.col("lon"), "p"))
    rem = spark.createDataFrame(pts, "k long, _lat double, _lon double").select(
        "_lat", "_lon", *N.unit_sphere_point(F.col("_lat"), F.col("_lon"), "q"))
    depth = N.pyramid_depth(pl, 32)
    out = N._descend(rem, pl, depth, 32, True)
    assert out.count() == 50
    cand = N._descend(rem, pl, depth, 32, True, candidates=True).count()
    assert cand < 50 * 2000 / 4, cand           # antipodal: nearly equidistant, still pruned
    # far but not antipodal: few candidates per point
    pts2 = [(i, -10 - rnd.random() * 5, -120 + rnd.random() * 5) for i in range(50)]
    rem2 = spark.createDataFrame(pts2, "k long, _lat double, _lon double").select(
        "_lat", "_lon", *N.unit_sphere_point(F.col("_lat"), F.col("_lon"), "q"))
    cand2 = N._descend(rem2, pl, depth, 32, True, candidates=True).count()
    assert cand2 < 50 * 200, cand2
    assert _run(spark, pts2, places) == nearest(pts2, places)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_candidates_are_neither_sorted_nor_shuffled(spark):
    pts = spark.createDataFrame([(1, 0.0, 1.0)], "k long, lat double, lon double")
    pl = spark.createDataFrame([(1, 0.0, 0.0, "a", "p", "c")], "place_id long, lat double, lon double, name string, province string, country string")
    plan = nearest_place(pts, pl)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortAggregate\(key=\[_lat#\d+, _lon#\d+, qx", plan) and "array_min" in plan

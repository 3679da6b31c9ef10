import json
import os


from skyledger.operators.enrich import (country_filter, flatten_measurements, major_only,
                                        pack_measurements)
from skyledger.sources import fixtures as FX
from skyledger.sources.catalog import builtin_catalog
from skyledger.sources.files import read_packets, read_places, split_packets, write_places_tsv
from skyledger.sources.sinks import latest_by, to_json_rows
from tests.conftest import SF001


def test_places_tsv_round_trip(spark, scratch):
    places = FX.places(spark, SF001)
    path = os.path.join(scratch, "places")
    write_places_tsv(places, path)
    with open(os.path.join(path, "readme.txt"), "w") as f:
        f.write("not\ta\tplace\n")
    back = read_places(spark, path)
    cols = ["place_id", "name", "province", "country", "feature_class", "lat", "lon"]
    assert sorted(back.select(cols).collect()) == sorted(places.select(cols).collect())
    major = read_places(spark, path, major_only=True)
    assert major.count() == places.where("feature_class = 'P'").count()


def test_place_filters(spark):
    p = FX.places(spark, SF001)
    assert country_filter(p, []).count() == p.count()
    assert country_filter(p, None).count() == p.count()
    assert country_filter(p, ["ASIA"]).count() == p.where("country = 'ASIA'").count()
    assert major_only(p, False).count() == p.count()


def test_packets_rejects_and_flatten(spark, scratch):
    path = os.path.join(scratch, "packets")
    os.makedirs(path)
    good = {"id": "drone-1", "timestamp": 5, "measurements": [
        {"timestamp": 3, "temperature": 1.5, "location": {"lat": 1.0, "lon": 2.0}},
        {"timestamp": 4, "temperature": 2.5, "location": {"lat": 1.5, "lon": 2.5}}]}
    empty = {"id": "drone-2", "timestamp": 6, "measurements": []}
    no_id = {"timestamp": 7, "measurements": [
        {"timestamp": 1, "temperature": 1.0, "location": {"lat": 0.0, "lon": 0.0}}]}
    with open(os.path.join(path, "p.json"), "w") as f:
        for obj in (good, empty, no_id):
            f.write(json.dumps(obj) + "\n")
        f.write("{not json\n")
    valid, rejected = split_packets(read_packets(spark, path))
    assert sorted(r.reason for r in rejected.collect()) == ["malformed", "null id"]
    flat = flatten_measurements(valid)
    rows = sorted((r.id, r.ts_ms, r.temperature) for r in flat.collect())
    assert rows == [("drone-1", 3, 1.5), ("drone-1", 4, 2.5)]   # empty list -> no rows


def test_pack_then_flatten_is_identity(spark):
    m = FX.measurements(spark, SF001)
    f = flatten_measurements(pack_measurements(m))
    a = f.select("id", "ts_ms", "lat", "lon").exceptAll(m.select("id", "ts_ms", "lat", "lon"))
    assert a.count() == 0 and f.count() == m.count()


def test_json_keeps_null_and_catalog(spark):
    df = spark.createDataFrame([("org1", "city1", None), ("org1", "city2", 1.1)],
                               "org string, city string, cityTemperature double")
    out = sorted(r.json for r in to_json_rows(df).collect())
    assert out[0] == '{"org":"org1","city":"city1","cityTemperature":null}'
    assert out[1] == '{"org":"org1","city":"city2","cityTemperature":1.1}'
    cat = builtin_catalog(spark)
    assert cat.count() == 10 and cat.where("id = '10'").first().unit_price == 347.0


def test_latest_by_last_write_wins(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 30.0), ("b", 2, 5.0)], "k string, t long, v double")
    got = {r.k: r.v for r in latest_by(df, ["k"], "t").collect()}
    assert got == {"a": 30.0, "b": 5.0}


def test_parse_packets_from_strings_and_send_errors(spark):
    from skyledger.operators.metrics import send_errors, send_stats
    from skyledger.sources.files import parse_packets
    raw = spark.createDataFrame([
        ('{"id": "d1", "timestamp": 9, "measurements": [{"timestamp": 1, "temperature": 2.0, '
         '"location": {"lat": 0.0, "lon": 0.0}}]}',),
        ('{"timestamp": 9, "measurements": []}',),
        ("not json",)], "value string")
    valid, rejected = split_packets(parse_packets(raw))
    assert [r.id for r in valid.collect()] == ["d1"]
    errs = {r.error: r.errors for r in send_errors(rejected).collect()}
    assert errs == {"malformed": 1, "null id": 1}
    st = send_stats(valid).first()
    assert (st.id, st.packets, st.measurements_sent, st.last_batch_size) == ("d1", 1, 1, 1)

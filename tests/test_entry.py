import __spark_entry__ as E

NO_ORACLE = set()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["org", "city", "cityTemperature"]
    assert df.count() > 0


def test_registry_and_oracles():
    from skyledger.plans.registry import QUERIES
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and set(QUERIES) <= set(q)
    assert set(QUERIES) - set(o) == NO_ORACLE


def test_sample_places_is_a_seeded_top_k(spark):
    a = E.queries()["sample_places"](spark, "/root/testdata/sf0.01")
    b = E.queries()["sample_places"](spark, "/root/testdata/sf0.01")
    assert a.count() == 20 and sorted(a.collect()) == sorted(b.collect())

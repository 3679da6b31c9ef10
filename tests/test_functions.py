import random


from skyledger.functions import assign_org, java_string_hash, qualified_name
from tests.folds import java_hash, org_of


def test_java_hash_matches_jvm_rule(spark):
    rnd = random.Random(3)
    alphabet = "abcXYZ-_09 éü中😀"
    words = ["", "a", "drone-1", "polygenelubricants", "Aa", "BB"] + [
        "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = {r.s: r.h for r in df.select("s", java_string_hash("s").alias("h")).collect()}
    for w in words:
        assert got[w] == java_hash(w), w
    # known JVM values
    assert got["Aa"] == got["BB"] == 2112
    assert got["polygenelubricants"] == -(2 ** 31)


def test_assign_org_abs_after_mod(spark):
    ids = [f"drone-{i}" for i in range(300)] + ["polygenelubricants"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: r.org for r in df.select("id", assign_org("id").alias("org")).collect()}
    for i in ids:
        assert got[i] == org_of(i)
    assert got["polygenelubricants"] == "Org 8"   # -2^31 % 20 = -8 -> 8


def test_qualified_name_prints_null(spark):
    df = spark.createDataFrame([("Paris", None, "FR")], "n string, p string, c string")
    assert df.select(qualified_name("n", "p", "c")).first()[0] == "Paris, null FR"

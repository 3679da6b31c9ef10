"""Stand-in inputs built from the driver's test tables.

These views only shape rows into the schemas the jobs expect (see
FIXTURES.md section 2); they do none of the jobs' work.  The integer
arithmetic is the same in the DuckDB oracle text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EPOCH_MS = 1704067200000   # 2024-01-01T00:00:00Z
CLOCK_MS = 200             # dense clock: one event every 200 ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat measurements: arrival_seq, id, ts_ms, temperature, lat, lon."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("arrival_seq"),
        F.concat(F.lit("drone-"), F.col("user_id").cast("string")).alias("id"),
        (F.lit(EPOCH_MS) + F.col("event_id") * CLOCK_MS).alias("ts_ms"),
        F.col("value").cast("double").alias("temperature"),
        ((F.col("user_id") * 37 + F.col("event_id") * 7) % 18000).cast("double") / 100 - 90,
        ((F.col("user_id") * 91 + F.col("event_id") * 13) % 36000).cast("double") / 100 - 180,
    ).toDF("arrival_seq", "id", "ts_ms", "temperature", "lat", "lon")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places: place_id, name, province, country, feature_class, lat, lon."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey)
             .select(
                 F.col("s_suppkey").alias("place_id"),
                 F.col("s_name").alias("name"),
                 F.col("n_name").alias("province"),
                 F.col("r_name").alias("country"),
                 F.when(F.col("s_suppkey") % 3 == 0, "A").otherwise("P").alias("feature_class"),
                 (((F.col("s_suppkey") * 7919) % 18000).cast("double") / 100 - 90).alias("lat"),
                 (((F.col("s_suppkey") * 104729) % 36000).cast("double") / 100 - 180).alias("lon")))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product catalog from ``part``: id, name, description, category, unit_price."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.col("p_brand").alias("category"),
        F.col("p_retailprice").cast("float").alias("unit_price"))


def cart_events(spark: SparkSession, sf_dir: str, auth: str = "ok") -> DataFrame:
    """Cart commands from ``events``.

    click/view add (a view adds two of one id), signup clears, purchase and
    error commit; an error commit carries a stale version.  ``auth`` is
    ``"ok"`` (every commit authenticated) or ``"seq7"`` (refused when
    ``seq % 7 == 0``).
    """
    from skyledger.operators.prefix import bucketed_running
    e = table(spark, sf_dir, "events")
    b = e.select(
        F.col("user_id"),
        F.col("event_id").alias("seq"),
        (F.lit(EPOCH_MS) + F.col("event_id") * CLOCK_MS).alias("ts_ms"),
        F.col("event_type"),
        F.when(F.col("event_type").isin("click", "view"), "add")
         .when(F.col("event_type") == "signup", "clear").otherwise("commit").alias("action"),
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("x-"), F.col("event_id").cast("string")))
         .otherwise(((F.col("event_id") * 31) % 200).cast("string")).alias("product_id"),
        F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2)
         .otherwise(0).alias("qty"))
    # Running max of add times per user (only read on commit rows, whose own
    # value is null, so "rows before" equals "rows up to"), bucketed by seq
    # so a busy user is not one window partition.
    b = b.withColumn("_bkt", F.floor(F.col("seq") / (1 << 16)))
    b = bucketed_running(b, ["user_id"], ["seq"], "_bkt",
                         maxs_before={"_last_add": F.when(F.col("action") == "add", F.col("ts_ms"))})
    commit_ts = F.when(F.col("action") == "commit",
                       F.col("_last_add") - F.when(F.col("event_type") == "error", 1).otherwise(0))
    auth_ok = F.lit(True) if auth == "ok" else (F.col("seq") % 7 != 0)
    return b.select(
        F.col("user_id").cast("string").alias("user_id"), "seq", "ts_ms", "action",
        F.when(F.col("action") == "add", F.array_repeat("product_id", F.col("qty")))
         .otherwise(F.array().cast("array<string>")).alias("product_ids"),
        commit_ts.alias("commit_ts"),
        auth_ok.alias("auth_ok"))

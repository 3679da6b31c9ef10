"""Point lookups, batched over a request table.

Each request row gets exactly one reply (or, for set-valued replies, its
rows in long form with a null member for an empty set).  A single key is a
one-row request table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyledger.schemas import CART_STATUS_OPEN


def get_cities(requests: DataFrame, latest_temps: DataFrame) -> DataFrame:
    """G1: cities known for each requested org; an unknown org gets one row
    with a null city (the empty list)."""
    known = latest_temps.select("org", "city").distinct()
    return requests.select("org").join(known, "org", "left")


# Replies of one org that one task makes from one copy of its list.
REPLIES_PER_LIST = 512


def get_cities_lists(requests: DataFrame, latest_temps: DataFrame, separator: str | None = None) -> DataFrame:
    """G1 reply shape: one row per request, a repeated one included, with
    ``cities`` sorted (empty when unknown); with ``separator`` as one text.

    A list may be megabytes long and an org requested any number of times, so
    requests are counted, an org's list (or text) is made once, and its replies
    are dealt in parts of ``REPLIES_PER_LIST``: what is shuffled is one list a
    part.  Rows are multiplied without their list, which a join adds to one reply
    at a time: ``explode`` would hold all replies of a part at once."""
    cities = F.array_sort(F.collect_set("city"))
    none = F.array().cast("array<string>")
    if separator is not None:
        cities, none = F.array_join(cities, separator), F.lit("")
    known = latest_temps.groupBy("org").agg(cities.alias("cities"))
    counts = requests.groupBy("org").agg(F.count(F.lit(1)).alias("_n"))
    last = F.floor((F.col("_n") - 1) / REPLIES_PER_LIST)
    parts = counts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    left = F.least(F.col("_n") - F.col("_part") * REPLIES_PER_LIST, F.lit(REPLIES_PER_LIST).cast("long"))
    replies = parts.select("org", "_part", F.explode(F.sequence(F.lit(1).cast("long"), left)).alias("_reply"))
    lists = parts.join(known, "org").select("org", "_part", "cities")
    # a given number of partitions: by their bytes, which the replies outgrow, they would be merged
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (replies.repartition(tasks, "org", "_part").join(lists.repartition(tasks, "org", "_part"), ["org", "_part"], "left")
            .select("org", F.coalesce("cities", none).alias("cities")))


def get_temperature(requests: DataFrame, latest_temps: DataFrame) -> DataFrame:
    """One row per (org, city) request; unknown -> null temperature."""
    t = latest_temps.select("org", "city", F.col("avg_temperature").alias("cityTemperature"))
    return requests.select("org", "city").join(t, ["org", "city"], "left")


def get_drone_summary(requests: DataFrame, latest_summary: DataFrame) -> DataFrame:
    """Latest drone summary rows (city, id) per requested org; an unknown
    org gets one row with null city and id (empty set and map)."""
    s = latest_summary.select("org", "city", "id")
    return requests.select("org").join(s, "org", "left")


def get_cart(requests: DataFrame, open_carts: DataFrame) -> DataFrame:
    """The open cart of each requested user in long form (user_id,
    status, cart_ts, product_id, qty); an unknown user gets an empty Open
    cart (one row, null product)."""
    items = open_carts.select("user_id", "cart_ts", "product_id", "qty")
    return (requests.select("user_id").join(items, "user_id", "left")
            .select("user_id", F.lit(CART_STATUS_OPEN).alias("status"),
                    "cart_ts", "product_id", "qty"))

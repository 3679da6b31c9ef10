"""Spark schemas of the inputs and replies."""

from pyspark.sql import types as T

LOCATION = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

MEASUREMENT = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("temperature", T.FloatType()),
    T.StructField("location", LOCATION),
])

# JSON packet sent by a device.
PACKET = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("measurements", T.ArrayType(MEASUREMENT)),
])

# Place file: tab separated, 19 string columns; the ones used are named.
PLACE_FILE_COLUMNS = [
    "geonameid", "name", "asciiname", "alternatenames", "latitude", "longitude",
    "feature_class", "feature_code", "country_code", "cc2", "admin1_code",
    "admin2_code", "admin3_code", "admin4_code", "population", "elevation",
    "dem", "timezone", "modification_date",
]
PLACE_FILE = T.StructType([T.StructField(c, T.StringType()) for c in PLACE_FILE_COLUMNS])

# Normalised place table used by the nearest-place join.
PLACE = T.StructType([
    T.StructField("place_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("province", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("feature_class", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

PRODUCT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("unit_price", T.FloatType()),
])

CART_EVENT = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("action", T.StringType()),          # add | clear | commit
    T.StructField("product_ids", T.ArrayType(T.StringType())),
    T.StructField("commit_ts", T.LongType()),
    T.StructField("auth_ok", T.BooleanType()),
])

SESSION_LOG = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("start_ms", T.LongType()),
    T.StructField("end_ms", T.LongType()),
])

CART_STATUS_OPEN = "Open"
CART_STATUS_COMMITTED = "Committed"

OUTCOME_EMPTY = "CartEmpty"
OUTCOME_OUT_OF_DATE = "CartOutOfDate"
OUTCOME_COMMITTED = "CartCommitted"
OUTCOME_FAILED = "CartCommitFailed"

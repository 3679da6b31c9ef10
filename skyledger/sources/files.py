"""A1-A3: file and stream readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from skyledger.schemas import CART_EVENT, PACKET, PLACE_FILE

CORRUPT = "_corrupt_record"


def _place_rows(spark: SparkSession, path: str) -> DataFrame:
    raw = (spark.read.schema(PLACE_FILE)
           .option("sep", "\t").option("quote", "\u0000").option("header", "false")
           .option("mode", "PERMISSIVE").csv(path))
    return raw.where(F.col("_metadata.file_name") != "readme.txt")


def _coordinate(column: str):
    value = F.col(column).try_cast("double")
    return F.when(~F.isnan(value), value)


def read_places(spark: SparkSession, path: str, major_only: bool = False) -> DataFrame:
    """A1: a geonames-style TSV (19 columns, no header, no quoting).

    Used fields (0-based): 0 id, 1 name, 4 lat, 5 lon, 6 feature class,
    8 country, 10 admin1; an empty text field is an empty string.  A
    ``readme.txt`` next to the data is skipped; rows whose coordinates do not
    parse are in :func:`read_place_rejects`.  ``major_only`` keeps feature
    class ``P`` (B7).
    """
    def text(column):
        return F.coalesce(F.col(column), F.lit(""))

    out = _place_rows(spark, path).select(
        F.col("geonameid").try_cast("long").alias("place_id"),
        text("name").alias("name"),
        text("admin1_code").alias("province"),
        text("country_code").alias("country"),
        text("feature_class").alias("feature_class"),
        _coordinate("latitude").alias("lat"),
        _coordinate("longitude").alias("lon"),
    ).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    from skyledger.operators.enrich import major_only as _major
    return _major(out, major_only)


def read_place_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The rows :func:`read_places` leaves out: all fields as read."""
    return _place_rows(spark, path).where(_coordinate("latitude").isNull() | _coordinate("longitude").isNull())


def write_places_tsv(places: DataFrame, path: str) -> None:
    """Write a place table in the 19-column TSV layout read by :func:`read_places`."""
    cols = {c: F.lit(None).cast("string") for c in PLACE_FILE.fieldNames()}
    cols.update({
        "geonameid": F.col("place_id").cast("string"),
        "name": F.col("name"), "asciiname": F.col("name"),
        "latitude": F.col("lat").cast("string"), "longitude": F.col("lon").cast("string"),
        "feature_class": F.col("feature_class"), "country_code": F.col("country"),
        "admin1_code": F.col("province"),
    })
    (places.select([cols[c].alias(c) for c in PLACE_FILE.fieldNames()])
     .write.mode("overwrite").option("sep", "\t").option("quote", "\u0000")
     .option("nullValue", "").csv(path))


def _packet_schema_with_corrupt(with_arrival: bool = False) -> T.StructType:
    extra = [T.StructField("arrival_seq", T.LongType())] if with_arrival else []
    return T.StructType(PACKET.fields + extra + [T.StructField(CORRUPT, T.StringType())])


def read_packets(spark: SparkSession, path: str, stream: bool = False,
                 max_files_per_trigger: int | None = None, with_arrival: bool = False) -> DataFrame:
    """A2: JSON packets, one per line, with a ``_corrupt_record`` column for
    rows that do not parse.  Use :func:`split_packets` to separate them.
    ``with_arrival`` also reads an optional ``arrival_seq`` field."""
    reader = spark.readStream if stream else spark.read
    reader = reader.schema(_packet_schema_with_corrupt(with_arrival)).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", CORRUPT)
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def parse_packets(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """A2 for a string column (e.g. a message value): ``from_json`` into the
    packet schema; unparseable text yields a row with ``_corrupt_record``."""
    parsed = F.from_json(F.col(value_col).cast("string"), PACKET,
                         {"mode": "PERMISSIVE"})
    return raw.select(parsed.alias("p"), F.col(value_col).cast("string").alias("_raw")).select(
        "p.*", F.when(F.col("p").isNull() | F.col("p.measurements").isNull() & F.col("p.id").isNull(),
                      F.col("_raw")).alias(CORRUPT))


def split_packets(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid packets, and rejects (unparseable or without an id) with a reason."""
    bad = F.col(CORRUPT).isNotNull() | F.col("id").isNull()
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed").otherwise("null id")
    valid = packets.where(~bad).drop(CORRUPT)
    rejected = packets.where(bad).select(reason.alias("reason"), CORRUPT, "id")
    return valid, rejected


def read_cart_events(spark: SparkSession, path: str, fmt: str = "parquet",
                     stream: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """A3: cart commands (schema :data:`skyledger.schemas.CART_EVENT`)."""
    reader = (spark.readStream if stream else spark.read).schema(CART_EVENT).format(fmt)
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)

"""Exact deduplication by stateful streaming, in DataFrame operations only.

Documents become an arrivals log (digest of the normalised text, code points,
doc_id, content locator); the locator is the file and row that hold the text.
A stream reads that log.  Its state, keyed by digest, lives in RocksDB on the
executors' disks with its changes in the shared checkpoint folder, and never
expires: for each digest it retains the best document so far, its locator and
the number of hits.  Each micro-batch writes the entries it changed.

A digest is no proof: the text of every document of a group with hits is
fetched by its locator and compared, byte for byte, with the retained
document's text.  Texts that differ under one digest are regrouped by their
bytes.  A group is compared in parts of ``COMPARE_ROWS`` documents, so a group
with a third of all rows is no task's burden.

Texts are equal if they are identical after deleting space, tab, line feed,
vertical tab, form feed and carriage return.  Of equal texts the row with the
most code points, then the smallest doc_id stays (a null doc_id loses; of rows
alike in both, one by locator).  Null text counts as empty; empty texts are
one group; an empty table gives no rows; other columns are ignored, also those
called like a locator's (``_file``, ``_row``, ``_metadata``), which ``keep_first`` returns as they were.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import PLACE, located, run_folder, table, unlocated, written

COMPARE_ROWS = 256
FILES_PER_BATCH = 256
#: State on disk, without files that reserve megabytes for each state partition.
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for space in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _falling(doc_id: str) -> Column:
    """Falls as ``doc_id`` rises, over all longs (a negation overflows at the least); its own inverse."""
    return F.bitwise_not(F.col(doc_id))


def stream_state(arrivals: str, folder: str, spark: SparkSession, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Run the stream over all arrivals: ``digest, best, size`` at its end."""
    schema = spark.read.parquet(arrivals).schema
    # A struct's order: most code points, smallest doc_id, then the locator.
    best = F.max(F.struct("chars", _falling("doc_id").alias("falling_id"), *PLACE))
    changes = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
               .groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("size")))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    before = {key: spark.conf.get(key, None) for key in _STATE_CONF}
    for key, value in _STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        (changes.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True)
         .option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination())
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    try:
        written_changes = spark.read.parquet(f"{folder}/changes")
    except AnalysisException:  # no documents: no batch
        return spark.createDataFrame([], changes.schema)
    # Sizes only grow, so an entry's largest is its last.
    # Written, so that the join with a hot digest's documents is one that Spark can split.
    return written(written_changes.groupBy("digest").agg(F.max_by("best", "size").alias("best"), F.max("size").alias("size")), "dedup-state")


def deduplicate(docs: DataFrame, digest=sha256, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per document with its locator: ``doc_id, keep_id, group_size,
    kept, text_sha256, _file, _row``."""
    spark, docs = docs.sparkSession, located(docs)
    folder = run_folder(spark, "dedup")
    text = normalised(F.col("text"))
    (docs.select(digest(text).alias("digest"), F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("chars"),
                 F.col("doc_id").cast("long").alias("doc_id"), *PLACE, sha256(text).alias("text_sha256"))
     .write.parquet(f"{folder}/arrivals"))
    arrivals = spark.read.parquet(f"{folder}/arrivals")
    state = stream_state(f"{folder}/arrivals", folder, spark, files_per_batch)
    grouped = arrivals.join(state, "digest")

    # Hits: the texts of groups of two and more, by locator.
    hits = (grouped.filter("size > 1")
            .select(*PLACE, "digest", "size", (F.struct("_file", "_row") == F.struct("best._file", "best._row")).alias("held")))
    texts = written(docs.select(*PLACE, "text").join(hits, PLACE).withColumn("content", normalised(F.col("text"))).drop("text"), "dedup-hits")
    parts = F.ceil(F.col("size") / COMPARE_ROWS).cast("int")
    held = texts.filter("held").select("digest", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("content").alias("held_content"))
    differing = written(texts.withColumn("part", F.pmod(F.xxhash64(*PLACE), parts).cast("int")).join(held, ["digest", "part"])
                        .filter(F.col("content") != F.col("held_content")).select("digest", *PLACE), "dedup-differing")

    best_id = _falling("best.falling_id")
    result = grouped.select("doc_id", best_id.alias("keep_id"), F.col("size").alias("group_size"),
                            (F.struct("_file", "_row") == F.struct("best._file", "best._row")).alias("kept"), "text_sha256", *PLACE, "digest")
    if differing.isEmpty():
        return result.drop("digest")
    collided = differing.select("digest").distinct()
    members = (texts.join(collided, "digest").join(arrivals.select(*PLACE, "doc_id", "chars", "text_sha256"), PLACE))
    classes = members.groupBy("digest", "content").agg(
        F.max(F.struct("chars", _falling("doc_id").alias("falling_id"), *PLACE)).alias("best"), F.count(F.lit(1)).alias("group_size"))
    regrouped = members.drop("size").join(classes, ["digest", "content"]).select(
        "doc_id", best_id.alias("keep_id"), "group_size", (F.struct("_file", "_row") == F.struct("best._file", "best._row")).alias("kept"),
        "text_sha256", *PLACE)
    return result.join(collided, "digest", "left_anti").drop("digest").unionByName(regrouped)


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all columns of ``docs``."""
    places = located(docs)
    dropped = deduplicate(places.select("doc_id", "text")).filter(~F.col("kept")).select(*PLACE)
    return unlocated(places.join(dropped, PLACE, "left_anti"), docs.columns)


def op5_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful streaming deduplication of all ``documents``."""
    return deduplicate(table(spark, sf_dir, "documents")).drop(*PLACE)

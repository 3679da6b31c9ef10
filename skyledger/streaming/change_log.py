"""A5 / H4: state tables kept as a log of changes, merged when read.

Every micro-batch writes one *run* that holds what the batch adds, so bytes
written follow the batch, never the table.  ``fan`` runs of a level are merged
into one run of the next level: a row is rewritten once a level, and the number
of live runs stays below ``2 * fan`` for each of ``log(batches) / log(fan)`` levels.

A run is the folder ``<path>/<level>-<first batch>-<last batch>``, complete
once Spark's ``_SUCCESS`` is in it; a reader takes the widest complete runs
that do not overlap.  Merged-away runs stay until the next merge of their
level, for readers that opened them.  A replayed batch writes its run again, or
nothing if a wider run already holds it: each batch counts once.

``merge`` adds up rows that belong together and must not depend on the order or
grouping of runs (sums, distinct, newest of).  Nothing waits for a watermark: a
row that comes late adds to its pane like any other.

Runs are split by a hash of ``org`` (``bucket``), so a lookup of some orgs
reads only their folders.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKET = "bucket"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@dataclass(frozen=True, order=True)
class Run:
    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"{self.level}-{self.first}-{self.last}"


class ChangeLog:
    """The table at ``path`` with ``schema`` (a DDL string without the bucket)."""

    def __init__(self, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], fan: int = 8, buckets: int = 16):
        if fan < 2:
            raise ValueError("fan is 2 or more")
        self.path, self.schema, self.merge, self.fan, self.buckets = path, schema, merge, fan, buckets

    def complete(self, spark: SparkSession) -> list[Run]:
        """All complete runs, merged-away ones too."""
        fs, p = _fs(spark, self.path)
        if not fs.exists(p):
            return []
        runs = []
        for status in fs.listStatus(p):
            found = re.fullmatch(r"(\d+)-(\d+)-(\d+)", status.getPath().getName())
            if found and fs.exists(_fs(spark, f"{self.path}/{found.group()}/_SUCCESS")[1]):
                runs.append(Run(*map(int, found.groups())))
        return runs

    def live(self, spark: SparkSession) -> list[Run]:
        """The widest complete runs, none inside another, by batch."""
        kept: list[Run] = []
        for run in sorted(self.complete(spark), key=lambda r: (-r.level, r.first)):
            if not any(k.first <= run.first and run.last <= k.last for k in kept):
                kept.append(run)
        return sorted(kept, key=lambda r: r.first)

    def _bucket(self, org):
        return F.pmod(F.xxhash64(org), F.lit(self.buckets)).cast("int")

    def _rows(self, spark: SparkSession, runs: list[Run]) -> DataFrame:
        """The rows of runs, not merged; one scan."""
        if not runs:
            return spark.createDataFrame([], self.schema).withColumn(BUCKET, F.lit(0))
        schema = spark.createDataFrame([], self.schema).withColumn(BUCKET, F.lit(0)).schema
        # each folder as a path of its own: basePath would make its name a column
        parts = [spark.read.schema(schema).parquet(f"{self.path}/{run.name}") for run in runs]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows

    def _write(self, rows: DataFrame, run: Run) -> None:
        names = [c for c in rows.columns if c != BUCKET]
        (rows.select(*names, self._bucket(F.col("org")).alias(BUCKET)).repartition(BUCKET)
         .write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{run.name}"))

    def add(self, changes: DataFrame, batch_id: int) -> None:
        """One micro-batch's changes; then the merges that fall due."""
        spark = changes.sparkSession
        if any(r.level > 0 and r.first <= batch_id <= r.last for r in self.complete(spark)):
            return   # a replay of a batch that was merged already
        self._write(self.merge(changes), Run(0, batch_id, batch_id))
        level = 0
        while len(due := [r for r in self.live(spark) if r.level == level]) >= self.fan:
            self.compact(spark, due)
            level += 1

    def compact(self, spark: SparkSession, runs: list[Run]) -> Run:
        """Merge neighbouring runs into one of the next level; then remove runs
        that an earlier merge had replaced."""
        run = Run(max(r.level for r in runs) + 1, min(r.first for r in runs), max(r.last for r in runs))
        self._write(self.merge(self._rows(spark, runs).drop(BUCKET)), run)
        live, fresh = set(self.live(spark)), set(runs)
        for old in self.complete(spark):
            if old not in live and old not in fresh and old.level < run.level:
                fs, p = _fs(spark, f"{self.path}/{old.name}")
                fs.delete(p, True)
        return run

    def read(self, spark: SparkSession, orgs: DataFrame | None = None) -> DataFrame:
        """The merged table; with ``orgs`` (a column ``org``) only their rows: the
        runs' folders of other orgs are not read."""
        rows = self._rows(spark, self.live(spark))
        if orgs is not None:
            asked = orgs.select("org").distinct()
            wanted = asked.select(self._bucket(F.col("org")).alias(BUCKET)).distinct().collect()   # at most `buckets` numbers
            rows = rows.where(F.col(BUCKET).isin([r[0] for r in wanted])).join(asked, "org", "left_semi")
        return self.merge(rows.drop(BUCKET))

"""Helpers shared by the pipeline operators: table access, written
intermediate tables, Arrow batches and per-worker word tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import checkpoint_dir

#: Documents handed to the numpy code at a time; bounds a worker's memory.
SLICE = 256
#: The content locator of a document: the Parquet file and row that hold it.
PLACE = ["_file", "_row"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the
    lineage is cut there, so a lost executor never repeats the work above."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _put_by(columns: list[str]) -> dict[str, str]:
    """Other names for columns of a table that are called like a locator's."""
    taken, out = {c.lower() for c in columns}, {}
    for c in columns:
        if c.lower() in PLACE:
            name = c + "_of_table"
            while name.lower() in taken:
                name += "_"
            out[c] = name
    return out


def _quoted(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and row of each document; documents that are not
    read from Parquet are written to the shared folder first.  Columns of
    ``docs`` with a locator's name are put by until ``unlocated``."""
    other = _put_by(docs.columns)

    def with_place(df):
        place = df.metadataColumn("_metadata")
        return df.select(*(F.col(_quoted(c)).alias(other.get(c, c)) for c in df.columns),
                         place["file_path"].alias(PLACE[0]), place["row_index"].alias(PLACE[1]))
    try:
        out = with_place(docs)
        out.schema  # an analysis error shows here at the latest
        return out
    except (AnalysisException, IllegalArgumentException):
        return with_place(written(docs, "documents"))


def unlocated(places: DataFrame, columns: list[str]) -> DataFrame:
    """The table's own ``columns`` of what ``located`` returned."""
    other = _put_by(columns)
    return places.select(*(F.col(_quoted(other.get(c, c))).alias(c) for c in columns))


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Numbered(dict):
    """Numbers keys in order of first use; new keys wait in ``pending``.

    A worker keeps one for all its tasks.  ``fresh()`` empties it between
    documents once it holds ``limit`` keys: that bounds its memory and changes
    speed only, since every key can be numbered anew.
    """

    def __init__(self, limit: int = 800_000):
        super().__init__()
        self.limit, self.pending = limit, []

    def __missing__(self, key):
        self[key] = number = len(self)
        self.pending.append(key)
        return number

    def fresh(self) -> bool:
        if len(self) < self.limit:
            return False
        self.clear()
        self.pending = []
        return True


class Growing:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.size = np.empty(1024, dtype), 0

    def extend(self, values) -> None:
        values = np.asarray(values, self.data.dtype)
        need = self.size + len(values)
        if need > len(self.data):
            data = np.empty(max(need, 2 * len(self.data)), self.data.dtype)
            data[:self.size] = self.data[:self.size]
            self.data = data
        self.data[self.size:need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.data[:self.size]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[starts[i]:starts[i] + lengths[i]]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]

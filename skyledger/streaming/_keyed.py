"""Drive a per-key fold over a batch or a stream.

A *fold* is a small object with ``begin(key, state)``, ``step(row) ->
[outputs]`` and ``end() -> ([outputs], state)``.  The same fold runs

* on a stream inside ``transformWithStateInPandas`` (state kept in one
  ``ValueState`` per key, checkpointed by the state store), and
* on a batch (the twin) with ``mapInPandas`` over input that is
  hash-partitioned on the key and sorted by key and arrival order, so each
  task scans its keys one after the other and holds only the current key's
  state; memory is bounded by the Arrow batch and that state, never by the
  size of a key's group.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def fold_sorted(df: DataFrame, keys: list[str], order_cols: list[str], make_fold: Callable,
                in_cols: list[str], output_schema: T.StructType) -> DataFrame:
    """Batch twin: run ``make_fold()`` over each key's rows in order."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    extra = [c for c in order_cols if c not in in_cols and c not in keys]
    ordered = (df.select(*keys, *[c for c in in_cols if c not in keys], *extra)
               .repartition(n, *keys).sortWithinPartitions(*keys, *order_cols))
    out_cols = [f.name for f in output_schema.fields]
    nk = len(keys)

    def run(batches):
        fold, cur = make_fold(), None
        for pdf in batches:
            out = []
            cols = [pdf[c].tolist() for c in keys] + [pdf[c].tolist() for c in in_cols]
            for row in zip(*cols):
                key = row[:nk]
                if key != cur:
                    if cur is not None:
                        out.extend(fold.end()[0])
                    fold.begin(key, None)
                    cur = key
                out.extend(fold.step(row[nk:]))
            if out:
                yield pd.DataFrame(out, columns=out_cols)
        if cur is not None:
            tail = fold.end()[0]
            if tail:
                yield pd.DataFrame(tail, columns=out_cols)

    return ordered.mapInPandas(run, output_schema)


class FoldProcessor(StatefulProcessor):
    """Streaming driver: a micro-batch's rows of one key are sorted by the
    order columns (bounded by the trigger size), folded, and the fold's
    state is stored back in a single value."""

    def __init__(self, make_fold: Callable, state_schema: T.StructType, in_cols: list[str],
                 order_cols: list[str], output_schema: T.StructType):
        self.make_fold, self.state_schema = make_fold, state_schema
        self.in_cols, self.order_cols, self.output_schema = in_cols, order_cols, output_schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", self.state_schema)
        self.fold = self.make_fold()

    def handleInputRows(self, key, rows, timerValues):
        parts = list(rows)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        sort_cols = []
        for c in self.order_cols:
            pdf["_o_" + c] = pdf[c].fillna(-1) if pdf[c].dtype.kind == "f" else pdf[c]
            sort_cols.append("_o_" + c)
        pdf = pdf.sort_values(sort_cols, kind="stable")
        self.fold.begin(tuple(key), self.state.get())
        out = []
        for row in zip(*[pdf[c].tolist() for c in self.in_cols]):
            out.extend(self.fold.step(row))
        tail, new_state = self.fold.end()
        out.extend(tail)
        if new_state is not None:
            self.state.update(new_state)
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in self.output_schema.fields])

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, keys: list[str], order_cols: list[str], make_fold: Callable,
                in_cols: list[str], state_schema: T.StructType,
                output_schema: T.StructType) -> DataFrame:
    proc = FoldProcessor(make_fold, state_schema, in_cols, order_cols, output_schema)
    extra = [c for c in order_cols if c not in in_cols and c not in keys]
    return stream.select(*keys, *[c for c in in_cols if c not in keys], *extra).groupBy(*keys) \
        .transformWithStateInPandas(statefulProcessor=proc, outputStructType=output_schema,
                                    outputMode="Append", timeMode="None")

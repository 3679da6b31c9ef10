"""Sums of arrays over the tasks of a DataFrame, merged by tasks before they reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks that merge the partial sums; the driver gets one sum of each.
MERGERS = 16


def summed(df: DataFrame, partial: Callable, add: Callable, dump: Callable, load: Callable):
    """``partial(batches)`` gives one task's sum or None, ``add(a, b)`` joins two;
    ``dump`` and ``load`` turn a sum into bytes and back.  None: no task had one."""
    def merged(values: Iterable):
        total = None
        for value in values:
            total = value if total is None else add(total, value)
        return total

    def out(total):
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([dump(total)], pa.binary())], ["part"])

    def parts(batches):
        return (load(value.as_py()) for batch in batches for value in batch.column(0))

    each = df.mapInArrow(lambda batches: out(partial(batches)), "part binary")
    few = each.repartition(MERGERS).mapInArrow(lambda batches: out(merged(parts(batches))), "part binary")
    return merged(load(bytes(r.part)) for r in few.collect())

"""H2 on a stream: the slide-on-arrival window, exactly (in batch:
:mod:`skyledger.operators.arrival`, which gives the same rows).

Per group key, in arrival order:

1. append the row to the buffer;
2. ``delta = row.ts - window_start``;
3. if ``delta > window``: emit the whole buffer (including the row that
   triggered it), then pop from the front until a popped row has
   ``ts >= window_start`` (the old start) or the buffer is empty, and
   advance ``window_start`` by one ``slide``;
4. nothing is emitted without a new row.

The first ``window_start`` is a parameter; by default the key's first event
time.  There is no watermark: a late row joins the buffer in arrival order.
This is not the same function as the event-time sliding window (H1).

Emitted windows are reduced at once: ``mode="temperature"`` (key org,
city) gives the mean temperature plus the first buffered row's id, time
and location; ``mode="drones"`` (key org) gives the distinct (city, id)
pairs of the buffer, one row each.  A running sum and a multiset keep each
step O(1) apart from the emitted rows.  The buffer (the key's current
window) is the only state.
"""

from __future__ import annotations

from collections import Counter, deque

from pyspark.sql import DataFrame, types as T

from skyledger.operators.arrival import SLIDE_MS, WINDOW_MS
from skyledger.streaming._keyed import fold_stream

BUFFER_ROW = T.StructType([
    T.StructField("ts_ms", T.LongType()), T.StructField("temperature", T.DoubleType()),
    T.StructField("id", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
])
IN_COLS = [f.name for f in BUFFER_ROW.fields]
STATE = T.StructType([
    T.StructField("window_start", T.LongType()), T.StructField("emitted", T.LongType()),
    T.StructField("buffer", T.ArrayType(BUFFER_ROW)),
])

TEMPERATURE_OUT = T.StructType([
    T.StructField("org", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("emit_no", T.LongType()), T.StructField("window_start_ms", T.LongType()),
    T.StructField("trigger_ts_ms", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("avg_temperature", T.DoubleType()), T.StructField("first_id", T.StringType()),
    T.StructField("first_ts_ms", T.LongType()), T.StructField("first_lat", T.DoubleType()),
    T.StructField("first_lon", T.DoubleType()),
])
DRONES_OUT = T.StructType([
    T.StructField("org", T.StringType()), T.StructField("emit_no", T.LongType()),
    T.StructField("window_start_ms", T.LongType()), T.StructField("trigger_ts_ms", T.LongType()),
    T.StructField("city", T.StringType()), T.StructField("id", T.StringType()),
])


class ArrivalWindowFold:
    def __init__(self, mode: str = "temperature", window_ms: int = WINDOW_MS,
                 slide_ms: int = SLIDE_MS, initial_start: int | None = None):
        self.mode, self.window_ms, self.slide_ms, self.initial_start = mode, window_ms, slide_ms, initial_start

    def begin(self, key, state):
        self.key = key
        if state is None:
            self.start, self.emitted, self.buf = self.initial_start, 0, deque()
        else:
            self.start, self.emitted = state[0], state[1]
            self.buf = deque(tuple(r) for r in (state[2] or []))
        self.temp_sum = sum(r[1] for r in self.buf)
        self.pairs = Counter((r[3], r[2]) for r in self.buf) if self.mode == "drones" else None

    def step(self, row):
        ts = row[0]
        if self.start is None:
            self.start = ts
        self.buf.append(row)
        self.temp_sum += row[1]
        if self.pairs is not None:
            self.pairs[(row[3], row[2])] += 1
        if ts - self.start <= self.window_ms:
            return []
        self.emitted += 1
        out = self._emit(ts)
        while True:
            popped = self.buf.popleft()
            self.temp_sum -= popped[1]
            if self.pairs is not None:
                k = (popped[3], popped[2])
                self.pairs[k] -= 1
                if self.pairs[k] == 0:
                    del self.pairs[k]
            if not self.buf or popped[0] >= self.start:
                break
        self.start += self.slide_ms
        return out

    def _emit(self, trigger_ts):
        if self.mode == "temperature":
            f, n = self.buf[0], len(self.buf)
            return [(self.key[0], self.key[1], self.emitted, self.start, trigger_ts, n,
                     self.temp_sum / n, f[2], f[0], f[4], f[5])]
        return [(self.key[0], self.emitted, self.start, trigger_ts, city, did)
                for (city, did) in sorted(self.pairs)]

    def end(self):
        return [], (self.start, self.emitted, list(self.buf))


def _setup(mode):
    keys = ["org", "city"] if mode == "temperature" else ["org"]
    return keys, (TEMPERATURE_OUT if mode == "temperature" else DRONES_OUT)


def arrival_window_stream(enriched_stream: DataFrame, mode: str = "temperature",
                          window_ms: int = WINDOW_MS, slide_ms: int = SLIDE_MS,
                          initial_start: int | None = None,
                          order_cols: tuple[str, ...] = ("arrival_seq", "arrival_pos")) -> DataFrame:
    """H2 on a stream; the fold's state per key lives in the state store."""
    keys, out = _setup(mode)
    order = [c for c in order_cols if c in enriched_stream.columns]
    return fold_stream(enriched_stream, keys, order,
                       lambda: ArrivalWindowFold(mode, window_ms, slide_ms, initial_start),
                       IN_COLS, STATE, out)

"""H5: the per-user cart fold, including refused authentication.

One fold serves the stream (``transformWithStateInPandas``) and its batch
twin (``mapInPandas`` over input sorted per user).  Input rows are cart
commands exploded to one row per product id (``pos`` null for a command
without ids), each with ``valid`` from a left join on the catalog, so
validation stays a plain (stream-static) join before the state.

Rules per user, in ``seq`` order (synchronous model: a commit and its
authentication verdict ``auth_ok`` are one event, interleaving during
authentication is left out):

* add: every valid id +1; the version becomes the command time, also when
  no id was valid.
* clear: a new empty cart at the command time.
* commit(ct): empty -> CartEmpty; version != ct -> CartOutOfDate; else the
  cart moves out and a new empty cart opens at the command time; with
  ``auth_ok`` it is stored under ct (CartCommitted), otherwise its items are
  merged back into the open cart, which keeps the new version
  (CartCommitFailed).
* a new user's first cart has the time of the user's first command.

Output rows (``kind``): ``outcome`` for each command, ``committed`` items of
each successful commit, and ``cart``: the open cart after the key's input
(one row per product, or one row with null product when empty).  The state
per user is the open cart's version and items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from skyledger.schemas import OUTCOME_COMMITTED, OUTCOME_EMPTY, OUTCOME_FAILED, OUTCOME_OUT_OF_DATE
from skyledger.streaming._keyed import fold_sorted, fold_stream

OUT = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("seq", T.LongType()), T.StructField("ts_ms", T.LongType()),
    T.StructField("action", T.StringType()), T.StructField("outcome", T.StringType()),
    T.StructField("n_valid", T.LongType()), T.StructField("version", T.LongType()),
    T.StructField("product_id", T.StringType()), T.StructField("qty", T.LongType()),
])
STATE = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("items", T.MapType(T.StringType(), T.LongType())),
])
IN_COLS = ["seq", "ts_ms", "action", "commit_ts", "auth_ok", "pos", "product_id", "valid"]
ORDER = ["seq", "pos"]


def _num(v):
    return None if v is None or v != v else int(v)


class CartFold:
    def begin(self, key, state):
        self.user = key[0]
        self.version = None if state is None else state[0]
        self.items = {} if state is None else dict(state[1] or {})
        self.cmd, self.ids = None, []

    def step(self, row):
        out = []
        if self.cmd is not None and row[0] != self.cmd[0]:
            out = self._apply()
        if self.cmd is None:
            self.cmd, self.ids = row, []
        pos, pid, valid = row[5], row[6], row[7]
        if _num(pos) is not None and bool(valid):
            self.ids.append(pid)
        return out

    def _apply(self):
        seq, ts, action, commit_ts, auth_ok = self.cmd[:5]
        seq, ts = int(seq), int(ts)
        ids, self.cmd, self.ids = self.ids, None, []
        if self.version is None:
            self.version = ts
        out, outcome, n_valid = [], None, 0
        if action == "add":
            for pid in ids:
                self.items[pid] = self.items.get(pid, 0) + 1
            n_valid, self.version = len(ids), ts
        elif action == "clear":
            self.items, self.version = {}, ts
        elif action == "commit":
            ct = _num(commit_ts)
            if not self.items:
                outcome = OUTCOME_EMPTY
            elif self.version != ct:
                outcome = OUTCOME_OUT_OF_DATE
            else:
                committing, self.items, self.version = self.items, {}, ts
                if bool(auth_ok):
                    outcome = OUTCOME_COMMITTED
                    out.extend((self.user, "committed", seq, ts, action, None, None, ct, pid, q)
                               for pid, q in sorted(committing.items()))
                else:
                    outcome = OUTCOME_FAILED
                    self.items = dict(committing)
        out.append((self.user, "outcome", seq, ts, action, outcome, n_valid, self.version, None, None))
        return out

    def end(self):
        out = self._apply() if self.cmd is not None else []
        if self.items:
            out.extend((self.user, "cart", None, None, None, None, None, self.version, pid, q)
                       for pid, q in sorted(self.items.items()))
        else:
            out.append((self.user, "cart", None, None, None, None, None, self.version, None, None))
        state = None if self.version is None else (self.version, dict(self.items))
        return out, state


def exploded_commands(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Commands as one row per product id with a catalog-validity flag
    (stateless: works on a stream joined with a static catalog; the
    catalog side is broadcast by AQE when its measured size is small)."""
    ex = events.select("user_id", "seq", "ts_ms", "action", "commit_ts", "auth_ok",
                       F.posexplode_outer("product_ids").alias("pos", "product_id"))
    cat = catalog.select(F.col("id").alias("product_id"), F.lit(True).alias("valid"))
    return (ex.join(cat, "product_id", "left")
            .withColumn("valid", F.coalesce("valid", F.lit(False)))
            .select("user_id", *IN_COLS))


def cart_fold(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Batch twin of the stateful cart (each user's rows in seq, pos order)."""
    return fold_sorted(exploded_commands(events, catalog), ["user_id"], ORDER, CartFold, IN_COLS, OUT)


def cart_fold_stream(events_stream: DataFrame, catalog: DataFrame) -> DataFrame:
    """H5 on a stream of cart commands."""
    return fold_stream(exploded_commands(events_stream, catalog), ["user_id"], ORDER, CartFold,
                       IN_COLS, STATE, OUT)

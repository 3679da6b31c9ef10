"""Shopping carts from a command log.

Input: cart commands ``user_id, seq, ts_ms, action, product_ids,
commit_ts, auth_ok`` (``seq`` unique per user, defines the order).

The batch fold here uses running aggregates per user in ``seq`` order
(bucketed, see :mod:`skyledger.operators.prefix`) in the synchronous model: a
commit and its authentication verdict are one event.  A refused commit moves
the cart version, so whether a later one meets the version depends on the
refused ones before it; :func:`commit_hits` follows those moves by doubling.
:mod:`skyledger.streaming.cart_state` has the same rules as a stateful fold.

Rules (one user):
* add: valid ids are added one each (duplicates kept), the cart version
  becomes the command time, also when no id was valid.
* clear: new empty cart at the command time.
* commit(ct): empty cart -> CartEmpty; version != ct -> CartOutOfDate;
  else the cart moves out and a new version opens at the command time: with
  ``auth_ok`` (null: yes) it is stored under ct (CartCommitted) and the new one
  is empty; refused, its items stay in the new one (CartCommitFailed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyledger.operators.prefix import bucketed_running
from skyledger.session import materialize, shared_table
from skyledger.schemas import (CART_STATUS_COMMITTED, OUTCOME_COMMITTED,
                               OUTCOME_EMPTY, OUTCOME_FAILED, OUTCOME_OUT_OF_DATE)


# --- validation -----------------------------------------------------------

def validate_products(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """The valid product ids of every add, one row per id occurrence
    (duplicates kept): user_id, seq, pos, product_id.  A left-semi join on
    the catalog ids; the catalog side is broadcast by AQE when small."""
    ids = (events.where(F.col("action") == "add")
           .select("user_id", "seq", F.posexplode("product_ids").alias("pos", "product_id")))
    return ids.join(catalog.select(F.col("id").alias("product_id")), "product_id", "left_semi") \
              .select("user_id", "seq", "pos", "product_id")


def distinct_ids(events: DataFrame) -> DataFrame:
    """the adds with their id list as a set (other columns kept)."""
    return (events.where(F.col("action") == "add")
            .withColumn("product_ids", F.array_distinct("product_ids")))


def invalid_product_ids(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per add, the set of ids not in the catalog (distinct ids minus
    known ids): user_id, seq, product_id."""
    ids = (distinct_ids(events)
           .select("user_id", "seq", F.explode("product_ids").alias("product_id")))
    return ids.join(catalog.select(F.col("id").alias("product_id")), "product_id", "left_anti") \
              .select("user_id", "seq", "product_id")


# --- fold by running aggregates (E1, E2) -----------------------------------

# Buckets of ``seq`` for the running aggregates (see operators.prefix).
SEQ_BUCKET = 1 << 16


def commands(events: DataFrame, catalog: DataFrame, seq_bucket: int = SEQ_BUCKET) -> DataFrame:
    """One row per command with ``n_valid``, its ids (``product_ids``) and
    its valid ids (``valid_ids``, duplicates kept; order not kept), hash-
    partitioned on (user, seq bucket ``_bkt``) - the one shuffle of the
    command log; everything downstream reuses it."""
    ex = events.select("user_id", "seq", "ts_ms", "action", "commit_ts", "auth_ok",
                       F.posexplode_outer("product_ids").alias("pos", "product_id"))
    cat = catalog.select(F.col("id").alias("product_id"), F.lit(True).alias("_valid"))
    # A fixed partition count (not coalesced by AQE) so later joins with the
    # small per-bucket tables find both sides partitioned alike.
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ex = (ex.join(cat, "product_id", "left")
            .withColumn("_bkt", F.floor(F.col("seq") / seq_bucket))
            .repartition(n, "user_id", "_bkt"))
    has_id = F.col("pos").isNotNull()
    ok = has_id & F.coalesce(F.col("_valid"), F.lit(False))
    return ex.groupBy("user_id", "_bkt", "seq", "ts_ms", "action", "commit_ts", "auth_ok").agg(
        F.collect_list(F.when(has_id, F.col("product_id"))).alias("product_ids"),
        F.collect_list(F.when(ok, F.col("product_id"))).alias("valid_ids"),
        F.count_if(ok).alias("n_valid"))


def cart_epochs(events: DataFrame, catalog: DataFrame, seq_bucket: int = SEQ_BUCKET) -> DataFrame:
    """E1 + E2: every command with its cart epoch and, for commits, the outcome.

    seg   running count of adds (a new segment starts at each add)
    ats   time of the latest add (the cart version while the cart holds items
          and no commit was refused)
    r0    clear, or commit whose timestamp equals ats; where any commit was
          refused: clear, or a successful commit among the ``commit_hits``
    reset first r0 of its (user, seg): from there the cart is empty until the
          next add, so later r0 rows of the segment meet an empty cart.  As
          segments never decrease, "an earlier r0 in my segment" is "the
          largest segment of an earlier r0 equals mine".
    epoch resets strictly before the row
    n     valid items added in the epoch so far: the running item count
          minus its value at the last reset before the row

    All running values come from :func:`bucketed_running` on the command
    log partitioned by (user, seq bucket), so no user's history has to fit
    one task and the command log is shuffled once: the three running
    steps share their inputs through ``session.materialize`` (persisted,
    partitioning kept), so no step re-shuffles or recomputes another
    (``session.release_shared`` drops them).  Logs with refused commits take
    one more small table, the hits, joined on (user, bucket, seq).
    """
    # Each running step reads its input twice (rows and per-bucket totals);
    # the inputs are materialized so the command log is shuffled once and
    # no step recomputes the ones before it.
    c = materialize(commands(events, catalog, seq_bucket))
    is_add = F.col("action") == "add"
    c = bucketed_running(c, ["user_id"], ["seq"], "_bkt",
                         sums={"seg": is_add.cast("long"),
                               "_vp": F.when(is_add, F.col("n_valid")).otherwise(0).cast("long")},
                         lasts={"ats": F.when(is_add, F.col("ts_ms"))})
    if events.where((F.col("action") == "commit") & ~F.col("auth_ok")).isEmpty():
        met = (F.col("action") == "commit") & (F.col("commit_ts") == F.col("ats"))
        closes = met
    else:
        c = materialize(c)
        n_parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hits = commit_hits(c).withColumn("_hit", F.lit(True)).repartition(n_parts, "user_id", "_bkt")
        c = c.join(hits, ["user_id", "_bkt", "seq"], "left")
        met = F.col("_hit").isNotNull()
        closes = met & _authenticated()
    c = c.withColumns({"met": F.coalesce(met, F.lit(False)),
                       "r0": F.coalesce((F.col("action") == "clear") | closes, F.lit(False))}).drop("_hit")
    c = materialize(c)
    c = bucketed_running(c, ["user_id"], ["seq"], "_bkt",
                         maxs_before={"_r0_seg": F.when(F.col("r0"), F.col("seg"))})
    c = c.withColumn("reset", F.col("r0") & ~F.coalesce(F.col("_r0_seg") == F.col("seg"), F.lit(False)))
    c = materialize(c)
    c = bucketed_running(c, ["user_id"], ["seq"], "_bkt",
                         sums={"_resets": F.col("reset").cast("long")},
                         lasts_before={"_vp_reset": F.when(F.col("reset"), F.col("_vp"))})
    c = (c.withColumn("epoch", F.col("_resets") - F.col("reset").cast("long"))
          .withColumn("n", F.col("_vp") - F.coalesce(F.col("_vp_reset"), F.lit(0)))
          .drop("_r0_seg", "_resets", "_vp_reset", "_vp"))
    outcome = (F.when(F.col("action") != "commit", F.lit(None).cast("string"))
               .when(F.col("n") == 0, OUTCOME_EMPTY)
               .when(F.col("met") & _authenticated(), OUTCOME_COMMITTED)
               .when(F.col("met"), OUTCOME_FAILED)
               .otherwise(OUTCOME_OUT_OF_DATE))
    return c.withColumn("outcome", outcome).drop("met")


def _authenticated():
    return F.coalesce(F.col("auth_ok"), F.lit(True))


def commit_hits(commands: DataFrame) -> DataFrame:
    """The commits whose timestamp meets the cart's version, were the cart not
    empty: user_id, _bkt, seq.  Input: commands with ``seg`` and ``_bkt``.

    Within a segment (an add and what follows it up to the next add) the
    version starts as the add's time; a commit that meets it ends the cart, or
    if refused makes its own time the version.  So each of these *sources* of a
    version leads to the first later commit of that timestamp.  With the number
    of commits of a timestamp before a source, and each commit's number among
    them, that is an equal join.  The links of refused commits are composed
    with themselves, 1, 2, 4, ... steps at a time, until none is left: rounds
    grow with the logarithm of the longest chain of refused commits.
    A clear empties the cart, and no commit behind it in the segment counts as
    one that the cart's items see (see ``cart_epochs``).
    """
    key = ["user_id", "seg", "value"]
    is_commit, is_refused = F.col("action") == "commit", (F.col("action") == "commit") & ~_authenticated()
    target = F.struct(F.col("commit_ts").alias("value"), F.lit(0).alias("kind"))
    source = F.when((F.col("action") == "add") | is_refused, F.struct(F.col("ts_ms").alias("value"), F.lit(1).alias("kind")))
    events = (commands.select("user_id", "seg", "_bkt", "seq", "action", is_refused.alias("refused"),
                              F.explode(F.array(F.when(is_commit, target), source)).alias("_e"))
              .where(F.col("_e.value").isNotNull()).select("*", "_e.value", "_e.kind").drop("_e"))
    n = int(commands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a commit is a target before it is a source
    numbered = bucketed_running(events.repartition(n, *key, "_bkt"), key, ["seq", "kind"], "_bkt",
                                sums={"_targets": (F.col("kind") == 0).cast("long")})
    numbered = shared_table(numbered, "cart-versions")
    to = numbered.where("kind = 0").select(*key, (F.col("_targets") - 1).alias("_targets"), F.col("seq").alias("to"),
                                           F.col("_bkt").alias("to_bkt"))
    links = numbered.where("kind = 1").select(*key, "_targets", "action", "seq").join(to, [*key, "_targets"])
    links = shared_table(links.select("user_id", "action", "seq", "to", "to_bkt"), "cart-links")
    steps = links.where("action = 'commit'").drop("action")
    hits = links.where("action = 'add'").select("user_id", F.col("to").alias("seq"), F.col("to_bkt").alias("_bkt"))
    while not steps.isEmpty():
        ahead = hits.select("user_id", "seq").join(steps, ["user_id", "seq"])
        hits = shared_table(hits.unionByName(ahead.select("user_id", F.col("to").alias("seq"), F.col("to_bkt").alias("_bkt"))).distinct(), "cart-hits")
        second = steps.select("user_id", F.col("seq").alias("to"), F.col("to").alias("_last"), F.col("to_bkt").alias("_last_bkt"))
        steps = shared_table(steps.select("user_id", "seq", "to").join(second, ["user_id", "to"])
                             .select("user_id", "seq", F.col("_last").alias("to"), F.col("_last_bkt").alias("to_bkt")), "cart-steps")
    return hits.select("user_id", "_bkt", "seq").distinct()


def commit_outcomes(epochs: DataFrame) -> DataFrame:
    """user_id, seq, ts_ms, commit_ts, outcome for every commit."""
    return (epochs.where(F.col("action") == "commit")
            .select("user_id", "seq", "ts_ms", "commit_ts", "outcome"))


def _epoch_items(epochs: DataFrame) -> DataFrame:
    """Valid items per (user, epoch, product) from the adds' ``valid_ids``."""
    return (epochs.where(F.col("action") == "add")
            .select("user_id", "epoch", F.explode("valid_ids").alias("product_id"))
            .groupBy("user_id", "epoch", "product_id")
            .agg(F.count(F.lit(1)).cast("long").alias("qty")))


def cart_contents(epochs: DataFrame) -> DataFrame:
    """Each user's open cart, long form: user_id, cart_ts, product_id, qty.

    The open cart is the last epoch unless that epoch was closed (by a clear
    or a successful commit), in which case it is empty.  The version is the
    time of the last add, clear, or successful or refused commit, or of the user's first
    command when there was none (the first cart's creation).  An empty open cart is one
    row with null product_id.
    """
    last = (epochs.groupBy("user_id").agg(
        F.max_by(F.struct("epoch", "reset", "action", "ts_ms", "ats"), F.col("seq")).alias("l"),
        F.coalesce(F.max_by("ts_ms", F.when(F.col("action").isin("add", "clear") |
                                            F.col("outcome").isin(OUTCOME_COMMITTED, OUTCOME_FAILED), F.col("seq"))),
                   F.min_by("ts_ms", "seq")).alias("cart_ts")))
    # The open epoch: the last row's epoch, plus one if the last row closed it.
    open_epoch = last.select("user_id", "cart_ts",
                             (F.col("l.epoch") + F.col("l.reset").cast("long")).alias("epoch"))
    items = _epoch_items(epochs)
    return (open_epoch.join(items, ["user_id", "epoch"], "left")
            .select("user_id", "cart_ts", "product_id", "qty"))


def committed_carts(epochs: DataFrame) -> DataFrame:
    """Committed carts by (user, cart timestamp), long form:
    user_id, commit_ts, status, product_id, qty.  When two commits share a
    timestamp the later one wins."""
    ok = epochs.where(F.col("outcome") == OUTCOME_COMMITTED)
    winner = (ok.groupBy("user_id", "commit_ts").agg(F.max_by("epoch", "seq").alias("epoch")))
    items = _epoch_items(epochs)
    return (winner.join(items, ["user_id", "epoch"])
            .select("user_id", "commit_ts", F.lit(CART_STATUS_COMMITTED).alias("status"),
                    "product_id", "qty"))


def merge_carts(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("user_id",),
                scalars: tuple[str, ...] = ()) -> DataFrame:
    """Add two item tables (long form ``keys..., product_id, qty``);
    quantities of the same product add up.  ``scalars`` (timestamp, status)
    are those of the left cart, null where only the right one exists."""
    cols = [*keys, "product_id", "qty"]
    both = left.select(*cols).unionByName(right.select(*cols))
    merged = (both.where(F.col("product_id").isNotNull())
              .groupBy(*keys, "product_id").agg(F.sum("qty").cast("long").alias("qty")))
    if not scalars:
        return merged
    of_left = left.groupBy(*keys).agg(*[F.first(c).alias(c) for c in scalars])
    return merged.join(of_left, list(keys), "left").select(*keys, *scalars, "product_id", "qty")


def cart_kpis(commands: DataFrame) -> DataFrame:
    """productsAdded (valid items, not calls), cartsCommitted,
    cartsOutOfDate, cartCommitFailed, in one aggregate over the folded
    commands (``action, n_valid, outcome``).  CartEmpty is not counted."""
    return commands.agg(
        F.coalesce(F.sum(F.when(F.col("action") == "add", F.col("n_valid"))), F.lit(0))
         .cast("long").alias("products_added"),
        F.count_if(F.col("outcome") == OUTCOME_COMMITTED).alias("carts_committed"),
        F.count_if(F.col("outcome") == OUTCOME_OUT_OF_DATE).alias("carts_out_of_date"),
        F.count_if(F.col("outcome") == OUTCOME_FAILED).alias("cart_commit_failed"))


def cart_reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per user of either side, does the server cart equal the expected
    item counts?  Both inputs long form (user_id, product_id, qty); a null
    product is an empty cart, and two empty carts match.  Full outer join on
    (user, product) with null-safe comparison, then ``bool_and``."""
    users = expected.select("user_id").unionByName(actual.select("user_id")).distinct()
    a = actual.where(F.col("product_id").isNotNull()).select(
        "user_id", "product_id", F.col("qty").cast("long").alias("a_qty"))
    x = expected.where(F.col("product_id").isNotNull()).select(
        "user_id", "product_id", F.col("qty").cast("long").alias("e_qty"))
    j = x.join(a, ["user_id", "product_id"], "full_outer")
    items = j.groupBy("user_id").agg(F.bool_and(F.col("e_qty").eqNullSafe(F.col("a_qty"))).alias("matches"))
    return users.join(items, "user_id", "left").select(
        "user_id", F.coalesce("matches", F.lit(True)).alias("matches"))

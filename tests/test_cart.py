from pyspark.sql import functions as F
import random

import pytest

from skyledger.operators import cart as C
from skyledger.streaming.cart_state import cart_fold
from tests.folds import cart_fold as py_fold

CAT_IDS = [str(i) for i in range(1, 11)]


def _catalog(spark):
    return spark.createDataFrame([(i,) for i in CAT_IDS], "id string")


def _events(spark, rows):
    return spark.createDataFrame(rows, "user_id string, seq long, ts_ms long, action string, "
                                       "product_ids array<string>, commit_ts long, auth_ok boolean")


EDGE = [
    # add with only invalid ids, then commit with the older timestamp -> out of date
    ("u1", 1, 100, "add", ["1", "2", "2"], None, True),
    ("u1", 2, 200, "add", ["x", "y"], None, True),
    ("u1", 3, 210, "commit", [], 100, True),
    ("u1", 4, 220, "commit", [], 200, True),
    ("u1", 5, 230, "commit", [], 200, True),          # two equal commits: second finds empty cart
    # commit on an empty cart
    ("u2", 1, 100, "commit", [], 100, True),
    # clear between add and commit
    ("u3", 1, 100, "add", ["3"], None, True),
    ("u3", 2, 150, "clear", [], None, True),
    ("u3", 3, 160, "commit", [], 100, True),
    # refused commit followed by an add; retry with the new version
    ("u4", 1, 100, "add", ["4"], None, True),
    ("u4", 2, 110, "commit", [], 100, False),
    ("u4", 3, 120, "add", ["5"], None, True),
    ("u4", 4, 130, "commit", [], 120, True),
]


def _py(rows, auth=True):
    users = {}
    for r in rows:
        users.setdefault(r[0], []).append((r[1], r[2], r[3], r[4], r[5], r[6] if auth is None else (r[6] if auth else True)))
    return {u: py_fold(sorted(cmds), set(CAT_IDS)) for u, cmds in users.items()}


def test_edge_rows_fold(spark):
    f = cart_fold(_events(spark, EDGE), _catalog(spark)).collect()
    outcomes = {(r.user_id, r.seq): r.outcome for r in f if r.kind == "outcome" and r.action == "commit"}
    assert outcomes == {("u1", 3): "CartOutOfDate", ("u1", 4): "CartCommitted", ("u1", 5): "CartEmpty",
                        ("u2", 1): "CartEmpty", ("u3", 3): "CartEmpty",
                        ("u4", 2): "CartCommitFailed", ("u4", 4): "CartCommitted"}
    committed = {(r.user_id, r.version, r.product_id): r.qty for r in f if r.kind == "committed"}
    assert committed == {("u1", 200, "1"): 1, ("u1", 200, "2"): 2, ("u4", 120, "4"): 1, ("u4", 120, "5"): 1}
    from skyledger.streaming.cart_state import OUT
    kpis = C.cart_kpis(spark.createDataFrame([r for r in f if r.kind == "outcome"], OUT)).first()
    assert (kpis.products_added, kpis.carts_committed, kpis.carts_out_of_date, kpis.cart_commit_failed) == (6, 2, 1, 1)


def _random_rows(seed, users=12, n=400, refuse=False):
    rnd = random.Random(seed)
    rows, last_add = [], {}
    for seq in range(n):
        u = f"u{rnd.randrange(users)}"
        ts = 1000 + seq * 10
        a = rnd.choice(["add", "add", "add", "clear", "commit", "commit"])
        ids = [rnd.choice(CAT_IDS + ["bad"]) for _ in range(rnd.randint(0, 3))] if a == "add" else []
        ct = None
        if a == "add":
            last_add[u] = ts
        if a == "commit":
            ct = rnd.choice([last_add.get(u, 0), last_add.get(u, 0) - 1, ts - 10])
        ok = not (refuse and rnd.random() < 0.3)
        rows.append((u, seq, ts, a, ids, ct, ok))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_window_version_equals_python_fold(spark, seed):
    rows = _random_rows(seed)
    ev, cat = _events(spark, rows), _catalog(spark)
    ep = C.cart_epochs(ev, cat)
    got = {(r.user_id, r.seq): r.outcome for r in C.commit_outcomes(ep).collect()}
    ref = _py(rows)
    want = {(u, s): o for u, (outs, _, _, _) in ref.items() for s, o in outs.items()}
    assert got == want
    carts = {}
    for r in C.cart_contents(ep).collect():
        carts.setdefault(r.user_id, [r.cart_ts, {}])
        if r.product_id is not None:
            carts[r.user_id][1][r.product_id] = r.qty
    assert carts == {u: [ver, items] for u, (_, items, ver, _) in ref.items()}
    com = {}
    for r in C.committed_carts(ep).collect():
        com.setdefault((r.user_id, r.commit_ts), {})[r.product_id] = r.qty
    assert com == {(u, ct): items for u, (_, _, _, c) in ref.items() for ct, items in c.items()}


def _check_epochs(ep, ref):
    want = {(u, s): o for u, (outs, _, _, _) in ref.items() for s, o in outs.items()}
    assert {(r.user_id, r.seq): r.outcome for r in C.commit_outcomes(ep).collect()} == want
    carts = {}
    for r in C.cart_contents(ep).collect():
        carts.setdefault(r.user_id, [r.cart_ts, {}])
        if r.product_id is not None:
            carts[r.user_id][1][r.product_id] = r.qty
    assert carts == {u: [ver, items] for u, (_, items, ver, _) in ref.items()}
    com = {}
    for r in C.committed_carts(ep).collect():
        com.setdefault((r.user_id, r.commit_ts), {})[r.product_id] = r.qty
    assert com == {(u, ct): items for u, (_, _, _, c) in ref.items() for ct, items in c.items()}
    kpis = C.cart_kpis(ep).first()
    assert [kpis.carts_committed, kpis.carts_out_of_date, kpis.cart_commit_failed] == [
        sum(o == x for o in want.values()) for x in ("CartCommitted", "CartOutOfDate", "CartCommitFailed")]
    return set(want.values())


def _retry_rows(seed, n=300):
    """Clients that retry refused commits with the version they moved to: long
    chains, equal times of neighbouring commands, clears and useless adds between."""
    rnd = random.Random(seed)
    rows, version, ts = [], {}, 1000
    for seq in range(n):
        u = f"u{rnd.randrange(3)}"
        ts += rnd.choice([0, 0, 1, 5])
        a = rnd.choices(["add", "clear", "commit"], [2, 1, 12])[0]
        ids = [rnd.choice(CAT_IDS + ["bad", "bad"]) for _ in range(rnd.randint(0, 3))] if a == "add" else []
        ct = rnd.choice([version.get(u, 0)] * 5 + [version.get(u, 0) - 1, ts, None]) if a == "commit" else None
        ok = rnd.random() < 0.1
        if a != "commit" or ct == version.get(u):
            version[u] = ts
        rows.append((u, seq, ts, a, ids, ct, ok))
    return rows


@pytest.mark.parametrize("seq_bucket", [16, 1 << 16])
def test_window_version_with_refusals_equals_python_fold(spark, seq_bucket):
    for rows in (EDGE, _retry_rows(5)) if seq_bucket > 16 else (_random_rows(3, refuse=True), _retry_rows(6)):
        ep = C.cart_epochs(_events(spark, rows), _catalog(spark), seq_bucket)
        seen = _check_epochs(ep, _py(rows, auth=None))
        assert "CartCommitFailed" in seen


def test_one_long_chain_of_refused_commits(spark):
    n = 150
    rows = [("u", 0, 100, "add", ["1"], None, True)]
    rows += [("u", i, 100 + i, "commit", [], 99 + i, i == n) for i in range(1, n + 1)]
    rows += [("u", n + 1, 500, "commit", [], 100 + n, True)]
    ep = C.cart_epochs(_events(spark, rows), _catalog(spark), 32)
    outs = {r.seq: r.outcome for r in C.commit_outcomes(ep).collect()}
    assert outs == {**{i: "CartCommitFailed" for i in range(1, n)}, n: "CartCommitted", n + 1: "CartEmpty"}


@pytest.mark.parametrize("seed", [3, 4])
def test_stateful_fold_with_refusals_equals_python_fold(spark, seed):
    rows = _random_rows(seed, refuse=True)
    f = cart_fold(_events(spark, rows), _catalog(spark)).collect()
    ref = _py(rows, auth=None)
    got = {(r.user_id, r.seq): r.outcome for r in f if r.kind == "outcome" and r.action == "commit"}
    want = {(u, s): o for u, (outs, _, _, _) in ref.items() for s, o in outs.items()}
    assert got == want
    assert "CartCommitFailed" in set(want.values())
    carts = {}
    for r in f:
        if r.kind == "cart":
            carts.setdefault(r.user_id, [r.version, {}])
            if r.product_id is not None:
                carts[r.user_id][1][r.product_id] = r.qty
    assert carts == {u: [ver, items] for u, (_, items, ver, _) in ref.items()}


def test_validation_and_reconcile(spark):
    ev = _events(spark, [("u", 1, 1, "add", ["1", "x", "1", "x"], None, True)])
    cat = _catalog(spark)
    assert sorted(r.product_id for r in C.validate_products(ev, cat).collect()) == ["1", "1"]
    assert [r.product_id for r in C.invalid_product_ids(ev, cat).collect()] == ["x"]
    exp = spark.createDataFrame([("u", "1", 2)], "user_id string, product_id string, qty long")
    act = spark.createDataFrame([("u", "1", 2), ("v", "2", 1)], "user_id string, product_id string, qty long")
    got = {r.user_id: r.matches for r in C.cart_reconcile(exp, act).collect()}
    assert got == {"u": True, "v": False}
    left = spark.createDataFrame([("u", "1", 2)], "user_id string, product_id string, qty long")
    right = spark.createDataFrame([("u", "1", 1), ("u", "2", 4)], "user_id string, product_id string, qty long")
    assert sorted((r.product_id, r.qty) for r in C.merge_carts(left, right).collect()) == [("1", 3), ("2", 4)]


def test_get_cart_unknown_user_is_empty_open_cart(spark):
    from skyledger.operators.lookups import get_cart
    ev, cat = _events(spark, EDGE).withColumn("auth_ok", F.lit(True)), _catalog(spark)
    carts = C.cart_contents(C.cart_epochs(ev, cat))
    req = spark.createDataFrame([("u4",), ("nobody",)], "user_id string")
    rows = sorted(get_cart(req, carts).collect(), key=lambda r: (r.user_id, r.product_id or ""))
    assert [(r.user_id, r.status, r.product_id) for r in rows] == [("nobody", "Open", None), ("u4", "Open", None)]
    assert rows[1].cart_ts == 130    # u4's last commit succeeded: new empty cart at its time

"""Plain-Python reference folds used as brute-force oracles in tests."""

from __future__ import annotations

import math


def java_hash(s: str) -> int:
    b = s.encode("utf-16-be")
    h = 0
    for i in range(0, len(b), 2):
        h = (h * 31 + int.from_bytes(b[i:i + 2], "big")) & 0xFFFFFFFF
    return h - (1 << 32) if h >= (1 << 31) else h


def org_of(s: str, n: int = 20) -> str:
    h = java_hash(s)
    r = abs(h) % n
    r = -r if h < 0 else r          # JVM remainder keeps the dividend's sign
    return f"Org {abs(r)}"


def xyz(lat, lon):
    la, lo = math.radians(lat), math.radians(lon)
    return (math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la))


def nearest(points, places):
    """points: [(key, lat, lon)], places: [(place_id, lat, lon)] -> {key: place_id}."""
    pp = [(pid, xyz(la, lo)) for pid, la, lo in places]
    out = {}
    for key, la, lo in points:
        q = xyz(la, lo)
        best = min(pp, key=lambda t: (sum((a - b) ** 2 for a, b in zip(q, t[1])), t[0]))
        out[key] = best[0]
    return out


def arrival_window(rows, window=60_000, slide=10_000, start=None):
    """rows: [(ts, temperature, id)] in arrival order -> emitted windows
    [(start, trigger_ts, [rows])]."""
    buf, out = [], []
    for r in rows:
        if start is None:
            start = r[0]
        buf.append(r)
        if r[0] - start > window:
            out.append((start, r[0], list(buf)))
            while True:
                popped = buf.pop(0)
                if not buf or popped[0] >= start:
                    break
            start += slide
    return out


def cart_fold(commands, valid_ids):
    """commands: [(seq, ts, action, ids, commit_ts, auth_ok)] for one user in
    order -> (outcomes {seq: outcome}, open cart dict, version, committed
    {ct: dict})."""
    items, version, committed, outcomes = {}, None, {}, {}
    for seq, ts, action, ids, ct, auth_ok in commands:
        if version is None:
            version = ts
        if action == "add":
            for i in ids:
                if i in valid_ids:
                    items[i] = items.get(i, 0) + 1
            version = ts
        elif action == "clear":
            items, version = {}, ts
        elif action == "commit":
            if not items:
                outcomes[seq] = "CartEmpty"
            elif version != ct:
                outcomes[seq] = "CartOutOfDate"
            else:
                committing, items, version = items, {}, ts
                if auth_ok:
                    outcomes[seq] = "CartCommitted"
                    committed[ct] = committing
                else:
                    outcomes[seq] = "CartCommitFailed"
                    items = dict(committing)
    return outcomes, items, version, committed

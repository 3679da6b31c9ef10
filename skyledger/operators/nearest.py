"""Exact nearest place on the unit sphere, as joins with bounded fan-out.

Both sides are mapped to unit-sphere points (x, y, z); chord distance
orders like great-circle distance.  Ties go to the lowest ``place_id``.

**Fast path (one grid level).**  Places are copied into the 27 cells around
their own cell of size ``c`` (about the mean place spacing), listed by cell, and
each distinct point location is equi-joined with the list of its cell.  Any
place within chord distance ``c`` of a point lies in one of those cells, so
a best candidate within ``c`` (more exactly, within ``c`` plus the
point's distance to the nearest face of its own cell) is the exact answer.  A point takes this path
only if its 27 cells hold between 1 and ``max_candidates`` places (a small
per-cell count table tells), so no point meets more than that many places,
however the places cluster.

**Descent (everything else).**  Points in empty or crowded neighbourhoods,
and fast-path points whose best candidate lies beyond ``c``, walk a cell
pyramid top-down: levels of cell size 2, 1, 1/2, ... each holding, per
non-empty cell, its place count, the bounding box of its places, one
representative place and the largest angle from it to the cell's places.
At each level the frontier (point, cell) keeps only cells whose lower
bound (the larger of the box distance and the angular bound) is within the
best representative distance of the point - an actual place distance, so
the nearest place is never pruned.  Cells with at most ``leaf_size`` places (or at the deepest level)
stop and are joined with their places; the others are replaced by their
children.  The frontier of a point covers the cells near the sphere of
radius "nearest distance" around it, not a whole cluster or the whole
table, so even a point far from every place or next to a dense cluster
pairs with a bounded number of places.

Scale notes:
* Point locations are deduplicated on exact coordinates first, so a device
  parked at one spot (a hot key) is resolved once.
* All joins are equi-joins (cell keys); none is a cross join.  When
  ``27 * num_places <= broadcast_max_copies`` the place-side tables are
  broadcast (checked size); otherwise both sides are shuffled on the cell
  and AQE's skew join splits heavy cells.
* The plan has a fixed length: the fine cell size comes from the number of
  place positions and the pyramid depth is the first level whose most
  crowded cell holds at most ``leaf_size`` places (one small aggregate over
  the place table); there is no driver loop over results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger.functions.geo import chord_distance_sq, unit_sphere_point

_BITS = 21
_OFF = 1 << (_BITS - 1)
_TRIPLES = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)]
_NEIGHBOUR_OFFSETS = [(dx << (2 * _BITS)) + (dy << _BITS) + dz for dx, dy, dz in _TRIPLES]
_MARGIN = 1e-9
# 27 copies per place; 4M copies of (id, x, y, z, cell) ~ 160 MB.
BROADCAST_MAX_COPIES = 4_000_000
MAX_CANDIDATES = 256     # fast path: places a point may meet in its 27 cells
LEAF_SIZE = 32           # descent: cells this small are joined with their places
MAX_DEPTH = 26           # deepest pyramid level: cell size 2 / 2**26 (about 0.2 m on Earth)

_LOC = ["_lat", "_lon"]
_Q = ["qx", "qy", "qz"]


def fine_cell_size(num_places: int) -> float:
    """About the mean spacing of ``num_places`` places on the sphere."""
    n = max(int(num_places), 1)
    return min(max(math.sqrt(4 * math.pi / n), 1e-5), 0.5)


def _cell_key(x: Column, y: Column, z: Column, c: float) -> Column:
    def axis(v):
        return (F.floor(v / F.lit(c)) + F.lit(_OFF)).cast("long")
    return F.shiftleft(axis(x), 2 * _BITS) + F.shiftleft(axis(y), _BITS) + axis(z)


def _level_size(j: int) -> float:
    return 2.0 / (1 << j)


def _idx(v: Column, j: int) -> Column:
    return F.floor(v / F.lit(_level_size(j))).cast("long")


def _angle(ax: str, ay: str, az: str, bx: str, by: str, bz: str) -> Column:
    """Angle between two unit vectors, atan2(|a x b|, a . b): accurate near 0 and pi."""
    a = [F.col(ax), F.col(ay), F.col(az)]
    b = [F.col(bx), F.col(by), F.col(bz)]
    cx = a[1] * b[2] - a[2] * b[1]
    cy = a[2] * b[0] - a[0] * b[2]
    cz = a[0] * b[1] - a[1] * b[0]
    return F.atan2(F.sqrt(cx * cx + cy * cy + cz * cz), a[0] * b[0] + a[1] * b[1] + a[2] * b[2])


def _maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _level_stats(pl: DataFrame, max_depth: int) -> list:
    """(level, most crowded cell, places) for every pyramid level: one small
    aggregate over the place table exploded to all levels."""
    at = pl.select("px", "py", "pz", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("lvl"))
    scale = F.pow(F.lit(2.0), F.col("lvl") - 1)
    per_cell = at.groupBy("lvl", F.floor(F.col("px") * scale).alias("a"), F.floor(F.col("py") * scale).alias("b"),
                          F.floor(F.col("pz") * scale).alias("c")).count()
    return per_cell.groupBy("lvl").agg(F.max("count").alias("m"), F.sum("count").alias("n")).collect()


def _depth_from(stats: list, leaf_size: int, max_depth: int) -> int:
    ok = [r["lvl"] for r in stats if r["m"] <= leaf_size]
    return min(ok) if ok else max_depth


def pyramid_depth(pl: DataFrame, leaf_size: int, max_depth: int = MAX_DEPTH) -> int:
    """The first level at which no cell holds more than ``leaf_size``
    places (capped at ``max_depth``)."""
    return _depth_from(_level_stats(pl, max_depth), leaf_size, max_depth)


def _descend(rem: DataFrame, pl: DataFrame, depth: int, leaf_size: int, small: bool,
             candidates: bool = False) -> DataFrame:
    """Top-down pruned search for the locations in ``rem``; returns
    (_lat, _lon, place_id, _d2) for each of them.

    One pyramid table holds every level (places exploded to levels
    0..depth, grouped by (level, cell)); each level's expansion joins it on
    (level, parent cell), so the same broadcast relation serves all levels,
    and all leaves meet their places in one join on (level, cell)."""
    lvl = F.col("lvl")
    scale = F.pow(F.lit(2.0), lvl - 1)          # 1 / cell size of the level, exact
    at_levels = pl.select("place_id", "px", "py", "pz",
                          F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("lvl"))
    cells = at_levels.select("place_id", "px", "py", "pz", "lvl",
                             F.floor(F.col("px") * scale).cast("long").alias("ix"),
                             F.floor(F.col("py") * scale).cast("long").alias("iy"),
                             F.floor(F.col("pz") * scale).cast("long").alias("iz"))
    key = ["lvl", "ix", "iy", "iz"]
    summ = cells.groupBy(*key).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("px").alias("lx"), F.max("px").alias("hx"), F.min("py").alias("ly"),
        F.max("py").alias("hy"), F.min("pz").alias("lz"), F.max("pz").alias("hz"),
        F.min_by(F.struct("px", "py", "pz"), F.col("place_id")).alias("rep"))
    rad = (cells.join(summ.select(*key, "rep"), key).groupBy(*key)
           .agg(F.max(_angle("px", "py", "pz", "rep.px", "rep.py", "rep.pz")).alias("rad")))
    pyramid = (summ.join(rad, key)
               .select(*key, F.floor(F.col("ix") / 2).cast("long").alias("pix"),
                       F.floor(F.col("iy") / 2).cast("long").alias("piy"),
                       F.floor(F.col("iz") / 2).cast("long").alias("piz"),
                       F.struct("cnt", "lx", "hx", "ly", "hy", "lz", "hz", "rep", "rad").alias("n")))

    # Level 0 (cell size 2): the 27 cells around a point's own cover the sphere.
    start = rem.select(*_LOC, *_Q, F.explode(F.array(*[
        F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz"))
        for a, b, c in _TRIPLES])).alias("_o"))
    frontier = start.select(*_LOC, *_Q, F.lit(0).alias("lvl"),
                            (_idx(F.col("qx"), 0) + F.col("_o.dx")).alias("ix"),
                            (_idx(F.col("qy"), 0) + F.col("_o.dy")).alias("iy"),
                            (_idx(F.col("qz"), 0) + F.col("_o.dz")).alias("iz"))
    level0 = pyramid.where(lvl == 0).select(*key, "n")
    frontier = (frontier.join(_maybe_broadcast(level0, small), key)
                .withColumn("_leaf", F.lit(False)))
    children = pyramid.select(F.col("lvl").alias("clvl"), "pix", "piy", "piz",
                              F.col("ix").alias("cix"), F.col("iy").alias("ciy"),
                              F.col("iz").alias("ciz"), F.col("n").alias("cn"))

    def gap(q, lo, hi):
        g = F.greatest(F.col("n." + lo) - F.col(q), F.lit(0.0), F.col(q) - F.col("n." + hi))
        return g * g

    rep = ("n.rep.px", "n.rep.py", "n.rep.pz")
    rep_d2 = chord_distance_sq(F.col("qx"), F.col("qy"), F.col("qz"), *[F.col(c) for c in rep])
    box_lb2 = gap("qx", "lx", "hx") + gap("qy", "ly", "hy") + gap("qz", "lz", "hz")
    # Angular bound: angle(q, p) >= angle(q, rep) - radius for every p in the
    # cell; tight also for far points, where the box bound is loose.
    theta = F.greatest(_angle("qx", "qy", "qz", *rep) - F.col("n.rad") - F.lit(1e-12), F.lit(0.0))
    cap_lb = 2 * F.sin(F.least(theta, F.lit(math.pi)) / 2)
    lb2 = F.greatest(box_lb2, cap_lb * cap_lb)
    by_loc = W.partitionBy(*_LOC)
    cols = [*_LOC, *_Q, *key, "n", "_leaf"]
    # One linear chain: at each level prune by the bound, then a left join
    # replaces each expanding cell by its children while leaf cells (no
    # match) pass through; leaf rows keep tightening the bound.
    for j in range(depth + 1):
        frontier = (frontier.select(*cols, rep_d2.alias("_rd2"), lb2.alias("_lb2"))
                    .withColumn("_u2", F.min("_rd2").over(by_loc))
                    .where(F.col("_lb2") <= F.col("_u2") * (1 + _MARGIN) + F.lit(1e-18)).select(*cols))
        if j == depth:
            break
        frontier = frontier.withColumn("_leaf", F.col("_leaf") | (F.col("n.cnt") <= leaf_size))
        ch = _maybe_broadcast(children, small)
        cond = ((frontier["lvl"] + 1 == ch["clvl"]) & (frontier["ix"] == ch["pix"])
                & (frontier["iy"] == ch["piy"]) & (frontier["iz"] == ch["piz"]) & ~frontier["_leaf"])
        j2 = frontier.join(ch, cond, "left")
        expanded = F.col("clvl").isNotNull()
        frontier = j2.select(
            *_LOC, *_Q,
            F.when(expanded, F.col("clvl")).otherwise(F.col("lvl")).alias("lvl"),
            F.when(expanded, F.col("cix")).otherwise(F.col("ix")).alias("ix"),
            F.when(expanded, F.col("ciy")).otherwise(F.col("iy")).alias("iy"),
            F.when(expanded, F.col("ciz")).otherwise(F.col("iz")).alias("iz"),
            F.when(expanded, F.col("cn")).otherwise(F.col("n")).alias("n"),
            F.col("_leaf"))

    d2 = chord_distance_sq(F.col("qx"), F.col("qy"), F.col("qz"), F.col("px"), F.col("py"), F.col("pz"))
    cand = frontier.select(*_LOC, *_Q, *key).join(_maybe_broadcast(cells, small), key).select(
        *_LOC, F.struct(d2.alias("d2"), F.col("place_id")).alias("_c"))
    if candidates:
        return cand
    best = cand.groupBy(*_LOC).agg(F.min("_c").alias("_b"))
    return best.select(*_LOC, F.col("_b.place_id").alias("place_id"), F.col("_b.d2").alias("_d2"))


def _positions(places: DataFrame) -> DataFrame:
    """Distinct place positions on the unit sphere; at one position the
    lowest id wins."""
    return (places.select("place_id", *unit_sphere_point(F.col("lat"), F.col("lon"), "p"))
            .groupBy("px", "py", "pz").agg(F.min("place_id").alias("place_id")))


def place_stats(places: DataFrame, leaf_size: int = LEAF_SIZE,
                max_depth: int = MAX_DEPTH) -> dict[str, int]:
    """Number of place positions and pyramid depth in one small job, for
    callers that join many batches against the same place table."""
    stats = _level_stats(_positions(places), max_depth)
    n = sum(int(r["n"]) for r in stats if r["lvl"] == 0)
    return {"num_places": n, "depth": _depth_from(stats, leaf_size, max_depth)}


def nearest_place(points: DataFrame, places: DataFrame, *, lat: str = "lat", lon: str = "lon",
                  place_cols: tuple[str, ...] = ("name", "province", "country"),
                  fine_cell: float | None = None, num_places: int | None = None,
                  max_candidates: int = MAX_CANDIDATES, leaf_size: int = LEAF_SIZE,
                  max_depth: int = MAX_DEPTH, depth: int | None = None, with_distance: bool = False,
                  broadcast_max_copies: int = BROADCAST_MAX_COPIES) -> DataFrame:
    """Adds ``place_id`` and ``place_cols`` of the nearest place to each row.

    ``places`` needs ``place_id, lat, lon`` plus ``place_cols``.  Rows with a
    null coordinate get null place columns.  ``num_places`` and the pyramid
    ``depth`` are computed from the place table when not given (a stream
    computes them once, see :func:`place_stats`).
    """
    pl = _positions(places)
    if num_places is None or depth is None:
        st = place_stats(places, leaf_size, max_depth)
        num_places = st["num_places"] if num_places is None else num_places
        depth = st["depth"] if depth is None else depth
    c0 = fine_cell or fine_cell_size(num_places)
    small = num_places * 27 <= broadcast_max_copies
    locs = (points.select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
            .where(F.col("_lat").isNotNull() & F.col("_lon").isNotNull())
            .distinct()
            .select(*_LOC, *unit_sphere_point(F.col("_lat"), F.col("_lon"), "q")))

    # -- fast path ------------------------------------------------------------
    own = pl.select("place_id", "px", "py", "pz",
                    _cell_key(F.col("px"), F.col("py"), F.col("pz"), c0).alias("_own"))
    offsets = F.explode(F.array(*[F.lit(o) for o in _NEIGHBOUR_OFFSETS])).alias("_off")
    per_cell = own.groupBy("_own").agg(F.count(F.lit(1)).alias("_n"))
    around = (per_cell.select("_own", "_n", offsets)
              .groupBy((F.col("_own") + F.col("_off")).alias("_cell")).agg(F.sum("_n").alias("_nbr")))
    copies = (own.select("place_id", "px", "py", "pz", "_own", offsets)
              .select("place_id", "px", "py", "pz", (F.col("_own") + F.col("_off")).alias("_cell")))
    # The places a cell's points meet, as one list of at most max_candidates: a
    # location stays one row, so its candidates are neither sorted nor shuffled.
    listed = around.where(F.col("_nbr").between(1, max_candidates)).select("_cell")
    near = (copies.join(_maybe_broadcast(listed, small), "_cell", "left_semi").groupBy("_cell")
            .agg(F.collect_list(F.struct("place_id", "px", "py", "pz")).alias("_near")))

    def candidate(p):
        d2 = chord_distance_sq(F.col("qx"), F.col("qy"), F.col("qz"), p["px"], p["py"], p["pz"])
        return F.struct(d2.alias("d2"), p["place_id"].alias("place_id"))
    # Locations outside the fast path get no candidate and go on to the descent.
    # explode: the least candidate is worked out once, not again in each filter on it.
    best = (locs.withColumn("_cell", _cell_key(F.col("qx"), F.col("qy"), F.col("qz"), c0))
            .join(_maybe_broadcast(near, small), "_cell", "left")
            .select(*_LOC, *_Q, F.explode(F.array(F.array_min(F.transform("_near", candidate)))).alias("_b")))
    # The 27 cells cover every place closer than c0 * (1 + m), m the point's
    # smallest distance (in cells) to a face of its own cell.
    def frac(v):
        u = F.col(v) / F.lit(c0)
        u = u - F.floor(u)
        return F.least(u, 1 - u)
    reach = F.lit(c0) * (1 + F.least(frac("qx"), frac("qy"), frac("qz"))) * (1 - _MARGIN)
    best = best.withColumn("_ok", F.coalesce(F.col("_b.d2") <= reach * reach, F.lit(False)))
    settled = best.where("_ok").select(*_LOC, F.col("_b.place_id").alias("place_id"),
                                       F.col("_b.d2").alias("_d2"))

    # -- descent for the rest ----------------------------------------------------
    rest = best.where(~F.col("_ok")).select(*_LOC, *_Q)
    # a pyramid row has about eight times the bytes of a copy, and there is one a level
    small_pyramid = num_places * (depth + 1) * 8 <= broadcast_max_copies
    resolved = settled.unionByName(_descend(rest, pl, depth, leaf_size, small_pyramid))

    attrs = places.select("place_id", *place_cols)
    out = (points.join(resolved,
                       (points[lat] == resolved["_lat"]) & (points[lon] == resolved["_lon"]),
                       "left")
           .drop("_lat", "_lon"))
    out = out.join(attrs, "place_id", "left")
    return out.withColumnRenamed("_d2", "chord_d2") if with_distance else out.drop("_d2")

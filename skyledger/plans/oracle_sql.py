"""DuckDB SQL for the registered queries (the correctness oracle).

The CTEs restate the fixture views (FIXTURES.md section 2) and then each
query independently in plain SQL.  The nearest place is brute force here
(every point against every place), which is only fine at test scale.
"""

from __future__ import annotations

_JAVA_HASH = ("list_reduce(list_prepend(0::BIGINT, list_transform(string_split({c}, ''), "
              "lambda ch: unicode(ch)::BIGINT)), lambda a, ch: (a * 31 + ch) & 4294967295)")


def _signed(u: str) -> str:
    return f"(CASE WHEN {u} >= 2147483648 THEN {u} - 4294967296 ELSE {u} END)"


def _org(c: str, n: int = 20) -> str:
    h = _signed(_JAVA_HASH.format(c=c))
    return f"('Org ' || CAST(abs({h} % {n}) AS VARCHAR))"


def _xyz(p: str, lat: str = "lat", lon: str = "lon") -> str:
    return (f"cos(radians({lat})) * cos(radians({lon})) AS {p}x, "
            f"cos(radians({lat})) * sin(radians({lon})) AS {p}y, "
            f"sin(radians({lat})) AS {p}z")


# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "m": ((), """SELECT event_id AS arrival_seq, concat('drone-', CAST(user_id AS VARCHAR)) AS id,
        1704067200000 + event_id * 200 AS ts_ms, CAST(value AS DOUBLE) AS temperature,
        CAST((user_id * 37 + event_id * 7) % 18000 AS DOUBLE) / 100 - 90 AS lat,
        CAST((user_id * 91 + event_id * 13) % 36000 AS DOUBLE) / 100 - 180 AS lon FROM events"""),
    "mo": (("m",), f"SELECT *, {_org('id')} AS org FROM m"),
    "p": ((), """SELECT s_suppkey AS place_id, s_name AS name, n_name AS province, r_name AS country,
        CASE WHEN s_suppkey % 3 = 0 THEN 'A' ELSE 'P' END AS feature_class,
        CAST((s_suppkey * 7919) % 18000 AS DOUBLE) / 100 - 90 AS lat,
        CAST((s_suppkey * 104729) % 36000 AS DOUBLE) / 100 - 180 AS lon
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "pq": (("p",), f"SELECT place_id, {_xyz('p')} FROM p"),
    "mq": (("mo",), f"SELECT arrival_seq, {_xyz('q')} FROM mo"),
    "nn": (("mq", "pq"), """SELECT arrival_seq, place_id FROM (
        SELECT mq.arrival_seq, pq.place_id, row_number() OVER (PARTITION BY mq.arrival_seq
          ORDER BY (qx - px) * (qx - px) + (qy - py) * (qy - py) + (qz - pz) * (qz - pz), pq.place_id) AS rk
        FROM mq, pq) WHERE rk = 1"""),
    "en": (("mo", "nn", "p"), """SELECT mo.*, p.place_id, p.name, p.province, p.country,
        p.name || ', ' || coalesce(p.province, 'null') || ' ' || coalesce(p.country, 'null') AS city
        FROM mo JOIN nn USING (arrival_seq) JOIN p USING (place_id)"""),
    "w": (("en",), """SELECT en.*, (ts_ms // 10000 - k) * 10000 AS window_start_ms,
        (ts_ms // 10000 - k) * 10000 + 60000 AS window_end_ms
        FROM en, range(0, 6) AS t(k)"""),
    "d1": (("w",), """SELECT org, city, window_start_ms, window_end_ms, avg(temperature) AS avg_temperature,
        count(*) AS n, arg_min(id, arrival_seq) AS first_id, arg_min(ts_ms, arrival_seq) AS first_ts_ms,
        arg_min(lat, arrival_seq) AS first_lat, arg_min(lon, arrival_seq) AS first_lon
        FROM w GROUP BY org, city, window_start_ms, window_end_ms"""),
    "d2": (("w",), "SELECT DISTINCT org, window_start_ms, window_end_ms, id FROM w"),
    "d3": (("w",), "SELECT DISTINCT org, window_start_ms, window_end_ms, city, id FROM w"),
    "d4": (("d1",), """SELECT org, city, max(window_end_ms) - 60000 AS window_start_ms,
        max(window_end_ms) AS window_end_ms, arg_max(avg_temperature, window_end_ms) AS avg_temperature,
        arg_max(n, window_end_ms) AS n FROM d1 GROUP BY org, city"""),
    "d5": (("d3",), """SELECT d3.* FROM d3 JOIN (SELECT org, max(window_end_ms) AS newest FROM d3 GROUP BY org) x
        ON d3.org = x.org AND d3.window_end_ms = x.newest"""),
    "preq": (("p",), f"""SELECT {_org('name', 25)} AS org,
        name || ', ' || coalesce(province, 'null') || ' ' || coalesce(country, 'null') AS city FROM p"""),
    "pk": (("m",), """SELECT id, (ts_ms // 10000 + 1) * 10000 AS timestamp, count(*) AS n_measurements,
        min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms, min(arrival_seq) AS arrival_seq
        FROM m GROUP BY id, ts_ms // 10000"""),
    # carts
    "cat": ((), "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part"),
    "b": ((), """SELECT CAST(user_id AS VARCHAR) AS user_id, event_id AS seq, 1704067200000 + event_id * 200 AS ts_ms,
        event_type,
        CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'add' WHEN 'signup' THEN 'clear' ELSE 'commit' END AS action,
        CASE WHEN event_id % 11 = 0 THEN concat('x-', CAST(event_id AS VARCHAR))
             ELSE CAST((event_id * 31) % 200 AS VARCHAR) END AS product_id,
        CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS qty FROM events"""),
    "ce": (("b",), """SELECT *, CASE WHEN action = 'commit' THEN
        max(CASE WHEN action = 'add' THEN ts_ms END) OVER (PARTITION BY user_id ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        - CASE WHEN event_type = 'error' THEN 1 ELSE 0 END END AS commit_ts FROM b"""),
    "v": (("ce", "cat"), """SELECT ce.*, CASE WHEN action = 'add' AND product_id IN (SELECT id FROM cat)
        THEN qty ELSE 0 END AS n_valid FROM ce"""),
    "s1": (("v",), """SELECT *,
        sum(CASE WHEN action = 'add' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg,
        last_value(CASE WHEN action = 'add' THEN ts_ms END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ats FROM v"""),
    "s2": (("s1",), """SELECT *, coalesce(action = 'clear' OR (action = 'commit' AND commit_ts = ats), false) AS r0
        FROM s1"""),
    "s3": (("s2",), """SELECT *, r0 AND NOT coalesce(max(CASE WHEN r0 THEN 1 ELSE 0 END) OVER (
        PARTITION BY user_id, seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false)
        AS reset FROM s2"""),
    "s4": (("s3",), """SELECT *, coalesce(sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
        ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM s3"""),
    "s5": (("s4",), """SELECT *, sum(CASE WHEN action = 'add' THEN n_valid ELSE 0 END) OVER (
        PARTITION BY user_id, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM s4"""),
    "ep": (("s5",), """SELECT *, CASE WHEN action <> 'commit' THEN NULL WHEN n = 0 THEN 'CartEmpty'
        WHEN commit_ts = ats THEN 'CartCommitted' ELSE 'CartOutOfDate' END AS outcome FROM s5"""),
    "items": (("ep",), """SELECT user_id, epoch, product_id, CAST(sum(n_valid) AS BIGINT) AS qty FROM ep
        WHERE action = 'add' AND n_valid > 0 GROUP BY user_id, epoch, product_id"""),
    "oe": (("ep",), """SELECT user_id,
        coalesce(max(CASE WHEN action IN ('add', 'clear') OR outcome = 'CartCommitted' THEN ts_ms END),
                 min(ts_ms)) AS cart_ts,
        arg_max(epoch, seq) + CASE WHEN arg_max(reset, seq) THEN 1 ELSE 0 END AS epoch
        FROM ep GROUP BY user_id"""),
    "d9": (("oe", "items"), """SELECT oe.user_id, oe.cart_ts, items.product_id, items.qty
        FROM oe LEFT JOIN items ON oe.user_id = items.user_id AND oe.epoch = items.epoch"""),
    "d11": (("ep", "items"), """SELECT w.user_id, w.commit_ts, 'Committed' AS status, items.product_id, items.qty
        FROM (SELECT user_id, commit_ts, arg_max(epoch, seq) AS epoch FROM ep WHERE outcome = 'CartCommitted'
              GROUP BY user_id, commit_ts) w
        JOIN items ON w.user_id = items.user_id AND w.epoch = items.epoch"""),
    "sess": (("ep",), """SELECT user_id || '-' || CAST(session_no AS VARCHAR) AS session_id,
        CASE WHEN outcome = 'CartCommitted' THEN NULL ELSE 'CommitCart' END AS stage,
        CASE WHEN outcome = 'CartCommitted' THEN NULL
             WHEN outcome IN ('CartOutOfDate', 'CartEmpty') THEN 'cart timestamp out of date or empty cart'
             ELSE 'error committing to cart with status: 500 Internal Server Error' END AS reason,
        outcome = 'CartCommitted' AS success, start_ms, end_ms
        FROM (SELECT user_id, session_no, min(ts_ms) AS start_ms, arg_max(action, seq) AS last_action,
                     arg_max(outcome, seq) AS outcome, arg_max(ts_ms, seq) AS end_ms
              FROM (SELECT *, coalesce(sum(CASE WHEN action = 'commit' THEN 1 ELSE 0 END) OVER (
                      PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                      AS session_no FROM ep)
              GROUP BY user_id, session_no)
        WHERE last_action = 'commit'"""),
}


# H2, row by row: the window start and the buffer's first row before row i of a key
for _name, _keys in (("ht", "org, city"), ("hd", "org")):
    CTES[f"{_name}_list"] = (("en",), f"SELECT {_keys}, list(ts_ms ORDER BY arrival_seq) AS ts FROM en GROUP BY {_keys}")
    CTES[f"{_name}_step"] = ((f"{_name}_list",), f"""SELECT {_keys}, 1::BIGINT AS i, ts[1] AS w, 1::BIGINT AS f FROM {_name}_list
        UNION ALL SELECT {_keys}, i + 1, CASE WHEN ts[i] - w > 60000 THEN w + 10000 ELSE w END,
        CASE WHEN ts[i] - w > 60000 THEN f + list_position(list_transform(ts[f:i], lambda t: t >= w), true) ELSE f END
        FROM {_name}_step JOIN {_name}_list USING ({_keys}) WHERE i <= len(ts)""")
    CTES[f"{_name}_fired"] = ((f"{_name}_step",), f"""SELECT {_keys}, i, w, f, ts[i] AS trigger_ts_ms,
        row_number() OVER (PARTITION BY {_keys} ORDER BY i) AS emit_no
        FROM {_name}_step JOIN {_name}_list USING ({_keys}) WHERE ts[i] - w > 60000""")
    CTES[f"{_name}_rows"] = (("en",), f"SELECT *, row_number() OVER (PARTITION BY {_keys} ORDER BY arrival_seq) AS rn FROM en")

# carts with refused authentication, command by command: the state after command rn
CTES["rc"] = (("v",), "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn, seq % 7 <> 0 AS ok FROM v")
CTES["rc_step"] = (("rc",), """SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS seq, ts_ms, NULL::BIGINT AS commit_ts, NULL::VARCHAR AS action,
        NULL::VARCHAR AS product_id, 0::BIGINT AS n_valid, ts_ms AS version, 0::BIGINT AS n, 0::BIGINT AS epoch, NULL::VARCHAR AS outcome
        FROM rc WHERE rn = 1
        UNION ALL SELECT c.user_id, c.rn, c.seq, c.ts_ms, c.commit_ts, c.action, c.product_id, c.n_valid,
        CASE WHEN c.action <> 'commit' OR (s.n > 0 AND c.commit_ts = s.version) THEN c.ts_ms ELSE s.version END,
        CASE WHEN c.action = 'add' THEN s.n + c.n_valid WHEN c.action = 'clear' OR (c.commit_ts = s.version AND c.ok) THEN 0 ELSE s.n END,
        s.epoch + CASE WHEN c.action = 'clear' OR (c.action = 'commit' AND s.n > 0 AND c.commit_ts = s.version AND c.ok) THEN 1 ELSE 0 END,
        CASE WHEN c.action <> 'commit' THEN NULL WHEN s.n = 0 THEN 'CartEmpty'
             WHEN c.commit_ts = s.version THEN CASE WHEN c.ok THEN 'CartCommitted' ELSE 'CartCommitFailed' END ELSE 'CartOutOfDate' END
        FROM rc_step s JOIN rc c ON c.user_id = s.user_id AND c.rn = s.rn + 1""")
CTES["rc_items"] = (("rc_step",), """SELECT user_id, epoch, product_id, CAST(sum(n_valid) AS BIGINT) AS qty FROM rc_step
        WHERE n_valid > 0 GROUP BY user_id, epoch, product_id""")


def sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    recursive = "RECURSIVE " if any(n.endswith("_step") for n in order) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


R6 = "round({c}, 6) AS {a}"


CTES["lat"] = (("sess", "ce", "pk"), """SELECT 'session' AS kind, end_ms - start_ms AS ms FROM sess
        UNION ALL SELECT 'commit', ts_ms - commit_ts FROM ce WHERE action = 'commit' AND commit_ts IS NOT NULL
        UNION ALL SELECT 'send', timestamp - first_ts_ms FROM pk""")
CTES["adm"] = (("en",), f"""SELECT *, row_number() OVER (PARTITION BY abs({_signed(_JAVA_HASH.format(c='org'))}) % 9 ORDER BY first_seq) <= 20 AS admitted
        FROM (SELECT org, city, min(arrival_seq) AS first_seq FROM en GROUP BY org, city)""")

REFUSED_KPIS = sql("""SELECT CAST(coalesce(sum(n_valid), 0) AS BIGINT) AS products_added,
        count(*) FILTER (outcome = 'CartCommitted') AS carts_committed,
        count(*) FILTER (outcome = 'CartOutOfDate') AS carts_out_of_date,
        count(*) FILTER (outcome = 'CartCommitFailed') AS cart_commit_failed FROM rc_step""", "rc_step")

ORACLE: dict[str, str] = {
    # --- telemetry -------------------------------------------------------
    "pack_measurements": sql("SELECT * FROM pk", "pk"),
    "stream_pack_measurements": sql("SELECT * FROM pk", "pk"),
    "flatten_measurements": sql("""SELECT id,
        min(arrival_seq) OVER (PARTITION BY id, ts_ms // 10000) AS arrival_seq,
        row_number() OVER (PARTITION BY id, ts_ms // 10000 ORDER BY ts_ms) - 1 AS arrival_pos,
        ts_ms, CAST(CAST(temperature AS FLOAT) AS DOUBLE) AS temperature, lat, lon FROM m""", "m"),
    "assign_org": sql(f"""SELECT DISTINCT id, {_signed(_JAVA_HASH.format(c='id'))} AS id_hash, org FROM mo""", "mo"),
    "qualified_places": sql(f"""SELECT place_id,
        name || ', ' || coalesce(province, 'null') || ' ' || coalesce(country, 'null') AS city,
        round(cos(radians(lat)) * cos(radians(lon)), 9) AS x, round(cos(radians(lat)) * sin(radians(lon)), 9) AS y,
        round(sin(radians(lat)), 9) AS z FROM p""", "p"),
    "major_places_by_country": sql("""SELECT place_id, name, country FROM p
        WHERE feature_class = 'P' AND country IN ('ASIA', 'EUROPE', 'AMERICA')""", "p"),
    "nearest_place": sql("SELECT arrival_seq, id, org, place_id, city FROM en", "en"),
    "avg_city_temperature": sql(f"""SELECT org, city, window_start_ms, window_end_ms,
        {R6.format(c='avg_temperature', a='avg_temperature')}, n, first_id, first_ts_ms, first_lat, first_lon
        FROM d1""", "d1"),
    "arrival_window_city_temperature": sql("""SELECT org, city, emit_no, w AS window_start_ms, trigger_ts_ms, count(*) AS n,
        round(avg(temperature), 6) AS avg_temperature, arg_min(id, rn) AS first_id, arg_min(ts_ms, rn) AS first_ts_ms,
        arg_min(lat, rn) AS first_lat, arg_min(lon, rn) AS first_lon
        FROM ht_fired JOIN ht_rows USING (org, city) WHERE rn BETWEEN f AND i GROUP BY org, city, emit_no, w, trigger_ts_ms""",
        "ht_fired", "ht_rows"),
    "arrival_window_drones": sql("""SELECT DISTINCT org, emit_no, w AS window_start_ms, trigger_ts_ms, city, id
        FROM hd_fired JOIN hd_rows USING (org) WHERE rn BETWEEN f AND i""", "hd_fired", "hd_rows"),
    "drones_per_org": sql("SELECT * FROM d2", "d2"),
    "drones_per_city": sql("SELECT * FROM d3", "d3"),
    "kept_drones_per_city": sql("SELECT * FROM d3", "d3"),
    "kept_get_drone_summary": sql("""SELECT r.org, d5.city, d5.id FROM (SELECT DISTINCT org FROM preq) r
        LEFT JOIN d5 ON r.org = d5.org""", "preq", "d5"),
    "kept_get_cities": sql("""SELECT r.org, k.city FROM (SELECT DISTINCT org FROM preq) r
        LEFT JOIN (SELECT DISTINCT org, city FROM d4) k ON r.org = k.org""", "preq", "d4"),
    # packets carry single-precision temperatures
    "kept_get_temperature": sql("""SELECT r.org, r.city, round(f.t, 6) AS cityTemperature FROM preq r LEFT JOIN (
        SELECT org, city, arg_max(t, window_end_ms) AS t FROM (SELECT org, city, window_end_ms,
            avg(CAST(CAST(temperature AS FLOAT) AS DOUBLE)) AS t FROM w GROUP BY org, city, window_end_ms) GROUP BY org, city) f
        ON r.org = f.org AND r.city = f.city""", "preq", "w"),
    "kept_city_temperature_windows": sql("""SELECT org, city, window_start_ms, window_end_ms,
        round(avg(CAST(CAST(temperature AS FLOAT) AS DOUBLE)), 6) AS avg_temperature, count(*) AS n,
        arg_min(id, ord) AS first_id, arg_min(ts_ms, ord) AS first_ts_ms
        FROM (SELECT w.*, q.ord FROM w JOIN (SELECT arrival_seq,
                min(arrival_seq) OVER (PARTITION BY id, ts_ms // 10000) * 1000000
                + row_number() OVER (PARTITION BY id, ts_ms // 10000 ORDER BY ts_ms) AS ord FROM m) q USING (arrival_seq))
        GROUP BY org, city, window_start_ms, window_end_ms""", "w", "m"),
    "drone_summary_replies": sql("""SELECT o.org, o.ids AS drone_ids, c.cities AS drones_per_city
        FROM (SELECT org, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT org, id FROM d5) GROUP BY org) o
        JOIN (SELECT org, string_agg(city || '=' || ids, '|' ORDER BY city || '=' || ids) AS cities FROM (
            SELECT org, city, string_agg(id, ',' ORDER BY id) AS ids FROM d5 GROUP BY org, city) GROUP BY org) c
        ON o.org = c.org""", "d5"),
    "drone_counts": sql("""SELECT org, window_start_ms, window_end_ms, count(*) AS drone_count FROM d2
        GROUP BY ALL""", "d2"),
    "city_drone_counts": sql("""SELECT org, window_start_ms, window_end_ms, city, count(*) AS city_drone_count
        FROM d3 GROUP BY ALL""", "d3"),
    "latest_city_temperature": sql(f"""SELECT org, city, window_start_ms, window_end_ms,
        {R6.format(c='avg_temperature', a='avg_temperature')}, n FROM d4""", "d4"),
    "latest_drone_summary": sql("SELECT * FROM d5", "d5"),
    "num_cities": sql("SELECT org, count(DISTINCT city) AS num_cities FROM d4 GROUP BY org", "d4"),
    "group_limit_guard": sql("""SELECT count(*) AS org_city_groups, count(DISTINCT org) AS org_groups,
        count(*) <= 50000 AND count(DISTINCT org) <= 10000 AS within_limits
        FROM (SELECT DISTINCT org, city FROM en)""", "en"),
    "org_report": sql(f"""SELECT d4.org, d4.city, {R6.format(c='d4.avg_temperature', a='temperature')},
        c.city_drone_count, o.drone_count
        FROM d4 LEFT JOIN (SELECT org, city, count(*) AS city_drone_count FROM d5 GROUP BY org, city) c
          ON d4.org = c.org AND d4.city = c.city
        LEFT JOIN (SELECT org, count(DISTINCT id) AS drone_count FROM d5 GROUP BY org) o ON d4.org = o.org""",
        "d4", "d5"),
    "fan_out": sql("""SELECT 'city_temperature' AS summary, org, city, window_start_ms,
        round(avg_temperature, 6) AS value FROM d1
        UNION ALL SELECT 'drones_per_city' AS summary, org, city, window_start_ms,
        CAST(count(*) AS DOUBLE) AS value FROM d3 GROUP BY org, city, window_start_ms""", "d1", "d3"),
    "get_cities": sql("""SELECT r.org, k.city FROM (SELECT DISTINCT org FROM preq) r
        LEFT JOIN (SELECT DISTINCT org, city FROM d4) k ON r.org = k.org""", "preq", "d4"),
    "get_temperature": sql("""SELECT r.org, r.city, round(d4.avg_temperature, 6) AS cityTemperature
        FROM preq r LEFT JOIN d4 ON r.org = d4.org AND r.city = d4.city""", "preq", "d4"),
    "get_drone_summary": sql("""SELECT r.org, d5.city, d5.id FROM (SELECT DISTINCT org FROM preq) r
        LEFT JOIN d5 ON r.org = d5.org""", "preq", "d5"),
    "sorted_orgs": sql("SELECT DISTINCT org FROM mo", "mo"),
    "report_intervals": sql("""SELECT id, arrival_seq, ts_ms,
        ts_ms - lag(ts_ms) OVER (PARTITION BY id ORDER BY ts_ms, arrival_seq) AS interval_ms FROM m""", "m"),
    "send_stats": sql("""SELECT id, count(*) AS packets, CAST(sum(n_measurements) AS BIGINT) AS measurements_sent,
        arg_max(n_measurements, timestamp) AS last_batch_size FROM pk GROUP BY id""", "pk"),
    "stage_throughput": sql("""SELECT pipeline, stage, rows FROM (
        SELECT 'data-enrichment' AS pipeline, 'pre-pipeline' AS stage, (SELECT count(*) FROM pk) AS rows
        UNION ALL SELECT 'data-enrichment', 'flatten-data', (SELECT count(*) FROM pk)
        UNION ALL SELECT 'data-enrichment', 'broadcast-downstream', (SELECT count(*) FROM m)
        UNION ALL SELECT 'summarize-by-org', 'pre-pipeline', (SELECT count(*) FROM m)
        UNION ALL SELECT 'summarize-by-org', 'group-by-org-city', (SELECT count(*) FROM m)
        UNION ALL SELECT 'summarize-by-city', 'pre-pipeline', (SELECT count(*) FROM m)
        UNION ALL SELECT 'summarize-by-city', 'group-by-org', (SELECT count(*) FROM m))""", "pk", "m"),
    "send_errors": sql("""SELECT 'malformed' AS error, count(DISTINCT id) AS errors FROM m
        UNION ALL SELECT 'null id', count(DISTINCT id) FROM m""", "m"),
    "get_cities_lists": sql("""SELECT r.org, coalesce(k.cities, '') AS cities FROM preq r LEFT JOIN (
        SELECT org, string_agg(city, '|' ORDER BY city) AS cities FROM (SELECT DISTINCT org, city FROM d4) GROUP BY org) k
        ON r.org = k.org""", "preq", "d4"),
    "sample_places": sql("""SELECT place_id, name, lat, lon FROM p
        ORDER BY md5('7:' || CAST(place_id AS VARCHAR)), place_id LIMIT 20""", "p"),
    # --- carts -----------------------------------------------------------
    "validate_products": sql("""SELECT user_id, seq, unnest(range(qty)) AS pos, product_id FROM ce
        WHERE action = 'add' AND product_id IN (SELECT id FROM cat)""", "ce", "cat"),
    "invalid_product_ids": sql("""SELECT DISTINCT user_id, seq, product_id FROM ce
        WHERE action = 'add' AND qty > 0 AND product_id NOT IN (SELECT id FROM cat)""", "ce", "cat"),
    "distinct_ids": sql("""SELECT user_id, seq, CASE WHEN qty > 0 THEN 1 ELSE 0 END AS n_distinct,
        qty AS n_ids FROM ce WHERE action = 'add'""", "ce"),
    "cart_epochs": sql("""SELECT user_id, seq, action, CAST(epoch AS BIGINT) AS epoch, reset,
        CAST(n AS BIGINT) AS n FROM ep""", "ep"),
    "refused_commit_outcomes": sql("SELECT user_id, seq, ts_ms, commit_ts, outcome FROM rc_step WHERE action = 'commit'", "rc_step"),
    "refused_cart_contents": sql("""SELECT l.user_id, l.version AS cart_ts, i.product_id, i.qty
        FROM (SELECT user_id, arg_max(version, rn) AS version, arg_max(epoch, rn) AS epoch FROM rc_step GROUP BY user_id) l
        LEFT JOIN rc_items i ON l.user_id = i.user_id AND l.epoch = i.epoch""", "rc_items"),
    "refused_committed_carts": sql("""SELECT w.user_id, w.commit_ts, 'Committed' AS status, i.product_id, i.qty
        FROM (SELECT user_id, commit_ts, arg_max(epoch, rn) - 1 AS epoch FROM rc_step WHERE outcome = 'CartCommitted'
              GROUP BY user_id, commit_ts) w JOIN rc_items i ON w.user_id = i.user_id AND w.epoch = i.epoch""", "rc_items"),
    "refused_cart_kpis": REFUSED_KPIS,
    "cart_fold_refused_auth_kpis": REFUSED_KPIS,
    "commit_outcomes": sql("SELECT user_id, seq, ts_ms, commit_ts, outcome FROM ep WHERE action = 'commit'", "ep"),
    "cart_contents": sql("SELECT * FROM d9", "d9"),
    "committed_carts": sql("SELECT * FROM d11", "d11"),
    "merge_carts": sql("""SELECT user_id, product_id, CAST(sum(qty) AS BIGINT) AS qty FROM (
        SELECT user_id, product_id, qty FROM d9 UNION ALL SELECT user_id, product_id, qty FROM d11)
        WHERE product_id IS NOT NULL GROUP BY user_id, product_id""", "d9", "d11"),
    "cart_kpis": sql("""SELECT CAST(coalesce(sum(CASE WHEN action = 'add' THEN n_valid END), 0) AS BIGINT) AS products_added,
        CAST(count_if(outcome = 'CartCommitted') AS BIGINT) AS carts_committed,
        CAST(count_if(outcome = 'CartOutOfDate') AS BIGINT) AS carts_out_of_date,
        CAST(count_if(outcome = 'CartCommitFailed') AS BIGINT) AS cart_commit_failed FROM ep""", "ep"),
    "cart_reconcile": sql("""SELECT u.user_id, coalesce(bool_and(i.e_qty IS NOT DISTINCT FROM i.a_qty), true) AS matches
        FROM (SELECT DISTINCT user_id FROM d9) u LEFT JOIN (
          SELECT coalesce(x.user_id, a.user_id) AS user_id, x.e_qty, a.a_qty, true AS item
          FROM (SELECT ep.user_id, ep.product_id, CAST(sum(ep.qty) AS BIGINT) AS e_qty FROM ep
                JOIN oe ON ep.user_id = oe.user_id AND ep.epoch = oe.epoch
                WHERE ep.action = 'add' AND ep.qty > 0 GROUP BY ep.user_id, ep.product_id) x
          FULL OUTER JOIN (SELECT user_id, product_id, qty AS a_qty FROM d9 WHERE product_id IS NOT NULL) a
            ON x.user_id = a.user_id AND x.product_id = a.product_id) i ON u.user_id = i.user_id
        GROUP BY u.user_id""", "ep", "oe", "d9"),
    "get_cart": sql("""SELECT r.user_id, 'Open' AS status, d9.cart_ts, d9.product_id, d9.qty
        FROM (SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer) r
        LEFT JOIN d9 ON r.user_id = d9.user_id""", "d9"),
    "catalog_listing": """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS description,
        p_brand AS category, CAST(p_retailprice AS FLOAT) AS unit_price FROM part""",
    "session_outcomes_all_stages": sql("""SELECT success, stage, reason, count(*) AS sessions FROM (
        SELECT o = 'CartCommitted' AND NOT bad AS success,
          CASE WHEN bad THEN 'QueryShoppingCart' WHEN o <> 'CartCommitted' THEN 'CommitCart' END AS stage,
          CASE WHEN bad THEN 'shopping cart doesn''t match' WHEN o IN ('CartOutOfDate', 'CartEmpty') THEN 'cart timestamp out of date or empty cart'
               WHEN o = 'CartCommitFailed' THEN 'error committing to cart with status: 500 Internal Server Error' END AS reason
        FROM (SELECT arg_max(action, seq) AS a, arg_max(outcome, seq) AS o,
                coalesce(max(CASE WHEN wrong THEN epoch END) = arg_max(epoch, seq), false) AS bad
              FROM (SELECT s.user_id, s.seq, s.action, s.outcome, s.action = 'add' AND rc.qty > s.n_valid AS wrong,
                      s.epoch - CASE WHEN s.action = 'clear' OR coalesce(s.outcome = 'CartCommitted', false) THEN 1 ELSE 0 END AS epoch,
                      coalesce(sum(CASE WHEN s.action = 'commit' THEN 1 ELSE 0 END) OVER (PARTITION BY s.user_id ORDER BY s.seq
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session_no
                    FROM rc_step s JOIN rc ON s.user_id = rc.user_id AND s.seq = rc.seq)
              GROUP BY user_id, session_no) WHERE a = 'commit') GROUP BY ALL""", "rc_step"),
    "latency_quantiles": sql("""SELECT kind, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95,
        quantile_disc(ms, 0.99) AS p99 FROM lat GROUP BY kind""", "lat"),
    "latency_sketch_bounds": sql("""SELECT kind, q, min(ms) AS low, max(ms) AS high FROM (
        SELECT l.kind, w.q, l.ms, l.b = max(CASE WHEN l.ms = w.v THEN l.b END) OVER (PARTITION BY l.kind, w.q) AS here
        FROM (SELECT kind, ms, (ms >> greatest(length(bin(ms)) - 7, 0)) << greatest(length(bin(ms)) - 7, 0) AS b FROM lat) l
        JOIN (SELECT kind, unnest([0.5, 0.95, 0.99])::DOUBLE AS q,
                unnest([quantile_disc(ms, 0.5), quantile_disc(ms, 0.95), quantile_disc(ms, 0.99)]) AS v FROM lat GROUP BY kind) w
        ON l.kind = w.kind) WHERE here GROUP BY kind, q""", "lat"),
    "group_admission": sql("SELECT en.arrival_seq, en.org, en.city, adm.admitted FROM en JOIN adm USING (org, city)", "adm"),
    "merge_carts_of_left": sql("""SELECT m.user_id, l.cart_ts, l.status, m.product_id, m.qty FROM (
          SELECT user_id, product_id, CAST(sum(qty) AS BIGINT) AS qty FROM (
            SELECT user_id, product_id, qty FROM d9 UNION ALL SELECT user_id, product_id, qty FROM d11)
          WHERE product_id IS NOT NULL GROUP BY user_id, product_id) m
        LEFT JOIN (SELECT DISTINCT user_id, cart_ts, 'Open' AS status FROM d9) l ON m.user_id = l.user_id""", "d9", "d11"),
    "temperature_replies_json": sql("""SELECT CAST(to_json({'org': r.org, 'city': r.city, 'cityTemperature': round(d4.avg_temperature, 6)}) AS VARCHAR) AS json
        FROM preq r LEFT JOIN d4 ON r.org = d4.org AND r.city = d4.city""", "preq", "d4"),
    "session_outcomes": sql("SELECT success, stage, reason, count(*) AS sessions FROM sess GROUP BY ALL", "sess"),
    "latency_stats": sql("""SELECT count(end_ms - start_ms) AS n, min(end_ms - start_ms) AS min_ms,
        max(end_ms - start_ms) AS max_ms, round(avg(end_ms - start_ms), 6) AS avg_ms FROM sess""", "sess"),
    "active_sessions": sql("""SELECT session_id, t, delta, CAST(sum(delta) OVER (ORDER BY t, delta DESC, session_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS active FROM (
          SELECT session_id, start_ms AS t, 1 AS delta FROM sess
          UNION ALL SELECT session_id, end_ms AS t, -1 AS delta FROM sess)""", "sess"),
    # --- stateful fold (H5 batch twin) against the window-function oracle ---
    "cart_fold_outcomes": sql("SELECT user_id, seq, ts_ms, outcome FROM ep WHERE action = 'commit'", "ep"),
    "cart_fold_contents": sql("SELECT * FROM d9", "d9"),
    "cart_fold_committed": sql("SELECT * FROM d11", "d11"),
    # --- file sources --------------------------------------------------------
    "read_places_tsv": sql("SELECT place_id, name, province, country, feature_class, lat, lon FROM p", "p"),
    "read_packets_json": sql("""SELECT id,
        min(arrival_seq) OVER (PARTITION BY id, ts_ms // 10000) AS arrival_seq,
        row_number() OVER (PARTITION BY id, ts_ms // 10000 ORDER BY ts_ms) - 1 AS arrival_pos,
        ts_ms, CAST(CAST(temperature AS FLOAT) AS DOUBLE) AS temperature, lat, lon FROM m""", "m"),
    "commit_outcomes_from_files": sql(
        "SELECT user_id, seq, ts_ms, commit_ts, outcome FROM ep WHERE action = 'commit'", "ep"),
    # packets carry float temperatures: the same D4 over float-rounded values
    "stream_latest_city_temperature": sql("""SELECT org, city, max(window_end_ms) - 60000 AS window_start_ms,
        max(window_end_ms) AS window_end_ms, round(arg_max(t, window_end_ms), 6) AS avg_temperature,
        arg_max(n, window_end_ms) AS n FROM (
          SELECT org, city, window_start_ms, window_end_ms,
                 avg(CAST(CAST(temperature AS FLOAT) AS DOUBLE)) AS t, count(*) AS n
          FROM w GROUP BY org, city, window_start_ms, window_end_ms)
        GROUP BY org, city""", "w"),
}

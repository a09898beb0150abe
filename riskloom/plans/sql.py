"""SQL counterparts of the registered queries, over the same tables."""

from __future__ import annotations

TZ = "America/Los_Angeles"


def _local(ts: str) -> str:
    return f"timezone('{TZ}', timezone('UTC', {ts}))"


def _from_local(wall: str) -> str:
    return f"timezone('UTC', timezone('{TZ}', {wall}))"


def _season(month: str) -> str:
    return (
        f"CASE WHEN {month} IN (12, 1, 2) THEN 'winter' WHEN {month} IN (3, 4, 5) THEN 'spring' "
        f"WHEN {month} IN (6, 7, 8) THEN 'summer' ELSE 'fall' END"
    )


def _calendar(ts: str) -> str:
    return (
        f"CAST(year({ts}) AS INTEGER) AS year, CAST(month({ts}) AS INTEGER) AS month, "
        f"CAST(isodow({ts}) - 1 AS INTEGER) AS day_of_week"
    )


def _hour_calendar(ts: str) -> str:
    return f"{_calendar(ts)}, CAST(hour({ts}) AS INTEGER) AS hour, {_season(f'month({ts})')} AS season"


def _avg(x: str, name: str, digits: int = 4) -> str:
    return f"round(avg({x}) + 1e-7, {digits}) AS {name}"


def _day_incidents(area: str = "CAST(c.c_nationkey AS VARCHAR)") -> str:
    return f"""inc AS (
  SELECT {area} AS "GEOID", date_trunc('hour', o.o_orderdate)::TIMESTAMP AS dt, o.o_totalprice, i.item_count
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS item_count FROM lineitem GROUP BY 1) i ON i.l_orderkey = o.o_orderkey)"""


DAY = _day_incidents()
SEGMENT = _day_incidents("CAST(c.c_nationkey AS VARCHAR) || '-' || c.c_mktsegment")
HOUR = """inc AS (SELECT CAST(user_id AS VARCHAR) AS "GEOID", date_trunc('hour', ts)::TIMESTAMP AS dt, value FROM events)"""

# Dense grids; side features stay unrounded for further use.
DAY_GRID = """cells AS (
  SELECT "GEOID", date_trunc('day', dt)::TIMESTAMP AS t0, count(*) AS crime_count,
         avg(o_totalprice) AS o_totalprice, coalesce(sum(item_count), 0) AS item_count
  FROM inc GROUP BY 1, 2),
grid AS (
  SELECT k."GEOID", d.t0, CAST(coalesce(c.crime_count, 0) AS BIGINT) AS crime_count, c.o_totalprice, c.item_count,
         CAST(coalesce(c.crime_count, 0) > 0 AS INTEGER) AS "Y_label"
  FROM (SELECT DISTINCT "GEOID" FROM cells) k
  CROSS JOIN (SELECT unnest(generate_series(min(t0), max(t0), INTERVAL 1 DAY)) AS t0 FROM cells) d
  LEFT JOIN cells c ON c."GEOID" = k."GEOID" AND c.t0 = d.t0)"""
HOUR_GRID = """cells AS (SELECT "GEOID", dt, count(*) AS crime_count, avg(value) AS value FROM inc GROUP BY 1, 2),
grid AS (
  SELECT k."GEOID", d.dt, CAST(coalesce(c.crime_count, 0) AS BIGINT) AS crime_count, c.value,
         CAST(coalesce(c.crime_count, 0) > 0 AS INTEGER) AS "Y_label"
  FROM (SELECT DISTINCT "GEOID" FROM cells) k
  CROSS JOIN (SELECT unnest(generate_series(min(dt), max(dt), INTERVAL 1 HOUR)) AS dt FROM cells) d
  LEFT JOIN cells c ON c."GEOID" = k."GEOID" AND c.dt = d.dt)"""


def _window(name: str, days: int, keys: str, t: str) -> str:
    return (
        f"{name} AS (PARTITION BY {keys} ORDER BY {t} "
        f"RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
    )


def _prior(suffix: str, w: str, y: str = '"Y_label"') -> str:
    return (
        f"CAST(coalesce(sum({y}) OVER {w}, 0) AS DOUBLE) AS prior_cnt_{suffix}, "
        f"coalesce(CAST(sum({y}) OVER {w} AS DOUBLE) / nullif(count(*) OVER {w}, 0), 0) AS prior_p_{suffix}"
    )


DOW = "isodow(t0) - 1"
STANDARD = f"""{DAY_GRID},
std AS (
  SELECT *, {_calendar("t0")}, 0::INTEGER AS hour_start, {_prior("28d", "a")}, {_prior("180d", "b")}
  FROM grid WINDOW {_window("a", 28, f'"GEOID", {DOW}', "t0")}, {_window("b", 180, f'"GEOID", {DOW}', "t0")})"""
PANEL = f"""{DAY_GRID},
panel AS (
  SELECT *, {_calendar("t0")}, {_prior("3m", "a")}, {_prior("12m", "b")}
  FROM grid WINDOW {_window("a", 90, f'"GEOID", {DOW}', "t0")}, {_window("b", 365, f'"GEOID", {DOW}', "t0")})"""
HOUR_KEYS = f'"GEOID", isodow(dt), hour(dt), {_season("month(dt)")}'
HOUR_PANEL = f"""{HOUR_GRID},
panel AS (
  SELECT *, {_hour_calendar("dt")}, {_prior("3m", "a")}, {_prior("12m", "b")}
  FROM grid WINDOW {_window("a", 90, HOUR_KEYS, "dt")}, {_window("b", 365, HOUR_KEYS, "dt")})"""


def _shifted(suffix: str, days: int, y: str = '"Y_label"') -> str:
    """Frame of the previous row: lag over a window ending at the own row."""
    return f"own_{suffix}", (
        f"sum({y}) OVER (PARTITION BY \"GEOID\", day_of_week ORDER BY t0 RANGE BETWEEN "
        f"INTERVAL {days * 86400 * 1000000 - 1} MICROSECOND PRECEDING AND CURRENT ROW) AS own_{suffix}"
    )


def _shifted_priors(source: str) -> str:
    frames = ", ".join(_shifted(s, d)[1] for s, d in (("28d", 28), ("180d", 180)))
    lagged = ", ".join(
        f"""CAST(coalesce(lag(own_{s}) OVER g, 0) AS DOUBLE) AS prior_cnt_{s},
  round(coalesce(lag(own_{s}) OVER g, 0) / {d * 24.0}, 10) AS prior_p_{s}"""
        for s, d in (("28d", 28), ("180d", 180))
    )
    return f"""SELECT * EXCLUDE (own_28d, own_180d), {lagged}
FROM (SELECT *, {frames} FROM {source}) WINDOW g AS (PARTITION BY "GEOID", day_of_week ORDER BY t0)"""


def _coarse(start: str) -> str:
    """Weekly or monthly grid with averaged side features and fresh priors."""
    return f"""WITH {DAY}, {DAY_GRID}, coarse AS (
  SELECT "GEOID", {start} AS t0, CAST(sum(crime_count) AS BIGINT) AS crime_count,
         {_avg("o_totalprice", "o_totalprice")}, {_avg("item_count", "item_count")},
         CAST(sum(crime_count) > 0 AS INTEGER) AS "Y_label"
  FROM grid GROUP BY 1, 2)
SELECT *, {_calendar("t0")}, 0::INTEGER AS hour_start, {_prior("28d", "a")}, {_prior("180d", "b")}
FROM coarse WINDOW {_window("a", 28, f'"GEOID", {DOW}', "t0")}, {_window("b", 180, f'"GEOID", {DOW}', "t0")}"""


def _anchored(days: int, ts: str) -> str:
    # The run day's local midnight: 2024-01-31 00:00 in Los Angeles.
    return f"time_bucket(INTERVAL {days} DAY, {ts}, TIMESTAMP '2024-01-31 08:00:00')"


LOCAL_DAY = _from_local(f"date_trunc('day', {_local('{}')})")


def _windowed(start: str) -> str:
    return f"""WITH {HOUR}, {HOUR_GRID}, rolled AS (
  SELECT "GEOID", {start} AS t0, CAST(sum(crime_count) AS BIGINT) AS crime_count, {_avg("value", "value")},
         CAST(sum(crime_count) > 0 AS INTEGER) AS "Y_label"
  FROM grid GROUP BY 1, 2),
w AS (SELECT *, {_calendar(_local("t0"))}, CAST(hour({_local("t0")}) AS INTEGER) AS hour_start FROM rolled)"""


def _windowed_closed(start: str) -> str:
    keys = '"GEOID", day_of_week'
    return f"""{_windowed(start)}, p AS (
SELECT *, {_prior("28d", "a")}, {_prior("180d", "b")}
FROM w WINDOW {_window("a", 28, keys, "t0")}, {_window("b", 180, keys, "t0")})
SELECT * REPLACE (round(prior_p_28d, 10) AS prior_p_28d, round(prior_p_180d, 10) AS prior_p_180d) FROM p"""


CARRIED = "crime_count, prior_cnt_28d, prior_p_28d, prior_cnt_180d, prior_p_180d"
SNAPSHOT = f"""{STANDARD},
snap AS (
  SELECT "GEOID", {CARRIED} FROM std QUALIFY row_number() OVER (PARTITION BY "GEOID" ORDER BY t0 DESC) = 1)"""


def _starts(count: int, step: int) -> str:
    return (
        f"SELECT TIMESTAMP '2001-08-02' + to_days(CAST(i * {step} AS INTEGER)) AS t0 "
        f"FROM (SELECT unnest(range({count})) AS i)"
    )


FRAME = f"""SELECT s.*, f.t0, {_calendar("f.t0")}, 0::INTEGER AS hour_start FROM snap s CROSS JOIN ({{starts}}) f"""
SCORES = f"""{SNAPSHOT},
future AS ({_starts(30, 1)}),
scored AS (
  SELECT s."GEOID", f.t0, CAST(CAST(s.prior_p_180d / (1 + isodow(f.t0) - 1) AS FLOAT) AS DOUBLE) AS prob
  FROM snap s CROSS JOIN future f),
q AS (
  SELECT quantile_cont(prob, 0.8) AS q1, quantile_cont(prob, 0.6) AS q2,
         quantile_cont(prob, 0.4) AS q3, quantile_cont(prob, 0.2) AS q4 FROM scored),
ranked AS (
  SELECT scored.*, CASE WHEN prob >= q1 THEN 1 WHEN prob >= q2 THEN 2 WHEN prob >= q3 THEN 3
         WHEN prob >= q4 THEN 4 ELSE 5 END AS tier_rank
  FROM scored CROSS JOIN q),
tiered AS (
  SELECT "GEOID", t0, prob, CAST(tier_rank AS INTEGER) AS tier_rank,
         ['Çok Yüksek', 'Yüksek', 'Orta', 'Düşük', 'Çok Düşük'][tier_rank] AS tier FROM ranked)"""
TRAIN = f"""{DAY_GRID},
placed AS (
  SELECT *, row_number() OVER (ORDER BY t0, "GEOID") AS pos, count(*) OVER () AS total FROM grid),
train AS (SELECT *, {_calendar("t0")} FROM placed WHERE pos <= CAST(floor(total * 0.8) AS BIGINT))"""

DOCS = """docs AS (
  SELECT l.doc_id, l.quality AS y, CAST(d.n_chars / 20000.0 AS FLOAT) AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
by_score AS (SELECT p AS threshold, count(*) AS n, sum(y) AS pos FROM docs GROUP BY 1),
cum AS (
  SELECT threshold, pos, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos, sum(pos) OVER () AS total
  FROM by_score WINDOW w AS (ORDER BY threshold DESC)),
curve AS (
  SELECT threshold, pos, total, CAST(cum_pos AS DOUBLE) / cum_n AS precision, CAST(cum_pos AS DOUBLE) / total AS recall
  FROM cum)"""
CONFUSION = f"""{DOCS},
cm AS (
  SELECT count(*) FILTER (y = 0 AND p < 0.25::FLOAT) AS tn, count(*) FILTER (y = 0 AND p >= 0.25::FLOAT) AS fp,
         count(*) FILTER (y = 1 AND p < 0.25::FLOAT) AS fn, count(*) FILTER (y = 1 AND p >= 0.25::FLOAT) AS tp
  FROM docs)"""
HORIZON = r"""req AS (
  SELECT c_custkey, CAST(c_custkey % 120 + 1 AS DOUBLE) AS n, CAST(c_custkey % 12 AS INTEGER) AS form FROM customer),
hours AS (
  SELECT c_custkey, CASE form WHEN 0 THEN n WHEN 1 THEN n * 24 WHEN 2 THEN n * 168 WHEN 3 THEN n * 720 WHEN 4 THEN n * 24
         WHEN 5 THEN 720 WHEN 6 THEN n + 0.5 WHEN 7 THEN n * 24 + 6.5 WHEN 8 THEN -n * 24
         WHEN 9 THEN n * 10 WHEN 10 THEN n * 24 END AS hours FROM req),
planned AS (
  SELECT *, CASE WHEN hours <= 720 THEN '1D' WHEN hours <= 2160 THEN '1W' WHEN hours IS NOT NULL THEN '1M' END AS freq
  FROM hours)"""
LEAK_ROLES = {
    '"GEOID"': "dropped", "t0": "dropped", "crime_count": "dropped", '"Y_label"': "dropped",
    "year": "categorical", "month": "categorical", "day_of_week": "categorical", "o_totalprice": "numeric",
    "risk_x": "dropped", "metrics_y": "dropped", "my_label_z": "dropped", "crime_count_lag": "dropped",
    "area_name": "dropped",
}
LEAK_LINES = " UNION ALL ".join(
    f"SELECT '{c.strip(chr(34))}' AS column_name, '{role}' AS role, count(*) - count({c}) AS missing FROM g"
    for c, role in LEAK_ROLES.items()
)
# What a strict choice says of the same columns.
STRICT_LINES = " UNION ALL ".join(
    f"SELECT '{c.strip(chr(34))}' AS column_name, '{role}' AS role, count(*) - count({c}) AS missing FROM g"
    for c, role in (LEAK_ROLES | {"my_label_z": "forbidden", "crime_count_lag": "forbidden"}).items()
)
VALID_LINES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) > 1 AS is_valid FROM t"
    for c in ("year", "month", "hour_start", "o_totalprice", "empty", "crime_count")
)


REPORT = """report AS (
  SELECT row_number() OVER (ORDER BY t0, prob DESC, "GEOID") AS position, * FROM (
    SELECT "GEOID", t0, prob, tier FROM tiered QUALIFY row_number() OVER (PARTITION BY t0 ORDER BY prob DESC, "GEOID") <= 10))"""

# Slot 0 is the number, then come the categories seen in training, as texts in order.
ENCODED = f"""parts AS (
  SELECT *, {_calendar("t0")}, day(t0) / 31.0::DOUBLE AS day, pos <= CAST(floor(total * 0.8) AS BIGINT) AS is_train FROM placed
  WHERE pos > CAST(floor(total * 0.8) AS BIGINT) OR month(t0) <> 12),
categories AS (
  SELECT "GEOID", t0, is_train, "Y_label", unnest([{{'c': 0, 'v': month::DOUBLE::VARCHAR}}, {{'c': 1, 'v': day_of_week::DOUBLE::VARCHAR}}], recursive := true)
  FROM parts),
slots AS (SELECT c, v, CAST(row_number() OVER (ORDER BY c, v) AS INTEGER) AS slot FROM (SELECT DISTINCT c, v FROM categories WHERE is_train)),
encoded AS (
  SELECT "GEOID", t0, is_train, "Y_label", slot, 1.0::DOUBLE AS value FROM categories JOIN slots USING (c, v)
  UNION ALL SELECT "GEOID", t0, is_train, "Y_label", 0, day FROM parts)"""


def _median_filled(source: str) -> str:
    return f"round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM {source})) + 1e-7, 4) AS o_totalprice"


def _mode_filled(name: str) -> str:
    return (
        f"CAST(coalesce(CASE WHEN day(t0) <= 28 THEN {name} END, (SELECT {name} FROM train WHERE day(t0) <= 28 "
        f"GROUP BY {name} ORDER BY count(*) DESC, {name} LIMIT 1)) AS INTEGER) AS {name}"
    )


SQL: dict[str, str] = {
    "scan_pruned": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "schema_check": """SELECT 'risk' AS table_kind, true AS schema_ok, 'geoid,hour,risk_score' AS columns_found,
  count(*) AS row_count FROM events
UNION ALL SELECT 'metrics', true, 'metric,value,timestamp', count(*) FROM events""",
    "event_time": """SELECT o_orderkey, CASE WHEN o_orderkey % 97 <> 0
  THEN date_trunc('day', o_orderdate)::TIMESTAMP + to_hours(CAST(o_orderkey % 24 AS INTEGER)) END AS dt FROM orders""",
    "local_time": f"SELECT event_id, {_local('ts')} AS local_ts FROM events",
    "calendar": f"SELECT event_id, {_hour_calendar('ts')} FROM events",
    "calendar_local": f"""SELECT o_orderkey, o_orderdate AS t0, {_calendar(_local("o_orderdate"))},
  CAST(hour({_local("o_orderdate")}) AS INTEGER) AS hour_start, {_local("o_orderdate")} AS t0_local FROM orders""",
    "stored_types": """SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour,
  CAST(value > 50 AS INTEGER) AS "Y_label", CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
  'smallint tinyint tinyint tinyint tinyint float' AS types FROM events""",
    "season": f"SELECT {_season('month(o_orderdate)')} AS season, count(*) AS row_count FROM orders GROUP BY 1",
    "label": """SELECT event_id, CASE WHEN event_id % 13 <> 0 AND floor(value - 10) > 0 THEN 1 ELSE 0 END AS "Y_label"
FROM events""",
    "local_day": f"SELECT o_orderkey, {LOCAL_DAY.format('o_orderdate')} AS t0 FROM orders",
    "bucket_week": "SELECT o_orderkey, time_bucket(INTERVAL 7 DAY, o_orderdate, TIMESTAMP '1970-01-01') AS t0 FROM orders",
    "bucket_month": "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS t0 FROM orders",
    "bucket_anchored": f"SELECT event_id, {_anchored(7, 'ts')} AS week_start, {_anchored(30, 'ts')} AS month_start FROM events",
    "horizon_hours": f"WITH {HORIZON} SELECT c_custkey, CAST(hours AS DOUBLE) AS hours, freq FROM planned",
    "future_index": f"""WITH {HORIZON}, sized AS (
  SELECT *, CASE freq WHEN '1D' THEN CAST(ceil(hours / 24) AS BIGINT) WHEN '1W' THEN CAST(ceil(hours / 168) AS BIGINT)
         ELSE greatest(1, CAST(ceil(hours / 720) AS BIGINT)) END AS steps FROM planned WHERE freq IS NOT NULL),
stepped AS (SELECT c_custkey, freq, unnest(range(greatest(steps, 0))) AS i FROM sized)
SELECT c_custkey, freq, NULL::TIMESTAMP AS t0 FROM planned WHERE c_custkey NOT IN (SELECT c_custkey FROM stepped)
UNION ALL SELECT c_custkey, freq, CASE freq WHEN '1M' THEN TIMESTAMP '2001-08-02 09:30:00' ELSE TIMESTAMP '2001-08-02' END
  + to_days(CAST(i * CASE freq WHEN '1D' THEN 1 WHEN '1W' THEN 7 ELSE 30 END AS INTEGER)) AS t0 FROM stepped""",
    "request_report": f"""WITH {HORIZON}, sized AS (
  SELECT *, CASE freq WHEN '1D' THEN CAST(ceil(hours / 24) AS BIGINT) WHEN '1W' THEN CAST(ceil(hours / 168) AS BIGINT)
         WHEN '1M' THEN greatest(1, CAST(ceil(hours / 720) AS BIGINT)) END AS steps FROM planned)
SELECT c_custkey, CASE WHEN hours IS NULL THEN 'unreadable' WHEN steps <= 0 THEN 'too short' END AS problem,
  greatest(coalesce(steps, 0), 0) AS starts FROM sized""",
    "hourly_counts": f"""WITH {HOUR}
SELECT "GEOID", dt, count(*) AS crime_count, 1::INTEGER AS "Y_label", {_hour_calendar("dt")} FROM inc GROUP BY "GEOID", dt""",
    "hourly_sum": f"""WITH {HOUR}
SELECT "GEOID", dt, CAST(sum(floor(value)) AS BIGINT) AS crime_count,
  CAST(sum(floor(value)) > 0 AS INTEGER) AS "Y_label" FROM inc GROUP BY 1, 2""",
    "daily_counts": f"""WITH {DAY}, c AS (
  SELECT "GEOID", date_trunc('day', dt)::TIMESTAMP AS t0, count(*) AS crime_count FROM inc GROUP BY 1, 2)
SELECT *, 1::INTEGER AS "Y_label", {_calendar("t0")} FROM c""",
    "side_features": f"""WITH {DAY}
SELECT "GEOID", date_trunc('day', dt)::TIMESTAMP AS t0, count(*) AS crime_count, {_avg("o_totalprice", "o_totalprice")},
  CAST(coalesce(sum(item_count), 0) AS DOUBLE) AS item_count FROM inc GROUP BY 1, 2""",
    "side_features_hourly": f"""WITH {HOUR}
SELECT "GEOID", dt, count(*) AS crime_count, {_avg("value", "value")} FROM inc GROUP BY 1, 2""",
    "grid_daily": f"""WITH {DAY}, {DAY_GRID}
SELECT * REPLACE (round(o_totalprice + 1e-7, 4) AS o_totalprice) FROM grid""",
    "grid_hourly": f"""WITH {HOUR}, {HOUR_GRID} SELECT "GEOID", dt, crime_count, "Y_label" FROM grid""",
    "grid_stats": f"""WITH {SEGMENT}, {DAY_GRID}
SELECT count(*) AS row_count, count(DISTINCT "GEOID") AS area_count, min(t0) AS first_time, max(t0) AS last_time,
  round(avg("Y_label") + 1e-7, 6) AS label_rate FROM grid""",
    "label_stats": f"""WITH {SEGMENT}, {DAY_GRID}, t AS (
  SELECT count(*) FILTER ("Y_label" = 1) AS y1, count(*) FILTER ("Y_label" = 0) AS y0 FROM grid)
SELECT 1::INTEGER AS "Y_label", y1 AS "Count", round(100.0::DOUBLE * y1 / (y1 + y0), 4) AS "Percent(%)" FROM t
UNION ALL SELECT 0, y0, round(100.0::DOUBLE * y0 / (y1 + y0), 4) FROM t""",
    "prior_28d": f"""WITH {DAY}, {STANDARD} SELECT "GEOID", t0, prior_cnt_28d, prior_p_28d FROM std""",
    "prior_180d": f"""WITH {DAY}, {STANDARD} SELECT "GEOID", t0, prior_cnt_180d, prior_p_180d FROM std""",
    "prior_3m": f"""WITH {DAY}, {PANEL}
SELECT "GEOID", t0, crime_count, "Y_label", day_of_week, prior_cnt_3m, prior_p_3m FROM panel""",
    "prior_12m": f"""WITH {DAY}, {PANEL} SELECT "GEOID", t0, prior_cnt_12m, prior_p_12m FROM panel""",
    "prior_hourly": f"""WITH {HOUR}, {HOUR_PANEL}
SELECT "GEOID", dt, day_of_week, hour, season, prior_cnt_3m, prior_p_3m FROM panel""",
    "panel_daily": f"""WITH {SEGMENT}, {PANEL}
SELECT * EXCLUDE (item_count) REPLACE (round(o_totalprice + 1e-7, 4) AS o_totalprice) FROM panel""",
    "panel_daily_local": f"""WITH {DAY}, {DAY_GRID}
SELECT "GEOID", t0, crime_count, "Y_label", {_calendar(_local("t0"))}, {_local("t0")} AS t0_local,
  {_prior("3m", "a")}, {_prior("12m", "b")}
FROM grid WINDOW {_window("a", 90, f'"GEOID", isodow({_local("t0")})', "t0")},
  {_window("b", 365, f'"GEOID", isodow({_local("t0")})', "t0")}""",
    "panel_hourly": f"""WITH {HOUR}, {HOUR_PANEL} SELECT * REPLACE (round(value + 1e-7, 4) AS value) FROM panel""",
    "prior_shifted": f"""WITH {DAY}, {DAY_GRID},
w AS (SELECT "GEOID", t0, "Y_label", CAST({DOW} AS INTEGER) AS day_of_week FROM grid) {_shifted_priors("w")}""",
    "prior_repeated_cells": f"""WITH {DAY}, r AS (
  SELECT "GEOID", dt AS t0, CAST(o_totalprice > 250000 AS INTEGER) AS "Y_label" FROM inc)
SELECT *, {_prior("28d", "a")} FROM r WINDOW {_window("a", 28, '"GEOID"', "t0")}""",
    "prior_null_keys": f"""WITH r AS (
  SELECT CAST(o_custkey AS VARCHAR) AS "GEOID", date_trunc('day', o_orderdate)::TIMESTAMP AS t0,
         max(CAST(o_totalprice > 250000 AS INTEGER)) AS "Y_label", max(o_orderkey) AS k FROM orders GROUP BY 1, 2),
d AS (SELECT * EXCLUDE (k), CAST({DOW} AS INTEGER) AS day_of_week FROM r WHERE k % 5 <> 0)
SELECT *, {_prior("28d", "a")} FROM d WINDOW {_window("a", 28, '"GEOID", day_of_week', "t0")}""",
    "prior_shifted_blocks": f"""WITH {DAY}, r AS (
  SELECT "GEOID", dt AS t0, CAST(floor(o_totalprice / 50000) AS BIGINT) AS block_id,
         max(CAST(o_totalprice % 2 < 1 AS INTEGER)) AS "Y_label" FROM inc GROUP BY 1, 2, 3),
u AS (
  SELECT *, sum("Y_label") OVER (PARTITION BY "GEOID" ORDER BY t0, block_id ROWS UNBOUNDED PRECEDING)
    - coalesce(sum("Y_label") OVER (PARTITION BY "GEOID" ORDER BY t0
        RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 28 DAY PRECEDING), 0) AS own FROM r),
s AS (SELECT *, CAST(coalesce(lag(own) OVER (PARTITION BY "GEOID" ORDER BY t0, block_id), 0) AS BIGINT) AS c FROM u)
SELECT "GEOID", t0, block_id, "Y_label", CAST(c AS DOUBLE) AS prior_cnt_28d, c / 672.0::DOUBLE AS prior_p_28d FROM s""",
    "prior_since": f"""WITH {DAY}, {PANEL}
SELECT "GEOID", t0, prior_cnt_3m, prior_p_3m FROM panel WHERE t0 >= TIMESTAMP '2001-01-01'""",
    "rollup_week": _coarse("time_bucket(INTERVAL 7 DAY, t0, TIMESTAMP '1970-01-01')"),
    "rollup_month": _coarse("date_trunc('month', t0)::TIMESTAMP"),
    "rollup_local_day": _windowed_closed(LOCAL_DAY.format("dt")),
    "rollup_anchored": _windowed_closed(_anchored(7, "dt")),
    "rollup_anchored_month": f"{_windowed(_anchored(30, 'dt'))} {_shifted_priors('w')}",
    "rollup_missing_counts": """WITH r AS (
  SELECT CAST(o_custkey AS VARCHAR) AS "GEOID", time_bucket(INTERVAL 7 DAY, o_orderdate, TIMESTAMP '1970-01-01') AS t0,
         CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN 0.25::DOUBLE END AS n FROM orders)
SELECT "GEOID", t0, coalesce(sum(n), 0) AS crime_count, CAST(coalesce(sum(n), 0) > 0 AS INTEGER) AS "Y_label" FROM r GROUP BY 1, 2""",
    "grid_in_span": """WITH c AS (
  SELECT CAST(o_custkey AS VARCHAR) AS "GEOID", date_trunc('day', o_orderdate)::TIMESTAMP AS t0, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT k."GEOID", d.t0, coalesce(c.n, 0) AS crime_count FROM (SELECT DISTINCT "GEOID" FROM c) k
CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2000-03-01', TIMESTAMP '2000-03-10', INTERVAL 1 DAY)) AS t0) d
LEFT JOIN c ON c."GEOID" = k."GEOID" AND c.t0 = d.t0""",
    "last_snapshot": f"WITH {DAY}, {SNAPSHOT} SELECT * FROM snap",
    "median_fill": f"""WITH {SEGMENT}, {DAY_GRID}, s AS (
  SELECT "GEOID", crime_count, o_totalprice FROM grid QUALIFY row_number() OVER (PARTITION BY "GEOID" ORDER BY t0 DESC) = 1)
SELECT "GEOID", crime_count, {_median_filled("s")} FROM s""",
    "forecast_grid": f"WITH {DAY}, {SNAPSHOT} {FRAME.format(starts=_starts(30, 1))}",
    "forecast_one": f"""WITH {DAY}, {SNAPSHOT} {FRAME.format(starts=_starts(9, 7))} WHERE s."GEOID" = '7'""",
    "tiers": f"WITH {DAY}, {SCORES} SELECT * FROM tiered",
    "tier_counts": f"WITH {DAY}, {SCORES} SELECT tier, count(*) AS row_count FROM tiered GROUP BY 1",
    "topk_per_window": f"""WITH {DAY}, {SCORES}
SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY t0 ORDER BY prob DESC, "GEOID") <= 5""",
    "forecast_export": f"""WITH {DAY}, {SCORES}
SELECT "GEOID", strftime(t0, '%Y-%m-%dT%H:%M:%SZ') AS t0, prob, tier
FROM tiered QUALIFY row_number() OVER (PARTITION BY t0 ORDER BY prob DESC, "GEOID") <= 10""",
    "leak_filter": f"""WITH {DAY}, {DAY_GRID}, g AS (
  SELECT *, {_calendar("t0")}, o_totalprice AS risk_x, crime_count AS metrics_y, o_totalprice AS my_label_z,
         crime_count AS crime_count_lag, "GEOID" AS area_name FROM grid) {LEAK_LINES}""",
    "leak_check": f"""WITH {DAY}, {DAY_GRID}, g AS (
  SELECT *, {_calendar("t0")}, o_totalprice AS risk_x, crime_count AS metrics_y, o_totalprice AS my_label_z,
         crime_count AS crime_count_lag, "GEOID" AS area_name FROM grid) {STRICT_LINES}""",
    "align_features": f"""WITH {DAY}, {DAY_GRID}
SELECT "GEOID", t0, round(coalesce(o_totalprice, 0) + 1e-7, 4) AS o_totalprice, 0::DOUBLE AS absent_feature,
  CAST(crime_count AS DOUBLE) AS crime_count, CAST("GEOID" AS DOUBLE) AS area_text FROM grid""",
    "valid_columns": f"""WITH {DAY}, {TRAIN},
t AS (SELECT *, 0 AS hour_start, NULL::DOUBLE AS empty FROM train) {VALID_LINES}""",
    "time_split": f"""WITH {DAY}, {TRAIN}
SELECT "GEOID", t0, pos <= CAST(floor(total * 0.8) AS BIGINT) AS is_train FROM placed""",
    "time_split_text": """WITH r AS (
  SELECT CAST(c_custkey AS VARCHAR) AS "GEOID",
         CASE WHEN c_custkey % 20 <> 0 THEN TIMESTAMP '2000-01-01' + to_days(CAST(c_custkey AS INTEGER)) END AS t0 FROM customer),
placed AS (SELECT *, row_number() OVER (ORDER BY t0 NULLS LAST, "GEOID") AS pos, count(*) OVER () AS total FROM r)
SELECT "GEOID", t0, t0 IS NOT NULL AND pos <= CAST(floor(total * 0.8) AS BIGINT) AS is_train FROM placed""",
    "class_balance": f"""WITH {DAY}, {TRAIN}, t AS (
  SELECT count(*) FILTER ("Y_label" = 1) AS pos, count(*) FILTER ("Y_label" = 0) AS neg, avg("Y_label") AS rate FROM train)
SELECT pos, neg, round(rate + 1e-7, 6) AS y1_rate,
  round(CASE WHEN pos > 0 THEN CAST(neg AS DOUBLE) / pos ELSE 1 END + 1e-7, 6) AS scale_pos_weight FROM t""",
    "undersample": f"""WITH {DAY}, {TRAIN}, ordered AS (
  SELECT "GEOID", t0, "Y_label", count(*) OVER (PARTITION BY "Y_label") AS n,
         row_number() OVER (PARTITION BY "Y_label" ORDER BY
           substr(md5("GEOID" || '|' || strftime(t0, '%Y-%m-%d') || '|42'), 1, 15), "GEOID", t0) AS r FROM train)
SELECT "GEOID", t0, "Y_label" FROM ordered WHERE "Y_label" = 1 OR r <= greatest(1, CAST(floor(n * 0.3) AS BIGINT))""",
    "class_weights": f"""WITH {DAY}, {TRAIN}, ordered AS (
  SELECT "Y_label", count(*) OVER (PARTITION BY "Y_label") AS n,
         row_number() OVER (PARTITION BY "Y_label" ORDER BY "GEOID", t0) AS r FROM train),
t AS (SELECT count(*) FILTER ("Y_label" = 1) AS pos, count(*) FILTER ("Y_label" = 0) AS negatives,
  count(*) FILTER ("Y_label" = 0 AND r <= greatest(1, CAST(floor(n * 0.3) AS BIGINT))) AS neg FROM ordered)
SELECT w AS weighted, pos, neg, round(CASE WHEN pos = 0 THEN 1 WHEN w = 'before' THEN negatives / pos ELSE neg / pos END + 1e-7, 6) AS scale_pos_weight
FROM t, (VALUES ('before'), ('after')) AS v(w)""",
    "impute_median": f"""WITH {DAY}, {TRAIN} SELECT "GEOID", t0, crime_count, {_median_filled("train")} FROM train""",
    "impute_mode": f"""WITH {DAY}, {TRAIN}
SELECT "GEOID", t0, {_mode_filled("year")}, {_mode_filled("month")}, {_mode_filled("day_of_week")} FROM train""",
    "pr_curve": f"""WITH {DOCS} SELECT CAST(threshold AS DOUBLE) AS threshold, precision, recall FROM curve
UNION ALL SELECT NULL, 1, 0""",
    "average_precision": f"""WITH {DOCS}, a AS (SELECT sum(pos * precision) / max(total) AS ap FROM curve)
SELECT round(ap + 1e-7, 8) AS average_precision, ap > 0.95 AS leak_alarm FROM a""",
    "best_f1": f"""WITH {DOCS}, f AS (
  SELECT *, 2 * (precision * recall) / (precision + recall + 1e-12::DOUBLE) AS f1 FROM curve)
SELECT CAST(threshold AS DOUBLE) AS best_threshold, f1 AS f1_best, precision AS precision_at_best,
  recall AS recall_at_best FROM f ORDER BY f1 DESC, threshold LIMIT 1""",
    "confusion": f"WITH {CONFUSION} SELECT * FROM cm",
    "class_report": f"""WITH {CONFUSION}, r AS (
  SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r,
         coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f, tn + fp AS s FROM cm
  UNION ALL
  SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM cm),
lines AS (
  SELECT * FROM r
  UNION ALL SELECT 'accuracy', (tn + tp) / (tn + fp + fn + tp), (tn + tp) / (tn + fp + fn + tp),
    (tn + tp) / (tn + fp + fn + tp), tn + fp + fn + tp FROM cm
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM r
  UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM r)
SELECT class, round(p + 1e-7, 4) AS precision, round(r + 1e-7, 4) AS recall, round(f + 1e-7, 4) AS f1_score,
  CAST(s AS BIGINT) AS support FROM lines""",
    "ordered_report": f"WITH {DAY}, {SCORES}, {REPORT} SELECT * FROM report",
    "report_page": f"WITH {DAY}, {SCORES}, {REPORT} SELECT * FROM report WHERE position BETWEEN 11 AND 35",
    "contract_report": """WITH r AS (
  SELECT CASE WHEN o_orderkey % 83 <> 0 THEN o_custkey END AS area, o_orderkey % 97 = 0 AS bad, o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0 AS missing,
         CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT count(*) AS row_count, count(*) FILTER (bad) AS unreadable_times, count(*) FILTER (missing) AS null_times,
  count(*) FILTER (area IS NULL) AS null_keys, count(DISTINCT (area, day)) FILTER (area IS NOT NULL AND NOT bad AND NOT missing) AS cells FROM r""",
    "text_round_trip": f"""WITH {DAY}, {SCORES}, best AS (
  SELECT * FROM tiered QUALIFY row_number() OVER (PARTITION BY t0 ORDER BY prob DESC, "GEOID") <= 3)
SELECT 'lines' AS source, CASE WHEN c_custkey % 70 = 35 THEN 'short' WHEN c_custkey % 50 = 0 THEN 'damaged' ELSE 'good' END AS kind,
  count(*) AS row_count, CAST(sum(c_custkey) AS DOUBLE) AS total FROM customer GROUP BY 2
UNION ALL SELECT unnest(['csv', 'json']), 'good', count(*), round(sum(prob) + 1e-7, 4) FROM best""",
    "grid_layout": f"WITH {DAY}, {DAY_GRID} SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS overlapping_files FROM grid",
    "metrics_history": f"""WITH {DOCS}, runs AS (
  SELECT '1D' AS freq, TIMESTAMP '2024-01-03' AS run_time, y, TRUE AS rated FROM docs WHERE doc_id % 2 = 0
  UNION ALL SELECT '1W', TIMESTAMP '2024-01-02', y, FALSE FROM docs WHERE doc_id % 3 = 0)
SELECT freq, run_time, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg,
  CASE WHEN bool_and(rated) THEN round(avg(y) + 1e-7, 6) END AS y1_rate FROM runs GROUP BY 1, 2""",
    "encoded_features": f"""WITH {DAY}, {TRAIN}, {ENCODED}
SELECT "GEOID", t0, slot, round(value + 1e-7, 4) AS value FROM encoded WHERE NOT is_train""",
    "scaled_features": f"""WITH {DAY}, {TRAIN}, {ENCODED}, m AS (
  SELECT median(o_totalprice) AS mid FROM parts WHERE is_train), s AS (
  SELECT any_value(mid) AS mid, stddev_samp(day) AS day_std, stddev_samp(coalesce(o_totalprice, mid)) AS price_std FROM parts, m WHERE is_train)
SELECT "GEOID", t0, round(day / day_std + 1e-7, 6) AS day, round(coalesce(o_totalprice, mid) / price_std + 1e-7, 6) AS o_totalprice
FROM parts, s WHERE NOT is_train""",
    "score_linear": f"""WITH {DAY}, {TRAIN}, {ENCODED}, n AS (
  SELECT count(*) FILTER ("Y_label" = 1) AS pos, count(*) FILTER ("Y_label" = 0) AS neg FROM parts WHERE is_train),
weights AS (
  SELECT slot, coalesce(sum(value) FILTER ("Y_label" = 1), 0) / any_value(pos) - coalesce(sum(value) FILTER ("Y_label" = 0), 0) / any_value(neg) AS weight
  FROM encoded, n WHERE is_train GROUP BY 1),
margins AS (SELECT "GEOID", t0, sum(value * weight) AS margin FROM encoded JOIN weights USING (slot) WHERE NOT is_train GROUP BY 1, 2)
SELECT p."GEOID", p.t0, round(CAST(CAST(1 / (1 + exp(-(coalesce(margin, 0) + 0.25))) AS FLOAT) AS DOUBLE) + 1e-7, 5) AS prob
FROM parts p LEFT JOIN margins m ON m."GEOID" = p."GEOID" AND m.t0 = p.t0 WHERE NOT is_train""",
    "stack_out_of_fold": f"""WITH {DAY}, {TRAIN}, {ENCODED}, f AS (
  SELECT *, CAST(('0x' || substr(md5("GEOID" || '|' || strftime(t0, '%Y-%m-%d')), 1, 7))::BIGINT % 5 AS INTEGER) AS fold FROM parts WHERE is_train),
lines AS (
  SELECT k, {', '.join(f'regr_slope("Y_label"::DOUBLE, {c}) AS s_{c}, regr_intercept("Y_label"::DOUBLE, {c}) AS i_{c}' for c in ('day', 'month', 'o_totalprice'))}
  FROM f, range(5) r(k) WHERE fold <> k GROUP BY k)
SELECT "GEOID", t0, fold, {', '.join(f'round(i_{c} + s_{c} * {c} + 1e-7, 6) AS line_{c}' for c in ('day', 'month', 'o_totalprice'))}
FROM f JOIN lines ON fold = k""",
    "saved_model_scores": f"""WITH {DAY}, {TRAIN}, t AS (SELECT count(*) AS n FROM placed WHERE pos > CAST(floor(total * 0.8) AS BIGINT))
SELECT unnest(['single', 'stacked']) AS kind, n AS rows_compared, CAST(0 AS BIGINT) AS rows_different FROM t""",
    "train_outcomes": f"""WITH {DAY}, {TRAIN}, t AS (
  SELECT count(*) FILTER (pos <= CAST(floor(total * 0.8) AS BIGINT)) AS a, count(*) AS n FROM placed)
SELECT '1D' AS freq, 'trained' AS outcome, NULL::VARCHAR AS reason, a AS n_train, n - a AS n_test FROM t
UNION ALL SELECT '1W', 'skipped', 'no grid', NULL, NULL
UNION ALL SELECT '1M', 'failed', 'ValueError: training grid: missing column(s) [''Y_label'']', NULL, NULL""",
}

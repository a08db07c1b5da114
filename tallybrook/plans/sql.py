"""The queries in SQL for DuckDB, over the test table `events`."""

from __future__ import annotations

from tallybrook import config as C

_codes = ", ".join(f"'{c}'" for c in C.CODES)
_countries = ", ".join(f"('{c}', {lat}, {lon}, '{name}')" for c, lat, lon, name in C.COUNTRIES)

TX = f"""raw AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
tx AS (SELECT CAST(event_id AS VARCHAR) AS transaction_id, 'acct_' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS account_id,
  round(round(100 + value, 2) * CASE WHEN k BETWEEN 90 AND 94 THEN 8 + k % 18 ELSE 1 END, 2) AS amount, event_type AS merchant,
  [{_codes}][CAST(CASE WHEN k >= 95 THEN (user_id + 1 + k % 14) % 15 ELSE user_id % 15 END AS INTEGER) + 1] AS location, ts AS event_timestamp,
  CASE WHEN k >= 95 THEN 'impossible_travel' WHEN k >= 90 THEN 'amount_spike' END AS injected_label FROM raw)"""

COUNTRY = f"country(code, lat, lon, name) AS (VALUES {_countries})"
PAIRS = f"""{COUNTRY}, pair AS (SELECT a.code AS from_code, b.code AS to_code, 2 * {C.EARTH_KM} * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS km FROM country a JOIN country b ON a.code <> b.code)"""

FEATURES = f"""{TX}, {PAIRS},
o AS (SELECT *, (epoch_us(event_timestamp) // 1000) AS ms, row_number() OVER w AS rn, lag(location) OVER w AS prev_location, lag((epoch_us(event_timestamp) // 1000)) OVER w AS prev_ms,
  count(amount) OVER p AS prior_count, coalesce(avg(amount) OVER p, 0) AS prior_mean FROM tx
  WINDOW w AS (PARTITION BY account_id ORDER BY (epoch_us(event_timestamp) // 1000), transaction_id),
         p AS (PARTITION BY account_id ORDER BY (epoch_us(event_timestamp) // 1000), transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, rn - min(rn) OVER (PARTITION BY account_id ORDER BY ms RANGE BETWEEN {C.WINDOW_MS} PRECEDING AND CURRENT ROW) + 1 AS velocity_count,
  min(rn) OVER (PARTITION BY account_id ORDER BY ms RANGE BETWEEN {C.WINDOW_MS} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM o),
heads AS (SELECT account_id, rn, nxt, ms, 1 AS no FROM n WHERE rn = 1
  UNION ALL SELECT n.account_id, n.rn, n.nxt, n.ms, heads.no + 1 FROM heads JOIN n ON n.account_id = heads.account_id AND n.rn = heads.nxt),
f AS (SELECT n.*, heads.no AS window_no, heads.ms AS window_start, heads.no - 1 AS baseline_count,
  CASE WHEN heads.no > 1 THEN (heads.rn - 1.0) / (heads.no - 1.0) ELSE 0 END AS baseline_mean
  FROM n JOIN heads ON n.account_id = heads.account_id AND n.rn >= heads.rn AND (heads.nxt IS NULL OR n.rn < heads.nxt))"""

RULES = f"""{FEATURES},
s AS (SELECT f.*, coalesce(pair.km, 0) / greatest((ms - prev_ms) / 3600000.0, {C.MIN_HOURS}) AS speed_or_null FROM f LEFT JOIN pair ON from_code = prev_location AND to_code = location),
g AS (SELECT *, coalesce(speed_or_null, 0) AS speed, baseline_count >= {C.VELOCITY_MIN_WINDOWS} AND velocity_count > CAST(baseline_mean AS DOUBLE) * {C.VELOCITY_FACTOR} AS flag_velocity,
  prior_count >= {C.AMOUNT_MIN_PRIOR} AND amount > prior_mean * {C.AMOUNT_FACTOR} AS flag_amount, coalesce(speed_or_null, 0) > {C.MAX_SPEED_KMH} AS flag_geo FROM s),
d AS (SELECT *, flag_velocity OR flag_amount OR flag_geo AS is_flagged,
  concat_ws(',', CASE WHEN flag_velocity THEN 'velocity' END, CASE WHEN flag_amount THEN 'amount' END, CASE WHEN flag_geo THEN 'geo' END) AS triggered_rules,
  CAST(velocity_count AS INTEGER) AS velocity_count_5min, round(CASE WHEN baseline_mean > 0 THEN velocity_count / CAST(baseline_mean AS DOUBLE) ELSE 0 END, 3) AS velocity_ratio_to_baseline,
  round(CASE WHEN prior_mean > 0 THEN amount / prior_mean ELSE 0 END, 3) AS amount_ratio_to_avg, round(speed, 1) AS implied_speed_kmh FROM g)"""

HITS = f"{RULES}, hits AS (SELECT account_id, transaction_id, event_timestamp, unnest(string_split(triggered_rules, ',')) AS rule FROM d WHERE is_flagged)"

_sum = lambda r: f"count(*) FILTER (WHERE is_flagged AND flag_{r})"
SCORES = f"""{RULES}, totals AS (SELECT account_id, count(*) AS total_processed_transactions, count(*) FILTER (WHERE is_flagged) AS total_flags,
  {_sum('amount')} AS amount_flags, {_sum('geo')} AS geo_flags, {_sum('velocity')} AS velocity_flags FROM d GROUP BY account_id),
scores AS (SELECT *, round((100 * amount_flags + 50 * geo_flags + 26 * velocity_flags) / 100.0, 2) AS risk_score FROM totals),
levels AS (SELECT *, CASE WHEN risk_score <= 0 THEN 'none' WHEN risk_score >= 3 THEN 'high' WHEN risk_score >= 1 THEN 'medium' ELSE 'low' END AS risk_level FROM scores)"""

_label = "country_{0}.code || ' (' || country_{0}.name || ')'"
TEXT = f"""{RULES}, t AS (SELECT d.*, coalesce(c.code || ' (' || c.name || ')', location) AS label,
  'amount $' || printf('%.2f', amount) || ' is ' || printf('%.1f', round(amount_ratio_to_avg, 1)) || 'x this account''s historical average transaction amount' AS amount_text,
  'implied travel speed from this account''s previous transaction location to ' || coalesce(c.code || ' (' || c.name || ')', location) || ' was ' || format('{{:,}}', CAST(round(implied_speed_kmh) AS BIGINT)) || ' km/h' AS geo_text,
  velocity_count_5min || ' transactions in the trailing 5 minutes for this account, ' || printf('%.1f', round(velocity_ratio_to_baseline, 1)) || 'x its own average count per completed 5-minute window' AS velocity_text
  FROM d LEFT JOIN country c ON c.code = location WHERE is_flagged)"""

RESULT = "transaction_id, account_id, amount, merchant, location, event_timestamp, injected_label, flag_velocity, flag_amount, flag_geo, is_flagged, triggered_rules, velocity_count_5min, velocity_ratio_to_baseline, amount_ratio_to_avg, implied_speed_kmh"
EXPLAINED = "explained AS (SELECT transaction_id, 'explained ' || transaction_id AS explanation FROM d WHERE is_flagged AND CAST(transaction_id AS BIGINT) % 3 = 0)"


def query(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"

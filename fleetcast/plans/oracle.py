"""DuckDB SQL equivalents of the driver queries (the correctness oracle).

Written independently of the Spark code, from the operator definitions in
SURVEY section 2. Output conventions match ``plans.output``: dates as ISO text,
doubles rounded to 4 decimals.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# ---- shared fragments ----------------------------------------------------------

HIST = """
hist AS (
  SELECT CAST(o.o_orderdate AS DATE) AS booking_date,
         n.n_regionkey AS from_area_id,
         CAST(p.p_size % 5 AS INTEGER) AS vehicle_model_id,
         COALESCE(CAST(TRUNC(TRY_CAST(substr(o.o_orderpriority, 1, 1) AS DOUBLE)) AS INTEGER), 0)
           AS travel_type_id
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE o.o_orderdate IS NOT NULL
)"""

COUNTS = """
counts AS (
  SELECT booking_date, from_area_id, vehicle_model_id, travel_type_id,
         CAST(count(*) AS INTEGER) AS demand
  FROM hist GROUP BY ALL
)"""

GRID = """
bounds AS (SELECT min(booking_date) AS lo, max(booking_date) AS hi FROM counts),
segs AS (SELECT DISTINCT from_area_id, vehicle_model_id, travel_type_id FROM counts),
days AS (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS booking_date FROM bounds
),
grid AS (
  SELECT d.booking_date, s.from_area_id, s.vehicle_model_id, s.travel_type_id,
         CAST(COALESCE(c.demand, 0) AS INTEGER) AS demand
  FROM segs s CROSS JOIN days d
  LEFT JOIN counts c
    ON c.booking_date = d.booking_date AND c.from_area_id = s.from_area_id
   AND c.vehicle_model_id = s.vehicle_model_id AND c.travel_type_id = s.travel_type_id
)"""

# k-th smallest distinct date, k = max(1, floor(0.8 n)).
GRID_CUT = """
grid_dates AS (
  SELECT booking_date, row_number() OVER (ORDER BY booking_date) AS rn,
         count(*) OVER () AS n
  FROM (SELECT DISTINCT booking_date FROM grid)
),
cut AS (
  SELECT booking_date AS cut_date FROM grid_dates
  WHERE rn = greatest(1, CAST(floor(n * 0.8) AS BIGINT))
)"""

SERIES = """
series AS (SELECT booking_date AS ds, CAST(count(*) AS DOUBLE) AS y FROM hist GROUP BY 1)"""

SEG_WINDOW = "PARTITION BY from_area_id, vehicle_model_id, travel_type_id ORDER BY booking_date"

LAGS = f"""
lagged AS (
  SELECT *,
    lag(demand, 1) OVER w AS lag_1,
    lag(demand, 7) OVER w AS lag_7,
    lag(demand, 14) OVER w AS lag_14,
    lag(demand, 28) OVER w AS lag_28,
    avg(demand) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7,
    avg(demand) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS rolling_mean_14,
    avg(demand) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS rolling_mean_28,
    stddev_samp(demand) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_std_7
  FROM grid
  WINDOW w AS ({SEG_WINDOW})
)"""

MEANS = """
train AS (SELECT * FROM grid WHERE booking_date <= (SELECT cut_date FROM cut)),
means AS (
  SELECT CASE grouping(from_area_id, vehicle_model_id, travel_type_id)
           WHEN 7 THEN 'global' WHEN 3 THEN 'area' WHEN 5 THEN 'vehicle_model'
           WHEN 6 THEN 'travel_type' ELSE 'segment' END AS level,
         from_area_id, vehicle_model_id, travel_type_id, avg(demand) AS mean_demand
  FROM train
  GROUP BY GROUPING SETS ((), (from_area_id), (vehicle_model_id), (travel_type_id),
                          (from_area_id, vehicle_model_id, travel_type_id))
)"""

STATIC = """
gmean AS (SELECT COALESCE(max(mean_demand), 0.0) AS g FROM means WHERE level = 'global'),
static AS (
  SELECT x.*,
    COALESCE(ms.mean_demand, (SELECT g FROM gmean)) AS segment_mean_demand,
    COALESCE(ma.mean_demand, (SELECT g FROM gmean)) AS area_mean_demand,
    COALESCE(mv.mean_demand, (SELECT g FROM gmean)) AS vehicle_model_mean_demand,
    COALESCE(mt.mean_demand, (SELECT g FROM gmean)) AS travel_type_mean_demand
  FROM {src} x
  LEFT JOIN means ms ON ms.level = 'segment' AND ms.from_area_id = x.from_area_id
    AND ms.vehicle_model_id = x.vehicle_model_id AND ms.travel_type_id = x.travel_type_id
  LEFT JOIN means ma ON ma.level = 'area' AND ma.from_area_id = x.from_area_id
  LEFT JOIN means mv ON mv.level = 'vehicle_model' AND mv.vehicle_model_id = x.vehicle_model_id
  LEFT JOIN means mt ON mt.level = 'travel_type' AND mt.travel_type_id = x.travel_type_id
)"""

CAL_DAYS = """
cal AS (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS booking_date FROM bounds
)"""

# US federal holidays by rule (see functions/calendar.py for the list).
HOLIDAYS = """
years AS (
  SELECT unnest(generate_series(year(lo) - 1, year(hi) + 1)) AS y FROM bounds
),
raw_hol AS (
  SELECT make_date(CAST(y AS BIGINT), 1, 1) AS d, 'fixed' AS kind FROM years
  UNION ALL SELECT make_date(CAST(y AS BIGINT), 7, 4), 'fixed' FROM years
  UNION ALL SELECT make_date(CAST(y AS BIGINT), 11, 11), 'fixed' FROM years
  UNION ALL SELECT make_date(CAST(y AS BIGINT), 12, 25), 'fixed' FROM years
  UNION ALL SELECT make_date(CAST(y AS BIGINT), 6, 19), 'fixed' FROM years WHERE y >= 2021
  UNION ALL SELECT make_date(CAST(y AS BIGINT), 1, 1) + INTERVAL 14 DAY
                   + to_days(CAST((8 - isodow(make_date(CAST(y AS BIGINT), 1, 1))) % 7 AS INTEGER)), 'rule'
            FROM years WHERE y >= 1986
  UNION ALL SELECT make_date(CAST(y AS BIGINT), 2, 1) + INTERVAL 14 DAY
                   + to_days(CAST((8 - isodow(make_date(CAST(y AS BIGINT), 2, 1))) % 7 AS INTEGER)), 'rule'
            FROM years
  UNION ALL SELECT make_date(CAST(y AS BIGINT), 5, 31)
                   - to_days(CAST((isodow(make_date(CAST(y AS BIGINT), 5, 31)) - 1) % 7 AS INTEGER)), 'rule'
            FROM years
  UNION ALL SELECT make_date(CAST(y AS BIGINT), 9, 1)
                   + to_days(CAST((8 - isodow(make_date(CAST(y AS BIGINT), 9, 1))) % 7 AS INTEGER)), 'rule'
            FROM years
  UNION ALL SELECT make_date(CAST(y AS BIGINT), 10, 1) + INTERVAL 7 DAY
                   + to_days(CAST((8 - isodow(make_date(CAST(y AS BIGINT), 10, 1))) % 7 AS INTEGER)), 'rule'
            FROM years
  UNION ALL SELECT make_date(CAST(y AS BIGINT), 11, 1) + INTERVAL 21 DAY
                   + to_days(CAST((11 - isodow(make_date(CAST(y AS BIGINT), 11, 1))) % 7 AS INTEGER)), 'rule'
            FROM years
),
hol AS (
  SELECT DISTINCT CAST(CASE WHEN kind = 'fixed' AND isodow(d) = 6 THEN d - INTERVAL 1 DAY
                            WHEN kind = 'fixed' AND isodow(d) = 7 THEN d + INTERVAL 1 DAY
                            ELSE d END AS DATE) AS holiday
  FROM raw_hol
),
hol_in AS (
  SELECT holiday FROM hol, bounds WHERE holiday BETWEEN lo AND hi
),
hol_win AS (
  SELECT DISTINCT CAST(holiday + to_days(CAST(o AS INTEGER)) AS DATE) AS window_day
  FROM hol_in, (SELECT unnest([-1, 0, 1]) AS o)
)"""

CAL_COLS = """
  CAST(isodow(booking_date) - 1 AS INTEGER) AS dayofweek,
  CAST(month(booking_date) AS INTEGER) AS month,
  CAST(day(booking_date) AS INTEGER) AS dayofmonth,
  CAST(weekofyear(booking_date) AS INTEGER) AS weekofyear,
  CAST(dayofyear(booking_date) AS INTEGER) AS dayofyear,
  CAST(isodow(booking_date) >= 6 AS INTEGER) AS is_weekend,
  CAST(day(booking_date) = 1 AS INTEGER) AS is_month_start,
  CAST(booking_date = last_day(booking_date) AS INTEGER) AS is_month_end,
  CAST(booking_date = date_trunc('quarter', booking_date) AS INTEGER) AS is_quarter_start,
  CAST(booking_date = last_day(date_trunc('quarter', booking_date) + INTERVAL 2 MONTH) AS INTEGER)
    AS is_quarter_end,
  CAST(day(booking_date) IN (1, 15) AS INTEGER) AS is_payday"""

CYC_COLS = """
  round(sin(dayofyear(booking_date) * 2 * pi() / 365.25), 4) AS dayofyear_sin,
  round(cos(dayofyear(booking_date) * 2 * pi() / 365.25), 4) AS dayofyear_cos,
  round(sin(month(booking_date) * 2 * pi() / 12.0), 4) AS month_sin,
  round(cos(month(booking_date) * 2 * pi() / 12.0), 4) AS month_cos"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _iso(c: str, alias: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {alias or c}"


# ---- demand series -------------------------------------------------------------

ORACLE["daily_demand"] = _with(HIST) + f"""
SELECT {_iso('booking_date')}, count(*) AS bookings FROM hist GROUP BY booking_date
ORDER BY 1"""

ORACLE["daily_segment_demand"] = _with(HIST, COUNTS) + f"""
SELECT {_iso('booking_date')}, from_area_id, vehicle_model_id, travel_type_id, demand FROM counts"""

ORACLE["series_summary"] = _with(HIST, SERIES) + f"""
SELECT count(y) AS days, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std,
       round(min(y), 4) AS min, round(quantile_cont(y, 0.25), 4) AS q25,
       round(quantile_cont(y, 0.5), 4) AS q50, round(quantile_cont(y, 0.75), 4) AS q75,
       round(max(y), 4) AS max, {_iso('min(ds)', 'first_date')}, {_iso('max(ds)', 'last_date')}
FROM series"""

ORACLE["dense_grid"] = _with(HIST, COUNTS, GRID) + f"""
SELECT {_iso('booking_date')}, from_area_id, vehicle_model_id, travel_type_id, demand FROM grid"""

ORACLE["demand_lags"] = _with(HIST, COUNTS, GRID, LAGS) + f"""
SELECT {_iso('booking_date')}, from_area_id, vehicle_model_id, travel_type_id, demand,
       lag_1, lag_7, lag_14, lag_28 FROM lagged"""

ORACLE["demand_rolling"] = _with(HIST, COUNTS, GRID, LAGS) + f"""
SELECT {_iso('booking_date')}, from_area_id, vehicle_model_id, travel_type_id, demand,
       round(rolling_mean_7, 4) AS rolling_mean_7, round(rolling_mean_14, 4) AS rolling_mean_14,
       round(rolling_mean_28, 4) AS rolling_mean_28, round(rolling_std_7, 4) AS rolling_std_7
FROM lagged"""

ORACLE["target_means"] = _with(HIST, COUNTS, GRID, GRID_CUT, MEANS) + """
SELECT level, from_area_id, vehicle_model_id, travel_type_id, round(mean_demand, 4) AS mean_demand
FROM means"""

ORACLE["target_mean_lookup"] = _with(HIST, COUNTS, GRID, GRID_CUT, MEANS,
                                     STATIC.format(src="grid")) + f"""
SELECT {_iso('booking_date')}, from_area_id, vehicle_model_id, travel_type_id, demand,
       round(segment_mean_demand, 4) AS segment_mean_demand,
       round(area_mean_demand, 4) AS area_mean_demand,
       round(vehicle_model_mean_demand, 4) AS vehicle_model_mean_demand,
       round(travel_type_mean_demand, 4) AS travel_type_mean_demand
FROM static"""

ORACLE["calendar_features"] = _with(HIST, COUNTS, GRID, CAL_DAYS) + f"""
SELECT {_iso('booking_date')}, {CAL_COLS} FROM cal"""

ORACLE["cyclic_features"] = _with(HIST, COUNTS, GRID, CAL_DAYS) + f"""
SELECT {_iso('booking_date')}, {CYC_COLS} FROM cal"""

ORACLE["holiday_flags"] = _with(HIST, COUNTS, GRID, CAL_DAYS, HOLIDAYS) + f"""
SELECT {_iso('booking_date')},
       CAST(booking_date IN (SELECT holiday FROM hol_in) AS INTEGER) AS is_holiday,
       CAST(booking_date IN (SELECT window_day FROM hol_win) AS INTEGER) AS is_holiday_window
FROM cal"""

ORACLE["demand_feature_frame"] = _with(
    HIST, COUNTS, GRID, GRID_CUT, LAGS, MEANS, STATIC.format(src="lagged"), HOLIDAYS) + f"""
SELECT {_iso('booking_date')}, from_area_id, vehicle_model_id, travel_type_id, {CAL_COLS},
  CAST(booking_date IN (SELECT holiday FROM hol_in) AS INTEGER) AS is_holiday,
  CAST(booking_date IN (SELECT window_day FROM hol_win) AS INTEGER) AS is_holiday_window,
  {CYC_COLS},
  round(segment_mean_demand, 4) AS segment_mean_demand,
  round(area_mean_demand, 4) AS area_mean_demand,
  round(vehicle_model_mean_demand, 4) AS vehicle_model_mean_demand,
  round(travel_type_mean_demand, 4) AS travel_type_mean_demand,
  lag_1, lag_7, lag_14, lag_28,
  round(rolling_mean_7, 4) AS rolling_mean_7, round(rolling_mean_14, 4) AS rolling_mean_14,
  round(rolling_mean_28, 4) AS rolling_mean_28, round(rolling_std_7, 4) AS rolling_std_7,
  demand, booking_date <= (SELECT cut_date FROM cut) AS is_train
FROM static"""

ORACLE["date_split"] = _with(HIST, COUNTS, GRID, GRID_CUT) + f"""
SELECT CASE WHEN booking_date <= (SELECT cut_date FROM cut) THEN 'train' ELSE 'test' END AS split,
       count(*) AS rows, count(DISTINCT booking_date) AS days,
       {_iso('min(booking_date)', 'first_date')}, {_iso('max(booking_date)', 'last_date')},
       CAST(sum(demand) AS BIGINT) AS demand
FROM grid GROUP BY 1"""

ORACLE["series_split"] = _with(HIST, SERIES) + f"""
, ranked AS (SELECT *, row_number() OVER (ORDER BY ds) AS rn, count(*) OVER () AS n FROM series)
SELECT CASE WHEN rn <= CAST(floor(n * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS split,
       count(*) AS days, {_iso('min(ds)', 'first_date')}, {_iso('max(ds)', 'last_date')},
       round(sum(y), 4) AS bookings
FROM ranked GROUP BY 1"""


# ---- booking features, coercion, training preparation ---------------------------

BOOK = """
book AS (
  SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_number,
    l.l_partkey AS part_key, l.l_suppkey AS supp_key,
    CAST(p.p_size % 5 AS DOUBLE) AS vehicle_model_id,
    CAST(l.l_linenumber AS DOUBLE) AS package_id,
    CAST(TRY_CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS DOUBLE) AS travel_type_id,
    CAST(cn.n_regionkey AS DOUBLE) AS from_area_id,
    CAST(sn.n_regionkey AS DOUBLE) AS to_area_id,
    CAST(c.c_nationkey AS DOUBLE) AS from_city_id,
    CAST(s.s_nationkey AS DOUBLE) AS to_city_id,
    CAST(CAST(o.o_orderstatus = 'O' AS INTEGER) AS DOUBLE) AS online_booking,
    CAST(CAST(l.l_linestatus = 'O' AS INTEGER) AS DOUBLE) AS mobile_site_booking,
    CAST(e.embedding[1] AS DOUBLE) * 90.0 AS from_lat,
    CAST(e.embedding[2] AS DOUBLE) * 180.0 AS from_long,
    CAST(e.embedding[3] AS DOUBLE) * 90.0 AS to_lat,
    CAST(e.embedding[4] AS DOUBLE) * 180.0 AS to_long,
    CAST(l.l_shipdate AS TIMESTAMP) AS from_date,
    CAST(l.l_shipdate AS TIMESTAMP) + to_hours(CAST(l.l_quantity AS INTEGER)) AS to_date,
    CAST(o.o_orderdate AS TIMESTAMP) AS booking_created,
    CAST(l.l_returnflag = 'R' AS INTEGER) AS label
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  LEFT JOIN embeddings e ON e.vec_id = l.l_suppkey
)"""

HAV = """6371.0 * atan2(sqrt({a}), sqrt(1 - {a})) * 2"""
HAV_A = """(pow(sin((radians({tl}) - radians({fl})) / 2), 2)
  + cos(radians({fl})) * cos(radians({tl})) * pow(sin((radians({tg}) - radians({fg})) / 2), 2))"""


def _hav(fl, fg, tl, tg):
    a = HAV_A.format(fl=fl, fg=fg, tl=tl, tg=tg)
    return HAV.format(a=a)


FEAT_COLS = [
    "vehicle_model_id", "package_id", "travel_type_id", "from_area_id", "to_area_id",
    "from_city_id", "to_city_id", "online_booking", "mobile_site_booking",
    "from_lat", "from_long", "to_lat", "to_long", "booking_lead_hours",
    "trip_duration_hours", "booking_created_hour", "booking_created_dayofweek",
    "from_date_hour", "from_date_dayofweek", "to_date_hour", "to_date_dayofweek",
    "route_distance_km",
]

FEAT = f"""
feat AS (
  SELECT order_key, line_number, part_key, supp_key, label,
    vehicle_model_id, package_id, travel_type_id, from_area_id, to_area_id,
    from_city_id, to_city_id, online_booking, mobile_site_booking,
    from_lat, from_long, to_lat, to_long,
    (epoch_us(from_date) - epoch_us(booking_created)) / 3.6e9 AS booking_lead_hours,
    (epoch_us(to_date) - epoch_us(from_date)) / 3.6e9 AS trip_duration_hours,
    CAST(hour(booking_created) AS DOUBLE) AS booking_created_hour,
    CAST(isodow(booking_created) - 1 AS DOUBLE) AS booking_created_dayofweek,
    CAST(hour(from_date) AS DOUBLE) AS from_date_hour,
    CAST(isodow(from_date) - 1 AS DOUBLE) AS from_date_dayofweek,
    CAST(hour(to_date) AS DOUBLE) AS to_date_hour,
    CAST(isodow(to_date) - 1 AS DOUBLE) AS to_date_dayofweek,
    {_hav('from_lat', 'from_long', 'to_lat', 'to_long')} AS route_distance_km
  FROM book
)"""

SPLIT = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY
              md5(concat_ws('|', order_key, line_number, part_key, supp_key))) AS rn,
         count(*) OVER (PARTITION BY label) AS n_c
  FROM feat
),
split AS (
  SELECT * EXCLUDE (rn, n_c),
         CASE WHEN rn <= CAST(ceil(n_c * 0.2) AS BIGINT) THEN 'test' ELSE 'train' END AS split
  FROM ranked
)"""

ORACLE["booking_features"] = _with(BOOK, FEAT) + """
SELECT order_key, line_number, part_key, supp_key, label, """ + ", ".join(
    f"round({c}, 4) AS {c}" for c in FEAT_COLS) + " FROM feat"

ORACLE["route_distance"] = f"""
SELECT vec_id, round({_hav('CAST(embedding[1] AS DOUBLE) * 90.0', 'CAST(embedding[2] AS DOUBLE) * 180.0',
                           'CAST(embedding[3] AS DOUBLE) * 90.0', 'CAST(embedding[4] AS DOUBLE) * 180.0')}, 4)
       AS route_distance_km
FROM embeddings"""

ORACLE["coerce_numbers"] = """
SELECT o_orderkey,
  TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority_code,
  TRY_CAST(o_orderpriority AS DOUBLE) AS priority_text,
  round(TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE), 4) AS price,
  COALESCE(CAST(TRUNC(TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE)) AS INTEGER), 0) AS price_int,
  COALESCE(CAST(TRUNC(TRY_CAST(o_orderstatus AS DOUBLE)) AS INTEGER), 0) AS status_int
FROM orders"""

ORACLE["coerce_timestamps"] = """
SELECT event_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_iso,
  strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS ts_export,
  CAST(NULL AS VARCHAR) AS ts_bad,
  strftime(CAST(ts AS DATE), '%Y-%m-%d') AS event_date
FROM events WHERE ts IS NOT NULL"""

ORACLE["stratified_split"] = _with(BOOK, FEAT, SPLIT) + """
SELECT split, label, count(*) AS rows, round(sum(booking_lead_hours), 4) AS lead_hours,
       CAST(sum(order_key) AS BIGINT) AS order_keys
FROM split GROUP BY split, label"""

ORACLE["median_impute"] = _with(BOOK, FEAT, SPLIT) + """
, med AS (SELECT """ + ", ".join(f"median({c}) AS {c}" for c in FEAT_COLS) + """
          FROM split WHERE split = 'train'),
nul AS (SELECT """ + ", ".join(f"count(*) - count({c}) AS {c}" for c in FEAT_COLS) + """ FROM split)
SELECT m.feature, round(m.median, 4) AS median, n.filled
FROM (UNPIVOT med ON """ + ", ".join(FEAT_COLS) + """ INTO NAME feature VALUE median) m
JOIN (UNPIVOT nul ON """ + ", ".join(FEAT_COLS) + """ INTO NAME feature VALUE filled) n
  ON m.feature = n.feature"""

ORACLE["class_weights"] = _with(BOOK, FEAT, SPLIT) + """
, tr AS (SELECT label FROM split WHERE split = 'train')
SELECT label, count(*) AS rows,
       round((SELECT count(*) FROM tr) / ((SELECT count(DISTINCT label) FROM tr) * count(*)), 4) AS weight
FROM tr GROUP BY label"""

RULE_TEST = """
scored AS (
  SELECT label, 1.0 / (1.0 + exp(booking_lead_hours / 8760.0)) AS score
  FROM split WHERE split = 'test'
),
pred AS (SELECT label, score, CAST(score >= 0.5 AS INTEGER) AS prediction FROM scored)"""

ORACLE["classification_metrics"] = _with(BOOK, FEAT, SPLIT, RULE_TEST) + """
, cm AS (
  SELECT CAST(sum(CAST(label = 1 AND prediction = 1 AS BIGINT)) AS BIGINT) AS tp,
         CAST(sum(CAST(label <> 1 AND prediction = 1 AS BIGINT)) AS BIGINT) AS fp,
         CAST(sum(CAST(label = 1 AND prediction <> 1 AS BIGINT)) AS BIGINT) AS fn,
         CAST(sum(CAST(label <> 1 AND prediction <> 1 AS BIGINT)) AS BIGINT) AS tn
  FROM pred)
SELECT tp + fp + fn + tn AS rows, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy,
       round(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0), 4) AS f1, tp, fp, fn, tn
FROM cm"""

ORACLE["roc_auc"] = _with(BOOK, FEAT, SPLIT, RULE_TEST) + """
, per AS (SELECT score, sum(CAST(label = 1 AS BIGINT)) AS pos, sum(CAST(label <> 1 AS BIGINT)) AS neg
          FROM pred GROUP BY score),
cum AS (SELECT *, COALESCE(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                          AND 1 PRECEDING), 0) AS below FROM per)
SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 4) AS roc_auc,
       CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
FROM cum"""


# ---- forecasts, hold-out evaluation, demand requests ------------------------------

NAIVE = """
series AS (SELECT booking_date AS ds, CAST(count(*) AS DOUBLE) AS y FROM hist GROUP BY 1),
sb AS (SELECT min(ds) AS lo, max(ds) AS hi FROM series),
dense AS (
  SELECT d.ds, COALESCE(s.y, 0.0) AS y
  FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM sb) d
  LEFT JOIN series s ON s.ds = d.ds
),
sdates AS (SELECT ds, row_number() OVER (ORDER BY ds) AS rn, count(*) OVER () AS n FROM series),
scut AS (SELECT ds AS cut_date FROM sdates WHERE rn = greatest(1, CAST(floor(n * 0.8) AS BIGINT))),
fc AS (SELECT s.ds, s.y, p.y AS yhat FROM series s JOIN dense p ON p.ds + 7 = s.ds)"""

FUTURE = """
fut AS (
  SELECT f.ds, d.y AS yhat
  FROM (SELECT CAST(unnest(generate_series(hi + 1, hi + 30, INTERVAL 1 DAY)) AS DATE) AS ds FROM sb) f
  LEFT JOIN dense d
    ON d.ds = f.ds - CAST(7 * ceil((f.ds - (SELECT hi FROM sb)) / 7.0) AS INTEGER)
)"""

ORACLE["forecast_metrics"] = _with(HIST, NAIVE) + """
, test AS (SELECT * FROM fc WHERE ds > (SELECT cut_date FROM scut))
SELECT count(*) AS rows, round(avg(abs(yhat - y)), 4) AS mae,
       round(sqrt(avg((yhat - y) * (yhat - y))), 4) AS rmse,
       round(avg(abs((yhat - y) / NULLIF(y, 0.0))) * 100, 4) AS mape,
       round(1 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(*)), 4) AS r2,
       CAST(sum(CAST(y = 0 AS BIGINT)) AS BIGINT) AS zero_actuals
FROM test"""

ORACLE["holdout_table"] = _with(HIST, NAIVE) + """
, sig AS (SELECT stddev_samp(y - yhat) AS sigma FROM fc WHERE ds <= (SELECT cut_date FROM scut))
SELECT strftime(ds, '%Y-%m-%d') AS Date, CAST(y AS BIGINT) AS Actual, round(yhat, 4) AS Predicted,
       round(yhat - 1.959963984540054 * (SELECT sigma FROM sig), 4) AS Lower_Bound,
       round(yhat + 1.959963984540054 * (SELECT sigma FROM sig), 4) AS Upper_Bound
FROM fc WHERE ds > (SELECT cut_date FROM scut)"""

ORACLE["forecast_summary"] = _with(HIST, NAIVE, FUTURE) + """
SELECT count(*) AS days, round(avg(yhat), 4) AS mean, round(min(yhat), 4) AS min,
       round(max(yhat), 4) AS max, round(sum(yhat), 4) AS total
FROM fut"""

ORACLE["forecast_vs_history"] = _with(HIST, NAIVE, FUTURE) + """
SELECT round((SELECT avg(y) FROM series), 4) AS history_mean,
       round((SELECT avg(yhat) FROM fut), 4) AS forecast_mean,
       round(((SELECT avg(yhat) FROM fut) - (SELECT avg(y) FROM series))
             / (SELECT avg(y) FROM series) * 100, 4) AS pct_change"""

REQUESTS = """
segreq AS (
  SELECT from_area_id, vehicle_model_id, travel_type_id FROM segs
  UNION ALL
  SELECT DISTINCT from_area_id, vehicle_model_id, CAST(NULL AS INTEGER) FROM segs
),
req AS (
  SELECT concat_ws('-', from_area_id, vehicle_model_id, COALESCE(CAST(travel_type_id AS VARCHAR), 'all'))
           AS request_id, from_area_id, vehicle_model_id, travel_type_id,
         (SELECT hi FROM bounds) + 1 AS start_date, (SELECT hi FROM bounds) + 30 AS end_date
  FROM segreq
),
req_days AS (
  SELECT request_id, from_area_id, vehicle_model_id, travel_type_id,
         CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS ds
  FROM req
)"""

ANSWER = """
, tot AS (SELECT request_id, CAST(sum(predicted_bookings) AS BIGINT) AS total_predicted_bookings,
                 count(*) AS number_of_days FROM rows_ GROUP BY request_id)
SELECT r.request_id, strftime(r.ds, '%Y-%m-%d') AS date, r.predicted_bookings,
       t.total_predicted_bookings, t.number_of_days,
       'Demand forecast generated successfully' AS message
FROM rows_ r JOIN tot t ON r.request_id = t.request_id"""

ORACLE["demand_request"] = _with(HIST, COUNTS, GRID, REQUESTS) + """
, segfut AS (
  SELECT s.from_area_id, s.vehicle_model_id, s.travel_type_id, f.ds, CAST(g.demand AS DOUBLE) AS yhat
  FROM segs s
  CROSS JOIN (SELECT CAST(unnest(generate_series(hi + 1, hi + 30, INTERVAL 1 DAY)) AS DATE) AS ds
              FROM bounds) f
  LEFT JOIN grid g
    ON g.from_area_id = s.from_area_id AND g.vehicle_model_id = s.vehicle_model_id
   AND g.travel_type_id = s.travel_type_id
   AND g.booking_date = f.ds - CAST(7 * ceil((f.ds - (SELECT hi FROM bounds)) / 7.0) AS INTEGER)
),
rows_ AS (
  SELECT r.request_id, r.ds,
         greatest(CAST(round_even(sum(f.yhat), 0) AS INTEGER), 0) AS predicted_bookings
  FROM req_days r JOIN segfut f
    ON r.from_area_id = f.from_area_id AND r.vehicle_model_id = f.vehicle_model_id AND r.ds = f.ds
   AND (r.travel_type_id IS NULL OR r.travel_type_id = f.travel_type_id)
  GROUP BY r.request_id, r.ds
)""" + ANSWER

ORACLE["risk_demand_index"] = _with(HIST, COUNTS, GRID, REQUESTS) + """
, rows_ AS (
  SELECT request_id, ds,
         CAST(round_even(5 + 15 * greatest(0.0, 1 - 1.0 / (1.0 + exp(24.0 / 8760.0))), 0) AS INTEGER)
           AS predicted_bookings
  FROM req_days
)""" + ANSWER


# ---- operational tables -------------------------------------------------------------

USERS = """
users AS (
  SELECT CAST(c_custkey * 2 + 1 AS BIGINT) AS id,
         lower(replace(c_name, '#', '.')) || '@fleet.test' AS email,
         lower(replace(c_name, '#', '')) AS username, md5(c_name) AS password,
         upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2, 100)) AS first_name,
         'N' || CAST(c_nationkey AS VARCHAR) AS last_name, '' AS middle_name, '' AS sex,
         '' AS date_of_birth, 'renter' AS role, c_acctbal >= 0 AS active
  FROM customer
  UNION ALL
  SELECT CAST(s_suppkey * 2 + 2 AS BIGINT), lower(replace(s_name, '#', '.')) || '@fleet.test',
         lower(replace(s_name, '#', '')), md5(s_name), 'Owner',
         'N' || CAST(s_nationkey AS VARCHAR), '', '', '', 'owner', s_acctbal >= 0
  FROM supplier
)"""

VEHICLES = """
fsup AS (SELECT l_partkey, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY l_partkey),
own AS (
  SELECT f.l_partkey, CAST(s.s_suppkey * 2 + 2 AS VARCHAR) AS owner_id,
         lower(replace(s.s_name, '#', '.')) || '@fleet.test' AS owner_email, s.s_name AS owner_name
  FROM fsup f JOIN supplier s ON f.s_suppkey = s.s_suppkey
),
vehicles AS (
  SELECT p.p_partkey AS id, p.p_name AS name, p.p_brand AS brand, p.p_type AS model,
         CAST(1995 + p.p_size % 30 AS INTEGER) AS year, p.p_retailprice / 10 AS price_per_day,
         p.p_size % 2 = 0 AS available, '' AS photo_uri,
         CAST(p.p_size % 4 + 2 AS INTEGER) AS seats, '' AS location,
         COALESCE(o.owner_id, '') AS owner_id, COALESCE(o.owner_email, '') AS owner_email,
         COALESCE(o.owner_name, '') AS owner_name,
         CASE WHEN p.p_size % 2 = 0 THEN 'available' ELSE 'rented' END AS status
  FROM part p LEFT JOIN own o ON p.p_partkey = o.l_partkey
)"""

BOOKINGS = """
fpart AS (SELECT l_orderkey, min(l_partkey) AS vehicle FROM lineitem GROUP BY l_orderkey),
bookings AS (
  SELECT o.o_orderkey AS id, f.vehicle, CAST(o.o_custkey * 2 + 1 AS VARCHAR) AS renter,
         CAST(o.o_custkey * 2 + 1 AS VARCHAR) AS renter_id,
         lower(replace(c.c_name, '#', '.')) || '@fleet.test' AS renter_email,
         c.c_name AS renter_name,
         strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d') AS start_date,
         strftime(CAST(o.o_orderdate AS DATE) + 3, '%Y-%m-%d') AS end_date,
         o.o_totalprice AS amount,
         CASE o.o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed'
              ELSE 'confirmed' END AS status
  FROM orders o JOIN fpart f ON o.o_orderkey = f.l_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
)"""

BOOKING_VIEW_COLS = """id, vehicle, vehicle AS vehicleId, renter, renter AS renterId,
  start_date AS startDate, end_date AS endDate, round(amount, 4) AS amount, status"""

USER_VIEW = """
SELECT id, email, username, first_name AS firstName, last_name AS lastName,
       middle_name AS middleName, sex, date_of_birth AS dateOfBirth, role, active,
       trim(concat_ws(' ', NULLIF(first_name, ''), NULLIF(last_name, ''))) AS fullName
FROM users"""

ORACLE["user_view"] = _with(USERS) + USER_VIEW
ORACLE["active_users"] = _with(USERS) + USER_VIEW + " WHERE active"

ORACLE["vehicle_view"] = _with(VEHICLES) + """
SELECT id, COALESCE(NULLIF(name, ''), NULLIF(model, ''), '') AS name, brand, model, year,
       round(price_per_day, 4) AS pricePerDay, round(price_per_day, 4) AS price, available,
       CASE WHEN available THEN 'available' ELSE 'rented' END AS status, '' AS image,
       '' AS type, '' AS transmission, '' AS fuel, seats, '' AS location, '' AS description,
       owner_id AS ownerId, owner_email AS ownerEmail
FROM vehicles"""

ORACLE["booking_view"] = _with(BOOKINGS) + f"SELECT {BOOKING_VIEW_COLS} FROM bookings"

ORACLE["bookings_by_party"] = _with(BOOKINGS) + f"""
SELECT {BOOKING_VIEW_COLS} FROM bookings
WHERE lower(renter_email) = 'customer.000000001@fleet.test'"""

ORACLE["newest_bookings"] = _with(BOOKINGS) + f"""
SELECT {BOOKING_VIEW_COLS} FROM bookings ORDER BY id DESC LIMIT 20"""

REPORTS = """
reports AS (
  SELECT conv_id AS id, count(*) AS turns FROM conversations GROUP BY conv_id
)"""

ORACLE["report_view"] = _with(REPORTS) + """
, firsts AS (
  SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS authors,
         sum(length(text)) AS chars
  FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id
)
SELECT r.id, 'checkin' AS type, r.id AS vehicleId, r.id AS rentalId, CAST(0.0 AS DOUBLE) AS amount,
       '[]' AS issues, '{"turns":"' || CAST(r.turns AS VARCHAR) || '"}' AS customLabels,
       '' AS checkout, CAST(COALESCE(f.n, 0) AS INTEGER) AS n_comments,
       COALESCE(f.authors, '') AS authors, CAST(COALESCE(f.chars, 0) AS BIGINT) AS message_chars
FROM reports r LEFT JOIN firsts f ON r.id = f.conv_id"""

ORACLE["append_comments"] = _with(REPORTS) + """
, alls AS (
  SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn % 2, turn) AS authors,
         sum(length(text)) AS chars
  FROM conversations GROUP BY conv_id
)
SELECT r.id, CAST(f.n AS INTEGER) AS n_comments, f.authors, CAST(f.chars AS BIGINT) AS message_chars
FROM reports r JOIN alls f ON r.id = f.conv_id"""

ORACLE["set_checkout"] = """
SELECT conv_id AS id,
       CAST(to_json(struct_pack(by := arg_max(role, turn), turn := max(turn))) AS VARCHAR) AS checkout
FROM conversations GROUP BY conv_id"""

BOOKING_BATCH = """
bb AS (
  SELECT event_id AS seq,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 25 + user_id % 25 AS vehicle,
         lower(trim(upper(printf('customer.%09d@fleet.test', user_id)))) AS renter_email,
         CAST(user_id * 2 + 1 AS VARCHAR) AS renter_id,
         strftime(CAST(ts AS DATE), '%Y-%m-%d') AS start_date,
         CASE WHEN value > 10 THEN value END AS amount
  FROM events WHERE event_type = 'purchase'
)"""

ORACLE["booking_enrichment"] = _with(VEHICLES, BOOKINGS, BOOKING_BATCH) + """
, ok AS (
  SELECT b.*, v.name AS vehicle_name, v.owner_id, v.owner_email, v.owner_name, v.price_per_day
  FROM bb b JOIN vehicles v ON b.vehicle = v.id
)
SELECT (SELECT max(id) FROM bookings) + row_number() OVER (ORDER BY seq) AS id,
       vehicle, vehicle_name, COALESCE(NULLIF(renter_id, ''), renter_email) AS renter, renter_id,
       renter_email, owner_id, owner_email, owner_name, start_date,
       round(COALESCE(amount, price_per_day, 0.0), 4) AS amount, 'pending' AS status
FROM ok"""

ORACLE["booking_rejects"] = _with(VEHICLES, BOOKINGS, BOOKING_BATCH) + """
SELECT seq, 'create' AS action, 'unknown_vehicle' AS reason
FROM bb WHERE vehicle NOT IN (SELECT id FROM vehicles)
UNION ALL
SELECT event_id AS seq, 'update' AS action, 'unknown_id' AS reason
FROM events WHERE event_type = 'click' AND event_id * 2 NOT IN (SELECT id FROM bookings)"""

USER_BATCH = """
ub_raw AS (
  SELECT event_id AS seq, user_id AS u,
    CASE WHEN event_id % 11 = 0 THEN 'fam' || CAST(user_id % 20 AS VARCHAR) || '@fleet.test' ELSE
    CASE event_id % 3 WHEN 0 THEN '  ' || upper(printf('customer.%09d@fleet.test', user_id)) || ' '
                      WHEN 1 THEN 'new' || CAST(event_id AS VARCHAR) || '@fleet.test'
                      ELSE printf('customer.%09d@fleet.test', user_id + 2) END END AS email_raw,
    CASE WHEN event_id % 11 = 0 THEN 'fam' || CAST(event_id % 13 AS VARCHAR) ELSE
    CASE event_id % 3 WHEN 0 THEN 'new' || CAST(event_id AS VARCHAR)
                      WHEN 1 THEN printf('customer%09d', user_id + 1)
                      ELSE printf('customer%09d', user_id) END END AS username_raw,
    CASE WHEN event_id % 7 <> 0 THEN 'pw' || CAST(event_id AS VARCHAR) END AS password,
    'F' || CAST(event_id AS VARCHAR) AS first_name,
    CASE WHEN event_id % 5 = 0 THEN 'driver' ELSE 'renter' END AS role
  FROM events WHERE event_type = 'signup'
),
ub AS (
  SELECT seq, lower(trim(COALESCE(email_raw, username_raw, ''))) AS email,
         lower(trim(COALESCE(username_raw, email_raw, ''))) AS username,
         COALESCE(password, '') AS password, first_name, role
  FROM ub_raw
),
um AS (
  SELECT seq, min(uid) AS match_id, count(DISTINCT uid) AS matches FROM (
    SELECT b.seq, u.id AS uid FROM ub b JOIN users u ON b.email = lower(trim(u.email))
    UNION ALL
    SELECT b.seq, u.id FROM ub b JOIN users u ON b.username = lower(trim(u.username))
  ) GROUP BY seq
)"""

# One change after the other: ``t`` has the users that the changes before touched; a stored user counts by the
# identity that it came with only until then. New users have minus their change's seq, less one, for an id.
USER_UPSERT = _with(USERS, USER_BATCH).replace("WITH", "WITH RECURSIVE", 1) + """
, valid AS (SELECT row_number() OVER (ORDER BY seq) AS rn, * FROM ub WHERE email <> '' AND username <> '' AND password <> ''),
met AS (
  SELECT v.seq, list(DISTINCT u.id) AS ids FROM valid v
  JOIN (SELECT id, lower(trim(email)) AS name, 'e' AS kind FROM users UNION ALL SELECT id, lower(trim(username)), 'n' FROM users) u
    ON (u.kind = 'e' AND u.name = v.email) OR (u.kind = 'n' AND u.name = v.username) GROUP BY v.seq),
step AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST([] AS BIGINT[]) AS found,
    CAST([] AS STRUCT(id BIGINT, email VARCHAR, username VARCHAR)[]) AS t
  UNION ALL
  SELECT rn, seq, found,
    CASE WHEN len(found) > 1 THEN t
         ELSE list_append(list_filter(t, lambda x: x.id <> coalesce(found[1], -seq - 1)),
                          {'id': coalesce(found[1], -seq - 1), 'email': email, 'username': username}) END
  FROM (SELECT v.rn, v.seq, v.email, v.username, s.t, list_distinct(list_concat(
            list_filter(coalesce(m.ids, []), lambda i: NOT list_contains(list_transform(s.t, lambda x: x.id), i)),
            list_transform(list_filter(s.t, lambda x: x.email = v.email OR x.username = v.username), lambda x: x.id))) AS found
        FROM step s JOIN valid v ON v.rn = s.rn + 1 LEFT JOIN met m ON m.seq = v.seq)),
out AS (
  SELECT seq, CASE WHEN len(found) > 1 THEN 'rejected' WHEN len(found) = 1 THEN 'updated' ELSE 'inserted' END AS outcome,
    CASE WHEN len(found) < 2 THEN coalesce(found[1], -seq - 1) END AS who FROM step WHERE rn > 0),
new AS (SELECT -seq - 1 AS who, (SELECT max(id) FROM users) + row_number() OVER (ORDER BY seq) AS id FROM out WHERE outcome = 'inserted'),
done AS (SELECT out.seq, out.outcome, coalesce(new.id, out.who) AS id FROM out LEFT JOIN new USING (who))"""

ORACLE["user_upsert"] = USER_UPSERT + """
SELECT b.seq, coalesce(d.outcome, 'rejected') AS outcome, d.id,
  CASE WHEN d.id IS NOT NULL THEN email END AS email, CASE WHEN d.id IS NOT NULL THEN username END AS username,
  CASE WHEN d.id IS NOT NULL THEN first_name END AS first_name, CASE WHEN d.id IS NOT NULL THEN role END AS role,
  CASE WHEN d.seq IS NULL THEN 'identity_missing' WHEN d.outcome = 'rejected' THEN 'several_users' END AS reason
FROM ub b LEFT JOIN done d ON d.seq = b.seq"""

ORACLE["user_upsert_rows"] = USER_UPSERT + """
SELECT d.id, b.seq, b.email, b.username, b.password, b.first_name, b.role, true AS active
FROM done d JOIN ub b ON b.seq = d.seq WHERE d.id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY b.seq DESC) = 1"""

# One change after the other: a change is accepted if no user and no change accepted before holds its identity.
ORACLE["user_insert_if_absent"] = _with(USERS, USER_BATCH).replace("WITH", "WITH RECURSIVE", 1) + """
, r AS (
  SELECT b.*, CASE WHEN b.email = '' OR b.username = '' THEN 'identity_missing'
                   WHEN b.role NOT IN ('renter', 'owner', 'admin') THEN 'unknown_role'
                   WHEN m.matches IS NOT NULL THEN 'identity_taken' END AS reason
  FROM ub b LEFT JOIN um m ON b.seq = m.seq
),
cand AS (SELECT row_number() OVER (ORDER BY seq) AS rn, seq, email, username FROM r WHERE reason IS NULL),
step AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS es, CAST([] AS VARCHAR[]) AS us,
         CAST(NULL AS BIGINT) AS seq, false AS ok
  UNION ALL
  SELECT c.rn,
    CASE WHEN list_contains(s.es, c.email) OR list_contains(s.us, c.username) THEN s.es ELSE list_append(s.es, c.email) END,
    CASE WHEN list_contains(s.es, c.email) OR list_contains(s.us, c.username) THEN s.us ELSE list_append(s.us, c.username) END,
    c.seq, NOT (list_contains(s.es, c.email) OR list_contains(s.us, c.username))
  FROM step s JOIN cand c ON c.rn = s.rn + 1
)
SELECT seq, 'inserted' AS outcome, (SELECT max(id) FROM users) + row_number() OVER (ORDER BY seq) AS id,
       email, username, first_name, role, CAST(NULL AS VARCHAR) AS reason
FROM r WHERE seq IN (SELECT seq FROM step WHERE ok)
UNION ALL
SELECT seq, 'rejected', NULL, NULL, NULL, NULL, NULL, COALESCE(reason, 'identity_taken')
FROM r WHERE reason IS NOT NULL OR seq IN (SELECT seq FROM step WHERE NOT ok AND rn > 0)"""

VEHICLE_PATCHES = """
vp AS (
  SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) * 20 + user_id % 20 AS id,
         event_id AS seq,
         CASE WHEN value > 20 THEN value END AS price,
         CASE WHEN value <= 20 THEN event_id % 6 + 2 END AS seats,
         CASE WHEN value > 40 THEN 'depot-' || json_extract_string(props, '$.k') END AS location
  FROM events WHERE event_type = 'view' AND NOT (event_id % 17 = 0 AND value > 20)
)"""

ORACLE["patch_coalesce"] = _with(VEHICLES, VEHICLE_PATCHES) + """
, f AS (
  SELECT id, arg_max(price, seq) FILTER (WHERE price IS NOT NULL) AS price,
         bool_or(price IS NOT NULL) AS has_price,
         arg_max(seats, seq) FILTER (WHERE seats IS NOT NULL) AS seats,
         bool_or(seats IS NOT NULL) AS has_seats,
         arg_max(location, seq) FILTER (WHERE location IS NOT NULL) AS location,
         bool_or(location IS NOT NULL) AS has_loc
  FROM vp GROUP BY id
)
SELECT v.id,
  round(CASE WHEN f.has_price THEN f.price ELSE v.price_per_day END, 4) AS price_per_day,
  CAST(CASE WHEN f.has_seats THEN f.seats ELSE v.seats END AS INTEGER) AS seats,
  CASE WHEN f.has_loc THEN f.location ELSE v.location END AS location
FROM vehicles v LEFT JOIN f ON v.id = f.id"""

ORACLE["patch_present"] = _with(VEHICLES, VEHICLE_PATCHES) + """
, f AS (SELECT id, arg_max_null(price, seq) AS price, arg_max_null(seats, seq) AS seats,
               arg_max_null(location, seq) AS location FROM vp GROUP BY id)
SELECT v.id,
  round(CASE WHEN f.id IS NOT NULL THEN f.price ELSE v.price_per_day END, 4) AS price_per_day,
  CAST(CASE WHEN f.id IS NOT NULL THEN f.seats ELSE v.seats END AS INTEGER) AS seats,
  CASE WHEN f.id IS NOT NULL THEN f.location ELSE v.location END AS location
FROM vehicles v LEFT JOIN f ON v.id = f.id"""

ORACLE["delete_rows"] = _with(BOOKINGS) + """
, d AS (SELECT event_id * 2 AS id FROM events WHERE event_type = 'error')
SELECT id, 'removed' AS outcome FROM bookings WHERE id IN (SELECT id FROM d)
UNION ALL
SELECT id, 'not found' FROM d WHERE id NOT IN (SELECT id FROM bookings)
UNION ALL
SELECT id, 'cleared' FROM bookings WHERE id NOT IN (SELECT id FROM d)
  AND renter_id IN (SELECT DISTINCT CAST(user_id * 2 + 1 AS VARCHAR) FROM events WHERE event_type = 'error')"""

ORACLE["backfill_column"] = """
SELECT p_partkey AS id,
       CASE WHEN p_size > 25 THEN '/uploads/vehicles/' || CAST(p_partkey AS VARCHAR) || '.jpg'
            ELSE '' END AS photo_uri
FROM part"""

ORACLE["apply_change_log"] = """
WITH c AS (
  SELECT user_id AS id, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS action,
         json_extract_string(props, '$.k') AS k,
         CASE WHEN event_type <> 'view' THEN value END AS value, event_type AS last_event
  FROM events
),
b AS (SELECT id, max(seq) FILTER (WHERE action = 'delete') AS del FROM c GROUP BY id),
a AS (SELECT c.* FROM c JOIN b ON c.id = b.id WHERE b.del IS NULL OR c.seq > b.del),
born AS (SELECT id, min(seq) FILTER (WHERE action = 'create') AS born FROM a GROUP BY id),
live AS (SELECT a.* FROM a JOIN born ON a.id = born.id WHERE a.seq >= born.born)
SELECT id, arg_max(k, seq) FILTER (WHERE k IS NOT NULL) AS k,
       round(arg_max(value, seq) FILTER (WHERE value IS NOT NULL), 4) AS value,
       arg_max(last_event, seq) FILTER (WHERE last_event IS NOT NULL) AS last_event,
       count(*) AS changes_applied, max(seq) AS last_seq
FROM live GROUP BY id"""

PERMS = """
vc AS (
  SELECT event_id AS seq, user_id AS actor_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 20 + user_id % 20 AS target_id
  FROM events WHERE event_type IN ('click', 'purchase')
),
pj AS (
  SELECT vc.*, u.role AS actor_role, u.active AS actor_active, v.owner_id AS target_owner,
         v.id AS vid
  FROM vc LEFT JOIN users u ON vc.actor_id = u.id LEFT JOIN vehicles v ON vc.target_id = v.id
),
perm AS (
  SELECT seq, actor_id, target_id,
    CASE WHEN actor_role IS NULL OR NOT actor_active THEN 'no_active_user'
         WHEN actor_role NOT IN ('owner', 'admin') THEN 'owners_only'
         WHEN vid IS NULL THEN 'unknown_vehicle'
         WHEN actor_role = 'owner' AND target_owner <> CAST(actor_id AS VARCHAR)
           THEN 'not_own_vehicle' END AS reason
  FROM pj
)"""

ORACLE["change_permissions"] = _with(USERS, VEHICLES, PERMS) + """
SELECT seq, actor_id, target_id, reason IS NULL AS accepted, reason FROM perm"""

ORACLE["change_events"] = _with(USERS, VEHICLES, PERMS) + """
SELECT 'vehicle_updated' AS type, 'updated' AS action, target_id AS id,
       CAST(to_json(struct_pack(id := target_id, by := actor_id, seq := seq)) AS VARCHAR) AS payload
FROM perm WHERE reason IS NULL"""


# ---- streams (oracle = the batch result) ---------------------------------------------

ORACLE["stream_daily_demand"] = ORACLE["daily_segment_demand"]
ORACLE["stream_apply_changes"] = ORACLE["apply_change_log"].replace(
    "count(*) AS changes_applied, ", "")


ORACLE["stream_outcomes"] = """
WITH c AS (
  SELECT user_id AS id, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS action
  FROM events
),
e AS (
  SELECT *, last_value(CASE WHEN action <> 'update' THEN action END IGNORE NULLS)
    OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c
)
SELECT id, seq, CASE WHEN action = 'create' OR before = 'create' THEN action || 'd' ELSE 'unknown_id' END AS outcome
FROM e"""


# ---- profile -------------------------------------------------------------------------

_PROFILE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax"]

ORACLE["profile_table"] = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column, count({c}) AS count, count(*) - count({c}) AS nulls,
       round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std,
       round(min(CAST({c} AS DOUBLE)), 4) AS min, round(max(CAST({c} AS DOUBLE)), 4) AS max
FROM lineitem""" for c in _PROFILE_COLS)

ORACLE["vehicle_create"] = _with(VEHICLES) + """
, vb AS (
  SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id, value
  FROM events WHERE event_type = 'signup'
),
vr AS (
  SELECT seq,
    COALESCE(CASE WHEN k % 3 <> 0 THEN 'car-' || CAST(k AS VARCHAR) END, 'M' || CAST(k % 7 AS VARCHAR)) AS name,
    'M' || CAST(k % 7 AS VARCHAR) AS model,
    CAST(COALESCE(CASE WHEN value > 25 THEN 2000 + k % 25 END, year(ts)) AS INTEGER) AS year,
    round(value * 3, 2) AS price_per_day,
    CASE WHEN seq % 4 = 0 THEN false
         ELSE COALESCE(CASE WHEN seq % 5 = 0 THEN 'rented' END, 'available') = 'available' END AS available,
    CAST(user_id AS VARCHAR) AS owner_id, 'approved' AS approval_status,
    COALESCE(CASE WHEN seq % 5 = 0 THEN 'rented' END, 'available') AS status
  FROM vb
)
SELECT seq, (SELECT max(id) FROM vehicles) + row_number() OVER (ORDER BY seq) AS id, name, model,
       year, round(price_per_day, 4) AS price_per_day, available, owner_id, approval_status, status
FROM vr"""

ORACLE["booking_permissions"] = _with(USERS) + """
, ch AS (
  SELECT event_id AS seq, user_id AS actor_id,
         CASE WHEN event_type = 'purchase' THEN 'create' ELSE 'clear' END AS action,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN user_id
              ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS target_user
  FROM events WHERE event_type IN ('purchase', 'error')
)
SELECT ch.seq, ch.actor_id, ch.action, ch.target_user,
  CASE WHEN u.role IS NULL OR NOT u.active THEN 'no_active_user'
       WHEN ch.action = 'create' AND u.role = 'owner' THEN 'owner_may_not_book'
       WHEN ch.action = 'clear' AND u.role <> 'admin' AND ch.actor_id <> ch.target_user
         THEN 'not_own_bookings' END IS NULL AS accepted,
  CASE WHEN u.role IS NULL OR NOT u.active THEN 'no_active_user'
       WHEN ch.action = 'create' AND u.role = 'owner' THEN 'owner_may_not_book'
       WHEN ch.action = 'clear' AND u.role <> 'admin' AND ch.actor_id <> ch.target_user
         THEN 'not_own_bookings' END AS reason
FROM ch LEFT JOIN users u ON ch.actor_id = u.id"""

ORACLE["report_create"] = """
WITH mx AS (SELECT max(conv_id) AS m FROM conversations)
SELECT conv_id * 1000000 + turn AS seq, (SELECT m FROM mx) + row_number() OVER (ORDER BY conv_id, turn) AS id,
       role AS type, conv_id AS vehicle_id,
       round(CAST(CASE WHEN conv_id % 2 = 0 THEN conv_id * 10 ELSE 0 END AS DOUBLE), 4) AS amount,
       '["' || role || '"]' AS issues, length(text) AS note_chars, '[]' AS photos, '{}' AS custom_labels, '[]' AS comments
FROM conversations"""

ORACLE["booking_records"] = _with(BOOKINGS) + """
SELECT id, vehicle, vehicle AS "vehicleId", '' AS "vehicleName", renter, renter_id AS "renterId", renter_email AS "renterEmail",
       renter_name AS "renterName", '' AS "ownerId", '' AS "ownerEmail", '' AS "ownerName", start_date AS "startDate",
       end_date AS "endDate", round(amount, 4) AS amount, status, '' AS notes, '' AS "cancelReason",
       CAST(NULL AS VARCHAR) AS "createdAt" FROM bookings"""

ORACLE["vehicles_by_owner"] = ORACLE["vehicle_view"] + " WHERE owner_email = 'supplier.000000001@fleet.test'"

ORACLE["lookup_bookings"] = _with(BOOKINGS) + f"""
SELECT {BOOKING_VIEW_COLS} FROM bookings WHERE id IN (SELECT event_id * 7919 % (SELECT ((max(id) + 1) * 5) >> 2 FROM bookings) FROM events)"""

ADMINS = """
admins AS (SELECT id, active, CASE WHEN id % 10 = 7 THEN 'admin' ELSE role END AS role FROM users)"""

ORACLE["user_permissions"] = _with(USERS, ADMINS) + """
, ch AS (SELECT event_id AS seq, user_id AS actor_id,
    CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'list' ELSE 'patch' END AS action,
    event_id * 7919 % (SELECT ((max(id) + 1) * 5) >> 2 FROM users) AS target_id FROM events),
p AS (SELECT ch.*, CASE WHEN a.id IS NULL OR NOT a.active THEN 'no_active_user' WHEN a.role <> 'admin' THEN 'admins_only'
                     WHEN ch.action <> 'list' AND t.id IS NULL THEN 'unknown_id' END AS reason
  FROM ch LEFT JOIN admins a ON a.id = ch.actor_id LEFT JOIN admins t ON t.id = ch.target_id)
SELECT seq, actor_id, action, target_id, reason IS NULL AS accepted, reason FROM p"""

ORACLE["user_requests_as_of"] = _with(USERS, ADMINS) + """
, asked AS (SELECT event_id AS seq, user_id AS actor_id, event_type,
    CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'list' ELSE 'patch' END AS action,
    1 + (event_id * 7919) % (SELECT max(id) FROM users) AS target_id,
    CASE event_id % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'renter' END AS role,
    CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS active FROM events),
states AS (SELECT actor_id AS id, seq, role, active FROM asked WHERE event_type = 'signup'),
roles AS (SELECT id, seq, role FROM states WHERE role IS NOT NULL),
switches AS (SELECT id, seq, active FROM states WHERE active IS NOT NULL),
j AS (
  SELECT a.seq, a.actor_id, a.action, a.target_id, t.id AS known,
    CASE WHEN u.id IS NOT NULL THEN coalesce(r.role, u.role) END AS actor_role,
    CASE WHEN u.id IS NOT NULL THEN coalesce(s.active, u.active) END AS actor_active
  FROM (SELECT * FROM asked WHERE event_type <> 'signup') a
  ASOF LEFT JOIN roles r ON r.id = a.actor_id AND a.seq > r.seq
  ASOF LEFT JOIN switches s ON s.id = a.actor_id AND a.seq > s.seq
  LEFT JOIN admins u ON u.id = a.actor_id LEFT JOIN admins t ON t.id = a.target_id),
p AS (SELECT *, CASE WHEN actor_role IS NULL OR NOT actor_active THEN 'no_active_user' WHEN actor_role <> 'admin' THEN 'admins_only'
    WHEN action <> 'list' AND known IS NULL THEN 'unknown_id' END AS reason FROM j)
SELECT seq, actor_id, action, target_id, actor_role, actor_active, reason IS NULL AS accepted, reason FROM p"""

ORACLE["booking_price_as_of"] = _with(VEHICLES) + """
, most AS (SELECT max(id) AS n FROM vehicles),
p AS (SELECT 1 + (user_id * 31) % n AS id, event_id AS seq, value FROM events, most WHERE event_type = 'view' AND value IS NOT NULL),
b AS (SELECT event_id AS seq, 1 + (user_id * 31) % n AS vehicle FROM events, most WHERE event_type = 'purchase')
SELECT b.seq, b.vehicle, round(coalesce(CAST(p.value AS DOUBLE), v.price_per_day), 4) AS amount
FROM b ASOF LEFT JOIN p ON p.id = b.vehicle AND b.seq > p.seq LEFT JOIN vehicles v ON v.id = b.vehicle"""

ORACLE["vehicle_permissions"] = _with(USERS, VEHICLES, ADMINS) + """
, ch AS (SELECT event_id AS seq, user_id AS actor_id,
    CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'create' ELSE 'update' END AS action,
    event_id * 7919 % (SELECT ((max(id) + 1) * 5) >> 2 FROM vehicles) AS target_id FROM events),
p AS (SELECT ch.*, CASE WHEN a.id IS NULL OR NOT a.active THEN 'no_active_user'
                     WHEN a.role = 'renter' THEN 'owners_only'
                     WHEN ch.action = 'create' THEN NULL
                     WHEN v.id IS NULL THEN 'unknown_vehicle'
                     WHEN a.role = 'owner' AND v.owner_id <> CAST(a.id AS VARCHAR) THEN 'not_own_vehicle' END AS reason
  FROM ch LEFT JOIN admins a ON a.id = ch.actor_id LEFT JOIN vehicles v ON v.id = ch.target_id)
SELECT seq, actor_id, action, target_id, reason IS NULL AS accepted, reason FROM p"""

ORACLE["patch_users"] = _with(USERS) + """
, f AS (SELECT user_id * 2 + 1 AS id, arg_max('P' || CAST(event_id AS VARCHAR), event_id) AS first_name,
               bool_or(event_id % 5 = 0) AS off, strftime(arg_max(ts, event_id), '%Y-%m-%d') AS day FROM events GROUP BY 1)
SELECT u.id, COALESCE(f.first_name, u.first_name) AS first_name, u.active AND NOT COALESCE(f.off, false) AS active,
       f.day AS updated_day FROM users u LEFT JOIN f ON f.id = u.id"""

ORACLE["patch_reports"] = _with(REPORTS) + """
, e AS (SELECT event_id * 7919 % (SELECT ((max(conv_id) + 1) * 5) >> 2 FROM conversations) AS id, * EXCLUDE (event_type) FROM events),
f AS (SELECT id, arg_max('n' || CAST(event_id AS VARCHAR), event_id) AS notes,
             arg_max(value, event_id) FILTER (WHERE value > 20) AS amount, bool_or(event_id % 2 = 0) AS half FROM e GROUP BY id)
SELECT r.id, COALESCE(f.notes, '') AS notes, round(COALESCE(f.amount, 0.0), 4) AS amount,
       CASE WHEN f.half THEN 'half' ELSE '' END AS fuel_level, CAST(0 AS BIGINT) AS rejected
FROM reports r LEFT JOIN f ON f.id = r.id
UNION ALL
SELECT id, '', 0.0, '', count(*) FROM e WHERE id NOT IN (SELECT id FROM reports) GROUP BY id"""

ORACLE["report_rejects"] = """
SELECT conv_id * 3 AS id, turn AS seq, 'unknown_report' AS reason FROM conversations
WHERE conv_id * 3 NOT IN (SELECT conv_id FROM conversations)"""

ORACLE["csv_booking_features"] = ORACLE["booking_features"]

ORACLE["json_change_log"] = (ORACLE["apply_change_log"].replace("  FROM events\n", "  FROM events WHERE event_id % 50 <> 0\n")
    .replace("""       round(arg_max(value, seq) FILTER (WHERE value IS NOT NULL), 4) AS value,\n""", "")) + """
UNION ALL SELECT NULL, NULL, 'broken', count(*), NULL FROM events WHERE event_id % 50 = 0"""

ORACLE["forecast_csv"] = _with(HIST) + """
, s AS (SELECT 'area-' || CAST(from_area_id AS VARCHAR) AS series_id, booking_date AS ds, count(*) AS y FROM hist GROUP BY ALL
        UNION ALL SELECT 'total', booking_date, count(*) FROM hist GROUP BY ALL),
last AS (SELECT series_id, max(ds) AS hi FROM s GROUP BY 1),
step AS (SELECT unnest(generate_series(1, 30)) AS k)
SELECT l.series_id, strftime(l.hi + CAST(k AS INTEGER), '%Y-%m-%d') AS "Date",
       round(CAST(COALESCE(s.y, 0) AS DOUBLE), 4) AS "Forecast"
FROM last l, step LEFT JOIN s ON s.series_id = l.series_id AND s.ds = l.hi + CAST((k - 1) % 7 - 6 AS INTEGER)"""


# ---- model answers: keys, and that each row is valid -----------------------------------

ORACLE["score_bookings_valid"] = """
SELECT l_orderkey AS order_key, l_linenumber AS line_number, CAST(l_returnflag = 'R' AS INTEGER) AS label, true AS ok FROM lineitem"""
ORACLE["stream_score_valid"] = "SELECT l_orderkey AS order_key, l_linenumber AS line_number, true AS ok FROM lineitem"
ORACLE["train_cancellation_valid"] = """
SELECT 'random_forest' AS model_name, CAST(22 AS INTEGER) AS features, count(*) AS rows, true AS ok FROM lineitem"""
ORACLE["risk_index_valid"] = _with(HIST, COUNTS, GRID, REQUESTS) + """
SELECT request_id, strftime(ds, '%Y-%m-%d') AS date, CAST(30 AS BIGINT) AS number_of_days, true AS ok FROM req_days"""
ORACLE["demand_request_valid"] = ORACLE["risk_index_valid"]

AREA_SERIES = """
s AS (SELECT 'area-' || CAST(from_area_id AS VARCHAR) AS series_id, booking_date AS ds, CAST(count(*) AS DOUBLE) AS y
      FROM hist GROUP BY 1, 2
      UNION ALL SELECT 'total', booking_date, CAST(count(*) AS DOUBLE) FROM hist GROUP BY 1, 2)"""
ORACLE["forecast_valid"] = _with(HIST, AREA_SERIES) + """
SELECT series_id, strftime(ds, '%Y-%m-%d') AS ds, y, true AS ok FROM s
UNION ALL
SELECT series_id, strftime(hi + CAST(k AS INTEGER), '%Y-%m-%d'), NULL, true
FROM (SELECT series_id, max(ds) AS hi FROM s GROUP BY 1), (SELECT unnest(generate_series(1, 30)) AS k)"""
ORACLE["forecast_holdout_valid"] = _with(HIST, AREA_SERIES) + """
, d AS (SELECT ds, row_number() OVER (ORDER BY ds) AS rn, count(*) OVER () AS n FROM s WHERE series_id = 'total')
SELECT series_id, count(*) AS rows, true AS ok FROM s
WHERE ds > (SELECT ds FROM d WHERE rn = greatest(1, CAST(floor(n * 0.8) AS BIGINT))) GROUP BY series_id"""
ORACLE["text_sentiment_valid"] = "SELECT doc_id, true AS ok FROM documents"
# Skill: what the fitted models have to reach, whatever their coefficients.
ORACLE["forecast_skill"] = ORACLE["forecast_holdout_valid"]
ORACLE["text_skill"] = "SELECT true AS ok"
ORACLE["poisson_skill"] = "SELECT true AS ok"
ORACLE["boosted_calibration"] = "SELECT true AS ok"

ORACLE["comment_totals"] = """
SELECT conv_id AS report_id, count(*) AS n_comments, CAST(sum(length(text)) AS BIGINT) AS message_chars,
       arg_min(role, (turn % 2) * 1000000 + turn) AS first_author, arg_max(role, (turn % 2) * 1000000 + turn) AS last_author
FROM conversations GROUP BY conv_id"""
ORACLE["newest_comments"] = """
SELECT conv_id AS report_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2 DESC, turn DESC) AS INTEGER) AS rank,
       role AS author, text AS message
FROM conversations QUALIFY rank <= 3"""

ORACLE["lookup_bookings_by_id"] = ORACLE["lookup_bookings"]

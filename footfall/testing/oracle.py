"""DuckDB twins of the registered queries (tables are pre-registered views).

The twins compute the expected values straight from the tables, without building and parsing the
raw text the Spark side goes through, so the parsers themselves are checked too. Shared fixture
steps are CTEs, composed per query.
"""

from __future__ import annotations

from footfall import schemas
from footfall.functions.labels import (FUTURE_TEMP_DATES, FUTURE_TEMPS, PARK_MESSAGES, PARK_UNKNOWN_MESSAGE,
                                       PARKS, ROUTE_COUNT_MESSAGE, ROUTES)
from footfall.testing import fixtures as fx

ORACLE: dict[str, str] = {}

M = schemas.WEATHER_MEASURES

CTE = {
    "ev": "SELECT event_id, user_id, value, date_trunc('hour', ts) AS t FROM events",
    "readings": f"""
        SELECT event_id AS measurmentId, user_id AS counterId, event_id % 1000 AS seqNumber,
               epoch(t) - 7200 AS startDate, epoch(t) - 3600 AS endDate,
               CAST(floor(value) AS BIGINT) AS visits, 'P' || CAST(user_id AS VARCHAR) AS counterIdPave,
               epoch(TIMESTAMP '2015-01-01 00:00:00') - 7200 AS installationDate,
               CAST(CASE WHEN user_id % 2 = 0 THEN {fx.PARK_EVEN} ELSE {fx.PARK_ODD} END AS BIGINT) AS parkCode,
               CAST(6680000 + user_id AS BIGINT) AS cordNorth, CAST(370000 + user_id AS BIGINT) AS coordSouth
        FROM ev WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0""",
    "hours": """
        SELECT DISTINCT t, CAST((epoch(t) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 3600 AS BIGINT) AS h
        FROM ev""",
    "weather": """
        SELECT epoch(t) - 7200 AS startDate,
               CASE WHEN h % 13 = 0 THEN NULL ELSE CAST(h % 9 AS DOUBLE) END AS cloud,
               CAST(980 + h % 50 AS DOUBLE) AS pressure, CAST(40 + (h * 7) % 60 AS DOUBLE) AS humidity,
               CAST(h % 8 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS percip, CAST(h % 5 AS DOUBLE) AS show_depth,
               CAST((h * 5) % 40 AS DOUBLE) - CAST(19.5 AS DOUBLE) AS temp,
               CAST((h * 5) % 40 AS DOUBLE) - CAST(21.5 AS DOUBLE) AS dewpoint,
               CAST(10000 + h AS DOUBLE) AS visib, CAST((h * 15) % 360 AS DOUBLE) AS wind_dir,
               CAST(h % 10 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS gust_speed, CAST(h % 10 AS DOUBLE) AS wind_speed
        FROM hours WHERE h % 101 <> 50""",
    "hol": """
        SELECT DISTINCT d FROM (VALUES (DATE '2024-01-01'), (DATE '2024-01-06'), (DATE '2024-01-20'),
                                       (DATE '2024-01-06'), (DATE '2023-12-25')) v(d)""",
    "enriched": f"""
        SELECT startDate, {', '.join(M)}, measurmentId, counterId, seqNumber, endDate, visits, counterIdPave,
               installationDate, parkCode, cordNorth, coordSouth
        FROM weather JOIN readings USING (startDate)""",
    "enriched_h": """
        SELECT e.*, EXISTS (SELECT 1 FROM hol WHERE CAST(e.loc AS DATE) = hol.d
                            AND e.loc > CAST(hol.d AS TIMESTAMP)) AS holiday
        FROM (SELECT *, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(startDate + 7200 AS BIGINT)) AS loc
              FROM enriched) e""",
    "hourly": """
        SELECT *, CAST(year(loc) AS BIGINT) AS year, CAST(month(loc) AS BIGINT) AS month,
               CAST(day(loc) AS BIGINT) AS day, CAST(hour(loc) AS BIGINT) AS hour,
               CAST(isodow(loc) - 1 AS BIGINT) AS weekday, CAST(hour(loc) - hour(loc) % 2 AS BIGINT) AS hour2d,
               strftime(loc, '%Y-%m-%d') AS date_day, strftime(loc, '%Y-%m-%d %H:%M:%S') AS ds
        FROM enriched_h""",
    "daily": f"""
        SELECT parkCode, counterIdPave, date_day, {', '.join(f'avg({m}) AS {m}' for m in M)},
               CAST(coalesce(sum(visits), 0) AS BIGINT) AS visits, avg(cordNorth) AS cordNorth, avg(coordSouth) AS coordSouth,
               avg(year) AS year, avg(month) AS month, avg(day) AS day,
               coalesce(bool_or(holiday), false) AS holiday, min(counterId) AS counterId
        FROM hourly WHERE hour BETWEEN 9 AND 19 GROUP BY parkCode, counterIdPave, date_day""",
    "history_daily": """
        SELECT l_suppkey AS counterId, l_suppkey % 5 AS parkCode, 'P' || CAST(l_suppkey AS VARCHAR) AS counterIdPave,
               strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS date_day,
               CAST(year(CAST(l_shipdate AS DATE)) AS BIGINT) AS year,
               CAST(sum(l_quantity) AS BIGINT) AS visits, CAST(sum(l_linenumber) AS DOUBLE) AS temp,
               day(CAST(l_shipdate AS DATE)) = 1 AS holiday
        FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "prediction": f"""
        SELECT o_custkey % 25 AS counterId,
               strftime(DATE '{fx.AS_OF}' + CAST(o_orderkey % 10 AS INTEGER), '%Y-%m-%d') AS date,
               o_totalprice / 1000 AS visits_pred, CASE WHEN o_orderkey % 53 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS load
        FROM orders""",
    "feed": f"""
        SELECT counterId, CAST(CASE WHEN counterId % 2 = 0 THEN {fx.PARK_EVEN} ELSE {fx.PARK_ODD} END AS BIGINT)
                   AS parkId, load, CAST(date AS DATE) AS date
        FROM prediction""",
    "weekday_profile_counter": """
        SELECT counterId, weekday, hour2d, avg(visits) AS visits_mean FROM hourly
        GROUP BY counterId, weekday, hour2d""",
}

# which CTEs each CTE needs
DEPS = {
    "ev": [], "readings": ["ev"], "hours": ["ev"], "weather": ["hours"], "hol": [],
    "enriched": ["weather", "readings"], "enriched_h": ["enriched", "hol"], "hourly": ["enriched_h"],
    "daily": ["hourly"], "history_daily": [], "prediction": [], "feed": ["prediction"],
    "weekday_profile_counter": ["hourly"],
}


def with_ctes(body: str, *needed: str) -> str:
    order: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in needed:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" + body


def register(name: str, body: str, *needed: str) -> None:
    ORACLE[name] = with_ctes(body, *needed)


def _raw_line_sql() -> str:
    start = "strftime(t, '%-m/%-d/%Y %H:%M')"
    end = "strftime(t + INTERVAL 1 HOUR, '%-m/%-d/%Y %H:%M')"
    start = f"CASE WHEN event_id % 97 = 0 THEN '68/' || strftime(t, '%-d/%Y %H:%M') ELSE {start} END"
    visits = ("CASE WHEN event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 = 0 THEN 'n/a' "
              "ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END")
    park = f"CAST(CASE WHEN user_id % 2 = 0 THEN {fx.PARK_EVEN} ELSE {fx.PARK_ODD} END AS VARCHAR)"
    fill = ["'G' || CAST(event_id AS VARCHAR)" if f is None else "'" + f + "'" for f in fx.FILLERS]
    fields = ["CAST(event_id AS VARCHAR)", "CAST(user_id AS VARCHAR)", "CAST(event_id % 1000 AS VARCHAR)",
              start, end, visits, "'P' || CAST(user_id AS VARCHAR)", "'N' || CAST(user_id AS VARCHAR)",
              f"'{fx.INSTALLATION_TEXT}'", park, *fill,
              "CAST(6680000 + user_id AS VARCHAR)", "CAST(370000 + user_id AS VARCHAR)"]
    full = "concat_ws(chr(9), " + ", ".join(fields) + ")"
    short = "concat_ws(chr(9), " + ", ".join(fields[:-1]) + ")"
    return f"CASE WHEN event_id % 97 <> 0 AND event_id % 89 = 0 THEN {short} ELSE {full} END"


HEADER = "\t".join(schemas.RAW_READING_FIELDS)
READING_COLS = ", ".join(schemas.READING.names)
ENRICHED_COLS = ", ".join(schemas.ENRICHED.names)

# ---- step 1 ------------------------------------------------------------------------------------------

register("clean_readings", f"SELECT {READING_COLS} FROM readings", "readings")
register("rejected_readings", f"""
    SELECT {_raw_line_sql()} AS value,
           CASE WHEN event_id % 97 = 0 THEN 'startDate' WHEN event_id % 89 = 0 THEN 'field_count'
                ELSE 'visits' END AS reason
    FROM ev WHERE event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0
    UNION ALL SELECT '{HEADER}' AS value, 'measurmentId' AS reason""", "ev")
register("json_round_trip", f"SELECT {READING_COLS} FROM readings", "readings")
register("clean_weather", "SELECT * FROM weather", "weather")
register("rejected_weather", """
    SELECT concat_ws(',', CAST(year(t) AS VARCHAR), CAST(month(t) AS VARCHAR), CAST(day(t) AS VARCHAR),
                     CASE WHEN h % 7 = 3 THEN strftime(t, '%H:%M:%S') ELSE strftime(t, '%H:%M') END, 'UTC',
                     CASE WHEN h % 13 = 0 THEN '' ELSE CAST(h % 9 AS VARCHAR) END,
                     CAST(980 + h % 50 AS VARCHAR), CAST(40 + (h * 7) % 60 AS VARCHAR),
                     CAST(CAST(h % 8 AS DOUBLE) * 0.25 AS VARCHAR), CAST(h % 5 AS VARCHAR),
                     CAST(CAST((h * 5) % 40 AS DOUBLE) - 19.5 AS VARCHAR), CAST(CAST((h * 5) % 40 AS DOUBLE) - 19.5 - 2 AS VARCHAR), 'x',
                     CAST((h * 15) % 360 AS VARCHAR), CAST(CAST(h % 10 AS DOUBLE) + 0.5 AS VARCHAR), CAST(h % 10 AS VARCHAR))
               AS value, 'visib' AS reason
    FROM hours WHERE h % 101 = 50""", "hours")
register("join_weather", f"SELECT {ENRICHED_COLS} FROM enriched", "enriched")
register("mark_holidays", f"SELECT {ENRICHED_COLS}, holiday FROM enriched_h", "enriched_h")
register("daily_rollup", "SELECT * FROM daily", "daily")
register("daily_load", """
    SELECT d.counterId, d.date_day AS date, CAST(d.visits AS DOUBLE) AS visits_pred,
           CAST(d.visits AS DOUBLE) / CAST(s.visits_max + 1 AS DOUBLE) AS load
    FROM daily d JOIN (SELECT counterId, max(visits) AS visits_max FROM daily GROUP BY counterId) s
      USING (counterId)""", "daily")

# ---- step 2 ------------------------------------------------------------------------------------------

register("add_calendar", """
    SELECT measurmentId, counterId, startDate, year, month, day, hour, weekday, hour2d, date_day, ds
    FROM hourly""", "hourly")
register("day_part_rollup", f"""
    SELECT counterId, date_day, year, month, day_part, CAST(coalesce(sum(visits), 0) AS BIGINT) AS visits,
           {', '.join(f'avg({m}) AS {m}' for m in schemas.DAY_PART_MEANS)},
           coalesce(bool_or(holiday), false) AS holiday,
           CASE day_part WHEN 0 THEN '01:00' WHEN 1 THEN '09:00' ELSE '17:00' END AS hours,
           date_day || ' ' || CASE day_part WHEN 0 THEN '01:00' WHEN 1 THEN '09:00' ELSE '17:00' END AS ds
    FROM (SELECT *, CAST(CASE WHEN hour <= 12 THEN 0 WHEN hour <= 16 THEN 1 ELSE 2 END AS BIGINT) AS day_part
          FROM hourly WHERE hour BETWEEN 9 AND 20)
    GROUP BY counterId, date_day, year, month, day_part""", "hourly")
register("hourly_profile", """
    SELECT counterId, hour, avg(visits) AS visits_mean FROM hourly GROUP BY counterId, hour""", "hourly")
register("weekday_profile_park", """
    SELECT parkCode, weekday, hour2d, avg(visits) AS visits_mean FROM hourly
    GROUP BY parkCode, weekday, hour2d""", "hourly")
register("weekday_profile_counter", "SELECT * FROM weekday_profile_counter", "weekday_profile_counter")
register("distinct_keys", "SELECT DISTINCT parkCode, counterId FROM hourly", "hourly")
register("row_counts", "SELECT count(*) AS n_rows, count(cloud) AS n_not_null FROM weather", "weather")
register("drop_incomplete", f"""
    SELECT {ENRICHED_COLS}, holiday FROM enriched_h WHERE cloud IS NOT NULL AND visits IS NOT NULL""",
         "enriched_h")
register("for_counter", "SELECT * FROM history_daily WHERE counterId = 7", "history_daily")
register("preview", """
    SELECT measurmentId, counterId, startDate, visits FROM readings
    ORDER BY visits DESC, measurmentId DESC LIMIT 20""", "readings")
register("profile_for_date", """
    SELECT r.counterId, p.weekday, strftime(r.date, '%Y-%m-%d') AS date, p.hour2d, p.visits_mean
    FROM (SELECT DISTINCT counterId, date FROM feed) r
    JOIN weekday_profile_counter p ON p.counterId = r.counterId AND p.weekday = isodow(r.date) - 1""",
         "feed", "weekday_profile_counter")


# ---- step 3 ------------------------------------------------------------------------------------------

# Spark converts a DOUBLE to DECIMAL through its shortest decimal text; the twins do the same
# (CAST via VARCHAR), since a direct DuckDB cast scales in binary and can differ in the last digit.


def _sql_text(text: str) -> str:
    """A SQL string expression for ``text`` (quotes doubled, newlines as chr(10))."""
    parts = [("'" + p.replace("'", "''") + "'") for p in text.split("\n")]
    return " || chr(10) || ".join(parts)


CTE["forecast"] = """
    SELECT o_orderkey, o_custkey % 25 AS counterId, strftime(o_orderdate, '%Y-%m-%d') AS date,
           CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice / 1000 - 100 END AS visits_pred
    FROM orders"""
CTE["hmax"] = "SELECT counterId, max(visits) AS visits_max FROM history_daily GROUP BY counterId"
CTE["park_routes"] = "SELECT CAST(n_nationkey AS BIGINT) AS counterId FROM nation WHERE n_regionkey <= 1"
DEPS.update({"forecast": [], "hmax": ["history_daily"], "park_routes": []})

CLAMP = "CASE WHEN visits_pred < 0 THEN CAST(0.0 AS DOUBLE) ELSE visits_pred END"
register("clamp_visits", f"SELECT counterId, date, {CLAMP} AS visits_pred FROM forecast", "forecast")
register("historic_max", "SELECT * FROM hmax", "hmax")
register("compute_load", f"""
    SELECT counterId, date, {CLAMP} AS visits_pred,
           {CLAMP} / CAST(visits_max + 1 AS DOUBLE) AS load
    FROM forecast JOIN hmax USING (counterId)""", "forecast", "hmax")
register("prediction_feed", f"""
    SELECT counterId, CAST({fx.PARK_EVEN} AS BIGINT) AS parkId, load, date
    FROM prediction WHERE counterId IN (SELECT counterId FROM park_routes)""", "prediction", "park_routes")
register("keep_routes", """
    SELECT counterId, parkId, load, strftime(date, '%Y-%m-%d') AS date
    FROM feed WHERE counterId IN (SELECT counterId FROM park_routes)""", "feed", "park_routes")
register("forecast_on", f"""
    SELECT counterId, parkId, load, strftime(date, '%Y-%m-%d') AS date
    FROM feed WHERE date = DATE '{fx.AS_OF}' + 3""", "feed")
_RC = ROUTE_COUNT_MESSAGE
register("route_bucket_counts", f"""
    SELECT parkId, strftime(date, '%Y-%m-%d') AS date, avoid, busy, free, unknown,
           printf({_sql_text(_RC)}, CAST(avoid AS VARCHAR), CAST(busy AS VARCHAR), CAST(free AS VARCHAR))
               AS message
    FROM (SELECT parkId, date, CAST(count_if(load > 0.7) AS BIGINT) AS avoid,
                 CAST(count_if(load > 0.5 AND load <= 0.7) AS BIGINT) AS busy,
                 CAST(count_if(NOT (load > 0.5)) AS BIGINT) AS free, CAST(count_if(load IS NULL) AS BIGINT) AS unknown
          FROM feed GROUP BY parkId, date)""", "feed")

_STATE = ("CASE WHEN mean_load IS NULL THEN 'unknown' WHEN mean_load > 0.7 THEN 'extremely busy' "
          "WHEN mean_load > 0.5 THEN 'very busy' WHEN mean_load > 0.3 THEN 'moderate' ELSE 'almost empty' END")
_MSG = "CASE " + " ".join(
    f"WHEN state = '{k}' THEN printf({_sql_text(v)}, CAST(percent AS VARCHAR))" for k, v in PARK_MESSAGES.items()
) + f" ELSE {_sql_text(PARK_UNKNOWN_MESSAGE)} END"
_PARKS = ", ".join(f"({pid})" for pid, _ in PARKS)
register("park_state", f"""
    SELECT parkId, date, mean_load, n_routes, state, percent, {_MSG} AS message
    FROM (SELECT parkId, strftime(a.date, '%Y-%m-%d') AS date, g.mean_load,
                 CAST(coalesce(g.n_routes, 0) AS BIGINT) AS n_routes,
                 {_STATE.replace('mean_load', 'g.mean_load')} AS state,
                 CAST(ceil(g.mean_load * 100) AS BIGINT) AS percent
          FROM (SELECT CAST(p AS BIGINT) AS parkId, CAST(d AS DATE) AS date
                FROM (VALUES {_PARKS}) v(p),
                     generate_series(DATE '{fx.AS_OF}', DATE '{fx.AS_OF}' + 10, INTERVAL 1 DAY) s(d)) a
          LEFT JOIN (SELECT parkId, date,
                            CAST(sum(CAST(CAST(load AS VARCHAR) AS DECIMAL(38,12))) AS DOUBLE) / CAST(count(load) AS DOUBLE)
                                AS mean_load,
                            count(*) AS n_routes
                     FROM feed GROUP BY parkId, date) g USING (parkId, date))""", "feed")
register("describe_routes", """
    SELECT f.counterId, f.parkId, f.load, strftime(f.date, '%Y-%m-%d') AS date, d.name, d.lon, d.lat, d.region
    FROM feed f LEFT JOIN (
        SELECT CAST(n_nationkey AS BIGINT) AS counterId, min(n_name) AS name,
               24.0 + CAST(n_nationkey AS DOUBLE) / 8 AS lon, 60.0 + CAST(n_nationkey AS DOUBLE) / 16 AS lat,
               CAST(n_regionkey AS BIGINT) AS region
        FROM nation GROUP BY n_nationkey, n_regionkey) d USING (counterId)""", "feed")
register("routes_in_bucket", """
    SELECT f.counterId, f.parkId, f.load, strftime(f.date, '%Y-%m-%d') AS date, 'avoid' AS bucket, n_name AS name,
           24.0 + CAST(n_nationkey AS DOUBLE) / 8 AS lon, 60.0 + CAST(n_nationkey AS DOUBLE) / 16 AS lat,
           CAST(n_regionkey AS BIGINT) AS region
    FROM feed f LEFT JOIN nation ON n_nationkey = f.counterId WHERE load > 0.7""", "feed")


def _value(x) -> str:
    return "NULL" if x is None else _sql_text(x) if isinstance(x, str) else str(x)


_BUILT_IN = ", ".join(f"({i}, {r[0]}, {_value(r[1])}, {_value(r[5])}, {_value(r[6] and float(r[6].replace(',', '.')))}, {_value(r[7])})"
                      for i, r in enumerate(ROUTES))
register("built_in_routes_feed", f"""
    SELECT CAST(v.id AS BIGINT) AS counterId, CAST({PARKS[0][0]} AS BIGINT) AS parkId, load, date, v.name, v.difficulty,
           CAST(v.length_km AS DOUBLE) AS length_km, CAST(v.duration_min AS DOUBLE) AS duration_min
    FROM prediction JOIN (VALUES {_BUILT_IN}) v(k, id, name, difficulty, length_km, duration_min)
      ON counterId % {len(ROUTES) + 1} = v.k""", "prediction")


# ---- step 4 ------------------------------------------------------------------------------------------

_FLAGS = ", ".join(
    (f"CASE WHEN c_custkey % 2 = 0 THEN (c_custkey >> {i}) & 1 END AS {f}" if f == "Restaurant"
     else f"(c_custkey >> {i}) & 1 AS {f}") for i, f in enumerate(schemas.ROUTE_FLAGS))
CTE["routes"] = f"""
    SELECT c_custkey AS counterId, c_name AS track_name, c_mktsegment AS difficulty, c_acctbal AS length_km,
           CAST(c_nationkey * 10 AS DOUBLE) AS duration_min, {_FLAGS}
    FROM customer"""
CTE["hd_last"] = "SELECT counterId, max(CAST(date_day AS DATE)) AS last FROM history_daily GROUP BY counterId"
CTE["hd_future"] = """
    SELECT counterId, strftime(last + CAST(i AS INTEGER), '%Y-%m-%d') AS ds
    FROM hd_last, generate_series(1, 10) g(i)"""
DEPS.update({"routes": [], "hd_last": ["history_daily"], "hd_future": ["hd_last"]})

register("latest_per_counter", """
    SELECT * FROM (SELECT * FROM history_daily UNION ALL SELECT * REPLACE (visits + 1 AS visits) FROM history_daily)
    QUALIFY rank() OVER (PARTITION BY counterId ORDER BY date_day DESC) = 1""", "history_daily")
register("last_n_per_counter", """
    SELECT * FROM history_daily
    QUALIFY row_number() OVER (PARTITION BY counterId ORDER BY date_day DESC) <= 200""", "history_daily")
register("ordered_split", """
    SELECT *, CASE WHEN rn <= 400 THEN 'train' ELSE 'test' END AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY counterId ORDER BY date_day) AS rn FROM history_daily)""",
         "history_daily")
register("to_series", "SELECT counterId, date_day AS ds, CAST(visits AS DOUBLE) AS y FROM history_daily",
         "history_daily")
register("future_days", "SELECT * FROM hd_future", "hd_future")
register("split_horizon", """
    SELECT counterId, date_day AS ds, 'history' AS part FROM history_daily
    UNION ALL SELECT counterId, ds, 'future' AS part FROM hd_future""", "history_daily", "hd_future")
register("future_day_parts", """
    SELECT counterId, strftime(DATE '2024-02-01' + CAST(i AS INTEGER), '%Y-%m-%d') || ' ' || l AS ds,
           CAST(p AS BIGINT) AS day_part
    FROM (SELECT DISTINCT counterId FROM history_daily), generate_series(0, 9) g(i),
         (VALUES (0, '01:00'), (1, '09:00'), (2, '17:00')) v(p, l)""", "history_daily")
_COV = ", ".join(f"('{d}', {t})" for d, t in zip(FUTURE_TEMP_DATES, FUTURE_TEMPS))
register("future_covariates", f"""
    SELECT counterId, date, CAST(temp AS BIGINT) AS temp FROM routes, (VALUES {_COV}) v(date, temp)""", "routes")
register("stack_routes", "SELECT * FROM routes", "routes")
register("attach_routes", "SELECT * FROM daily JOIN routes USING (counterId)", "daily", "routes")


# ---- step 5 ------------------------------------------------------------------------------------------

register("forecast_error", """
    SELECT counterId, count(*) AS n,
           CAST(sum(CAST(CAST(CAST(y AS DOUBLE) AS VARCHAR) AS DECIMAL(38,12))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS y_mean,
           CAST(sum(CAST(CAST((y - yhat) * (y - yhat) AS VARCHAR) AS DECIMAL(38,12))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mse,
           sqrt(CAST(sum(CAST(CAST((y - yhat) * (y - yhat) AS VARCHAR) AS DECIMAL(38,12))) AS DOUBLE) / CAST(count(*) AS DOUBLE))
               AS rmse
    FROM (SELECT h.counterId, CAST(h.visits AS DOUBLE) AS y, f.visits_pred AS yhat
          FROM history_daily h JOIN forecast f ON f.counterId = h.counterId AND f.date = h.date_day AND f.o_orderkey % 53 <> 0)
    WHERE y IS NOT NULL AND yhat IS NOT NULL
    GROUP BY counterId""", "history_daily", "forecast")


# ---- step 6 ------------------------------------------------------------------------------------------

_FEAT = ", ".join([f"coalesce({m}, 0.0) AS {m}" for m in M]
                  + ["visits", "coalesce(cordNorth, 0.0) AS cordNorth", "coalesce(coordSouth, 0.0) AS coordSouth",
                     "coalesce(month, 0.0) AS month", "coalesce(day, 0.0) AS day",
                     "CAST(holiday AS BIGINT) AS holiday"])
register("feature_table", f"SELECT {_FEAT} FROM daily JOIN routes USING (counterId)", "daily", "routes")


# ---- step 7 ------------------------------------------------------------------------------------------

register("parse_coverage", f"""
    SELECT CAST(user_id AS VARCHAR) || '-' || strftime(day, '%Y%m%d') AS doc, CAST(odd - low AS BIGINT) AS member,
           point, CAST(user_id AS DOUBLE) AS x, CAST(event_id AS DOUBLE) AS y,
           strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS time,
           value AS {fx.COVERAGE_FIELDS[0]}, CAST(event_id % 7 AS DOUBLE) AS {fx.COVERAGE_FIELDS[1]}
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day, odd ORDER BY event_id) - 1 AS point,
                 row_number() OVER (PARTITION BY user_id, day, odd ORDER BY event_id DESC) AS back,
                 min(odd) OVER (PARTITION BY user_id, day) AS low
          FROM (SELECT *, CAST(ts AS DATE) AS day, event_id % 2 AS odd FROM events))
    WHERE NOT (user_id % 2 = 1 AND back = 1)""")


# ---- text forms and orders -----------------------------------------------------------------------------

register("enriched_csv_round_trip", f"SELECT {ENRICHED_COLS}, holiday FROM enriched_h", "enriched_h")
register("route_csv_round_trip", "SELECT * FROM routes WHERE counterId % 2 = 0", "routes")
ORACLE["prediction_csv_feed"] = ORACLE["prediction_feed"]
register("weekday_profile_sorted", """
    SELECT parkCode, weekday, hour2d, avg(visits) AS visits_mean, row_number() OVER (ORDER BY parkCode, weekday, hour2d) AS place
    FROM hourly GROUP BY parkCode, weekday, hour2d""", "hourly")
CTE["day_parts"] = """
    SELECT counterId, date_day, CAST(CASE WHEN hour <= 12 THEN 0 WHEN hour <= 16 THEN 1 ELSE 2 END AS BIGINT) AS day_part,
           CAST(coalesce(sum(visits), 0) AS BIGINT) AS visits
    FROM hourly WHERE hour BETWEEN 9 AND 20 GROUP BY ALL"""
DEPS["day_parts"] = ["hourly"]
register("day_part_rollup_sorted", """
    SELECT *, row_number() OVER (ORDER BY date_day, day_part, counterId) AS place FROM day_parts""", "day_parts")


# ---- models ----------------------------------------------------------------------------------------------

# t: days since the first day of all data, which keeps the sums of the line fit small
CTE["line_points"] = "SELECT counterId, date_day, CAST(date_day AS DATE) - DATE '1992-01-01' AS t, CAST(visits AS DOUBLE) AS y FROM history_daily"
CTE["lines"] = "SELECT counterId, coalesce(regr_slope(y, t), 0) AS b, coalesce(regr_intercept(y, t), avg(y)) AS a FROM line_points GROUP BY counterId"
CTE["trend_days"] = """
    SELECT counterId, ds, a + b * (CAST(ds AS DATE) - DATE '1992-01-01') AS yhat FROM hd_future JOIN lines USING (counterId)"""
CTE["part_points"] = """
    SELECT counterId, CAST(y AS DOUBLE) AS y, epoch(CAST(date_day || ' ' || CASE day_part WHEN 0 THEN '01:00' WHEN 1 THEN '09:00' ELSE '17:00' END
             AS TIMESTAMP) - TIMESTAMP '2024-01-01 00:00:00') / 86400.0 AS t
    FROM (SELECT *, visits AS y FROM day_parts)"""
CTE["part_frame"] = """
    SELECT strftime(DATE '2024-02-01' + CAST(i AS INTEGER), '%Y-%m-%d') || ' ' || l AS date,
           epoch(CAST(strftime(DATE '2024-02-01' + CAST(i AS INTEGER), '%Y-%m-%d') || ' ' || l AS TIMESTAMP) - TIMESTAMP '2024-01-01 00:00:00') / 86400.0 AS t
    FROM generate_series(0, 9) g(i), (VALUES ('01:00'), ('09:00'), ('17:00')) v(l)"""
CTE["daily_max"] = "SELECT counterId, max(visits) AS visits_max FROM daily GROUP BY counterId"
DEPS.update({"line_points": ["history_daily"], "lines": ["line_points"], "trend_days": ["hd_future", "lines"],
             "part_points": ["day_parts"], "part_frame": [], "daily_max": ["daily"]})


def _load(pred: str, most: str) -> str:
    clamped = f"CASE WHEN {pred} < 0 THEN 0.0 ELSE {pred} END"
    return f"round({clamped}, 2) AS visits_pred, round({clamped} / CAST({most} + 1 AS DOUBLE), 5) AS load"


register("trend_forecast", "SELECT counterId, ds, round(yhat, 2) AS yhat FROM trend_days", "trend_days")
register("trend_backcast", "SELECT p.counterId, date_day AS ds, y, round(a + b * t, 2) AS yhat FROM line_points p JOIN lines USING (counterId)", "line_points", "lines")
register("trend_holdout", """
    SELECT counterId, count(*) AS n, round(avg(y), 4) AS y_mean, round(avg((y - yhat) * (y - yhat)), 2) AS mse, round(sqrt(avg((y - yhat) * (y - yhat))), 3) AS rmse
    FROM (SELECT p.counterId, y, a + b * t AS yhat
          FROM (SELECT *, row_number() OVER (PARTITION BY counterId ORDER BY t) AS rn FROM line_points) p
          JOIN (SELECT counterId, regr_slope(y, t) AS b, regr_intercept(y, t) AS a
                FROM (SELECT *, row_number() OVER (PARTITION BY counterId ORDER BY t) AS rn FROM line_points) WHERE rn <= 400 GROUP BY counterId) l
            ON l.counterId = p.counterId WHERE rn > 400)
    GROUP BY counterId""", "line_points")
register("trend_daily_prediction", f"""
    SELECT counterId, ds AS date, {_load('yhat', 'visits_max')} FROM trend_days JOIN hmax USING (counterId)""", "trend_days", "hmax")
register("trend_day_part_prediction", f"""
    SELECT l.counterId, date, {_load('(a + b * t)', 'visits_max')}
    FROM (SELECT counterId, coalesce(regr_slope(y, t), 0) AS b, coalesce(regr_intercept(y, t), avg(y)) AS a FROM part_points GROUP BY counterId) l
    JOIN daily_max m ON m.counterId = l.counterId, part_frame""", "part_points", "part_frame", "daily_max")
register("trend_day_part_prediction_pooled", f"""
    SELECT counterId, date, {_load('(a + b * t)', 'visits_max')}
    FROM daily_max, (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM part_points) l, part_frame""",
         "part_points", "part_frame", "daily_max")
register("stump_prediction", """
    SELECT CAST(holiday AS BIGINT) AS holiday, count(*) AS n, round(avg(visits), 4) AS low, round(avg(visits), 4) AS high
    FROM history_daily GROUP BY holiday""", "history_daily")
register("stump_error", """
    SELECT count(*) AS n, round(sqrt(avg((visits - m) * (visits - m))), 4) AS rmse, 'holiday' AS feature, CAST(1.0 AS DOUBLE) AS importance
    FROM (SELECT visits, avg(visits) OVER (PARTITION BY holiday) AS m FROM history_daily)""", "history_daily")

# for the full models: keys, dates, row counts and that every value is a usable number
register("fit_forecast_frame", "SELECT counterId, ds, true AS usable FROM hd_future", "hd_future")
register("backcast_frame", "SELECT counterId, date_day AS ds, CAST(visits AS DOUBLE) AS y, true AS usable FROM history_daily", "history_daily")
register("evaluate_holdout_frame", """
    SELECT counterId, count(*) AS n, round(avg(y), 4) AS y_mean, true AS usable
    FROM (SELECT *, row_number() OVER (PARTITION BY counterId ORDER BY t) AS rn FROM line_points) WHERE rn > 400 GROUP BY counterId""", "line_points")
register("daily_prediction_frame", "SELECT counterId, ds AS date, true AS usable FROM hd_future", "hd_future")
for _name in ("day_part_prediction_frame", "day_part_prediction_pooled_frame"):
    register(_name, "SELECT counterId, date, true AS usable FROM daily_max, part_frame", "daily_max", "part_frame")
CTE["daily_routes"] = "SELECT * FROM daily JOIN routes USING (counterId)"
DEPS["daily_routes"] = ["daily", "routes"]
register("fit_visits_gbt_frame", """
    SELECT counterId, date_day, visits, true AS usable
    FROM (SELECT *, row_number() OVER (PARTITION BY counterId ORDER BY date_day) AS rn FROM daily_routes) WHERE rn > 14""", "daily_routes")
register("gbt_future_prediction_frame", """
    SELECT counterId, strftime(last + CAST(i AS INTEGER), '%Y-%m-%d') AS date, true AS usable
    FROM (SELECT counterId, max(CAST(date_day AS DATE)) AS last FROM daily_routes GROUP BY counterId), generate_series(1, 10) g(i)""", "daily_routes")
_NAMES = ", ".join(f"('{n}')" for n in [*M, "cordNorth", "coordSouth", "month", "day", "holiday", "yhat"])
register("feature_importance_frame", f"SELECT f AS feature, true AS usable, CAST(1.0 AS DOUBLE) AS total FROM (VALUES {_NAMES}) v(f)")


# ---- coefficient tables, sparse trends, trees per counter ------------------------------------------------

register("trend_model", """
    SELECT p.counterId, count(y) AS n, max(date_day) AS last_day, min(date_day) AS first_day, round(any_value(a) + any_value(b) * min(t), 2) AS start,
           round(any_value(b), 5) AS slope
    FROM line_points p JOIN lines l ON l.counterId = p.counterId GROUP BY p.counterId""", "line_points", "lines")
ORACLE["trend_model_forecast"] = ORACLE["trend_forecast"]
ORACLE["trend_model_prediction"] = ORACLE["trend_daily_prediction"]
CTE["ends"] = "SELECT counterId, min(CAST(date_day AS DATE)) AS lo, max(CAST(date_day AS DATE)) AS hi FROM history_daily GROUP BY counterId"
DEPS["ends"] = ["history_daily"]
register("sparse_trend_changes", "SELECT counterId, strftime(lo + CAST(floor((hi - lo) / 2.0) AS INTEGER), '%Y-%m-%d') AS day, CAST(3 AS DOUBLE) AS change FROM ends", "ends")
register("sparse_trend_forecast", """
    SELECT counterId, strftime(hi + CAST(i AS INTEGER), '%Y-%m-%d') AS ds,
           round(CAST(100 + 2 * (hi - lo + i) + 3 * (hi - lo + i - (hi - lo) / 2.0) AS DOUBLE), 1) AS yhat
    FROM ends, generate_series(1, 10) g(i)""", "ends")
register("keyed_boosting", """
    SELECT counterId, holiday, n, round(base + (m - base) * (1 - pow(0.95, 7)), 4) AS low, round(base + (m - base) * (1 - pow(0.95, 7)), 4) AS high
    FROM (SELECT counterId, CAST(holiday AS BIGINT) AS holiday, count(*) AS n, avg(visits) AS m FROM history_daily GROUP BY ALL)
    JOIN (SELECT counterId, avg(visits) AS base FROM history_daily GROUP BY counterId) USING (counterId)""", "history_daily")
register("patient_boosting", """
    SELECT count(*) AS n, round(sqrt(avg((visits - m) * (visits - m))), 4) AS rmse, CAST(1 AS BIGINT) AS rounds, CAST(8 AS BIGINT) AS trained
    FROM (SELECT *, row_number() OVER (PARTITION BY counterId ORDER BY date_day) AS rn FROM history_daily) v
    JOIN (SELECT holiday, avg(visits) AS m
          FROM (SELECT *, row_number() OVER (PARTITION BY counterId ORDER BY date_day) AS rn FROM history_daily) WHERE rn <= 400 GROUP BY holiday) t
      ON t.holiday = v.holiday WHERE rn > 400""", "history_daily")

# ---- tables that grow and tables that are replaced -------------------------------------------------------

ORACLE["incremental_daily_rollup"] = ORACLE["daily_rollup"]
ORACLE["incremental_day_part_rollup"] = ORACLE["day_part_rollup"]
register("incremental_historic_max", "SELECT counterId, visits_max FROM daily_max", "daily_max")
register("republished_days", "SELECT parkCode, counterIdPave, visits, date_day FROM daily", "daily")
register("partitioned_readings", f"""
    SELECT parkCode, count(*) AS n, CAST(sum(visits) AS BIGINT) AS visits, count(*) > {fx.ROWS_PER_FILE} AS several_files FROM readings GROUP BY parkCode""", "ev", "readings")
register("partitioned_profiles", "SELECT parkCode, weekday, hour2d, avg(visits) AS visits_mean FROM hourly GROUP BY parkCode, weekday, hour2d", "hourly")
register("read_coverage_files", f"""
    SELECT user_id AS user, member,
           point, CAST(user_id AS DOUBLE) AS x, CAST(event_id AS DOUBLE) AS y,
           strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS time,
           value AS {fx.COVERAGE_FIELDS[0]}, CAST(event_id % 7 AS DOUBLE) AS {fx.COVERAGE_FIELDS[1]}
    FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY day, odd) - 1 AS member,
                 row_number() OVER (PARTITION BY user_id, day, odd ORDER BY event_id) - 1 AS point,
                 row_number() OVER (PARTITION BY user_id, day, odd ORDER BY event_id DESC) AS back
          FROM (SELECT *, CAST(ts AS DATE) AS day, event_id % 2 AS odd FROM events))
    WHERE NOT (user_id % 2 = 1 AND back = 1)""")

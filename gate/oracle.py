"""The same results in SQL, written against the driver's tables independently of the Spark operators."""
from __future__ import annotations

from gate.views import WEIGHTS


def r(expr: str) -> str:
    """Four decimals. The detour over nine removes float noise, so that exact ties fall alike in both engines."""
    return f"CAST(round(CAST({expr} AS DECIMAL(30, 9)), 4) AS DOUBLE)"


def two(expr: str) -> str:
    """Two decimals, ties to even."""
    d = f"CAST({expr} AS DECIMAL(30, 9)) * 100"
    tie = f"({d}) % 1 = 0.5 AND floor({d}) % 2 = 0"
    return f"CAST(CASE WHEN {tie} THEN floor({d}) / 100 ELSE round(CAST({expr} AS DECIMAL(30, 9)), 2) END AS DOUBLE)"


# --- the views -----------------------------------------------------------------------------------------------------------

VIEWS = """
opt AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS search_id, rs.r_name AS origin, rc.r_name AS destination,
    CAST(l_shipdate AS DATE) AS outbound_date,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS DATE) + l_linenumber END AS return_date,
    l_extendedprice AS price, 'INR' AS currency, l_quantity * 10 + 60 AS total_duration_minutes,
    p_type AS flight_type, p_brand AS airline, l_linenumber - 2 AS stops, l_discount * 1000 AS carbon_emissions_kg,
    l_returnflag || l_linestatus AS booking_token,
    CAST(CAST(l_shipdate AS DATE) - CAST((7 * l_orderkey + 13 * l_linenumber) % 97 - 2 AS INTEGER) AS TIMESTAMP)
      + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS collected_at,
    l_partkey, l_suppkey, l_linenumber, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey
    JOIN region rc ON nc.n_regionkey = rc.r_regionkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey
    JOIN region rs ON ns.n_regionkey = rs.r_regionkey
    JOIN part ON l_partkey = p_partkey),
obs0 AS (
  SELECT * REPLACE (greatest(stops, 0) AS stops), origin || '-' || destination AS route, price AS total_fare,
    collected_at AS collection_timestamp, CAST(collected_at AS DATE) AS collection_date,
    greatest(outbound_date - CAST(collected_at AS DATE), 0) AS advance_purchase_days,
    isodow(outbound_date) >= 6 AS is_weekend, price > 90000 AS fare_outlier, CAST(id AS VARCHAR) AS record_id,
    total_duration_minutes AS duration_minutes
  FROM opt),
obs AS (
  SELECT *, CASE WHEN advance_purchase_days <= 3 THEN '0-3 days' WHEN advance_purchase_days <= 7 THEN '4-7 days'
      WHEN advance_purchase_days <= 14 THEN '8-14 days' WHEN advance_purchase_days <= 30 THEN '15-30 days'
      WHEN advance_purchase_days <= 60 THEN '31-60 days' ELSE '60+ days' END AS booking_window,
    CASE WHEN total_fare <= 5000 THEN '<=5K' WHEN total_fare <= 7500 THEN '5K-7.5K'
      WHEN total_fare <= 10000 THEN '7.5K-10K' WHEN total_fare <= 15000 THEN '10K-15K'
      WHEN total_fare <= 25000 THEN '15K-25K' WHEN total_fare <= 50000 THEN '25K-50K' ELSE '50K+' END AS fare_bucket
  FROM obs0),
dense AS (SELECT * REPLACE (CAST(date_trunc('month', outbound_date) AS DATE) AS outbound_date) FROM obs),
dirty AS (
  SELECT * REPLACE (
      CASE WHEN l_partkey % 53 = 0 THEN 'n/a' WHEN l_partkey % 50 = 0 THEN CAST(-price AS VARCHAR)
        ELSE CAST(price AS VARCHAR) END AS price,
      CASE WHEN l_partkey % 37 = 0 THEN NULL WHEN l_partkey % 41 = 0 THEN ''
        WHEN l_partkey % 43 = 0 THEN 'Air "' || airline || '", Ltd'
        WHEN l_suppkey % 3 = 0 THEN '  ' || replace(airline, '#', '   ') || ' ' ELSE airline END AS airline,
      CASE WHEN l_partkey % 59 = 0 THEN 'bad' ELSE CAST(outbound_date AS VARCHAR) END AS outbound_date,
      CASE WHEN l_quantity = 1 THEN -total_duration_minutes ELSE total_duration_minutes END AS total_duration_minutes,
      CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE currency END AS currency,
      CASE WHEN l_suppkey % 5 = 0 THEN lower(origin) ELSE origin END AS origin)
  FROM opt, range(1, CASE WHEN search_id % 20 = 0 THEN 3 ELSE 2 END) AS copies(copy)),
search AS (
  SELECT o_orderkey AS id, rc.r_name AS origin, rd.r_name AS destination, CAST(o_orderdate AS DATE) AS outbound_date,
    o_orderdate AS searched_at, sha256(CAST(o_orderkey AS VARCHAR)) AS request_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey
    JOIN region rc ON nc.n_regionkey = rc.r_regionkey JOIN region rd ON o_orderkey % 5 = rd.r_regionkey),
flat AS (
  SELECT search_id, o_orderdate AS collection_timestamp, CAST(o_orderdate AS DATE) AS collection_date, origin AS departure_airport,
    destination AS arrival_airport, origin || '-' || destination AS route, CAST(o_orderdate AS DATE) + 5 AS outbound_date,
    5 AS advance_purchase_days, airline,
    array_to_string(['F-' || i FOR i IN range(1, greatest(stops, 0) + 2)], ',') AS flight_numbers,
    '08:00' AS departure_time, '12:00' AS arrival_time, CAST(total_duration_minutes AS INTEGER) AS duration_minutes,
    greatest(stops, 0) AS stops, price AS total_fare, 'INR' AS currency, l_partkey % 10 = 0 AS sold_out,
    CASE WHEN l_partkey % 10 = 0 THEN 'Sold out' ELSE 'Carry-on' END AS availability_details
  FROM opt JOIN orders ON search_id = o_orderkey)"""


def sql(body: str, *more: str) -> str:
    """`body` over the views and the CTEs in `more`."""
    return "WITH " + ",\n".join([VIEWS.strip(), *[m.strip() for m in more]]) + "\n" + body


TEXT_TIME = "'%Y-%m-%d %H:%M:%S'"


def stamp(c: str) -> str:
    return f"strftime({c}, {TEXT_TIME})"


# --- building blocks --------------------------------------------------------------------------------------------------------

FIVE = {"average_fare": "avg(total_fare)", "median_fare": "median(total_fare)", "minimum_fare": "min(total_fare)",
        "maximum_fare": "max(total_fare)"}
STD = {"fare_std": "coalesce(stddev_samp(total_fare), 0)"}
COUNT = {"observations": "count(total_fare)"}
AIRLINES = {"airlines": "count(DISTINCT airline)"}
VOL = "coalesce(stddev_samp(total_fare), 0) / avg(total_fare) * 100"
RANGE = {"fare_range": "max(total_fare) - min(total_fare)"}
CHANGE = "(avg(total_fare) / nullif(lag(avg(total_fare)) OVER (PARTITION BY route ORDER BY {0}), 0) - 1) * 100"
WHOLE = ("observations", "airlines", "routes", "sample_size", "observation_count", "route_count")
PERIODS = {"week_start": "CAST(date_trunc('week', outbound_date) AS DATE)", "month": "strftime(outbound_date, '%Y-%m')",
           "outbound_date": "outbound_date"}


def grouped(source: str, keys: dict[str, str], *parts: dict[str, str], where: str = "true") -> str:
    fields = {k: e for part in parts for k, e in part.items()}
    shown = [f"{e} AS {k}" for k, e in keys.items()]
    shown += [f"{e if k in WHOLE else r(e)} AS {k}" for k, e in fields.items()]
    by = f" GROUP BY {', '.join(keys.values())}" if keys else ""
    return f"SELECT {', '.join(shown)} FROM {source} WHERE {where}{by}"


def period(source: str, name: str, *parts: dict[str, str], change: str, vol: str) -> str:
    key = PERIODS[name]
    return grouped(source, {name: key, "route": "route"}, FIVE, STD, COUNT, *parts, {vol: VOL, change: CHANGE.format(key)})


def stays(key: str) -> dict[str, str]:
    return {key: key}


ROUTE, AIRLINE, WINDOW = stays("route"), stays("airline"), stays("booking_window")
MEANS = {"average_duration_minutes": "avg(total_duration_minutes)", "average_stops": "avg(stops)"}

# --- index ----------------------------------------------------------------------------------------------------------------------


def index(source: str) -> str:
    weights = ", ".join(f"('{k}', {w})" for k, w in WEIGHTS.items())
    return f"""
w(route, weight) AS (VALUES {weights}),
per AS (SELECT outbound_date, route, avg(total_fare) AS average_fare, median(total_fare) AS median_fare,
    min(total_fare) AS minimum_fare, max(total_fare) AS maximum_fare, count(total_fare) AS observation_count
  FROM {source} GROUP BY 1, 2),
base AS (SELECT route, avg(total_fare) AS base_fare FROM {source}
  WHERE outbound_date = (SELECT min(outbound_date) FROM {source}) GROUP BY 1),
ri AS (SELECT per.*, base_fare, average_fare / base_fare * 100 AS route_index, coalesce(weight, 0) AS route_weight,
    average_fare / base_fare * 100 * coalesce(weight, 0) AS weighted_contribution
  FROM per LEFT JOIN base USING (route) LEFT JOIN w USING (route)),
di AS (SELECT outbound_date, coalesce(sum(weighted_contribution), 0) AS weighted_index, sum(route_weight) AS available_weight,
    count(*) AS route_count, sum(observation_count) AS total_observations, avg(average_fare) AS average_fare,
    CASE WHEN sum(route_weight) > 0
      THEN {two('coalesce(sum(weighted_contribution), 0) / sum(route_weight)')} END AS price_index
  FROM ri GROUP BY 1),
wi AS (SELECT CAST(date_trunc('week', outbound_date) AS DATE) AS week_start, avg(price_index) AS price_index,
    CAST(sum(route_count) AS BIGINT) AS observations, CAST(sum(total_observations) AS BIGINT) AS fares FROM di GROUP BY 1),
mi AS (SELECT strftime(outbound_date, '%Y-%m') AS month, avg(price_index) AS price_index,
    CAST(sum(route_count) AS BIGINT) AS observations, avg(route_count) AS route_count, avg(average_fare) AS average_fare
  FROM di GROUP BY 1)"""


def changed(column: str, order: str) -> str:
    return f"({column} / nullif(lag({column}) OVER (ORDER BY {order}), 0) - 1) * 100"


def trend(source: str, date: str = "outbound_date") -> str:
    return f"""
tday AS (SELECT {date} AS date, avg(total_fare) AS fare FROM {source} GROUP BY 1),
trend AS (SELECT date, {two('fare / (SELECT arg_min(fare, date) FROM tday) * 100')} AS price_index FROM tday)"""


LATEST = """
seq AS (SELECT *, lag(price_index) OVER (ORDER BY outbound_date) AS previous FROM di),
latest AS (SELECT * FROM seq ORDER BY outbound_date DESC LIMIT 1)"""

# --- results ------------------------------------------------------------------------------------------------------------------------

ORACLE: dict[str, str] = {}

ORACLE["src_search_csv"] = sql(f"""
SELECT id, origin, destination, outbound_date, 'INR' AS currency, {stamp('searched_at')} AS searched_at, request_id
FROM search WHERE origin <> destination AND id % 59 <> 0""")
ORACLE["src_option_csv"] = sql(f"""
SELECT id, search_id, upper(origin) AS origin, destination, CAST(outbound_date AS DATE) AS outbound_date,
  {r('CAST(price AS DOUBLE)')} AS price, nullif(currency, '') AS currency,
  {r('CASE WHEN total_duration_minutes > 0 THEN total_duration_minutes END')} AS total_duration_minutes,
  trim(regexp_replace(airline, '\\s+', ' ', 'g')) AS airline, greatest(stops, 0) AS stops,
  {stamp('collected_at')} AS collected_at
FROM dirty WHERE l_partkey % 59 <> 0 AND l_partkey % 53 <> 0 AND l_partkey % 50 <> 0 AND airline <> ''""")
ORACLE["src_observation_json"] = sql("""
SELECT CAST(id AS VARCHAR) AS record_id, origin AS departure_airport, destination AS arrival_airport, outbound_date,
  airline, price, currency, CAST(stops AS VARCHAR) AS stops FROM dirty""")
ORACLE["src_processed_parquet"] = sql(f"""
SELECT record_id, route, outbound_date, airline, {r('total_fare')} AS total_fare FROM obs""")
ORACLE["src_optional_table"] = sql("SELECT 'present' AS found, route, count(*) AS rows FROM obs GROUP BY route")
ORACLE["sink_dual"] = sql(f"""
SELECT format, route, outbound_date, average_fare, observations, fare_change_pct
FROM ({period('dense', 'outbound_date', AIRLINES, RANGE, change='fare_change_pct', vol='volatility_pct')}),
  (VALUES ('parquet'), ('csv')) AS f(format)""")
ORACLE["sink_append_new"] = sql(f"""
SELECT route, CAST(year(collection_date) AS INTEGER) AS year, count(*) AS stored, {r('sum(total_fare)')} AS total_fare
FROM (SELECT collection_date, route, outbound_date, record_id, min(total_fare) AS total_fare FROM obs GROUP BY ALL)
GROUP BY 1, 2""")
ORACLE["sink_raw_archive"] = sql("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS responses
FROM orders WHERE o_orderkey IN (SELECT search_id FROM opt) GROUP BY 1, 2""")

ORACLE["flatten_responses"] = sql(f"""
SELECT * EXCLUDE (collection_date) REPLACE ({stamp('collection_timestamp')} AS collection_timestamp,
  {r('total_fare')} AS total_fare) FROM flat""")
ORACLE["normalize_text"] = sql("""
SELECT id, coalesce(trim(regexp_replace(airline, '\\s+', ' ', 'g')), '') AS airline,
  trim(regexp_replace(airline, '\\s+', ' ', 'g')) AS kept FROM dirty""")
ORACLE["coerce_types"] = sql(f"""
SELECT id, {r('TRY_CAST(price AS DOUBLE)')} AS price, TRY_CAST(outbound_date AS DATE) AS outbound_date,
  {stamp('collected_at')} AS collected_at FROM dirty""")
ORACLE["normalize_airports"] = sql("""
SELECT CAST(id AS VARCHAR) AS record_id, upper(origin) AS departure_airport, destination AS arrival_airport FROM dirty""")
ORACLE["normalize_airlines"] = sql("SELECT id, coalesce(nullif(trim(airline), ''), 'UNKNOWN') AS airline FROM dirty")
ORACLE["build_route"] = sql("SELECT id, origin, destination, upper(origin) || '-' || upper(destination) AS route FROM dirty")
ORACLE["parse_route"] = sql("""
SELECT record_id, route, split_part(route, '-', 1) AS route_origin, split_part(route, '-', 2) AS route_destination FROM obs""")
_POSITIVE = "CASE WHEN TRY_CAST(price AS DOUBLE) > 0 THEN TRY_CAST(price AS DOUBLE) END"
ORACLE["validate_fares"] = sql(f"SELECT id, {r(_POSITIVE)} AS price, {r(_POSITIVE)} AS total_fare FROM dirty")
ORACLE["resolve_fare"] = sql(f"""
SELECT id, {r('TRY_CAST(price AS DOUBLE)')} AS column_fare, {r('coalesce(TRY_CAST(price AS DOUBLE), 1)')} AS total_fare
FROM dirty""")
ORACLE["validate_dataset"] = sql(f"""
SELECT id, upper(origin) || '-' || destination AS route, CAST(outbound_date AS DATE) AS outbound_date,
  {r('CAST(price AS DOUBLE)')} AS total_fare
FROM dirty WHERE outbound_date <> 'bad' AND TRY_CAST(price AS DOUBLE) > 0""")
ORACLE["normalize_dataset"] = sql(f"""
SELECT id, upper(origin) || '-' || destination AS route, trim(airline) AS airline,
  TRY_CAST(outbound_date AS DATE) AS outbound_date, {r('CAST(price AS DOUBLE)')} AS total_fare, {r('stops')} AS stops
FROM dirty WHERE TRY_CAST(price AS DOUBLE) > 0""")
ORACLE["handle_missing"] = sql(f"""
SELECT record_id, airline, outbound_date, {r('coalesce(dur, (SELECT median(dur) FROM kept))')} AS duration_minutes,
  CAST(coalesce(stops, 0) AS INTEGER) AS stops, CAST(coalesce(lead, 0) AS INTEGER) AS advance_purchase_days,
  currency, {r('total_fare')} AS total_fare FROM kept""", """
kept AS (SELECT CAST(id AS VARCHAR) AS record_id, airline, TRY_CAST(outbound_date AS DATE) AS outbound_date,
    CASE WHEN total_duration_minutes > 0 THEN total_duration_minutes END AS dur,
    CASE WHEN l_partkey % 7 <> 0 THEN stops END AS stops,
    CAST(collected_at AS DATE) - DATE '1990-01-01' AS lead, 'INR' AS currency, TRY_CAST(price AS DOUBLE) AS total_fare
  FROM dirty WHERE outbound_date <> 'bad' AND airline IS NOT NULL AND TRY_CAST(price AS DOUBLE) IS NOT NULL)""")
ORACLE["search_spine"] = sql("""
SELECT origin AS departure_airport, destination AS arrival_airport,
  CAST((SELECT min(outbound_date) FROM search) + CAST(i AS INTEGER) AS DATE) AS outbound_date,
  CAST((SELECT min(outbound_date) FROM search) + CAST(i AS INTEGER) + 3 AS DATE) AS return_date
FROM (SELECT DISTINCT origin, destination FROM search), range(0, 7) AS t(i), range(0, 2) AS listed(n)
WHERE origin <> destination AND origin NOT LIKE '%-%' AND destination NOT LIKE '%-%'""")
ORACLE["organize_columns"] = sql("""
SELECT 'record_id,route,total_fare,base_fare,stops,travel_class,source,l_partkey' AS column_order, route,
  'provider' AS source, CAST(NULL AS VARCHAR) AS travel_class, CAST(NULL AS DOUBLE) AS base_fare, count(*) AS rows
FROM obs GROUP BY route""")

ORACLE["advance_days"] = sql("""
SELECT id, outbound_date, CAST(greatest(outbound_date - CAST(collected_at AS DATE), 0) AS INTEGER) AS advance_purchase_days
FROM opt""")
_WIDE = "(advance_purchase_days * 200 - 300)"


def _lead(c: str, low: str | None, limit: int | None) -> str:
    first = f"WHEN {c} <= {low} THEN NULL " if low else ""
    last = f"WHEN {c} <= {limit} THEN '60+ days'" if limit else "ELSE '60+ days'"
    steps = "".join(f"WHEN {c} <= {b} THEN '{t}' " for b, t in
                    ((3, "0-3 days"), (7, "4-7 days"), (14, "8-14 days"), (30, "15-30 days"), (60, "31-60 days")))
    return f"CASE {first}{steps}{last} END"


ORACLE["booking_window"] = sql(f"""
SELECT record_id, booking_window AS booking_window_category, CAST({_WIDE} AS INTEGER) AS wide,
  {_lead(_WIDE, '-1', 9999)} AS limited_window, {_lead(_WIDE, None, None)} AS lenient_window FROM obs""")
_B7 = "".join(f"WHEN total_fare <= {b} THEN '{t}' " for b, t in (
    (3000, "0-3000"), (5000, "3001-5000"), (7500, "5001-7500"), (10000, "7501-10000"), (15000, "10001-15000")))
ORACLE["fare_band"] = sql(f"""
SELECT id, {r('price')} AS price, {r('total_fare')} AS total_fare,
  CASE {_B7} WHEN total_fare <= 25000 THEN '15001-25000' ELSE '25000+' END AS band7,
  CASE {_B7} ELSE '15000+' END AS fare_band, {r('ln(1 + total_fare)')} AS log_fare
FROM (SELECT id, price, round_even(price, 2) AS total_fare FROM opt)""")


def _time(month: str, day_name: bool = True) -> str:
    named = "dayname(outbound_date) AS travel_day_name," if day_name else ""
    return f"""CAST(year(outbound_date) AS INTEGER) AS travel_year, CAST(month(outbound_date) AS INTEGER) AS travel_month,
  CAST(week(outbound_date) AS INTEGER) AS travel_week, CAST(day(outbound_date) AS INTEGER) AS travel_day,
  CAST(isodow(outbound_date) - 1 AS INTEGER) AS travel_day_of_week, {named} isodow(outbound_date) >= 6 AS is_weekend,
  monthname(outbound_date) AS {month}, CAST(collection_timestamp AS DATE) AS collection_date,
  CAST(hour(collection_timestamp) AS INTEGER) AS collection_hour"""


ORACLE["time_features"] = sql(f"""
SELECT id, outbound_date, {stamp('collection_timestamp')} AS collection_timestamp, {_time('travel_month_name')}
FROM (SELECT id, outbound_date, collected_at AS collection_timestamp FROM opt)""")

ORACLE["record_fingerprint"] = sql("""
SELECT search_id, sha256('{"airline":"' || airline || '","arrival_airport":"' || arrival_airport
  || '","arrival_time":"12:00","currency":"INR","departure_airport":"' || departure_airport
  || '","departure_time":"08:00","duration_minutes":' || duration_minutes || ',"flight_numbers":["'
  || replace(flight_numbers, ',', '","') || '"],"outbound_date":"' || outbound_date
  || '","return_date":null,"source":"provider","source_engine":null,"stops":' || stops || ',"total_fare":' || total_fare
  || ',"travel_class":"Economy"}') AS record_id FROM flat""")
_ID = """sha256(search_id || '|' || CAST(collected_at AS DATE) || '|' || origin || '|' || destination || '|'
  || outbound_date || '|' || coalesce(CAST(return_date AS VARCHAR), '') || '|' || airline || '|' || price || '|' || currency
  || '|' || coalesce(CAST(total_duration_minutes AS VARCHAR), '') || '|' || flight_type || '|' || stops)"""
ORACLE["record_id"] = sql(f"SELECT id, {_ID} AS record_id FROM opt")
ORACLE["dedup_response"] = sql(f"""
SELECT search_id, route, airline, {r('total_fare')} AS total_fare, record_id, id, extracted, duplicates FROM (
  SELECT search_id, route, airline, total_fare, airline || '/' || route AS record_id, id,
    row_number() OVER (PARTITION BY search_id, airline, route ORDER BY total_fare, id) AS rn FROM obs)
JOIN (SELECT search_id, count(*) AS extracted, count(*) - count(DISTINCT airline || '/' || route) AS duplicates
  FROM obs GROUP BY 1) USING (search_id) WHERE rn = 1""")
ORACLE["dedup_observations"] = sql(f"""
SELECT search_id, {stamp('collected_at')} AS collection_timestamp, origin, destination, airline, currency, stops, l_partkey,
  l_suppkey, price AS fare_text FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id, CAST(collected_at AS DATE), origin, destination, airline, currency,
    stops ORDER BY collected_at DESC, price DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM dirty) WHERE rn = 1""")


def _last(keys: str, name: str, tag: str) -> str:
    return f"""SELECT {name} AS record_id, {stamp('collection_timestamp')} AS collection_timestamp,
  {r('total_fare')} AS total_fare, l_partkey, l_suppkey, '{tag}' AS key FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
  ORDER BY collection_timestamp DESC, total_fare DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM obs) WHERE rn = 1"""


ORACLE["dedup_records"] = sql(
    _last("record_id", "record_id", "id") + " UNION ALL " + _last(
        "route, outbound_date, airline, floor(price / 10000)",
        "origin || '/' || destination || '/' || airline || '/' || CAST(floor(price / 10000) AS BIGINT)", "fallback"))
ORACLE["index_snapshot_hash"] = sql("""
SELECT route, outbound_date, sample_size, sha256('{"outbound_date":"' || outbound_date || '","route":"' || route
  || '","sample_size":' || sample_size || '}') AS snapshot_hash
FROM (SELECT route, outbound_date, count(*) AS sample_size FROM dense GROUP BY 1, 2)""")

ORACLE["join_search_metadata"] = sql(f"""
SELECT opt.id, search_id, CASE WHEN search.id IS NOT NULL THEN 'INR' END AS search_currency,
  {stamp('searched_at')} AS search_timestamp, request_id AS search_request_id
FROM opt LEFT JOIN search ON search_id = search.id""")
ORACLE["join_search_metadata_bucketed"] = ORACLE["join_search_metadata"]
ORACLE["semi_base_routes"] = sql(f"""
SELECT record_id, route, {r('total_fare')} AS total_fare FROM obs
WHERE route IN (SELECT route FROM obs WHERE outbound_date = (SELECT min(outbound_date) FROM obs))""")
ORACLE["semi_selected_routes"] = sql(f"""
SELECT record_id, route, {r('total_fare')} AS total_fare FROM obs WHERE origin = 'ASIA'""")
MASTER = """
master AS (SELECT CASE WHEN r_regionkey < 3 THEN r_name ELSE 'X' || r_name END AS code, min(n_name) AS city, max(n_name) AS name, CAST(min(n_regionkey) AS VARCHAR) AS state
  FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)"""
_NAMED = "coalesce(city, code) AS city, coalesce(name, code || ' Airport') AS name, coalesce(state, '—') AS state"
ORACLE["airport_lookup"] = sql(f"""
SELECT code, {_NAMED} FROM (SELECT DISTINCT origin AS code FROM obs) LEFT JOIN master USING (code)""", MASTER)
ORACLE["trend_activity"] = sql(f"""
SELECT date, {r('price_index')} AS price_index, coalesce(n, 0) AS activity FROM trend
LEFT JOIN (SELECT collection_date AS date, count(*) AS n FROM obs GROUP BY 1) USING (date)""", trend("obs"))

ORACLE["daily_fare"] = sql(period("dense", "outbound_date", AIRLINES, RANGE, change="fare_change_pct", vol="volatility_pct"))
ORACLE["daily_fare_sparse"] = sql(period("obs", "outbound_date", AIRLINES, RANGE, change="daily_fare_change_pct",
                                         vol="fare_volatility_pct"))
ORACLE["weekly_fare"] = sql(period("obs", "week_start", change="fare_change_pct", vol="volatility_pct"))
ORACLE["weekly_fare_detailed"] = sql(period("obs", "week_start", AIRLINES, change="weekly_fare_change_pct",
                                            vol="fare_volatility_pct"))
ORACLE["monthly_fare"] = sql(period("obs", "month", change="fare_change_pct", vol="volatility_pct"))
ORACLE["monthly_fare_detailed"] = sql(period("obs", "month", AIRLINES, change="monthly_fare_change_pct",
                                             vol="fare_volatility_pct"))
_RANK = "CAST(dense_rank() OVER (ORDER BY average_fare DESC) AS INTEGER) AS rank_by_average_fare"
ORACLE["route_analysis"] = sql(f"""
SELECT *, {_RANK} FROM ({grouped('obs', ROUTE, FIVE, STD, COUNT, AIRLINES, {'volatility_pct': VOL}, RANGE)})""")
ORACLE["route_analysis_detailed"] = sql(grouped("obs", ROUTE, FIVE, STD, COUNT, AIRLINES, MEANS, {"volatility_pct": VOL}))
ORACLE["airline_analysis"] = sql(grouped("obs", {**ROUTE, **AIRLINE}, FIVE, COUNT, MEANS))
_ROUTES = {"routes": "count(DISTINCT route)"}
ORACLE["airline_summary"] = sql(grouped("obs", AIRLINE, FIVE, COUNT, _ROUTES))
ORACLE["airline_summary_one_route"] = sql(grouped("obs", AIRLINE, FIVE, COUNT, _ROUTES, where="route = 'ASIA-EUROPE'"))
ORACLE["route_summary"] = sql(grouped("obs", ROUTE, FIVE, COUNT, AIRLINES))
ORACLE["route_summary_detailed"] = sql(grouped("obs", ROUTE, FIVE, STD, COUNT, AIRLINES, {"volatility_pct": VOL}, RANGE))
ORACLE["booking_window_by_route"] = sql(grouped("obs", {**ROUTE, **WINDOW}, FIVE, COUNT))
ORACLE["booking_window_by_route_preset"] = sql(
    grouped("obs", {**ROUTE, "booking_window_category": "booking_window"}, FIVE, COUNT))
ORACLE["booking_window_summary"] = sql(grouped("obs", WINDOW, FIVE, COUNT))
ORACLE["booking_premium"] = sql(f"""
SELECT {r('early')} AS early_fare, {r('late')} AS late_fare, {r('(late - early) / early * 100')} AS booking_premium_pct FROM (
  SELECT arg_max(fare, days) AS early, arg_min(fare, days) AS late FROM (
    SELECT booking_window, avg(total_fare) AS fare, min(advance_purchase_days) AS days FROM obs GROUP BY 1))""")
_DAY_TYPE = "CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END"
ORACLE["weekday_weekend"] = sql(f"""
SELECT *, {_DAY_TYPE} AS day_type FROM ({grouped('obs', {**ROUTE, 'is_weekend': 'is_weekend'},
    {k: FIVE[k] for k in ('average_fare', 'median_fare')}, COUNT)})""")
ORACLE["fare_distribution"] = sql("SELECT fare_bucket, count(*) AS observations FROM obs GROUP BY 1")
_LEFT = (("<=5K", 0, 5000), ("5K-7.5K", 5000, 7500), ("7.5K-10K", 7500, 10000), ("10K-15K", 10000, 15000),
         ("15K-25K", 15000, 25000), ("25K-50K", 25000, 50000), ("50K+", 50000, 1e300))
_BUCKETS = "b(fare_bucket, low, high) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {z}::DOUBLE)" for n, a, z in _LEFT) + ")"
ORACLE["fare_distribution_left"] = sql("""
SELECT b.fare_bucket, count(total_fare) AS observations FROM b
LEFT JOIN obs ON total_fare + 5000 >= low AND total_fare + 5000 < high GROUP BY 1""", _BUCKETS)
ORACLE["index_input"] = sql(f"""
SELECT outbound_date, route, average_fare AS current_average_fare, median_fare AS current_median_fare, minimum_fare,
  maximum_fare, fare_std, observations AS sample_size, airlines, fare_volatility_pct
FROM ({grouped('dense', {'outbound_date': 'outbound_date', 'route': 'route'}, FIVE, STD, COUNT, AIRLINES,
               {'fare_volatility_pct': VOL})})""")
_TWO = two
_COUNTS = """count(DISTINCT route) AS routes, count(DISTINCT airline) AS airlines, count(*) AS observations,
  count(DISTINCT outbound_date) AS travel_dates"""


def _summary(source: str, value: str, change: str) -> str:
    return f"""SELECT {_TWO(value)} AS price_index, {_TWO(change)} AS price_index_change,
  {_TWO('avg(total_fare)')} AS average_fare, {_TWO('min(total_fare)')} AS minimum_fare,
  {_TWO('max(total_fare)')} AS maximum_fare, {_COUNTS}, {stamp('max(collection_timestamp)')} AS updated_at FROM {source}"""


ORACLE["fare_summary"] = sql(
    _summary("obs", "(SELECT arg_max(fare, date) / arg_min(fare, date) * 100 FROM tday)",
             "(SELECT arg_max(c, date) FROM (SELECT date, (fare / lag(fare) OVER (ORDER BY date) - 1) * 100 AS c FROM tday))"),
    trend("obs"))
ORACLE["fare_summary_indexed"] = sql(
    _summary("dense", "(SELECT price_index FROM latest)", "(SELECT (price_index / previous - 1) * 100 FROM latest)"),
    index("dense"), LATEST)
ORACLE["national_snapshot"] = sql(f"""
SELECT (SELECT price_index FROM latest) AS price_index,
  {r('(SELECT (price_index / previous - 1) * 100 FROM latest)')} AS price_index_change_pct,
  {r('avg(total_fare)')} AS average_fare, {r('min(total_fare)')} AS minimum_fare, {r('max(total_fare)')} AS maximum_fare,
  {_COUNTS}, (SELECT arg_max(route, fare) FROM byr) AS highest_average_fare_route,
  (SELECT arg_min(route, fare) FROM byr) AS lowest_average_fare_route FROM dense""",
    index("dense"), LATEST, "byr AS (SELECT route, avg(total_fare) AS fare FROM dense GROUP BY 1)")
TYPED = """
typed AS (SELECT * REPLACE (TRY_CAST(price AS DOUBLE) AS price, TRY_CAST(outbound_date AS DATE) AS outbound_date),
  upper(origin) || '-' || destination AS route, TRY_CAST(price AS DOUBLE) AS total_fare FROM dirty)"""
ORACLE["quality_report"] = sql("""
SELECT count(*) AS rows, CAST(23 AS BIGINT) AS columns, count(*) - count(DISTINCT id) AS duplicate_record_ids,
  count(*) - count(total_fare) AS missing_total_fare, count(*) - count(airline) AS missing_airline,
  count(*) FILTER (total_fare < 0) AS negative_fares, count(DISTINCT route) AS unique_routes,
  count(DISTINCT airline) AS unique_airlines FROM typed""", TYPED)
ORACLE["quality_summary"] = sql("""
SELECT count(*) AS records, count(*) - count(DISTINCT id) AS duplicates, count(*) FILTER (total_fare > 90000) AS outliers,
  count(*) - count(total_fare) AS missing_fare, count(*) - count(airline) AS missing_airline,
  count(DISTINCT route) AS routes, count(DISTINCT airline) AS airlines,
  {0} AS completeness_pct FROM typed""".format(two("""(count(*) * 2 + count(airline) + count(outbound_date)
  + 2 * count(total_fare) + count(return_date)) / (7.0::DOUBLE * count(*)) * 100""")), TYPED)
ORACLE["quality_filtered"] = sql(f"""
SELECT count(*) AS records,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT route, airline, outbound_date, total_fare FROM typed
    WHERE upper(origin) = 'ASIA')) AS duplicates,
  count(*) FILTER (total_fare > 90000) AS outliers, count(*) - count(total_fare) AS missing_fare,
  {r("(count(*) * 2 + count(nullif(airline, '')) + count(outbound_date) + count(total_fare)) / (5.0::DOUBLE * count(*)) * 100")}
    AS completeness_pct FROM typed WHERE upper(origin) = 'ASIA'""", TYPED)


def _search_index(base: str) -> str:
    return f"""
SELECT route, outbound_date, {_TWO(f'avg(total_fare) / {base} * 100')} AS index_value, 100.0::DOUBLE AS base_index,
  {_TWO(base)} AS base_fare, {', '.join(f'{_TWO(e)} AS {k}' for k, e in FIVE.items())},
  count(total_fare) AS sample_size, 'INR' AS currency, 5 AS advance_purchase_days
FROM flat GROUP BY 1, 2"""


ORACLE["search_index"] = sql(_search_index("40000.0::DOUBLE"))
ORACLE["search_index_own_base"] = sql(_search_index("avg(total_fare)"))


def _manifest(date: str) -> str:
    return f"""
runs AS (SELECT route, {date} AS outbound_date, record_id, collection_date, total_fare FROM obs),
uniq AS (SELECT route, outbound_date, collection_date, record_id FROM runs GROUP BY ALL),
manifest AS (SELECT * FROM
  (SELECT route, outbound_date, count(*) AS extracted, count(*) - count(DISTINCT record_id) AS duplicates_in_response,
    avg(total_fare) AS fare FROM runs GROUP BY 1, 2)
  JOIN (SELECT route, outbound_date, count(*) FILTER (collection_date >= DATE '1995-01-01') AS new_records,
    count(*) FILTER (collection_date < DATE '1995-01-01') AS skipped_existing FROM uniq GROUP BY 1, 2)
  USING (route, outbound_date))"""


ORACLE["run_manifest"] = sql(f"""
SELECT route, outbound_date, extracted, duplicates_in_response, new_records, skipped_existing, {r('fare')} AS index_value,
  true AS index_generated FROM manifest""", _manifest("CAST(date_trunc('month', outbound_date) AS DATE)"))
_SUMS = ("extracted", "duplicates_in_response", "new_records", "skipped_existing")
ORACLE["run_totals"] = sql(
    "SELECT count(*) AS total_searches, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS total_{c}" for c in _SUMS)
    + " FROM manifest", _manifest("outbound_date"))
ORACLE["run_manifest_gaps"] = sql(f"""
SELECT a.route, a.outbound_date, extracted, duplicates_in_response, new_records, skipped_existing,
  CASE WHEN a.route IS NULL OR a.outbound_date > DATE '1994-06-01' THEN {r('fare')} END AS index_value,
  coalesce(a.route IS NULL OR a.outbound_date > DATE '1994-06-01', false) AS index_generated
FROM (SELECT route, outbound_date, count(*) AS extracted, count(*) - count(DISTINCT record_id) AS duplicates_in_response,
        avg(total_fare) AS fare FROM gaps GROUP BY 1, 2) a
JOIN (SELECT route, outbound_date, count(*) FILTER (NOT old) AS new_records, count(*) FILTER (old) AS skipped_existing
      FROM (SELECT DISTINCT route, outbound_date, collection_date, record_id,
              collection_date IS NULL OR collection_date < DATE '1995-01-01' AS old FROM gaps) GROUP BY 1, 2) b
  ON a.route IS NOT DISTINCT FROM b.route AND a.outbound_date IS NOT DISTINCT FROM b.outbound_date""", """
gaps AS (SELECT CASE WHEN l_partkey % 11 <> 0 THEN route END AS route, record_id, total_fare,
  CASE WHEN l_partkey % 13 <> 0 THEN collection_date END AS collection_date,
  CASE WHEN l_partkey % 7 <> 0 THEN CAST(date_trunc('year', outbound_date) AS DATE) END AS outbound_date FROM obs)""")
ENDS = """
byroute AS (SELECT route, avg(total_fare) AS fare FROM obs GROUP BY 1),
ends AS (SELECT split_part(route, '-', 1) AS code, 'o' AS role, * FROM byroute
  UNION ALL SELECT split_part(route, '-', 2), 'd', * FROM byroute)"""
ORACLE["airport_directory"] = sql(f"""
SELECT code, {_NAMED}, origin_routes, destination_routes, routes, {r('fare')} AS average_fare FROM (
  SELECT code, count(*) FILTER (role = 'o') AS origin_routes, count(*) FILTER (role = 'd') AS destination_routes,
    count(DISTINCT route) AS routes, avg(fare) AS fare FROM ends GROUP BY 1) LEFT JOIN master USING (code)""", ENDS, MASTER)
ORACLE["airport_totals"] = sql("""
SELECT count(DISTINCT code) AS airports, count(DISTINCT code) FILTER (role = 'o') AS origins,
  count(DISTINCT code) FILTER (role = 'd') AS destinations, count(DISTINCT route) AS routes FROM ends""", ENDS)

ORACLE["pct_change"] = sql(grouped("dense", {**ROUTE, "outbound_date": "outbound_date"},
                                   {"average_fare": "avg(total_fare)", "change_pct": CHANGE.format("outbound_date")}))
ORACLE["index_changes"] = sql(f"""
SELECT outbound_date, price_index, {r('price_index - lag(price_index) OVER (ORDER BY outbound_date)')} AS index_change,
  {r(changed('price_index', 'outbound_date'))} AS index_change_pct FROM di""", index("dense"))
ORACLE["dense_rank_fare"] = sql(f"""
SELECT airline, average_fare, {_RANK} FROM (
  SELECT airline, CAST(floor(avg(total_fare) / 100) AS BIGINT) AS average_fare FROM obs GROUP BY 1)""")
PER_ROUTE = """
per_route AS (SELECT route, avg(total_fare) AS route_average_fare, count(DISTINCT airline) AS carriers,
  count(*) AS route_observation_count FROM {0} GROUP BY 1)"""
ORACLE["market_features"] = sql(f"""
SELECT record_id, route, {r('total_fare')} AS total_fare, {r('route_average_fare')} AS route_average_fare,
  {r('(total_fare / route_average_fare - 1) * 100')} AS fare_vs_route_average_pct, carriers AS route_airline_count,
  route_observation_count FROM obs JOIN per_route USING (route)""", PER_ROUTE.format("obs"))


def _tailed(route: str) -> str:
    return f"""
tailed AS (SELECT record_id, CASE WHEN l_partkey % 31 <> 0 THEN route END AS route0, l_partkey,
    CASE WHEN l_partkey % 40 = 0 THEN price * 9 WHEN l_partkey % 43 <> 0 THEN price END AS total_fare FROM obs),
named AS (SELECT *, {route} AS route FROM tailed),
quart AS (SELECT route, quantile_cont(total_fare, 0.25) AS q1, quantile_cont(total_fare, 0.75) AS q3, count(*) AS n
  FROM named GROUP BY 1)"""


_OUT = "coalesce(total_fare < q1 - 1.5 * (q3 - q1) OR total_fare > q3 + 1.5 * (q3 - q1), false)"
ORACLE["outlier_route_iqr"] = sql(f"""
SELECT record_id, named.route, {r('total_fare')} AS total_fare, {_OUT} AS fare_outlier
FROM named JOIN quart ON named.route IS NOT DISTINCT FROM quart.route""", _tailed("route0"))
ORACLE["outlier_route_iqr_guarded"] = sql(f"""
SELECT record_id, named.route, {r('total_fare')} AS total_fare, {_OUT} AND n >= 4 AND q3 > q1 AS fare_outlier
FROM named JOIN quart ON named.route IS NOT DISTINCT FROM quart.route""",
    _tailed("concat_ws('/', route0, CAST(CAST(floor(l_partkey / 50) AS BIGINT) AS VARCHAR))"))
ORACLE["outlier_global_iqr"] = sql(f"""
SELECT record_id, {r('total_fare')} AS total_fare,
  coalesce(total_fare < greatest(0, q1 - 1.5 * (q3 - q1)) OR total_fare > q3 + 1.5 * (q3 - q1), false) AS fare_outlier
FROM tailed, (SELECT quantile_cont(total_fare, 0.25) AS q1, quantile_cont(total_fare, 0.75) AS q3 FROM tailed)""",
    _tailed("route0"))

ORACLE["normalize_weights"] = sql(f"""
SELECT route, {r('weight / sum(weight) OVER ()')} AS weight
FROM (SELECT route, CAST(sum(stops) + 1 AS DOUBLE) AS weight FROM obs GROUP BY 1)""")
ORACLE["base_fares"] = sql(f"SELECT route, {r('base_fare')} AS base_fare FROM base", index("obs"))
_RI = {c: r(c) for c in ("average_fare", "base_fare", "route_index", "route_weight", "weighted_contribution")}
ORACLE["index_route_daily"] = sql(
    "SELECT outbound_date, route, " + ", ".join(f"{e} AS {c}" for c, e in _RI.items()) + " FROM ri", index("dense"))
ORACLE["index_route_daily_sparse"] = sql(
    "SELECT outbound_date, route, observation_count, "
    + ", ".join(f"{r(c)} AS {c}" for c in (*_RI, "median_fare", "minimum_fare", "maximum_fare")) + " FROM ri", index("obs"))
_DI = f"""SELECT outbound_date, {r('weighted_index')} AS weighted_index, {r('available_weight')} AS available_weight,
  route_count, price_index, {r(changed('price_index', 'outbound_date'))} AS price_index_change_pct FROM """
ORACLE["index_daily"] = sql(_DI + "di", index("dense"))
ORACLE["index_daily_strict"] = sql(_DI + "strict", index("obs"), f"""
strict AS (SELECT outbound_date, coalesce(sum(weighted_contribution), 0) AS weighted_index,
    coalesce(sum(route_weight) FILTER (weighted_contribution IS NOT NULL), 0) AS available_weight, count(*) AS route_count,
    CASE WHEN sum(route_weight) FILTER (weighted_contribution IS NOT NULL) > 0 THEN
      {two('sum(weighted_contribution) / sum(route_weight) FILTER (weighted_contribution IS NOT NULL)')} END AS price_index FROM ri GROUP BY 1)""")
ORACLE["index_weekly"] = sql(f"""
SELECT week_start, {r('price_index')} AS price_index, observations,
  {r(changed('price_index', 'week_start'))} AS price_index_change_pct FROM wi""", index("obs"))
ORACLE["index_monthly"] = sql(f"SELECT month, {r('price_index')} AS price_index, observations FROM mi", index("obs"))


def section(name: str, source: str, label: str, observations: str, value: str, where: str = "", tail: str = "") -> str:
    return f"""SELECT '{name}' AS section, CAST({label} AS VARCHAR) AS label, {r(observations)} AS observations,
  {r(value)} AS value FROM {source} {where} {tail}"""


def sections(*parts: str) -> str:
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


_DATED = "outbound_date || '/' || route"
ORACLE["index_bundle"] = sql(sections(
    section("base_period", "dense", "min(outbound_date)", "1", "0"),
    section("daily_route", "ri", _DATED, "observation_count", "weighted_contribution"),
    section("daily", "di", "outbound_date", "total_observations",
            "price_index - lag(price_index) OVER (ORDER BY outbound_date)"),
    section("weekly", "wi", "week_start", "fares", two("price_index")),
    section("monthly", "mi", "month", "route_count", "average_fare"),
), index("dense"))


def _fare_section(name: str, source: str, keys: list[str], observations: str, value: str) -> str:
    label = " || '/' || ".join(f"({k})" for k in keys)
    return section(name, source, label, observations, value, tail="GROUP BY " + ", ".join(keys))


_WEEK, _MONTH = PERIODS["week_start"], PERIODS["month"]
ORACLE["all_aggregations"] = sql(sections(
    _fare_section("daily", "dense", ["outbound_date", "route"], "count(DISTINCT airline)", "median(total_fare)"),
    _fare_section("weekly", "dense", [_WEEK, "route"], "count(DISTINCT airline)", VOL),
    _fare_section("monthly", "dense", [_MONTH, "route"], "count(*)", CHANGE.format(_MONTH)),
    _fare_section("route", "dense", ["route"], "avg(stops)", "avg(duration_minutes)"),
    _fare_section("airline", "dense", ["route", "airline"], "avg(stops)", "median(total_fare)"),
    _fare_section("booking_window", "dense", ["route", "booking_window"], "count(*)", "median(total_fare)"),
    _fare_section("weekday_weekend", "dense", ["route", _DAY_TYPE], "count(*)", "median(total_fare)"),
    _fare_section("index_input", "dense", ["outbound_date", "route"], "count(*)", VOL),
))
_RESTRICTED = "known AS (SELECT * FROM obs WHERE route IN (SELECT route FROM obs WHERE outbound_date = (SELECT min(outbound_date) FROM obs)))"
ORACLE["backtest_series"] = sql(f"""
SELECT outbound_date, price_index, {r('available_weight')} AS total_route_weight, {r('average_fare')} AS average_fare,
  route_count, CAST(total_observations AS BIGINT) AS total_observations,
  {r('price_index - lag(price_index) OVER (ORDER BY outbound_date)')} AS index_change,
  {r(changed('price_index', 'outbound_date'))} AS index_change_pct FROM di""", _RESTRICTED, index("known"))
ORACLE["backtest_metrics"] = sql(f"""
SELECT {r('avg(abs(a - b))')} AS mae, {r('sqrt(avg((a - b) * (a - b)))')} AS rmse,
  {r('avg(abs((a - b) / b)) * 100')} AS mape, {r('corr(a, b)')} AS correlation,
  {two('avg(CAST(da = db AS DOUBLE)) * 100')} AS directional_accuracy_pct
FROM (SELECT *, sign(a - lag(a) OVER (ORDER BY date)) AS da, sign(b - lag(b) OVER (ORDER BY date)) AS db
  FROM (SELECT date, di.price_index AS a, trend.price_index AS b FROM di JOIN trend ON outbound_date = date
    WHERE di.price_index IS NOT NULL))""", index("dense"), trend("dense"))
ORACLE["trend_simple"] = sql("SELECT date, price_index FROM trend", trend("obs"))
ORACLE["trend_rollup"] = sql(f"""
SELECT CAST(date_trunc('week', date) AS DATE) AS date, {two('avg(price_index)')} AS price_index, 'week' AS mode
FROM trend GROUP BY 1 UNION ALL
SELECT CAST(date_trunc('month', date) AS DATE), {two('avg(price_index)')}, 'month' FROM trend GROUP BY 1""",
    trend("obs"))
ORACLE["index_latest"] = sql(f"""
SELECT price_index, previous, {r('(price_index / previous - 1) * 100')} AS change_pct,
  (SELECT min(price_index) FROM di) AS minimum, (SELECT max(price_index) FROM di) AS maximum FROM latest""",
    index("dense"), LATEST)
ORACLE["market_signal"] = sql(f"""
SELECT date, price_index, {r('c')} AS change_pct,
  CASE WHEN price_index >= 110 THEN 'ELEVATED' WHEN c > 2 THEN 'RISING' WHEN price_index < 95 THEN 'BELOW BASE'
    ELSE 'STABLE' END AS signal,
  CASE WHEN c > 0.25 THEN 'RISING' WHEN c < -0.25 THEN 'EASING' ELSE 'STABLE' END AS direction,
  {r('greatest(5, least(100, (price_index - 85) / 40 * 100))')} AS meter_pct
FROM (SELECT *, coalesce({changed('price_index', 'date')}, 0) AS c FROM trend)""", trend("dense"))
ORACLE["route_status"] = sql(f"""
SELECT route, outbound_date, {r('fare')} AS average_fare, {r('vol')} AS volatility_pct,
  CASE WHEN vol >= 15 THEN 'HIGH VOLATILITY' WHEN fare >= 10000 THEN 'HIGH FARE' ELSE 'NORMAL' END AS status
FROM (SELECT route, outbound_date, avg(total_fare) AS fare, {VOL} AS vol FROM dense GROUP BY 1, 2)""")

_LISTED = f"""record_id, route, airline, outbound_date, {r('total_fare')} AS total_fare,
  {stamp('collection_timestamp')} AS collection_timestamp"""
_NEWEST = "collection_timestamp DESC, record_id, route, airline, outbound_date, total_fare"
ORACLE["flights_query"] = sql(f"""
SELECT {_LISTED} FROM (SELECT * FROM obs WHERE route = 'ASIA-EUROPE' AND airline = 'Brand#12'
  ORDER BY {_NEWEST} LIMIT 1000)""")
ORACLE["recent_flights"] = sql(f"SELECT {_LISTED} FROM (SELECT * FROM obs ORDER BY {_NEWEST} LIMIT 15)")
ORACLE["filter_values"] = sql("""
SELECT DISTINCT 'route' AS dimension, route AS value FROM obs UNION ALL
SELECT DISTINCT 'airline', airline FROM obs UNION ALL
SELECT DISTINCT 'travel_date', CAST(outbound_date AS VARCHAR) FROM obs UNION ALL
SELECT DISTINCT 'origin', origin FROM obs UNION ALL
SELECT DISTINCT 'destination', destination FROM obs WHERE origin = 'ASIA'""")
_MATCH = "origin = 'ASIA' AND booking_window = '15-30 days' AND airline = 'Brand#12'"
ORACLE["filter_observations"] = sql(f"SELECT {_LISTED} FROM obs WHERE {_MATCH}")
ORACLE["filter_observations_laid_out"] = sql(f"""
SELECT 'day' AS asked, {_LISTED} FROM obs WHERE outbound_date = DATE '1995-03-14'
UNION ALL SELECT 'lead', {_LISTED} FROM obs WHERE booking_window = '15-30 days' AND airline = 'Brand#12'""")
ORACLE["flights_query_laid_out"] = sql(f"""
SELECT {_LISTED} FROM (SELECT * FROM obs WHERE route = 'ASIA-EUROPE'
  AND outbound_date BETWEEN DATE '1995-02-10' AND DATE '1995-03-20' ORDER BY {_NEWEST} LIMIT 40)""")
_KEYED = "routes || '/' || airlines || '/' || travel_dates"
_DISPLAY = ("<= ₹5K", "₹5K–7.5K", "₹7.5K–10K", "₹10K–15K", "₹15K–25K", "₹25K–50K", "₹50K+")
_SHOWN = "shown(fare_bucket, display) AS (VALUES " + ", ".join(
    f"('{b[0]}', '{t}')" for b, t in zip(_LEFT, _DISPLAY)) + ")"


def _panels(rows: str, scoped: str, carriers: str) -> tuple[str, ...]:
    return (
        section("summary", f"(SELECT {_COUNTS}, avg(total_fare) AS fare FROM {rows})", _KEYED, "observations",
                two("fare")),
        _fare_section("routes", scoped, ["route"], "count(*)", VOL),
        _fare_section("airlines", carriers, ["airline"], "count(*)", "median(total_fare)"),
        _fare_section("booking_window", scoped, ["booking_window"], "count(*)", "median(total_fare)"),
        section("recent_flights", f"(SELECT * FROM {rows} ORDER BY {_NEWEST} LIMIT 15)", "record_id", "1", "total_fare"),
    )


ORACLE["filtered_dashboard"] = sql(sections(
    *_panels("picked", "asia", "carrier"),
    section("trend", "trend", "date", "0", "price_index"),
    section("distribution", "b LEFT JOIN picked ON total_fare >= low AND total_fare < high JOIN shown ON "
            "b.fare_bucket = shown.fare_bucket", "display", "count(total_fare)", "0", tail="GROUP BY display"),
    section("quality", "picked", "(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT route, airline, outbound_date, "
            "total_fare FROM picked)) FROM picked) || '/' || 0", "count(*)", "100"),
), _BUCKETS, _SHOWN, f"picked AS (SELECT * FROM obs WHERE {_MATCH})", "asia AS (SELECT * FROM obs WHERE origin = 'ASIA')",
    "carrier AS (SELECT * FROM asia WHERE airline = 'Brand#12')", trend("picked", "collection_date"))
ORACLE["dashboard_bundle"] = sql(sections(
    *_panels("obs", "obs", "obs"),
    section("trend", "di", "outbound_date", "0", "price_index"),
    section("distribution", "obs JOIN shown USING (fare_bucket)", "display", "count(*)", "0", tail="GROUP BY display"),
    section("quality", "obs", "(count(*) - count(DISTINCT record_id)) || '/' || 0", "count(*)", "100"),
), _SHOWN, index("dense"))
ORACLE["text_search"] = sql("""
SELECT record_id, route, airline FROM obs WHERE lower(route || ' ' || airline) LIKE '%rope brand#1%'""")
ORACLE["paginate"] = sql(f"""
SELECT {_LISTED}, CAST(position AS BIGINT) AS position, 3 AS asked FROM placed WHERE position > 30 AND position <= 45
UNION ALL
SELECT {_LISTED}, CAST(position AS BIGINT), 1000000000 FROM placed
WHERE position > (SELECT (ceil(count(*) / 12.0) - 1) * 12 FROM obs)""",
    f"placed AS (SELECT *, row_number() OVER (ORDER BY {_NEWEST}) AS position FROM obs)")
_BY = "byroute AS (SELECT route, avg(total_fare) AS fare FROM obs GROUP BY 1)"
ORACLE["top_routes"] = sql(f"""
SELECT route, {r('fare')} AS average_fare, {r('fare / (SELECT max(fare) FROM byroute) * 100')} AS share_of_max_pct,
  (SELECT arg_max(route, fare) FROM byroute) AS highest_route, (SELECT arg_min(route, fare) FROM byroute) AS lowest_route
FROM byroute ORDER BY fare DESC, route LIMIT 3""", _BY)
ORACLE["top_airlines"] = sql(f"""
SELECT airline, observations, {r('observations / (SELECT max(observations) FROM c) * 100')} AS share_of_max_pct
FROM c ORDER BY observations DESC, airline LIMIT 8""",
    "c AS (SELECT airline, count(*) AS observations FROM obs GROUP BY 1)")
ORACLE["connected_airports"] = sql("""
SELECT r_name AS code, r_name IN (SELECT origin FROM p UNION SELECT destination FROM p) AS connected FROM region""",
    "p AS (SELECT * FROM obs WHERE origin = 'ASIA' AND airline = 'Brand#12')")
ORACLE["status_summary"] = sql("""
SELECT count(*) AS records, 'healthy' AS status FROM obs UNION ALL SELECT 0, 'no-data'""")

ORACLE["clean_dataset"] = sql(f"""
SELECT record_id, {stamp('collected_at')} AS collection_timestamp, route, airline, outbound_date,
  {r('total_fare')} AS total_fare, {r('coalesce(dur, (SELECT median(dur) FROM kept))')} AS duration_minutes,
  CAST(stops AS INTEGER) AS stops, currency,
  total_fare < greatest(0, q1 - 1.5 * (q3 - q1)) OR total_fare > q3 + 1.5 * (q3 - q1) AS fare_outlier
FROM kept, (SELECT quantile_cont(total_fare, 0.25) AS q1, quantile_cont(total_fare, 0.75) AS q3 FROM kept)""", """
ready AS (SELECT CAST(id AS VARCHAR) AS record_id, collected_at, l_partkey, l_suppkey, upper(origin) AS dep, destination AS arr,
    upper(origin) || '-' || destination AS route, TRY_CAST(outbound_date AS DATE) AS outbound_date,
    coalesce(nullif(trim(regexp_replace(airline, '\\s+', ' ', 'g')), ''), 'UNKNOWN') AS airline,
    total_duration_minutes AS dur, CAST(stops AS DOUBLE) AS stops,
    CASE WHEN TRY_CAST(price AS DOUBLE) > 0 THEN TRY_CAST(price AS DOUBLE) END AS total_fare, currency,
    CAST(CAST(collected_at AS DATE) - DATE '1990-01-01' AS DOUBLE) AS lead FROM dirty),
kept AS (SELECT * REPLACE (CASE WHEN currency = '' THEN 'INR' ELSE currency END AS currency) FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY collected_at DESC, dep DESC, arr DESC,
      outbound_date DESC NULLS LAST, airline DESC, dur DESC, stops DESC, total_fare DESC NULLS LAST, currency DESC,
      lead DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM ready)
  WHERE rn = 1 AND outbound_date IS NOT NULL AND total_fare IS NOT NULL)""")
ORACLE["preprocess_dataset"] = sql(f"""
SELECT record_id, route, airline, outbound_date, {stamp('collection_timestamp')} AS collection_timestamp,
  {r('total_fare')} AS total_fare, CAST(advance_purchase_days AS INTEGER) AS advance_purchase_days, {_time('month_name', False)},
  booking_window AS booking_window_category, CASE {_B7} ELSE '15000+' END AS fare_band, {r('ln(1 + total_fare)')} AS log_fare,
  {r('route_average_fare')} AS route_average_fare, carriers AS airline_competition_count, route_observation_count,
  {r('(total_fare / route_average_fare - 1) * 100')} AS fare_vs_route_average_pct
FROM obs JOIN per_route USING (route)""", PER_ROUTE.format("obs"))
ORACLE["build_dataset"] = sql(f"""
SELECT {_ID} AS record_id, search_id, named.route, outbound_date, return_date, {stamp('collected_at')} AS collection_timestamp,
  CAST(greatest(outbound_date - CAST(collected_at AS DATE), 0) AS INTEGER) AS advance_purchase_days,
  {_lead('greatest(outbound_date - CAST(collected_at AS DATE), 0)', None, None)} AS booking_window_category, airline,
  {r('total_fare')} AS total_fare, stops, isodow(outbound_date) >= 6 AS is_weekend,
  CASE {_B7} WHEN total_fare <= 25000 THEN '15001-25000' ELSE '25000+' END AS fare_band,
  {r('ln(1 + total_fare)')} AS log_fare, {_OUT} AS fare_outlier, {r('route_average_fare')} AS route_average_fare,
  {r('(total_fare / route_average_fare - 1) * 100')} AS fare_vs_route_average_pct, carriers AS route_airline_count,
  route_observation_count, search_currency, 'provider' AS source, CAST(NULL AS DOUBLE) AS base_fare
FROM named JOIN quart USING (route) JOIN per_route USING (route)
  LEFT JOIN (SELECT id AS search_id, 'INR' AS search_currency FROM search WHERE origin <> destination AND id % 59 <> 0)
  USING (search_id)""", """
named AS (SELECT DISTINCT search_id, collected_at, upper(origin) AS origin, destination,
    upper(origin) || '-' || destination AS route, CAST(outbound_date AS DATE) AS outbound_date, return_date,
    trim(regexp_replace(airline, '\\s+', ' ', 'g')) AS airline, CAST(price AS DOUBLE) AS price,
    CAST(price AS DOUBLE) AS total_fare, coalesce(nullif(currency, ''), '') AS currency,
    CASE WHEN total_duration_minutes > 0 THEN total_duration_minutes END AS total_duration_minutes, flight_type,
    greatest(stops, 0) AS stops FROM dirty
  WHERE l_partkey % 59 <> 0 AND l_partkey % 53 <> 0 AND l_partkey % 50 <> 0 AND airline <> ''),
quart AS (SELECT route, quantile_cont(total_fare, 0.25) AS q1, quantile_cont(total_fare, 0.75) AS q3
  FROM named GROUP BY 1)""", PER_ROUTE.format("named"))
ORACLE["run_analytics"] = sql(sections(
    _fare_section("daily_fare", "dense", ["outbound_date", "route"], "count(*)", "median(total_fare)"),
    _fare_section("weekly_fare", "dense", [_WEEK, "route"], "count(*)", VOL),
    _fare_section("monthly_fare", "dense", [_MONTH, "route"], "count(*)", CHANGE.format(_MONTH)),
    section("route_analysis", "(SELECT route, avg(total_fare) AS average_fare, median(total_fare) AS m FROM dense GROUP BY 1)",
            "route", "dense_rank() OVER (ORDER BY average_fare DESC)", "m"),
    _fare_section("fare_distribution", "dense", ["fare_bucket"], "count(*)", "0"),
    _fare_section("airline_analysis", "dense", ["route", "airline"], "count(*)", "median(total_fare)"),
    _fare_section("booking_window_analysis", "dense", ["route", "booking_window"], "count(*)", "median(total_fare)"),
    _fare_section("weekday_weekend_analysis", "dense", ["route", _DAY_TYPE], "count(*)", "median(total_fare)"),
    section("index_route_daily", "ri", _DATED, "0", "weighted_contribution"),
    section("index_daily", "di", "outbound_date", "route_count", "price_index"),
    section("index_weekly", "wi", "week_start", "observations", "price_index"),
    section("index_monthly", "mi", "month", "observations", "price_index"),
    section("national_snapshot", "(SELECT count(*) AS n FROM dense), (SELECT arg_max(route, fare) AS hi, "
            "arg_min(route, fare) AS lo FROM (SELECT route, avg(total_fare) AS fare FROM dense GROUP BY 1)), latest",
            "hi || '/' || lo", "n", "price_index"),
), index("dense"), LATEST)
ORACLE["ingest_stream"] = sql(f"""
SELECT route, CAST(month(collection_date) AS INTEGER) AS month, count(*) AS stored, {r('sum(total_fare)')} AS total_fare
FROM (SELECT DISTINCT route, collection_date, outbound_date, airline, flight_numbers, duration_minutes, total_fare FROM flat)
GROUP BY 1, 2""")
_STORED = """
stored AS (SELECT DISTINCT route, collection_date, outbound_date, airline, flight_numbers, duration_minutes, total_fare FROM flat)"""
ORACLE["ingest_results"] = sql(sections(
    _fare_section("daily_fare", "stored", ["outbound_date", "route"], "count(DISTINCT airline)", "median(total_fare)"),
    _fare_section("monthly_fare", "stored", [_MONTH, "route"], "count(*)", CHANGE.format(_MONTH)),
    section("index_route_daily", "ri", _DATED, "0", "weighted_contribution"),
    section("index_daily", "di", "outbound_date", "route_count", "price_index"),
), _STORED, index("stored"))
ORACLE["ingest_stream_rejects"] = sql(f"""
SELECT 'run ' || run AS run_id, count(*) AS total_searches, CAST(sum(extracted) AS BIGINT) AS total_extracted,
  CAST(sum(repeats) AS BIGINT) AS total_duplicates_in_response, CAST(sum(CASE WHEN run = 0 THEN fresh ELSE 0 END) AS BIGINT) AS total_new_records,
  CAST(sum(CASE WHEN run = 0 THEN known - fresh ELSE known END) AS BIGINT) AS total_skipped_existing,
  CASE WHEN run = 0 THEN (SELECT count(DISTINCT search_id // 1000) FROM flat WHERE search_id // 1000 % 5 = 2) ELSE 0 END AS rejected_files
FROM (SELECT search_id, sum(n) AS extracted, sum(n) - count(*) AS repeats, count(*) FILTER (nth = 1) AS fresh, count(*) AS known
      FROM (SELECT *, row_number() OVER (PARTITION BY route, collection_date, outbound_date, airline, flight_numbers,
              duration_minutes, total_fare ORDER BY search_id) AS nth
            FROM (SELECT search_id, route, collection_date, outbound_date, airline, flight_numbers, duration_minutes, total_fare,
                    count(*) AS n FROM flat WHERE search_id // 1000 % 5 <> 2 GROUP BY ALL)) GROUP BY 1), range(2) AS t(run)
GROUP BY run""")
ORACLE["sink_published"] = sql(f"""
SELECT 'after' AS seen, * FROM ({grouped('dense', ROUTE, {k: FIVE[k] for k in ('average_fare', 'median_fare')}, COUNT)})
UNION ALL SELECT 'between', * FROM ({grouped('dense', ROUTE, {k: FIVE[k] for k in ('average_fare', 'median_fare')}, COUNT, where="route = 'ASIA-EUROPE'")})""")
ORACLE["sink_index_snapshot"] = sql("""
SELECT route, CAST(sum(n) AS BIGINT) AS stored, CAST(sum(n) AS BIGINT) AS hashes FROM (
  SELECT route, CASE WHEN route = 'ASIA-EUROPE' THEN 1 ELSE 2 END AS n FROM flat GROUP BY route, outbound_date) GROUP BY 1""")

ORACLE["ingest_stream_index"] = sql(f"""
SELECT DISTINCT * FROM (
  SELECT 'XXX-YYY' AS route, outbound_date, collection_date, {_TWO('avg(total_fare) / 40000.0 * 100')} AS index_value,
    40000.0::DOUBLE AS base_fare, {', '.join(f'{_TWO(e)} AS {k}' for k, e in FIVE.items())}, count(total_fare) AS sample_size,
    'INR' AS currency, 5 AS advance_purchase_days
  FROM flat GROUP BY search_id, outbound_date, collection_date)""")
ORACLE["ingest_stream_runs"] = sql(f"""
SELECT 'gate' AS run_id, search_id, 'XXX-YYY' AS route, outbound_date, collection_date, CAST(sum(n) AS BIGINT) AS extracted,
  CAST(sum(n) - count(*) AS BIGINT) AS duplicates_in_response, count(*) FILTER (nth = 1) AS new_records,
  count(*) FILTER (nth > 1) AS skipped_existing, {_TWO('sum(fares) / sum(n) / 40000.0 * 100')} AS index_value,
  true AS index_generated, true AS raw_response_uploaded
FROM (SELECT *, row_number() OVER (PARTITION BY route, collection_date, outbound_date, airline, flight_numbers,
        duration_minutes, total_fare ORDER BY search_id) AS nth
      FROM (SELECT search_id, route, collection_date, outbound_date, airline, flight_numbers, duration_minutes, total_fare,
              count(*) AS n, sum(total_fare) AS fares FROM flat GROUP BY ALL))
GROUP BY search_id, outbound_date, collection_date""")
ORACLE["sink_append_undated"] = sql(f"""
SELECT route, CAST(year(collection_date) AS INTEGER) AS year, count(*) AS stored, {r('sum(total_fare)')} AS total_fare
FROM (SELECT CASE WHEN month(collection_date) > 3 THEN collection_date END AS collection_date, route, outbound_date, record_id,
        min(total_fare) AS total_fare FROM obs GROUP BY ALL)
GROUP BY 1, 2""")
UNSOUND = """
unsound AS (SELECT * REPLACE (CASE WHEN l_partkey % 17 = 0 OR l_partkey % 19 = 0 OR l_partkey % 23 = 0 THEN NULL
  ELSE total_fare END AS total_fare) FROM obs)"""
ORACLE["unsound_fares"] = sql(grouped("unsound", ROUTE, FIVE, COUNT), UNSOUND)
ORACLE["unsound_quartiles"] = sql(f"""
SELECT route, {', '.join(f"{r(f'quantile_cont(total_fare, {p})')} AS q{k}" for k, p in ((1, 0.25), (2, 0.5), (3, 0.75)))}
FROM unsound WHERE total_fare IS NOT NULL GROUP BY 1""", UNSOUND)

"""SQL for scans, sinks and decoding."""

from oracles.base import closest, cte, hav, query, r
from oracles.phase import PHASE

ORACLE: dict[str, str] = {}
O = ORACLE

VEL_TEXT = "CASE WHEN (k + i) % 50 = 0 THEN NULL ELSE velocity END"
O["scan_states_csv"] = query(f"SELECT icao24, time, {r('lat')} AS lat, {r('lon')} AS lon, {r(VEL_TEXT)} AS velocity, {r('baroaltitude')} AS baroaltitude, "
                             "onground, CAST(squawk AS INTEGER) AS squawk, lastcontact FROM obs", "obs")
O["scan_parquet_cohort"] = query(f"SELECT flight_id, time, {r('lat')} AS lat, {r('lon')} AS lon, {r('baroaltitude')} AS baroaltitude FROM obs", "obs")
O["scan_validated_input"] = query(f"SELECT icao24, time, {r('lat')} AS lat, {r('lon')} AS lon, {r('heading')} AS heading, onground, squawk, 15 AS n_columns FROM obs", "obs")

DIG = "regexp_matches({0}, '^[0-9]+$')"


def f(text: str, i: int) -> str:
    return f"split_part({text}, ',', {i + 1})"


def good(x: str) -> str:
    return f"trim({x}) NOT IN ('2', '3', '6', '7')"


WDIR = f"CASE WHEN {DIG.format(f('WND', 0))} AND {f('WND', 0)} <> '999' AND CAST({f('WND', 0)} AS BIGINT) <= 360 AND {good(f('WND', 1))} THEN CAST(CAST({f('WND', 0)} AS BIGINT) % 360 AS DOUBLE) END"
WSPD = f"CASE WHEN {DIG.format(f('WND', 3))} AND {f('WND', 3)} <> '9999' AND {good(f('WND', 4))} THEN CAST({f('WND', 3)} AS BIGINT) / 1e1 END"
MA1 = f"CASE WHEN {DIG.format(f('MA1', 0))} AND {f('MA1', 0)} <> '99999' AND {good(f('MA1', 1))} AND CAST({f('MA1', 0)} AS BIGINT) / 1e1 BETWEEN 850 AND 1100 THEN CAST({f('MA1', 0)} AS BIGINT) / 1e1 END"
MET = "CASE WHEN try_cast(regexp_extract(REM, '(^|\\s)Q(\\d{4})(\\s|=|$)', 2) AS DOUBLE) BETWEEN 850 AND 1100 THEN try_cast(regexp_extract(REM, '(^|\\s)Q(\\d{4})(\\s|=|$)', 2) AS DOUBLE) END"


def tenths(c: str) -> str:
    return f"CASE WHEN {f(c, 0)} <> '' AND ltrim({f(c, 0)}, '+-') <> '9999' AND {good(f(c, 1))} THEN CAST({f(c, 0)} AS INTEGER) / 1e1 END"


cte("wxd", "wxt", f"""
SELECT *, concat_ws(',', CASE WHEN wdir IS NULL THEN 'wind_direction_missing_or_variable' END, CASE WHEN wspd IS NULL THEN 'wind_speed_missing' END,
  CASE WHEN ma1v IS NULL THEN 'ma1_qnh_missing' END,
  CASE WHEN ma1v IS NOT NULL AND metv IS NULL THEN 'raw_metar_qnh_cross_check_unavailable' WHEN abs(ma1v - metv) > 0.6e0 THEN 'ma1_raw_metar_qnh_mismatch' END,
  CASE WHEN tmpv IS NULL THEN 'temperature_missing' END, CASE WHEN dewv IS NULL THEN 'dew_point_missing' END) AS missing_reasons,
  CASE WHEN coalesce(abs(ma1v - metv) > 0.6e0, FALSE) THEN NULL ELSE ma1v END AS qnh, abs(ma1v - metv) <= 0.6e0 AS qnh_matches
FROM (SELECT *, {WDIR} AS wdir, {WSPD} AS wspd, {MA1} AS ma1v, {MET} AS metv, {tenths('TMP')} AS tmpv, {tenths('DEW')} AS dewv FROM wxt)""")
cte("wx1", "wxd", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY observed_at ORDER BY CASE WHEN REPORT_TYPE = 'FM-15' THEN 0 ELSE 1 END) AS rn FROM wxd) WHERE rn = 1")
O["scan_weather_csv"] = query(f"SELECT observed_at, REPORT_TYPE AS report_type, {r('wdir')} AS wind_from_deg, {r('wspd')} AS wind_speed, {r('qnh')} AS qnh_hpa, "
                              f"{r('tmpv')} AS temperature_c, {r('dewv')} AS dew_point_c, missing_reasons FROM wx1", "wx1")
O["decode_wind"] = query(f"SELECT observed_at, REPORT_TYPE, {r('wdir')} AS wind_from_deg, {r('wspd')} AS wind_speed FROM wxd", "wxd")
O["decode_pressure"] = query(f"SELECT observed_at, REPORT_TYPE, {r('ma1v')} AS ma1_hpa, {r('metv')} AS metar_hpa FROM wxd", "wxd")
O["decode_temperature"] = query(f"SELECT observed_at, REPORT_TYPE, {r('tmpv')} AS temperature_c, {r('dewv')} AS dew_point_c FROM wxd", "wxd")
O["weather_quality_flags"] = query(f"SELECT observed_at, REPORT_TYPE, {r('qnh')} AS qnh_hpa, qnh_matches, missing_reasons FROM wxd", "wxd")
O["prefer_report_type"] = query("SELECT observed_at, REPORT_TYPE, WND FROM wx1", "wx1")
O["scan_aircraft_registry"] = query("SELECT icao24, typecode, manufacturername FROM reg", "reg")

cte("flist", "obs", """SELECT icao24, k, min(callsign) AS callsign, min(time) AS firstseen, max(time) AS lastseen,
  CASE WHEN k % 3 = 0 THEN 'LEMD' ELSE 'LEBL' END AS arr, CASE WHEN k % 3 = 1 THEN 'LEMD' ELSE 'LEVC' END AS dep FROM obs GROUP BY flight_id, icao24, k""")
OPER = "CASE WHEN arr = 'LEMD' THEN 'arrival' WHEN dep = 'LEMD' THEN 'departure' ELSE 'unknown' END"
O["source_flights_sql"] = query(f"SELECT icao24, callsign, firstseen, lastseen, {OPER} AS operation FROM flist WHERE (arr = 'LEMD' OR dep = 'LEMD') "
                                "AND firstseen >= 1496620800 AND lastseen <= 1596620800", "flist")
O["source_track_sql"] = query(f"SELECT time, icao24, {r('lat')} AS lat, {r('lon')} AS lon, {r('velocity')} AS velocity, lastcontact FROM obs "
                              "WHERE icao24 = 'a00007' AND time BETWEEN 1496620800 AND 1600000000 AND time - lastcontact <= 15", "obs")
O["build_master_table"] = query(f"""SELECT flight_id, time, operation, {r('velocity * 3.6e0')} AS velocity_kmh, {r('dist_to_runway_m')} AS dist_to_runway_m, {PHASE} AS flight_phase, callsign
FROM (SELECT o.*, f.callsign, {OPER} AS operation, {closest()} AS dist_to_runway_m FROM (SELECT * EXCLUDE (callsign) FROM obs) o JOIN flist f ON o.icao24 = f.icao24 AND o.time BETWEEN f.firstseen AND f.lastseen
WHERE (arr = 'LEMD' OR dep = 'LEMD') AND o.time - o.lastcontact <= 15) WHERE dist_to_runway_m <= 200000""", "flist")
O["flight_track_range"] = query("SELECT f.icao24, f.firstseen, count(*) AS n_rows FROM flist f JOIN obs o ON o.icao24 = f.icao24 AND o.time BETWEEN f.firstseen AND f.lastseen GROUP BY 1, 2", "flist")
O["flights_dedupe_slices"] = query("SELECT icao24, firstseen, callsign, lastseen FROM flist", "flist")
O["scan_by_day_ranges"] = query("SELECT time // 86400 * 86400 AS range_start, count(*) AS n_rows FROM obs GROUP BY 1", "obs")
MON = "CAST(date_trunc('week', make_timestamp(CAST(time * 1000000 AS BIGINT))) AS DATE)"
WEEK = f"strftime({MON}, '%Y%m%d')"
O["choose_canonical_batches"] = query(f"""SELECT concat('lemd_', w) AS batch, kind, concat('/data/lemd_', w, '__', kind, '_20260101.parquet') AS path FROM (
SELECT w, CASE WHEN substring(w, 8, 1) IN ('0', '2', '4', '6', '8') THEN 'deduped' ELSE 'snapshot' END AS kind FROM (SELECT DISTINCT {WEEK} AS w FROM obs))""", "obs")
O["sink_partitioned_parquet"] = query(f"SELECT CAST({MON} AS VARCHAR) AS monday, count(*) AS n_rows, min(time) AS first_time FROM obs GROUP BY 1", "obs")
O["sink_snapshot_parquet"] = query(f"SELECT flight_id, time, {r('vertrate')} AS vertrate FROM obs", "obs")
O["sink_keyed_upsert"] = query(f"SELECT icao24, time, {r('CASE WHEN vertrate < -10 AND velocity IS NOT NULL THEN velocity + 1 ELSE velocity END')} AS velocity, "
                               "CASE WHEN vertrate < -10 AND velocity IS NOT NULL THEN 2 ELSE 1 END AS version FROM obs", "obs")
O["pick_evenly_spaced_dates"] = query(f"""SELECT CAST(monday AS VARCHAR) AS monday FROM (SELECT monday, row_number() OVER (ORDER BY monday) - 1 AS rn, count(*) OVER () AS m FROM (
SELECT DISTINCT {MON} AS monday FROM obs WHERE {MON} NOT BETWEEN DATE '2020-03-15' AND DATE '2022-01-01'))
WHERE m <= 18 OR rn IN (SELECT j * (mm - 1) // 17 FROM (SELECT unnest(range(0, 18)) AS j), (SELECT count(DISTINCT {MON}) AS mm FROM obs WHERE {MON} NOT BETWEEN DATE '2020-03-15' AND DATE '2022-01-01'))""", "obs")
O["scan_external_units"] = query(f"SELECT icao24, time, {r('lat')} AS lat, {r('lon')} AS lon, {r('baroaltitude')} AS baroaltitude, {r('velocity')} AS velocity, {r('vertrate')} AS vertrate, "
                                 "FALSE AS onground FROM obs WHERE i % 9 <> 4", "obs")
O["normalize_column_aliases"] = query(f"SELECT icao24, time, {r('baroaltitude')} AS baroaltitude, {r('heading')} AS heading, {r('vertrate')} AS vertrate, onground FROM obs", "obs")
O["union_batches"] = query("SELECT CASE WHEN time < 1530000000 THEN 'early' ELSE 'late' END AS batch, count(*) AS n_rows, count(CASE WHEN time >= 1530000000 THEN lon END) AS with_lon FROM obs GROUP BY 1", "obs")

# uploads
cte("up", "raw", """SELECT k, i, flight_id, time, strftime(make_timestamp(CAST(time * 1000000 AS BIGINT)), '%Y%m') AS month, CASE WHEN (k + i) % 61 = 0 THEN time + 0.5e0 ELSE CAST(time AS DOUBLE) END AS tnum,
  CASE WHEN (k + i) % 67 = 0 THEN NULL ELSE icao24 END AS icao24, CASE WHEN (k + i) % 71 = 0 THEN 95.5e0 ELSE lat END AS lat, lon, baroaltitude,
  CASE WHEN (k + i) % 73 = 0 THEN NULL ELSE velocity END AS velocity, heading, vertrate, CASE WHEN i % 5 <= 1 THEN FALSE ELSE onground END AS og,
  CASE WHEN i % 7 = 0 THEN 0e0 ELSE CAST(i AS DOUBLE) END AS wdir, CASE WHEN i % 13 = 0 THEN 1200e0 ELSE 1013.26e0 END AS qnh,
  CASE WHEN k % 5 = 0 THEN 'A320' END AS tc FROM raw""")
ERR = """concat_ws(',', CASE WHEN (k + i) % 61 = 0 THEN 'time:range' END, CASE WHEN icao24 IS NULL THEN 'icao24:required' END,
  CASE WHEN (k + i) % 73 = 0 THEN 'velocity:numeric' END, CASE WHEN (k + i) % 71 = 0 THEN 'position:range' END, CASE WHEN i % 13 = 0 THEN 'qnh_hpa:range' END)"""
O["canonical_values"] = query(f"""SELECT CAST(floor(tnum) AS BIGINT) AS time, icao24, {r('lat')} AS lat, {r('lon')} AS lon, {r('baroaltitude')} AS baroaltitude, {r('velocity')} AS velocity,
{r('heading')} AS heading, {r('vertrate')} AS vertrate, og AS onground, {r('wdir')} AS wind_from_direction_deg, {r('qnh')} AS qnh_hpa, tc AS aircraft_typecode, {ERR} AS errors FROM up""", "up")
O["null_and_bool_tokens"] = query("""SELECT onground, aircraft_typecode, CASE WHEN aircraft_typecode = 'a320 ' THEN 'a320' END AS type_text,
CASE onground WHEN 'null' THEN NULL WHEN '0' THEN FALSE WHEN 'TRUE' THEN TRUE ELSE FALSE END AS flag, onground = 'TRUE' AS flag_or_false, count(*) AS n FROM (
SELECT CASE WHEN i % 5 = 0 THEN 'null' WHEN i % 5 = 1 THEN '0' WHEN onground THEN 'TRUE' ELSE 'False' END AS onground, CASE WHEN k % 5 = 0 THEN 'a320 ' ELSE 'na' END AS aircraft_typecode FROM raw)
GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5"), "raw")
O["error_position_report"] = query(f"SELECT month, row_number, split_part(e, ':', 1) AS field, split_part(e, ':', 2) AS code FROM (SELECT month, row_number, unnest(string_split({ERR}, ',')) AS e FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY flight_id, time) AS row_number FROM up) WHERE {ERR} <> '')", "up")
O["collapse_or_conflict"] = query("""SELECT icao24, time, count(*) - 1 AS duplicates, CASE WHEN count(DISTINCT coalesce(velocity, -1e9)) > 1 THEN 'conflict' ELSE 'kept' END AS result
FROM raw GROUP BY 1, 2""", "raw")

"""SQL for profiles and checks."""

from oracles.base import bins, closest, cte, hav, pmod, query, r
from oracles.phase import PHASE
from oracles.rows import ENG, near
from skyledger.operators.checks import BOUNDS, CRITICAL

ORACLE: dict[str, str] = {}
O = ORACLE
NUM = ("time", "lat", "lon", "baroaltitude", "velocity", "heading", "vertrate", "dist_to_runway_m")
ENDC = ("start_min_dist", "start_min_alt", "end_min_dist", "end_min_alt", "min_dist", "min_alt")
O["endpoint_stats"] = query("SELECT flight_id, n_rows, start_phase_set, end_phase_set, start_any_onground, end_any_onground, first_phase, last_phase, " + ", ".join(f"{r(c)} AS {c}" for c in ENDC) + " FROM ends", "ends")
FLAGS = ", ".join(f"bool_or({e}) AS {n}" for n, e in ENG.items())
cte("engf", "d21", f"SELECT flight_id, {FLAGS} FROM d21 GROUP BY 1")
O["engagement_flags"] = query("SELECT *, by_approach OR by_onground OR by_takeoff AS engages FROM engf", "engf")
O["engagement_subsets"] = query("SELECT by_approach, by_onground, by_takeoff, count(*) AS flights FROM engf GROUP BY 1, 2, 3", "engf")
O["direction_of_operation"] = query("""SELECT CASE WHEN s AND e THEN 'both' WHEN s THEN 'start_only' WHEN e THEN 'end_only' ELSE 'neither' END AS direction, count(*) AS flights FROM (
SELECT flight_id, bool_or(g AND rn <= 5) AS s, bool_or(g AND rn > n - 5) AS e FROM (SELECT flight_id, (k % 3 = 0 AND i < 2) OR (k % 4 = 0 AND i >= 25) AS g, row_number() OVER (PARTITION BY flight_id ORDER BY time) AS rn, count(*) OVER (PARTITION BY flight_id) AS n FROM obs) GROUP BY 1) GROUP BY 1""", "obs")
O["phase_composition"] = query(f"SELECT flight_phase, n, {r('n * 1e2 / sum(n) OVER ()')} AS pct FROM (SELECT flight_phase, count(*) AS n FROM d21 GROUP BY 1)", "d21")
O["operation_flights"] = query("SELECT CASE WHEN k % 3 = 0 THEN 'arrival' WHEN k % 3 = 1 THEN 'departure' ELSE 'unknown' END AS operation, count(*) AS n_rows, count(DISTINCT flight_id) AS flights FROM obs GROUP BY 1", "obs")
O["column_profile"] = query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, {r(f'(count(*) - count({c})) * 1e2 / count(*)')} AS null_pct, count(DISTINCT {c}) AS n_unique, "
    + (f"{r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'avg({c})')} AS mean" if c in NUM else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean") + " FROM d21"
    for c in (*NUM, "flight_id", "callsign", "flight_phase")), "d21")
STATES = {"all": "TRUE", "onground": "onground", "airborne": "NOT onground", "active": "onground AND step_speed > 2.5", "idle": "onground AND step_speed <= 2.5"}
O["null_by_state"] = query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + ", ".join(
    f"{r(f'count(*) FILTER (({e}) AND {c} IS NULL) * 1e2 / nullif(count(*) FILTER ({e}), 0)')} AS null_pct_{s}" for s, e in STATES.items()) + " FROM parked" for c in ("velocity", "baroaltitude", "heading")), "parked")
O["scale_profile"] = query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'max({c}) - min({c})')} AS range FROM d21" for c in NUM[1:]), "d21")
cte("flen", "obs", "SELECT flight_id, CAST(count(*) AS DOUBLE) AS n FROM obs GROUP BY 1")
O["length_quantiles"] = query(" UNION ALL ".join(f"SELECT 'P{int(q * 100)}' AS quantile, {r(f'quantile_cont(n, {q})')} AS rows FROM flen" for q in (0.5, 0.75, 0.9, 0.95, 0.99, 1.0)), "flen")
O["length_ecdf"] = query(f"SELECT CAST(n AS BIGINT) AS n_rows, c AS flights, {r('sum(c) OVER (ORDER BY n) / sum(c) OVER ()')} AS ecdf FROM (SELECT n, count(*) AS c FROM flen GROUP BY 1)", "flen")
O["long_tail_profile"] = query(f"""SELECT coalesce(mg, 0) > 300 AS gappy, count(*) AS flights, {r('avg(g)')} AS mean_ground_share, {r('avg(n)')} AS mean_rows FROM (SELECT *, quantile_cont(CAST(n AS DOUBLE), 0.99) OVER () AS mark FROM (
SELECT fid, count(*) AS n, avg(CAST(onground AS INTEGER)) AS g, max(gap) AS mg FROM (SELECT *, time - lag(time) OVER (PARTITION BY fid ORDER BY time) AS gap FROM (SELECT *, concat(icao24, '_', CAST(k // 60 % (1 + k % 5) AS VARCHAR)) AS fid FROM obs)) GROUP BY 1)) WHERE n > mark GROUP BY 1""", "obs")
BANDS = {"10-60s": (15, 70), "1-3min": (70, 180), "3-10min": (180, 600), "10-30min": (600, 1800)}
cte("gaps", "obs", "SELECT * FROM (SELECT time - lag(time) OVER (PARTITION BY flight_id ORDER BY time) AS g FROM obs) WHERE g IS NOT NULL")
O["gap_histogram"] = query(" UNION ALL ".join(f"SELECT '{n}' AS band, {r(f'count(*) FILTER (g > {a} AND g <= {b}) * 1e2 / count(*)')} AS pct FROM gaps" for n, (a, b) in BANDS.items()), "gaps")
O["histogram_60"] = query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(least(floor(({c} - lo) / (hi - lo) * 60), 59) AS INTEGER) AS bin, count(*) AS n FROM d21, (SELECT min({c}) AS lo, max({c}) AS hi FROM d21) WHERE {c} IS NOT NULL GROUP BY 1, 2"
                                         for c in ("lat", "lon", "velocity", "vertrate", "dist_to_runway_m")), "d21")
cte("wildh", "wild", f"SELECT *, CASE WHEN c > 180 THEN 360 - c ELSE c END AS heading_change FROM (SELECT *, abs(h - lag(h) OVER (PARTITION BY flight_id ORDER BY time)) AS c FROM (SELECT *, {pmod('heading + (i % 5) * 9')} AS h FROM wild))")
O["motion_tail_counts"] = query(" UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) FILTER ({e} > {a}) AS suspicious, count(*) FILTER ({e} > {b}) AS impossible FROM wildh" for n, e, a, b in (
    ("velocity", "velocity", 320, 400), ("vertrate", "abs(vertrate)", 25, 50), ("baroaltitude", "baroaltitude", 14000, 16000), ("heading_change", "heading_change", 15, 30))), "wildh")
cte("ext", "wild", """SELECT flight_id, max(velocity + k * 1e-3) AS max_velocity, max(abs(vertrate)) AS max_vertrate, max(baroaltitude) AS max_altitude, max(hc) AS max_heading_change FROM (
SELECT *, CASE WHEN c > 180 THEN 360 - c ELSE c END AS hc FROM (SELECT *, abs(heading - lag(heading) OVER (PARTITION BY flight_id ORDER BY time)) AS c FROM wild)) GROUP BY 1""")
O["extreme_topk"] = query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS metric, flight_id, {r(m)} AS value FROM ext WHERE {m} IS NOT NULL ORDER BY {m} DESC, flight_id LIMIT 20)" for m in ("max_velocity", "max_vertrate", "max_altitude", "max_heading_change")), "ext")
O["extreme_quantiles"] = query(" UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS flights, {r(f'avg({m})', 1)} AS mean, {r(f'stddev_samp({m})', 1)} AS deviation, {r(f'min({m})', 1)} AS least, {r(f'max({m})', 1)} AS largest, "
                                 + ", ".join(f"{r(f'quantile_cont({m}, {q})', 1)} AS p{round(100 * q)}" for q in (0.5, 0.9, 0.99)) + " FROM ext" for m in ("max_velocity", "max_vertrate", "max_altitude", "max_heading_change")), "ext")
O["impossible_share"] = query(f"""SELECT count(*) AS flights, CAST(sum(h) AS BIGINT) AS rows_high, {r('max(s)')} AS max_share, {r('quantile_cont(s, 0.1)')} AS p10, {r('quantile_cont(s, 0.5)')} AS p50, {r('quantile_cont(s, 0.9)')} AS p90 FROM (
SELECT count(*) FILTER (baroaltitude > 16000) AS h, CAST(count(*) FILTER (baroaltitude > 16000) AS DOUBLE) / count(*) AS s FROM wild GROUP BY flight_id) WHERE h > 0""", "wild")
O["ground_air_split"] = query(f"""SELECT i < 6 AS onground, flight_phase, count(*) AS n FROM (SELECT *, CASE WHEN c > 180 THEN 360 - c ELSE c END AS hc FROM (SELECT *, abs(h - lag(h) OVER (PARTITION BY flight_id ORDER BY time)) AS c FROM (
SELECT *, {pmod('heading + (i % 5) * 9')} AS h FROM d21))) WHERE hc > 15 GROUP BY 1, 2""", "d21")
O["derived_vs_reported"] = query(f"""SELECT count(*) AS n, {r('corr(d, velocity)')} AS correlation, {r('quantile_cont(abs(d - velocity), 0.5)')} AS median_difference FROM (SELECT *, time - lag(time) OVER w AS dt, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} / (time - lag(time) OVER w) AS d
FROM obs WINDOW w AS (PARTITION BY flight_id ORDER BY time)) WHERE dt = 5 AND NOT onground AND velocity IS NOT NULL""", "obs")
O["volume_coverage"] = query("""SELECT count(DISTINCT time < 1530000000) AS batches, count(DISTINCT flight_id) AS trajectories, count(*) AS rows, min(time) AS first_time, max(time) AS last_time, count(DISTINCT time // 86400) AS calendar_days,
count(DISTINCT (time // 86400 + 3) % 7) AS weekdays, count(DISTINCT time // 3600 % 24) AS hours FROM obs""", "obs")
DH = "radians(h - lag(h) OVER (PARTITION BY flight_id, segment_id ORDER BY time))"
O["turning_and_range"] = query(f"SELECT flight_id, segment_id, {r('coalesce(sum(t), 0)')} AS turn_deg, {r('max(baroaltitude) - min(baroaltitude)')} AS alt_range FROM (SELECT *, abs(degrees(atan2(sin(dh), cos(dh)))) AS t FROM (SELECT *, {DH} AS dh FROM (SELECT *, {pmod('heading + (i % 4) * 40')} AS h FROM seg))) GROUP BY 1, 2", "seg")
O["channel_summary"] = query(" UNION ALL ".join(f"SELECT flight_id, segment_id, '{c}' AS channel, {r(f'arg_min({c}, time)')} AS \"start\", {r(f'arg_max({c}, time)')} AS \"end\", {r(f'min({c})')} AS min, {r(f'max({c})')} AS max FROM seg GROUP BY 1, 2" for c in ("lat", "vertrate", "dist_to_runway_m")), "seg")
O["check_critical_nulls"] = query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(*) = count({c}) AS passes FROM d21" for c in CRITICAL), "d21")
O["check_bounds"] = query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < {a}) AS below_min, count(*) FILTER ({c} > {b}) AS above_max, {r(f'min({c})')} AS min_seen, {r(f'max({c})')} AS max_seen FROM wild" for c, (a, b) in BOUNDS.items()), "wild")
O["check_region"] = query("SELECT count(*) FILTER (lat < 38.5e0 OR lat > 42.5e0 OR lon < -6e0 OR lon > -1.1e0) AS outside, count(*) AS n_rows FROM (SELECT lat + (k % 9 - 4) * 0.6e0 AS lat, lon + (k % 7 - 3) * 0.8e0 AS lon FROM obs)", "obs")
O["check_consistency"] = query(f"SELECT 0e0 AS max_kmh, 0e0 AS max_dist, {r('avg(CASE WHEN i = 7 AND flight_phase <> $$cruise$$ THEN 0 ELSE 1 END)')} AS phase_match, 0e0 AS max_seconds, count(*) FILTER (i = 7 AND flight_phase <> 'cruise') = 0 AS passes FROM d21".replace("$$", "'"), "d21")
O["dataset_verdict"] = query("""SELECT TRUE AS real, count(*) = count(baroaltitude) AS usable, CASE WHEN t < 500 THEN 'NOT_YET' WHEN d < 30 OR t < 5000 THEN 'SOFT_DEV' WHEN d < 90 OR t < 20000 THEN 'CONDITIONAL' ELSE 'PASS' END AS enough, t AS trajectories, d AS days, 0 AS copies
FROM d21, (SELECT count(DISTINCT flight_id) AS t, count(DISTINCT time // 86400) AS d FROM d21) GROUP BY t, d""", "d21")
O["dataset_digest"] = query("SELECT CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, count(*) AS n_rows, TRUE AS stable FROM obs GROUP BY 1", "obs")
O["referential_integrity"] = query("SELECT flight_id, CASE WHEN flight_id LIKE '%1' THEN 0 ELSE 1 END AS n_left, CASE WHEN k % 50 = 0 THEN 2 ELSE 1 END AS n_right FROM (SELECT DISTINCT flight_id, k FROM obs) WHERE flight_id LIKE '%1' OR k % 50 = 0", "obs")
O["recomputed_parity"] = query("SELECT flight_id, concat_ws(',', CASE WHEN k % 40 = 0 THEN 'n_rows' END, CASE WHEN k % 60 = 0 THEN 'end_time' END) AS differs FROM (SELECT DISTINCT flight_id, k FROM obs) WHERE k % 40 = 0 OR k % 60 = 0", "obs")
O["count_map"] = query("SELECT 'phase' AS map, flight_phase AS key, count(*) AS n FROM d21 GROUP BY 1, 2 UNION ALL SELECT 'squawk', CAST(squawk AS VARCHAR), count(*) FROM d21 GROUP BY 1, 2", "d21")
O["id_set_overlap"] = query(f"""SELECT count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, {r('count(*) FILTER (a AND b) / CAST(greatest(count(*) FILTER (a), count(*) FILTER (b), 1) AS DOUBLE)')} AS overlap FROM (
SELECT flight_id, bool_or(vertrate > 0) AS a, bool_or(onground OR coalesce(velocity > 80.5e0, FALSE)) AS b FROM obs GROUP BY 1)""", "obs")

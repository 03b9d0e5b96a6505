"""SQL for segmentation, islands, resampling and windows."""

from oracles.base import closest, cte, hav, pmod, query, r, turn
from oracles.phase import PHASE
from oracles.rows import ANY, lerp, segmented
from skyledger.config import FEATURES, MEASURED, SCALED

ORACLE: dict[str, str] = {}
O = ORACLE
K = "flight_id, time"

O["segment_flights"] = query(f"""SELECT concat(icao24, '_', CAST(min(time) OVER (PARTITION BY icao24, seg) AS VARCHAR)) AS flight_id, icao24, time, {r('lat')} AS lat, {r('velocity')} AS velocity FROM (
SELECT *, sum(CASE WHEN g IS NULL OR g > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY icao24 ORDER BY time, rid) AS seg FROM (SELECT *, time - lag(time) OVER (PARTITION BY icao24 ORDER BY time, rid) AS g FROM (SELECT *, row_number() OVER () AS rid FROM raw)))""", "raw")
O["segment_gaps"] = query(f"SELECT segment_id, time FROM ({segmented('obs', 60)})", "obs")
O["segment_gap_or_jump"] = query(f"""SELECT concat(icao24, '_', CAST(CAST(seg AS BIGINT) AS VARCHAR)) AS seg_id, time, n AS n_rows FROM (SELECT *, count(*) OVER (PARTITION BY icao24, seg) AS n FROM (
SELECT *, sum(CASE WHEN g > 60 OR d > 5000 THEN 1 ELSE 0 END) OVER (PARTITION BY icao24 ORDER BY time) AS seg FROM (SELECT *, time - lag(time) OVER w AS g, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d FROM obs WINDOW w AS (PARTITION BY icao24 ORDER BY time))))
WHERE n >= 10""", "obs")


def stepped(source: str) -> str:
    return (f"SELECT *, step_m / step_s AS step_speed FROM (SELECT *, time - lag(time) OVER w AS step_s, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step_m "
            f"FROM {source} WINDOW w AS (PARTITION BY flight_id, segment_id ORDER BY time))")


O["movement_speed"] = query(f"SELECT segment_id, time, step_s, {r('step_m')} AS step_m, {r('step_speed')} AS step_speed FROM ({stepped('seg')})", "seg")
cte("parked0", "seg", """SELECT * REPLACE (k % 10 = 3 OR i < 6 OR i >= 40 AS onground, CASE WHEN i < 3 OR i >= 50 THEN 40.5e0 ELSE lat END AS lat, CASE WHEN i < 3 OR i >= 50 THEN -3.55e0 ELSE lon END AS lon) FROM seg""")
cte("parked", "parked0", f"SELECT *, NOT onground OR coalesce(step_speed > 2.5e0, FALSE) AS active FROM ({stepped('parked0')})")
O["trim_idle"] = query("""SELECT segment_id, time FROM (SELECT *, min(CASE WHEN active THEN time END) OVER p AS a, max(CASE WHEN active THEN time END) OVER p AS z, bool_or(NOT onground) OVER p AS air
FROM parked WINDOW p AS (PARTITION BY segment_id)) WHERE air AND time BETWEEN a AND z""", "parked")
O["idle_runs"] = query("""SELECT flight_id, coalesce(min(rn) FILTER (active) - 1, count(*)) AS lead_idle, coalesce(count(*) - max(rn) FILTER (active), 0) AS trail_idle, bool_or(NOT onground) AS has_air
FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY time) AS rn FROM parked) GROUP BY 1""", "parked")
O["corridor_visits"] = query("SELECT flight_id, runway, CAST(visit AS BIGINT) AS visit, start_time, end_time, n_rows FROM visits", "visits")
O["merge_intervals"] = query("SELECT * FROM clus", "clus")
O["attempt_extension"] = query("SELECT flight_id, cluster, min(time) AS start_time, max(time) AS end_time, count(*) AS n_rows FROM arow GROUP BY 1, 2", "arow")
O["extract_attempts"] = query("SELECT flight_id, cluster, geometry_runway, min(time) AS start_time, max(time) AS end_time, count(*) AS n_rows FROM att GROUP BY 1, 2, 3", "att")


def islands(source: str, cond: str, keys: str = "flight_id") -> str:
    return (f"SELECT {keys}, g, min(rn) AS start_rn, count(*) AS n_rows, min(time) AS start_time, max(time) AS end_time FROM (SELECT *, rn - row_number() OVER (PARTITION BY {keys} ORDER BY time) AS g FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY time) AS rn FROM {source}) WHERE {cond}) GROUP BY {keys}, g")


O["persistent_spans"] = query(f"SELECT flight_id, start_rn, n_rows, start_time, end_time FROM ({islands('obs', '(i // 7) % 3 = 1')}) WHERE n_rows >= 3 AND end_time - start_time >= 20", "obs")
O["airborne_runs"] = query(f"SELECT flight_id, segment_id, start_time, end_time, n_rows FROM ({islands('parked', 'NOT onground', 'flight_id, segment_id')})", "parked")
cte("nulled", "obs", "SELECT * REPLACE (CASE WHEN (k + i) % 12 < 5 THEN NULL ELSE velocity END AS velocity) FROM obs")
cte("nulled_air", "nulled", "SELECT * FROM nulled WHERE NOT onground")
O["max_null_run"] = query(" UNION ALL ".join(
    f"SELECT '{s}' AS scope, e.flight_id, coalesce(m, 0) AS longest FROM (SELECT DISTINCT flight_id FROM {t}) e LEFT JOIN (SELECT flight_id, max(n_rows) AS m FROM ({islands(t, 'velocity IS NULL')}) GROUP BY 1) x ON e.flight_id = x.flight_id"
    for s, t in (("all", "nulled"), ("airborne", "nulled_air"))), "nulled_air")
cte("rep", "obs", "SELECT * REPLACE (CASE WHEN i % 3 = 1 THEN coalesce(lag(lat) OVER w, lat) ELSE lat END AS lat, CASE WHEN i % 3 = 1 THEN coalesce(lag(lon) OVER w, lon) ELSE lon END AS lon) FROM obs WINDOW w AS (PARTITION BY flight_id ORDER BY time)")
cte("rep2", "rep", "SELECT *, coalesce(lat = lag(lat) OVER w AND lon = lag(lon) OVER w, FALSE) AS same, coalesce(velocity = lag(velocity) OVER w, FALSE) AS sv, coalesce(baroaltitude = lag(baroaltitude) OVER w, FALSE) AS sb FROM rep WINDOW w AS (PARTITION BY flight_id ORDER BY time)")
O["value_repeat_rate"] = query(" UNION ALL ".join(f"SELECT '{n}' AS channel, {r(f'avg(CAST({c} AS INTEGER)) * 100')} AS repeat_pct FROM rep2" for n, c in (("position", "same"), ("velocity", "sv"), ("baroaltitude", "sb"))), "rep2")
O["update_intervals"] = query("SELECT interval_s, count(*) AS n FROM (SELECT time - lag(time) OVER (PARTITION BY flight_id ORDER BY time) AS interval_s FROM rep2 WHERE NOT same) WHERE interval_s IS NOT NULL GROUP BY 1", "rep2")
O["gap_spatial_profile"] = query(f"""SELECT count(*) AS gaps, {r('max(jump)')} AS max_jump, {r('avg(CAST(bef AS INTEGER))')} AS ground_before, {r('avg(CAST(onground AS INTEGER))')} AS ground_after, {r('avg(CAST(jump < 2000 AS INTEGER))')} AS near_share,
{r('quantile_cont(jump, 0.5)')} AS median_jump, {r('quantile_cont(jump, 0.9)')} AS p90_jump, {r('quantile_cont(jump / dt, 0.5)')} AS median_speed, {r('quantile_cont(jump / dt, 0.9)')} AS p90_speed FROM (
SELECT *, time - lag(time) OVER w AS dt, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS jump, lag(onground) OVER w AS bef FROM obs WINDOW w AS (PARTITION BY flight_id ORDER BY time)) WHERE dt > 60""", "obs")
O["split_threshold_sweep"] = query(f"""SELECT threshold_s, CAST(sum(CASE WHEN seg > 0 THEN 1 ELSE 0 END) AS BIGINT) AS splits, max(n) AS max_rows, {r('quantile_cont(CAST(n AS DOUBLE), 0.95)')} AS p95, {r('quantile_cont(CAST(n AS DOUBLE), 0.99)')} AS p99 FROM (
SELECT threshold_s, flight_id, seg, count(*) AS n FROM (SELECT t AS threshold_s, flight_id, sum(CASE WHEN g > t THEN 1 ELSE 0 END) OVER (PARTITION BY t, flight_id ORDER BY time) AS seg FROM (
SELECT *, time - lag(time) OVER (PARTITION BY flight_id ORDER BY time) AS g FROM obs), (SELECT unnest([2, 4, 60, 90, 180]) AS t)) GROUP BY 1, 2, 3) GROUP BY 1""", "obs")
O["row_step_quality"] = query(f"""SELECT flight_id, max(g) AS max_gap_s, {r('max(s)')} AS max_ground_speed, {r('max(v)')} AS max_vertical_rate FROM (SELECT flight_id, time - lag(time) OVER w AS g,
{hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} / (time - lag(time) OVER w) AS s, abs(baroaltitude - lag(baroaltitude) OVER w) / (time - lag(time) OVER w) AS v FROM obs WINDOW w AS (PARTITION BY flight_id ORDER BY time)) GROUP BY 1""", "obs")
O["previous_first_last_k"] = query("""SELECT count(*) FILTER (t) AS takeoff, count(*) FILTER (g) AS onground, count(*) FILTER (t AND g) AS "both", count(*) FILTER (t AND NOT g) AS takeoff_only, count(*) FILTER (g AND NOT t) AS onground_only FROM (
SELECT flight_id, bool_or(CASE WHEN k % 4 = 1 AND i = 3 THEN TRUE ELSE flight_phase = 'takeoff' END) AS t, bool_or(k % 6 = 1 AND i < 2) AS g FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY time) AS rn FROM d21) WHERE rn <= 5 GROUP BY 1)""", "d21")


# ---- resampling ----
def snapped(source: str) -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, grid_time ORDER BY time) AS rn0 FROM (SELECT *, t0 + CAST(round_even((time - t0) / 10e0, 0) AS BIGINT) * 10 AS grid_time FROM ("
            f"SELECT *, min(time) OVER (PARTITION BY segment_id) AS t0 FROM {source}))) WHERE rn0 = 1")


def gridded(source: str, cols: str) -> str:
    return (f"SELECT g.flight_id, g.segment_id, g.gt AS time, {cols} FROM (SELECT flight_id, segment_id, unnest(range(min(grid_time), max(grid_time) + 1, 10)) AS gt FROM {source} GROUP BY 1, 2) g "
            f"LEFT JOIN {source} s ON s.segment_id = g.segment_id AND s.grid_time = g.gt")


MC = ", ".join(f"s.{c}" for c in MEASURED)
cte("snap", "seg", snapped("seg"))
cte("grid", "snap", gridded("snap", MC + ", s.onground, s.flight_phase, s.squawk, s.i"))
O["snap_to_grid"] = query("SELECT segment_id, time, grid_time FROM snap", "snap")
O["expand_grid"] = query(f"SELECT segment_id, time, {r('lat')} AS lat FROM grid", "grid")
O["missing_masks"] = query("SELECT segment_id, time, " + ", ".join(f"{c} IS NULL AS {c}_missing" for c in MEASURED) + " FROM grid", "grid")
O["interpolate_linear"] = query(f"SELECT segment_id, time, {r('baroaltitude')} AS baroaltitude, {r('velocity')} AS velocity FROM ({lerp('SELECT flight_id, segment_id, time, baroaltitude, velocity FROM grid', ['baroaltitude', 'velocity'], 'flight_id, segment_id')})", "grid")
cte("turned", "seg", f"SELECT * REPLACE (CASE WHEN (k + i) % 9 = 4 THEN NULL ELSE {pmod('heading + (i % 4) * 40')} END AS heading) FROM seg")
cte("tsnap", "turned", snapped("turned"))
cte("tgrid", "tsnap", "SELECT flight_id, segment_id, time, sin(radians(heading)) AS hs, cos(radians(heading)) AS hc FROM (" + gridded("tsnap", "s.heading") + ")")


def unit(source: str) -> str:
    return (f"SELECT *, CASE WHEN n > 0 THEN hs / n ELSE 0e0 END AS hdg_sin, CASE WHEN n > 0 THEN hc / n ELSE 1e0 END AS hdg_cos FROM (SELECT *, sqrt(hs * hs + hc * hc) AS n FROM ("
            f"SELECT * REPLACE (coalesce(hs, 0e0) AS hs, coalesce(hc, 0e0) AS hc) FROM ({lerp(source, ['hs', 'hc'], 'flight_id, segment_id')})))")


O["interpolate_heading"] = query(f"SELECT segment_id, time, {r('hdg_sin')} AS hdg_sin, {r('hdg_cos')} AS hdg_cos FROM ({unit('SELECT * FROM tgrid')})", "tgrid")


def near_fill(c: str, keys: str = "segment_id") -> str:
    """Last value before, else first value after, through the row numbers of the non-null rows."""
    return (f"coalesce(arg_max({c}, time) FILTER ({c} IS NOT NULL) OVER (PARTITION BY {keys} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"arg_min({c}, time) FILTER ({c} IS NOT NULL) OVER (PARTITION BY {keys} ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


O["ffill_bfill"] = query(f"SELECT segment_id, time, {near_fill('onground')} AS onground, {near_fill('flight_phase')} AS flight_phase, {near_fill('squawk')} AS squawk FROM (SELECT * REPLACE (CASE WHEN i % 3 = 0 THEN squawk + i END AS squawk) FROM grid)", "grid")


def resampled(grid: str, extra: str = "") -> str:
    """Imputed grid rows with masks, from a grid CTE."""
    five = ["lat", "lon", "baroaltitude", "velocity", "vertrate"]
    masks = ", ".join(f"{c} IS NULL AS {c}_missing" for c in MEASURED)
    base = (f"SELECT * EXCLUDE (heading, onground, flight_phase, squawk), {masks}, sin(radians(heading)) AS hs, cos(radians(heading)) AS hc, coalesce({near_fill('onground')}, FALSE) AS onground, "
            f"{near_fill('flight_phase')} AS flight_phase, {near_fill('squawk')} AS squawk FROM {grid}")
    filled = lerp(base, [*five, "hs", "hc"], "flight_id, segment_id")
    zero = ", ".join(f"coalesce({c}, 0e0) AS {c}" for c in [*five, "hs", "hc"])
    unit_ = (f"SELECT *, CASE WHEN n > 0 THEN hs / n ELSE 0e0 END AS hdg_sin, CASE WHEN n > 0 THEN hc / n ELSE 1e0 END AS hdg_cos FROM (SELECT *, sqrt(hs * hs + hc * hc) AS n FROM (SELECT * REPLACE ({zero}) FROM ({filled})))")
    return f"SELECT *, {pmod('degrees(atan2(hdg_sin, hdg_cos))')} AS heading, {closest()} AS dist_to_runway_m FROM ({unit_})"


cte("resampled", "grid", resampled("grid"))
RS = ("lat", "lon", "baroaltitude", "velocity", "vertrate", "heading")
O["resample_segments"] = query("SELECT segment_id, time, " + ", ".join(f"{r(c)} AS {c}" for c in (*RS, "hdg_sin", "hdg_cos", "dist_to_runway_m")) + ", onground, flight_phase, squawk, velocity_missing FROM resampled", "resampled")

# the whole cleaning job on d21 (gap 180 s)
cte("p_seg", "d21", segmented("d21", 180))
cte("p_eng", "p_seg", f"SELECT * EXCLUDE (f, s) FROM (SELECT *, bool_or({ANY}) OVER (PARTITION BY flight_id) AS f, bool_or({ANY}) OVER (PARTITION BY segment_id) AS s FROM p_seg) WHERE f AND s")
cte("p_trim", "p_eng", f"""SELECT * EXCLUDE (a, z, air, active, step_s, step_m, step_speed) FROM (SELECT *, min(CASE WHEN active THEN time END) OVER p AS a, max(CASE WHEN active THEN time END) OVER p AS z, bool_or(NOT onground) OVER p AS air
FROM (SELECT *, NOT onground OR coalesce(step_speed > 2.5e0, FALSE) AS active FROM ({stepped('p_eng')})) WINDOW p AS (PARTITION BY segment_id)) WHERE air AND time BETWEEN a AND z""")


def counted(source: str) -> str:
    nulls = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in MEASURED)
    return f"""SELECT *, CAST(sum(bad) OVER p AS BIGINT) AS n_imputed_impossible, CAST(sum({nulls} - bad) OVER p AS BIGINT) AS n_imputed_missing, bool_or(squawk IN (7500, 7600, 7700)) OVER p AS is_emergency FROM (
SELECT * REPLACE (CASE WHEN iv OR (velocity = 0 AND baroaltitude > 1000) THEN NULL ELSE velocity END AS velocity, CASE WHEN ir THEN NULL ELSE vertrate END AS vertrate, CASE WHEN ia THEN NULL ELSE baroaltitude END AS baroaltitude),
  CAST(iv AS INTEGER) + CAST(ir AS INTEGER) + CAST(ia AS INTEGER) AS bad FROM (SELECT *, coalesce(abs(velocity) > 400, FALSE) AS iv, coalesce(abs(vertrate) > 50, FALSE) AS ir, coalesce(baroaltitude > 16000 OR baroaltitude < -100, FALSE) AS ia FROM {source}))
WINDOW p AS (PARTITION BY segment_id)"""


cte("p_cnt", "p_trim", counted("p_trim"))
cte("p_snap", "p_cnt", snapped("p_cnt"))
cte("p_grid", "p_snap", gridded("p_snap", MC + ", s.onground, s.flight_phase, s.squawk"))
cte("p_res", "p_grid", resampled("p_grid"))
cte("p_attr", "p_cnt", "SELECT DISTINCT segment_id, icao24, n_imputed_impossible, n_imputed_missing, is_emergency FROM p_cnt")
cte("clean", "p_res p_attr", "SELECT * EXCLUDE (n, hs, hc) FROM (SELECT *, count(*) OVER (PARTITION BY segment_id) AS n_steps FROM p_res JOIN p_attr USING (segment_id)) WHERE n_steps >= 10")
O["preprocess"] = query("SELECT segment_id, flight_id, icao24, time, " + ", ".join(f"{r(c)} AS {c}" for c in (*RS, "dist_to_runway_m")) + ", onground, flight_phase, squawk, "
                        + ", ".join(f"{c}_missing" for c in MEASURED) + ", is_emergency, n_imputed_impossible, n_imputed_missing, n_steps FROM clean", "clean")
NULLF = " OR ".join(f"{c} IS NULL" for c in (*RS[:5], "hdg_sin", "hdg_cos", "dist_to_runway_m", "onground"))
O["assert_grid"] = query(f"SELECT nf AS null_feature, bs AS bad_step, count(*) AS n FROM (SELECT {NULLF} AS nf, coalesce(time - lag(time) OVER (PARTITION BY segment_id ORDER BY time) <> 10, FALSE) AS bs FROM (SELECT * REPLACE (CASE WHEN time // 10 % 90 = 7 THEN NULL ELSE lat END AS lat, time + CASE WHEN time // 10 % 70 = 3 THEN 5 ELSE 0 END AS time) FROM clean)) WHERE nf OR bs GROUP BY 1, 2", "clean")
O["project_grid_size"] = query(f"SELECT CAST(sum((s + 9) // 10 + 1) AS BIGINT) AS grid_rows, count(*) AS segments FROM (SELECT max(time) - min(time) AS s FROM ({segmented('obs', 60)}) GROUP BY segment_id)", "obs")
O["reject_summary"] = query("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {n} AS step_no, '{name}' AS step, count(*) AS rows, {'count(DISTINCT segment_id)' if n > 1 else 'CAST(NULL AS BIGINT)'} AS segments FROM {t}"
    for n, (name, t) in enumerate((("input", "d21"), ("deduplicated", "d21"), ("segmented", "p_seg"), ("engaged", "p_eng"), ("trimmed", "p_trim"), ("counted", "p_cnt"), ("gridded", "p_res"), ("clean", "clean")))) + ")", "clean")
O["imputation_counters"] = query(f"SELECT segment_id, max(n_imputed_impossible) AS n_imputed_impossible, max(n_imputed_missing) AS n_imputed_missing FROM ({counted('wild')}) GROUP BY 1", "wild")
O["emergency_segments"] = query("SELECT segment_id, bool_or(squawk IN (7500, 7600, 7700)) AS is_emergency FROM seg GROUP BY 1", "seg")
O["per_segment_broadcast"] = query("SELECT segment_id, time, n AS hits, n > 0 AS is_emergency FROM (SELECT *, count(*) FILTER (squawk IN (7500, 7600, 7700)) OVER (PARTITION BY segment_id) AS n FROM seg)", "seg")

# ---- windows ----
cte("scl", "clean", "SELECT " + ", ".join(f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1e0 END AS sd_{c}" for c in SCALED) + " FROM clean")
MISS = " OR ".join(f"{c}_missing" for c in MEASURED)
# the number is taken off outside the part: a filter on it would be pushed below the subtraction
cte("zrow0", "clean scl", "SELECT c.*, row_number() OVER (PARTITION BY segment_id ORDER BY time) AS rn, NOT (" + MISS + ") AS valid, "
    + ", ".join(f"({c} - mean_{c}) / sd_{c} AS z_{c}" for c in SCALED) + ", hdg_sin AS z_hdg_sin, hdg_cos AS z_hdg_cos, CAST(CAST(onground AS INTEGER) AS DOUBLE) AS z_onground FROM clean c, scl")
cte("zrow", "zrow0", "SELECT * EXCLUDE (rn), rn - 1 AS step FROM zrow0")
O["to_sequences"] = query("SELECT s.segment_id, s.n > 15 AS was_truncated, s.j AS step, " + r("CASE WHEN z.segment_id IS NULL THEN 0 ELSE 1 END") + " AS mask, " + r("CASE WHEN z.valid THEN 1 ELSE 0 END") + " AS loss_mask, "
                          + ", ".join(f"{r(f'coalesce(z_{c}, 0e0)')} AS z_{c}" for c in FEATURES)
                          + " FROM (SELECT segment_id, count(*) AS n, unnest(range(0, 15)) AS j FROM clean GROUP BY 1) s LEFT JOIN zrow z ON z.segment_id = s.segment_id AND z.step = s.j", "zrow")
O["loss_mask"] = query(f"SELECT segment_id, time, NOT ({MISS}) AS observed FROM clean", "clean")
O["sequence_length_p95"] = query("SELECT CAST(floor(quantile_cont(CAST(n AS DOUBLE), 0.95)) AS BIGINT) AS t FROM (SELECT count(*) AS n FROM clean GROUP BY segment_id)", "clean")
O["truncation_tradeoff"] = query(f"""SELECT t, {r('sum(CASE WHEN n > t THEN 1 ELSE 0 END) * 1e2 / count(*)')} AS truncated_pct, {r('sum(greatest(t - n, 0)) * 1e2 / sum(t)')} AS padding_pct
FROM (SELECT count(*) AS n FROM clean GROUP BY segment_id), (SELECT unnest([10, 12, 14, 16, 18]) AS t) GROUP BY 1""", "clean")
cte("sw", "seg", """SELECT s.segment_id, w AS window_no, time, vertrate FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY time) - 1 AS rn, count(*) OVER (PARTITION BY segment_id) AS n FROM seg) s,
  (SELECT unnest(range(0, 40)) AS w) WHERE w * 10 + 20 <= n AND rn >= w * 10 AND rn < w * 10 + 20""")
O["sliding_windows"] = query("SELECT segment_id, window_no, count(*) AS n_rows, min(time) AS start_time, max(time) AS end_time FROM sw GROUP BY 1, 2", "sw")
O["worst_window_score"] = query(f"SELECT segment_id, {r('max(s)')} AS score FROM (SELECT segment_id, window_no, avg(abs(vertrate + 3.9e0)) AS s FROM sw GROUP BY 1, 2) GROUP BY 1", "sw")
STATS = (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))
O["summary_features"] = query("SELECT segment_id, " + ", ".join(f"{r(f'coalesce({f}(z_{c}) FILTER (valid), 0e0)')} AS {c}_{s}" for c in SCALED for s, f in STATS) + " FROM zrow WHERE step < 15 GROUP BY 1", "zrow")
O["fit_scaler"] = query("SELECT " + ", ".join(f"{r(f'mean_{c}')} AS mean_{c}, {r(f'sd_{c}')} AS sd_{c}" for c in SCALED) + " FROM scl", "scl")

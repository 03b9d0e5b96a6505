"""Plain SQL for the correctness check: named common table expressions and a builder."""

from __future__ import annotations

from skyledger.config import DEFAULT as C
from skyledger.config import EARTH_RADIUS_M, FEATURES, LANDING_RUNWAYS, LEGACY_POINTS, PUBLISHED_ENVELOPE, SCALED
from skyledger.sources import derived

CTES: dict[str, tuple[tuple[str, ...], str]] = {}
RECURSIVE: set[str] = set()


def cte(name: str, deps: str, sql: str, recursive: bool = False) -> None:
    CTES[name] = (tuple(deps.split()), sql)
    if recursive:
        RECURSIVE.add(name)


def query(select: str, *needs: str) -> str:
    """SELECT text preceded by the tables it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for need in needs:
        visit(need)
    body = ", ".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({CTES[n][1]})" for n in order)
    return f"WITH {'RECURSIVE ' if RECURSIVE & set(order) else ''}{body} {select}" if order else select


def r(expr: str, digits: int = 3) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0e0"


def pmod(a: str, b: str = "360e0") -> str:
    return f"((({a}) % {b} + {b}) % {b})"


def hav(a, b, c, d) -> str:
    x = (f"(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) "
         f"* pow(sin(radians(({d}) - ({b})) / 2), 2))")
    return f"({2 * EARTH_RADIUS_M:.1f}e0 * atan2(sqrt({x}), sqrt(1 - {x})))"


def closest(lat="lat", lon="lon") -> str:
    return "least(" + ", ".join(hav(lat, lon, derived.number(a), derived.number(b)) for a, b in LEGACY_POINTS.values()) + ")"


def frame(lat="lat", lon="lon") -> str:
    e = f"(radians({lon} - rwy_lon) * 6371000e0 * cos(radians(({lat} + rwy_lat) / 2)))"
    n = f"(radians({lat} - rwy_lat) * 6371000e0)"
    return (f"-({e} * sin(radians(bearing)) + {n} * cos(radians(bearing))) AS along, "
            f"{e} * cos(radians(bearing)) - {n} * sin(radians(bearing)) AS cross_m, "
            f"{hav(lat, lon, 'rwy_lat', 'rwy_lon')} AS dist")


def turn(a: str, b: str) -> str:
    return f"abs({pmod(f'{a} - {b} + 180e0')} - 180e0)"


def bins(x: str) -> str:
    return (f"CASE WHEN {x} >= 0 AND {x} < 1500 THEN '0-1500' WHEN {x} >= 1500 AND {x} < 3000 THEN '1500-3000' "
            f"WHEN {x} >= 3000 AND {x} < 6000 THEN '3000-6000' WHEN {x} >= 6000 AND {x} < 10000 THEN '6000-10000' "
            f"WHEN {x} >= 10000 AND {x} < 20000 THEN '10000-20000' END")


cte("obs", "", derived.observations_sql())
cte("raw", "obs", derived.with_copies_sql())
cte("wx", "obs", derived.weather_reports_sql())
cte("wxt", "wx", derived.weather_text_sql())
cte("reg", "obs", derived.registry_sql())
cte("rwy", "", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{x.designator}', '{x.direction}', {derived.number(x.lat)}, {derived.number(x.lon)}, {derived.number(x.bearing)}, {derived.number(x.elevation)})"
    for i, x in enumerate(LANDING_RUNWAYS)) + ") AS t(ord, runway, direction, rwy_lat, rwy_lon, bearing, elevation)")
cte("env", "", "SELECT * FROM (VALUES " + ", ".join(
    f"('{d}', 'unknown', '{b}', {derived.number(sl)}, {derived.number(sh)}, {derived.number(vl)}, {derived.number(vh)})"
    for d, b, sl, sh, vl, vh in PUBLISHED_ENVELOPE) + ") AS t(direction, speed_class, bin, speed_lo, speed_hi, rate_lo, rate_hi)")

# ---- approach ----
cte("mobs", "obs", derived.with_masks_sql())
cte("cobs", "mobs", "SELECT DISTINCT * FROM mobs WHERE lat IS NOT NULL AND NOT lat_missing AND NOT lon_missing")
cte("idxd", "cobs", "SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY time) AS idx FROM cobs")
cte("inside", "idxd rwy", f"SELECT * FROM (SELECT flight_id, time, idx, runway, {frame()} FROM idxd, rwy) "
    "WHERE along BETWEEN -500 AND 20000 AND abs(cross_m) <= 6000")
cte("visits", "inside", """
SELECT flight_id, runway, visit, min(time) AS start_time, max(time) AS end_time, count(*) AS n_rows FROM (
  SELECT *, sum(CASE WHEN pt IS NULL OR time - pt > 180 OR (idx - pi - 1 >= 3 AND time - pt >= 20) THEN 1 ELSE 0 END)
    OVER (PARTITION BY flight_id, runway ORDER BY idx) AS visit FROM (
    SELECT *, lag(time) OVER w AS pt, lag(idx) OVER w AS pi FROM inside WINDOW w AS (PARTITION BY flight_id, runway ORDER BY idx)))
GROUP BY 1, 2, 3 HAVING count(*) >= 8""")
cte("clus", "visits", """
SELECT flight_id, CAST(c AS BIGINT) AS cluster, min(start_time) AS start_time, max(end_time) AS end_time FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_time > reach THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id ORDER BY start_time, end_time, runway
    ROWS UNBOUNDED PRECEDING) AS c FROM (
    SELECT *, max(end_time) OVER (PARTITION BY flight_id ORDER BY start_time, end_time, runway ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM visits))
GROUP BY 1, 2""")
cte("arow", "cobs clus", """
SELECT o.*, c.cluster FROM cobs o JOIN (SELECT *, lead(start_time) OVER (PARTITION BY flight_id ORDER BY cluster) AS nxt FROM clus) c
ON o.flight_id = c.flight_id AND o.time >= c.start_time AND (o.time <= c.end_time OR (o.time <= c.end_time + 180 AND (nxt IS NULL OR o.time < nxt)))""")
cte("cand", "arow rwy", f"SELECT *, along BETWEEN 0 AND 25000 AND abs(cross_m) <= 6000 AND NOT coalesce(baroaltitude > elevation + 3000, FALSE) AS gate "
    f"FROM (SELECT *, {frame()} FROM arow, rwy)")
cte("scores", "cand", f"""
SELECT *, CASE WHEN gate_rows >= 8 AND span_s >= 60 THEN lat_part + track_error / 30e0 + least(min_dist / 6e3, 2e0) END AS score FROM (
SELECT flight_id, cluster, ord, runway, direction, rwy_lat, rwy_lon, bearing, elevation, min(dist) AS min_dist,
  count(*) FILTER (gate) AS gate_rows, count(*) FILTER (recent) AS rows_used, max(time) FILTER (recent) - min(time) FILTER (recent) AS span_s,
  median(abs(cross_m) / greatest(250e0, along * 0.12e0)) FILTER (recent) AS lat_part,
  CASE WHEN count(*) FILTER (recent AND velocity >= 30) >= 3 THEN median({turn('heading', 'bearing')}) FILTER (recent AND velocity >= 30) ELSE 9e1 END AS track_error
FROM (SELECT *, gate AND time >= max(CASE WHEN gate THEN time END) OVER (PARTITION BY flight_id, cluster, ord) - 600 AS recent FROM cand)
GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9"))
cte("best", "scores", """
SELECT w.flight_id, w.cluster, w.runway AS wr, w.direction AS wd, w.rwy_lat, w.rwy_lon, w.bearing, w.elevation, w.score AS ws,
  coalesce((SELECT min(o.score) FROM scores o WHERE o.flight_id = w.flight_id AND o.cluster = w.cluster AND o.direction <> w.direction) - w.score, CAST('inf' AS DOUBLE)) AS dm,
  coalesce((SELECT min(o.score) FROM scores o WHERE o.flight_id = w.flight_id AND o.cluster = w.cluster AND o.direction = w.direction AND o.ord <> w.ord) - w.score, CAST('inf' AS DOUBLE)) AS em
FROM (SELECT *, row_number() OVER (PARTITION BY flight_id, cluster ORDER BY score NULLS LAST, ord) AS rn FROM scores) w WHERE rn = 1""")
cte("inferred", "best", """
SELECT flight_id, cluster, CASE WHEN ok THEN CASE WHEN em >= 0.2e0 THEN wr ELSE wd || '_pair' END END AS runway,
  CASE WHEN ok THEN wr END AS geometry_runway, CASE WHEN ok THEN wd END AS direction,
  CASE WHEN NOT ok THEN 'unknown' WHEN em >= 0.2e0 THEN 'exact' ELSE 'direction' END AS specificity,
  CASE WHEN ok THEN least(1e0, greatest(0e0, dm / 2)) / (1 + ws) ELSE 0e0 END AS confidence,
  CASE WHEN ws IS NULL THEN 0e0 WHEN ok AND em >= 0.2e0 THEN em ELSE dm END AS score_margin, ws AS score,
  CASE WHEN ws IS NULL THEN 'no_supported_runway_candidate' WHEN NOT ok THEN 'runway_direction_ambiguous' END AS reason,
  rwy_lat, rwy_lon, bearing, elevation
FROM (SELECT *, ws IS NOT NULL AND ws <= 4 AND dm >= 0.35e0 AS ok FROM best)""")
cte("att", "arow inferred", "SELECT * FROM arow JOIN (SELECT * FROM inferred WHERE geometry_runway IS NOT NULL) USING (flight_id, cluster)")
cte("framed", "att", f"""
SELECT *, row_number() OVER w - 1 AS ix, time - lag(time) OVER w AS gap_s,
  {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} / (time - lag(time) OVER w) AS ground_rate,
  abs(baroaltitude - lag(baroaltitude) OVER w) / (time - lag(time) OVER w) AS vertical_rate
FROM (SELECT *, min(CASE WHEN g THEN time END) OVER p AS g0, max(CASE WHEN g THEN time END) OVER p AS g1,
   min(time) OVER p AS frame_start, max(time) OVER p AS frame_end FROM (
   SELECT *, along BETWEEN -500 AND 20000 AND abs(cross_m) <= 6000 AS g FROM (SELECT *, {frame()} FROM att))
   WINDOW p AS (PARTITION BY flight_id, cluster))
WHERE time BETWEEN g0 AND g1 + 180 WINDOW w AS (PARTITION BY flight_id, cluster ORDER BY time)""")
cte("oc1", "framed", """
SELECT f.*, CASE WHEN coalesce(max(vertical_rate) OVER p, 0) <= 50 THEN baroaltitude END AS alt_ok,
  min(CASE WHEN onground AND dist <= 2000 THEN ix END) OVER p AS touch_ix, max(ix) OVER p AS last_ix
FROM framed f WINDOW p AS (PARTITION BY flight_id, cluster)""")
cte("oc2", "oc1", """
SELECT *, min(CASE WHEN ix = touch_ix THEN baroaltitude END) OVER p AS touch_alt,
  min(CASE WHEN dist <= 5000 THEN alt_ok END) OVER p AS low_alt FROM oc1 WINDOW p AS (PARTITION BY flight_id, cluster)""")
cte("oc3", "oc2", """
SELECT *, min(CASE WHEN dist <= 5000 AND alt_ok = low_alt THEN ix END) OVER p AS low_ix FROM oc2 WINDOW p AS (PARTITION BY flight_id, cluster)""")
cte("oc4", "oc3", """
SELECT *, count(CASE WHEN NOT onground AND alt_ok IS NOT NULL AND ix > touch_ix THEN 1 END) OVER p AS ln,
  max(CASE WHEN NOT onground AND ix > touch_ix THEN alt_ok END) OVER p AS lt,
  max(CASE WHEN NOT onground AND alt_ok IS NOT NULL AND ix > touch_ix THEN time END) OVER p - min(CASE WHEN NOT onground AND alt_ok IS NOT NULL AND ix > touch_ix THEN time END) OVER p AS ls,
  max(CASE WHEN NOT onground AND ix < low_ix THEN alt_ok END) OVER p AS bt, max(CASE WHEN NOT onground AND ix > low_ix THEN alt_ok END) OVER p AS at2
FROM oc3 WINDOW p AS (PARTITION BY flight_id, cluster)""")
cte("oc", "oc4", """
SELECT *, CASE WHEN oc IN ('touch_and_go', 'go_around') THEN m_ix ELSE last_ix END AS crit_end FROM (
SELECT *, CASE WHEN oc IN ('touch_and_go', 'landing_observed') THEN touch_ix WHEN oc = 'go_around' THEN low_ix END AS m_ix FROM (
SELECT *, CASE WHEN touch_ix IS NOT NULL THEN CASE WHEN ln >= 3 AND lt - touch_alt >= 150 AND ls >= 20 THEN 'touch_and_go' ELSE 'landing_observed' END
  WHEN bt - low_alt >= 150 AND at2 - low_alt >= 150 THEN 'go_around' ELSE 'closest_approach' END AS oc FROM oc4))""")
cte("q", "oc", """
SELECT *, count(*) FILTER (win) OVER p AS n_rows, max(time) FILTER (win) OVER p - min(time) FILTER (win) OVER p AS duration_s,
  CAST(coalesce(max(gap_s) FILTER (win) OVER p, 0) AS DOUBLE) AS max_gap_s, coalesce(max(ground_rate) FILTER (win) OVER p, 0e0) AS max_ground_speed,
  coalesce(max(vertical_rate) FILTER (win) OVER p, 0e0) AS max_vertical_rate,
  count(*) FILTER (win AND baroaltitude IS NOT NULL AND dist <= 1500 AND onground) OVER p AS g_n,
  count(*) FILTER (win AND baroaltitude IS NOT NULL AND dist <= 750) OVER p AS p_n
FROM (SELECT *, ix <= crit_end AS win FROM oc) WINDOW p AS (PARTITION BY flight_id, cluster)""")
cte("meds", "q", """
SELECT flight_id, cluster, median(baroaltitude) FILTER (win AND dist <= 1500 AND onground) AS g_med, median(baroaltitude) FILTER (win AND dist <= 750) AS p_med
FROM q GROUP BY 1, 2""")


def biased(override: str = "CAST(NULL AS DOUBLE)", source: str = "'supplied'") -> str:
    return f"""
SELECT *, CASE WHEN max_vertical_rate > 50 THEN NULL WHEN {override} IS NOT NULL THEN {override} WHEN abs(raw_bias) > 500 THEN NULL ELSE raw_bias END AS bias,
  CASE WHEN max_vertical_rate > 50 THEN 'rate_conflict' WHEN {override} IS NOT NULL THEN {source} WHEN abs(raw_bias) > 500 THEN 'inconsistent'
  WHEN g_n >= 2 THEN 'observed_onground' WHEN p_n >= 2 THEN 'threshold_adjacent_proxy' ELSE 'unavailable' END AS bias_source
FROM (SELECT *, CASE WHEN g_n >= 2 THEN g_med WHEN p_n >= 2 THEN p_med END - elevation AS raw_bias FROM q JOIN meds USING (flight_id, cluster)"""


cte("bias", "q meds", biased() + ")")


def limits(source: str, env: str, speed_class: str = "'unknown'") -> str:
    """Rows with their envelope bounds, own class first."""
    return f"""
SELECT b.*, CASE WHEN o.bin IS NOT NULL THEN 'exact' WHEN u.bin IS NOT NULL THEN 'unknown_speed_class' END AS fallback,
  CASE WHEN o.bin IS NOT NULL THEN o.speed_lo ELSE u.speed_lo END AS speed_lo, CASE WHEN o.bin IS NOT NULL THEN o.speed_hi ELSE u.speed_hi END AS speed_hi,
  CASE WHEN o.bin IS NOT NULL THEN o.rate_lo ELSE u.rate_lo END AS rate_lo
FROM (SELECT *, CASE WHEN along >= 0 THEN {bins('along')} END AS bin, {speed_class} AS cls FROM {source}) b
LEFT JOIN {env} o ON o.direction = b.direction AND o.bin = b.bin AND o.speed_class = b.cls
LEFT JOIN {env} u ON u.direction = b.direction AND u.bin = b.bin AND u.speed_class = 'unknown'"""


cte("lim", "bias env", limits("bias", "env"))
H = "(baroaltitude - elevation - coalesce(bias, 0e0))"
D = f"({H} - 5.2407779283041196e-2 * greatest(along, 0e0))"
ROW_CRITERIA = {
    "lateral_path_proxy": ("abs(cross_m)", "greatest(150e0, along * 1e-1)", "along BETWEEN 0 AND 6000", "abs(cross_m) > greatest(150e0, along * 1e-1)"),
    "barometric_path_proxy": (D, f"CASE WHEN {D} >= 0 THEN 200e0 ELSE -120e0 END",
                              "bias IS NOT NULL AND baroaltitude IS NOT NULL AND along BETWEEN 0 AND 10000", f"({D} > 200 OR {D} < -120)"),
    "observed_descent_rate": ("vertrate", "rate_lo", "vertrate IS NOT NULL AND rate_lo IS NOT NULL", "vertrate < rate_lo"),
    "observed_ground_speed_envelope": ("velocity", "CASE WHEN velocity < speed_lo THEN speed_lo ELSE speed_hi END",
                                       "velocity IS NOT NULL AND speed_lo IS NOT NULL", "(velocity < speed_lo OR velocity > speed_hi)"),
    "late_track_correction": (turn("heading", "bearing"), "15e0", "heading IS NOT NULL AND velocity >= 30 AND along BETWEEN 0 AND 3000",
                              f"{turn('heading', 'bearing')} > 15"),
}
FIXED_DESCENT = ("vertrate", "-7.6e0", f"vertrate IS NOT NULL AND bias IS NOT NULL AND {H} <= 1000", "vertrate < -7.6e0")


def long_rows(source: str, criteria=None) -> str:
    parts = [f"SELECT flight_id, cluster, '{n}' AS criterion, ix, time, along, {v} AS value, {lim} AS lim, coalesce(win AND {ok}, FALSE) AS valid, "
             f"coalesce(win AND {ok} AND {bad}, FALSE) AS hit FROM {source}" for n, (v, lim, ok, bad) in (criteria or ROW_CRITERIA).items()]
    return " UNION ALL ".join(parts)


def spans(source: str) -> str:
    return f"""
SELECT flight_id, cluster, criterion, min(ix) AS start_idx, max(ix) AS end_idx, min(time) AS start_time, max(time) AS end_time,
  arg_max(ix, (abs(value - lim), -ix)) AS worst_idx, arg_max(time, (abs(value - lim), -ix)) AS worst_time, arg_max(value, (abs(value - lim), -ix)) AS value,
  arg_max(lim, (abs(value - lim), -ix)) AS lim, arg_max(along, (abs(value - lim), -ix)) AS along
FROM (SELECT *, ix - row_number() OVER (PARTITION BY flight_id, cluster, criterion ORDER BY ix) AS g FROM {source} WHERE hit)
GROUP BY flight_id, cluster, criterion, g HAVING count(*) >= 3 AND max(time) - min(time) >= 20"""


def crits(rows: str, sp: str) -> str:
    return f"""
SELECT l.flight_id, l.cluster, l.criterion, l.seen, CASE WHEN s.n > 0 THEN 'review_required' WHEN l.seen > 0 THEN 'within_limit' ELSE 'not_observed' END AS status
FROM (SELECT flight_id, cluster, criterion, count(*) FILTER (valid) AS seen FROM {rows} GROUP BY 1, 2, 3) l
LEFT JOIN (SELECT flight_id, cluster, criterion, count(*) AS n FROM {sp} GROUP BY 1, 2, 3) s USING (flight_id, cluster, criterion)"""


def assessed(rows: str, crit: str) -> str:
    return f"""
SELECT *, CASE WHEN reasons <> '' THEN 'not_assessable' WHEN failed <> '' THEN 'review_required' WHEN gaps > 0 THEN 'partial_observation' ELSE 'criteria_observed' END AS status,
  CASE WHEN NOT terminal THEN 'incomplete' WHEN oc = 'closest_approach' THEN 'final_gate_observed' ELSE oc END AS outcome,
  row_number() OVER (PARTITION BY flight_id ORDER BY cluster) AS attempt_no FROM (
SELECT a.*, concat_ws(',', CASE WHEN n_rows < 20 THEN 'insufficient_observations' END, CASE WHEN duration_s < 90 THEN 'insufficient_duration' END,
  CASE WHEN max_gap_s > 60 THEN 'approach_coverage_gap' END, CASE WHEN max_ground_speed > 400 THEN 'position_rate_conflict' END,
  CASE WHEN NOT terminal THEN 'terminal_gate_not_reached' END) AS reasons, c.failed, c.gaps, c.lateral_path_proxy, c.barometric_path_proxy,
  c.observed_descent_rate, c.observed_ground_speed_envelope, c.late_track_correction,
  CASE WHEN max_vertical_rate > 50 THEN 'altitude_rate_conflict' ELSE '' END AS advisories FROM (
SELECT flight_id, cluster, min(time) AS start_time, max(time) AS end_time, max(time) FILTER (win) AS criterion_end_time, count(*) AS observed_samples,
  min(dist) AS min_threshold_m, any_value(n_rows) AS n_rows, any_value(duration_s) AS duration_s, any_value(max_gap_s) AS max_gap_s,
  any_value(max_ground_speed) AS max_ground_speed, any_value(max_vertical_rate) AS max_vertical_rate, any_value(bias) AS bias, any_value(bias_source) AS bias_source,
  any_value(runway) AS runway, any_value(geometry_runway) AS geometry_runway, any_value(direction) AS direction, any_value(specificity) AS specificity,
  any_value(confidence) AS confidence, any_value(score_margin) AS score_margin, any_value(oc) AS oc, any_value(m_ix) AS m_ix,
  max(time) FILTER (ix = m_ix) AS maneuver_time, arg_max(along, time) AS last_along, any_value(bearing) AS bearing, any_value(elevation) AS elevation,
  any_value(frame_start) AS frame_start, any_value(frame_end) AS frame_end,
  coalesce(bool_or(win AND dist <= 6000 AND (baroaltitude IS NULL OR max_vertical_rate > 50 OR baroaltitude <= elevation + 800)), FALSE)
    OR any_value(oc) IN ('landing_observed', 'go_around', 'touch_and_go') AS terminal,
  coalesce(string_agg(DISTINCT fallback, ',' ORDER BY fallback) FILTER (win), '') AS fallbacks
FROM {rows} GROUP BY 1, 2) a JOIN (
SELECT flight_id, cluster, coalesce(string_agg(criterion, ',' ORDER BY CASE criterion WHEN 'lateral_path_proxy' THEN 0 WHEN 'barometric_path_proxy' THEN 1
  WHEN 'observed_descent_rate' THEN 2 WHEN 'observed_ground_speed_envelope' THEN 3 ELSE 4 END) FILTER (status = 'review_required'), '') AS failed,
  count(*) FILTER (status = 'not_observed') AS gaps, max(CASE WHEN criterion = 'lateral_path_proxy' THEN status END) AS lateral_path_proxy,
  max(CASE WHEN criterion = 'barometric_path_proxy' THEN status END) AS barometric_path_proxy, max(CASE WHEN criterion = 'observed_descent_rate' THEN status END) AS observed_descent_rate,
  max(CASE WHEN criterion = 'observed_ground_speed_envelope' THEN status END) AS observed_ground_speed_envelope,
  max(CASE WHEN criterion = 'late_track_correction' THEN status END) AS late_track_correction
FROM {crit} GROUP BY 1, 2) c USING (flight_id, cluster))"""


cte("crow", "lim", long_rows("lim"))
cte("span", "crow", spans("crow"))
cte("crit", "crow span", crits("crow", "span"))
cte("asd", "lim crit", assessed("lim", "crit"))
# assessed without a reference
cte("lim0", "bias", "SELECT *, NULL AS fallback, CAST(NULL AS DOUBLE) AS speed_lo, CAST(NULL AS DOUBLE) AS speed_hi FROM bias")
cte("crow0", "lim0", long_rows("lim0", ROW_CRITERIA | {"observed_descent_rate": FIXED_DESCENT}))
cte("span0", "crow0", spans("crow0"))
cte("crit0", "crow0 span0", crits("crow0", "span0"))
cte("asd0", "lim0 crit0", assessed("lim0", "crit0"))

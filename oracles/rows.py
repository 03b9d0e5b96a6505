"""SQL for projections, filters and de-duplication."""

from oracles.base import bins, closest, cte, frame, hav, pmod, query, r, turn
from oracles.phase import PHASE
from skyledger.config import LANDING_RUNWAYS
from skyledger.sources.derived import number

ORACLE: dict[str, str] = {}
O = ORACLE
K = "flight_id, time"

cte("rr", "obs rwy", f"SELECT *, {frame()} FROM obs, rwy")
cte("d0", "obs", f"SELECT *, {closest()} AS dist_to_runway_m, velocity * 3.6e0 AS velocity_kmh FROM obs")
cte("d21", "d0", f"SELECT *, {PHASE} AS flight_phase, 'unknown' AS operation FROM d0")


def segmented(source: str, gap: int) -> str:
    return (f"SELECT *, concat(flight_id, '#', CAST(seg AS VARCHAR)) AS segment_id FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {gap} THEN 1 ELSE 0 END) "
            f"OVER (PARTITION BY flight_id ORDER BY time) AS seg FROM (SELECT *, time - lag(time) OVER (PARTITION BY flight_id ORDER BY time) AS gap FROM {source}))")


cte("seg", "d21", segmented("d21", 60))
x = LANDING_RUNWAYS[0]
O["haversine_m"] = query(f"SELECT {K}, {r(hav('lat', 'lon', number(x.lat), number(x.lon)))} AS dist FROM obs", "obs")
O["dist_to_closest_runway"] = query(f"SELECT {K}, {r('dist_to_runway_m')} AS dist_to_runway_m FROM d0", "d0")
O["runway_relative"] = query(f"SELECT {K}, runway, {r('along')} AS along, {r('cross_m')} AS \"cross\", {r('dist')} AS dist FROM rr", "rr")
O["runway_relative_inverse"] = query(f"SELECT {K}, runway, {r('lat')} AS lat2, {r('lon')} AS lon2 FROM rr", "rr")
O["circular_difference"] = query(f"SELECT {K}, runway, {r(turn('heading', 'bearing'))} AS angle FROM rr", "rr")
O["signed_track_offset"] = query(f"SELECT {K}, runway, {r(pmod('heading - bearing + 180e0') + ' - 180e0')} AS \"offset\" FROM rr", "rr")
O["heading_change_wrapped"] = query(f"""SELECT {K}, {r('CASE WHEN c > 180 THEN 360 - c ELSE c END')} AS heading_change FROM (
SELECT {K}, abs(h - lag(h) OVER (PARTITION BY flight_id ORDER BY time)) AS c FROM (SELECT {K}, {pmod('heading + i * 37')} AS h FROM obs))""", "obs")
O["heading_components"] = query(f"""SELECT {K}, {r('CASE WHEN i % 3 = 0 THEN 0 ELSE sin(radians(heading)) END')} AS hdg_sin, {r('CASE WHEN i % 3 = 0 THEN 1 ELSE cos(radians(heading)) END')} AS hdg_cos,
{r('CASE WHEN i % 3 = 0 THEN 0 ELSE heading END')} AS heading FROM obs""", "obs")
O["derived_replay"] = query(f"SELECT {K}, {r('sin(radians(heading))')} AS hdg_sin, {r('cos(radians(heading))')} AS hdg_cos, {r('dist_to_runway_m')} AS dist_to_runway_m FROM d0", "d0")
O["velocity_kmh"] = query(f"SELECT {K}, {r('velocity * 3.6e0')} AS velocity_kmh FROM obs", "obs")
O["time_utc"] = query(f"SELECT {K}, strftime(make_timestamp(CAST(time * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS time_utc FROM obs", "obs")
O["flight_phase"] = query(f"SELECT {K}, flight_phase FROM d21", "d21")
O["enu_offsets"] = query(f"SELECT {K}, {r('(lon - -3.5626e0) * 111320e0 * cos(radians(lat))')} AS east, {r('(lat - 40.4719e0) * 111320e0')} AS north FROM obs", "obs")
O["time_of_day_cyclic"] = query(f"SELECT {K}, {r('sin((time % 86400 // 3600) * 2 * pi() / 24)')} AS tod_sin, {r('cos((time % 86400 // 3600) * 2 * pi() / 24)')} AS tod_cos FROM obs", "obs")


def lerp(source: str, cols: list[str], keys: str = "flight_id", time: str = "time") -> str:
    """Rows of source with cols filled linearly between observed rows and with the nearest value outside."""
    w = f"PARTITION BY {keys} ORDER BY {time}"
    back, ahead = f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    grp = ", ".join(f"max(CASE WHEN {c} IS NOT NULL THEN {time} END) {back} AS pt_{c}, min(CASE WHEN {c} IS NOT NULL THEN {time} END) {ahead} AS nt_{c}" for c in cols)
    vals = ", ".join(f"max({c}) OVER (PARTITION BY {keys}, pt_{c}) AS pv0_{c}" for c in cols)
    out = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN pt_{c} IS NOT NULL AND nt_{c} IS NOT NULL THEN pv_{c} + (nv_{c} - pv_{c}) * ({time} - pt_{c}) / (nt_{c} - pt_{c}) "
                    f"WHEN pt_{c} IS NOT NULL THEN pv_{c} ELSE nv_{c} END AS {c}" for c in cols)
    pv = ", ".join(f"max(CASE WHEN {time} = pt_{c} THEN {c} END) OVER (PARTITION BY {keys}, pt_{c}) AS pv_{c}, max(CASE WHEN {time} = nt_{c} THEN {c} END) OVER (PARTITION BY {keys}, nt_{c}) AS nv_{c}" for c in cols)
    del vals
    drop = ", ".join(cols)
    extra = ", ".join(f"pt_{c}, nt_{c}, pv_{c}, nv_{c}" for c in cols)
    return f"SELECT * EXCLUDE ({drop}, {extra}), {out} FROM (SELECT *, {pv} FROM (SELECT *, {grp} FROM ({source})))"


O["altitude_fallback"] = query(f"SELECT {K}, {r('alt')} AS alt FROM ({lerp('SELECT flight_id, time, coalesce(baroaltitude, geoaltitude) AS alt FROM obs', ['alt'])})", "obs")
O["height_above_threshold"] = query(f"SELECT {K}, runway, {r('baroaltitude - elevation')} AS height FROM rr", "rr")
O["distance_bin"] = query(f"SELECT {K}, runway, {bins('along')} AS bin FROM rr", "rr")
MASK = "i % 4 NOT IN (0, 1)"
O["observed_mask"] = query(f"SELECT {K}, velocity IS NOT NULL AND {MASK} AS seen_velocity, baroaltitude IS NOT NULL AS seen_baroaltitude, FALSE AS seen_spoiler FROM obs", "obs")
O["usable_track"] = query(f"SELECT {K}, coalesce(velocity IS NOT NULL AND {MASK} AND velocity >= 30, FALSE) AS usable FROM obs", "obs")
A = f"radians({pmod('wind_from_deg - bearing')})"
O["wind_components"] = query(f"SELECT observed_at, runway, {r(f'wind_speed * cos({A})')} AS headwind, {r(f'wind_speed * sin({A})')} AS crosswind FROM wx, rwy", "wx", "rwy")
B = "(1013.25e0 - (qnh_hpa - h % 90)) * 9.144e0"
O["qnh_bias"] = query(f"SELECT observed_at, {r(B)} AS bias, {r(f'CASE WHEN abs({B}) <= 500 THEN {B} END')} AS usable_bias FROM wx", "wx")
cte("segn", "obs", "SELECT DISTINCT concat(flight_id, '#', CAST(1 + i // 40 AS VARCHAR)) AS segment_id FROM obs")
O["operation_key"] = query("SELECT segment_id, split_part(segment_id, '#', 1) AS operation_key FROM segn", "segn")
O["operation_ref"] = query("SELECT segment_id, concat('OP-', replace(upper(split_part(segment_id, '#', 1)), '_', '-')) AS operation_ref FROM segn", "segn")


def b32(digest: str, n_bytes: int) -> str:
    """Base 32 of the leading bytes, from the hex digits two and a half at a time."""
    hexes = n_bytes * 2
    groups = -(-n_bytes * 8 // 5)
    parts = []
    for g in range(groups):
        bit = g * 5
        first, last = bit // 4, (bit + 4) // 4
        def digit(i):
            return f"(strpos('0123456789abcdef', substring({digest}, {i + 1}, 1)) - 1)" if i < hexes else "0"
        value = f"({digit(first)} * 16 + {digit(last)})"
        shift = 8 - (bit % 4) - 5
        parts.append(f"substring('abcdefghijklmnopqrstuvwxyz234567', CAST(({value} // {2 ** shift}) % 32 AS BIGINT) + 1, 1)")
    return "concat(" + ", ".join(parts) + ")"


O["case_identity"] = query(f"SELECT segment_id, digest, concat('c_', {b32('digest', 10)}) AS case_id, concat('CASE-', upper({b32('digest', 8)})) AS case_ref FROM (SELECT segment_id, sha256(segment_id) AS digest FROM segn)", "segn")
BAND = "CASE WHEN pct >= 95 THEN 'highly anomalous' WHEN pct >= 80 THEN 'elevated' WHEN pct >= 50 THEN 'upper-normal' ELSE 'normal range' END"
O["severity_band"] = query(f"SELECT *, {BAND} AS band FROM (SELECT {K}, CAST((k * 7 + i * 13) % 101 AS DOUBLE) AS pct FROM obs)", "obs")
O["scale_unscale"] = query(f"""SELECT {K}, {r('(baroaltitude - ma) / sa')} AS z_baroaltitude, {r('(velocity - mv) / sv')} AS z_velocity, {r('baroaltitude')} AS u_baroaltitude, {r('velocity')} AS u_velocity
FROM (SELECT *, avg(baroaltitude) OVER () AS ma, stddev_pop(baroaltitude) OVER () AS sa, avg(velocity) OVER () AS mv, stddev_pop(velocity) OVER () AS sv FROM obs WHERE velocity IS NOT NULL AND baroaltitude IS NOT NULL AND vertrate IS NOT NULL)""", "obs")

O["filter_bbox"] = query(f"SELECT {K}, {r('lat')} AS lat, {r('lon')} AS lon FROM (SELECT {K}, lat + (k % 9 - 4) * 0.6e0 AS lat, lon + (k % 7 - 3) * 0.8e0 AS lon FROM obs) WHERE lat BETWEEN 40.4719e0 - 1.8e0 AND 40.4719e0 + 1.8e0 AND lon BETWEEN -3.5626e0 - 1.8e0 AND -3.5626e0 + 1.8e0", "obs")
O["filter_radius"] = query(f"SELECT {K}, {r('d')} AS dist_to_runway_m FROM (SELECT {K}, lat, lon, {closest()} AS d FROM (SELECT {K}, lat + (k % 9 - 4) * 0.6e0 AS lat, lon FROM obs)) WHERE d <= 150000 AND lat BETWEEN 40.4719e0 - 1.8e0 AND 40.4719e0 + 1.8e0", "obs")
O["filter_canonical_positions"] = query(f"SELECT {K}, {r('lat')} AS lat, {r('lon')} AS lon FROM obs WHERE i % 11 <> 3 AND i % 13 <> 5 AND i % 17 <> 6", "obs")
O["filter_b"] = query(f"SELECT {K} FROM d21 WHERE flight_id IN (SELECT flight_id FROM d21 GROUP BY 1 HAVING min(dist_to_runway_m) < 10000 AND min(baroaltitude) < 3000)", "d21")
cte("ends", "d21", """
SELECT flight_id, count(*) AS n_rows, min(dist_to_runway_m) AS min_dist, min(baroaltitude) AS min_alt,
  coalesce(string_agg(DISTINCT flight_phase, ',' ORDER BY flight_phase) FILTER (s), '') AS start_phase_set, min(dist_to_runway_m) FILTER (s) AS start_min_dist, min(baroaltitude) FILTER (s) AS start_min_alt, bool_or(s AND onground) AS start_any_onground,
  coalesce(string_agg(DISTINCT flight_phase, ',' ORDER BY flight_phase) FILTER (e), '') AS end_phase_set, min(dist_to_runway_m) FILTER (e) AS end_min_dist, min(baroaltitude) FILTER (e) AS end_min_alt, bool_or(e AND onground) AS end_any_onground,
  arg_min(flight_phase, time) AS first_phase, arg_max(flight_phase, time) AS last_phase
FROM (SELECT *, rn <= 5 AS s, rn > n - 5 AS e FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY time) AS rn, count(*) OVER (PARTITION BY flight_id) AS n FROM d21)) GROUP BY 1""")


def near(d, a):
    return (f"(coalesce(contains(end_phase_set, 'approach') AND end_min_dist < {d} AND end_min_alt < {a}, FALSE) OR "
            f"coalesce(contains(start_phase_set, 'takeoff') AND start_min_dist < {d} AND start_min_alt < {a}, FALSE))")


G = "(start_any_onground OR end_any_onground)"
O["filter_c"] = query(f"SELECT flight_id, {G} AS pass_c1, {G} OR {near(2000, 1000)} AS pass_c2, {G} OR {near(5000, 1500)} AS pass_c3 FROM ends", "ends")
ENG = {"by_approach": "coalesce(flight_phase = 'approach' AND dist_to_runway_m < 10000, FALSE)", "by_onground": "coalesce(onground AND dist_to_runway_m < 5000, FALSE)",
       "by_takeoff": "coalesce(flight_phase = 'takeoff' AND dist_to_runway_m < 5000 AND baroaltitude < 2000, FALSE)"}
ANY = "(" + " OR ".join(ENG.values()) + ")"
O["filter_d"] = query(f"SELECT segment_id, time FROM (SELECT *, bool_or({ANY}) OVER (PARTITION BY flight_id) AS f, bool_or({ANY}) OVER (PARTITION BY segment_id) AS s FROM seg) WHERE f AND s", "seg")
O["filter_min_length"] = query("SELECT segment_id, time, n AS n_steps FROM (SELECT *, count(*) OVER (PARTITION BY segment_id) AS n FROM seg) WHERE n >= 30", "seg")
O["filter_stale_contact"] = query(f"SELECT {K}, lastcontact FROM obs WHERE time - lastcontact <= 15", "obs")
cte("fold", "seg", "SELECT flight_id, segment_id, CASE WHEN y <= 2018 THEN 'train' WHEN y = 2019 THEN 'val' ELSE 'test' END AS fold FROM (SELECT flight_id, segment_id, year(make_timestamp(CAST(min(time) * 1000000 AS BIGINT))) AS y FROM seg GROUP BY 1, 2)")
O["filter_ids"] = query("SELECT segment_id, time FROM seg WHERE segment_id IN (SELECT segment_id FROM fold WHERE fold = 'val')", "fold")
O["cohort_operations"] = query(f"SELECT {K} FROM obs WHERE flight_id IN (SELECT flight_id FROM fold WHERE fold = 'train')", "fold")
O["cohort_first_operations"] = query(f"SELECT {K} FROM obs WHERE flight_id IN (SELECT DISTINCT flight_id FROM fold WHERE fold = 'train' ORDER BY flight_id LIMIT 25)", "fold")
O["fold_semi"] = query("SELECT flight_id, count(*) AS n_rows FROM obs WHERE flight_id IN (SELECT flight_id FROM fold WHERE fold = 'test') GROUP BY 1", "fold")
O["identity_gate"] = query("SELECT CASE WHEN r.icao24 IS NOT NULL THEN 'CLEARED' ELSE 'UNIDENTIFIED' END AS status, count(DISTINCT o.flight_id) AS flights, count(*) AS n_rows FROM obs o LEFT JOIN reg r ON o.icao24 = r.icao24 GROUP BY 1", "reg")
O["airport_association"] = query("SELECT count(*) FILTER (k % 3 = 0 OR k % 4 = 0 OR k % 5 = 0 OR k % 11 = 0) AS associated, count(*) FILTER (k % 4 = 0 OR k % 5 = 0) AS arriving, count(*) FILTER (k % 3 = 0) AS departing, count(*) FILTER (k % 11 = 0) AS diverted_to FROM (SELECT DISTINCT k FROM obs)", "obs")
O["radius_ladder"] = query("SELECT CAST(rad AS VARCHAR) AS radius_km, count(*) FILTER (d < rad * 1000) AS flights FROM (SELECT flight_id, min(dist_to_runway_m) AS d FROM d21 GROUP BY 1), (SELECT unnest([10, 30, 50, 100, 200]) AS rad) GROUP BY rad", "d21")
cte("wild", "seg", """SELECT * REPLACE (CASE WHEN (k + i) % 29 = 0 THEN 450e0 WHEN (k + i) % 31 = 0 THEN 0e0 ELSE velocity END AS velocity,
  CASE WHEN (k + i) % 37 = 0 THEN -60e0 ELSE vertrate END AS vertrate, CASE WHEN (k + i) % 43 = 0 THEN 17000e0 WHEN (k + i) % 47 = 0 THEN -150e0 ELSE baroaltitude END AS baroaltitude) FROM seg""")
O["flag_impossible"] = query(f"""SELECT segment_id, time, {r('CASE WHEN abs(velocity) > 400 OR (velocity = 0 AND baroaltitude > 1000) THEN NULL ELSE velocity END')} AS velocity,
{r('CASE WHEN abs(vertrate) > 50 THEN NULL ELSE vertrate END')} AS vertrate, {r('CASE WHEN baroaltitude > 16000 OR baroaltitude < -100 THEN NULL ELSE baroaltitude END')} AS baroaltitude,
coalesce(abs(velocity) > 400, FALSE) AS imp_velocity, coalesce(abs(vertrate) > 50, FALSE) AS imp_vertrate, coalesce(baroaltitude > 16000 OR baroaltitude < -100, FALSE) AS imp_baroaltitude FROM wild""", "wild")
O["plausible_values"] = query("SELECT count(*) FILTER (velocity BETWEEN 0 AND 150) AS speed_samples, count(*) FILTER (abs(vertrate) <= 25) AS rate_samples FROM wild", "wild")
O["geo_subset"] = query("SELECT count(*) AS n_rows, count(DISTINCT flight_id) AS flights FROM wild WHERE lat < 40.45e0 AND lon > -3.55e0", "wild")
O["envelope_outliers"] = query("SELECT count(*) FILTER (velocity < 80 AND baroaltitude > 1000) AS slow_high, count(*) FILTER (velocity > 280 AND baroaltitude < 3000) AS fast_low, count(*) FILTER (baroaltitude > 16000) AS too_high FROM wild", "wild")
LOW, TINY = "baroaltitude < 1500 AND velocity < 51", "baroaltitude < 620 AND velocity < 15"
O["low_slow_subset"] = query(f"SELECT count(*) FILTER ({LOW}) AS rows_low, count(DISTINCT icao24) FILTER ({LOW}) AS aircraft_low, count(*) FILTER ({TINY}) AS rows_tiny, count(DISTINCT icao24) FILTER ({TINY}) AS aircraft_tiny FROM wild", "wild")

O["dedupe_flight_time"] = query(f"""SELECT flight_id, t AS time, {r('velocity')} AS velocity, {r('lat')} AS lat FROM (SELECT *, row_number() OVER (PARTITION BY flight_id, t ORDER BY lat, lon, baroaltitude NULLS FIRST, velocity NULLS FIRST) AS rn
FROM (SELECT *, CAST(round_even(time + 0.5e0 * (i % 2), 0) AS BIGINT) AS t FROM raw)) WHERE rn = 1""", "raw")
O["dedupe_observations"] = query(f"SELECT {K}, {r('lat')} AS lat, {r('velocity')} AS velocity FROM (SELECT *, row_number() OVER (PARTITION BY flight_id, time ORDER BY lat, lon, baroaltitude NULLS FIRST, velocity NULLS FIRST) AS rn FROM raw) WHERE rn = 1", "raw")
cte("rc", "raw", "SELECT k, i, flight_id, time, lat, lon, velocity, count(*) AS copies FROM raw GROUP BY 1, 2, 3, 4, 5, 6, 7")
O["duplicate_profile"] = query("""SELECT *, CASE WHEN cause = 'full_row' THEN 'fail' WHEN cause IS NOT NULL THEN 'review' ELSE 'pass' END AS verdict FROM (SELECT *, max_by(key_set, CASE WHEN extra_rows > 0 THEN list_position(['flight_time', 'flight_time_position', 'full_row'], key_set) END) OVER () AS cause FROM (SELECT 'flight_time' AS key_set, CAST(count(*) - count(DISTINCT (flight_id, time)) AS BIGINT) AS extra_rows FROM raw
UNION ALL SELECT 'flight_time_position', CAST(count(*) - count(DISTINCT (flight_id, time, lat, lon)) AS BIGINT) FROM raw UNION ALL SELECT 'full_row', CAST(sum(copies - 1) AS BIGINT) FROM rc))""", "rc")
O["duplicate_multiplicity"] = query("SELECT copies, count(*) AS unique_rows, CAST(sum(copies) AS BIGINT) AS instances FROM rc GROUP BY 1", "rc")
O["most_repeated_row"] = query(f"SELECT flight_id, time, icao24, {', '.join(f'{r(c)} AS {c}' for c in ('lat', 'lon', 'baroaltitude', 'velocity'))}, copies FROM (SELECT flight_id, time, icao24, lat, lon, baroaltitude, velocity, count(*) AS copies FROM raw GROUP BY ALL HAVING count(*) > 1 ORDER BY copies DESC, flight_id, time LIMIT 3)", "raw")
O["duplicates_by_day"] = query("SELECT time // 86400 AS day, CAST(sum(copies - 1) AS BIGINT) AS extras, CAST(sum(copies) AS BIGINT) AS total FROM rc GROUP BY 1", "rc")
O["dedupe_full_rows"] = query("SELECT CAST(sum(copies) AS BIGINT) AS before, count(*) AS after FROM rc", "rc")

"""SQL for folds, labelled data, metrics and the queue."""

from oracles.base import closest, cte, hav, pmod, query, r
from oracles.rows import BAND, b32
from oracles.sequences import MISS
import math

from skyledger.config import FEATURES, FOLD_DATES, INJECTION_MIX, LEGACY_POINTS, MEASURED, SCALED
from skyledger.operators.inject import COMPARISON_KINDS
from skyledger.sources.derived import number

ORACLE: dict[str, str] = {}
O = ORACLE
W = "PARTITION BY segment_id ORDER BY time"

cte("lowc", "clean", "SELECT * REPLACE (baroaltitude - 580e0 AS baroaltitude) FROM clean")
cte("air", "lowc", f"""SELECT *, row_number() OVER (PARTITION BY segment_id, run ORDER BY time) AS j, count(*) OVER (PARTITION BY segment_id) AS n_air FROM (
SELECT *, sum(CASE WHEN onground THEN 1 ELSE 0 END) OVER ({W}) AS run FROM lowc) WHERE NOT onground""")
cte("lows", "air", "SELECT segment_id, run, arg_min(j, (baroaltitude, j)) AS lj, min(baroaltitude) AS la FROM air WHERE dist_to_runway_m < 5000 GROUP BY 1, 2")
cte("ga", "lowc air lows", """SELECT s.segment_id, coalesce(bool_or(hit), FALSE) AS is_go_around FROM (SELECT DISTINCT segment_id FROM lowc) s LEFT JOIN (
SELECT a.segment_id, a.run, any_value(n_air) >= 5 AND any_value(la) < 500 AND coalesce(max(baroaltitude) FILTER (j < lj) - any_value(la) >= 300, FALSE) AND coalesce(max(baroaltitude) FILTER (j > lj) - any_value(la) >= 300, FALSE) AS hit
FROM air a JOIN lows l ON a.segment_id = l.segment_id AND a.run = l.run GROUP BY 1, 2) h USING (segment_id) GROUP BY 1""")
O["detect_go_around"] = query("SELECT * FROM ga", "ga")


def facts(source: str) -> str:
    return f"""SELECT segment_id, max(total) AS n_steps, count(*) FILTER (NOT ({MISS})) AS valid_steps, count(*) AS window_steps, coalesce(max(jump), 0e0) AS mj, coalesce(max(jump / dt), 0e0) AS mv, coalesce(max(mv0 / dt), 0e0) AS mg,
bool_or(dist_to_runway_m < 5000 AND baroaltitude < 1500) AS terminal_op FROM (SELECT *, time - lag(time) OVER w AS dt, abs(baroaltitude - lag(baroaltitude) OVER w) AS jump, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS mv0, row_number() OVER w AS st, count(*) OVER (PARTITION BY segment_id) AS total
FROM {source} WINDOW w AS ({W})) WHERE st <= 15 GROUP BY 1"""


def states(source: str) -> str:
    return f"""SELECT *, CASE WHEN valid_steps < 10 THEN 'insufficient_data' WHEN mv > 50 OR mg > 400 THEN 'data_quality_conflict' WHEN NOT terminal_op THEN 'coverage_limited' ELSE 'reviewable' END AS assessment_state,
CASE WHEN valid_steps < 10 OR mv > 50 OR mg > 400 THEN 'data_quality' WHEN NOT terminal_op THEN 'coverage' ELSE 'behavioral' END AS review_lane, n_steps > 15 AS truncated,
concat_ws(',', CASE WHEN valid_steps < 10 THEN 'insufficient_observations' END, CASE WHEN mv > 50 THEN 'altitude_rate_conflict' END, CASE WHEN mg > 400 THEN 'position_rate_conflict' END,
CASE WHEN NOT terminal_op AND n_steps > 15 THEN 'terminal_phase_not_scored' WHEN NOT terminal_op THEN 'nonterminal_window' END) AS data_quality_flags FROM ({facts(source)})"""


O["terminal_window"] = query(f"SELECT segment_id, terminal_op FROM ({facts('clean')})", "clean")
cte("jumpy", "clean", "SELECT * REPLACE (CASE WHEN flight_id LIKE '%7' AND time % 7 = 0 THEN baroaltitude + 900 ELSE baroaltitude END AS baroaltitude) FROM clean")
O["assess_segment"] = query(f"""SELECT segment_id, n_steps, valid_steps, window_steps, {r('round(mj, 1)', 6)} AS max_altitude_jump_m, {r('round(mv, 1)', 6)} AS max_vertical_rate, {r('round(mg, 1)', 6)} AS max_ground_speed, terminal_op, truncated, data_quality_flags,
assessment_state, review_lane, CASE WHEN assessment_state = 'reviewable' THEN 'reviewable' ELSE 'not_assessable' END AS behavioral_verdict, {r('round(CAST(valid_steps AS DOUBLE) / window_steps, 4)', 6)} AS observed_fraction FROM ({states('jumpy')})""", "jumpy")

DATE = "strftime(make_timestamp(CAST(min(time) * 1000000 AS BIGINT)), '%Y-%m-%d')"
cte("meta", "clean ga", f"SELECT segment_id, {DATE} AS date, min(icao24) AS icao24, bool_or(is_emergency) AS is_emergency, max(n_imputed_impossible) AS n_imputed_impossible, bool_or(is_go_around) AS is_go_around FROM clean JOIN ga USING (segment_id) GROUP BY 1")
O["segment_date"] = query("SELECT segment_id, date FROM meta", "meta")
O["per_segment_meta"] = query("SELECT * FROM meta", "meta")
HELD = "(is_emergency OR is_go_around OR n_imputed_impossible > 0)"
cte("split", "meta", f"SELECT *, CASE WHEN {HELD} THEN 'held_aside' ELSE block END AS fold FROM (SELECT *, CASE WHEN CAST(substring(date, 1, 4) AS INTEGER) <= 2018 THEN 'train' WHEN CAST(substring(date, 1, 4) AS INTEGER) = 2019 THEN 'val' ELSE 'test' END AS block FROM meta)")
O["temporal_split"] = query("SELECT segment_id, fold, block FROM split", "split")
INDATE = " ".join("WHEN date IN (" + ", ".join(f"'{d}'" for d in ds) + f") THEN '{f}'" for f, ds in FOLD_DATES.items())
O["temporal_split_published"] = query(f"SELECT CASE WHEN block = 'unmapped' THEN block WHEN {HELD} THEN 'held_aside' ELSE block END AS fold, block, count(*) AS segments FROM (SELECT *, CASE {INDATE} ELSE 'unmapped' END AS block FROM meta) GROUP BY 1, 2", "meta")


def hu(*parts) -> str:
    return f"(CAST(concat('0x', substring(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT) / 4294967296e0)"


U = hu("segment_id", "'42'")
O["random_split"] = query(f"SELECT segment_id, CASE WHEN {U} < 0.8 THEN 'train' WHEN {U} < 0.9 THEN 'val' ELSE 'test' END AS fold FROM meta", "meta")
O["fold_overlap"] = query("""SELECT count(*) FILTER (t AND v) AS train_val, count(*) FILTER (t AND s) AS train_test, count(*) FILTER (v AND s) AS val_test, count(*) FILTER (t AND v AND s) AS all_three FROM (
SELECT icao24, bool_or(fold = 'train') AS t, bool_or(fold = 'val') AS v, bool_or(fold = 'test') AS s FROM split WHERE fold <> 'held_aside' GROUP BY 1)""", "split")
O["firewall_checks"] = query("""SELECT 'identifier_feature' AS problem, 'icao24' AS item UNION ALL SELECT 'train_or_val_not_before_test', a FROM (SELECT max(CASE WHEN block = 'val' AND is_emergency THEN '2999-01-01' ELSE date END) FILTER (block IN ('train', 'val')) AS a, min(date) FILTER (block = 'test') AS b FROM split) WHERE a >= b""", "split")
O["relabel_anomaly"] = query("SELECT segment_id, CASE WHEN is_emergency THEN 'emergency' WHEN is_go_around THEN 'go_around' ELSE 'normal' END AS label FROM meta", "meta")


# ---- labelled data ----
def kind_case(rate: float) -> str:
    draw, edge, text = hu("segment_id", "'42'", "'kind'"), 0.0, ""
    for name, w in INJECTION_MIX[:-1]:
        edge += w
        text += f" WHEN {draw} < {round(edge, 9)!r} THEN '{name}'"
    return f"CASE WHEN NOT {hu('segment_id', chr(39) + '42' + chr(39), chr(39) + 'rate' + chr(39))} < {rate} THEN 'normal'{text} ELSE '{INJECTION_MIX[-1][0]}' END"


cte("kinds", "meta", f"SELECT segment_id, {kind_case(0.5)} AS kind FROM meta")
O["assign_kinds"] = query("SELECT * FROM kinds", "kinds")


def onset(source: str) -> str:
    return f"""SELECT *, CASE WHEN onset >= n - 1 THEN CASE WHEN step >= n - 1 THEN 1e0 ELSE 0e0 END WHEN step < onset THEN 0e0 ELSE CAST(step - onset AS DOUBLE) / (n - 1 - onset) END AS ramp FROM (
SELECT *, least(greatest(CAST(round_even(least(n, 15) * 0.5e0, 0) AS BIGINT), 0), greatest(least(n, 15) - 1, 0)) AS onset FROM (SELECT *, row_number() OVER ({W}) - 1 AS step, count(*) OVER (PARTITION BY segment_id) AS n FROM {source}))"""


cte("ev0", "clean meta", f"SELECT * FROM clean JOIN (SELECT segment_id, {kind_case(1.0)} AS kind FROM meta) USING (segment_id)")
cte("ev1", "ev0", f"SELECT *, max(CASE WHEN step = onset THEN lat END) OVER (PARTITION BY segment_id) AS lat0, max(CASE WHEN step = onset THEN lon END) OVER (PARTITION BY segment_id) AS lon0 FROM ({onset('ev0')})")
S = "'42'"


def un(purpose: str, lo: float, hi: float, per_row: bool = False) -> str:
    parts = ["segment_id", "kind", S, f"'{purpose}'"] + (["CAST(step AS VARCHAR)"] if per_row else [])
    return f"({number(lo)} + {number(hi - lo)} * {hu(*parts)})"


TWO_PI = 6.283185307179586


def nrm(purpose: str) -> str:
    return f"(sqrt(-2e0 * ln(1e0 - {un(purpose + '_r', 0, 1, True)})) * cos({un(purpose + '_a', 0, TWO_PI, True)}) * 30e0)"


cte("ev2", "ev1", f"""SELECT *, step >= onset AS aft, {un('mag', 1000, 3000)} AS mag, {un('bearing', 0, TWO_PI)} AS brg,
CASE WHEN {un('sign', 0, 1)} < 0.7e0 THEN {un('up', 200, 1500)} ELSE -{un('down', 50, 100)} END * ramp AS climb, {un('target', 50, 300)} AS tgt, {un('factor', 1.5, 2)} AS fac FROM ev1""")
PTS = list(LEGACY_POINTS.values())
D2 = [f"(pow(lat0 - {number(a)}, 2) + pow(lon0 - {number(b)}, 2))" for a, b in PTS]
NEAR = "least(" + ", ".join(D2) + ")"
GLAT = "CASE " + " ".join(f"WHEN {d} = {NEAR} THEN {number(p[0])}" for d, p in zip(D2, PTS)) + " END"
GLON = "CASE " + " ".join(f"WHEN {d} = {NEAR} THEN {number(p[1])}" for d, p in zip(D2, PTS)) + " END"
cte("ev3", "ev2", f"SELECT *, coalesce(climb - lag(climb) OVER ({W}), 0e0) / 10 AS crate, {GLAT} AS glat, {GLON} AS glon FROM ev2")
M = "111320e0"
HLD = "kind = 'sustained_loiter' AND aft"
cte("inj", "ev3", f"""SELECT segment_id, kind, step, onset, lat AS b_lat, lon AS b_lon, baroaltitude AS b_alt, velocity AS b_vel, vertrate AS b_vr,
CASE WHEN kind = 'zone_violation' THEN lat + cos(brg) * mag * ramp / {M} WHEN {HLD} THEN lat0 + {nrm('north')} / {M} WHEN kind = 'final_approach_intercept' THEN lat + (glat - lat) * ramp ELSE lat END AS lat,
CASE WHEN kind = 'zone_violation' THEN lon + sin(brg) * mag * ramp / ({M} * cos(radians(lat))) WHEN {HLD} THEN lon0 + {nrm('east')} / ({M} * cos(radians(lat0))) WHEN kind = 'final_approach_intercept' THEN lon + (glon - lon) * ramp ELSE lon END AS lon,
CASE WHEN kind = 'altitude_high' THEN baroaltitude + climb WHEN kind = 'final_approach_intercept' THEN baroaltitude + (tgt - baroaltitude) * ramp ELSE baroaltitude END AS baroaltitude,
CASE WHEN {HLD} THEN {un('slow', 0, 2, True)} WHEN kind = 'speed_spike' AND step = onset THEN greatest(velocity * fac, 0e0) ELSE velocity END AS velocity,
CASE WHEN kind = 'altitude_high' THEN vertrate + crate WHEN {HLD} THEN 0e0 ELSE vertrate END AS vertrate,
CASE WHEN kind IN ('altitude_high', 'sustained_loiter', 'final_approach_intercept') AND aft THEN FALSE ELSE onground END AS onground,
CASE WHEN kind <> 'normal' AND aft THEN FALSE ELSE velocity_missing END AS velocity_missing FROM ev3""")
FIVE = (("lat", "b_lat"), ("lon", "b_lon"), ("baroaltitude", "b_alt"), ("velocity", "b_vel"), ("vertrate", "b_vr"))
O["inject_anomalies"] = query("SELECT segment_id, kind, step, onset, onground, velocity_missing, " + ", ".join(f"{r(c)} AS {c}" for c, _ in FIVE) + f", {r(closest())} AS dist_to_runway_m FROM inj", "inj")
O["inject_blend"] = query("SELECT segment_id, kind, step, " + ", ".join(f"{r(f'{b} + 0.4e0 * ({c} - {b})')} AS {c}" for c, b in FIVE) + " FROM inj", "inj")
cte("evs", "clean kinds split", "SELECT c.*, k.kind FROM clean c JOIN kinds k USING (segment_id) WHERE segment_id IN (SELECT segment_id FROM split WHERE fold IN ('val', 'test'))")
O["make_eval_set"] = query(f"SELECT segment_id, kind, CASE WHEN kind = 'normal' THEN 0 ELSE 1 END AS label, onset, count(*) AS n_rows FROM ({onset('evs')}) GROUP BY 1, 2, 3, 4", "evs")
cte("cmp0", "clean", "SELECT *, 'comparison' AS kind FROM clean")
AT = ", ".join(f"max(CASE WHEN step = onset THEN {c} END) OVER (PARTITION BY segment_id) AS o_{c}" for c in MEASURED)
cte("cmp", "cmp0", f"SELECT *, step >= onset AS aft, {un('route', 0, TWO_PI)} AS brg, CASE WHEN {un('altitude', 0, 1)} < 0.5e0 THEN -1e0 ELSE 1e0 END AS sgn, {AT} FROM ({onset('cmp0')})")


def comparison(kind: str, size: float) -> str:
    cols = {c: c for c in ("lat", "lon", "baroaltitude", "velocity", "vertrate")}
    src, s = "cmp", number(size)
    if kind == "route":
        cols |= {"lat": f"lat + cos(brg) * {s} * ramp / {M}", "lon": f"lon + sin(brg) * {s} * ramp / ({M} * cos(radians(lat)))"}
    elif kind == "altitude":
        cols |= {"baroaltitude": f"baroaltitude + sgn * {s} * ramp", "vertrate": "vertrate + dv"}
        src = f"(SELECT *, coalesce(sgn * {s} * ramp - lag(sgn * {s} * ramp) OVER ({W}), 0e0) / 10 AS dv FROM cmp)"
    elif kind == "speed":
        cols |= {"velocity": f"CASE WHEN aft THEN greatest(velocity * {s}, 0e0) ELSE velocity END"}
    elif kind == "holding":
        h = f"radians(o_heading) + {number(TWO_PI / size)} * (step - 1 - onset) * 10"
        src = f"(SELECT *, coalesce(sum(CASE WHEN step > onset THEN o_velocity * 10 * sin({h}) END) OVER ({W}), 0e0) AS e, coalesce(sum(CASE WHEN step > onset THEN o_velocity * 10 * cos({h}) END) OVER ({W}), 0e0) AS nn FROM cmp)"
        cols |= {"lat": f"CASE WHEN aft THEN o_lat + nn / {M} ELSE lat END", "lon": f"CASE WHEN aft THEN o_lon + e / ({M} * cos(radians(o_lat))) ELSE lon END", "vertrate": "CASE WHEN aft THEN 0e0 ELSE vertrate END"}
    else:
        cols = {c: f"CASE WHEN aft THEN o_{c} ELSE {c} END" for c in cols}
    return f"SELECT '{kind}:{int(size * 10)}' AS variant, segment_id, " + ", ".join(f"{r(f'avg({e})')} AS {c}" for c, e in cols.items()) + f" FROM {src} GROUP BY 2"


O["inject_comparison_kinds"] = query(" UNION ALL ".join(comparison(k, s) for k, s in COMPARISON_KINDS), "cmp")
SK = f"['altitude', 'speed', 'hovering', 'zone_violation'][CAST(floor({hu('segment_id', S, chr(39) + 'simple' + chr(39))} * 4) AS BIGINT) + 1]"
MID = "step >= n // 2 AND step < n // 2 + 5"
O["inject_simple_kinds"] = query(f"""SELECT concat(segment_id, '_anom') AS segment_id, kind, step, {r("CASE WHEN kind = 'altitude' THEN z_baroaltitude + 3 ELSE z_baroaltitude END")} AS z_baroaltitude,
{r(f"CASE WHEN kind = 'speed' AND {MID} THEN z_velocity * 3 WHEN kind = 'hovering' AND {MID} THEN 0 ELSE z_velocity END")} AS z_velocity, {r("CASE WHEN kind = 'zone_violation' THEN z_dist_to_runway_m - 2 ELSE z_dist_to_runway_m END")} AS z_dist_to_runway_m
FROM (SELECT *, {SK} AS kind, count(*) OVER (PARTITION BY segment_id) AS n FROM zrow)""", "zrow")

# ---- reconstruction ----
PREV = ", ".join(f"pow(coalesce(lag(z_{c}) OVER ({W}), z_{c}) - z_{c}, 2) AS q_{c}" for c in FEATURES)
cte("err0", "zrow", f"SELECT segment_id, time, valid, {PREV} FROM zrow WHERE step < 15")
cte("err", "err0", "SELECT *, (" + " + ".join(f"q_{c}" for c in FEATURES) + ") / 9 AS se FROM err0")
O["reconstruction_scores"] = query(f"""SELECT segment_id, {r('coalesce(avg(ok), 0)')} AS score_mean, {r('coalesce(max(ok), 0)')} AS score_max, {r('coalesce(avg(ok) FILTER (place <= 2), 0)')} AS score_topk, count(ok) AS valid_steps FROM (
SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY ok DESC NULLS LAST) AS place FROM (SELECT *, CASE WHEN valid THEN se END AS ok FROM err)) GROUP BY 1""", "err")
O["feature_errors"] = query("SELECT segment_id, " + ", ".join(f"{r(f'coalesce(avg(q_{c}) FILTER (valid), 0)')} AS e_{c}" for c in FEATURES) + " FROM err GROUP BY 1", "err")
LAB = "CASE WHEN is_emergency THEN 'emergency' WHEN is_go_around THEN 'go_around' ELSE 'normal' END"
O["step_threshold_p99"] = query(f"SELECT {r('quantile_cont(se, 0.99)')} AS step_threshold, count(*) AS n_steps FROM err WHERE valid AND segment_id IN (SELECT segment_id FROM meta WHERE {LAB} = 'normal')", "err", "meta")

# ---- nearest neighbours ----
cte("tscl", "clean split", "SELECT " + ", ".join(f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1e0 END AS sd_{c}" for c in SCALED)
    + " FROM clean WHERE segment_id IN (SELECT segment_id FROM split WHERE fold = 'train')")
cte("tz", "clean tscl", f"SELECT segment_id, NOT ({MISS}) AS valid, " + ", ".join(f"({c} - mean_{c}) / sd_{c} AS z_{c}" for c in SCALED) + f" FROM (SELECT *, row_number() OVER ({W}) AS st FROM clean), tscl WHERE st <= 15")
VEC = [f"coalesce({f}(z_{c}) FILTER (valid), 0e0)" for f in ("avg", "stddev_pop", "min", "max") for c in SCALED]
cte("vec", "tz split", "SELECT segment_id, any_value(fold) AS fold, " + ", ".join(f"{e} AS f{i}" for i, e in enumerate(VEC)) + " FROM tz JOIN split USING (segment_id) GROUP BY 1")
DIST = "sqrt(" + " + ".join(f"(a.f{i} - b.f{i}) * (a.f{i} - b.f{i})" for i in range(24)) + ")"
O["knn_score"] = query(f"SELECT segment_id, {r('d')} AS score FROM (SELECT a.segment_id, {DIST} AS d, row_number() OVER (PARTITION BY a.segment_id ORDER BY {DIST}) AS rn FROM vec a, vec b WHERE a.fold <> 'train' AND b.fold = 'train') WHERE rn = 5", "vec")

cte("knn5", "vec", f"SELECT segment_id, round(d, 6) AS d FROM (SELECT a.segment_id, {DIST} AS d, row_number() OVER (PARTITION BY a.segment_id ORDER BY {DIST}) AS rn FROM vec a, vec b WHERE a.fold <> 'train' AND b.fold = 'train') WHERE rn = 5")
cte("top20", "err split", "SELECT segment_id, round(coalesce(avg(se) FILTER (valid), 0), 6) AS error FROM err WHERE segment_id IN (SELECT segment_id FROM split WHERE fold <> 'train') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
cte("turned", "clean top20", f"SELECT segment_id, baroaltitude, radians(h - lag(h) OVER (PARTITION BY segment_id ORDER BY time)) AS dh FROM (SELECT *, {pmod('heading + (time // 10 % 4) * 40')} AS h FROM clean WHERE segment_id IN (SELECT segment_id FROM top20))")
O["turning_review"] = query(f"""SELECT segment_id, {r('error')} AS error, {r('turn')} AS turn_deg, {r('alt')} AS alt_range, {r('pct')} AS neighbour_pct, turn > 400 AS circling, coalesce(pct < 50, FALSE) AS near_normal FROM top20
JOIN (SELECT segment_id, coalesce(sum(abs(degrees(atan2(sin(dh), cos(dh))))), 0) AS turn, max(baroaltitude) - min(baroaltitude) AS alt FROM turned GROUP BY 1) USING (segment_id)
LEFT JOIN (SELECT a.segment_id, 1e2 * (SELECT count(*) FROM knn5 b WHERE b.d < a.d) / (SELECT count(*) FROM knn5) AS pct FROM knn5 a) USING (segment_id)""", "top20", "turned", "knn5")

# ---- isolation forest: 200 trees of the 256 rows of least hash ----
cte("vec6", "vec", "SELECT segment_id, fold, [" + ", ".join(f"round(f{i}, 6) + 0e0" for i in range(24)) + "] AS f FROM vec")
cte("fsam", "vec6", f"SELECT tree, segment_id, f FROM (SELECT tree, segment_id, f, row_number() OVER (PARTITION BY tree ORDER BY u, segment_id) AS rn FROM (SELECT tree, segment_id, f, {hu('segment_id', 'CAST(tree AS VARCHAR)', S)} AS u FROM vec6, (SELECT unnest(range(0, 200)) AS tree) WHERE fold = 'train')) WHERE rn <= 256")


def path_length(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0e0 WHEN {n} = 2 THEN 1e0 ELSE 2e0 * (ln({n} - 1e0) + 0.5772156649015329::DOUBLE) - 2e0 * ({n} - 1e0) / {n} END"


def split(source: str) -> str:
    """Rows of nodes with the node's size, feature (from 1; 0 in leaves) and cut."""
    w = "OVER (PARTITION BY tree, node)"
    spans = (f"SELECT *, count(*) {w} AS n, [" + ", ".join(f"min(f[{i}]) {w}" for i in range(1, 25)) + "] AS lows, [" + ", ".join(f"max(f[{i}]) {w}" for i in range(1, 25)) + f"] AS highs FROM ({source})")
    node = "CAST(tree AS VARCHAR)", "CAST(node AS VARCHAR)", S
    varied = f"SELECT *, list_filter(range(1, 25), lambda i: highs[i] > lows[i]) AS varied FROM ({spans})"
    picked = (f"SELECT *, CASE WHEN depth >= ceil(log2(greatest(least(256, (SELECT count(*) FROM vec6 WHERE fold = 'train')), 2))) OR n <= 1 OR len(varied) = 0 THEN 0 ELSE varied[1 + CAST(floor({hu(*node, chr(39) + 'feature' + chr(39))} * len(varied)) AS BIGINT)] END AS feature FROM ({varied})")
    drawn = f"SELECT *, lows[feature] + {hu(*node, chr(39) + 'cut' + chr(39))} * (highs[feature] - lows[feature]) AS drawn FROM ({picked})"
    return f"SELECT tree, node, depth, f, n, feature, CASE WHEN drawn < highs[feature] THEN drawn ELSE lows[feature] END AS cut FROM ({drawn})"


cte("grown", "fsam", split("SELECT tree, 1::BIGINT AS node, 0 AS depth, f FROM fsam") + " UNION ALL " + split("SELECT tree, 2 * node + CAST(f[feature] > cut AS BIGINT) AS node, depth + 1 AS depth, f FROM grown WHERE feature > 0"), recursive=True)
cte("fnode", "grown", f"SELECT DISTINCT tree, node, feature, cut, CASE WHEN feature = 0 THEN depth + {path_length('n')} END AS path FROM grown")
cte("walk", "fnode", "SELECT segment_id, tree, f, 1::BIGINT AS node FROM vec6, (SELECT unnest(range(0, 200)) AS tree) WHERE fold <> 'train' UNION ALL SELECT walk.segment_id, walk.tree, walk.f, 2 * walk.node + CAST(walk.f[x.feature] > x.cut AS BIGINT) FROM walk JOIN fnode x ON x.tree = walk.tree AND x.node = walk.node WHERE x.feature > 0", recursive=True)
O["isolation_forest"] = query(f"SELECT segment_id, {r('pow(2e0, -sum(path) / (SELECT sum(' + path_length('m') + ') FROM (SELECT count(*) AS m FROM fsam GROUP BY tree)))')} AS score FROM walk JOIN fnode x ON x.tree = walk.tree AND x.node = walk.node WHERE x.feature = 0 GROUP BY 1", "walk")

# ---- mixture of 8 diagonal components ----
DIM = range(1, 25)
cte("gstart", "vec6", f"SELECT row_number() OVER (ORDER BY u, segment_id) AS c, f AS m FROM (SELECT segment_id, f, {hu('segment_id', S, chr(39) + 'gmm' + chr(39))} AS u FROM vec6 WHERE fold = 'train' ORDER BY u, segment_id LIMIT 8)")
LOGD = "ln(w) - list_sum(list_transform(range(1, 25), lambda i: (f[i] - m[i]) * (f[i] - m[i]) / v[i] + ln(2e0 * pi() * v[i]))) / 2"
WHOLE = f"SELECT *, top + ln(sum(exp(l - top)) OVER (PARTITION BY segment_id)) AS whole FROM (SELECT *, max(l) OVER (PARTITION BY segment_id) AS top FROM (SELECT *, {LOGD} AS l FROM "
cte("em", "gstart", "SELECT 0 AS step, c, 1e0 / (SELECT count(*) FROM gstart) AS w, m, (SELECT [" + ", ".join(f"greatest(var_pop(f[{i}]), 1e-6)" for i in DIM) + "] FROM vec6 WHERE fold = 'train') AS v, NULL::DOUBLE AS ll, FALSE AS done FROM gstart UNION ALL "
    "SELECT step + 1, c, mass / sum(mass) OVER () AS w, list_transform(sx, lambda x: x / mass) AS m, list_transform(range(1, 25), lambda i: greatest(sxx[i] / mass - (sx[i] / mass) * (sx[i] / mass), 1e-6)) AS v, now AS ll, coalesce(abs(now - ll) < 1e-3, FALSE) AS done FROM ("
    "SELECT *, greatest(n, 1e-9) AS mass, sum(rw) OVER () / greatest(sum(n) OVER (), 1e-9) AS now FROM (SELECT step, c, any_value(ll) AS ll, sum(resp) AS n, sum(resp * whole) AS rw, [" + ", ".join(f"sum(resp * f[{i}])" for i in DIM) + "] AS sx, [" + ", ".join(f"sum(resp * f[{i}] * f[{i}])" for i in DIM)
    + f"] AS sxx FROM (SELECT *, exp(l - whole) AS resp FROM ({WHOLE}(SELECT em.*, segment_id, f FROM em, vec6 WHERE fold = 'train' AND NOT done AND step < 200))))) GROUP BY step, c))", recursive=True)
O["gmm_score"] = query(f"SELECT segment_id, {r('any_value(-whole)')} AS score FROM ({WHOLE}(SELECT em.*, segment_id, f FROM em, vec6 WHERE fold <> 'train' AND step = (SELECT max(step) FROM em))))) GROUP BY 1", "em")

# ---- principal components by orthogonal iteration ----
ZS = [f"z_{c}" for c in FEATURES]
cte("pz", "clean tscl split", f"SELECT *, hdg_sin AS z_hdg_sin, hdg_cos AS z_hdg_cos, CAST(CAST(onground AS INTEGER) AS DOUBLE) AS z_onground FROM (SELECT c.*, fold, NOT ({MISS}) AS valid, " + ", ".join(f"({c} - mean_{c}) / sd_{c} AS z_{c}" for c in SCALED) + f" FROM (SELECT *, row_number() OVER ({W}) AS st FROM clean) c JOIN split USING (segment_id), tscl WHERE st <= 15)")
cte("pcov", "pz", "SELECT [" + ", ".join(f"avg({z})" for z in ZS) + "] AS mu, [" + ", ".join("[" + ", ".join(f"covar_pop({x}, {y})" for y in ZS) + "]" for x in ZS) + "] AS cov FROM pz WHERE fold = 'train'")


def times(q: str) -> str:
    return f"list_transform(cov, lambda line: list_dot_product(line, {q}))"


def without(y: str, *qs: str) -> str:
    return f"list_transform(range(1, 10), lambda i: {y}[i]" + "".join(f" - list_dot_product({y}, {q}) * {q}[i]" for q in qs) + ")"


def scaled_to_one(y: str) -> str:
    return f"list_transform({y}, lambda x: x / sqrt(list_dot_product({y}, {y})))"


cte("axes", "pcov", "SELECT 0 AS step, " + ", ".join("[" + ", ".join("1e0" if i == k else f"{0.01 * (i + 1):.2f}::DOUBLE" for i in range(9)) + f"] AS q{k}" for k in range(3)) + " UNION ALL "
    f"SELECT step + 1, q0, q1, {scaled_to_one('y2')} AS q2 FROM (SELECT step, q0, q1, {without('p2', 'q0', 'q1')} AS y2 FROM (SELECT step, q0, {scaled_to_one('y1')} AS q1, p2 FROM (SELECT step, q0, {without('p1', 'q0')} AS y1, p2 FROM ("
    f"SELECT step, {scaled_to_one('p0')} AS q0, p1, p2 FROM (SELECT step, {times('q0')} AS p0, {times('q1')} AS p1, {times('q2')} AS p2 FROM axes, pcov WHERE step < 1500)))))", recursive=True)
cte("perr", "axes pz", "SELECT segment_id, time, valid, list_sum(list_transform(range(1, 10), lambda i: pow(d[i] - a0 * q0[i] - a1 * q1[i] - a2 * q2[i], 2))) / 9 AS se FROM (SELECT *, list_dot_product(d, q0) AS a0, list_dot_product(d, q1) AS a1, list_dot_product(d, q2) AS a2 FROM ("
    "SELECT segment_id, time, valid, list_transform(range(1, 10), lambda i: z[i] - mu[i]) AS d, q0, q1, q2 FROM (SELECT *, [" + ", ".join(ZS) + "] AS z FROM pz WHERE fold <> 'train'), pcov, (SELECT * FROM axes WHERE step = 1500)))")
O["pca_reconstruction"] = query(O["reconstruction_scores"][O["reconstruction_scores"].rindex("SELECT segment_id, round(CAST(coalesce(avg(ok)"):].replace("FROM err)", "FROM perr)"), "perr")

cte("near5", "pz", """SELECT a.z_lat, a.z_lon, list_last(min(sqrt(pow(a.z_lat - b.z_lat, 2) + pow(a.z_lon - b.z_lon, 2)), 5)) AS d FROM (SELECT DISTINCT z_lat, z_lon FROM pz WHERE valid AND fold <> 'train') a,
(SELECT z_lat, z_lon, unnest(range(0, least(n, 5))) AS copy FROM (SELECT z_lat, z_lon, count(*) AS n FROM pz WHERE valid AND fold = 'train' GROUP BY 1, 2)) b GROUP BY 1, 2""")
O["position_knn"] = query(f"SELECT segment_id, {r('coalesce(avg(d) FILTER (valid), 0)')} AS score FROM pz LEFT JOIN near5 USING (z_lat, z_lon) WHERE fold <> 'train' GROUP BY 1", "near5")

# ---- scores, metrics ----
cte("sfacts", "clean", states("clean"))
cte("scored", "clean sfacts meta", f"""SELECT s.*, f.* EXCLUDE (segment_id), m.icao24, {LAB} AS label, CASE WHEN {LAB} = 'normal' THEN 0 ELSE 1 END AS y FROM (
SELECT segment_id, round(avg(abs(vertrate + 3.9e0)) + avg(abs(velocity - 80e0)) / 10, 6) AS score FROM clean GROUP BY 1) s JOIN sfacts f USING (segment_id) JOIN meta m USING (segment_id)""")


def pairs(source: str, cond: str = "y = 1", neg: str = "y = 0", score: str = "score") -> str:
    return (f"(SELECT avg(CASE WHEN p.{score} > n.{score} THEN 1e0 WHEN p.{score} = n.{score} THEN 5e-1 ELSE 0e0 END) FROM (SELECT {score} FROM {source} WHERE {cond}) p, (SELECT {score} FROM {source} WHERE {neg}) n)")


O["auroc"] = query(f"SELECT {r(pairs('scored'), 6)} AS auroc", "scored")


def steps(source: str, cond: str = "y = 1", neg: str = "y = 0", score: str = "score") -> str:
    return (f"(SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS tpos, sum(neg) OVER () AS tneg FROM ("
            f"SELECT {score} AS s, count(*) FILTER ({cond}) AS pos, count(*) FILTER ({neg}) AS neg FROM {source} GROUP BY 1))")


AP = "sum(CAST(pos AS DOUBLE) / tpos * tp / nullif(tp + fp, 0))"
O["average_precision"] = query(f"SELECT {r(AP, 6)} AS average_precision FROM {steps('scored')}", "scored")
O["pr_curve"] = query(f"SELECT {r('s', 6)} AS threshold, {r('CAST(tp AS DOUBLE) / (tp + fp)', 6)} AS precision, {r('CAST(tp AS DOUBLE) / tpos', 6)} AS recall FROM {steps('scored')}", "scored")
cte("sk", "scored kinds", "SELECT score, kind FROM scored JOIN kinds USING (segment_id)")


def kind_rows(source: str, groups: dict[str, str], neg: str, score: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {extra}'{k}' AS kind, (SELECT count(*) FROM {source} WHERE {c}) AS positives, {r(pairs(source, c, neg, score), 6)} AS auroc, {r(f'(SELECT {AP} FROM {steps(source, c, neg, score)})', 6)} AS average_precision" for k, c in groups.items())


KG = {k: f"kind = '{k}'" for k, _ in INJECTION_MIX} | {"overall": "kind <> 'normal'"}
O["per_type_auroc"] = query("SELECT * FROM (" + kind_rows("sk", KG, "kind = 'normal'", "score") + ") WHERE positives > 0", "sk")
CG = {"go_around": "label = 'go_around'", "emergency": "label = 'emergency'", "overall": "label <> 'normal'"}
cte("sma", "scored", "SELECT label, score AS s0 FROM scored")
cte("smb", "scored", "SELECT label, round(mg, 1) AS s0 FROM scored")
O["metric_by_cohort"] = query("SELECT * FROM (" + kind_rows("sma", CG, "label = 'normal'", "s0", "'a' AS model, ") + " UNION ALL " + kind_rows("smb", CG, "label = 'normal'", "s0", "'b' AS model, ") + ") WHERE positives > 0", "sma", "smb")
F2 = "coalesce(5e0 * tp / nullif(5e0 * tp + 4e0 * (tpos - tp) + fp, 0), 0)"
O["pick_threshold"] = query(f"SELECT {r('s', 6)} AS threshold, {r('f2', 6)} AS f2, {r('fp * 1e0 / tneg', 6)} AS fpr, {r('tp * 1e0 / tpos', 6)} AS recall FROM (SELECT *, round({F2}, 12) AS f2 FROM {steps('scored')}) WHERE fp * 1e0 / tneg <= 0.15e0 ORDER BY f2 DESC, s LIMIT 1", "scored")


def point(op: str, thr: str) -> str:
    f1 = "coalesce(2e0 * tp / nullif(2e0 * tp + fn + fp, 0), 0)"
    f2 = "coalesce(5e0 * tp / nullif(5e0 * tp + 4e0 * fn + fp, 0), 0)"
    return f"""tp, fp, fn, tn, {r(f2, 6)} AS f2, {r(f1, 6)} AS f1, {r('fp * 1e0 / (fp + tn)', 6)} AS fpr, {r('tp * 1e0 / greatest(tp + fn, 1)', 6)} AS recall FROM (SELECT count(*) FILTER (score {op} {thr} AND y = 1) AS tp, count(*) FILTER (score {op} {thr} AND y = 0) AS fp,
count(*) FILTER (NOT score {op} {thr} AND y = 1) AS fn, count(*) FILTER (NOT score {op} {thr} AND y = 0) AS tn, any_value({thr}) AS thr FROM scored0)"""


cte("scored0", "scored", "SELECT *, (SELECT quantile_cont(score, 0.95) FROM scored WHERE y = 0) AS t95 FROM scored")
O["operating_point"] = query("SELECT " + point(">=", "1e0"), "scored0")
O["threshold_p95_normal"] = query(f"SELECT {r('thr', 6)} AS threshold, " + point(">", "t95"), "scored0")
def poisson(u: str, most: int = 16) -> str:
    term, upto, out = math.exp(-1.0), 0.0, []
    for k in range(most):
        upto += term
        out.append(f"CAST({u} >= {upto!r}::DOUBLE AS BIGINT)")
        term /= k + 1
    return " + ".join(out)


cte("boot", "scored", f"SELECT rep, score, y, {poisson('u')} AS w FROM (SELECT score, y, rep, {hu('segment_id', S, 'CAST(rep AS VARCHAR)')} AS u FROM scored, (SELECT unnest(range(0, 1000)) AS rep))")
O["bootstrap_ci"] = query(f"""SELECT {r('quantile_cont(a, 0.025)')} AS lo, {r('quantile_cont(a, 0.975)')} AS hi, count(a) AS replicates FROM (
SELECT sum(p * (below + n / 2e0)) / nullif(sum(p) * sum(n), 0) AS a FROM (SELECT *, sum(n) OVER (PARTITION BY rep ORDER BY score) - n AS below FROM (
SELECT rep, score, sum(w * y) AS p, sum(w * (1 - y)) AS n FROM boot GROUP BY 1, 2)) GROUP BY rep)""", "boot")
O["precision_at_k"] = query("SELECT CAST(sum(y) AS BIGINT) AS hits, count(*) AS k FROM (SELECT y FROM scored ORDER BY score DESC, segment_id LIMIT 50)", "scored")
O["weak_ecdf_percentile"] = query(f"SELECT segment_id, {r('score', 6)} AS score, {r('100 * cume_dist() OVER (ORDER BY score)', 6)} AS pct FROM scored", "scored")
O["strict_percentile_vs_normal"] = query(f"SELECT segment_id, {r('score', 6)} AS score, {r('(SELECT count(*) * 1e2 / (SELECT count(*) FROM scored WHERE y = 0) FROM scored n WHERE n.y = 0 AND n.score < s.score)', 6)} AS pct FROM scored s", "scored")
cte("few", "split", "SELECT DISTINCT icao24 FROM split WHERE fold = 'train' AND segment_id LIKE '%5#1'")
cte("su", "scored split few", "SELECT s.score, s.y, s.icao24 IN (SELECT icao24 FROM few) AS seen FROM scored s JOIN split p USING (segment_id) WHERE p.block <> 'train'")
O["seen_unseen"] = query(" UNION ALL ".join(f"SELECT {b} AS seen, {r(pairs('su', f'y = 1 AND seen = {b}', f'y = 0 AND seen = {b}'))} AS auroc WHERE EXISTS (SELECT 1 FROM su WHERE seen = {b})" for b in ("TRUE", "FALSE")), "su")

# ---- queue ----
cte("q1", "scored", f"SELECT *, {BAND} AS band, score >= 1 AS anomalous, concat('OP-', replace(upper(split_part(segment_id, '#', 1)), '_', '-')) AS operation_ref, concat('c_', {b32('dg', 10)}) AS case_id, CAST(split_part(segment_id, '#', 2) AS BIGINT) AS no FROM ("
    "SELECT *, 100 * cume_dist() OVER (ORDER BY score) AS pct, sha256(segment_id) AS dg FROM scored)")
O["build_queue"] = query(f"SELECT segment_id, {r('score')} AS score, {r('pct')} AS pct, band, anomalous, case_id, operation_ref, label, assessment_state FROM q1", "q1")
RV = "assessment_state = 'reviewable'"


def band_of(e: str) -> str:
    return BAND.replace("pct", e)


O["operation_summary"] = query(f"""SELECT operation_ref, n AS segment_count, fl AS flagged_segment_count, labels_seen, ce AS has_confirmed_event, mf AS has_model_flag_unlabeled, bf AS behavioral_flagged_segment_count, ok AS reviewable_segment_count, dq AS data_quality_segment_count, cl AS coverage_limited_segment_count,
tm AS terminal_segment_count, tr AS truncated_segment_count, {r('w.score')} AS worst_score, {r('w.pct')} AS worst_pct, {band_of('w.pct')} AS worst_band, w.case_id AS worst_case_id, w.segment_id AS worst_segment_id, {r('b.score')} AS behavioral_worst_score, {r('b.pct')} AS behavioral_worst_pct,
CASE WHEN b.segment_id IS NOT NULL THEN {band_of('b.pct')} END AS behavioral_worst_band, b.case_id AS behavioral_worst_case_id, n - ok AS not_assessable_segment_count, CASE WHEN ok > 0 THEN 'reviewable' ELSE 'not_assessable' END AS behavioral_assessment,
CASE WHEN tm = 0 THEN 'likely artifact' WHEN tm = n THEN 'mostly terminal' ELSE 'mixed' END AS data_quality_summary, CASE WHEN ok = n THEN 'reviewable' WHEN ok = 0 THEN 'not assessable' ELSE 'mixed evidence' END AS assessment_summary FROM (
SELECT operation_ref, count(*) AS n, count(*) FILTER (anomalous) AS fl, string_agg(DISTINCT label, ',' ORDER BY label) AS labels_seen, bool_or(label <> 'normal') AS ce, bool_or(anomalous AND label = 'normal') AS mf, count(*) FILTER (anomalous AND {RV}) AS bf, count(*) FILTER ({RV}) AS ok,
count(*) FILTER (review_lane = 'data_quality') AS dq, count(*) FILTER (review_lane = 'coverage') AS cl, count(*) FILTER (terminal_op) AS tm, count(*) FILTER (truncated) AS tr, arg_max(segment_id, (score, -no)) AS ws, arg_max(segment_id, (score, -no)) FILTER ({RV}) AS bs FROM q1 GROUP BY 1) g
JOIN q1 w ON w.segment_id = g.ws LEFT JOIN q1 b ON b.segment_id = g.bs""".replace("SELECT operation_ref, n AS", "SELECT g.operation_ref, n AS"), "q1")
O["queue_summary"] = query(f"""SELECT count(*) AS n_segments, count(DISTINCT operation_ref) AS n_operations, count(*) FILTER (label <> 'normal') AS n_real_anomalies, count(*) FILTER (score >= 1) AS n_anomalous, count(*) FILTER (truncated) AS n_truncated, count(*) FILTER (NOT terminal_op) AS n_nonterminal,
{', '.join(f"count(*) FILTER (assessment_state = '{s}') AS n_{s}" for s in ('reviewable', 'data_quality_conflict', 'insufficient_data', 'coverage_limited'))}, {r('round(quantile_cont(score, 0.5), 6)', 6)} AS median_score FROM q1""", "q1")
O["rank_queue_modes"] = query(" UNION ALL ".join(f"SELECT * FROM (SELECT segment_id, {r('score')} AS score, '{m}' AS mode FROM q1, (SELECT median(score) AS mid FROM q1) ORDER BY {o}, segment_id LIMIT 50)" for m, o in (("anomalous", "q1.score DESC"), ("normal", "q1.score"), ("typical", "abs(q1.score - mid)"))), "q1")
cte("picked", "q1", """SELECT segment_id FROM q1 WHERE label <> 'normal' UNION SELECT * FROM (SELECT segment_id FROM q1 WHERE label = 'normal' ORDER BY score DESC, segment_id LIMIT 40)
UNION SELECT * FROM (SELECT segment_id FROM q1, (SELECT median(score) AS mid FROM q1) WHERE label = 'normal' ORDER BY abs(q1.score - mid), segment_id LIMIT 20)""")
O["select_cases"] = query("SELECT * FROM picked", "picked")
O["queue_with_cases"] = query("SELECT segment_id, case_id, segment_id IN (SELECT segment_id FROM picked) AS has_case FROM q1", "picked")
O["siblings_context"] = query("SELECT flight_id, segment_id, time FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY time) - 1 AS rn, count(*) OVER (PARTITION BY flight_id) AS n FROM clean) WHERE rn % greatest(1, n // 5) = 0", "clean")

"""SQL for assessment, fitting, context, reports and disclosure."""

import oracles.sources  # noqa: F401  (the decoded reports)
from oracles.base import ROW_CRITERIA, assessed, biased, bins, crits, cte, frame, limits, long_rows, pmod, query, r, spans
from skyledger.operators.approach import CRITERIA

ORACLE: dict[str, str] = {}
O = ORACLE
K = "flight_id, cluster"

O["runway_candidates"] = query(f"SELECT flight_id, runway, count(*) AS n_rows, {r('min(dist)')} AS min_dist FROM (SELECT flight_id, runway, {frame()} FROM obs, rwy) GROUP BY 1, 2", "obs", "rwy")
O["runway_score"] = query(f"SELECT {K}, runway, gate_rows, rows_used, span_s, {r('lat_part')} AS \"lateral\", {r('track_error')} AS track_error, {r('min_dist')} AS min_dist, {r('score')} AS score FROM scores", "scores")
FIN = "CASE WHEN score_margin < 1e9 THEN score_margin END"
O["infer_runway"] = query(f"SELECT {K}, runway, geometry_runway, direction, specificity, {r('confidence')} AS confidence, {r(FIN)} AS score_margin, reason FROM inferred", "inferred")
FATAL = ("concat_ws(',', CASE WHEN n < 20 THEN 'insufficient_observations' END, CASE WHEN d < 90 THEN 'insufficient_duration' END, CASE WHEN g > 60 THEN 'approach_coverage_gap' END, "
         "CASE WHEN s > 400 THEN 'position_rate_conflict' END)")
O["quality_gates"] = query(f"""SELECT {K}, n AS n_rows, d AS duration_s, {r('g')} AS max_gap_s, {r('s')} AS max_ground_speed, {r('v')} AS max_vertical_rate, {FATAL} AS fatal, v > 50 AS altitude_rate_conflict FROM (
SELECT {K}, count(*) AS n, max(time) - min(time) AS d, coalesce(max(gap_s), 0) AS g, coalesce(max(ground_rate), 0) AS s, coalesce(max(vertical_rate), 0) AS v FROM framed GROUP BY 1, 2)""", "framed")
O["attempt_outcome"] = query(f"SELECT DISTINCT {K}, oc AS outcome, m_ix AS maneuver_idx FROM oc", "oc")
O["criterion_window"] = query(f"SELECT {K}, start_time, end_time, criterion_end_time, observed_samples, n_rows AS criterion_samples, maneuver_time, terminal FROM asd", "asd")
O["vertical_bias"] = query(f"SELECT {K}, {r('bias')} AS bias, bias_source FROM asd", "asd")
for key, name in zip(("crit_lateral", "crit_baro_path", "crit_descent", "crit_speed", "crit_track"), CRITERIA):
    O[key] = query(f"SELECT {K}, status, seen AS observed_samples FROM crit WHERE criterion = '{name}'", "crit")
EV = f"{K}, criterion, start_idx, end_idx, start_time, end_time, worst_idx, worst_time, {r('value')} AS value, {r('lim')} AS \"limit\", {r('along')} AS along"
O["criterion_evidence"] = query(f"SELECT {EV} FROM span", "span")
O["criterion_evidence_fixed"] = query(f"SELECT {EV} FROM span0", "span0")
AS = (f"start_time, end_time, runway, specificity, status, outcome, reasons, advisories, failed, observed_samples, {r('max_gap_s')} AS max_gap_s, {r('max_ground_speed')} AS max_ground_speed, "
      f"{r('max_vertical_rate')} AS max_vertical_rate, {r('min_threshold_m')} AS min_threshold_m, " + ", ".join(CRITERIA))
O["assess_attempt"] = query(f"SELECT {K}, {AS} FROM asd0", "asd0")
O["assess_operations"] = query(f"SELECT flight_id, attempt_no, {AS} FROM asd", "asd")
cte("attf", "att", f"SELECT *, {frame()} FROM att")
O["reference_lookup"] = query("SELECT flight_id, time, b.bin, CASE WHEN e.bin IS NULL THEN NULL WHEN time % 2 = 0 THEN 'exact' ELSE 'unknown_speed_class' END AS fallback, "
                              + ", ".join(f"{r('e.' + c)} AS {c}" for c in ("speed_lo", "speed_hi", "rate_lo", "rate_hi"))
                              + f" FROM (SELECT *, CASE WHEN along >= 0 THEN {bins('along')} END AS bin FROM attf) b LEFT JOIN env e ON e.direction = b.direction AND e.bin = b.bin", "attf", "env")

# ---- context ----
cte("akey", "att", f"SELECT {K}, (min(time) + max(time)) // 2 AS midpoint, any_value(bearing) AS bearing, split_part(flight_id, '_', 1) AS icao24 FROM att GROUP BY 1, 2")


def with_weather(source: str, shown: str = "") -> str:
    return f"""SELECT a.*, w.observed_at, a.midpoint - w.observed_at AS age_s, CASE WHEN w.observed_at IS NULL THEN 'weather_observation_not_yet_available' WHEN a.midpoint - w.observed_at > 1800 THEN 'latest_prior_weather_observation_too_old' END AS weather_reason,
CASE WHEN a.midpoint - w.observed_at <= 1800 THEN qnh_hpa END AS qnh_hpa, CASE WHEN a.midpoint - w.observed_at <= 1800 THEN wind_from_deg END AS wind_from_deg, CASE WHEN a.midpoint - w.observed_at <= 1800 THEN wind_speed END AS wind_speed, {shown}
r.typecode, r.icao24 IS NOT NULL AS registered FROM {source} a ASOF LEFT JOIN wx w ON a.midpoint >= w.observed_at LEFT JOIN reg r ON r.icao24 = a.icao24"""


cte("ctx0", "akey wx reg", with_weather("akey", ", ".join(f"CASE WHEN a.midpoint - w.observed_at <= 1800 THEN {e} END AS {c}" for c, e in (("report_age_s", "a.midpoint - w.observed_at"), ("temperature_c", "temperature_c"), ("dew_point_c", "dew_point_c"))) + ","))
A = f"radians({pmod('wind_from_deg - bearing')})"
cte("ctx", "ctx0", f"SELECT *, wind_speed * cos({A}) AS headwind, wind_speed * sin({A}) AS crosswind, (1013.25e0 - qnh_hpa) * 9.144e0 AS qnh_bias, coalesce(typecode, 'unknown') AS speed_class FROM ctx0")
O["aircraft_lookup"] = query(f"SELECT {K}, icao24, registered, typecode FROM ctx", "ctx")
O["asof_weather"] = query(f"SELECT {K}, midpoint, observed_at, age_s, weather_reason, {r('qnh_hpa')} AS qnh_hpa, {r('wind_speed')} AS wind_speed FROM ctx", "ctx")
O["attempt_context"] = query(f"SELECT {K}, {r('headwind')} AS headwind, {r('crosswind')} AS crosswind, {r('qnh_bias')} AS qnh_bias, speed_class, weather_reason FROM ctx", "ctx")

# ---- fitting ----
REJ = "CASE WHEN status = 'not_assessable' THEN 'quality_or_coverage' WHEN outcome IN ('go_around', 'incomplete') THEN outcome END"
O["reference_eligible"] = query(f"SELECT {REJ} AS reject_reason, count(*) AS attempts FROM asd0 GROUP BY 1", "asd0")


def refrows(source: str) -> str:
    return (f"SELECT *, CASE WHEN velocity BETWEEN 0 AND 150 THEN velocity END AS speed_ok, CASE WHEN abs(vertrate) <= 25 THEN vertrate END AS rate_ok FROM (SELECT * EXCLUDE (speed_class), unnest(list_distinct([speed_class, 'unknown'])) AS speed_class FROM ("
            f"SELECT *, {bins('along')} AS bin FROM (SELECT a.*, c.speed_class FROM {source} a JOIN ctx c USING (flight_id, cluster))) WHERE bin IS NOT NULL AND (velocity IS NOT NULL OR vertrate IS NOT NULL))")


cte("rrows", "attf ctx", refrows("attf"))
O["reference_rows"] = query(f"SELECT direction, speed_class, bin, count(*) AS n_rows, count(speed_ok) AS speed_samples, {r('sum(along)')} AS along_sum FROM rrows GROUP BY 1, 2, 3", "rrows")
GRID = "[" + ", ".join(f"{i / 100!r}" for i in range(101)) + "]"


def balanced(source: str, value: str, keys: str = "direction, speed_class, bin") -> str:
    return f"SELECT {keys}, unnest(g) AS v FROM (SELECT {keys}, {K}, quantile_cont({value}, {GRID}) AS g FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys}, {K})"


O["attempt_balanced_quantiles"] = query(f"SELECT direction, speed_class, bin, count(*) AS n, {r('min(v)')} AS lo, {r('max(v)')} AS hi, {r('avg(v)')} AS mean FROM ({balanced('rrows', 'speed_ok')}) GROUP BY 1, 2, 3", "rrows")
cte("tatt", "attf asd0", f"SELECT * EXCLUDE (y0) FROM (SELECT *, year(make_timestamp(CAST(min(time) OVER (PARTITION BY {K}) * 1000000 AS BIGINT))) AS y0 FROM attf WHERE ({K}) IN (SELECT ({K}) FROM asd0 WHERE {REJ} IS NULL)) WHERE y0 <= 2018".replace(f"({K}) IN (SELECT ({K}) FROM asd0 WHERE {REJ} IS NULL)", f"EXISTS (SELECT 1 FROM asd0 z WHERE z.flight_id = attf.flight_id AND z.cluster = attf.cluster AND {REJ} IS NULL)"))
cte("trows", "tatt ctx", refrows("tatt"))
C3 = "direction, speed_class, bin"
cte("fit", "trows", f"""SELECT c.*, s.pooled, s.speed_lo, s.speed_hi, v.rate_lo, v.rate_hi FROM (SELECT {C3}, count(DISTINCT (flight_id, cluster)) AS attempt_count, count(speed_ok) AS speed_samples, count(rate_ok) AS rate_samples FROM trows GROUP BY 1, 2, 3) c
JOIN (SELECT {C3}, count(*) AS pooled, round(quantile_cont(v, 0.01), 4) AS speed_lo, round(quantile_cont(v, 0.99), 4) AS speed_hi FROM ({balanced('trows', 'speed_ok')}) GROUP BY 1, 2, 3) s USING ({C3})
JOIN (SELECT {C3}, round(quantile_cont(v, 0.01), 4) AS rate_lo, round(quantile_cont(v, 0.99), 4) AS rate_hi FROM ({balanced('trows', 'rate_ok')}) GROUP BY 1, 2, 3) v USING ({C3})
WHERE attempt_count >= 20 AND speed_samples >= 100 AND rate_samples >= 100""")
BOUNDS = ", ".join(f"{r(c, 6)} AS {c}" for c in ("speed_lo", "speed_hi", "rate_lo", "rate_hi"))
O["fit_reference"] = query(f"SELECT {C3}, attempt_count, speed_samples, rate_samples, pooled, {BOUNDS} FROM fit", "fit")
cte("yrows", "trows", f"SELECT t.*, y.year FROM trows t JOIN (SELECT {K}, year(make_timestamp(CAST(min(time) * 1000000 AS BIGINT))) AS year FROM trows GROUP BY 1, 2) y USING ({K}) WHERE speed_class = 'unknown'")
Y3 = "year, direction, bin"
cte("ycell", "yrows", f"""SELECT c.*, s.sm, v.rm FROM (SELECT {Y3}, count(DISTINCT (flight_id, cluster)) AS n FROM yrows GROUP BY 1, 2, 3) c JOIN (SELECT {Y3}, round(median(v), 4) AS sm FROM ({balanced('yrows', 'speed_ok', Y3)}) GROUP BY 1, 2, 3) s USING ({Y3})
JOIN (SELECT {Y3}, round(median(v), 4) AS rm FROM ({balanced('yrows', 'rate_ok', Y3)}) GROUP BY 1, 2, 3) v USING ({Y3}) WHERE n >= 20""")
cte("drift", "ycell fit", """SELECT y.direction, y.bin, years, round(s / (speed_hi - speed_lo), 4) AS ss, round(r / (rate_hi - rate_lo), 4) AS rs FROM (SELECT direction, bin, count(*) AS years, max(sm) - min(sm) AS s, max(rm) - min(rm) AS r FROM ycell GROUP BY 1, 2 HAVING count(*) >= 2) y JOIN (SELECT * FROM fit WHERE speed_class = 'unknown') e ON e.direction = y.direction AND e.bin = y.bin""")
O["year_drift"] = query(f"SELECT direction, bin, years, {r('ss', 6)} AS speed_shift, {r('rs', 6)} AS rate_shift, greatest(ss, rs) <= 0.5 AS within_limit FROM drift", "drift")
O["drift_verdict"] = query(f"""SELECT count(*) AS comparisons, count(*) FILTER (greatest(ss, rs) > 0.5) AS above_limit, {r('max(greatest(ss, rs))', 6)} AS max_shift, 0.5e0 AS acceptance_limit,
CASE WHEN max(greatest(ss, rs)) <= 0.5 THEN 'pass' ELSE 'review' END AS status FROM drift""", "drift")
cte("fitatt", "trows", f"SELECT {K}, CAST(year(make_timestamp(CAST(min(time) * 1000000 AS BIGINT))) AS VARCHAR) AS yr, min(direction) AS direction, coalesce(max(speed_class) FILTER (speed_class <> 'unknown'), 'unknown') AS speed_class FROM trows GROUP BY flight_id, cluster")
O["fit_diagnostics"] = query(" UNION ALL ".join(f"SELECT '{d}' AS dimension, {c} AS value, count(*) AS attempts FROM fitatt GROUP BY 2" for d, c in (("year", "yr"), ("direction", "direction"), ("speed_class", "speed_class"), ("accepted", "'all'"))), "fitatt")
O["validate_reference"] = query("""SELECT direction, speed_class, bin, CASE WHEN bin = '0-1500' THEN CASE WHEN speed_hi + 1 > 150 THEN 'speed_bounds_out_of_order' ELSE 'speed_bounds_out_of_order' END ELSE CASE WHEN rate_lo > 30 THEN 'x' ELSE 'rate_bounds_implausible' END END AS problems FROM fit WHERE bin IN ('0-1500', '1500-3000')""", "fit")

# ---- contextual ----
cte("ctxo", "ctx", f"SELECT {K}, CASE WHEN abs(qnh_bias) <= 500 THEN qnh_bias END AS bias_override, speed_class FROM ctx")
cte("biasc", "q meds ctxo", biased("bias_override", "'qnh_pressure_altitude_proxy'") + " JOIN ctxo USING (flight_id, cluster))")
cte("limc", "biasc fit", limits("biasc", "fit", "speed_class"))
cte("crowc", "limc", long_rows("limc"))
cte("spanc", "crowc", spans("crowc"))
cte("critc", "crowc spanc", crits("crowc", "spanc"))
cte("asdc", "limc critc", assessed("limc", "critc"))
O["assess_contextual"] = query(f"SELECT {K}, status, outcome, {r('bias')} AS bias, bias_source, fallbacks, failed, " + ", ".join(CRITERIA) + f", report_age_s, {r('temperature_c')} AS temperature_c, {r('dew_point_c')} AS dew_point_c, CASE WHEN list_contains(string_split(fallbacks, ','), 'unknown_speed_class') AND x.speed_class <> 'unknown' THEN x.speed_class || ',unknown' ELSE x.speed_class END AS effective_classes FROM asdc LEFT JOIN (SELECT {K}, report_age_s, temperature_c, dew_point_c, speed_class FROM ctx) x USING ({K})", "asdc", "ctx")
cte("pairs", "asd asdc", f"SELECT a.flight_id, a.cluster, a.status AS base_status, c.status AS context_status, c.fallbacks FROM asd a JOIN asdc c ON a.flight_id = c.flight_id AND a.cluster = c.cluster")
O["base_vs_context"] = query("SELECT * FROM pairs", "pairs")
RB, RC = "base_status = 'review_required'", "context_status = 'review_required'"


def share(a: str, b: str) -> str:
    return r(f"round(CAST({a} AS DOUBLE) / {b}, 4)", 6)


O["context_comparison"] = query(f"""SELECT count(*) AS attempts, 0 AS unpaired, count(*) FILTER ({RB} AND {RC}) AS "both", count(*) FILTER (NOT {RB} AND {RC}) AS context_only, count(*) FILTER ({RB} AND NOT {RC}) AS base_only,
{share(f'count(*) FILTER ({RB})', "count(*) FILTER (base_status <> 'not_assessable')")} AS base_review_rate, {share(f'count(*) FILTER ({RC})', "count(*) FILTER (context_status <> 'not_assessable')")} AS context_review_rate,
{share("count(*) FILTER (contains(fallbacks, 'exact'))", 'count(*)')} AS any_exact, {share("count(*) FILTER (fallbacks = 'exact')", 'count(*)')} AS all_exact FROM pairs""", "pairs")
O["status_transitions"] = query("SELECT concat(base_status, '->', context_status) AS transition, count(*) AS n FROM pairs GROUP BY 1", "pairs")
cte("fkey", "asd", f"SELECT {K}, status, bearing, barometric_path_proxy, (start_time + end_time) // 2 AS midpoint, split_part(flight_id, '_', 1) AS icao24 FROM asd")
cte("facts", "fkey wx reg", with_weather("fkey"))
RATES = {"weather_match": "age_s <= 1800", "qnh": "qnh_hpa IS NOT NULL", "wind_speed": "wind_speed IS NOT NULL", "wind_direction": "wind_from_deg IS NOT NULL",
         "wind_components": "wind_speed IS NOT NULL AND wind_from_deg IS NOT NULL", "aircraft_metadata": "registered", "aircraft_typecode": "typecode IS NOT NULL",
         "path_current": "barometric_path_proxy <> 'not_observed'", "path_upper_bound": "qnh_hpa IS NOT NULL"}


def rate(n: str) -> str:
    return f"(CAST(count(*) FILTER ({RATES[n]}) AS DOUBLE) / count(*))"


O["context_coverage"] = query("SELECT count(*) AS attempts, " + ", ".join(f"{r(f'round({rate(n)}, 4)', 6)} AS {n}_rate" for n in RATES) + ", " + ", ".join(
    f"CASE WHEN {rate(n)} >= {m} THEN 'passed' ELSE 'failed' END AS gate_{g}" for g, n, m in (("weather_qnh", "qnh", 0.95), ("wind_direction", "wind_direction", 0.8), ("aircraft_type", "aircraft_typecode", 0.8))) + " FROM facts", "facts")
cte("wxm", "wx1", "SELECT observed_at, qnh AS qnh_hpa, wdir AS wind_from_deg, wspd AS wind_speed, missing_reasons FROM wx1")
cte("facts2", "fkey wxm reg", f"SELECT f.*, m.missing_reasons FROM ({with_weather('fkey').replace('JOIN wx w', 'JOIN wxm w')}) f LEFT JOIN wxm m ON m.observed_at = f.observed_at")
O["weather_missing_reasons"] = query("""SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(CASE WHEN weather_reason IS NOT NULL THEN weather_reason
ELSE concat_ws(',', missing_reasons, CASE WHEN abs((1013.25e0 - qnh_hpa) * 9.144e0) > 500 THEN 'qnh_pressure_altitude_proxy_outside_supported_bias' END) END, ',')) AS reason FROM facts2) WHERE reason <> '' GROUP BY 1""", "facts2")
O["top_typecodes"] = query("SELECT typecode, count(*) AS n FROM facts WHERE typecode IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "facts")
O["supplied_context"] = query("""SELECT flight_id, sparse AS sparse_weather_context, conf AS conflicting_aircraft_context FROM (SELECT flight_id, k, k % 8 = 0 AND count(*) FILTER (i % 10 = 0 AND i % 20 <> 0) > 0 AND count(*) FILTER (i % 20 = 0) > 0 AS sparse,
k % 5 = 0 AND count(*) FILTER (i = 3) > 0 AND count(*) FILTER (i < 9 AND i <> 3) > 0 AS conf FROM obs GROUP BY 1, 2) WHERE sparse OR conf""", "obs")

# ---- reports ----


def sections(source: str, extra: str = "") -> str:
    parts = [f"SELECT 'status' AS section, status AS key FROM {source}", f"SELECT 'outcome', outcome FROM {source}", f"SELECT 'direction', coalesce(direction, 'unknown') FROM {source}"]
    parts += [f"SELECT 'criterion:{c}', {c} FROM {source}" for c in CRITERIA]
    parts += [f"SELECT 'reason', unnest(string_split(reasons, ',')) FROM {source} WHERE reasons <> ''", f"SELECT 'advisory', advisories FROM {source} WHERE advisories <> ''"]
    return f"SELECT section, key, count(*) AS n FROM ({' UNION ALL '.join(parts)}{extra}) GROUP BY 1, 2"


cte("head", "asd obs", """SELECT (SELECT count(*) FROM obs) AS rows, (SELECT count(DISTINCT flight_id) FROM obs) AS operations, count(DISTINCT flight_id) AS operations_with_attempts, count(*) AS attempts, count(*) FILTER (status <> 'not_assessable') AS assessable_attempts,
round(CAST(count(*) FILTER (status = 'not_assessable') AS DOUBLE) / count(*), 4) AS abstention_rate, round(CAST(count(*) FILTER (status = 'review_required') AS DOUBLE) / count(*) FILTER (status <> 'not_assessable'), 4) AS review_rate_among_assessable FROM asd""")
HEAD = ("rows", "operations", "operations_with_attempts", "attempts", "assessable_attempts", "abstention_rate", "review_rate_among_assessable")
O["dataset_audit"] = query(" UNION ALL ".join(f"SELECT 'headline' AS section, '{c}' AS key, {r(c, 6)} AS value FROM head" for c in HEAD) + f" UNION ALL SELECT section, key, {r('n', 6)} FROM ({sections('asd')})", "head")
cte("asdt", "asd fold", "SELECT * FROM asd WHERE flight_id IN (SELECT flight_id FROM fold WHERE fold = 'train')")
O["feasibility_report"] = query(sections("asdt", " UNION ALL SELECT 'specificity', specificity FROM asdt UNION ALL SELECT 'altitude_source', bias_source FROM asdt"), "asdt")
O["feasibility_examples"] = query("SELECT flight_id, attempt_no, status, runway, reasons, failed FROM asd ORDER BY 1, 2 LIMIT 25", "asd")
O["attempt_queue_counts"] = query("SELECT status, outcome, count(*) AS n FROM asd GROUP BY 1, 2", "asd")
QF = "concat_ws(',', nullif(array_to_string(list_sort(list_distinct(string_split(concat_ws(',', nullif(reasons, ''), nullif(advisories, '')), ','))), ','), ''))"
AID = "concat(flight_id, ':attempt-', CAST(attempt_no AS VARCHAR))"
cte("summ", "asd", f"SELECT *, {AID} AS attempt_id, {QF} AS quality_flags FROM asd")
O["attempt_summary"] = query(f"SELECT attempt_id, flight_id AS operation_id, status, direction, runway, geometry_runway, specificity, {r('round(confidence, 4)', 6)} AS confidence, {r(f'round({FIN}, 4)', 6)} AS score_margin, failed, outcome, observed_samples, {r('max_gap_s', 6)} AS max_gap_s, "
                             "start_time, end_time, reasons, quality_flags FROM summ", "summ")
PRI = "CASE status WHEN 'review_required' THEN 0 WHEN 'partial_observation' THEN 1 WHEN 'criteria_observed' THEN 2 WHEN 'not_assessable' THEN 3 ELSE 99 END"
O["rank_attempts"] = query(f"SELECT attempt_id, status, start_time FROM summ ORDER BY {PRI}, start_time DESC, attempt_id", "summ")
O["filter_attempt_queue"] = query(f"SELECT attempt_id, direction, outcome, start_time FROM summ WHERE status = 'review_required' AND contains(failed, 'observed_descent_rate') ORDER BY {PRI}, start_time DESC, attempt_id", "summ")
O["landing_outcome"] = query(f"SELECT {K}, outcome IN ('landing_observed', 'touch_and_go') AS available, CASE WHEN outcome IN ('landing_observed', 'touch_and_go') THEN NULL WHEN outcome = 'go_around' THEN 'go_around_observed' WHEN last_along > 0 THEN 'evidence_ends_before_threshold' ELSE 'landing_not_observed' END AS reason, {r('round(last_along, 1)')} AS evidence_end_along_m FROM asd", "asd")
O["quality_flag_union"] = query(f"SELECT {K}, quality_flags AS flags FROM summ", "summ")
O["case_path"] = query(f"SELECT {K}, time, {r('along')} AS along, {r('cross_m')} AS \"cross\", {r('baroaltitude - elevation')} AS height, {r(pmod('heading - bearing + 180e0') + ' - 180e0')} AS track_offset FROM attf", "attf")
O["sample_evenly"] = query(f"""SELECT a.flight_id, a.cluster, a.time FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY time) - 1 AS rn, count(*) OVER (PARTITION BY {K}) AS n FROM att) a
WHERE n <= 20 OR EXISTS (SELECT 1 FROM (SELECT unnest(range(0, 20)) AS j) WHERE j * (n - 1) // 19 = rn)""", "att")
O["cap_evidence"] = query(f"SELECT {K}, criterion, start_idx, greatest(n - 25, 0) AS evidence_truncated FROM (SELECT *, row_number() OVER (PARTITION BY {K}, criterion ORDER BY start_idx) AS rn, count(*) OVER (PARTITION BY {K}, criterion) AS n FROM span) WHERE rn <= 25", "span")
O["evaluation_ref"] = query(f"SELECT {K}, concat('ae_', substring(sha256(concat_ws('|', 'digest', flight_id, CAST(attempt_no AS VARCHAR), CAST(start_time AS VARCHAR), CAST(end_time AS VARCHAR))), 1, 20)) AS evaluation_ref FROM asd", "asd")

# ---- disclosure ----
cte("cmap", "asd", "SELECT concat(geometry_runway, ':', specificity) AS section, concat(status, '/', outcome) AS key, count(*) AS n FROM asd GROUP BY 1, 2")
cte("nmap", "asd", f"SELECT * FROM ({sections('asd')}) WHERE section LIKE 'criterion:%'")


def hidden(source: str) -> str:
    return f"""SELECT *, CASE WHEN n BETWEEN 1 AND 9 THEN '<10' WHEN anys AND rk = 1 AND n > 9 THEN 'suppressed' END AS flag FROM (SELECT *, bool_or(n BETWEEN 1 AND 9) OVER (PARTITION BY section) AS anys, sum(n) OVER (PARTITION BY section) AS total,
row_number() OVER (PARTITION BY section ORDER BY CASE WHEN n > 9 THEN 0 ELSE 1 END, n DESC, key) AS rk FROM {source})"""


O["suppress_small_cells"] = query(f"SELECT section, key, flag, CASE WHEN flag IS NULL THEN n END AS value FROM ({hidden('cmap')})", "cmap")
O["suppress_nested"] = query(f"SELECT section, key, flag, CASE WHEN flag IS NULL THEN n END AS value FROM ({hidden('nmap')})", "nmap")
O["published_rate"] = query(f"SELECT section, key, flag, CASE WHEN flag IS NULL THEN n END AS value, {r('CASE WHEN flag IS NULL THEN round(CAST(n AS DOUBLE) / total, 4) END', 6)} AS rate FROM ({hidden('cmap')})", "cmap")
cte("cmap2", "cmap obs", "SELECT section, key, n FROM cmap UNION ALL SELECT 'kinds', concat('kind ', CAST(kind AS VARCHAR)), CASE WHEN kind = 4 THEN least(n, 1) ELSE least(n, 10) END "
    "FROM (SELECT k % 16 AS kind, count(*) AS n FROM obs GROUP BY 1) WHERE kind IN (4, 9)")
# Enumerate the value of each hidden cell that leaves the others a feasible rest.
O["suppression_recoverable"] = query(f"""SELECT section, key FROM (SELECT h.section, h.key, count(*) AS ways FROM ({hidden('cmap2')}) h JOIN (SELECT section, count(*) FILTER (flag = '<10') AS p, count(*) FILTER (flag = 'suppressed') AS c, sum(n) FILTER (flag IS NOT NULL) AS rest FROM ({hidden('cmap2')}) GROUP BY 1) s ON s.section = h.section,
(SELECT unnest(range(1, 10)) AS v) WHERE h.flag = '<10' AND CASE WHEN c > 0 THEN rest - v - (p - 1) >= 10 ELSE rest - v BETWEEN p - 1 AND 9 * (p - 1) END GROUP BY 1, 2) WHERE ways = 1""", "cmap2")

"""Position reports derived from the orders table, with plain arithmetic.

Every order contributes eight consecutive reports to the flight numbered by its key, so the view
grows with the table. The arithmetic uses only operations that give the same bits in any engine.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.config import EARTH_RADIUS_M, RUNWAYS

BASE_TIME = 1_496_620_800
YEAR_S = 31_536_000
# Fixed value: orders whose flights one task sorts (eight reports each).
ORDERS_PER_TASK = 40_000
_BY_NAME = {r.designator: r for r in RUNWAYS}
_USED = tuple(_BY_NAME[n] for n in ("18L", "18R", "32L", "32R"))
_DEG_PER_M = 180.0 / (math.pi * EARTH_RADIUS_M)


def number(value: float) -> str:
    """A double literal both engines read as a double."""
    text = repr(float(value))
    return text if "e" in text else text + "e0"


def _pick(values) -> str:
    cases = " ".join(f"WHEN {i} THEN {number(v) if isinstance(v, float) else repr(v)}" for i, v in enumerate(values))
    return f"CASE m % 4 {cases} END"


# Each step is a list of (name, expression) added to the columns of the step before.
STEPS = (
    (("kind", "k % 16"), ("m", "CAST(floor(k / 16e0) AS BIGINT)"),
     ("yr", "CAST(floor(k / 64e0) AS BIGINT) % 4")),
    (("step", "2 + 3 * ((k + m) % 2)"), ("runway0", _pick([r.designator for r in _USED])),
     ("sin_b", _pick([math.sin(math.radians(r.bearing)) for r in _USED])),
     ("cos_b", _pick([math.cos(math.radians(r.bearing)) for r in _USED])),
     ("lat0", _pick([r.lat for r in _USED])), ("lon0", _pick([r.lon for r in _USED])),
     ("deg_lon", _pick([_DEG_PER_M / math.cos(math.radians(r.lat)) for r in _USED])),
     ("elev0", _pick([r.elevation for r in _USED])), ("bearing0", _pick([r.bearing for r in _USED]))),
    (("along0", "1.2e4 - 75e0 * step * i"),),
    (("cross0", "CASE WHEN kind = 4 AND along0 BETWEEN 5e3 AND 8e3 THEN 2e4 "
                "WHEN kind = 9 THEN 9e2 ELSE 1e1 * (k % 7) END"),
     ("t0", f"{BASE_TIME} + yr * {YEAR_S} + k * 7201")),
    (("east0", "-along0 * sin_b + cross0 * cos_b"), ("north0", "-along0 * cos_b - cross0 * sin_b"),
     ("icao24", "concat('a', lpad(CAST(k % 60 AS {text}), 5, '0'))"), ("time", "t0 + step * i")),
    (("lat", f"lat0 + north0 * {number(_DEG_PER_M)}"), ("lon", "lon0 + east0 * deg_lon"),
     ("alt0", "CASE WHEN kind = 5 THEN 1.0668e4 "
              "WHEN kind = 13 AND along0 < 2.5e3 THEN elev0 + 1.31019448e2 + 1.2e-1 * (2.5e3 - along0) "
              "WHEN along0 > 0e0 THEN elev0 + 5.24077793e-2 * along0 ELSE elev0 END "
              "+ CASE WHEN kind = 15 AND i = 20 THEN 2.5e3 ELSE 0e0 END")),
    (("flight_id", "concat(icao24, '_', CAST(t0 AS {text}))"),
     ("baroaltitude", "CASE WHEN (3 * k + i) % 41 = 0 THEN NULL ELSE alt0 END"),
     ("geoaltitude", "CASE WHEN (3 * k + i) % 37 = 0 THEN NULL ELSE alt0 + 3e1 END"),
     ("velocity", "CASE WHEN (k + i) % 23 = 0 THEN NULL WHEN kind = 6 THEN 5e1 WHEN kind = 7 THEN 1.1e2 "
                  "ELSE 8e1 + 2e-1 * ((7 * k + 3 * i) % 11 - 5) END"),
     ("vertrate", "CASE WHEN kind = 8 THEN -1.2e1 WHEN kind = 13 AND along0 < 2.5e3 THEN 9e0 ELSE -3.9e0 END"),
     ("heading", "bearing0 + CASE WHEN kind = 10 AND along0 < 3e3 THEN 2.5e1 ELSE 0e0 END"),
     ("onground", "kind = 14 AND along0 < 3e2"),
     ("callsign", "concat('FLT', CAST(k % 500 AS {text}))"),
     ("squawk", "CASE WHEN k % 97 = 5 THEN 7700 ELSE 1000 + k % 4000 END"),
     ("alert", "k % 53 = 0"), ("spi", "k % 59 = 0"),
     ("lastcontact", "time - i % 20"), ("lastposupdate", "time - i % 5")),
)
KEEP = ("along0 >= -4e2 AND NOT (kind = 11 AND along0 BETWEEN 1e3 AND 7e3) "
        "AND NOT (kind = 12 AND along0 < 9e3)")
COLUMNS = ("k", "i", "flight_id", "time", "icao24", "lat", "lon", "baroaltitude", "geoaltitude", "velocity",
           "vertrate", "heading", "onground", "callsign", "squawk", "alert", "spi", "lastcontact",
           "lastposupdate")


def _moving() -> frozenset[str]:
    """The derived columns that differ between the reports of an order."""
    found = {"i"}
    for step in STEPS:
        found |= {n for n, e in step if found & set(re.findall(r"[a-z_]\w*", e))}
    return frozenset(found)


MOVING = _moving()


def spread(keys: DataFrame) -> DataFrame:
    """The same rows over all tasks when the scan has fewer splits than there are shuffle partitions: layout only."""
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(tasks, *keys.columns) if keys.rdd.getNumPartitions() < tasks else keys


def flight_tasks(spark: SparkSession, sf_dir: str, per_task: int = ORDERS_PER_TASK) -> int:
    """Tasks for work that keeps flights together, in proportion to the table and at least the session's number."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # from the file footers
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-orders // per_task))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")).selectExpr("o_orderkey div 10 AS k", "o_orderkey % 10 * 8 AS first_")


def _shared(rows: DataFrame) -> DataFrame:
    """Add what all reports of an order share."""
    for step in STEPS:
        rows = rows.selectExpr("*", *[f"{e.format(text='STRING')} AS {n}" for n, e in step if n not in MOVING])
    return rows


def _reports(rows: DataFrame, *more: str) -> DataFrame:
    """The reports of orders with their shared columns."""
    rows = rows.select("*", F.explode(F.expr("sequence(first_, first_ + 7)")).alias("i"))
    for step in STEPS:
        rows = rows.selectExpr("*", *[f"{e.format(text='STRING')} AS {n}" for n, e in step if n in MOVING])
    return rows.filter(KEEP).select(*COLUMNS, *more)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation view: one row per aircraft and second, with its flight id.

    What all reports of an order share is computed once, before the order is listed as reports.
    """
    return _reports(_shared(_orders(spark, sf_dir)))


def observations_by_month(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """The same rows with their month, each month in one of `tasks` tasks: orders move to the months of their reports, reports do not move."""
    time = next(e for step in STEPS for n, e in step if n == "time")
    months = F.array_distinct(F.expr(f"transform(sequence(first_, first_ + 7), i -> date_format(timestamp_seconds({time}), 'yyyyMM'))"))
    dealt = _shared(_orders(spark, sf_dir)).select("k", "first_", F.explode(months).alias("month")).repartition(tasks, "month")
    return _reports(_shared(dealt), "month").filter(F.date_format(F.timestamp_seconds("time"), "yyyyMM") == F.col("month"))


def observations_sql() -> str:
    """The same view as one query for an engine that has the orders table registered."""
    inner = ("SELECT o_orderkey // 10 AS k, o_orderkey % 10 * 8 + j AS i FROM orders, "
             "(SELECT unnest(range(0, 8)) AS j)")
    for step in STEPS:
        cols = ", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, e in step)
        inner = f"SELECT *, {cols} FROM ({inner})"
    return f"SELECT {', '.join(COLUMNS)} FROM ({inner}) WHERE {KEEP}"


def with_copies(obs: DataFrame) -> DataFrame:
    """A feed with repeated rows: a third of the rows twice, and some of those copies disagree."""
    return (
        obs.select("*", F.explode(F.sequence(F.lit(0), F.expr("CASE WHEN (k + i) % 3 = 0 THEN 1 ELSE 0 END"))).alias("copy"))
        .withColumn("velocity", F.expr("CASE WHEN copy = 1 AND (k + i) % 5 = 0 THEN velocity + 1e0 ELSE velocity END"))
        .drop("copy")
    )


def with_copies_sql() -> str:
    return ("SELECT * EXCLUDE (copy, velocity), CASE WHEN copy = 1 AND (k + i) % 5 = 0 THEN velocity + 1e0 "
            "ELSE velocity END AS velocity FROM (SELECT *, unnest(range(0, CASE WHEN (k + i) % 3 = 0 THEN 2 ELSE 1 END)) "
            "AS copy FROM obs)")


MASKED = (
    # what a row is: 0 as it was, 1 an imputed position far off, 2 a copy, 3 a report without a position
    ("time", "CASE WHEN variant IN (1, 3) THEN time + 1 ELSE time END"),
    ("lat", "CASE WHEN variant = 1 THEN lat + 5e-1 WHEN variant = 3 THEN NULL ELSE lat END"),
    ("lon", "CASE WHEN variant = 1 THEN lon - 5e-1 ELSE lon END"),
    ("lat_missing", "variant = 1"), ("lon_missing", "variant = 1"),
)
VARIANTS = ("variant = 0 OR (variant = 1 AND (k + i) % 7 = 3) OR (variant = 2 AND (k + i) % 11 = 4) OR (variant = 3 AND (k + i) % 13 = 5)",
            "list_filter([0, CASE WHEN (k + i) % 7 = 3 THEN 1 END, CASE WHEN (k + i) % 11 = 4 THEN 2 END, CASE WHEN (k + i) % 13 = 5 THEN 3 END], lambda x: x IS NOT NULL)")


def with_masks(obs: DataFrame) -> DataFrame:
    """A grid with imputed positions between the real ones, copies and reports without a position."""
    rows = obs.select("*", F.explode(F.array(*[F.lit(n) for n in range(4)])).alias("variant")).filter(VARIANTS[0])
    kept = [c for c in obs.columns if c not in dict(MASKED)]
    return rows.selectExpr(*kept, *[f"{e} AS {n}" for n, e in MASKED])


def with_masks_sql() -> str:
    kept = [c for c in COLUMNS if c not in dict(MASKED)]
    return f"SELECT {', '.join(kept)}, {', '.join(f'{e} AS {n}' for n, e in MASKED)} FROM (SELECT *, unnest({VARIANTS[1]}) AS variant FROM obs)"


def weather_reports(obs: DataFrame) -> DataFrame:
    """One decoded report per half hour of the observed span, every 20th missing.

    The span is cut into days first and the days are dealt over the tasks, so no task holds the whole span.
    """
    span = obs.agg(F.expr("floor(min(time) / 3600) * 3600").alias("a"), F.expr("floor(max(time) / 3600) * 3600 + 3600").alias("b"))
    days = span.select(F.explode(F.expr("sequence(a, b, 86400L)")).alias("from_"), "b")
    tasks = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        days.repartition(tasks, "from_").select(F.explode(F.expr("sequence(from_, least(from_ + 84600L, b), 1800L)")).alias("observed_at"))
        .withColumn("h", F.expr("observed_at div 1800"))
        .filter("h % 20 <> 7")
        .select(
            F.lit("08221099999").alias("station"), "observed_at", "h",
            F.expr("1e3 + h % 30").alias("qnh_hpa"),
            F.expr("CASE WHEN h % 9 = 0 THEN NULL ELSE CAST(17 * h % 360 AS DOUBLE) END").alias("wind_from_deg"),
            F.expr("CASE WHEN h % 11 = 0 THEN NULL ELSE 2e0 + h % 8 END").alias("wind_speed"),
            F.expr("CASE WHEN h % 17 = 0 THEN NULL ELSE h % 300 / 1e1 - 5e0 END").alias("temperature_c"),
            F.expr("CASE WHEN h % 19 = 0 THEN NULL ELSE h % 150 / 1e1 - 5e0 END").alias("dew_point_c"),
        )
    )


def weather_reports_sql() -> str:
    return ("SELECT '08221099999' AS station, observed_at, h, 1e3 + h % 30 AS qnh_hpa, "
            "CASE WHEN h % 9 = 0 THEN NULL ELSE CAST(17 * h % 360 AS DOUBLE) END AS wind_from_deg, "
            "CASE WHEN h % 11 = 0 THEN NULL ELSE 2e0 + h % 8 END AS wind_speed, "
            "CASE WHEN h % 17 = 0 THEN NULL ELSE h % 300 / 1e1 - 5e0 END AS temperature_c, CASE WHEN h % 19 = 0 THEN NULL ELSE h % 150 / 1e1 - 5e0 END AS dew_point_c FROM "
            "(SELECT observed_at, observed_at // 1800 AS h FROM (SELECT unnest(range(a, b + 1, 1800)) AS observed_at "
            "FROM (SELECT min(time) // 3600 * 3600 AS a, max(time) // 3600 * 3600 + 3600 AS b FROM obs))) "
            "WHERE h % 20 <> 7")


def registry(obs: DataFrame) -> DataFrame:
    """One registry row per aircraft seen; one in ten has no type, one in seven is missing."""
    return (
        obs.select("icao24").distinct()
        .withColumn("n", F.expr("CAST(substring(icao24, 2) AS BIGINT)"))
        .filter("n % 7 <> 3")
        .select("icao24",
                F.expr("CASE WHEN n % 10 = 9 THEN NULL WHEN n % 3 = 0 THEN 'A320' WHEN n % 3 = 1 THEN 'B738' "
                       "ELSE 'E190' END").alias("typecode"),
                F.expr("CASE WHEN n % 2 = 0 THEN 'Airbus' ELSE 'Boeing' END").alias("manufacturername"))
    )


def registry_sql() -> str:
    return ("SELECT icao24, CASE WHEN n % 10 = 9 THEN NULL WHEN n % 3 = 0 THEN 'A320' WHEN n % 3 = 1 THEN 'B738' "
            "ELSE 'E190' END AS typecode, CASE WHEN n % 2 = 0 THEN 'Airbus' ELSE 'Boeing' END AS manufacturername "
            "FROM (SELECT DISTINCT icao24, CAST(substring(icao24, 2) AS BIGINT) AS n FROM obs) WHERE n % 7 <> 3")


def weather_text(wx: DataFrame) -> DataFrame:
    """The same reports in the text form of an hourly file, with both report types on even hours."""
    return (
        wx.select("*", F.explode(F.expr("CASE WHEN h % 2 = 0 THEN array('FM-12', 'FM-15') ELSE array('FM-12') END")).alias("REPORT_TYPE"))
        .selectExpr("station AS STATION", "observed_at", "h", "REPORT_TYPE", *[f"{e.format(text='STRING')} AS {n}" for n, e in WEATHER_TEXT])
    )


WEATHER_TEXT = (
    ("WND", "concat(CASE WHEN wind_from_deg IS NULL THEN '999' ELSE lpad(CAST(CAST(wind_from_deg AS BIGINT) AS {text}), 3, '0') END, "
            "',', CASE WHEN h % 13 = 0 THEN '3' ELSE '1' END, ',N,', "
            "CASE WHEN wind_speed IS NULL THEN '9999' ELSE lpad(CAST(CAST(wind_speed * 10 AS BIGINT) AS {text}), 4, '0') END, ',1')"),
    ("TMP", "CASE WHEN h % 17 = 0 THEN '+9999,9' ELSE concat(CASE WHEN h % 2 = 0 THEN '+' ELSE '-' END, "
            "lpad(CAST(h % 300 AS {text}), 4, '0'), ',1') END"),
    ("DEW", "CASE WHEN h % 19 = 0 THEN '+0050,2' ELSE concat('+', lpad(CAST(h % 150 AS {text}), 4, '0'), ',1') END"),
    ("MA1", "CASE WHEN h % 23 = 0 THEN '99999,9' ELSE concat(CAST(CAST(qnh_hpa * 10 AS BIGINT) AS {text}), ',1,99999,9') END"),
    ("REM", "CASE WHEN h % 29 = 0 THEN 'MET NOSIG' ELSE concat('METAR LEMD Q', "
            "lpad(CAST(CAST(qnh_hpa AS BIGINT) + CASE WHEN h % 31 = 0 THEN 2 ELSE 0 END AS {text}), 4, '0'), ' NOSIG=') END"),
)


def weather_text_sql() -> str:
    cols = ", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, e in WEATHER_TEXT)
    return (f"SELECT station AS STATION, observed_at, h, REPORT_TYPE, {cols} FROM (SELECT *, "
            "unnest(CASE WHEN h % 2 = 0 THEN ['FM-12', 'FM-15'] ELSE ['FM-12'] END) AS REPORT_TYPE FROM wx)")

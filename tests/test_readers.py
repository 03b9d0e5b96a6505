"""Headers in any order, repeated headers, the scratch folder, registry and weather look-ups."""

import hashlib

import pytest

from skyledger import session
from skyledger.config import STATE_COLUMNS
from skyledger.operators import context
from skyledger.sources import day_ranges, readers


def test_state_columns_are_found_by_name(spark, tmp_path):
    names = list(reversed(STATE_COLUMNS))
    values = {c: str(k) for k, c in enumerate(STATE_COLUMNS)} | {"onground": "true", "alert": "false", "spi": "false"}
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(values[c] for c in names) + "\n")
    row = readers.scan_states_csv(spark, str(tmp_path / "a.csv")).first()
    assert row.time == int(values["time"]) and row.lat == float(values["lat"]) and row.icao24 == values["icao24"] and row.onground is True


def test_a_repeated_header_is_named_as_such(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,icao24,time\n1,a,2\n")
    with pytest.raises(ValueError, match="duplicate"):
        readers.scan_validated_input(spark, str(tmp_path / "a.csv"), "csv")


def test_no_private_scratch_folder_on_a_cluster():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session())


def test_registry_rows_of_one_aircraft_give_a_stable_type(spark):
    registry = spark.createDataFrame([(" A1 ", "b738", "x"), ("a1", "A320", "y"), ("a1", "", "z"), ("b2", " ", "w")], "icao24 string, typecode string, maker string")
    attempts = spark.createDataFrame([("a1",), ("b2",), ("c3",)], "icao24 string")
    got = {r.icao24: (r.typecode, r.registered) for r in context.aircraft_lookup(attempts, registry).collect()}
    assert got == {"a1": ("A320", True), "b2": (None, True), "c3": (None, False)}


def test_a_blank_type_code_is_no_second_type(spark):
    schema = "flight_id string, qnh_hpa double, wind_from_direction_deg double, wind_speed_mps double, aircraft_typecode string"
    df = spark.createDataFrame([("f", 1.0, 2.0, 3.0, "A320"), ("f", 1.0, 2.0, 3.0, " "), ("g", 1.0, 2.0, 3.0, "A320"), ("g", 1.0, 2.0, 3.0, "B738")], schema)
    assert [(r.flight_id, r.conflicting_aircraft_context) for r in context.supplied_context_violations(df).collect()] == [("g", True)]


def test_weather_of_the_day_before_still_counts(spark):
    day = 86_400
    reports = spark.createDataFrame([("s", day - 600, 1.0), ("s", 3 * day, 2.0)], "station string, observed_at long, qnh_hpa double")
    attempts = spark.createDataFrame([("a", "s", day + 300), ("b", "s", 2 * day), ("c", "s", 3 * day + 5), ("d", "s", 10), ("e", "t", day)], "id string, station string, midpoint long")
    got = {r.id: (r.weather and r.weather.qnh_hpa, r.weather_reason) for r in context.asof_weather(attempts, reports).collect()}
    assert got == {"a": (1.0, None), "b": (None, "latest_prior_weather_observation_too_old"), "c": (2.0, None),
                   "d": (None, "weather_observation_not_yet_available"), "e": (None, "weather_observation_unavailable")}


def test_rows_are_numbered_over_splits(spark, tmp_path):
    """Files cut into many splits: numbers follow the lines of each file, without its header."""
    for name, n in (("a", 4_000), ("b", 900), ("c", 0)):
        (tmp_path / f"{name}.csv").write_text("time,icao24\n" + "".join(f"{k},{name}{k}\n" for k in range(1, n + 1)))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = readers.scan_upload_csv(spark, str(tmp_path), ["time", "icao24"])
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        found = rows.collect()
    finally:
        for c, value in old.items():
            spark.conf.set(c, value)
    assert len(found) == 4_900
    assert all(int(r.time) == r.row and r.file.endswith(f"{r.icao24[0]}.csv") for r in found)


def test_a_file_is_digested_in_chunks(spark, tmp_path):
    """An empty file, one with odd characters in its name and one above 2 GiB (with a hole)."""
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "a b%41.bin").write_bytes(b"abc" * 1_000_003)
    with open(tmp_path / "large.bin", "wb") as f:
        f.seek((1 << 31) + 5)
        f.write(b"end")
    got = {r.name: (r.bytes, r.sha256) for r in readers.file_manifest(spark, str(tmp_path)).collect()}
    large = hashlib.sha256()
    for _ in range(1 << 11):
        large.update(bytes(1 << 20))
    large.update(bytes(5) + b"end")
    assert got == {"empty.bin": (0, hashlib.sha256().hexdigest()), "a b%41.bin": (3_000_009, hashlib.sha256(b"abc" * 1_000_003).hexdigest()),
                   "large.bin": ((1 << 31) + 8, large.hexdigest())}


def test_day_ranges_cover_each_row_once(spark, tmp_path):
    """Negative times, rows on both ends of a day, days without rows, rows without a time."""
    day = 86_400
    times = [-day, -1, 0, day - 1, day, 5 * day + 7, 6 * day, None]
    rows = spark.createDataFrame([(t, f"r{k}", None if k % 2 else 0.5 * k) for k, t in enumerate(times)], "time long, name string, lat double")
    path = str(tmp_path / "days")
    day_ranges.write_by_day_ranges(rows, path, days=2)
    read = day_ranges.scan_stored_day_ranges(spark, path, rows.schema, -10 * day, 10 * day, days=2)
    assert sorted(read.collect()) == sorted(r for r in rows.collect() if r.time is not None)
    assert read.rdd.getNumPartitions() == 4
    part = day_ranges.scan_stored_day_ranges(spark, path, rows.schema, 0, 5 * day + 7, days=2)
    assert {r.name for r in part.collect()} == {"r2", "r3", "r4", "r5"}
    few = read.filter(f"time >= {5 * day} AND time < {6 * day}")
    assert few.rdd.getNumPartitions() == 1 and [r.name for r in few.collect()] == ["r5"]
    assert read.filter("time > 90000000").count() == 0

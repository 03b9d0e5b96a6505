"""Thresholds and fixed tables. Everything else in the package takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
AIRPORT = (40.4719, -3.5626)
BBOX_HALF_WIDTH_DEG = 1.8
MAX_RADIUS_M = 200_000.0

FLIGHT_GAP_S = 1_800
SEGMENT_GAP_S = 180
GRID_S = 10
SECONDS_PER_DAY = 86_400


# Limits of the approach rules.
@dataclass(frozen=True)
class ApproachConfig:
    """Limits of the approach rules; distances in metres, rates in m/s, angles in degrees."""

    gate_along: float = 20_000.0
    gate_cross: float = 6_000.0
    gate_height: float = 3_000.0
    terminal_distance: float = 6_000.0
    terminal_height: float = 800.0
    min_samples: int = 20
    min_duration_s: int = 90
    max_gap_s: int = 60
    max_ground_speed: float = 400.0
    max_vertical_rate: float = 50.0
    min_track_speed: float = 30.0
    infer_min_rows: int = 8
    infer_min_duration_s: int = 60
    infer_window_s: int = 600
    max_score: float = 4.0
    min_direction_margin: float = 0.35
    min_exact_margin: float = 0.20
    persist_rows: int = 3
    persist_s: int = 20
    reentry_gap_s: int = 180
    extension_s: int = 180
    lateral_along: float = 6_000.0
    lateral_floor: float = 150.0
    lateral_slope: float = 0.10
    path_along: float = 10_000.0
    path_angle: float = 3.0
    path_low: float = 120.0
    path_high: float = 200.0
    descent_height: float = 1_000.0
    descent_limit: float = -7.6
    track_along: float = 3_000.0
    track_limit: float = 15.0


DEFAULT = ApproachConfig()


@dataclass(frozen=True)
class Runway:
    designator: str
    lat: float
    lon: float
    bearing: float
    elevation: float
    landing: bool

    @property
    def direction(self) -> str:
        return self.designator[:2]


# Published runway thresholds (designator, lat, lon, true bearing, elevation, landing).
RUNWAYS = (
    Runway("14L", 40.494919444, -3.557869444, 142.21, 592.0, False),
    Runway("32R", 40.473569444, -3.536194444, 322.22, 574.8, True),
    Runway("14R", 40.484861111, -3.576011111, 142.20, 608.0, False),
    Runway("32L", 40.463083333, -3.553894444, 322.21, 589.1, True),
    Runway("18L", 40.528116667, -3.559355556, 179.76, 585.9, True),
    Runway("36R", 40.501102778, -3.559208333, 359.76, 592.0, False),
    Runway("18R", 40.522888889, -3.574797222, 179.76, 606.9, True),
    Runway("36L", 40.492588889, -3.574622222, 359.76, 605.0, False),
)
LANDING_RUNWAYS = tuple(r for r in RUNWAYS if r.landing)

# The eight older runway points used only for the closest-runway distance.
LEGACY_POINTS = {
    "14L": (40.5205, -3.5959),
    "14R": (40.5157, -3.5791),
    "32L": (40.4651, -3.5450),
    "32R": (40.4700, -3.5615),
    "18L": (40.5072, -3.5339),
    "18R": (40.5072, -3.5191),
    "36L": (40.4450, -3.5191),
    "36R": (40.4450, -3.5339),
}

# Edges of the distance classes of the envelope, in metres.
DISTANCE_BINS = (0.0, 1_500.0, 3_000.0, 6_000.0, 10_000.0, 20_000.0)
MIN_CELL_ATTEMPTS = 20
MIN_CELL_SAMPLES = 100
MAX_SPEED = 150.0
MAX_RATE = 25.0

# Published percentile envelope, aircraft class 'unknown'
# (direction, distance bin, speed low, speed high, vertical rate low, vertical rate high).
PUBLISHED_ENVELOPE = (
    ("18", "0-1500", 60.7044, 82.3126, -5.4035, -0.4487),
    ("18", "1500-3000", 61.7354, 82.3175, -5.527, -2.2758),
    ("18", "3000-6000", 64.324, 84.3748, -6.5024, -1.9507),
    ("18", "6000-10000", 66.3653, 98.2642, -7.1526, -1.9507),
    ("18", "10000-20000", 76.1394, 119.3521, -9.4285, -1.3005),
    ("32", "0-1500", 62.0904, 85.0966, -5.527, -0.3251),
    ("32", "1500-3000", 61.7365, 85.8155, -5.527, -0.9754),
    ("32", "3000-6000", 64.1159, 89.4339, -5.8522, -2.2758),
    ("32", "6000-10000", 67.815, 102.2864, -7.1526, -1.9507),
    ("32", "10000-20000", 77.0671, 122.9618, -8.4531, 1.3005),
)

WEATHER_MAX_AGE_S = 1_800
WEATHER_STATION = "08221099999"
STANDARD_PRESSURE_HPA = 1013.25
METRES_PER_HPA = 9.144
MAX_ALTITUDE_BIAS_M = 500.0

# The column lists of the cleaning job and the detectors.
MEASURED = ("lat", "lon", "baroaltitude", "velocity", "vertrate", "heading")
INTERPOLATED = ("lat", "lon", "baroaltitude", "velocity", "vertrate")
SCALED = ("lat", "lon", "baroaltitude", "velocity", "vertrate", "dist_to_runway_m")
FEATURES = SCALED + ("hdg_sin", "hdg_cos", "onground")
IDENTIFIERS = ("icao24", "flight_id", "segment_id", "callsign")
EMERGENCY_SQUAWKS = (7500, 7600, 7700)


# Limits of the cleaning job.
@dataclass(frozen=True)
class PrepConfig:
    """Limits of the historical cleaning job."""

    gap_s: int = SEGMENT_GAP_S
    move_speed: float = 2.5
    min_rows: int = 30
    max_velocity: float = 400.0
    max_vertrate: float = 50.0
    max_altitude: float = 16_000.0
    min_altitude: float = -100.0
    placeholder_altitude: float = 1_000.0


PREP = PrepConfig()

# Share of each injected kind.
INJECTION_MIX = (
    ("zone_violation", 0.40),
    ("altitude_high", 0.20),
    ("sustained_loiter", 0.20),
    ("final_approach_intercept", 0.10),
    ("speed_spike", 0.10),
)

# The dates of each fold of the published temporal split.
FOLD_DATES = {
    "train": ("2017-06-05", "2017-07-31", "2017-10-02", "2017-12-04", "2018-01-29",
              "2018-06-04", "2018-07-30", "2018-10-01", "2018-12-03"),
    "val": ("2019-01-28", "2019-04-01", "2019-06-03", "2019-07-29", "2019-09-30"),
    "test": ("2020-01-27", "2020-02-03", "2020-02-24", "2020-03-09"),
}

# Column contract of an uploaded file.
REQUIRED_COLUMNS = ("time", "icao24", "lat", "lon", "baroaltitude", "velocity", "heading",
                    "vertrate", "onground")
OPTIONAL_COLUMNS = ("callsign", "squawk", "geoaltitude", "alert", "spi", "lastcontact", "qnh_hpa",
                    "wind_from_direction_deg", "wind_speed_mps", "aircraft_typecode")
IGNORED_COLUMNS = ("flight_id", "segment_id", "operation", "flight_phase", "dist_to_runway_m",
                   "time_utc", "velocity_kmh", "is_emergency", "n_imputed_impossible",
                   "n_imputed_missing")
STATE_COLUMNS = ("time", "icao24", "lat", "lon", "velocity", "heading", "vertrate", "callsign",
                 "onground", "alert", "spi", "squawk", "baroaltitude", "geoaltitude",
                 "lastposupdate", "lastcontact")
DERIVED_STATE_COLUMNS = ("time", "icao24", "lat", "lon", "baroaltitude", "geoaltitude", "velocity",
                         "heading", "vertrate", "callsign", "onground", "squawk", "alert", "spi",
                         "lastcontact", "flight_id", "operation", "time_utc", "velocity_kmh",
                         "dist_to_runway_m", "flight_phase")
